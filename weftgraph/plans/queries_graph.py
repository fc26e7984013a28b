"""Queries over the property graph of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, graph, rollup, vectors
from . import starschema as star

N, E = star.NODES_SQL, star.EDGES_SQL
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


DEGREES = """
deg AS (
  SELECT n.id, n.node_type, n.is_public, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree
  FROM nodes n LEFT JOIN (SELECT target_id, count(*) AS c FROM edges GROUP BY 1) i ON i.target_id = n.id
  LEFT JOIN (SELECT source_id, count(*) AS c FROM edges GROUP BY 1) o ON o.source_id = n.id
)"""
IMPORTANCE = """
raw AS (
  SELECT id, node_type, (in_degree * 1.0::DOUBLE + out_degree * 0.5::DOUBLE + CASE node_type WHEN 'module' THEN 0.3::DOUBLE WHEN 'class' THEN 0.4 WHEN 'function' THEN 0.2
    WHEN 'method' THEN 0.1 WHEN 'config' THEN 0.3 WHEN 'type_def' THEN 0.15 ELSE 0.05 END) * CASE WHEN is_public THEN 1.2::DOUBLE ELSE 1.0 END AS r FROM deg
),
imp AS (SELECT id, node_type, round(r / (SELECT max(r) FROM raw), 3) AS importance FROM raw)"""


@query(f"WITH {N}, {E}, {DEGREES}, {IMPORTANCE} SELECT id, node_type, importance FROM imp ORDER BY importance DESC, id LIMIT 50")
def importance_topk(spark: SparkSession, sf: str) -> DataFrame:
    scored = graph.importance(star.nodes(spark, sf), star.edges(spark, sf))
    return scored.orderBy(F.desc("importance"), "id").limit(50).select("id", "node_type", "importance")


@query(f"WITH {N}, {E}, {DEGREES} SELECT id, in_degree::BIGINT AS in_degree, out_degree::BIGINT AS out_degree FROM deg")
def degree_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(star.nodes(spark, sf), star.edges(spark, sf))


@query(f"WITH {N}, {E} SELECT 'total_nodes' AS measure, count(*)::BIGINT AS value FROM nodes UNION ALL SELECT 'total_files', count(DISTINCT file_path) FROM nodes UNION ALL SELECT 'total_edges', count(*) FROM edges")
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_stats(star.nodes(spark, sf), star.edges(spark, sf))


@query(f"WITH {N} SELECT node_type, count(*)::BIGINT AS n FROM nodes GROUP BY 1")
def type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.type_counts(star.nodes(spark, sf))


@query(f"""WITH {N}, {E}, ends AS (SELECT source_id AS id, edge_type FROM edges UNION ALL SELECT target_id, edge_type FROM edges),
agg AS (SELECT id, count(*)::DOUBLE AS n, count(*) FILTER (edge_type = 'uses') AS u, count(*) FILTER (edge_type = 'contains') AS c FROM ends GROUP BY 1)
SELECT n.id, coalesce(u / n, 0.0) AS uses, coalesce(c / n, 0.0) AS contains FROM nodes n LEFT JOIN agg USING (id)""".replace("u / n, 0.0", "agg.u / agg.n, 0.0").replace("c / n, 0.0", "agg.c / agg.n, 0.0"))
def edge_profile(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edge_profile(star.nodes(spark, sf), star.edges(spark, sf)).select("id", "uses", "contains")


@query(f"""WITH {N}, {E}, {DEGREES} SELECT id, CASE WHEN in_degree = 0 AND out_degree = 0 THEN 'no connections'
ELSE concat_ws(', ', CASE WHEN out_degree > 0 THEN '→ ' || out_degree || ' out' END, CASE WHEN in_degree > 0 THEN '← ' || in_degree || ' in' END) END AS connections_summary FROM deg""")
def connections_summary(spark: SparkSession, sf: str) -> DataFrame:
    return graph.connections_summary(star.nodes(spark, sf), star.edges(spark, sf))


@query(f"""WITH {N}, {E}, s AS (SELECT id FROM nodes WHERE node_type = 'class'),
c AS (SELECT DISTINCT source_id, target_id FROM edges WHERE edge_type = 'contains'),
parent AS (SELECT s.id AS start, max(source_id) AS id FROM s JOIN c ON c.target_id = s.id GROUP BY 1)
SELECT s.id AS start, 'child' AS role, target_id AS id FROM s JOIN c ON c.source_id = s.id
UNION ALL SELECT start, 'parent', id FROM parent
UNION ALL SELECT start, 'sibling', target_id FROM parent JOIN c ON c.source_id = parent.id WHERE target_id <> start""")
def neighborhood_roles(spark: SparkSession, sf: str) -> DataFrame:
    n = star.nodes(spark, sf, "region", "nation", "customer", "supplier", "orders")
    return graph.neighborhood(n, star.contains(spark, sf), n.filter("node_type = 'class'"))


@query(f"""WITH {star.EVENT_GRAPH_SQL}, one AS (SELECT DISTINCT source_id, target_id FROM calls)
SELECT target_id AS start, 'caller' AS role, source_id AS id FROM one UNION ALL SELECT source_id, 'callee', target_id FROM one""")
def call_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    n, e = star.event_graph(spark, sf)
    return graph.neighborhood(n, e, n)


IMPACT_SQL = f"""WITH RECURSIVE {N}, {E}, back AS (SELECT target_id AS src, source_id AS dst FROM edges WHERE edge_type = 'contains'),
walk(start, id, hop) AS (
  SELECT id, id, 0 FROM nodes WHERE node_type = 'module'
  UNION SELECT w.start, b.src, w.hop + 1 FROM walk w JOIN back b ON b.dst = w.id WHERE w.hop < 4
),
first AS (SELECT start, id, min(hop) AS hop FROM walk GROUP BY 1, 2)"""


@query(IMPACT_SQL + " SELECT start, id, hop::INT AS hop FROM first WHERE hop > 0")
def impact_radius(spark: SparkSession, sf: str) -> DataFrame:
    n = star.nodes(spark, sf, "region", "nation", "customer", "supplier", "orders")
    return graph.impact(n, star.inherits(spark, sf), n.filter("node_type = 'module'"), max_depth=3)


@query(IMPACT_SQL + ", named AS (SELECT f.start, n.file_path, n.name FROM first f JOIN nodes n USING (id) WHERE hop > 0) SELECT start, file_path, count(*)::BIGINT AS affected, string_agg(name, ',' ORDER BY name) AS names FROM named GROUP BY 1, 2")
def impact_by_file(spark: SparkSession, sf: str) -> DataFrame:
    n = star.nodes(spark, sf, "region", "nation", "customer", "supplier", "orders")
    return graph.impact_by_file(graph.impact(n, star.inherits(spark, sf), n.filter("node_type = 'module'"), max_depth=3), n)


CHAINS_SQL = """WITH RECURSIVE {graph}, one AS (SELECT DISTINCT {here} AS a, {there} AS b FROM calls),
types AS (SELECT DISTINCT event_type AS id FROM events),
walk(start, chain) AS (
  SELECT id, [id] FROM types
  UNION ALL SELECT w.start, list_append(w.chain, o.b) FROM walk w JOIN one o ON o.a = w.chain[-1] WHERE len(w.chain) < {depth} AND NOT list_contains(w.chain, o.b)
)
SELECT DISTINCT start, array_to_string(chain, '>') AS chain FROM walk w
WHERE len(chain) = {depth} OR NOT EXISTS (SELECT 1 FROM one o WHERE o.a = w.chain[-1]) OR EXISTS (SELECT 1 FROM one o WHERE o.a = w.chain[-1] AND list_contains(w.chain, o.b))"""


@query(CHAINS_SQL.format(graph=star.EVENT_GRAPH_SQL, here="source_id", there="target_id", depth=4))
def call_chains_down(spark: SparkSession, sf: str) -> DataFrame:
    n, e = star.event_graph(spark, sf)
    return graph.call_chains(n, e, n, "down", 4).select("start", F.array_join("chain", ">").alias("chain"))


@query(CHAINS_SQL.format(graph=star.EVENT_GRAPH_SQL, here="target_id", there="source_id", depth=5))
def call_chains_up(spark: SparkSession, sf: str) -> DataFrame:
    n, e = star.event_graph(spark, sf)
    return graph.call_chains(n, e, n, "up", 5).select("start", F.array_join("chain", ">").alias("chain"))


TREE_SQL = f"""WITH RECURSIVE {N}, {E}, c AS (SELECT DISTINCT source_id AS up, target_id AS down FROM edges WHERE edge_type = 'contains'),
own AS (SELECT id FROM nodes WHERE node_type <> 'type_def'),
tree(root, id, depth, path) AS (
  SELECT id, id, 0, [id] FROM own WHERE id NOT IN (SELECT down FROM c)
  UNION ALL SELECT t.root, c.down, t.depth + 1, list_append(t.path, c.down) FROM tree t JOIN c ON c.up = t.id JOIN own n ON n.id = c.down WHERE t.depth < 6 AND NOT list_contains(t.path, c.down)
)"""


@query(TREE_SQL + " SELECT root, id, depth::INT AS depth, array_to_string(path, '/') AS path FROM tree")
def containment_tree(spark: SparkSession, sf: str) -> DataFrame:
    n = star.nodes(spark, sf, "region", "nation", "customer", "supplier", "orders")
    return graph.containment_tree(n, star.contains(spark, sf)).select("root", "id", "depth", F.array_join("path", "/").alias("path"))


@query(TREE_SQL + ", shown AS (SELECT id FROM own WHERE id LIKE 'supplier:%'), keep AS (SELECT DISTINCT unnest(path) AS id FROM tree WHERE id IN (SELECT id FROM shown)) SELECT root, id, depth::INT AS depth FROM tree WHERE id IN (SELECT id FROM keep)")
def pruned_tree(spark: SparkSession, sf: str) -> DataFrame:
    n = star.nodes(spark, sf, "region", "nation", "customer", "supplier", "orders")
    tree = graph.containment_tree(n, star.contains(spark, sf))
    return graph.prune_tree(tree, n.filter("node_type = 'method'")).select("root", "id", "depth")


@query(f"""WITH {N}, {E}, s AS (SELECT id FROM nodes WHERE node_type = 'class'),
inc AS (SELECT source_id AS id, 'out' AS direction, target_id AS other, edge_type FROM edges UNION SELECT target_id, 'in', source_id, edge_type FROM edges)
SELECT i.id, i.edge_type, i.direction, CASE i.direction WHEN 'out' THEN 0 ELSE 1 END AS group_rank, i.other,
  row_number() OVER (PARTITION BY i.id, i.edge_type, i.direction ORDER BY i.other)::INT AS position
FROM inc i JOIN s USING (id) JOIN nodes n ON n.id = i.other""")
def relationship_groups(spark: SparkSession, sf: str) -> DataFrame:
    n = star.nodes(spark, sf)
    return graph.relationship_groups(n, star.edges(spark, sf), n.filter("node_type = 'class'"))


@query(f"""WITH {N}, {E}, own AS (SELECT id FROM nodes WHERE node_type <> 'type_def'), con AS (SELECT source_id, target_id FROM edges WHERE edge_type = 'contains'),
rel AS (SELECT DISTINCT id, d, other FROM (SELECT source_id AS id, 'out' AS d, target_id AS other FROM con UNION ALL SELECT target_id, 'in', source_id FROM con) WHERE other IN (SELECT id FROM own)),
placed AS (SELECT *, row_number() OVER (PARTITION BY id, d ORDER BY other) AS pos, count(*) OVER (PARTITION BY id, d) AS size FROM rel),
f0 AS (SELECT id AS root, [id] AS path, id FROM nodes WHERE node_type = 'module'),
h1 AS (SELECT root, list_append(f.path, p.other) AS path, p.other AS id, p.d AS direction, 1 AS hop, list_contains(f.path, p.other) AS back_reference, size > 4 AS has_more FROM f0 f JOIN placed p ON p.id = f.id WHERE pos <= 4),
f1 AS (SELECT DISTINCT root, path, id FROM h1 WHERE NOT back_reference),
h2 AS (SELECT root, list_append(f.path, p.other) AS path, p.other AS id, p.d AS direction, 2 AS hop, list_contains(f.path, p.other) AS back_reference, size > 4 AS has_more FROM f1 f JOIN placed p ON p.id = f.id WHERE pos <= 4),
f2 AS (SELECT DISTINCT root, path, id FROM h2 WHERE NOT back_reference),
h3 AS (SELECT root, list_append(f.path, p.other) AS path, p.other AS id, p.d AS direction, 3 AS hop, list_contains(f.path, p.other) AS back_reference, size > 4 AS has_more FROM f2 f JOIN placed p ON p.id = f.id WHERE pos <= 4),
f3 AS (SELECT DISTINCT root, path, id FROM h3 WHERE NOT back_reference)
SELECT root, array_to_string(path, '/') AS path, id, 'contains' AS edge_type, direction, hop, back_reference, has_more FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)""")
def relationship_tree(spark: SparkSession, sf: str) -> DataFrame:
    n = star.nodes(spark, sf, "region", "nation", "customer", "supplier", "orders")
    tree = graph.relationship_tree(n, star.contains(spark, sf), n.filter("node_type = 'module'"), max_hops=3, per_group=4)
    return tree.withColumn("path", F.array_join("path", "/"))


@query(f"""WITH {N}, {E}, up AS (SELECT target_id, max(source_id) AS parent FROM edges WHERE edge_type = 'contains' GROUP BY 1)
SELECT n.id, parent, 0.05::DOUBLE AS value FROM nodes n LEFT JOIN up ON up.target_id = n.id""")
def treemap_parents(spark: SparkSession, sf: str) -> DataFrame:
    return graph.last_parents(star.nodes(spark, sf), star.edges(spark, sf))


@query(f"""WITH {N}, {E}, inc AS (SELECT source_id AS id, 'out' AS d, weight FROM edges UNION ALL SELECT target_id, 'in', weight FROM edges)
SELECT id, count(*) FILTER (d = 'in')::INT AS n_in, count(*) FILTER (d = 'out')::INT AS n_out, round(max(weight), 6) AS heaviest FROM inc GROUP BY 1""")
def adjacency_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = graph.adjacency(star.edges(spark, sf))
    top = F.array_max(F.transform(F.concat("incoming", "outgoing"), lambda x: x["weight"]))
    return lists.select("id", F.size("incoming").alias("n_in"), F.size("outgoing").alias("n_out"), F.round(top, 6).alias("heaviest"))


PAGE_NAMES = """
hrefs AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS target FROM pages),
pnodes AS (SELECT 'page:' || page_id AS id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_extract(html, 'href="/([^"]+)"', 1) AS name FROM pages)"""


def page_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = star.table(spark, sf, "pages")
    host = F.regexp_extract("url", "://([^/]+)", 1)
    named = p.select(star.key("page", "page_id").alias("id"), host.alias("file_path"), F.regexp_extract("html", 'href="/([^"]+)"', 1).alias("name"))
    links = p.select(star.key("page", "page_id").alias("source_id"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("target_name"), F.lit("imports").alias("edge_type"), F.lit("").alias("context"), host.alias("file_path"), F.lit(1.0).alias("weight"))
    return named, links


@query(f"""WITH {PAGE_NAMES}, keys AS (SELECT id, host, unnest(list_distinct([name, string_split(name, '.')[-1]])) AS k FROM pnodes),
u AS (SELECT DISTINCT 'page:' || page_id AS source_id, host, target FROM hrefs),
wanted AS (SELECT source_id, host, target, unnest(list_distinct([target, string_split(target, '.')[-1]])) AS k FROM u),
pick AS (SELECT w.source_id, w.target, keys.id, row_number() OVER (PARTITION BY w.source_id, w.target ORDER BY (keys.host = w.host) DESC, keys.id) AS n FROM wanted w JOIN keys USING (k) WHERE k <> '')
SELECT DISTINCT source_id, id AS target_id FROM pick WHERE n = 1""")
def edge_resolution(spark: SparkSession, sf: str) -> DataFrame:
    named, links = page_graph(spark, sf)
    return graph.resolve_edges(links, named).select("source_id", "target_id")


@query(f"""WITH {PAGE_NAMES} SELECT DISTINCT string_split(target, '.')[1] AS package FROM hrefs WHERE string_split(target, '.')[1] <> '' AND NOT starts_with(string_split(target, '.')[1], '_')
AND string_split(target, '.')[1] NOT IN (SELECT string_split(name, '.')[1] FROM pnodes)""")
def external_packages(spark: SparkSession, sf: str) -> DataFrame:
    named, links = page_graph(spark, sf)
    return graph.external_packages(links, named)


@query(f"""WITH {N}, code AS (SELECT *, regexp_replace(file_path, '/[^/]*$', '') AS dir FROM nodes),
best AS (SELECT dir, name, id, row_number() OVER (PARTITION BY dir ORDER BY id) AS k FROM code WHERE node_type IN ('class', 'function')),
keyed AS (SELECT dir, string_agg(name, ', ' ORDER BY id) AS key FROM best WHERE k <= 4 GROUP BY 1)
SELECT c.dir, count(DISTINCT file_path)::BIGINT AS files, count(*) FILTER (node_type = 'class')::BIGINT AS classes, count(*) FILTER (node_type = 'function')::BIGINT AS functions, coalesce(any_value(keyed.key), '') AS key
FROM code c LEFT JOIN keyed USING (dir) GROUP BY c.dir""")
def directory_overview(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.directory_overview(star.nodes(spark, sf))


@query(f"""WITH {N}, c AS (SELECT node_type, count(*) AS n FROM nodes GROUP BY 1),
s AS (SELECT 'Project: ' || (SELECT count(DISTINCT file_path) FROM nodes) || ' files, ' || (SELECT count(*) FROM nodes) || ' nodes. Top modules: ' || (SELECT string_agg(name, ', ' ORDER BY id) FROM (SELECT id, name FROM nodes WHERE node_type = 'module' ORDER BY id LIMIT 6)) || '.' AS short)
SELECT substr(sha256('__project__::project_overview::root'), 1, 12) AS id, 'project overview' AS name, substr(short, 1, 200) AS summary_short, substr(short || chr(10) || (SELECT string_agg(node_type || ': ' || n, chr(10) ORDER BY node_type) FROM c) || chr(10) || 'Key entities: ' ||
(SELECT string_agg(name, ', ' ORDER BY id) FROM (SELECT id, name FROM nodes WHERE node_type IN ('class', 'function') ORDER BY id LIMIT 5)), 1, 1000) AS summary_detailed FROM s""")
def project_overview(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.project_overview(star.nodes(spark, sf)).select("id", "name", "summary_short", "summary_detailed")


@query(f"WITH {N}, {E}, shown AS (SELECT id FROM nodes WHERE node_type IN ('module', 'class', 'method')) SELECT source_id, target_id, edge_type FROM edges WHERE source_id IN (SELECT id FROM shown) AND target_id IN (SELECT id FROM shown)")
def visible_edges(spark: SparkSession, sf: str) -> DataFrame:
    shown = filters.visible(star.nodes(spark, sf).withColumn("summary_short", F.lit("")), types=["module", "class", "method"])
    return filters.visible_edges(star.edges(spark, sf), shown).select("source_id", "target_id", "edge_type")


@query(f"WITH {N}, {E} SELECT id, name FROM nodes WHERE node_type = 'method' AND contains(lower(file_path), 'nation1') AND id IN (SELECT source_id FROM edges WHERE edge_type = 'queries' UNION SELECT target_id FROM edges WHERE edge_type = 'queries')")
def filter_language(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = filters.parse_query("type:method file:nation1 edge:queries supplier")
    return filters.apply_filters(star.nodes(spark, sf), found, star.edges(spark, sf)).select("id", "name")


@query(f"""WITH {N}, {E}, sims AS (SELECT id, ((regexp_extract(id, ':(\\d+)', 1)::BIGINT * 7) % 10)::DOUBLE / 10 AS s FROM nodes WHERE node_type IN ('module', 'class', 'function', 'method')),
seeds AS (SELECT id, s FROM sims WHERE id LIKE 'nation:%' AND s > 0),
step AS (SELECT a, b, max(w) AS w FROM (SELECT source_id AS a, target_id AS b, weight AS w FROM edges WHERE edge_type = 'contains' UNION ALL SELECT target_id, source_id, weight FROM edges WHERE edge_type = 'contains') WHERE b IN (SELECT id FROM sims WHERE s >= 0.1) GROUP BY 1, 2),
one AS (SELECT b AS id, max(s * 0.5::DOUBLE * w) AS v FROM seeds JOIN step ON a = seeds.id GROUP BY 1),
two AS (SELECT b AS id, max(v * 0.25::DOUBLE * w) AS v FROM one JOIN step ON a = one.id GROUP BY 1)
SELECT id, round(max(v), 9) AS branch FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY 1""")
def branch_expand(spark: SparkSession, sf: str) -> DataFrame:
    n = star.nodes(spark, sf, "region", "nation", "customer", "supplier")
    number = F.regexp_extract("id", r":(\d+)", 1).cast("long")
    sims = n.select("id", ((number * 7) % 10 / 10).alias("similarity"))
    found = vectors.branch_scores(sims.filter("id LIKE 'nation:%'"), star.contains(spark, sf), sims)
    return found.select("id", F.round("branch", 9).alias("branch"))


@query(f"""WITH {N}, {E}, {DEGREES}, {IMPORTANCE} SELECT d.node_type, count(*)::BIGINT AS n, round(sum(ln(1 + d.in_degree)), 4) AS log_in, round(sum(ln(1 + d.out_degree)), 4) AS log_out FROM deg d GROUP BY 1""")
def structural_features(spark: SparkSession, sf: str) -> DataFrame:
    n = star.nodes(spark, sf).withColumn("complexity", F.lit(1))
    f = vectors.structural(n, star.edges(spark, sf)).join(n.select("id", "node_type"), "id")
    return f.groupBy("node_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("features")[23]), 4).alias("log_in"), F.round(F.sum(F.col("features")[24]), 4).alias("log_out"))


@query(f"""WITH {N}, refs(ref) AS (VALUES ('people/nation1/suppliers.py'), ('nation2/suppliers.py'), ('suppliers.py'), ('/x/people/nation3/suppliers.py'), ('none.py'), ('')),
s AS (SELECT id, file_path AS p FROM nodes WHERE node_type = 'method'),
t AS (SELECT ref, regexp_replace(trim(ref), '^[/\\\\]+', '') AS t FROM refs),
scored AS (SELECT ref, id, CASE WHEN p = t THEN 3 WHEN ends_with(p, t) OR ends_with(t, p) THEN 2 WHEN string_split(p, '/')[-1] = string_split(t, '/')[-1] THEN 1 END AS score FROM t, s WHERE t <> ''),
best AS (SELECT *, rank() OVER (PARTITION BY ref ORDER BY score DESC) AS r, row_number() OVER (PARTITION BY ref ORDER BY score DESC, id) AS n FROM scored WHERE score IS NOT NULL)
SELECT ref, id, score::INT AS score FROM best WHERE r = 1 AND n <= 3""")
def path_specificity(spark: SparkSession, sf: str) -> DataFrame:
    refs = spark.createDataFrame([(r,) for r in ("people/nation1/suppliers.py", "nation2/suppliers.py", "suppliers.py", "/x/people/nation3/suppliers.py", "none.py", "")], "ref string")
    return filters.match_files(star.nodes(spark, sf, "supplier"), refs)
