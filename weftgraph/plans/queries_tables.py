"""Queries for items, tables that change, sessions, events and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine, vector_dot
from ..operators import filters, lifecycle, rollup, store, vectors
from ..streaming import ingest
from . import starschema as star

N, E, T = star.NODES_SQL, star.EDGES_SQL, star.TASKS_SQL
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- items ---------------------------------------------------------------------------------


@query(f"WITH {T} SELECT id, importance FROM tasks WHERE NOT archived")
def active_items(spark: SparkSession, sf: str) -> DataFrame:
    return filters.active_items(star.tasks(spark, sf), "tasks").select("id", "importance")


@query(f"WITH {T} SELECT id, name FROM tasks WHERE NOT archived AND task_status = 'pending' AND priority = 'high'")
def task_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.tasks(star.tasks(spark, sf), "pending", "high").select("id", "name")


@query(f"WITH {T} SELECT task_status AS status, CASE task_status WHEN 'in_progress' THEN 0 WHEN 'pending' THEN 2 ELSE 3 END AS position, count(*)::BIGINT AS tasks FROM tasks WHERE NOT archived GROUP BY 1, 2")
def task_board(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.task_board(star.tasks(spark, sf))


@query(f"WITH {T} SELECT id, archived OR task_status = 'done' AS archived, CASE WHEN NOT archived AND task_status = 'done' THEN round(importance * 0.3::DOUBLE, 3) ELSE importance END AS importance FROM tasks")
def archive_completed(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.archive_completed(star.tasks(spark, sf)).select("id", "archived", "importance")


@query(f"WITH {T} SELECT id, true AS archived, CASE WHEN archived THEN importance ELSE round(importance * 0.3::DOUBLE, 3) END AS importance FROM tasks WHERE task_status = 'in_progress'")
def archive_items(spark: SparkSession, sf: str) -> DataFrame:
    t = star.tasks(spark, sf)
    some = t.filter("task_status = 'in_progress'").select("id")
    return lifecycle.archive(t, some).join(some, "id", "left_semi").select("id", "archived", "importance")


@query("SELECT trim(lang) AS topic, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def insight_topics(spark: SparkSession, sf: str) -> DataFrame:
    d = star.table(spark, sf, "documents")
    notes = d.select(F.concat(F.lit("insight/"), "lang", F.lit(": "), F.col("doc_id").cast("string")).alias("name"), F.lit("insight").alias("node_type"), F.lit(False).alias("archived"))
    return rollup.insight_topics(notes)


@query(f"""WITH {N}, {E}, rel AS (SELECT source_id AS id, target_id AS ref, row_number() OVER (PARTITION BY source_id ORDER BY target_id) AS position FROM edges WHERE edge_type = 'uses')
SELECT id, ref, position::INT AS position FROM rel WHERE position <= 3 AND ref IN (SELECT id FROM nodes)""")
def code_refs(spark: SparkSession, sf: str) -> DataFrame:
    items = star.nodes(spark, sf, "orders")
    links = star.edges(spark, sf).filter("edge_type = 'uses'").withColumn("edge_type", F.lit("relates_to"))
    return rollup.code_refs(items, star.nodes(spark, sf, "part"), links)


@query("""WITH used AS (SELECT lang, doc_id, sum(length(source || lang) + 1) OVER (PARTITION BY lang ORDER BY doc_id) AS used FROM documents)
SELECT lang, doc_id, used::BIGINT AS used FROM used WHERE used <= 400""")
def char_budget(spark: SparkSession, sf: str) -> DataFrame:
    d = star.table(spark, sf, "documents").withColumn("line", F.concat("source", "lang"))
    return rollup.char_budget(d, ["lang"], [F.col("doc_id")], "line", 400).select("lang", "doc_id", "used")


# -- tables that change --------------------------------------------------------------------


def _file_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = star.table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), F.substring(F.sha2("text", 256), 1, 16).alias("content_hash"), "doc_id")
    now = d.filter("doc_id % 10 <> 1").select("file_path", "content_hash")
    was = d.filter("doc_id % 10 <> 0").select("file_path", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("doc_id") % 3 == 0, F.lit("2024-01-01 00:00:00")).otherwise("2023-01-01 00:00:00").cast("timestamp").alias("last_verified"))
    return now, was


FILE_SQL = """
d AS (SELECT 'doc/' || doc_id AS file_path, substr(sha256(text), 1, 16) AS h, doc_id FROM documents),
now_ AS (SELECT file_path, h FROM d WHERE doc_id % 10 <> 1),
was AS (SELECT file_path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE h END AS h, doc_id % 3 = 0 AS recent FROM d WHERE doc_id % 10 <> 0)"""


@query(f"WITH {FILE_SQL} SELECT file_path, CASE WHEN w.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'removed' WHEN n.h <> w.h THEN 'changed' ELSE 'same' END AS change FROM now_ n FULL JOIN was w USING (file_path)")
def file_diff(spark: SparkSession, sf: str) -> DataFrame:
    now, was = _file_tables(spark, sf)
    return store.file_diff(now, was)


@query(f"WITH {FILE_SQL} SELECT file_path, CASE WHEN w.h IS NULL THEN 'new' WHEN w.recent THEN 'fresh' WHEN n.h IS NULL THEN 'deleted' WHEN n.h = w.h THEN 'fresh' ELSE 'stale' END AS status FROM now_ n FULL JOIN was w USING (file_path)")
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    now, was = _file_tables(spark, sf)
    return store.freshness(was, now, F.lit("2024-01-01 00:04:00").cast("timestamp"))


@query("""WITH last AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT c_custkey AS custkey, coalesce(o_totalprice, c_acctbal) AS value FROM customer LEFT JOIN last ON o_custkey = c_custkey AND n = 1
UNION ALL SELECT o_custkey, o_totalprice FROM last WHERE n = 1 AND o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def upsert_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    now = star.table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("value"))
    o = star.table(spark, sf, "orders")
    changes = o.select(F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("value"), F.struct("o_orderdate", "o_orderkey").alias("__version"))
    return store.upsert(now, changes, ["custkey"])


@query(f"WITH {N}, {E}, kept AS (SELECT id FROM nodes WHERE file_path <> 'people/nation3/customers.py') SELECT edge_type, count(*)::BIGINT AS n FROM edges WHERE source_id IN (SELECT id FROM kept) AND target_id IN (SELECT id FROM kept) GROUP BY 1")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    paths = spark.createDataFrame([("people/nation3/customers.py",)], "file_path string")
    _, e, _ = store.delete_files(star.nodes(spark, sf), star.edges(spark, sf), paths)
    return e.groupBy("edge_type").agg(F.count("*").alias("n"))


@query(f"WITH {N}, {E}, kept AS (SELECT id FROM nodes WHERE id NOT IN (SELECT 'part:' || p_partkey FROM part WHERE p_size > 40)) SELECT source_id, target_id, edge_type FROM edges WHERE NOT (source_id IN (SELECT id FROM kept) AND target_id IN (SELECT id FROM kept))")
def dangling_edges(spark: SparkSession, sf: str) -> DataFrame:
    big = star.table(spark, sf, "part").filter("p_size > 40").select(star.key("part", "p_partkey").alias("id"))
    _, bad = store.valid_edges(star.edges(spark, sf), star.nodes(spark, sf).join(big, "id", "left_anti"))
    return bad.select("source_id", "target_id", "edge_type")


@query(f"WITH {E} SELECT edge_type, count(*)::BIGINT AS n FROM edges WHERE source_id NOT LIKE 'supplier:%' AND target_id NOT LIKE 'supplier:%' GROUP BY 1")
def delete_edges(spark: SparkSession, sf: str) -> DataFrame:
    gone = star.nodes(spark, sf, "supplier").select("id")
    return store.delete_edges_of(star.edges(spark, sf), gone).groupBy("edge_type").agg(F.count("*").alias("n"))


# -- sessions, events, JSON ----------------------------------------------------------------


@query("SELECT conv_id, count(*)::BIGINT AS turns, count(DISTINCT role)::BIGINT AS roles FROM conversations GROUP BY 1 ORDER BY turns DESC, conv_id LIMIT 20")
def recent_sessions(spark: SparkSession, sf: str) -> DataFrame:
    c = star.table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_distinct("role").alias("roles")).orderBy(F.desc("turns"), "conv_id").limit(20)


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM conversations) WHERE n <= 2")
def top_per_group(spark: SparkSession, sf: str) -> DataFrame:
    c = star.table(spark, sf, "conversations")
    return filters.top_per_group(c, ["conv_id"], [F.desc("turn"), F.col("role"), F.col("text")], 2).select("conv_id", "turn", "role")


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, count(*)::BIGINT AS n FROM events GROUP BY 1")
def json_paths(spark: SparkSession, sf: str) -> DataFrame:
    e = star.table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count("*").alias("n"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    got = ingest.windowed_counts(star.table(spark, sf, "events"), "ts", ["event_type"], "value")
    return got.withColumn("total", F.round("total", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*)::BIGINT AS n, epoch_us(max(ts))::BIGINT - epoch_us(min(ts))::BIGINT + 1800000000 AS micros FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    got = ingest.sessions(star.table(spark, sf, "events"), "ts", "user_id")
    return got.select("user_id", "n", (F.unix_micros(F.col("session_end").cast("timestamp")) - F.unix_micros(F.col("session_start").cast("timestamp"))).alias("micros"))


# -- vectors -------------------------------------------------------------------------------

QUERY_VECTOR = "q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 1)"
SIMS = f"{QUERY_VECTOR}, sims AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], q.e) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(q.e, q.e)) AS s FROM embeddings, q)"


def _first_vector(e: DataFrame) -> list[float]:
    row = e.orderBy("vec_id").select("embedding").first()
    return [float(x) for x in row["embedding"]] if row else []


@query(f"WITH {SIMS} SELECT vec_id, round(s, 6) AS similarity FROM sims ORDER BY s DESC, vec_id LIMIT 20")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = star.table(spark, sf, "embeddings")
    return vectors.top_similar(e, _first_vector(e), 20, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {SIMS} SELECT label, count(*)::BIGINT AS n, count(*) FILTER (s >= 0.1)::BIGINT AS close, round(max(s), 6) AS best FROM sims GROUP BY 1")
def similarity_scan(spark: SparkSession, sf: str) -> DataFrame:
    e = star.table(spark, sf, "embeddings")
    got = vectors.similarity(e, _first_vector(e))
    return got.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("similarity") >= 0.1).cast("long")).alias("close"), F.round(F.max("similarity"), 6).alias("best"))


@query("""WITH p AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbour) AS rank FROM p) SELECT id, neighbour, rank::INT AS rank FROM r WHERE rank <= 4""")
def nearest_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.neighbours(star.table(spark, sf, "embeddings"), 4, "vec_id", "embedding", "label")


@query(f"""WITH {SIMS}, n AS (SELECT 'v:' || vec_id AS id, 'label' || label AS name, (vec_id % 10)::DOUBLE / 10 AS importance, s FROM sims JOIN embeddings USING (vec_id, label)),
seeds AS (SELECT id, s FROM n WHERE s > 0 ORDER BY s DESC, id LIMIT 10),
e AS (SELECT 'v:' || vec_id AS a, 'v:' || (vec_id + 1) AS b FROM embeddings), step AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
alive AS (SELECT a, b FROM step WHERE b IN (SELECT id FROM n WHERE s >= 0.1)),
one AS (SELECT b AS id, max(s * 0.5::DOUBLE) AS v FROM seeds JOIN alive ON a = seeds.id GROUP BY 1),
two AS (SELECT b AS id, max(v * 0.25::DOUBLE) AS v FROM one JOIN alive ON a = one.id GROUP BY 1),
br AS (SELECT id, max(v) AS v FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY 1),
c AS (SELECT id FROM seeds UNION SELECT id FROM br),
f AS (SELECT n.id, 0.5::DOUBLE * n.s + 0.3::DOUBLE * n.importance + 0.2::DOUBLE * coalesce(br.v, 0.0) + CASE WHEN contains(n.name, 'label3') THEN 0.15::DOUBLE ELSE 0.0 END AS score,
  CASE WHEN contains(n.name, 'label3') THEN 'name_match' WHEN n.id IN (SELECT id FROM seeds) THEN 'semantic' ELSE 'branch' END AS match_type FROM c JOIN n USING (id) LEFT JOIN br ON br.id = c.id)
SELECT id, round(score, 6) AS score, match_type FROM f ORDER BY f.score DESC, id LIMIT 15""")
def semantic_rank(spark: SparkSession, sf: str) -> DataFrame:
    n, e = star.vector_nodes(spark, sf)
    sims = vectors.similarity(n, _first_vector(star.table(spark, sf, "embeddings"))).select("id", "similarity")
    return vectors.semantic_search(n, e, sims, "label3", limit=15).select("id", F.round("score", 6).alias("score"), "match_type")


@query("""SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine,
round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = star.table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"), F.round(vector_dot(F.col("embedding"), F.col("other")), 6).alias("dot"))


@query("WITH r AS (SELECT s_suppkey, s_acctbal, min(s_acctbal) OVER () AS lo, max(s_acctbal) OVER () AS hi FROM supplier) SELECT s_suppkey, round(2 * (s_acctbal - lo) / (hi - lo) - 1, 6) AS scaled FROM r")
def min_max_rescale(spark: SparkSession, sf: str) -> DataFrame:
    s = star.table(spark, sf, "supplier")
    lo, hi = s.agg(F.min("s_acctbal"), F.max("s_acctbal")).first()  # two numbers
    return s.select("s_suppkey", F.round(2 * (F.col("s_acctbal") - lo) / (hi - lo) - 1, 6).alias("scaled"))


@query()
def pca_layout(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.pca(star.table(spark, sf, "embeddings"), 2, "vec_id").select("id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))


@query("WITH r AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier) SELECT id, round(cos(2 * pi() * i / n), 4) + 0.0 AS x, round(sin(2 * pi() * i / n), 4) + 0.0 AS y FROM r")
def circle_layout(spark: SparkSession, sf: str) -> DataFrame:
    ids = star.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return vectors.circle(ids).select("id", (F.col("coords")[0] + 0.0).alias("x"), (F.col("coords")[1] + 0.0).alias("y"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, grouping(o_orderstatus)::INT AS g, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    o = star.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    return o.rollup("status", "priority").agg(F.grouping("status").cast("int").alias("g"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_id, user_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def last_state(spark: SparkSession, sf: str) -> DataFrame:
    """The value of each user's previous event, as of every event."""
    e = star.table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", "user_id", F.lag("value").over(w).alias("previous"))

