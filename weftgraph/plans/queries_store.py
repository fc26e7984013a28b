"""Queries for the store, work items, code references and summaries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import filters, graph, lifecycle, schema, store, text
from ..sources import database, files
from . import starschema as star, tools
from .queries_text import POSTINGS, _docs, _sql_redaction
from .shared import spread

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


# -- upserts, deletes, updates -------------------------------------------------------------


@query(f"""WITH {E} SELECT source_id, target_id, edge_type, CASE WHEN edge_type = 'contains' THEN 2.0 ELSE round(weight, 6) END AS weight FROM edges
UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'relates_to', 0.5 FROM nation""")
def upsert_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = star.edges(spark, sf).withColumn("weight", F.round("weight", 6))
    new = star.table(spark, sf, "nation").select(star.key("nation", "n_nationkey").alias("source_id"), star.key("region", "n_regionkey").alias("target_id"), F.lit("relates_to").alias("edge_type"), F.lit(0.5).alias("weight"))
    changes = e.filter("edge_type = 'contains'").withColumn("weight", F.lit(2.0)).unionByName(new)
    return store.upsert(e, changes, store.KEYS["edges"]).select("source_id", "target_id", "edge_type", "weight")


@query("""SELECT 'doc/' || doc_id AS file_path, CASE WHEN doc_id % 3 = 0 THEN substr(sha256(text), 1, 16) ELSE 'old' END AS content_hash FROM documents
UNION ALL SELECT 'page/' || page_id, substr(sha256(html), 1, 16) FROM pages""")
def upsert_file_state(spark: SparkSession, sf: str) -> DataFrame:
    d, p = star.table(spark, sf, "documents"), star.table(spark, sf, "pages")
    path = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c).cast("string")).alias("file_path")
    held = d.select(path("doc", "doc_id"), F.lit("old").alias("content_hash"))
    changes = d.filter("doc_id % 3 = 0").select(path("doc", "doc_id"), scalars.fingerprint(F.col("text")).alias("content_hash")).union(p.select(path("page", "page_id"), scalars.fingerprint(F.col("html"))))
    return store.upsert(held, changes, store.KEYS["file_state"]).select("file_path", "content_hash")


@query("""SELECT user_id::VARCHAR AS session_id, min(ts) AS started_at, CASE WHEN user_id % 2 = 0 THEN max(ts) END AS ended_at FROM events GROUP BY user_id
UNION ALL SELECT 'new' || n_nationkey, TIMESTAMP '2024-01-01 00:00:00', NULL FROM nation""")
def upsert_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = star.table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    key, none = F.col("user_id").cast("string").alias("session_id"), F.lit(None).cast(s.schema["last"].dataType).alias("ended_at")
    held = s.select(key, F.col("first").alias("started_at"), none)
    new = star.table(spark, sf, "nation").select(F.concat(F.lit("new"), F.col("n_nationkey").cast("string")).alias("session_id"), F.lit("2024-01-01 00:00:00").cast(s.schema["last"].dataType).alias("started_at"), none)
    changes = s.filter("user_id % 2 = 0").select(key, F.col("last").alias("started_at"), F.col("last").alias("ended_at")).unionByName(new)
    return store.upsert_sessions(held, changes).select("session_id", "started_at", "ended_at")


@query("SELECT vec_id AS node_id, label FROM embeddings WHERE label <> 3")
def delete_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    e = star.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "node_id")
    return store.delete_keys(e, e.filter("label = 3").select("node_id"), store.KEYS["embeddings"]).select("node_id", "label")


@query(f"WITH {T} SELECT id, CASE WHEN id = 'orders:7' THEN 'medium' ELSE priority END AS priority FROM tasks")
def update_one_field(spark: SparkSession, sf: str) -> DataFrame:
    return store.update_field(star.tasks(spark, sf), "orders:7", "priority", "medium").select("id", "priority")


# -- lookups and filters -------------------------------------------------------------------


@query(f"WITH {N} SELECT id, name, node_type, file_path FROM nodes WHERE id = 'customer:7'")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return filters.by_id(star.nodes(spark, sf), "customer:7").select("id", "name", "node_type", "file_path")


@query(f"""WITH {E} SELECT 'out' AS direction, target_id AS other, edge_type, round(weight, 6) AS weight FROM edges WHERE source_id = 'supplier:3'
UNION ALL SELECT 'in', source_id, edge_type, round(weight, 6) FROM edges WHERE target_id = 'supplier:3'""")
def edges_of_node(spark: SparkSession, sf: str) -> DataFrame:
    e = star.edges(spark, sf).withColumn("weight", F.round("weight", 6))
    out = filters.edges_from(e, "supplier:3").select(F.lit("out").alias("direction"), F.col("target_id").alias("other"), "edge_type", "weight")
    return out.union(filters.edges_to(e, "supplier:3").select(F.lit("in"), "source_id", "edge_type", "weight"))


@query(f"WITH {T} SELECT id FROM tasks WHERE importance >= 0.5 AND task_status = 'pending' AND contains(lower(name), 'task: 1')")
def visible_items(spark: SparkSession, sf: str) -> DataFrame:
    return filters.visible(star.tasks(spark, sf), category="tasks", types=["task", "subtask"], least=0.5, status="pending", text="Task: 1").select("id")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id % 10 <> 0")
def insight_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = star.table(spark, sf, "documents")
    notes = d.select("doc_id", F.concat(F.lit("insight/"), "lang", F.lit(": "), F.col("doc_id").cast("string")).alias("name"), F.lit("insight").alias("node_type"), (F.col("doc_id") % 10 == 0).alias("archived"), F.lit(0.5).alias("importance"), F.col("doc_id").alias("id"))
    return filters.insights(notes, " EN ").select("doc_id")


RESOLVED = "(SELECT id FROM tasks WHERE contains(lower(name), 'task: 77') ORDER BY importance DESC, id LIMIT 1)"


@query(f"WITH {T} SELECT id, name FROM tasks WHERE id = {RESOLVED}")
def resolve_task(spark: SparkSession, sf: str) -> DataFrame:
    return filters.resolve_item(star.tasks(spark, sf), "TASK: 77").select("id", "name")


@query(f"WITH {T} SELECT id, CASE WHEN id = {RESOLVED} THEN 'done' ELSE task_status END AS task_status, CASE WHEN id = {RESOLVED} THEN 'low' ELSE priority END AS priority FROM tasks")
def update_task(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.update_task(star.tasks(spark, sf), "task: 77", status="done", priority="low").select("id", "task_status", "priority")


NAMES = "CASE p_partkey % 5 WHEN 0 THEN '_x' || p_partkey WHEN 1 THEN 'MAX_' || p_partkey WHEN 2 THEN 'Part' || p_partkey WHEN 3 THEN 'part' || p_partkey ELSE 'Part_' || p_partkey END"


@query(f"""WITH n AS (SELECT p_partkey, {NAMES} AS name, p_partkey % 2 = 0 AS go FROM part)
SELECT p_partkey, CASE WHEN go THEN regexp_matches(name, '^[A-Z]') ELSE NOT starts_with(name, '_') END AS public, regexp_matches(name, '^[A-Z][A-Z0-9_]*$') OR regexp_matches(name, '^[A-Z][A-Za-z0-9]*$') AS constant FROM n""")
def name_predicates(spark: SparkSession, sf: str) -> DataFrame:
    n = star.table(spark, sf, "part").select("p_partkey", F.expr(NAMES).alias("name"), F.when(F.col("p_partkey") % 2 == 0, "go").otherwise("python").alias("language"))
    return n.select("p_partkey", scalars.is_public(F.col("name"), F.col("language")).alias("public"), scalars.is_constant_name(F.col("name")).alias("constant"))


@query("SELECT 'part:' || p_partkey AS id FROM part WHERE p_partkey % 10 >= 3 AND p_size % 2 = 0")
def worth_enriching(spark: SparkSession, sf: str) -> DataFrame:
    p = star.table(spark, sf, "part").select(star.key("part", "p_partkey").alias("id"), ((F.col("p_partkey") % 10) / 10).alias("importance"), F.lit("codebase").alias("category"), F.when(F.col("p_size") % 2 == 0, "parts.py").otherwise("__dir__").alias("file_path"))
    return tools.worth_enriching(p).select("id")


# -- items ---------------------------------------------------------------------------------

BRAND = "SELECT id FROM nodes WHERE file_path = 'parts/Brand#13.py' ORDER BY id LIMIT"


@query(f"WITH {N} SELECT substr(sha256('bug::manual::2024-01-02::It hangs'), 1, 12) AS source_id, id AS target_id, 'relates_to' AS edge_type, 0.8::DOUBLE AS weight FROM ({BRAND} 3)")
def bug_links(spark: SparkSession, sf: str) -> DataFrame:
    _, links = lifecycle.add_bug(star.nodes(spark, sf), "It hangs", ["/parts/Brand#13.py"], day=date(2024, 1, 2))
    return links.select("source_id", "target_id", "edge_type", "weight")


TASK_ID, PHASE_ID = "substr(sha256('task::manual::Tidy up'), 1, 12)", "substr(sha256('phase::manual::One'), 1, 12)"


@query(f"""WITH {N}, s AS (SELECT min(id) AS id FROM nodes WHERE file_path LIKE '%nation5/customers.py' GROUP BY id ORDER BY id LIMIT 2)
SELECT {TASK_ID} AS source_id, id AS target_id, 'relates_to' AS edge_type, 0.7::DOUBLE AS weight FROM ({BRAND} 2) UNION ALL SELECT {TASK_ID}, id, 'relates_to', 0.7 FROM s
UNION ALL SELECT {PHASE_ID}, {TASK_ID}, 'phase_contains', 1.0""")
def task_links(spark: SparkSession, sf: str) -> DataFrame:
    _, links = lifecycle.add_task(star.nodes(spark, sf), "Tidy up", "One", ["parts/Brand#13.py", "nation5/customers.py", "nothing/like/it.zzz"])
    return links.select("source_id", "target_id", "edge_type", "weight")


@query("SELECT substr(sha256('insight::perf::caches are warm'), 1, 12) AS id, 'insight/perf: Caches ARE warm' AS name, 'insights' AS category, 0.5::DOUBLE AS importance")
def new_insight(spark: SparkSession, sf: str) -> DataFrame:
    made, _ = lifecycle.add_insight(star.nodes(spark, sf), "Caches ARE warm", " Perf ")
    return made.select("id", "name", "category", "importance")


# -- search --------------------------------------------------------------------------------


@query(f"""WITH {POSTINGS}, len_ AS (SELECT doc_id, sum(tf)::DOUBLE AS l FROM post GROUP BY 1), agg AS (SELECT count(*)::DOUBLE AS n, avg(l) AS m FROM len_),
hits AS (SELECT doc_id, sum(tf)::DOUBLE AS tf FROM post WHERE starts_with(term, 'the') GROUP BY 1), df AS (SELECT count(*)::DOUBLE AS df FROM hits),
scored AS (SELECT doc_id, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m)) AS s FROM hits JOIN len_ USING (doc_id), agg, df)
SELECT doc_id AS id, round(s, 6) AS score FROM scored JOIN documents USING (doc_id) ORDER BY s DESC, doc_id % 7 DESC, doc_id LIMIT 10""")
def ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select(F.col("doc_id").alias("id"), F.lit("").alias("name"), F.lit("").alias("summary_short"), F.col("text").alias("docstring"), F.lit("").alias("file_path"), ((F.col("doc_id") % 7) / 7).alias("importance"))
    return text.search(d, text.postings(d), "The").select("id", F.round("score", 6).alias("score"))


@query(f"WITH {POSTINGS} SELECT term, count(*)::BIGINT AS docs, sum(tf)::BIGINT AS occurrences FROM post GROUP BY 1")
def refreshed_postings(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    old = d.withColumn("text", F.when(F.col("doc_id") % 5 == 0, "something old").otherwise(F.col("text")))
    now = text.refresh_postings(text.postings(old, "doc_id", ("text",)), d.filter("doc_id % 5 = 0"), "doc_id", ("text",))
    return now.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


@query(f"WITH {POSTINGS} SELECT doc_id AS node_id, count(*)::BIGINT AS terms, sum(tf)::BIGINT AS length FROM post GROUP BY 1")
def kept_postings(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    old = d.withColumn("text", F.when(F.col("doc_id") % 5 == 0, "something old").otherwise(F.col("text"))).filter("doc_id % 11 <> 0")
    now = text.current_postings(text.indexed(old, "doc_id", ("text",)), d, "doc_id", ("text",))
    return now.groupBy("node_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("length"))


@query("SELECT p_partkey, concat_ws(' ', nullif(p_name, ''), CASE WHEN p_size % 2 = 0 THEN p_brand END, CASE WHEN p_size % 3 = 0 THEN p_type END) AS text FROM part")
def composed_texts(spark: SparkSession, sf: str) -> DataFrame:
    some = lambda c, k: F.when(F.col("p_size") % k == 0, F.col(c)).otherwise("")
    return star.table(spark, sf, "part").select("p_partkey", scalars.compose_text(F.col("p_name"), some("p_brand", 2), some("p_type", 3)).alias("text"))


# -- redaction and summaries ---------------------------------------------------------------


@query(f"SELECT doc_id AS id, md5({_sql_redaction()[0]}) AS code, {_sql_redaction()[1]} > 0 AS has_redacted_content FROM documents")
def redacted_nodes(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("raw_code"), F.col("source").alias("summary_short"))
    return text.redact_nodes(d).select("id", F.md5("raw_code").alias("code"), "has_redacted_content")


@query("SELECT doc_id, md5(regexp_replace(text, '[0-9]{4,}', '[REDACTED_CUSTOM]', 'g')) AS text, len(regexp_extract_all(text, '[0-9]{4,}'))::INT AS found FROM documents")
def custom_redaction(spark: SparkSession, sf: str) -> DataFrame:
    done = text.redact(F.col("text"), text.Redaction(builtin=False, sensitive=[], custom=["[0-9]{4,}"]))
    return _docs(spark, sf).select("doc_id", done.alias("r")).select("doc_id", F.md5("r.text").alias("text"), F.col("r.redaction_count").cast("int").alias("found"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'half' ELSE 'masked' END ELSE 'none' END AS state FROM part""")
def whitelisted_names(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("password = 'p"), F.col("p_partkey").cast("string"), F.lit("'"), F.when(F.col("p_partkey") % 3 == 0, "\ntoken: \"t\"").otherwise(""))).otherwise("plain = 'text'")
    done = text.redact(code, text.Redaction(builtin=False, whitelist=["token"])).getField("text")
    state = F.when(done.contains('password = "[REDACTED]"'), F.when(done.contains('token = "[WHITELISTED]"'), "half").otherwise("masked")).otherwise("none")
    return star.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), state.alias("state"))


SUMMARY = """CASE k WHEN 0 THEN '**class ' || name || '**' || doc || E'\\nLocation: ' || path || ':1-9' WHEN 1 THEN '**Module: ' || name || '**' || doc || E'\\nFile: ' || path
WHEN 2 THEN '**def ' || name || '()**' || doc || E'\\nLocation: ' || path || E':1-9\\nComplexity: 3\\nDecorators: a, b\\nVisibility: private/internal\\nSize: 9 lines' ELSE '**config: ' || name || E'**\\nLocation: ' || path || ':1-9' END"""
SUMMED = "s AS (SELECT p_partkey AS id, p_partkey % 4 AS k, p_name AS name, 'parts/' || p_brand AS path, CASE WHEN p_size % 2 = 0 THEN E'\\nDocumentation: ' || p_type ELSE '' END AS doc FROM part)"


def _described(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    kind = F.when(k == 0, "class").when(k == 1, "module").when(k == 2, "method").otherwise("config")
    call = F.when(k == 2, F.concat(F.lit("def "), "p_name", F.lit("()"))).otherwise("")
    marks = F.when(k == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return star.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kind.alias("node_type"), F.concat(F.lit("parts/"), "p_brand").alias("file_path"), call.alias("signature"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("docstring"), F.lit(1).alias("line_start"), F.lit(9).alias("line_end"), F.lit(3).alias("complexity"), (k != 2).alias("is_public"), marks.alias("decorators"))


@query(f"WITH {SUMMED} SELECT id, {SUMMARY} AS summary_detailed, 'heuristic' AS summary_mode FROM s")
def summaries_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return text.summarize(_described(spark, sf)).select("id", "summary_detailed", "summary_mode")


@query(f"WITH {SUMMED} SELECT id, CASE WHEN id % 5 = 0 THEN 'told ' || id || E'\\n\\n' ELSE '' END || {SUMMARY} AS summary_detailed, CASE WHEN id % 5 = 0 THEN 'both' ELSE 'heuristic' END AS summary_mode FROM s")
def told_summaries(spark: SparkSession, sf: str) -> DataFrame:
    d = _described(spark, sf)
    told = d.filter("id % 5 = 0").select("id", F.concat(F.lit("told "), F.col("id").cast("string")).alias("summary"))
    return text.summarize(d, "both", told).select("id", "summary_detailed", "summary_mode")


# -- code, schemas, overviews --------------------------------------------------------------


@query("""SELECT 'f' || c_custkey AS source_id, 'table::nation_' || c_nationkey AS target_id, 'queries' AS edge_type, 'Nation' || c_nationkey AS context FROM customer
UNION ALL SELECT 'f' || c_custkey, 'table::nation_' || (c_custkey % 25), 'writes_to', 'nation_' || (c_custkey % 25) FROM customer WHERE c_custkey % 3 = 0""")
def traced_queries(spark: SparkSession, sf: str) -> DataFrame:
    n = star.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("k"))
    c = spread(star.table(spark, sf, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").cast("string").alias("k")))
    pad = F.repeat(F.lit("    x = 1\n"), (F.col("c") % 97 * 13).cast("int"))  # some bodies are long
    code = F.concat(F.lit("def f():\n"), pad, F.lit("    a = session.query(Nation"), "k", F.lit(").all()\n"), F.when(F.col("c") % 3 == 0, F.concat(F.lit('    run("UPDATE nation_'), (F.col("c") % 25).cast("string"), F.lit(' SET a = 1")\n'))).otherwise(""))
    row = lambda i, name, kind, raw: (i.alias("id"), name.alias("name"), F.lit(kind).alias("node_type"), raw.alias("raw_code"), F.lit("python").alias("language"))
    key, none = F.concat(F.lit("nation_"), "k"), F.lit(None).cast("string")
    nodes = c.select(*row(F.concat(F.lit("f"), F.col("c").cast("string")), F.lit("f"), "function", code))
    nodes = nodes.union(n.select(*row(F.concat(F.lit("class"), "k"), F.concat(F.lit("Nation"), "k"), "class", none))).union(n.select(*row(F.concat(F.lit("table::"), key), key, "table", none)))
    defines = n.select(F.concat(F.lit("class"), "k").alias("source_id"), F.concat(F.lit("table::"), key).alias("target_id"), F.lit("defines").alias("edge_type"))
    return database.trace_queries(nodes, defines).select("source_id", "target_id", "edge_type", "context")


@query("""SELECT 'project' AS source_id, 'dir' || n_nationkey AS target_id, 1.0::DOUBLE AS weight FROM nation
UNION ALL SELECT 'dir' || c_nationkey, 'customer:' || c_custkey, 0.9 FROM customer""")
def overview_edges(spark: SparkSession, sf: str) -> DataFrame:
    n, c = star.table(spark, sf, "nation"), star.table(spark, sf, "customer")
    place = lambda k: F.concat(F.lit("people/nation"), F.col(k).cast("string"))
    dirs = n.select(F.concat(F.lit("dir"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("directory_overview").alias("node_type"), place("n_nationkey").alias("file_path"))
    mods = c.select(star.key("customer", "c_custkey"), F.lit("module"), F.concat(place("c_nationkey"), F.lit("/c.py")))
    top = spark.createDataFrame([("project", "project_overview", "__project__")], dirs.schema)
    return graph.overview_edges(dirs.union(mods).union(top)).select("source_id", "target_id", "weight")


@query("""WITH f AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 2 THEN 'rust' END AS language FROM orders)
SELECT language, count(*)::BIGINT AS files FROM f WHERE language IS NOT NULL GROUP BY 1""")
def project_languages(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    ending = F.when(k % 4 == 0, ".py").when(k % 4 == 1, ".go").when(k % 4 == 2, ".rs").otherwise(".unknown")
    paths = star.table(spark, sf, "orders").select(F.concat(F.lit("src/f"), k.cast("string"), ending).alias("file_path"))
    return files.detect_languages(paths).select("language", F.col("files").cast("long").alias("files"))


@query("SELECT p_partkey::VARCHAR AS id, p_name AS name, p_size AS line_start, p_retailprice AS importance FROM part")
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    n = star.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("line_start"), F.col("p_retailprice").alias("importance"))
    return schema.from_json_rows(schema.to_json_rows(n, "id"), n.schema).select("id", "name", "line_start", "importance")
