"""The driver's tables seen as graph tables, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import deal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """id, name, node_type, file_path, is_public, category, importance of the named tables' rows."""
    t = lambda n: table(spark, sf_dir, n)
    yes = F.lit(True)
    made = {
        "region": lambda: t("region").select(key("region", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("module").alias("node_type"), F.lit("world/regions.py").alias("file_path"), yes.alias("is_public")),
        "nation": lambda: t("nation").select(key("nation", "n_nationkey"), "n_name", F.lit("class"), F.concat(F.lit("world/region"), F.col("n_regionkey").cast("string"), F.lit(".py")), yes),
        "customer": lambda: t("customer").select(key("customer", "c_custkey"), "c_name", F.lit("function"), F.concat(F.lit("people/nation"), F.col("c_nationkey").cast("string"), F.lit("/customers.py")), F.col("c_acctbal") >= 0),
        "supplier": lambda: t("supplier").select(key("supplier", "s_suppkey"), "s_name", F.lit("method"), F.concat(F.lit("people/nation"), F.col("s_nationkey").cast("string"), F.lit("/suppliers.py")), F.col("s_acctbal") >= 0),
        "part": lambda: t("part").select(key("part", "p_partkey"), "p_name", F.lit("type_def"), F.concat(F.lit("parts/"), "p_brand", F.lit(".py")), yes),
        "orders": lambda: t("orders").select(key("orders", "o_orderkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.lit("config"), F.concat(F.lit("orders/"), "o_orderstatus", F.lit(".py")), yes),
    }
    out = None
    for kind in kinds or made:
        df = made[kind]().toDF("id", "name", "node_type", "file_path", "is_public")
        out = df if out is None else out.union(df)
    return out.withColumn("category", F.lit("codebase")).withColumn("importance", F.lit(0.0)).withColumn("archived", F.lit(False))


NODES_SQL = """
nodes AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS name, 'module' AS node_type, 'world/regions.py' AS file_path, true AS is_public FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'class', 'world/region' || n_regionkey || '.py', true FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'function', 'people/nation' || c_nationkey || '/customers.py', c_acctbal >= 0 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'method', 'people/nation' || s_nationkey || '/suppliers.py', s_acctbal >= 0 FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'type_def', 'parts/' || p_brand || '.py', true FROM part
  UNION ALL SELECT 'orders:' || o_orderkey, 'order ' || o_orderkey, 'config', 'orders/' || o_orderstatus || '.py', true FROM orders
)"""


def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    pairs = [("nation", "region", "n_regionkey", "n_nationkey"), ("customer", "nation", "c_nationkey", "c_custkey"), ("orders", "customer", "o_custkey", "o_orderkey"), ("supplier", "nation", "s_nationkey", "s_suppkey")]
    out = None
    for name, up, a, b in pairs:
        df = t(name).select(key(up, a).alias("source_id"), key(name, b).alias("target_id"))
        out = df if out is None else out.union(df)
    return out.select("source_id", "target_id", F.lit("contains").alias("edge_type"), F.lit(1.0).alias("weight"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contains, orders use parts (weight: quantity), suppliers query parts (weight: lines)."""
    line = table(spark, sf_dir, "lineitem")
    uses = deal(line.select("l_orderkey", "l_partkey", "l_quantity"), "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("weight")).select(key("orders", "l_orderkey").alias("source_id"), key("part", "l_partkey").alias("target_id"), F.lit("uses").alias("edge_type"), "weight")
    asks = deal(line.select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.count("*").cast("double").alias("weight")).select(key("supplier", "l_suppkey"), key("part", "l_partkey"), F.lit("queries"), "weight")
    return contains(spark, sf_dir).union(uses).union(asks)


EDGES_SQL = """
edges AS (
  SELECT 'region:' || n_regionkey AS source_id, 'nation:' || n_nationkey AS target_id, 'contains' AS edge_type, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', 1.0 FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey, 'contains', 1.0 FROM orders
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains', 1.0 FROM supplier
  UNION ALL SELECT 'orders:' || l_orderkey, 'part:' || l_partkey, 'uses', sum(l_quantity) FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'queries', count(*)::DOUBLE FROM lineitem GROUP BY l_suppkey, l_partkey
)"""


def event_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Event types as functions; each calls the type of its user's next event."""
    e = table(spark, sf_dir, "events")
    step = e.select("event_type", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next")).filter("next IS NOT NULL")
    calls = step.groupBy(F.col("event_type").alias("source_id"), F.col("next").alias("target_id")).agg(F.count("*").cast("double").alias("weight")).withColumn("edge_type", F.lit("calls"))
    types = e.select(F.col("event_type").alias("id")).distinct().select("id", F.col("id").alias("name"), F.lit("function").alias("node_type"), F.lit("events.py").alias("file_path"), F.lit(True).alias("is_public"))
    return types, calls.select("source_id", "target_id", "edge_type", "weight")


EVENT_GRAPH_SQL = """
step AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
calls AS (SELECT event_type AS source_id, nxt AS target_id, count(*)::DOUBLE AS weight FROM step WHERE nxt IS NOT NULL GROUP BY 1, 2)"""


def inherits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment turned around: what is contained inherits from its container."""
    return contains(spark, sf_dir).select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit("inherits").alias("edge_type"), "weight")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks; every tenth is archived."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("in_progress")
    priority = F.when(F.col("o_orderpriority") < "3", "high").when(F.col("o_orderpriority") < "4", "medium").otherwise("low")
    return o.select(key("orders", "o_orderkey").alias("id"), F.concat(F.lit("task: "), F.col("o_orderkey").cast("string")).alias("name"), F.lit("task").alias("node_type"), F.lit("tasks").alias("category"), status.alias("task_status"), priority.alias("priority"), (F.col("o_orderkey") % 10 == 0).alias("archived"), ((F.col("o_orderkey") % 100) / 100).alias("importance"), F.lit(None).cast("string").alias("bug_status"), F.lit(None).cast("string").alias("summary_short"))


TASKS_SQL = """
tasks AS (
  SELECT 'orders:' || o_orderkey AS id, 'task: ' || o_orderkey AS name,
    CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'in_progress' END AS task_status,
    CASE WHEN o_orderpriority < '3' THEN 'high' WHEN o_orderpriority < '4' THEN 'medium' ELSE 'low' END AS priority,
    o_orderkey % 10 = 0 AS archived, (o_orderkey % 100)::DOUBLE / 100 AS importance
  FROM orders
)"""


def vector_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as nodes named by their label, each containing the next."""
    e = table(spark, sf_dir, "embeddings")
    made = e.select(key("v", "vec_id").alias("id"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("name"), ((F.col("vec_id") % 10) / 10).alias("importance"), F.col("embedding").cast("array<double>").alias("embedding"), "vec_id")
    link = e.select(key("v", "vec_id").alias("source_id"), F.concat(F.lit("v:"), (F.col("vec_id") + 1).cast("string")).alias("target_id"), F.lit("contains").alias("edge_type"), F.lit(1.0).alias("weight"))
    return made, link
