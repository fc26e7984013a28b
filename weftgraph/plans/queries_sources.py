"""Queries that scan code, schemas and logs, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..sources import database, logs, python_code
from . import starschema as star

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    return star.table(spark, sf, "nation").select("n_nationkey", F.col("n_nationkey").cast("string").alias("k"), F.regexp_replace("n_name", r"\W", "_").alias("name"), F.col("n_regionkey").cast("string").alias("r"))


@query("""WITH n AS (SELECT n_nationkey AS id, regexp_replace(n_name, '\\W', '_', 'g') AS name FROM nation)
SELECT id, name, 'queries' AS edge_type FROM n UNION ALL SELECT id, name || '_log', 'writes_to' FROM n UNION ALL SELECT id, name || '_old', 'writes_to' FROM n UNION ALL SELECT id, name || '_new', 'writes_to' FROM n""")
def sql_table_refs(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("name")
    code = F.concat(F.lit('q("SELECT a,\n b FROM `'), name, F.lit('` WHERE x")\nq("insert into '), name, F.lit('_log VALUES (1)")\nq("delete from '), name, F.lit('_old")\nq("UPDATE '), name, F.lit('_new SET a = 1")'))
    rows = _nations(spark, sf).select(F.col("n_nationkey").alias("id"), code.alias("raw_code"), F.lit("java").alias("language"))
    return database.table_refs(rows).select("id", "name", "edge_type")


@query("""SELECT n_nationkey AS id, 'Nation' || n_nationkey AS name, e AS edge_type FROM nation, (VALUES ('queries'), ('writes_to')) v(e)""")
def orm_query_refs(spark: SparkSession, sf: str) -> DataFrame:
    cls = F.concat(F.lit("Nation"), "k")
    code = F.concat(F.lit("a = session.query("), cls, F.lit(")\n"), cls, F.lit(".objects.filter(x=1)\n"), cls, F.lit(".objects.create(x=1)\n"))
    rows = _nations(spark, sf).select(F.col("n_nationkey").alias("id"), code.alias("raw_code"), F.lit("python").alias("language"))
    return database.table_refs(rows).select("id", "name", "edge_type").distinct()


ORM_ROWS = """SELECT 'nation_' || n_nationkey AS table_name, c.column_name, c.column_type, c.is_primary, c.is_nullable, CASE WHEN c.column_name = 'region_id' THEN 'region_' || n_regionkey || '.id' ELSE '' END AS foreign_key FROM nation,
(VALUES ('id', 'Integer', true, true), ('name', 'String', false, false), ('region_id', 'Integer', false, true)) c(column_name, column_type, is_primary, is_nullable)"""


@query(ORM_ROWS)
def orm_columns(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat(F.lit("class N(Base):\n    __tablename__ = 'nation_"), "k", F.lit("'\n    id = Column(Integer, primary_key=True)\n    name = Column(String, nullable=False)\n    region_id = Column(Integer, ForeignKey('region_"), "r", F.lit(".id'))\n"))
    rows = _nations(spark, sf).select(F.concat(F.lit("n"), "k").alias("id"), F.lit("N").alias("name"), F.lit("class").alias("node_type"), F.lit("m.py").alias("file_path"), code.alias("raw_code"), F.lit("").alias("summary_short"))
    return database.detect_orm(rows).select("table_name", "column_name", "column_type", "is_primary", "is_nullable", "foreign_key")


def _ddl(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("CREATE TABLE nation_"), "k", F.lit(" (\n id INTEGER PRIMARY KEY,\n name VARCHAR(25) NOT NULL, -- the name, in full\n region_id INT REFERENCES region_"), "r", F.lit("(id),\n total DECIMAL(10, 2),\n CONSTRAINT c UNIQUE (name)\n);"))
    return _nations(spark, sf).select(F.concat(F.lit("s"), "k", F.lit(".sql")).alias("file_path"), text.alias("content"))


@query("""SELECT 'nation_' || n_nationkey AS table_name, c.column_name, c.column_type, c.is_primary, c.is_nullable, CASE WHEN c.column_name = 'region_id' THEN 'region_' || n_regionkey || '.id' ELSE '' END AS foreign_key FROM nation,
(VALUES ('id', 'INTEGER', true, true), ('name', 'VARCHAR(25)', false, false), ('region_id', 'INT', false, true), ('total', 'DECIMAL(10, 2)', false, true)) c(column_name, column_type, is_primary, is_nullable)""")
def ddl_columns(spark: SparkSession, sf: str) -> DataFrame:
    return database.scan_ddl(_ddl(spark, sf)).select("table_name", "column_name", "column_type", "is_primary", "is_nullable", "foreign_key")


@query("""SELECT 'db::star' AS source_id, 'table::nation_' || n_nationkey AS target_id, 'contains' AS edge_type FROM nation
UNION ALL SELECT 'table::nation_' || n_nationkey, 'col::nation_' || n_nationkey || '::' || c, 'contains' FROM nation, (VALUES ('id'), ('name'), ('region_id'), ('total')) v(c)
UNION ALL SELECT 'col::nation_' || n_nationkey || '::region_id', 'table::region_' || n_regionkey, 'references' FROM nation""")
def schema_edges(spark: SparkSession, sf: str) -> DataFrame:
    _, edges = database.schema_graph(database.scan_ddl(_ddl(spark, sf)), "star")
    return edges.select("source_id", "target_id", "edge_type")


@query("SELECT 'nation_' || n_nationkey AS table_name, 'id,name,region_id,total' AS columns FROM nation")
def table_columns(spark: SparkSession, sf: str) -> DataFrame:
    return database.ordered_columns(database.scan_ddl(_ddl(spark, sf)))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("# Log\n\n## 2024-01-0"), "r", F.lit(" — Bug in "), "name", F.lit("\n\n**File**: `src/"), "k", F.lit(".py:3`\n**Root cause**: none\n**Fix**: restart\n\n## 2023-12-31 — Other "), "k", F.lit("\n\n**File**: `b.ts`\n"))
    return _nations(spark, sf).select(F.concat(F.lit("gotchas"), "k", F.lit(".md")).alias("file_path"), text.alias("content"))


@query("""WITH n AS (SELECT n_nationkey AS k, regexp_replace(n_name, '\\W', '_', 'g') AS name FROM nation)
SELECT 'bug: Bug in ' || name AS name, 'src/' || k || '.py' AS file_path, 'fixed' AS bug_status, 'none' || chr(10) || 'restart' AS summary_detailed FROM n
UNION ALL SELECT 'bug: Other ' || k, 'b.ts', 'open', '' FROM n""")
def gotcha_log(spark: SparkSession, sf: str) -> DataFrame:
    return logs.parse_gotchas(_log(spark, sf)).select("name", "file_path", "bug_status", "summary_detailed")


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation)
SELECT 'phase: Phase ' || k AS name, 'phase' AS node_type, 'tasks' || k || '.md' AS file_path, 'in_progress' AS task_status, 0 AS line_start FROM n
UNION ALL SELECT 'task: First ' || k, 'task', 'src/' || k || '.go', 'done', 10 FROM n UNION ALL SELECT 'task: Second ' || k, 'task', 'tasks' || k || '.md', 'pending', 0 FROM n""")
def task_log(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("# Phase "), "k", F.lit("\n\n## Fix 1 — First "), "k", F.lit("\n**Status**: [x] done\n**File**: `src/"), "k", F.lit(".go` lines 10-20\n\n## Fix 2 — Second "), "k", F.lit("\n```\n## Fix 3 — not one\n```\n**Status**: [ ] open\n"))
    nodes, _ = logs.parse_tasks(_nations(spark, sf).select(F.concat(F.lit("tasks"), "k", F.lit(".md")).alias("file_path"), text.alias("content")))
    return nodes.select("name", "node_type", "file_path", "task_status", "line_start")


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit('"""Module."""\nimport os\n\ndef helper_'), "k", F.lit("(x):\n    if x:\n        return os.path.join(x)\n    return x\n\nclass Nation"), "k", F.lit("(Base):\n    def run(self):\n        return helper_"), "k", F.lit("(1)\n"))
    return _nations(spark, sf).select(F.concat(F.lit("src/n"), "k", F.lit(".py")).alias("file_path"), text.alias("content"))


@query("""SELECT 'src/n' || n_nationkey || '.py' AS file_path, t AS node_type, CASE t WHEN 'module' THEN 'n' || n_nationkey WHEN 'function' THEN 'helper_' || n_nationkey WHEN 'class' THEN 'Nation' || n_nationkey ELSE 'Nation' || n_nationkey || '.run' END AS name,
c::INT AS complexity FROM nation, (VALUES ('module', 1), ('function', 2), ('class', 1), ('method', 1)) v(t, c)""")
def parse_python(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = python_code.parse_files(_sources(spark, sf))
    return nodes.select("file_path", "node_type", "name", "complexity")


@query("""SELECT 'Nation' || n_nationkey || '.run' AS caller, 'helper_' || n_nationkey AS callee FROM nation""")
def resolved_calls(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = python_code.parse_files(_sources(spark, sf))
    found = graph.resolve_edges(edges, nodes).filter("edge_type = 'calls'")
    name = nodes.select("id", "name")
    return found.join(name.toDF("source_id", "caller"), "source_id").join(name.toDF("target_id", "callee"), "target_id").select("caller", "callee")
