"""The data model: typed nodes and edges of a property graph, as table schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The node types, in the order of the one-hot features, and those without one.
NODE_TYPES = (
    "module", "class", "function", "method", "config", "export", "type_def", "other",
    "interface", "trait", "struct", "enum", "type_alias", "constant",
    "table", "view", "stored_procedure",
    "project_overview", "directory_overview",
    "bug", "phase", "task", "subtask",
)
OTHER_NODE_TYPES = ("database", "column", "insight")

#: The edge types, in the order of the profile features, and those without one.
EDGE_TYPES = (
    "calls", "imports", "inherits", "implements", "defines", "uses", "contains",
    "relates_to", "fixed_by", "phase_contains", "task_contains",
)
OTHER_EDGE_TYPES = ("references", "queries", "writes_to")

#: States of work items.
TASK_STATUSES = ("pending", "in_progress", "testing", "done")
BUG_STATUSES = ("open", "fixed")
PRIORITIES = ("low", "medium", "high")
STATUS_ALIASES = {"new": "pending"}

#: Weights of node types in the importance; others weigh 0.05.
TYPE_WEIGHTS = {"module": 0.3, "class": 0.4, "function": 0.2, "method": 0.1, "config": 0.3, "export": 0.2, "type_def": 0.15, "other": 0.05}
OTHER_WEIGHT = 0.05


def _fields(*specs: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType(), "a": T.ArrayType(T.StringType()), "t": T.TimestampType(), "v": T.ArrayType(T.FloatType()), "l": T.LongType(), "w": T.ArrayType(T.DoubleType()), "m": T.MapType(T.StringType(), T.StringType())}
    return T.StructType([T.StructField(n, kinds[k]) for k, names in (x.split(":") for x in specs) for n in names.split()])


NODES = _fields(
    "s:id name node_type file_path", "i:line_start line_end", "s:summary_short summary_detailed summary_mode signature docstring", "i:complexity", "d:importance", "b:is_public", "a:decorators",
    "s:content_hash language raw_code", "b:has_redacted_content", "s:category", "b:archived", "s:severity bug_status task_status priority lsp_type_info lsp_hover_doc", "a:lsp_diagnostics",
)
EDGES = _fields("s:source_id target_id edge_type context", "d:weight")
UNRESOLVED = _fields("s:source_id target_name edge_type context file_path", "d:weight", "l:ordinal")
EMBEDDINGS = _fields("s:node_id content_hash", "v:embedding")
FILE_STATE = _fields("s:file_path content_hash fingerprint_kind", "t:last_indexed last_verified")
INDEX_STATE = _fields("s:key last_commit", "t:last_full_index last_update", "l:total_nodes total_edges total_files", "s:index_mode")
PACKAGE_DOCS = _fields("s:package_name registry version summary description homepage_url doc_url", "t:fetched_at")
SESSION_LOG = _fields("s:session_id", "t:started_at ended_at", "m:data")
TABLE_COLUMNS = _fields("s:table_name source_node_id language file_path column_name column_type", "b:is_primary is_nullable", "s:foreign_key", "i:ordinal")
POSTINGS = _fields("s:node_id term", "l:tf text_hash")
MODEL = _fields("s:term version", "i:idx", "d:idf mean", "w:load")

SCHEMAS = {"nodes": NODES, "edges": EDGES, "unresolved": UNRESOLVED, "embeddings": EMBEDDINGS, "file_state": FILE_STATE, "index_state": INDEX_STATE, "package_docs": PACKAGE_DOCS, "session_log": SESSION_LOG, "postings": POSTINGS, "model": MODEL}

DEFAULTS: dict[str, object] = {"line_start": 0, "line_end": 0, "complexity": 1, "importance": 0.0, "is_public": True, "category": "codebase", "archived": False, "has_redacted_content": False, "summary_mode": "heuristic", "language": "python"}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns: unknown ones go, missing ones get their default."""
    have = set(df.columns)
    made = [(F.col(f.name) if f.name in have else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*made)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def invalid_nodes(nodes: DataFrame) -> DataFrame:
    """Rows whose type, status or priority the model doesn't know."""
    known = F.col("node_type").isin(*NODE_TYPES, *OTHER_NODE_TYPES)
    states = F.coalesce(F.col("task_status").isin(*TASK_STATUSES, ""), F.lit(True)) & F.coalesce(F.col("bug_status").isin(*BUG_STATUSES, ""), F.lit(True))
    return nodes.filter(~F.coalesce(known, F.lit(False)) | ~states | ~F.coalesce(F.col("priority").isin(*PRIORITIES, ""), F.lit(True)))


def active() -> Column:
    """Not archived; unknown counts as active."""
    return ~F.coalesce(F.col("archived"), F.lit(False))


def from_json_rows(rows: DataFrame, schema: T.StructType, data_col: str = "data") -> DataFrame:
    """Records kept as JSON text, unknown keys dropped."""
    return rows.select(F.from_json(data_col, schema).alias("r")).select("r.*")


def to_json_rows(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("data"))
