"""Graph tables as immutable snapshots: upserts, deletes, diffs and atomic swaps."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import materialize
from . import schema as S

KEYS = {"nodes": ["id"], "edges": ["source_id", "target_id", "edge_type"], "embeddings": ["node_id"], "file_state": ["file_path"], "index_state": ["key"], "package_docs": ["package_name", "registry"], "session_log": ["session_id"]}


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows of a key the last in the given order."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """current with each key of changes replaced as a whole row, or added. changes may repeat a
    key if it has a column __version, of which the largest wins; ties go by the whole row."""
    if "__version" in changes.columns:
        rest = [c for c in changes.columns if c not in keys and c != "__version"]
        changes = last_wins(changes, keys, [F.col("__version"), F.to_json(F.struct(*rest))]).drop("__version")
    kept = current.join(changes.select(*keys), keys, "left_anti")
    return kept.unionByName(changes.select(*current.columns), allowMissingColumns=True)


def upsert_sessions(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Sessions by id; a session that is known keeps its start."""
    old = current.select("session_id", F.col("started_at").alias("__start"))
    merged = changes.join(old, "session_id", "left").withColumn("started_at", F.coalesce("__start", "started_at")).drop("__start")
    return upsert(current, merged, ["session_id"])


SHORT = 2_000_000  # ids that are broadcast at most, about 80 bytes each


def valid_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose ends both exist, the others). Ends without a node are listed once; up to
    SHORT of them are broadcast, so that edges stay where they are."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("__end")).filter("__end IS NOT NULL").distinct()
    gone = materialize(ends.join(nodes.select(F.col("id").alias("__end")), "__end", "left_anti"), "missing")
    if gone.count() <= SHORT:
        gone = F.broadcast(gone)
    s, t = gone.select(F.col("__end").alias("__s")), gone.select(F.col("__end").alias("__t"))
    marks = edges.join(s, F.col("source_id") == F.col("__s"), "left").join(t, F.col("target_id") == F.col("__t"), "left")
    bad = F.col("__s").isNotNull() | F.col("__t").isNotNull() | F.col("source_id").isNull() | F.col("target_id").isNull()
    return marks.filter(~bad).select(*edges.columns), marks.filter(bad).select(*edges.columns)


def cascade(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Edges and embeddings of the nodes that are left."""
    ids = nodes.select("id")
    edges = edges.join(ids, edges.source_id == ids.id, "left_semi").join(ids, edges.target_id == ids.id, "left_semi")
    return nodes, edges, embeddings and embeddings.join(ids, embeddings.node_id == ids.id, "left_semi")


def delete_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame, embeddings: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """All that belongs to the files of paths (file_path) goes."""
    return cascade(nodes.join(paths.select("file_path"), "file_path", "left_anti"), edges, embeddings)


def delete_edges_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch none of ids (id)."""
    return edges.join(ids, edges.source_id == ids.id, "left_anti").join(ids, edges.target_id == ids.id, "left_anti")


def delete_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys), keys, "left_anti")


EDITABLE = ("archived", "severity", "bug_status", "task_status", "priority", "importance", "summary_short", "summary_detailed")


def update_field(nodes: DataFrame, node_id: str, field: str, value: object) -> DataFrame:
    """One field of one node; only fields of EDITABLE."""
    if field not in EDITABLE:
        raise ValueError(f"{field} can't be edited")
    return nodes.withColumn(field, F.when(F.col("id") == node_id, F.lit(value)).otherwise(F.col(field)).cast(nodes.schema[field].dataType))


def file_diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """file_path and change (new, changed, removed, same) of all paths of both tables of
    (file_path, content_hash)."""
    c, s = current.select("file_path", F.col("content_hash").alias("now")), stored.select("file_path", F.col("content_hash").alias("was"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "changed").otherwise("same")
    return c.join(s, "file_path", "full").select("file_path", change.alias("change"))


def freshness(stored: DataFrame, current: DataFrame, now: Column, ttl_seconds: int = 300) -> DataFrame:
    """file_path and status: new, deleted, fresh or stale. A file that was verified in the last
    ttl_seconds is fresh without looking at it."""
    c = current.select("file_path", F.col("content_hash").alias("now_hash"))
    s = stored.select("file_path", "content_hash", "last_verified")
    recent = F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("last_verified") < ttl_seconds, F.lit(False))
    status = F.when(F.col("content_hash").isNull(), "new").when(recent, "fresh").when(F.col("now_hash").isNull(), "deleted").when(F.col("now_hash") == F.col("content_hash"), "fresh").otherwise("stale")
    return c.join(s, "file_path", "full").select("file_path", status.alias("status"))


# -- snapshots -----------------------------------------------------------------------------


class Conflict(RuntimeError):
    """Another writer changed a table after this store had read it."""


class Store:
    """Named tables under one folder, each an immutable snapshot that the newest manifest names.

    A write makes new snapshot folders first and one new manifest last, so readers see all its
    tables or none of them, and a failed write leaves the old state. Manifests are numbered and
    each number can be made only once: of two writers the later one takes the next number if it
    touched other tables, and gets a Conflict if what it had read is no longer current.
    """

    KEPT = 3  # manifests that stay for readers that hold an older one

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._seen: dict[str, str | None] = {}

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join((self.root, *parts)))

    def _numbers(self) -> list[int]:
        at = self._path("_manifests")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _latest(self) -> tuple[int, dict[str, str]]:
        numbers = self._numbers()
        if not numbers:
            return 0, {}
        stream = self._fs.open(self._path("_manifests", f"{numbers[-1]:012d}"))
        try:
            return numbers[-1], json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, number: int, tables: dict[str, str]) -> bool:
        """Make the manifest of that number, unless there is one."""
        at = self._path("_manifests", f"{number:012d}")
        try:
            stream = self._fs.create(at, False)
        except Py4JJavaError:
            return False
        stream.write(bytearray(json.dumps(tables).encode()))
        stream.close()
        return max(self._numbers()) == number

    def current(self, name: str) -> str | None:
        return self._latest()[1].get(name)

    def read(self, name: str) -> DataFrame:
        at = self._seen[name] = self.current(name)
        return S.empty(self.spark, S.SCHEMAS[name]) if at is None else self.spark.read.schema(S.SCHEMAS[name]).parquet(f"{self.root}/{name}/{at}").select(*S.SCHEMAS[name].names)

    def write(self, name: str, df: DataFrame) -> None:
        self.write_all({name: df})

    def write_all(self, tables: dict[str, DataFrame]) -> None:
        """Replace the tables, all at once. Conflict if one of them is no longer what was read."""
        made = {}
        for name, df in tables.items():
            made[name] = uuid.uuid4().hex
            out = S.conform(df, S.SCHEMAS[name]).write
            (out.partitionBy("category") if name == "nodes" else out).parquet(f"{self.root}/{name}/{made[name]}")
        while True:
            number, held = self._latest()
            for name in made:
                if self._seen.get(name, held.get(name)) != held.get(name):
                    raise Conflict(f"{name} was changed by another writer")
            if self._publish(number + 1, held | made):
                break
        self._seen |= made
        for old in self._numbers()[: -self.KEPT]:
            self._fs.delete(self._path("_manifests", f"{old:012d}"), False)

    def upsert(self, name: str, changes: DataFrame) -> None:
        schema = S.SCHEMAS[name]
        extra = [F.col("__version")] if "__version" in changes.columns else []
        wanted = S.conform(changes, schema) if not extra else changes.select(*[c for c in S.conform(changes, schema).columns if c in changes.columns], *extra)
        self.write(name, upsert(self.read(name), wanted, KEYS[name]))

    def state(self) -> dict:
        """The index state, defaults where none is stored."""
        row = self.read("index_state").filter("key = 'main'").first()
        return row.asDict() if row else {"key": "main", "last_commit": "", "last_full_index": None, "last_update": None, "total_nodes": 0, "total_edges": 0, "total_files": 0, "index_mode": "ast_only"}
