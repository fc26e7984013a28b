"""Streams: changed files into the graph, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import fingerprint
from ..operators.store import Store

FILES = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("content", T.StringType()), T.StructField("modified", T.TimestampType())])


def file_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (file_path, content, modified) from Parquet files that arrive in folder."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest(stream: DataFrame, store: Store, extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str, once: bool = True):
    """Keep the store's nodes, edges and file states up with a stream of files.

    Of a batch the last version of each file counts, and only if its fingerprint is new; what the
    file gave before is replaced. A batch that runs twice gives the same tables.
    """
    from pyspark.sql import Window

    from ..operators import schema as S
    from ..operators.store import delete_files

    def batch(df: DataFrame, _: int) -> None:
        latest = df.withColumn("__n", F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("modified"), F.desc("content")))).filter("__n = 1").drop("__n")
        latest = latest.withColumn("content_hash", fingerprint(F.col("content")))
        known = store.read("file_state").select("file_path", "content_hash")
        changed = latest.join(known, ["file_path", "content_hash"], "left_anti")
        if changed.isEmpty():
            return
        nodes, edges = extract(changed)
        old_nodes, old_edges, _ = delete_files(store.read("nodes"), store.read("edges"), changed)
        store.write("nodes", old_nodes.unionByName(S.conform(nodes, S.NODES)))
        store.write("edges", old_edges.unionByName(S.conform(edges, S.EDGES)))
        now = F.current_timestamp()
        store.upsert("file_state", changed.select("file_path", "content_hash", F.lit("sha256").alias("fingerprint_kind"), now.alias("last_indexed"), now.alias("last_verified")))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, ts: str, keys: list[str], value: str, length: str = "1 day", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and key; with a watermark, on streams or tables alike."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    held = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return held.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user: runs of events less than a gap apart."""
    held = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return held.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
