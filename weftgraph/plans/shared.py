"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Deletes the shuffle files of a query when it is done. A written table is never computed again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where that is unset and driver
    and executors are one process. Elsewhere a ValueError: executors would each write to a disk
    of their own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    held = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if held is None else spark.conf.set(CLEANUP, held)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files behind materialised tables that are no longer read."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(spark, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialised inside is deleted at the end, but for a table that `keep` was given."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def keep(df: DataFrame) -> DataFrame:
    """Hand a materialised table on to the enclosing scope, or to none."""
    names = {f.rsplit("/", 2)[1] for f in df.inputFiles()}
    inner = _scopes[-1] if _scopes else []
    for path in [p for p in inner if p.rsplit("/", 1)[1] in names]:
        inner.remove(path)
        if len(_scopes) > 1:
            _scopes[-2].append(path)
    return df


TASK_ROWS = 500_000  # rows that a task groups at most, so that its memory does not grow with the table


def deal(df: DataFrame, *columns: str, rows: int = TASK_ROWS) -> DataFrame:
    """df by the hash of columns over as many partitions as keep a task at about `rows` rows, and
    at least one for each core. For groups that hardly shrink the table: nothing is combined before
    the shuffle, and adaptive execution doesn't join partitions."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n, *columns)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a table of one small file is read
    by one task otherwise. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
