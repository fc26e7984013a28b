"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import delete, discard, keep, materialize, scratch, shared_dir

__all__ = ["col", "delete", "discard", "fresh_path", "keep", "materialize", "per_process", "scratch", "table", "tidy"]


def col(name: str) -> Column:
    """A column by its literal name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_process(key: str, make: Callable[[], Any]) -> Any:
    """make(), once in each Python worker: it is kept from task to task."""
    held = sys.modules.setdefault("_weftgraph_per_process", types.ModuleType("_weftgraph_per_process")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def release(but: str | None = None) -> None:
    """Forget what per_process keeps under other keys, and give freed memory back to the system."""
    held = vars(sys.modules.get("_weftgraph_per_process", types.ModuleType("")))
    for key in [k for k in held if not k.startswith("__") and k != but]:
        del held[key]
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], key: str | None = None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for a Python worker, which lives on for tasks of other operators: a task starts without
    what they keep there (its own key stays), and does not hold on to what it freed."""

    def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(key)
        try:
            yield from run(batches)
        finally:
            release(key)

    return tidied
