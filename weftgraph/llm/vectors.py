"""Vectors as fixed-width binary rows, for numpy in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import col


def vector_size(df: DataFrame, vec_col: str) -> int:
    """The most frequent number of components (the smaller on a tie); 0 without vectors."""
    sizes = df.filter(col(vec_col).isNotNull()).groupBy(F.size(col(vec_col)).alias("size")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), "size").first()
    return first["size"] if first else 0


def element_type(df: DataFrame, vec_col: str) -> str:
    """numpy's name of the component type: floats stay floats, all else becomes doubles."""
    return "<f4" if df.select(col(vec_col)).schema[0].dataType == T.ArrayType(T.FloatType()) or str(df.select(col(vec_col)).schema[0].dataType).startswith("ArrayType(FloatType") else "<f8"


def binary_vectors(df: DataFrame, vec_col: str, keep: dict[str, str], dim: int, kind: str) -> DataFrame:
    """The columns keep (new name: column) and vec: the vector's bytes, or null where it has not
    `dim` components, is zero, or holds a null or a component that is not finite."""
    rows = df.select(*[col(v).alias(k) for k, v in keep.items()], col(vec_col).alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["vec"]
            n = b.num_rows
            sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
            flat = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            held = np.maximum(sizes, 0)
            at = np.flatnonzero(sizes == dim) if dim else np.empty(0, np.int64)
            first = (np.cumsum(held) - held)[at]
            x = flat[first[:, None] + np.arange(dim)] if len(at) else np.empty((0, max(dim, 1)))
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            data = (x + 0.0).astype(kind).tobytes()  # + 0.0: no negative zeros
            width = dim * int(kind[2])
            out: list[bytes | None] = [None] * n
            for k, i in enumerate(at.tolist()):
                if ok[k]:
                    out[i] = data[k * width : (k + 1) * width]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], names=b.schema.names)

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("vec", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)
