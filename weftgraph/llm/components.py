"""Connected components: inside one task with numpy, and across the cluster with joins."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize, tidy


def label(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links i[k]-j[k], the smallest node of each node's component."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root != (nxt := root[root])).any():
            root = nxt
    return root


def grow(n: int, near: Callable[[int], np.ndarray]) -> np.ndarray:
    """Components of rows 0..n-1, as `label` gives them; near(i): which rows link with row i.

    Rows are asked until all outside the largest component were: of two rows that were not, both
    lie in it. So a dense group costs a question or two, not one for each of its rows.
    """
    root, asked = np.arange(n), np.zeros(n, bool)
    at = 0
    while True:
        asked[at] = True
        met = near(at)
        met[at] = True
        names = np.unique(root[met])
        if len(names) > 1:
            moved = np.zeros(n, bool)
            moved[names] = True
            root[moved[root]] = names[0]
        open_ = np.flatnonzero(~asked & (root != np.bincount(root).argmax()))
        if not len(open_):
            return root
        at = int(open_[0])


class Forest:
    """Gathers links and keeps no more of them than a spanning forest needs."""

    MOST = 400_000

    def __init__(self, n: int):
        self.n, self.parts, self.held = n, [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            self.parts.append((i, j))
            self.held += len(i)
            if self.held > self.MOST + self.n:
                self.parts = [self.star()]
                self.held = len(self.parts[0][0])

    def star(self) -> tuple[np.ndarray, np.ndarray]:
        """Links (node, root) that join the same nodes as all that was added."""
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        root = label(self.n, np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))
        node = np.flatnonzero(root != np.arange(self.n))
        return node, root[node]


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: list[str], least: int = 65_536) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by the integer columns `keys`: tables of whole key groups, with the
    group number of each row. A table holds `least` rows or more, the last one fewer."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(t: pa.Table, last: bool) -> tuple[pa.Table, np.ndarray, pa.Table | None]:
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        group = np.cumsum(new)
        end = t.num_rows if last else (np.flatnonzero(new)[-1] if new.any() else 0)
        return t.slice(0, end), group[:end], None if last else t.slice(end)

    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= least:
            done, group, rest = cut(pa.Table.from_batches(held), False)
            if done.num_rows:
                yield done, group
            held = rest.combine_chunks().to_batches()
            rows = rest.num_rows
            least = max(least, 2 * rows)  # a group that is still open is not scanned again and again
    if rows:
        done, group, _ = cut(pa.Table.from_batches(held), True)
        yield done, group


def forest_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that join the same nodes as u[k]-v[k]."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = label(len(names), at[: len(u)], at[len(u) :])
    node = np.flatnonzero(root != np.arange(len(names)))
    return names[node], names[root[node]]


def thinned(links: DataFrame, a: str = "a", b: str = "b", most: int = Forest.MOST) -> DataFrame:
    """Links (a, b) that join the same nodes, fewer where many nodes have links to the same few
    smaller ones, as groups have that meet in many buckets: all links of a larger end go to one
    task, and of `most` links at a time it hands on a spanning forest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = v = np.empty(0, np.int64)
        for t in batches:
            u, v = np.concatenate([u, t["a"].to_numpy()]), np.concatenate([v, t["b"].to_numpy()])
            if len(u) >= most:
                u, v = forest_of(u, v)
                if 2 * len(u) >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])
                    u = v = u[:0]
        u, v = forest_of(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    ends = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    return ends.repartition("a").mapInArrow(tidy(run), "a long, b long")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link but the roots themselves; root: the smallest node
    of the component.

    links: two long columns, in any direction, repeats and self-links allowed; links with a
    null end are ignored. Large-star and small-star steps alternate until nothing moves. Each
    step is a minimum by key (combined before its shuffle) and a join, so a node with very many
    links is split like any skewed join key; every round is written to the shared folder.
    """
    spark = links.sparkSession
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialize(edges, "components")
    while True:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
        low = both.groupBy("x").agg(F.min(F.least("x", "y")).alias("m"))
        large = both.filter("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "components-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = materialize(near.union(low).distinct(), "components")
        moved = small.join(edges, ["u", "v"], "left_anti").limit(1).count() or edges.join(small, ["u", "v"], "left_anti").limit(1).count()
        discard(spark, large)
        discard(spark, edges)
        edges = small
        if not moved:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
