"""Minimax contiguous sharding, with DataFrame functions only.

Rows of equal text are one atomic group. Groups are ordered by the SHA-256 of their text, and
the shards are contiguous runs of that order whose largest total is as small as any such cut
allows: the capacity is binary-searched, each trial is checked greedily, and the cut is made at
the smallest feasible one.

The search never needs all group sizes in one place. The driver holds totals of key prefixes
(4096 at first). A prefix counts as divisible for a lower bound on the capacity and as atomic
for an upper bound; only prefixes in which a cut can still fall are split further, until both
bounds meet, so the answer is the exact one at any size.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import col, materialize

FIRST_DIGITS = 3  # hexadecimal digits of the first prefixes
MORE_DIGITS = 2  # digits that a split adds


class Segments:
    """Ordered key prefixes with the total size and the number of groups below each."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.rows = sorted(rows)
        self.ends = list(accumulate(size for _, size, _ in self.rows))
        self.starts = [0, *self.ends[:-1]]
        self.total = self.ends[-1] if self.ends else 0

    def walk(self, capacity: int, shards: int, divisible: bool) -> list[int]:
        """Positions after each shard of the greedy cut, at most `shards` of them."""
        at, out = 0, []
        for _ in range(shards):
            want = at + capacity
            if want >= self.total:
                at = self.total
            else:
                k = bisect_right(self.ends, want)  # the segment that `want` falls into
                at = want if divisible and self.rows[k][2] > 1 else max(at, self.starts[k])
            out.append(at)
        return out

    def capacity(self, shards: int, divisible: bool) -> int:
        low, high = 0, self.total
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, shards, divisible)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def undecided(self, low: int, high: int, shards: int) -> list[int]:
        """Divisible segments in which a cut falls for some capacity from low to high."""
        out: set[int] = set()
        for a, b in zip(self.walk(low, shards, False), self.walk(high, shards, True)):
            for k in range(bisect_right(self.ends, a), bisect_left(self.starts, b)):
                if self.rows[k][2] > 1:
                    out.add(k)
        return sorted(out)


def _prefixes(groups: DataFrame, digits: int, within: list[str] | None = None) -> list[tuple[str, int, int]]:
    if within is not None:
        groups = groups.filter(F.substring("group_key", 1, len(within[0])).isin(within))
    rows = groups.groupBy(F.substring("group_key", 1, digits).alias("p")).agg(F.sum("group_size").alias("s"), F.count("*").alias("n"))
    return [(r["p"], r["s"], r["n"]) for r in rows.collect()]  # of prefixes, never of groups


def minimax_bounds(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity, and the keys at which shards 1, 2, ... begin.

    groups: group_key (hexadecimal digest), group_size. An empty table gives (0, []).
    """
    seg = Segments(_prefixes(groups, FIRST_DIGITS))
    while True:
        heavy = [k for k, (_, size, n) in enumerate(seg.rows) if n > 1 and size * 16 * shards > seg.total and len(seg.rows[k][0]) < 2 * FIRST_DIGITS]
        low, high = seg.capacity(shards, True), seg.capacity(shards, False)
        if low == high:
            break
        split = heavy or seg.undecided(low, high, shards)
        names: dict[int, list[str]] = {}
        for k in split:
            names.setdefault(len(seg.rows[k][0]), []).append(seg.rows[k][0])
        gone, kept = {seg.rows[k][0] for k in split}, []
        for digits, within in names.items():
            kept += _prefixes(groups, digits + MORE_DIGITS, within)
        seg = Segments([r for r in seg.rows if r[0] not in gone] + kept)
    bounds = []
    for at in seg.walk(high, shards, False)[:-1]:
        if at < seg.total:
            bounds.append(seg.rows[bisect_left(seg.starts, at)][0])
    return high, bounds


def text_sizes(docs: DataFrame, id_col: str, text_col: str, overhead: int) -> DataFrame:
    text = F.coalesce(col(text_col), F.lit(""))
    return docs.select(
        col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("group_key"),
    )


def shard_of(key: Column, bounds: list[str]) -> Column:
    """How many bounds are not above the key."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= key))


def minimax_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Each row of docs with its shard and a gapless slot in it.

    Returns doc_id, size (UTF-8 bytes plus overhead), text_crc32, group_key, shard, slot.
    A null text counts as empty, so null and empty texts are one group. Ids may be null or
    repeat: every row gets a slot of its own. Shards beyond the last group stay empty; an
    empty table gives an empty result. Other columns are not carried.
    """
    base = materialize(text_sizes(docs, id_col, text_col, overhead), "shard-sizes")
    groups = materialize(base.groupBy("group_key").agg(F.sum("size").alias("group_size")), "shard-groups")
    _, bounds = minimax_bounds(groups, shards)
    # Slots: about sqrt(n) parts of a shard are numbered each for itself, from an offset.
    parts = max(1, math.isqrt(base.count()))
    dealt = base.withColumn("shard", shard_of(F.col("group_key"), bounds)).withColumn("part", F.pmod(F.xxhash64("doc_id", "size"), F.lit(parts)).cast("int"))
    held = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    offsets = held.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first"))
    slot = F.col("first") + F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "size")) - 1
    return dealt.join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", "group_key", "shard", slot.cast("long").alias("slot"))
