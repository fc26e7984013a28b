"""Nearest neighbours by inner product: an inverted file with product-quantised residuals.

Coarse centroids and residual codebooks are fitted on a bounded sample; every row is indexed:
it goes to the list of its nearest centroid, and its residual, divided by the list's mean
residual length, is coded by one byte per sub-space. (Without that scale, a dense group of near
copies would share a few codes.) A query probes the lists whose centroids have the largest inner
product with it. The sample gives each query a floor: the k-th best inner product among its rows
in lists that the query probes, which the k-th best found cannot be below. Lists that cannot reach the floor, by their centroid and
their longest residual, are not probed. In a list the query's asymmetric table (inner products of
its sub-vectors with all codewords) scores every row by table look-ups; rows whose score is below
the floor, or the k-th best score of their block, by more than the list's coding error allows are
out. Only for the others exact inner products of the original vectors are computed, in double
precision.

Lists are cut into blocks and a list's queries into sets, both of bounded size, so a list that
holds a third of all rows is many small tasks. Ties go to the smaller id at every step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize
from .components import sorted_runs
from .vectors import binary_vectors, element_type, matrix, vector_size

SAMPLE = 8192  # rows, at most, that centroids and codebooks are fitted on
LEAST_LISTS = 64
MOST_LISTS = 4096
PROBE = 0.75  # share of the lists that a query probes; without structure in the data, 0.55 gives recall 0.9
BLOCK = 2048  # rows of a list that are scored in one step
QUERY_BLOCK = 512  # queries of a list that are scored in one step
BAND = 2.5  # standard errors of a coded inner product below the k-th best that are ranked again
PAIRS = 50_000  # exact inner products that are computed at once
LEAST_SCALE = 8  # sampled rows of a list from which its own scale is taken


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centroids; where x has fewer different rows, some are equal."""
    centre = x[rng.permutation(len(x))[:k]] if len(x) >= k else x[rng.integers(len(x), size=k)]
    centre = centre.astype(np.float64)
    for _ in range(rounds):
        own = np.argmax(x @ centre.T - (centre**2).sum(axis=1) / 2, axis=1)
        order = np.argsort(own, kind="stable")
        n = np.bincount(own, minlength=k)
        full = np.flatnonzero(n)
        centre[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0) / n[full][:, None]
    return centre


@dataclass
class Index:
    centre: np.ndarray  # lists x dim
    scale: np.ndarray  # of each list, the length that its residuals are divided by
    error: np.ndarray  # of each list, the length of what coding loses
    cuts: list[int]  # bounds of the sub-spaces
    books: list[np.ndarray]  # of each sub-space, codewords x width

    def assign(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centre.T - (self.centre**2).sum(axis=1) / 2, axis=1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = (x - self.centre[lists]) / self.scale[lists][:, None]
        out = np.empty((len(x), len(self.books)), np.uint8)
        for j, book in enumerate(self.books):
            out[:, j] = np.argmax(rest[:, self.cuts[j] : self.cuts[j + 1]] @ book.T - (book**2).sum(axis=1) / 2, axis=1)
        return out

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """For each query the n lists of the largest centroid products, the nearest first."""
        return np.argsort(-(q @ self.centre.T), axis=1, kind="stable")[:, :n]

    def reaching(self, q: np.ndarray, lists: np.ndarray, floor: np.ndarray, reach: np.ndarray) -> list[np.ndarray]:
        """Of each query's lists those that hold something (reach, their longest residual, is not
        below 0) and can come up to its floor."""
        bound = q @ self.centre.T + np.sqrt((q**2).sum(axis=1))[:, None] * np.maximum(reach, 0) * (1 + 1e-9)
        return [o[(reach[o] >= 0) & (bound[i, o] >= floor[i])] for i, o in enumerate(lists)]

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Of each sub-space, the inner products of every query with every codeword."""
        return [(q[:, self.cuts[j] : self.cuts[j + 1]] @ book.T).astype(np.float32) for j, book in enumerate(self.books)]


def fit(x: np.ndarray, lists: int, subspaces: int = 16, seed: int = 11) -> Index:
    rng = np.random.default_rng(seed)
    centre = k_means(x, lists, 10, rng)
    cuts = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int).tolist()
    own = np.argmax(x @ centre.T - (centre**2).sum(axis=1) / 2, axis=1)
    rest = x - centre[own]
    power, n = (rest**2).sum(axis=1), np.bincount(own, minlength=lists)
    whole = float(np.sqrt(power.mean())) or 1.0
    mean = np.sqrt(np.bincount(own, power, lists) / np.maximum(n, 1))
    scale = np.where((n >= LEAST_SCALE) & (mean > 1e-9 * whole), mean, whole)
    rest /= scale[own][:, None]
    words = min(256, len(x))
    index = Index(centre, scale, scale, cuts, [k_means(rest[:, a:b], words, 6, rng) for a, b in zip(cuts, cuts[1:])])
    codes = index.encode(x, own)
    lost = sum((((rest[:, a:b] - index.books[j][codes[:, j]]) ** 2).sum(axis=1) for j, (a, b) in enumerate(zip(cuts, cuts[1:]))), np.zeros(len(x))) * scale[own] ** 2
    index.error = np.where(n >= LEAST_SCALE, np.sqrt(np.bincount(own, lost, lists) / np.maximum(n, 1)), np.sqrt(lost.mean()))
    return index


def floors(q: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, own: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ids of its k best rows of the sample (ids, x; own: their lists) that lie
    in lists that it probes, and a bound that none of them is below: so much can be found. -1 and
    -inf where they are too few."""
    if len(x) <= k:
        return np.full((len(q), k), -1), np.full(len(q), -np.inf)
    near = q @ x.T
    near[query_ids[:, None] == ids[None, :]] = -np.inf
    probed = np.zeros((len(q), max(int(own.max()), int(lists.max())) + 1), bool)
    np.put_along_axis(probed, lists, True, axis=1)
    near[~probed[:, own]] = -np.inf
    best = np.argpartition(near, len(x) - k, axis=1)[:, len(x) - k :]
    least = np.take_along_axis(near, best, axis=1).min(axis=1)
    return np.where((least > -np.inf)[:, None], ids[best], -1), least - rounding(q, x)


def rounding(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each query what the order of summation can change in its inner products with rows of x."""
    return 4 * q.shape[1] * np.finfo(np.float64).eps * np.sqrt((q**2).sum(axis=1)) * np.sqrt((x**2).sum(axis=1).max(initial=0))


def search_block(index: Index, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, list_no: int, query_ids: np.ndarray, q: np.ndarray, known: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query_id, id, exact score) of each query's k best rows of the block that are not below
    its floor, and how many exact inner products were computed for them. known: ids that are not
    below it, whatever their codes say."""
    score = np.zeros((len(q), len(ids)), np.float32)
    for j, table in enumerate(index.tables(q)):
        score += table[:, codes[:, j]]
    score = score * np.float32(index.scale[list_no]) + (q @ index.centre[list_no]).astype(np.float32)[:, None]
    score[query_ids[:, None] == ids[None, :]] = -np.inf  # a query is no neighbour of its own
    least = floor.copy()
    if len(ids) > k:
        least = np.maximum(least, np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k])
    least -= BAND * np.sqrt((q**2).sum(axis=1) / q.shape[1]) * index.error[list_no] + 1e-6 * np.where(np.isfinite(least), np.abs(least), 0)
    may = (score >= least[:, None]) & (score > -np.inf)
    by_id = np.argsort(ids, kind="stable")
    at = by_id[np.minimum(np.searchsorted(ids[by_id], known), len(ids) - 1)]
    there, which = np.nonzero(ids[at] == known)
    may[there, at[there, which]] = True
    asks, rows = np.nonzero(may)
    exact = np.empty(len(asks))
    for s in range(0, len(asks), PAIRS):
        exact[s : s + PAIRS] = np.einsum("pd,pd->p", q[asks[s : s + PAIRS]], x[rows[s : s + PAIRS]].astype(np.float64))
    done = len(asks)
    high = exact >= floor[asks]  # the others are not among the k best of all
    asks, rows, exact = asks[high], rows[high], exact[high]
    order = np.lexsort((ids[rows], -exact, asks))
    asks, rows, exact = asks[order], rows[order], exact[order]
    n = np.bincount(asks, minlength=len(q))
    best = np.arange(len(asks)) - np.repeat(np.cumsum(n) - n, n) < k
    return query_ids[asks[best]], ids[rows[best]], exact[best], done


def nearest(vectors: DataFrame, query_filter: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", probe: float = PROBE, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that query_filter chooses its k rows
    of largest inner product among those found, itself left out.

    query_filter sees the id as column vec_id. Rows without an id take no part, nor do vectors
    that are null, zero, of another size than most, or hold null or non-finite components. A
    repeated row is a candidate as often as it occurs; an id that occurs twice as a query is
    answered for each of its vectors under one query_id. Equal scores go by the smaller id. An
    empty table gives an empty result; other columns are not carried, whatever their names.
    """
    spark = vectors.sparkSession
    dim, kind = vector_size(vectors, vec_col), element_type(vectors, vec_col)
    rows = binary_vectors(vectors, vec_col, {"vec_id": id_col}, dim, kind).filter("vec IS NOT NULL AND vec_id IS NOT NULL")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "vec")
    n = rows.count()
    some = rows.orderBy(F.xxhash64("vec_id"), "vec").limit(sample).collect()
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = min(MOST_LISTS, max(LEAST_LISTS, 1 << int(np.log2(n**0.5 / 4 + 1))), max(1, len(some) // 4))
    some_ids = np.array([r["vec_id"] for r in some], np.int64)
    some_x = np.frombuffer(b"".join(bytes(r["vec"]) for r in some), kind).reshape(-1, dim).astype(np.float64)
    index = fit(some_x, lists)
    shared = spark.sparkContext.broadcast((index.centre, index.scale, index.error, index.cuts, index.books))
    n_probe = max(1, int(np.ceil(probe * lists)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b["vec"], dim, kind).astype(np.float64)
                index = Index(*shared.value)
                own = index.assign(x)
                codes = index.encode(x, own)
                far = np.sqrt(((x - index.centre[own]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["vec"], pa.array(own.astype(np.int32)), pa.array(far), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "vec", "list", "far", "code"])

    coded = materialize(rows.mapInArrow(encode, "vec_id long, vec binary, list int, far double, code binary"), "ann-index")
    held = coded.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # one row a list
    blocks, reach = {r["list"]: -(-r["n"] // BLOCK) for r in held}, np.full(lists, -1.0)
    for r in held:
        reach[r["list"]] = r["far"]
    looked = spark.sparkContext.broadcast((some_ids, some_x.astype(kind), index.assign(some_x), reach))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, own, far = looked.value
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                b = whole.slice(s, 512)
                q = matrix(b["vec"], dim, kind).astype(np.float64)
                index = Index(*shared.value)
                lists = index.probes(q, n_probe)
                best, floor = floors(q, b["vec_id"].to_numpy(), ids, x.astype(np.float64), k, own, lists)
                got = index.reaching(q, lists, floor, far)
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["vec"], pa.array(floor), pa.array([r.tobytes() for r in best.astype("<i8")], pa.binary()), pa.array([g.astype(np.int32) for g in got], pa.list_(pa.int32()))], names=["vec_id", "vec", "floor", "known", "lists"])

    asked = materialize(coded.filter(query_filter).select("vec_id", "vec").distinct().mapInArrow(place, "vec_id long, vec binary, floor double, known binary, lists array<int>"), "ann-queries")
    probed = asked.select("vec_id", "vec", "floor", "known", F.explode("lists").alias("list"))
    sets = {r["list"]: -(-r["n"] // QUERY_BLOCK) for r in probed.groupBy("list").agg(F.count("*").alias("n")).collect()}

    def looked_up(found: dict[int, int]) -> Column:
        return F.element_at(F.array(*[F.lit(found.get(i, 0)) for i in range(lists)]), F.col("list") + 1)

    def every(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), count - 1))

    left = coded.withColumn("sets", looked_up(sets)).filter("sets > 0").withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), looked_up(blocks)).cast("int"))
    left = left.select("list", "block", every(F.col("sets")).alias("set"), F.lit(0).alias("role"), "vec_id", "vec", "code", F.lit(None).cast("double").alias("floor"), F.lit(None).cast("binary").alias("known"))
    right = probed.withColumn("blocks", looked_up(blocks)).filter("blocks > 0").withColumn("set", F.pmod(F.xxhash64("vec_id", "vec"), looked_up(sets)).cast("int"))
    right = right.select("list", every(F.col("blocks")).alias("block"), "set", F.lit(1).alias("role"), "vec_id", "vec", F.lit(None).cast("binary").alias("code"), "floor", "known")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(*shared.value)
        for t, group in sorted_runs(batches, ["list", "block", "set"], least=4096):
            role, ids, which = t["role"].to_numpy(), t["vec_id"].to_numpy(), t["list"].to_numpy()
            ends = np.flatnonzero(np.diff(group, append=group[-1] + 1)) + 1
            for a, b in zip([0, *ends[:-1]], ends):
                at = np.arange(a, b)
                data, asks = at[role[a:b] == 0], at[role[a:b] == 1]
                if not len(data):
                    continue
                x = matrix(t["vec"].take(pa.array(data)), dim, kind)
                codes = np.frombuffer(b"".join(t["code"].take(pa.array(data)).to_pylist()), np.uint8).reshape(len(data), -1)
                for s in range(0, len(asks), 128):
                    part = asks[s : s + 128]
                    q = matrix(t["vec"].take(pa.array(part)), dim, kind).astype(np.float64)
                    floor = t["floor"].take(pa.array(part)).to_numpy()
                    known = np.frombuffer(b"".join(t["known"].take(pa.array(part)).to_pylist()), "<i8").reshape(len(part), -1)
                    asker, found, score, _ = search_block(own, ids[data], x, codes, int(which[a]), ids[part], q, known, floor, k)
                    yield pa.RecordBatch.from_arrays([pa.array(asker), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    met = left.union(right.select(left.columns)).repartition("list", "block", "set").sortWithinPartitions("list", "block", "set")
    found = met.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
