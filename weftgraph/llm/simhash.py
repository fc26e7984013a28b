"""SimHash near-duplicates by a generalised pigeonhole join.

Fingerprints within `radius` bits agree to within t_i bits on some part i of their positions,
for any thresholds t_i >= -1 with sum(t_i) = radius - parts + 1 (a part of -1 is not probed).
Correlated bits go to the same part; thresholds are allotted by dynamic programming on the
estimated number of candidates and probes. Values within t bits of each other are met by turning
at most t // 2 bits of the one and t - t // 2 of the other. Candidates of a bucket are verified
on all positions.

Fingerprints have one lane of 64 bits (`simhash_groups`, `drop_near_duplicates`: links by radius)
or several (`drop_similar`: links by the similarity of shingle sets). In the latter, thresholds
are raised until a pair of just that similarity is missed with a probability of at most MISS;
what is met within `reach` bits is verified exactly, by the sets themselves.

Only distinct fingerprints are joined, so exact copies cost nothing. A bucket hands on a
spanning forest of its links, not its pairs; in a dense bucket few rows are compared with all. A
bucket of more than TILE rows is cut into chunks that are compared pairwise in tasks of their
own, so no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, pi, prod

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import col, materialize, tidy
from .components import Forest, connected_components, grow, sorted_runs, thinned
from .shingles import set_links, shingle_set

BITS = 64  # of a lane
LANES = 4  # of the fingerprints that find similar sets
CHECKED = 2  # of these, lanes that a candidate is tried on before its sets are
SAMPLE = 4096  # distinct fingerprints, at most, from which correlations and candidate counts are estimated
TILE = 2048  # rows of a bucket that are compared in one task; larger buckets are cut
DENSE = 512  # rows of a bucket from which on rows are asked one by one, not all pairs compared
PIECE = 1 << 16  # hashes that are unpacked to bits at once
MISS = 0.002  # probability, at most, that no part brings a pair of the least similarity together
SETS = 2048  # shingle sets, about, that are verified in one task; larger groups are cut
SET_BYTES = 32 << 20  # bytes of them
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 for a null text or one without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(found) - words + 1].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(starts), PIECE):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + PIECE], stops[k : k + PIECE])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    ones = np.flatnonzero(2 * counts > len(starts))
    return int(sum(1 << int(k) for k in ones))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words, seed) for t in b["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], pa.array(fps)], ["doc_id", "text_hash", "fp"])

    rows = docs.select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("text_hash"), col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, text_hash long, fp long")


def wide_fingerprint(hashes: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """The lanes of a set of 64-bit hashes: each takes the majority of the bits of its own mix of them."""
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes):
        counts = np.zeros(BITS, np.int64)
        for k in range(0, len(hashes), PIECE):
            h = (hashes[k : k + PIECE] ^ np.uint64(lane)) * (_MIX + np.uint64(2 * lane))
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


# -- the plan of parts and thresholds ------------------------------------------------------


def positions(fps: np.ndarray) -> np.ndarray:
    """The bits of fingerprints (rows x lanes) as numbers, rows x positions."""
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little").astype(np.float64)


def bit_parts(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Positions in `parts` groups of nearly equal size, correlated ones together."""
    width = bits.shape[1]
    x = bits - bits.mean(axis=0) if len(bits) else np.zeros((1, width))
    scale = np.sqrt((x**2).sum(axis=0))
    scale[scale == 0] = 1
    near = np.abs(x.T @ x) / np.outer(scale, scale)
    left, out = set(range(width)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        part = [min(left)]
        left.discard(part[0])
        pull = near[part[0]].copy()
        while len(part) < size:
            best = max(sorted(left), key=lambda b: pull[b])
            part.append(best)
            left.discard(best)
            pull += near[best]
        out.append(sorted(part))
    return out


def close_share(bits: np.ndarray, part: list[int], most: int) -> list[float]:
    """For t = 0..most, the share of pairs that differ in at most t bits of the part: the larger
    of what the sample shows and what independent bits would give."""
    x = bits[:, part].astype(np.float32)
    n = len(x)
    seen = np.zeros(most + 1)
    if n > 1:
        d = (x.sum(axis=1)[:, None] + x.sum(axis=1)[None, :] - 2 * (x @ x.T)).round().astype(np.int64)
        count = np.bincount(d.ravel(), minlength=most + 1)[: most + 1]
        count[0] -= n
        seen = np.cumsum(count) / (n * (n - 1))
    p = x.mean(axis=0) if n else np.full(len(part), 0.5)
    dist = np.array([1.0])
    for q in 2 * p * (1 - p):
        dist = np.convolve(dist, [1 - q, q])
    return np.maximum(seen, np.cumsum(dist)[: most + 1]).tolist()


def allot(cost: list[list[float]], most: int) -> dict[int, tuple[float, list[int]]]:
    """For each sum up to `most`, the thresholds t_i >= -1 of that sum with the least sum of cost[i][t_i + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (v, ts) in best.items():
            for t in range(-1, len(c) - 1):
                x = (v + c[t + 1], [*ts, t])
                if s + t <= most and (s + t not in new or x < new[s + t]):
                    new[s + t] = x
        best = new
    return best


def keys_of(width: int, t: int) -> int:
    """Keys by which a row is put into the buckets of a part."""
    return sum(comb(width, k) for k in range(t - t // 2 + 1))


def costs(bits: np.ndarray, groups: list[list[int]], rows: int, most: int) -> list[list[float]]:
    """Of each part, the estimated work of thresholds -1 to `most`: comparisons, and rows that are
    shuffled and sorted, each about 20 times a comparison."""
    out = []
    for g in groups:
        share = close_share(bits, g, most)
        out.append([0.0] + [rows * rows / 2.0 * share[t] + 20.0 * rows * keys_of(len(g), t) for t in range(most + 1)])
    return out


def plan(sample: np.ndarray, rows: int, radius: int) -> list[tuple[list[int], int]]:
    """[(positions, threshold)] of least estimated work for `rows` distinct fingerprints, such
    that all pairs within radius meet."""
    bits = positions(sample.reshape(len(sample), -1)) if len(sample) else np.zeros((0, BITS))
    found = []
    for parts in range(2, 9):
        groups = bit_parts(bits, parts)
        need = radius - parts + 1
        if need >= -parts:
            found.append((*allot(costs(bits[:2048], groups, rows, radius), radius)[need], groups))
    _, ts, groups = min(found, key=lambda x: x[0])
    return [(g, t) for g, t in zip(groups, ts) if t >= 0]


def bit_difference(similarity: float) -> float:
    """The share of bits in which fingerprints of sets (of equal size) of a Jaccard similarity differ."""
    return acos(2 * similarity / (1 + similarity)) / pi


def missed(widths: list[int], thresholds: list[int], p: float) -> float:
    """The probability that bits which differ with probability p are in no part within its threshold."""
    return prod(1 - sum(comb(w, k) * p**k * (1 - p) ** (w - k) for k in range(t + 1)) for w, t in zip(widths, thresholds))


def plan_similar(sample: np.ndarray, rows: int, similarity: float, lanes: int = LANES) -> list[tuple[list[int], int]]:
    """[(positions, threshold)] of least estimated work, such that a pair of just the similarity
    is missed with a probability of at most MISS; the more alike a pair, the less."""
    width = BITS * lanes
    bits = positions(sample.reshape(len(sample), lanes))[:1024] if len(sample) else np.zeros((0, width))
    p = bit_difference(similarity)
    found = []
    for parts in (8, 10, 12, 14, 16):
        groups = bit_parts(bits, parts)
        widths = [len(g) for g in groups]
        table = allot(costs(bits, groups, rows, 4), 4 * parts)
        good = [(*table[s], groups) for s in sorted(table) if missed(widths, table[s][1], p) <= MISS]
        found += good
    _, ts, groups = min(found, key=lambda x: x[0])
    return [(g, t) for g, t in zip(groups, ts) if t >= 0]


# -- buckets -------------------------------------------------------------------------------


def gather(fps: np.ndarray, part: list[int]) -> np.ndarray:
    """The bits of a part of fingerprints (rows x lanes), as numbers."""
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(part):
        out |= ((fps[:, b // BITS] >> np.uint64(b % BITS)) & np.uint64(1)) << np.uint64(k)
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def close_links(group: np.ndarray, fps: np.ndarray, role: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of rows of one group within radius. Pairs of rows that both
    came by more than half of the turned bits meet elsewhere too, and may be left out."""
    forest, n = Forest(len(fps)), len(fps)
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    dense = np.zeros(n, bool)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= DENSE:
            dense[a:b] = True
            x = fps[a:b]
            forest.add(np.arange(a, b), a + grow(b - a, lambda i: distance(x[i], x) <= radius))
    at, lag = np.flatnonzero(~dense), 1
    while True:
        at = at[: np.searchsorted(at, n - lag)]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            return forest.star()
        d = distance(fps[at], fps[at + lag])
        hit = at[(d <= radius) & (d > 0) & ((role[at] == 0) | (role[at + lag] == 0))]
        forest.add(hit, hit + lag)
        lag += 1


def links_by_plan(distinct: DataFrame, chosen: list[tuple[list[int], int]], radius: int, lanes: int, checked: int = 1) -> DataFrame:
    """Links (a, b) between nodes that meet in a bucket of the plan and whose first `checked`
    lanes are within radius.

    distinct: node (long) and the lanes of its fingerprint as long columns f0, f1, ...
    """
    every = [f"f{k}" for k in range(lanes)]
    names = every[:checked]

    def stacked(b: pa.RecordBatch | pa.Table, columns: list[str]) -> np.ndarray:
        return np.stack([b[c].to_numpy().view(np.uint64) for c in columns], axis=1)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 4096):
                b = whole.slice(s, 4096)
                fps = stacked(b, every)
                for k, (part, t) in enumerate(chosen):
                    value = gather(fps, part)
                    for flips in range(t - t // 2 + 1):
                        role = pa.array(np.full(len(fps), int(flips > t // 2), np.int32))
                        for bits in combinations(range(len(part)), flips):
                            mask = np.uint64(sum(1 << x for x in bits))
                            key = ((value ^ mask) | np.uint64(k << 56)).view(np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(key), b["node"], *(b[c] for c in names), role], ["key", "node", *names, "role"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in sorted_runs(batches, ["key", "i", "j"]):
            node = t["node"].to_numpy()
            a, b = close_links(group, stacked(t, names), t["role"].to_numpy(), radius)
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    # Parts of more than 56 positions, whose keys would not fit, are in no plan.
    probes = distinct.select("node", *every).mapInArrow(tidy(probe), "key long, node long, " + "".join(f"{c} long, " for c in names) + "role int")
    large = probes.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > TILE)
    chunks = F.ceil(F.coalesce("n", F.lit(1)) / TILE).cast("int")
    tiled = probes.join(large, "key", "left").withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiled = tiled.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", *names, "role")
    return tiled.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(tidy(verify), "a long, b long")


def near_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) that join the same fingerprints as all pairs within radius.

    distinct: one long column fp without repeats.
    """
    rows = distinct.count()
    sample = [r["fp"] for r in distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()]
    chosen = plan(np.array(sample, np.int64).view(np.uint64), rows, radius)
    return links_by_plan(distinct.select(F.col("fp").alias("node"), F.col("fp").alias("f0")), chosen, radius, 1)


def _placed(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprinted rows, and for each fingerprint its component's root and the first row
    (by id, rows without one last) of those that have it."""
    own = materialize(fingerprints(docs, id_col, text_col, words), "simhash")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash")))
    distinct = materialize(own.groupBy("fp").agg(low.alias("low")), "simhash-distinct")
    roots = connected_components(near_links(distinct, radius))
    return own, distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row of docs.

    Rows link if their fingerprints differ in at most `radius` bits; component_id is the
    smallest doc_id reachable (null if a component has only null ids). Null and empty texts
    have fingerprint zero and link like others. Repeated rows stay, each with its component.
    An empty table gives an empty result; other columns are not carried.
    """
    own, placed = _placed(docs, id_col, text_col, words, radius)
    lows = placed.groupBy("root").agg(F.min("low").getField("doc_id").alias("component_id"))
    named = placed.select("fp", "root").join(lows, "root").select(F.col("fp").alias("named_fp"), "component_id")
    out = own.join(named, F.col("fp") == F.col("named_fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, placed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that are the first of their root; placed: root and low (none, doc_id, text_hash)."""
    first = placed.groupBy("root").agg(F.min("low").alias("low"))
    first = materialize(first.select(F.col("low.doc_id").alias("__first_id"), F.col("low.text_hash").alias("__first_hash")), "simhash-first")
    hashed = docs.withColumn("__text_hash", F.xxhash64(col(text_col)))
    kept = hashed.join(first, (F.col("__text_hash") == F.col("__first_hash")) & col(id_col).eqNullSafe(F.col("__first_id")), "left_semi")
    return kept.dropDuplicates(["__text_hash", id_col]).select(*[col(c) for c in docs.columns])


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """The rows of docs, with all their columns, of which one of each component stays: the one
    with the smallest id (one without an id only if no other is there). Of repeated rows one
    stays. Null and empty texts are one component."""
    _, placed = _placed(docs, id_col, text_col, words, radius)
    return keep_first(docs, placed, id_col, text_col)


# -- similar shingle sets ------------------------------------------------------------------


def similar_links(distinct: DataFrame, similarity: float, lanes: int = LANES) -> DataFrame:
    """Links between nodes whose fingerprints let them be of the similarity (four standard
    deviations are allowed for). distinct: as for links_by_plan."""
    names = [f"f{k}" for k in range(lanes)]
    rows = distinct.count()
    some = distinct.orderBy(F.xxhash64("node")).limit(SAMPLE).select(*names).collect()
    sample = np.array([list(r) for r in some], np.int64).reshape(-1, lanes).view(np.uint64)
    return links_by_plan(distinct, plan_similar(sample, rows, similarity, lanes), reach_of(similarity, CHECKED), lanes, CHECKED)


def reach_of(similarity: float, lanes: int) -> int:
    """The bits in which fingerprints of the similarity differ, and four standard deviations more."""
    p, width = bit_difference(similarity), BITS * lanes
    return ceil(width * p + 4 * (width * p * (1 - p)) ** 0.5)


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, of which one of each component stays: the one
    with the smallest id (one without an id only if no other is there).

    Rows link if the Jaccard similarity of their sets of `words`-word shingles is at least
    `similarity` (0.5 or more) and the pigeonhole join of their fingerprints brings them
    together, which it fails to do with a probability of MISS at that similarity and less above.
    No pair below it links. Of repeated rows one stays. Null texts and those without words are
    one component; very long texts count whole. An empty table gives an empty result; other
    columns are carried, whatever their names.
    """
    if not 0.5 <= similarity <= 1:
        raise ValueError("similarity: 0.5 to 1")
    lanes = [f"f{k}" for k in range(LANES)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, fps, sizes = np.zeros(b.num_rows, np.uint64), np.zeros((b.num_rows, LANES), np.uint64), np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(b["text"]):
                s = shingle_set(t.as_py(), words)
                if len(s):
                    nodes[i], fps[i], sizes[i] = xxhash.xxh64_intdigest(s.tobytes()), wide_fingerprint(s), len(s)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], pa.array(nodes.view(np.int64)), *(pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(LANES)), pa.array(sizes)], ["doc_id", "text_hash", "node", *lanes, "size"])

    rows = docs.select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("text_hash"), col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    own = materialize(rows.mapInArrow(tidy(sign), f"doc_id {kind}, text_hash long, node long, " + "".join(f"{c} long, " for c in lanes) + "size long"), "shingles")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash")))
    distinct = materialize(own.groupBy("node").agg(low.alias("low"), F.first("size").alias("size"), *[F.first(c).alias(c) for c in lanes]), "shingles-distinct")
    near = connected_components(thinned(similar_links(distinct.filter("size > 0"), similarity)))
    groups = materialize(near.union(near.select(F.col("root").alias("node"), "root").distinct()), "shingles-groups")

    # One text of each set that is in a group, as a set again.
    first = distinct.join(groups, "node").select("node", "root", *lanes, F.col("low.doc_id").alias("first_id"), F.col("low.text_hash").alias("first_hash"))
    asked = rows.join(first, (F.col("text_hash") == F.col("first_hash")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", "root", *lanes, "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([shingle_set(t.as_py(), words).tobytes() for t in part["text"]], pa.binary())], ["node", "root", *lanes, "hashes"])

    sets = materialize(asked.dropDuplicates(["node"]).mapInArrow(tidy(cut), "node long, root long, " + "".join(f"{c} long, " for c in lanes) + "hashes binary"), "shingles-sets")
    sizes = sets.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / SETS, F.sum(F.length("hashes")) / SET_BYTES)).cast("int").alias("chunks"))
    tiled = sets.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiled = tiled.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", *lanes, "hashes")
    reach = reach_of(similarity, LANES)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in sorted_runs(batches, ["root", "i", "j"], least=512):
            node, fps = t["node"].to_numpy(), np.stack([t[c].to_numpy().view(np.uint64) for c in lanes], axis=1)
            forest = Forest(len(node))
            edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1)).tolist()
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a > 1:
                    held = [np.frombuffer(h.as_buffer(), np.uint64) for h in t["hashes"].slice(a, b - a)]
                    x = fps[a:b]
                    forest.add(np.arange(a, b), a + set_links(held, similarity, lambda i: distance(x[i], x) <= reach))
            x, y = forest.star()
            yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], ["a", "b"])

    met = tiled.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    roots = connected_components(met.mapInArrow(tidy(verify), "a long, b long")).withColumnRenamed("node", "member")
    placed = distinct.join(roots, F.col("node") == F.col("member"), "left").select("low", F.coalesce("root", "node").alias("root"))
    return keep_first(docs, placed, id_col, text_col)
