"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors u, v of cosine c or more have |u - v|^2 <= 2 - 2c. After a rotation the components
are split into blocks; if every block had more than its proportional share of that squared
distance the whole would be larger, so each pair is within the share of at least one block. Each
block is range-joined: rows are put into leaves by halving them along their widest component, and
a leaf is compared with the rows that its bounding box lets be within the share. Candidates are
verified by their cosine on the original vectors.

Rows of a label travel once, to one task that joins all blocks, where LOCAL rows or fewer have
it. A larger label is cut for each block along some of the block's components; a row that is
nearer to the lower bound of its cell than the block's radius goes to the cell below, too. Cells
of more than LOCAL rows are cut into chunks that are compared pairwise in tasks of their own.

A pair is counted in the first block within whose share it is, and in one cell of it, so links
can be counted without listing them: a task returns each vector's number of partners and a
spanning forest of its links. Equal vectors of a label are joined once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize
from .components import Forest, connected_components, sorted_runs
from .vectors import binary_vectors, element_type, matrix, vector_size

BLOCK_WIDTH = 8  # components of a block
LOCAL = 16_384  # rows that are joined in one task (of 64 components; of longer vectors fewer)
LEAF = 32  # rows of a leaf
SLACK = 1e-6  # of squared distances, above what rounding can add
PAIRS = 40_000  # candidate pairs that are verified at once


def level(x: np.ndarray) -> np.ndarray:
    """Vectors as doubles, each scaled by a power of two so that squares neither vanish nor overflow."""
    x = x.astype(np.float64)
    _, e = np.frexp(np.abs(x).max(axis=1, initial=0))
    return np.ldexp(np.ldexp(x, -(e // 2)[:, None]), -(e - e // 2)[:, None])


def rotate(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Unit vectors, rotated: twice random signs and a Walsh-Hadamard transform.

    Only sums and differences of components, in a fixed order: a vector's result doesn't depend
    on what else is in the batch.
    """
    x = level(x)
    size = 1 << max(3, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x / np.sqrt((x**2).sum(axis=1))[:, None]
    rng = np.random.default_rng(seed)
    for _ in range(2):
        y *= rng.choice([-1.0, 1.0], size)
        step = 1
        while step < size:
            z = y.reshape(len(y), -1, 2, step)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(y), size)
            step *= 2
        y /= np.sqrt(size)
    return y


def budget(cosine: float, blocks: int) -> float:
    return (2 - 2 * cosine) / blocks + SLACK


def leaves(z: np.ndarray, most: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows in which leaves of at most `most` rows are adjacent, and their bounds."""
    open_, done = [np.arange(len(z))], []
    while open_:
        rows = open_.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        part = z[rows]
        half = len(rows) // 2
        cut = np.argpartition(part[:, np.argmax(part.max(axis=0) - part.min(axis=0))], half)
        open_ += [rows[cut[half:]], rows[cut[:half]]]
    return np.concatenate(done), np.cumsum([0, *map(len, done)])


def range_join(z: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The pairs of rows within the squared distance `limit`, each once, as (rows, rows, number of
    distances that were computed for them)."""
    order, bounds = leaves(z)
    z = z[order]
    norm = (z**2).sum(axis=1)
    low, high = np.minimum.reduceat(z, bounds[:-1]), np.maximum.reduceat(z, bounds[:-1])
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        gap = np.maximum(np.maximum(low[k:] - high[k], low[k] - high[k:]), 0)
        near = (gap**2).sum(axis=1) <= limit
        at = a + np.flatnonzero(np.repeat(near, np.diff(bounds[k:])))
        gap = np.maximum(np.maximum(z[at] - high[k], low[k] - z[at]), 0)
        at = at[(gap**2).sum(axis=1) <= limit]
        i, j = np.nonzero(norm[a:b, None] + norm[None, at] - 2 * (z[a:b] @ z[at].T) <= limit)
        i, j = a + i, at[j]
        ahead = j > i
        yield order[i[ahead]], order[j[ahead]], (b - a) * len(at)


def join_cell(blocks: range, share: float, cosine: float, chunk: np.ndarray | None, mask: np.ndarray, mult: np.ndarray, x: np.ndarray, y: np.ndarray, forest: Forest, counts: np.ndarray, at: int) -> int:
    """Links of one cell: adds them to forest and counts at the rows from `at` on. Returns how
    many block distances were computed.

    Of rows that came from a cell above along one component, a pair counts there; with chunks
    only pairs of different ones count.
    """
    u = level(x)
    u /= np.sqrt((u**2).sum(axis=1))[:, None]
    done = 0
    for block in blocks:
        for i, j, n in range_join(y[:, block * BLOCK_WIDTH : (block + 1) * BLOCK_WIDTH], share):
            done += n
            ok = (mask[i] & mask[j]) == 0
            if chunk is not None:
                ok &= chunk[i] != chunk[j]
            i, j = i[ok], j[ok]
            for p in range(0, len(i), PAIRS):
                a, b = i[p : p + PAIRS], j[p : p + PAIRS]
                for other in range(block):
                    part = slice(other * BLOCK_WIDTH, (other + 1) * BLOCK_WIDTH)
                    first = ((y[a, part] - y[b, part]) ** 2).sum(axis=1) > share
                    a, b = a[first], b[first]
                linked = np.einsum("pd,pd->p", u[a], u[b]) >= cosine
                a, b = a[linked], b[linked]
                forest.add(at + a, at + b)
                counts += np.bincount(at + a, mult[b], len(counts)).astype(np.int64) + np.bincount(at + b, mult[a], len(counts)).astype(np.int64)
    return done


def cells_of(y: np.ndarray, block: int, cuts: int, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, cells, masks) of rows cut along the first `cuts` components of a block. A mask has a
    bit for each component along which the row is in the cell below its own."""
    width = 3 * radius
    part = y[:, block * BLOCK_WIDTH : block * BLOCK_WIDTH + cuts]
    home = np.floor(part / width)
    low = part - home * width <= radius * (1 + 1e-9)
    for m in range(1 << cuts):
        down = np.array([m >> c & 1 for c in range(cuts)], bool)
        rows = np.flatnonzero(low[:, down].all(axis=1))
        if len(rows):
            yield rows, (home[rows] - down).astype(np.int64), np.full(len(rows), m, np.int32)


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id, kept, one row per row.

    Rows link if their labels are equal and not null (label_col None: always) and the cosine of
    their vectors is at least `cosine`. Vectors that are null, zero, of another size than most,
    or hold null or non-finite components link with nothing, nor do rows without an id; such a
    row is its own component. component_id is the smallest id reachable; kept: whether that is
    the row's own id (true for rows without an id). A repeated row links with its copies; rows of
    one id with other vectors or labels are rows of their own, each in its own component. An
    empty table gives an empty result; other columns are not carried, whatever their names.
    """
    spark = vectors.sparkSession
    dim, kind = vector_size(vectors, vec_col), element_type(vectors, vec_col)
    names = {"vec_id": id_col} | ({"label": label_col} if label_col else {})
    rows = binary_vectors(vectors, vec_col, names, dim, kind)
    if not label_col:
        rows = rows.withColumn("label", F.lit(0))
    vec = F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.col("vec"))
    rows = materialize(rows.withColumn("vec", vec).withColumn("digest", F.unhex(F.md5("vec"))), "near-rows")
    # A node is a vector of a label: its own number, the smallest id that has it, and how many rows do.
    nodes = rows.filter("vec IS NOT NULL").groupBy("label", "digest").agg(F.first("vec").alias("vec"), F.min("vec_id").alias("low"), F.count("*").alias("mult"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    size = 1 << max(3, (dim - 1).bit_length()) if dim else 8
    blocks = size // BLOCK_WIDTH
    share = budget(cosine, blocks)
    most = max(64, LOCAL * 64 // max(64, size))
    held = nodes.groupBy("label").agg(F.count("*").alias("rows"))
    placed = nodes.join(held, "label").select(F.xxhash64("label").alias("group"), "node", "mult", "vec", F.least(F.lit(BLOCK_WIDTH), F.ceil(F.log2(F.col("rows") / most))).cast("int").alias("cuts"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ["group", "block", "cell", "mask", "node", "mult", "vec"]
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                b = whole.slice(s, 1024)
                cuts, group = b["cuts"].to_numpy(), b["group"].to_numpy()
                at = np.flatnonzero(cuts <= 0)
                if len(at):
                    some = b.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([some["group"], pa.array(np.full(len(at), -1, np.int32)), some["group"], pa.array(np.zeros(len(at), np.int32)), some["node"], some["mult"], some["vec"]], names=out)
                for c in np.unique(cuts[cuts > 0]).tolist():
                    own = np.flatnonzero(cuts == c)
                    y = rotate(matrix(b["vec"].take(pa.array(own)), dim, kind))
                    for k in range(blocks):
                        for at, cell, mask in cells_of(y, k, c, share**0.5):
                            key = group[own[at]].view(np.uint64) ^ np.uint64(k)
                            for part in cell.T:  # two cells of one key are only compared in vain
                                key = (key ^ part.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                                key ^= key >> np.uint64(29)
                            some = b.take(pa.array(own[at]))
                            yield pa.RecordBatch.from_arrays([some["group"], pa.array(np.full(len(at), k, np.int32)), pa.array(key.view(np.int64)), pa.array(mask), some["node"], some["mult"], some["vec"]], names=out)

    cells = placed.mapInArrow(spread, "group long, block int, cell long, mask int, node long, mult long, vec binary")
    if nodes.count() > most:  # else no cell is that large
        large = cells.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > most)
        cells = cells.join(large, "cell", "left").withColumn("chunks", F.ceil(F.coalesce("n", F.lit(1)) / most).cast("int"))
    else:
        cells = cells.withColumn("chunks", F.lit(1))
    tiled = cells.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiled = tiled.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "block", "group", "own", "mask", "node", "mult", "vec")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in sorted_runs(batches, ["cell", "block", "group", "i", "j"], least=4096):
            node, mult, mask = t["node"].to_numpy(), t["mult"].to_numpy(), t["mask"].to_numpy()
            own, i, j, block = t["own"].to_numpy(), t["i"].to_numpy(), t["j"].to_numpy(), t["block"].to_numpy()
            forest, counts = Forest(len(node)), np.zeros(len(node), np.int64)
            ends = np.flatnonzero(np.diff(group, append=group[-1] + 1)) + 1
            for a, b in zip([0, *ends[:-1]], ends):
                if b - a > 1:
                    x = matrix(t["vec"].slice(a, b - a), dim, kind)
                    which = range(blocks) if block[a] < 0 else range(int(block[a]), int(block[a]) + 1)
                    join_cell(which, share, cosine, own[a:b] if i[a] != j[a] else None, mask[a:b], mult[a:b], x, rotate(x), forest, counts, a)
            low, high = forest.star()
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[low], node[some]])), pa.array(np.concatenate([node[high], np.zeros(len(some), np.int64)])), pa.array(np.concatenate([np.zeros(len(low), np.int64), counts[some]]))], names=["a", "b", "n"])

    met = tiled.repartition("cell", "i", "j").sortWithinPartitions("cell", "block", "group", "i", "j")
    found = materialize(met.mapInArrow(join, "a long, b long, n long"), "near-found")
    roots = connected_components(found.filter("n = 0").select("a", "b")).withColumnRenamed("node", "member")
    links = found.filter("n > 0").groupBy("a").agg(F.sum("n").alias("others"))
    named = nodes.drop("vec").join(links, F.col("node") == F.col("a"), "left").join(roots, F.col("node") == F.col("member"), "left")
    named = materialize(named.select("label", "digest", "low", (F.col("mult") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("root", "node").alias("root")), "near-named")
    discard(spark, nodes, found)
    tops = named.groupBy("root").agg(F.min("low").alias("top"))
    named = named.join(tops, "root").select(F.col("label").alias("l"), F.col("digest").alias("d"), "links", "top")
    out = rows.select("vec_id", "label", "digest").join(named, (F.col("label") == F.col("l")) & (F.col("digest") == F.col("d")), "left")
    top = F.coalesce("top", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), top.alias("component_id"), top.eqNullSafe(F.col("vec_id")).alias("kept"))
