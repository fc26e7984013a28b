"""Stupid-backoff language-model scores, computed relationally.

    S(w | v) = c(v w) / c(v) if the pair is in the table, else backoff * c(w) / N

and c(w) / N for the first word; a word that the table lacks counts `unseen` times. Words are
runs of other characters than ASCII white space, with A-Z lower-cased. The score of a document
is the sum of ln S over its words.

Texts are cut into chunks of some CHUNK words (a longer document is a chunk of its own). A chunk
explodes into its distinct n-grams (a 64-bit hash each) and their numbers, one row for each hash
partition, whose n-grams stand in an array. So an n-gram that every document holds comes once a
chunk: it is counted before its shuffle, and no partition is hot. Partitions are as many as it
takes to hold about ENTRIES n-grams each; one sums its n-grams to its part of the count table,
joins the table to what came and sends each row the counts back, in the order of the row's
n-grams. A chunk meets its word and pair counts by its number and sums ln S for each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import col, discard, materialize

CHUNK = 200_000  # words of a chunk
ENTRIES = 1_000_000  # n-grams of chunks that meet in one partition


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = v * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(31)))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def chunks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Chunks of documents: their ids and sizes in words, the hashes of their distinct words, and
    for each word in its place (at: little-endian unsigned numbers of 2 or 4 bytes) which it is."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    field = rows.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[np.ndarray] = []
            start = total = 0
            for i in range(b.num_rows):
                found = words_of(b["text"][i].as_py())
                held.append(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))
                total += len(found)
                if total >= CHUNK or i == b.num_rows - 1:
                    words, at = np.unique(np.concatenate(held), return_inverse=True)
                    ids = pa.ListArray.from_arrays(pa.array([0, i + 1 - start], pa.int32()), b["doc_id"].slice(start, i + 1 - start))
                    at = at.astype("<u2" if len(words) <= 1 << 16 else "<u4").tobytes()
                    yield pa.RecordBatch.from_arrays([ids, pa.array([[len(h) for h in held]], pa.list_(pa.int64())), pa.array([words.view(np.int64)], pa.list_(pa.int64())), pa.array([at], pa.binary())], names=["ids", "sizes", "words", "at"])
                    held, start, total = [], i + 1, 0

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("ids", T.ArrayType(field.dataType)), T.StructField("sizes", longs), T.StructField("words", longs), T.StructField("at", T.BinaryType())])
    return rows.mapInArrow(run, schema).withColumn("chunk", F.monotonically_increasing_id())


class Chunk:
    """A chunk's words in their places, and the places of its pairs' first words."""

    def __init__(self, words: np.ndarray, at: bytes, sizes: np.ndarray):
        self.words = words.view(np.uint64)
        self.at = np.frombuffer(at, "<u2" if len(words) <= 1 << 16 else "<u4").astype(np.int64)
        self.sizes = sizes
        self.ends = np.cumsum(sizes)
        inner = np.ones(len(self.at), bool)
        inner[self.ends[sizes > 0] - 1] = False
        self.first = np.flatnonzero(inner)

    def ngrams(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted distinct n-grams of an order, which of them stands where, and their numbers."""
        if order == 1:
            return self.words, self.at, np.bincount(self.at, minlength=len(self.words))
        hashes = self.words[self.at]
        key, which = np.unique(pair_hash(hashes[self.first], hashes[self.first + 1]), return_inverse=True)
        return key, which, np.bincount(which, minlength=len(key))


def by_partition(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of n-grams by partition, and the number of each partition's."""
    part = ((key >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    return np.argsort(part, kind="stable"), np.bincount(part, minlength=parts)


def exploded(chunks: DataFrame, order: int, parts: int, counted: bool, asking: bool) -> DataFrame:
    """part, chunk (null unless asking), keys and their numbers (0 unless counted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                own = Chunk(b["words"][i].values.to_numpy(), b["at"][i].as_py(), b["sizes"][i].values.to_numpy())
                key, _, n = own.ngrams(order)
                at, size = by_partition(key, parts)
                some = np.flatnonzero(size)
                bounds = pa.array(np.concatenate([[0], np.cumsum(size[some])]).astype(np.int32))
                which = pa.array(np.full(len(some), b["chunk"][i].as_py()), mask=np.full(len(some), not asking))
                n = n[at] if counted else np.zeros(len(at), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(some), which, pa.ListArray.from_arrays(bounds, pa.array(key[at].view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(n))], names=["part", "chunk", "keys", "n"])

    return chunks.select("chunk", "sizes", "words", "at").mapInArrow(run, "part long, chunk long, keys array<long>, n array<long>")


def answer(order: int) -> Callable[[pa.Table], pa.Table]:
    """Of one partition's rows: each asking row with the counts of its n-grams."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        keys, n = (pc.list_flatten(t[c]).to_numpy() for c in ("keys", "n"))
        which = np.unique(keys, return_inverse=True)[1]
        total = np.bincount(which, n).astype(np.int64)  # exact below 2^53
        size = pc.list_value_length(t["keys"]).to_numpy()
        ends = np.cumsum(size)
        asks = np.flatnonzero(t["chunk"].is_valid().to_numpy())
        taken = np.repeat(t["chunk"].is_valid().to_numpy(), size)
        bounds = np.concatenate([[0], np.cumsum(size[asks])]).astype(np.int32)
        assert ends[-1:].sum() == len(keys)
        counts = pa.ListArray.from_arrays(pa.array(bounds), pa.array(total[which[taken]]))
        return pa.table([pa.array(np.full(len(asks), order, np.int32)), t["part"].take(pa.array(asks)), t["chunk"].take(pa.array(asks)), counts], names=["order", "part", "chunk", "counts"])

    return run


def chunk_scores(own: Chunk, words: np.ndarray, pairs: np.ndarray, which: np.ndarray, total: float, backoff: float, min_count: int, unseen: float) -> np.ndarray:
    """The sum of ln S over each document of a chunk. words, pairs: counts of its distinct n-grams."""
    ln_word = np.log(np.where(words > 0, words, unseen))
    v, w = own.at[own.first], own.at[own.first + 1]
    c = pairs[which]
    known = np.log(np.maximum(c, 1)) - ln_word[v]
    each = np.zeros(len(own.at))
    each[own.first + 1] = np.where(c >= min_count, known, np.log(backoff) + ln_word[w] - np.log(total))
    starts = (own.ends - own.sizes)[own.sizes > 0]
    each[starts] = ln_word[own.at[starts]] - np.log(total)
    doc = np.repeat(np.arange(len(own.sizes)), own.sizes)
    return np.bincount(doc, each, len(own.sizes))


def score_documents(docs: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", backoff: float = 0.4, min_count: int = 1, unseen: float = 1.0) -> DataFrame:
    """doc_id, n_words, log_score (sum of ln S) and mean_log_score for each id of docs.

    corpus: the documents that are counted, by default docs themselves, all of them. Pairs that
    occur less than min_count times (1 or more) there are not in the table. Null and empty texts
    have no words, log_score 0 and a null mean; very long texts count whole. Rows of one id (null
    is one), repeated ones among them, are parts of one document, each with a first word of its
    own. An empty table gives an empty result; other columns are not carried, whatever their names.
    """
    spark = docs.sparkSession
    asking = materialize(chunks_of(docs, id_col, text_col), "lm-chunks")
    counted = asking if corpus is None else materialize(chunks_of(corpus, id_col, text_col), "lm-corpus")
    sized = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    total = float(counted.agg(F.sum(sized)).first()[0] or 1)
    most = total if corpus is None else total + float(asking.agg(F.sum(sized)).first()[0] or 0)
    words = (counted if corpus is None else counted.select("words").union(asking.select("words"))).agg(F.sum(F.size("words"))).first()[0] or 0
    answers = []
    for order, entries in ((1, words), (2, most)):
        parts = 1 + int(entries // ENTRIES)
        rows = exploded(counted, order, parts, True, corpus is None)
        if corpus is not None:
            rows = rows.union(exploded(asking, order, parts, False, True))
        answers.append(materialize(rows.groupBy("part").applyInArrow(answer(order), "order int, part long, chunk long, counts array<long>"), f"lm-counts-{order}"))

    kind = asking.schema["ids"].dataType.elementType.simpleString()
    arrow_kind = T.StructType([T.StructField("doc_id", asking.schema["ids"].dataType.elementType)])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        out: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        for i in range(left.num_rows):
            own = Chunk(left["words"][i].values.to_numpy(), left["at"][i].as_py(), left["sizes"][i].values.to_numpy())
            found = []
            for order in (1, 2):
                key, which, _ = own.ngrams(order)
                got = right.filter(pc.equal(right["order"], order)).sort_by("part")
                at, size = by_partition(key, 1 + int((words, most)[order - 1] // ENTRIES))
                counts = np.empty(len(key), np.int64)
                counts[at] = pc.list_flatten(got["counts"]).to_numpy()
                found += [counts, which]
            ln = chunk_scores(own, found[0], found[2], found[3], total, backoff, min_count, unseen)
            out.append((left["ids"][i].values, own.sizes, ln))
        schema = to_arrow_schema(arrow_kind).append(pa.field("n", pa.int64())).append(pa.field("s", pa.float64()))
        return pa.table([pa.chunked_array([o[0] for o in out], schema[0].type), pa.chunked_array([pa.array(o[1], pa.int64()) for o in out], pa.int64()), pa.chunked_array([pa.array(o[2], pa.float64()) for o in out], pa.float64())], schema=schema)

    both = answers[0].union(answers[1])
    scored = asking.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(score, f"doc_id {kind}, n long, s double")
    scored = materialize(scored, "lm-scores")
    discard(spark, asking, *answers, *([] if corpus is None else [counted]))
    out = scored.groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.sum("s").alias("log_score"))
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
