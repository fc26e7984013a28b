"""Toxicity scores: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its hashed character n-grams and of the word itself. The
distinct words of a document stand in the order of their first occurrence (so that a word that
is repeated a hundred times weighs no more than once); a window of them is the mean of its words; a linear softmax over that gives the window's
probability, and a document scores as its worst window. Vectors and softmax are trained jointly
in numpy on a bounded sample of labelled documents. A misspelling or an ending that was never
seen shares most n-grams with what was.

Because everything before the softmax is a mean, a trained model reduces to one number per
n-gram, so scoring is a sum per word and a running sum per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import col, materialize, tidy

WORD = re.compile(r"\w+")
GRAMS = (3, 4, 5)
BUCKET_BITS = 17
DIM = 8
WINDOW = 32
STRIDE = 16
LEAST = 16  # a window of fewer words is averaged as if neutral words filled it up to so many
GAIN = 30.0  # of the softmax over means, so that one word of a window can tip it
SAMPLE_PER_CLASS = 3000  # labelled documents of each class that training takes, at most
SAMPLE_CHARS = 32_000_000  # characters of them, at most
EPOCHS = 20
CACHE = 400_000  # words whose scores a task keeps at hand
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """The distinct words of the whole text, by first occurrence."""
    return list(dict.fromkeys(WORD.findall((text or "").lower())))


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams in word order, and where each word's begin (n + 1 offsets)."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    owners, hashes = [], []
    for n in GRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(1_000_003) + codes[k : len(codes) - n + 1 + k]
        ok = owner[: len(h)] == owner[n - 1 :]
        owners.append(owner[: len(h)][ok])
        hashes.append(h[ok])
    if len(words):
        starts = np.cumsum(sizes) - sizes
        place = (np.arange(len(codes)) - np.repeat(starts, sizes)).astype(np.uint64)
        whole = (codes + np.uint64(7)) * (_MIX ^ (place * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1))
        owners.append(np.arange(len(words)))
        hashes.append(np.add.reduceat(whole, starts))
    if not owners:
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    own, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(own, kind="stable")
    h = h ^ (h >> np.uint64(29))
    bucket = ((h * _MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    return bucket[order], np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(words)))])


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of the runs starts[k] .. starts[k] + sizes[k], one run after the other."""
    if not len(sizes):
        return np.empty(0, np.int64)
    first = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - first, sizes)


def window_bounds(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows over n words: all words are covered; no words, no window."""
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
    return starts, np.minimum(starts + WINDOW, n)


class Model:
    """gram: each n-gram bucket's share in the logit; bias."""

    def __init__(self, gram: np.ndarray, bias: float):
        self.gram, self.bias = gram, bias

    def word_scores(self, words: list[str]) -> np.ndarray:
        bucket, offsets = word_grams(words)
        if not len(words):
            return np.empty(0)
        return np.add.reduceat(self.gram[bucket], offsets[:-1]) / np.diff(offsets)

    def score(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        tokens = [words_of(t) for t in texts]
        fresh = list({w for ws in tokens for w in ws if w not in cache})
        own = cache
        if len(cache) + len(fresh) > CACHE:
            cache.clear()
            fresh = list({w for ws in tokens for w in ws})
            own = {} if len(fresh) > CACHE else cache
        for k in range(0, len(fresh), 10_000):
            own.update(zip(fresh[k : k + 10_000], self.word_scores(fresh[k : k + 10_000]).tolist()))
        out = np.empty(len(texts))
        for i, ws in enumerate(tokens):
            total = np.concatenate([[0.0], np.cumsum(np.fromiter(map(own.__getitem__, ws), np.float64, len(ws)))])
            a, b = window_bounds(len(ws))
            worst = float(((total[b] - total[a]) / np.maximum(b - a, LEAST)).max()) if len(a) else 0.0
            out[i] = worst + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(out, -500, 500)))


class Grams:
    """The n-grams of a vocabulary: their buckets in word order, and where each word's begin."""

    def __init__(self, words: list[str]):
        found = [word_grams(words[k : k + 10_000]) for k in range(0, len(words), 10_000)] or [word_grams([])]
        self.bucket = np.concatenate([b.astype(np.int32) for b, _ in found])
        self.size = np.concatenate([np.diff(o) for _, o in found])
        self.start = np.cumsum(self.size) - self.size

    def scores(self, line: np.ndarray) -> np.ndarray:
        """Of each word, the mean of line over its n-grams."""
        return np.concatenate([np.add.reduceat(line[self.bucket[a:b]], self.start[k : k + 50_000] - a) / self.size[k : k + 50_000] for k, a, b in self._pieces()] or [np.empty(0)])

    def _pieces(self) -> list[tuple[int, int, int]]:
        ends = self.start + self.size
        return [(k, int(self.start[k]), int(ends[min(k + 50_000, len(ends)) - 1])) for k in range(0, len(ends), 50_000)]


def gradients(vec: np.ndarray, soft: np.ndarray, bias: np.ndarray, grams: Grams, ids: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the weighted cross entropy of windows (of n[k] words each, one after the other in ids):
    the buckets met, their gradients, and those of softmax and bias."""
    by = np.maximum(n, LEAST)
    own, inv = np.unique(ids, return_inverse=True)
    size = grams.size[own]
    at = grams.bucket[ragged(grams.start[own], size)]
    cut = np.cumsum(size) - size
    word = np.add.reduceat(vec[at], cut, axis=0) / size[:, None]
    mean = np.add.reduceat(word[inv], np.cumsum(n) - n, axis=0) / by[:, None]
    logit = GAIN * (mean @ soft) + bias
    p = np.exp(logit - logit.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    err = (p - np.eye(2)[y]) * weight[:, None]
    g_mean = GAIN * err @ soft.T / by[:, None]
    spread = np.repeat(g_mean, n, axis=0)
    each = np.stack([np.bincount(inv, spread[:, d], len(own)) for d in range(DIM)], axis=1) / size[:, None]
    flow = np.repeat(each, size, axis=0)
    hit, back = np.unique(at, return_inverse=True)
    g_vec = np.stack([np.bincount(back, flow[:, d], len(hit)) for d in range(DIM)], axis=1)
    return hit, g_vec, GAIN * mean.T @ err, err.sum(axis=0)


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Fit n-gram vectors and softmax jointly (Adagrad on cross entropy). In each epoch every
    document is represented by its worst window so far and by a random one (of a clean
    document) or any of its windows at first (of a toxic one). One class only: a constant."""
    y_all = np.asarray(labels, np.int64)
    if len(y_all) == 0 or y_all.min() == y_all.max():
        return Model(np.zeros(1 << BUCKET_BITS), -4.0 if not len(y_all) or y_all[0] == 0 else 4.0)
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], np.int32) for t in texts]
    grams = Grams(list(vocab))
    del vocab
    buckets = 1 << BUCKET_BITS
    vec = rng.normal(0, 0.1, (buckets, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.3, (DIM, 2))
    bias = np.array([1.0, -1.0])
    seen, seen_soft, seen_bias = np.full((buckets, DIM), 1e-6, np.float32), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    weight = np.where(y_all == 1, 0.5 / max(1, (y_all == 1).sum()), 0.5 / max(1, (y_all == 0).sum())) * len(y_all)
    for epoch in range(epochs):
        score = grams.scores(vec @ (soft[:, 1] - soft[:, 0]).astype(np.float32))
        picks = []
        for k, ids in enumerate(docs):
            a, b = window_bounds(len(ids))
            if not len(a):
                continue
            total = np.concatenate([[0.0], np.cumsum(score[ids])])
            worst = int(np.argmax((total[b] - total[a]) / np.maximum(b - a, LEAST)))
            other = int(rng.integers(len(a)))
            for w in {worst, other} if y_all[k] == 0 else ({other, worst} if epoch < 2 else {worst}):
                picks.append((k, a[w], b[w]))
        picks = [picks[i] for i in rng.permutation(len(picks))]
        rate = 0.25 * (1 - epoch / epochs) + 0.02
        for s in range(0, len(picks), 256):
            part = picks[s : s + 256]
            who = [k for k, _, _ in part]
            ids, n = np.concatenate([docs[k][a:b] for k, a, b in part]), np.array([b - a for _, a, b in part])
            hit, g, g_soft, g_bias = gradients(vec, soft, bias, grams, ids, n, y_all[who], weight[who] / len(part))
            g += 1e-6 * vec[hit]
            seen[hit] += g**2
            vec[hit] -= (rate * g / np.sqrt(seen[hit])).astype(np.float32)
            seen_soft += g_soft**2
            soft -= rate * g_soft / np.sqrt(seen_soft)
            seen_bias += g_bias**2
            bias -= rate * g_bias / np.sqrt(seen_bias)
    return Model(GAIN * (vec @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS, chars: int = SAMPLE_CHARS) -> Model:
    """Train on at most per_class labelled documents of each class, of at most `chars` characters
    together, in the order of a hash of the id, that are not held out. A document labelled twice is toxic if any label says so; of rows that
    share an id the smallest text counts."""
    marks = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    marks = marks.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    first = [marks.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (1, 0)]
    chosen = materialize(first[0].union(first[1]), "toxicity-sample")
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    some = rows.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    so_far = F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    got = some.withColumn("so_far", so_far).filter(F.col("so_far") <= chars).drop("so_far").collect()  # at most 2 * per_class rows
    got = sorted({(r["id"], r["text"] or "", r["y"]) for r in got})
    return train([t for _, t, _ in got], [y for _, _, y in got])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, score_name: str = "score", predicted_name: str = "predicted", model: Model | None = None) -> DataFrame:
    """docs with the score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Null and texts without words get the model's score of no words, which is low; very long texts
    are scored whole, by all their windows. Input columns named like the outputs are replaced;
    repeated rows are scored alike; an empty table gives an empty result. Without any usable
    label, or with one class only, all scores are one constant.
    """
    model = model or fit(docs, labels, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.gram, model.bias))
    keep = [c for c in docs.columns if c not in (score_name, predicted_name)]
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = Model(*shared.value), {}
        for b in batches:
            parts = []
            texts = b.column(at)
            for s in range(0, len(texts), 500):
                parts.append(own.score(texts.slice(s, 500).to_pylist(), cache))
            score = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*b.schema.names, score_name, predicted_name])

    from pyspark.sql import types as T

    rows = docs.select(*[col(c) for c in keep])
    schema = T.StructType([*rows.schema.fields, T.StructField(score_name, T.DoubleType()), T.StructField(predicted_name, T.IntegerType())])
    return rows.mapInArrow(tidy(run), schema)
