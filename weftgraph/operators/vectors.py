"""TF-IDF, truncated SVD, structural features, similarity and three-phase search."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import compose_text, cosine, tokens, unit
from ..plans.shared import materialize
from .graph import degrees, edge_profile
from .schema import EDGE_TYPES, NODE_TYPES
from .text import counted, unique

COMPONENTS = 100
STRUCT_DIMS = len(NODE_TYPES) + 2 + len(EDGE_TYPES) + 2
MODEL_VERSION = "tfidf-svd-v2"
REFIT_SHARE = 0.2
PRUNE = 0.10
DECAY = 0.5
TEXT_FIELDS = ("name", "signature", "docstring", "summary_short", "summary_detailed", "lsp_type_info", "lsp_hover_doc")
WEIGHTS = {"similarity": 0.5, "importance": 0.3, "branch": 0.2, "name": 0.15}
MOST_TERMS = 4096  # terms (a matrix of 134 MB) up to which the decomposition takes their Gram matrix; above, products with it
TERM_CHUNK = 4096  # terms whose sums travel together
SPARE = 8  # vectors that are iterated beyond those asked for
RESIDUAL = 1e-7  # of the largest eigenvalue, that each vector asked for may be off
PASSES = 300  # products at most; a warning says if they were not enough


def node_text() -> Column:
    return compose_text(*[F.col(c) for c in TEXT_FIELDS])


def term_counts(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf): tf is the share of the document's tokens."""
    held = docs.select(F.col(id_col).alias("id"), tokens(text).alias("ts")).filter(F.size("ts") > 0)
    each = counted(held.withColumn("n", F.size("ts")), "ts").select("id", "n", "x.term", F.col("x.n").alias("c"))
    if not unique(docs, id_col):
        each = each.groupBy("id", "n", "term").agg(F.sum("c").alias("c"))
    return each.select("id", "term", (F.col("c") / F.col("n")).alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(docs: DataFrame, id_col: str = "id", text: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, term, weight), (term, df, idf)); idf = ln((N + 1) / (df + 1)) + 1 over all documents."""
    counts = materialize(term_counts(docs, id_col, node_text() if text is None else text), "terms")  # read twice
    n = docs.count()
    vocab = materialize(document_frequency(counts).withColumn("idf", F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1), "vocabulary")  # its size is known then: a small one is broadcast
    return counts.join(vocab, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("weight")), vocab


@dataclass
class Model:
    """vocab: (term, idx, idf); components: k rows over the vocabulary; mean of the corpus."""

    vocab: DataFrame
    components: np.ndarray
    mean: np.ndarray
    version: str = MODEL_VERSION

    def rows(self, spark: SparkSession) -> DataFrame:
        """The model as a table: a row for each term, with its place in every component."""
        at = [(i, self.components[:, i].tolist(), float(m), self.version) for i, m in enumerate(self.mean)]
        loads = spark.createDataFrame(at, "idx int, load array<double>, mean double, version string")
        return self.vocab.select("term", "idx", "idf").join(loads, "idx")


def load_model(rows: DataFrame) -> Model | None:
    """The model of a table that Model.rows made; None where it is empty. The driver holds a row
    of numbers for each term, as when it was fitted."""
    held = rows.select("idx", "load", "mean", "version").orderBy("idx").collect()
    if not held:
        return None
    return Model(rows.select("term", "idx", "idf"), np.array([r["load"] for r in held]).T, np.array([r["mean"] for r in held]), held[0]["version"])


def leading(product: Callable[[np.ndarray], np.ndarray], size: int, k: int, seed: int = 1) -> np.ndarray:
    """The k leading eigenvectors (columns) of a symmetric positive matrix of which only products
    with blocks of vectors are known: a block Davidson method that restarts at three blocks."""
    width = min(size, k + SPARE)
    new = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    base, image = np.zeros((size, 0)), np.zeros((size, 0))
    for _ in range(PASSES):
        base, image = np.hstack([base, new]), np.hstack([image, product(new)])
        small = base.T @ image
        value, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, np.argsort(-value)[:width]]
        x, ax = base @ turn, image @ turn
        rest = ax - x * (x * ax).sum(axis=0)
        off = np.linalg.norm(rest, axis=0)
        least = RESIDUAL * max(float(value.max()), 0.0)
        if (off[:k] <= least).all() or base.shape[1] >= size:
            return x[:, :k]
        if base.shape[1] + width > 3 * width:
            base, image = x, ax
        rest = rest[:, off > least / 10] / off[off > least / 10]
        for _ in range(2):
            rest = rest - base @ (base.T @ rest)
            u, s, _ = np.linalg.svd(rest, full_matrices=False)
            rest = u[:, s > 1e-8][:, : size - base.shape[1]]
        if not rest.shape[1]:
            return x[:, :k]
        new = rest
    warnings.warn(f"fit_svd: after {PASSES} products a vector is off by {off[:k].max():.1e} (wanted {least:.1e})", stacklevel=2)
    return x[:, :k]


def fit_svd_by_products(listed: DataFrame, index: DataFrame, vocab: DataFrame, size: int, n: int, k: int) -> Model:
    """fit_svd for a vocabulary of any size: the driver and each task hold a few blocks of
    vocabulary x k numbers (at k = 100 up to about 8 KB a term on the driver)."""
    spark = listed.sparkSession

    def product(q: np.ndarray) -> np.ndarray:
        width = q.shape[1]
        shared = spark.sparkContext.broadcast(q)
        step = TERM_CHUNK

        def multiply(batches):
            import pandas as pd

            q, held = shared.value, {}
            for pdf in batches:
                for s in range(0, len(pdf), 500):
                    xs = pdf["x"].iloc[s : s + 500]
                    sizes = np.array([len(x) for x in xs])
                    at = np.array([t["idx"] for x in xs for t in x])
                    w = np.array([t["weight"] for x in xs for t in x])
                    y = np.add.reduceat(w[:, None] * q[at], np.cumsum(sizes) - sizes, axis=0)
                    part = w[:, None] * np.repeat(y, sizes, axis=0)
                    order = np.argsort(at, kind="stable")
                    terms, first = np.unique(at[order], return_index=True)
                    sums = np.add.reduceat(part[order], first, axis=0)
                    for c in np.unique(terms // step):
                        own = terms // step == c
                        held.setdefault(int(c), np.zeros((step, width)))[terms[own] % step] += sums[own]
            yield pd.DataFrame({"chunk": list(held), "total": [h.tobytes() for h in held.values()]})

        def add(pdf):
            import pandas as pd

            return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "total": [sum(np.frombuffer(t) for t in pdf["total"]).tobytes()]})

        out = np.zeros((size, width))
        for row in listed.mapInPandas(multiply, "chunk int, total binary").groupBy("chunk").applyInPandas(add, "chunk int, total binary").toLocalIterator():
            start = row["chunk"] * step
            out[start : start + step] = np.frombuffer(row["total"]).reshape(step, width)[: size - start]
        shared.destroy()
        return out - n * np.outer(mean, mean @ q)

    mean = np.zeros(size)
    for row in listed.select(F.explode("x").alias("t")).groupBy("t.idx").agg(F.sum("t.weight").alias("w")).toLocalIterator():
        mean[row["idx"]] = row["w"] / max(n, 1)
    vectors = leading(product, size, max(0, min(k, n - 1, size)))
    return Model(index.join(vocab.select("term", "idf"), "term"), vectors.T, mean)


def fit_svd(weights: DataFrame, vocab: DataFrame, n: int, k: int = COMPONENTS, most_terms: int = MOST_TERMS) -> Model:
    """The leading right singular vectors of the centred matrix over the whole vocabulary; their
    signs are arbitrary. Up to most_terms terms come from their Gram matrix: products of term
    pairs are summed across the cluster (documents are short); the driver holds at most
    most_terms squared numbers, and decomposes them. More are iterated on products with it."""
    names = sorted(r["term"] for r in vocab.select("term").collect())  # the model holds a row of k numbers for each
    spark = weights.sparkSession
    index = spark.createDataFrame(list(zip(names, range(len(names)))), "term string, idx int")
    small = len(names) <= most_terms
    listed = weights.join(F.broadcast(index) if small else index, "term").groupBy("id").agg(F.collect_list(F.struct("idx", "weight")).alias("x"))
    if not small:
        return fit_svd_by_products(materialize(listed, "svd-rows"), index, vocab, len(names), n, k)

    def gram(batches):
        size = len(names)
        total, mean = np.zeros((size, size)), np.zeros(size)
        import pandas as pd

        for pdf in batches:
            block = np.zeros((len(pdf), size))
            for i, xs in enumerate(pdf["x"]):
                for x in xs:
                    block[i, x["idx"]] = x["weight"]
            total += block.T @ block
            mean += block.sum(axis=0)
        yield pd.DataFrame({"gram": [total.astype("<f8").tobytes()], "mean": [mean.astype("<f8").tobytes()]})

    def add(pdf):
        import pandas as pd

        total = sum(np.frombuffer(g, "<f8") for g in pdf["gram"])
        return pd.DataFrame({"gram": [total.tobytes()], "mean": [sum(np.frombuffer(m, "<f8") for m in pdf["mean"]).tobytes()]})

    parts = listed.mapInPandas(gram, "gram binary, mean binary")
    width = 8
    parts = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(width))).groupBy("g").applyInPandas(lambda pdf: add(pdf), "gram binary, mean binary")
    size = len(names)
    total, mean = np.zeros((size, size)), np.zeros(size)
    for row in parts.toLocalIterator():
        total += np.frombuffer(row["gram"], "<f8").reshape(size, size)
        mean += np.frombuffer(row["mean"], "<f8")
    mean /= max(n, 1)
    total -= n * np.outer(mean, mean)
    value, vector = np.linalg.eigh(total) if size else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-value)[: max(0, min(k, n - 1, size))]
    return Model(index.join(vocab.select("term", "idf"), "term"), vector[:, order].T, mean)


def project(weights: DataFrame, model: Model, center: bool = True) -> DataFrame:
    """(id, content): documents in the space of the components; terms the model lacks are
    ignored. center=False is how queries are projected."""
    spark = weights.sparkSession
    names = [r["term"] for r in model.vocab.orderBy("idx").select("term").collect()]
    rows = [(t, model.components[:, i].tolist()) for i, t in enumerate(names)]
    loads = spark.createDataFrame(rows, "term string, load array<double>")
    k = len(model.components)
    part = F.transform("load", lambda x: x * F.col("weight"))
    sums = weights.join(F.broadcast(loads) if len(names) <= MOST_TERMS else loads, "term").select("id", F.posexplode(part)).groupBy("id", "pos").agg(F.sum("col").alias("v"))
    base = (model.components @ model.mean).tolist() if center else [0.0] * k
    lists = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("m"))
    shift = F.array(*[F.lit(float(x)) for x in base])
    return lists.select("id", F.transform(F.sequence(F.lit(0), F.lit(max(k - 1, 0))), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)) - F.get(shift, i)).alias("content"))


def structural(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, features): type one-hot, log degrees, edge profile, log complexity, importance."""
    joined = nodes.select("id", "node_type", "complexity", "importance").join(degrees(nodes, edges), "id").join(edge_profile(nodes, edges), "id")
    one_hot = [F.coalesce(F.col("node_type") == t, F.lit(False)).cast("double") for t in NODE_TYPES]
    return joined.select("id", F.array(*one_hot, F.log1p("in_degree"), F.log1p("out_degree"), *[F.col(t) for t in EDGE_TYPES], F.log1p(F.coalesce("complexity", F.lit(0))) / F.log1p(F.lit(50.0)), F.coalesce("importance", F.lit(0.0))).alias("features"))


def composite(content: DataFrame, features: DataFrame, nodes: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(node_id, content_hash, embedding): content padded to `components`, then the features, at
    length one."""
    pad = F.transform(F.sequence(F.lit(0), F.lit(components - 1)), lambda i: F.coalesce(F.get("content", i), F.lit(0.0)))
    both = nodes.select("id", "content_hash").join(features, "id").join(content, "id", "left").withColumn("content", F.coalesce("content", F.array().cast("array<double>")))
    return both.select(F.col("id").alias("node_id"), "content_hash", unit(F.concat(pad, "features")).cast("array<float>").alias("embedding"))


def embed_all(nodes: DataFrame, edges: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Model]:
    weights, vocab = tfidf(nodes)
    model = fit_svd(weights, vocab, nodes.count(), components)
    return composite(project(weights, model), structural(nodes, edges), nodes, components), model


def needs_refit(model: Model | None, changed: int, total: int) -> bool:
    return model is None or model.version != MODEL_VERSION or (total > 0 and changed / total > REFIT_SHARE)


def update_embeddings(nodes: DataFrame, edges: DataFrame, old: DataFrame, model: Model | None, components: int = COMPONENTS) -> tuple[DataFrame, Model]:
    """Embeddings of nodes that are new or changed by content hash, made with the old model
    unless too much changed; those of nodes that are gone are dropped."""
    known = old.select("node_id", F.col("content_hash").alias("__hash"))
    fresh = nodes.join(known, (F.col("id") == F.col("node_id")) & F.col("content_hash").eqNullSafe(F.col("__hash")), "left_anti")
    if needs_refit(model, fresh.count(), nodes.count()):
        return embed_all(nodes, edges, components)
    counts = term_counts(fresh, "id", node_text())
    weights = counts.join(model.vocab, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("weight"))
    made = composite(project(weights, model), structural(nodes, edges).join(fresh.select("id"), "id", "left_semi"), fresh, components)
    kept = old.join(nodes.select("id"), F.col("node_id") == F.col("id"), "left_semi").join(fresh.select("id"), F.col("node_id") == F.col("id"), "left_anti")
    return kept.unionByName(made), model


def embed_query(spark: SparkSession, text: str, model: Model, components: int = COMPONENTS, center_query: bool = False) -> list[float]:
    """The query's vector: projected like a document, zeros for the structure. Words that the
    model lacks are ignored, so it may be zero."""
    one = spark.createDataFrame([("q", text)], "id string, text string")
    counts = term_counts(one, "id", F.col("text"))
    weights = counts.join(model.vocab, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("weight"))
    row = project(weights, model, center=center_query).first()
    content = np.zeros(components)
    if row:
        content[: len(row["content"])] = row["content"][:components]
    whole = np.concatenate([content, np.zeros(STRUCT_DIMS)])
    return (whole / (np.linalg.norm(whole) or 1.0)).tolist()


def similarity(vectors: DataFrame, query: list[float], vec_col: str = "embedding") -> DataFrame:
    """vectors with similarity: the cosine with the query."""
    return vectors.withColumn("similarity", cosine(F.col(vec_col), F.array(*[F.lit(float(x)) for x in query])))


def top_similar(vectors: DataFrame, query: list[float], k: int, id_col: str, vec_col: str = "embedding") -> DataFrame:
    return similarity(vectors, query, vec_col).orderBy(F.desc("similarity"), id_col).limit(k)


NEIGHBOUR_TILE = 1024  # points of a block that are compared with as many in one step


def neighbours(points: DataFrame, k: int, id_col: str, vec_col: str, block_col: str) -> DataFrame:
    """(id, neighbour, rank): for each point its k nearest of the same block, by dot product.

    A block is cut into chunks; each pair of chunks is one small matrix product that hands on the
    k best of each of its points, so pairs are never listed and a large block is many tasks.
    Points without a block or a vector have no neighbours.
    """
    held = points.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.xxhash64(block_col).alias("block"), F.col(block_col).isNotNull().alias("ok")).filter("ok AND v IS NOT NULL AND id IS NOT NULL")
    sizes = held.groupBy("block").agg(F.ceil(F.count("*") / NEIGHBOUR_TILE).cast("int").alias("chunks"))
    cut = held.join(sizes, "block").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    asks = cut.select("block", F.col("own").alias("i"), every.alias("j"), F.lit(0).alias("side"), "id", "v")
    data = cut.select("block", every.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "id", "v")

    def best(pdf):
        import pandas as pd

        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1].sort_values("id")
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "neighbour": [], "score": []})
        score = np.stack(a["v"]) @ np.stack(b["v"]).T
        ids, others = a["id"].to_numpy(), b["id"].to_numpy()
        score[ids[:, None] == others[None, :]] = -np.inf
        at = np.argsort(-score, axis=1, kind="stable")[:, :k]
        got = np.take_along_axis(score, at, axis=1)
        out = pd.DataFrame({"id": np.repeat(ids, at.shape[1]), "neighbour": others[at].ravel(), "score": got.ravel()})
        return out[out["score"] > -np.inf]

    found = asks.union(data).groupBy("block", "i", "j").applyInPandas(best, "id long, neighbour long, score double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "neighbour"))).filter(F.col("rank") <= k).select("id", "neighbour", "rank")


def branch_scores(seeds: DataFrame, edges: DataFrame, sims: DataFrame, prune: float = PRUNE) -> DataFrame:
    """(id, branch): the best score that a seed (id, similarity) sends over at most two hops, in
    either direction, through nodes (id, similarity) of at least `prune`.

    One hop sends s * 0.5 * w; a second sends that times 0.25 * w. Seeds without similarity
    send nothing.
    """
    both = edges.select("source_id", "target_id", "weight").union(edges.select("target_id", "source_id", "weight")).toDF("__from", "__to", "__w")
    both = both.withColumn("__w", F.coalesce("__w", F.lit(1.0))).groupBy("__from", "__to").agg(F.max("__w").alias("__w"))
    alive = sims.filter(F.col("similarity") >= prune).select(F.col("id").alias("__alive"))
    step = both.join(alive, F.col("__to") == F.col("__alive"), "left_semi")
    start = seeds.filter("similarity > 0").select("id", "similarity")
    one = start.join(step, F.col("id") == F.col("__from")).groupBy("__to").agg(F.max(F.col("similarity") * DECAY * F.col("__w")).alias("branch")).select(F.col("__to").alias("id"), "branch")
    two = one.join(step, F.col("id") == F.col("__from")).groupBy("__to").agg(F.max(F.col("branch") * DECAY**2 * F.col("__w")).alias("branch")).select(F.col("__to").alias("id"), "branch")
    return one.union(two).groupBy("id").agg(F.max("branch").alias("branch"))


def semantic_search(nodes: DataFrame, edges: DataFrame, sims: DataFrame, query: str, limit: int = 10, seeds: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, score, similarity, branch, match_type): seeds by similarity, or by name where none is
    similar; their branches; then a weighted sum. sims: (id, similarity) of all nodes."""
    w = WEIGHTS | (weights or {})
    first = sims.filter("similarity > 0").orderBy(F.desc("similarity"), "id").limit(seeds)
    if first.isEmpty():
        first = nodes.filter(F.lower("name").contains(query.lower())).orderBy(F.desc("importance"), "id").limit(seeds).select("id", F.lit(0.0).alias("similarity"))
    branch = branch_scores(first, edges, sims)
    chosen = first.select("id", F.lit(True).alias("__seed")).join(branch, "id", "full").join(sims, "id", "left").join(nodes.select("id", "name", "importance"), "id")
    named = F.instr(F.lower("name"), query.lower()) > 0
    score = w["similarity"] * F.coalesce("similarity", F.lit(0.0)) + w["importance"] * F.coalesce("importance", F.lit(0.0)) + w["branch"] * F.coalesce("branch", F.lit(0.0)) + F.when(named, w["name"]).otherwise(0.0)
    kind = F.when(named, "name_match").when(F.coalesce("__seed", F.lit(False)), "semantic").otherwise("branch")
    return chosen.select("id", score.alias("score"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("branch", F.lit(0.0)).alias("branch"), kind.alias("match_type")).orderBy(F.desc("score"), "id").limit(limit)


def pca(vectors: DataFrame, k: int = 2, id_col: str = "node_id", vec_col: str = "embedding") -> DataFrame:
    """(id, coords): each vector on the first k principal axes, each axis scaled to [-1, 1]; fewer
    than three vectors lie on a circle."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    held = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    n = held.limit(3).count()
    if n < 3:
        return circle(held.select("id"))
    x = held.withColumn("x", array_to_vector("v"))
    coords = PCA(k=k, inputCol="x", outputCol="p").fit(x).transform(x).select("id", vector_to_array("p").alias("p"))
    ends = coords.agg(*[f(F.col("p")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("lo", F.min), ("hi", F.max))]).first()  # two numbers an axis
    scaled = [F.when(F.lit(ends[f"hi{i}"] > ends[f"lo{i}"]), 2 * (F.col("p")[i] - ends[f"lo{i}"]) / ((ends[f"hi{i}"] - ends[f"lo{i}"]) or 1.0) - 1).otherwise(0.0) for i in range(k)]
    return coords.select("id", F.array(*scaled).alias("coords"))


def circle(ids: DataFrame, position: Column | None = None, total: int | None = None) -> DataFrame:
    """(id, coords): ids evenly on the unit circle, in their order. The order is found in parts:
    ranges of ids are numbered each for itself, from an offset."""
    n = total if total is not None else ids.count()
    ranged = ids.repartitionByRange("id").withColumn("__part", F.spark_partition_id()) if position is None else ids
    if position is None:
        ranged = materialize(ranged, "circle")
        sizes = ranged.groupBy("__part").agg(F.count("*").alias("c"))
        first = sizes.select("__part", (F.sum("c").over(Window.orderBy("__part")) - F.col("c")).alias("__first"))  # a row for each partition
        ranged = ranged.join(F.broadcast(first), "__part").withColumn("__at", F.col("__first") + F.row_number().over(Window.partitionBy("__part").orderBy("id")) - 1)
        position = F.col("__at")
    angle = 2 * np.pi * position / max(n, 1)
    return ranged.select("id", F.array(F.round(F.cos(angle), 4), F.round(F.sin(angle), 4)).alias("coords"))
