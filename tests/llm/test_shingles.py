"""Word-shingle near-duplicates against exact similarities of all pairs."""

import random

import pytest

import corpus_pipeline
from weftgraph.llm import simhash

from .helpers import components, pairs


def exact(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted():
    """Texts of 100 words with copies of which some words are changed, so similarities of 0.7 to 0.97."""
    rng = random.Random(3)
    rows, doc = [], 0
    for changed in (1, 1, 2, 2, 3, 4, 5, 6) * 4:
        words = [f"w{rng.randrange(5000)}" for _ in range(100 if changed < 3 else 250)]
        copy = list(words)
        for at in rng.sample(range(len(words)), changed):
            copy[at] = "other"
        if changed == 1:
            copy = copy[:-1] + ["end"]
            copy[rng.randrange(40)] = words[0]
        rows += [(doc, " ".join(words)), (doc + 1, " ".join(copy))]
        doc += 2
    base = [f"v{k}" for k in range(400)]
    rows += [(doc, " ".join(base)), (doc + 1, " ".join(["x", *base[1:], "y", "z"]))]  # about 0.98
    return rows + [(doc + 2, None), (doc + 3, " "), (doc + 4, "short text"), (doc + 5, "Short  TEXT"), (doc + 6, "short words")]


@pytest.mark.parametrize("tile", [2048, 3])
def test_stage_reaches_similarity(spark, sf_dir, monkeypatch, tile):
    monkeypatch.setattr(simhash, "SETS", tile)
    rows = planted()
    sets = {i: exact(t) for i, t in rows}
    near = [(rows[a][0], rows[b][0]) for a, b in pairs(len(rows)) if jaccard(sets[rows[a][0]], sets[rows[b][0]]) >= 0.8]
    values = [jaccard(sets[a], sets[b]) for a, b in near]
    assert sum(0.8 <= v <= 0.97 for v in values) >= 10 and min(jaccard(sets[2 * k], sets[2 * k + 1]) for k in range(32)) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect())
    assert kept == sorted(set(components([i for i, _ in rows], near).values()))


def test_large_group_and_driver_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(simhash, "SETS", 8)
    base = [f"v{k}" for k in range(300)]
    near = [(k, " ".join([*base[:150], f"only{k}", *base[151:]])) for k in range(60)]
    assert [r["doc_id"] for r in simhash.drop_similar(spark.createDataFrame(near, "doc_id long, text string")).collect()] == [0]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], exact(r["text"])) for r in docs.select("doc_id", "text").collect()]
    links = [(rows[a][0], rows[b][0]) for a, b in pairs(len(rows)) if jaccard(rows[a][1], rows[b][1]) >= 0.8]
    assert {r["doc_id"] for r in simhash.drop_similar(docs).collect()} == set(components([i for i, _ in rows], links).values())
