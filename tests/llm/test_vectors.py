import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import ann, embedding_dedup
from weftgraph.llm.components import label

SCHEMA = "vec_id long, embedding array<float>, label int, score string, vec string"


def table(spark, x, labels=None):
    return spark.createDataFrame([(i, [float(y) for y in v], int(labels[i]) if labels is not None else 0, "mine", "mine") for i, v in enumerate(x)], SCHEMA)


def odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0, 0.0], 1), (4, [nan, 1.0, 0.0], 1), (5, [inf, 1.0, 0.0], 1), (6, [None, 1.0, 0.0], 1), (7, [1.0, 0.01, 0.0], 1), (8, [1.0, 0.0, 0.0], None), (9, [1.0, 0.0], 1), (None, [1.0, 0.0, 0.0], 1), (20, [0.0, 1.0, 0.0], 2), (20, [0.0, 1.0, 0.0], 2), (11, [], 2)]
    return spark.createDataFrame([(a, b, c, "mine", "mine") for a, b, c in rows], SCHEMA)


def test_recall_scores_and_order(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(20, 24))
    x = (centre[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 24)) * 0.7).astype(np.float32)
    got = ann.nearest(table(spark, x), F.col("vec_id") % 20 == 0, k=20).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 3000, 20))
    hits = 0
    d = x.astype(np.float64)
    for q, rows in by.items():
        assert [r["rank"] for r in rows] == list(range(1, 21))
        keys = [(-r["score"], r["vec_id"]) for r in rows]
        assert keys == sorted(keys) and q not in {r["vec_id"] for r in rows}
        assert all(r["score"] == pytest.approx(float(d[q] @ d[r["vec_id"]]), abs=1e-12) for r in rows)
        s = d @ d[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s, kind="stable")[:20]) & {r["vec_id"] for r in rows})
    assert hits / (20 * len(by)) >= 0.95


def test_hot_lists_are_cut_and_ties_go_to_smaller_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 2)
    got = ann.nearest(table(spark, [[1.0, 2.0, 3.0]] * 200), F.col("vec_id") % 20 == 0, k=5).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert len(by) == 10
    for q, rows in by.items():
        assert [v for _, v in sorted(rows)] == [v for v in range(6) if v != q][:5]


def test_few_probes_still_find_k_rows(spark):
    x = np.random.default_rng(4).normal(size=(1500, 16))
    got = ann.nearest(table(spark, x), F.col("vec_id") % 20 == 0, k=20, probe=0.1).groupBy("query_id").count().collect()
    assert len(got) == 75 and {r["count"] for r in got} == {20}


@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e-12])
def test_short_vectors_are_ranked_like_long_ones(spark, scale):
    x = np.random.default_rng(8).normal(size=(400, 16)) * scale
    x[::7] *= 1e-3
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(docs, F.col("vec_id") % 40 == 0, k=5, probe=1.0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    index = ann.fit(x, 1)
    codes = index.encode(x, np.zeros(400, int))
    hits = 0
    asks, ids, scores, _ = ann.search_block(index, np.arange(400), x, codes, 0, np.arange(0, 400, 40), x[::40], np.full((10, 5), -1), np.full(10, -np.inf), 5)
    for q in range(0, 400, 40):
        ids_of, score = ids[asks == q], scores[asks == q]
        s = x @ x[q]
        s[q] = -np.inf
        want = np.argsort(-s, kind="stable")[:5]
        hits += len(set(want) & found[q])
        assert len(set(want) & set(ids_of.tolist())) >= 4 and np.allclose(score, s[ids_of], rtol=1e-9, atol=0)
    assert hits >= 0.9 * 50


def test_odd_vectors_take_no_part(spark):
    got = ann.nearest(odd(spark), F.col("vec_id") % 20 == 0, k=20, probe=1.0).collect()
    assert {r["query_id"] for r in got} == {0, 20}
    mine = sorted((r for r in got if r["query_id"] == 0), key=lambda r: r["rank"])
    assert [r["vec_id"] for r in mine] == [1, 7, 8, 20, 20] and [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
    assert ann.nearest(odd(spark).limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.nearest(odd(spark).filter("vec_id = 0"), F.col("vec_id") % 20 == 0).collect() == []


def test_few_exact_products_are_computed():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for scale in (1.0, 1e-6):
        y, q, asks = x * scale, x[::500] * scale, np.arange(0, 20_000, 500)
        some = rng.permutation(20_000)[:4096]
        index = ann.fit(y[some], 64)
        own = index.assign(y)
        codes, lists = index.encode(y, own), index.probes(q, 64)
        known, floor = ann.floors(q, asks, some, y[some], 20, own[some], lists)
        done, hits, found = 0, 0, {int(a): [] for a in asks}
        for k in range(64):
            at = np.flatnonzero(own == k)
            who, ids, score, n = ann.search_block(index, at, y[at], codes[at], k, asks, q, known, floor, 20)
            done += n
            for a, i, s in zip(who.tolist(), ids.tolist(), score.tolist()):
                found[a].append((-s, i))
        for a, got in found.items():
            s = y @ y[a]
            s[a] = -np.inf
            assert floor[a // 500] <= np.sort(s)[-20]
            hits += len({i for _, i in sorted(got)[:20]} & set(np.argsort(-s, kind="stable")[:20]))
        assert done < 0.1 * 40 * 20_000 and hits >= 0.95 * 20 * 40


def test_lists_that_cannot_reach_the_floor_are_not_probed():
    index = ann.Index(np.array([[1.0, 0], [0, 1], [-1, 0]]), np.ones(3), np.ones(3), [0, 2], [])
    q = np.array([[2.0, 0]])
    lists = index.probes(q, 3)
    assert lists.tolist() == [[0, 1, 2]]
    assert index.reaching(q, lists, np.array([0.5]), np.array([0.1, 0.3, 0.2]))[0].tolist() == [0, 1]
    assert index.reaching(q, lists, np.array([-np.inf]), np.array([0.1, -1, 0.2]))[0].tolist() == [0, 2]


def test_recall_of_the_registered_query(spark):
    from weftgraph.llm.queries import op1_ivfpq_search

    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = {}
    for r in op1_ivfpq_search(spark, folder).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asks = [i for i in ids if i % 20 == 0]
    hits = 0
    for a in asks:
        s = x @ x[ids == a][0]
        s[ids == a] = -np.inf
        hits += len(got[a] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(asks)


def brute(x, labels, cosine):
    n = np.zeros(len(x), int)
    u = x.astype(np.float64)
    u = u / np.sqrt((u**2).sum(axis=1))[:, None]
    i, j = np.nonzero(np.triu((u @ u.T >= cosine) & (labels[:, None] == labels[None, :]), 1))
    np.add.at(n, i, 1)
    np.add.at(n, j, 1)
    return n, label(len(x), i, j)


@pytest.mark.parametrize("dim,tile", [(64, 4096), (64, 64), (20, 4096), (5, 64)])
def test_links_and_components_equal_brute_force(spark, monkeypatch, dim, tile):
    monkeypatch.setattr(embedding_dedup, "LOCAL", tile)
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(150, dim))
    assert tile > 64 or 150 > tile  # the small bound cuts labels into cells, and those into chunks
    x = np.concatenate([base, base[:60] + rng.normal(size=(60, dim)) * 0.25, base[:3].repeat(20, axis=0) + rng.normal(size=(60, dim)) * 0.1, base[:20], base[:20] * 3]).astype(np.float32)
    labels = rng.integers(0, 2, len(x))
    labels[150:210], labels[210:270] = labels[:60], labels[:3].repeat(20)
    n, root = brute(x, labels, 0.93)
    rows = sorted(embedding_dedup.near_vectors(table(spark, x, labels)).collect(), key=lambda r: r["vec_id"])
    assert [r["n_links"] for r in rows] == n.tolist()
    assert [r["component_id"] for r in rows] == root.tolist()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows) and n.sum() > 0


def test_odd_vectors_link_with_nothing(spark):
    rows = embedding_dedup.near_vectors(odd(spark)).collect()
    got = sorted(((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"], r["kept"]) for r in rows), key=str)
    want = [(0, 2, 0, True), (1, 2, 0, False), (7, 2, 0, False), (20, 1, 20, True), (20, 1, 20, True), (-1, 0, None, True)] + [(k, 0, k, True) for k in (2, 3, 4, 5, 6, 8, 9, 11)]
    assert got == sorted(want, key=str)
    assert embedding_dedup.near_vectors(odd(spark).limit(0)).collect() == []


def test_repeated_ids_link_no_labels(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 1), (5, [1.0, 0.01, 0.0], 1), (5, b, 2), (9, [0.01, 1.0, 0.0], 2), (9, a, 3), (7, a, 3), (7, b, 3)]
    df = spark.createDataFrame([(i, v, k, "mine", "mine") for i, v, k in rows], SCHEMA)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df).collect())
    assert got == [(1, 1, 1, True), (5, 1, 1, False), (5, 1, 5, True), (7, 0, 7, True), (7, 1, 7, True), (9, 1, 5, False), (9, 1, 7, False)]


def test_very_short_and_long_vectors(spark):
    x = [[1e-200, 1e-201], [2e200, 2e199], [1.0, 0.1], [5e-324, 0.0], [-1e-200, 1e-201]]
    df = spark.createDataFrame([(k, v, 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(df, cosine=0.99).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4)}


def test_range_join_equals_brute_force_and_filters():
    rng = np.random.default_rng(1)
    shares = []
    for n, d in ((1, 8), (300, 8), (1500, 3), (3000, 3)):
        z = rng.normal(size=(n, d)) * 0.125
        limit = 0.0175
        found, done = set(), 0
        for i, j, k in embedding_dedup.range_join(z, limit):
            assert not found & set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist()))
            found |= set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist()))
            done += k
        i, j = np.nonzero(np.triu(((z[:, None] - z[None]) ** 2).sum(axis=2) <= limit, 1))
        assert found == set(zip(i.tolist(), j.tolist()))
        shares.append(done / (n * n / 2))
    assert shares[3] < shares[2] < 0.5


def test_rotation_keeps_distances_and_does_not_depend_on_the_batch():
    x = np.random.default_rng(2).normal(size=(50, 20)).astype(np.float32)
    y = embedding_dedup.rotate(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(y @ y.T, u @ u.T, atol=1e-6)
    assert (embedding_dedup.rotate(x[7:9]) == y[7:9]).all()
