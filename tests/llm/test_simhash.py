import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import simhash
from weftgraph.llm import components as components_module
from weftgraph.llm.components import Forest, connected_components, grow, label, thinned

from .helpers import DOCS, components, odd_docs, pairs


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(map(ord, "\t\n\r\x0b\x0c"), " ")).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["", None, " \t", "one", "one two", "One TWO three", "É a b c É a b c", "a b c a b c a b c", "x y z w v", "ABC abc " * 50]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_equals_sparks_hash(spark):
    row = spark.sql("SELECT xxhash64('one two three') AS h").first()
    assert simhash.fingerprint("one two three") == row["h"] % 2**64


@pytest.mark.parametrize("radius,n,dense", [(3, 600, 48), (3, 300, 2), (1, 300, 48), (5, 300, 48)])
def test_links_equal_brute_force(spark, monkeypatch, radius, n, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    r = random.Random(radius)
    fps = [r.getrandbits(64) for _ in range(n)]
    for base in fps[:60]:
        x = base
        for _ in range(4):  # chains: neighbours link, ends don't
            for b in r.sample(range(64), radius):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    links = [(a, b) for a, b in pairs(len(fps)) if (fps[a] ^ fps[b]).bit_count() <= radius]
    want = components(range(len(fps)), links)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"]: r["root"] for r in connected_components(simhash.near_links(df, radius)).collect()}
    groups = {}
    for k, x in enumerate(signed):
        groups.setdefault(got.get(x, x), set()).add(k)
    wanted = {}
    for k, v in want.items():
        wanted.setdefault(v, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    fps = sorted({(0xABCD << 48) ^ (1 << a) ^ (1 << b) for a, b in pairs(24)})
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    roots = connected_components(simhash.near_links(df, 2))
    assert roots.select("root").distinct().count() == 1 and roots.count() == len(fps) - 1
    far = connected_components(simhash.near_links(df, 1))
    assert far.count() == 0


def test_thresholds_fulfil_the_pigeonhole():
    rng = np.random.default_rng(1)
    for rows in (100, 10**6, 10**10):
        chosen = simhash.plan(rng.integers(0, 2**64, 500, dtype=np.uint64), rows, 3)
        positions = [b for part, _ in chosen for b in part]
        assert len(positions) == len(set(positions))
        assert sum(t + 1 for _, t in chosen) == 4  # as many as may differ, and one
    assert simhash.plan(np.empty(0, np.uint64), 0, 3)


def test_plan_misses_few_pairs():
    rng = np.random.default_rng(1)
    p = simhash.bit_difference(0.8)
    for rows in (0, 10**5, 10**9):
        chosen = simhash.plan_similar(rng.integers(0, 2**64, (500 if rows else 0, 4), dtype=np.uint64), rows, 0.8)
        positions = [b for part, _ in chosen for b in part]
        assert len(positions) == len(set(positions)) and max(positions) < 256
        flips = rng.random((20_000, 256)) < p
        met = np.zeros(20_000, bool)
        for part, t in chosen:
            met |= flips[:, part].sum(axis=1) <= t
        assert (~met).mean() <= 2 * simhash.MISS


def test_turned_bits_meet_within_the_threshold():
    for t in range(5):
        mine, theirs = t // 2, t - t // 2
        assert mine + theirs == t and simhash.keys_of(10, t) == sum(1 for k in range(1 << 10) if k.bit_count() <= theirs)


def test_wide_fingerprints_differ_by_similarity():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    for shared, similarity in ((2667, 0.8), (2850, 0.905)):
        b = np.concatenate([a[:shared], rng.integers(0, 2**64, 3000 - shared, dtype=np.uint64)])
        x, y = simhash.wide_fingerprint(a, 64), simhash.wide_fingerprint(b, 64)
        assert abs(simhash.distance(x, y) / (64 * 64) - simhash.bit_difference(similarity)) < 0.02


def test_dense_groups_cost_few_questions():
    asked = []
    x = np.zeros(500)
    x[490:] = np.arange(1, 11)  # ten rows that link with nothing

    def near(i):
        asked.append(i)
        return x == x[i]

    root = grow(500, near)
    assert (root[:490] == 0).all() and (root[490:] == np.arange(490, 500)).all() and len(asked) == 11
    rng = np.random.default_rng(2)
    for n in (1, 40, 200):
        m = rng.random((n, n)) < 1.2 / n
        m |= m.T
        i, j = np.nonzero(m)
        assert (grow(n, lambda k: m[k].copy()) == label(n, i, j)).all()


def test_groups_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = simhash.simhash_groups(docs).collect()
    assert len(rows) == docs.count() and rows[0].__fields__ == ["doc_id", "fingerprint", "component_id"]
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert {r["component_id"] for k in (1, 5) for r in by[k]} == {1}
    assert {by[k][0]["component_id"] for k in (2, 3, 7)} == {2} and by[2][0]["fingerprint"] == "0" * 16
    assert by[None][0]["component_id"] is None
    assert simhash.simhash_groups(docs.limit(0)).collect() == []


def test_one_of_each_group_stays(spark):
    docs = odd_docs(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 2, 4, 9]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0
    many = spark.createDataFrame([(k, "same text of five words here", "en", "s", 1) for k in range(50)], DOCS)
    assert [r["doc_id"] for r in simhash.drop_near_duplicates(many).collect()] == [0]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 299)]
    df = spark.createDataFrame(links, "a long, b long").union(spark.sql("SELECT CAST(NULL AS LONG), 5L"))
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, **{k: 100 for k in range(101, 160)}, 300: 299}
    assert connected_components(df.filter(F.lit(False))).count() == 0


def test_forest_keeps_the_components():
    rng = np.random.default_rng(0)
    f = Forest(500)
    f.MOST = 100
    i, j = rng.integers(0, 500, 400), rng.integers(0, 500, 400)
    for k in range(0, 400, 10):
        f.add(i[k : k + 10], j[k : k + 10])
    a, b = f.star()
    assert (label(500, a, b) == label(500, i, j)).all() and len(a) < 500


@pytest.mark.parametrize("most", [50, 400_000])
def test_thinned_links_keep_the_components(spark, most):
    rng = np.random.default_rng(1)
    links = [(1000 + n, h) for n in range(300) for h in rng.permutation(12)[:8].tolist()] + [(5000 + k, 5001 + k) for k in range(60)] + [(3, 3)]
    df = spark.createDataFrame(links, "a long, b long").union(spark.sql("SELECT CAST(NULL AS LONG), 5L")).repartition(3)
    thin = thinned(df, most=most)
    got, want = ({r["node"]: r["root"] for r in connected_components(x).collect()} for x in (thin, df))
    assert got == want and thin.count() < (len(links) if most == 50 else 300 + 4 * 12 + 2 * 60)
    assert thinned(df.filter(F.lit(False))).count() == 0


def test_a_group_that_meets_in_many_buckets_has_few_links(spark, monkeypatch):
    r = random.Random(3)
    words = [f"w{r.random()}" for _ in range(300)]
    rows = [(k, " ".join(words[:n] + [f"x{k}"] + words[n + 1 :]), "en", "s", 1) for k in range(400) for n in [r.randrange(300)]]
    monkeypatch.setattr(simhash, "TILE", 64)
    links = []
    held = components_module.materialize
    monkeypatch.setattr(components_module, "materialize", lambda df, label: (out := held(df, label), links.append(out.count()))[0])
    assert [d["doc_id"] for d in simhash.drop_similar(spark.createDataFrame(rows, DOCS)).collect()] == [0]
    assert links[0] <= 4 * len(rows)
