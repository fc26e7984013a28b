"""Sharding and mixing."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import mixing, sharding

from .helpers import DOCS, odd_docs


def brute_capacity(sizes, shards):
    def need(c):
        n, left = 1, c
        for s in sizes:
            if s > c:
                return math.inf
            if s > left:
                n, left = n + 1, c
            left -= s
        return n

    c = max(sizes)
    while need(c) > shards:
        c += 1
    return c


def check_shards(rows, shards):
    groups, texts, slots = defaultdict(int), {}, defaultdict(list)
    for r in rows:
        groups[r["group_key"]] += r["size"]
        assert texts.setdefault(r["group_key"], r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
    order = [texts[k] for k in sorted(groups)]
    assert order == sorted(order) and max(order) < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    loads = Counter()
    for k, s in groups.items():
        loads[texts[k]] += s
    assert max(loads.values()) == brute_capacity([groups[k] for k in sorted(groups)], shards)


@pytest.mark.parametrize("n,shards,digits", [(300, 24, 1), (300, 7, 3), (40, 24, 2), (3, 5, 3)])
def test_minimax_equals_brute_force(spark, monkeypatch, n, shards, digits):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", digits)
    rows = [(i, "t" * (1 + (i * 37) % 91) + str(i % (n // 2 + 1)), "en", "s", 1) for i in range(n)] + [(1000 + i, "hot", "en", "s", 1) for i in range(n // 3)]
    check_shards(sharding.minimax_shards(spark.createDataFrame(rows, DOCS), shards).collect(), shards)


def test_sharding_odd_rows(spark):
    docs = odd_docs(spark)
    rows = sharding.minimax_shards(docs, 4).collect()
    assert len(rows) == docs.count()
    check_shards(rows, 4)
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {8}
    assert sharding.minimax_shards(docs.limit(0), 4).collect() == []


def test_poisson_inversion_and_rates(spark):
    rows = [(i, "t", "en", "big" if i % 10 else "small", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, DOCS)
    rates = {r["source"]: r for r in mixing.source_rates(docs).collect()}
    total = 3600**0.5 + 400**0.5
    assert rates["small"]["rate"] == pytest.approx(4000 * 400**0.5 / total / 400)
    lam = rates["small"]["rate"] / rates["small"]["draws"]
    assert rates["small"]["cdf"][2] == pytest.approx(math.exp(-lam) * (1 + lam + lam * lam / 2))
    got = mixing.mix_sources(docs).groupBy("source").count().collect()
    for r in got:
        want = 4000 * {"big": 3600, "small": 400}[r["source"]] ** 0.5 / total
        assert abs(r["count"] - want) < 5 * want**0.5


def test_large_rates_and_weights(spark):
    docs = spark.createDataFrame([(i, "t", "en", "ab"[i % 2], 1) for i in range(200)], DOCS)
    out = mixing.mix_sources(docs, weights={"a": 1.0}, target_rows=5000).collect()
    assert {r["source"] for r in out} == {"a"}
    assert abs(len(out) - 5000) < 5 * 5000**0.5
    each = Counter(r["doc_id"] for r in out)
    assert sorted(r["replica"] for r in out if r["doc_id"] == out[0]["doc_id"]) == list(range(1, each[out[0]["doc_id"]] + 1))
    spread = sum((c - 50) ** 2 for c in each.values()) / len(each)
    assert 25 < spread < 100  # the variance of a Poisson distribution is its mean


def test_mixing_is_repeatable_and_whole(spark):
    docs = odd_docs(spark)
    a, b = mixing.mix_sources(docs, power=1.0), mixing.mix_sources(docs.repartition(3), power=1.0)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(a) == key(b)
    assert a.columns == [c for c in docs.columns if c not in ("replica", "shuffle_key")] + ["replica", "shuffle_key"]
    assert a.filter(F.col("shuffle_key") == "mine").count() == 0
    assert mixing.mix_sources(docs.limit(0)).collect() == []


def test_many_sources_are_joined(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    docs = spark.createDataFrame([(i, "t", "en", f"s{i % 7}", 1) for i in range(500)], DOCS)
    n = mixing.mix_sources(docs, power=1.0).count()
    assert abs(n - 500) < 5 * 500**0.5
