import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import lm_score, pii, toxicity

from .helpers import DOCS, odd_docs

# -- personal data -------------------------------------------------------------------------


def plain_base(text):
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), "card", m.end()))
    out += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[1])))


FIXED = ["a@b.c", "@b.c", "a@b", "a@b.c@d.e", "a@b.cd_x@y.z", "x..y@z-.q.r-", "é@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.0003.4", "1..2.3.4", "+1 (234) 555-0199.", "+1 2", "+123456789012345678", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "0" * 40, "+1.2.3.4.5.6.7.8.9", "𝟙 a@b.c 10.0.0.1", "a@b.c.@d.e.f", "a" * 3000 + "@" + "b" * 3000, "9" * 5000]


def test_base_spans_equal_the_patterns():
    r = random.Random(4)
    texts = FIXED + ["".join(r.choice("ab@@..--++%_  ()0123456789é\n") for _ in range(r.randint(0, 120))) for _ in range(4000)]
    for t in texts:
        assert pii.base_spans(t) == plain_base(t), t


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.labelled_table())


def test_field_on_held_out_sentences(field):
    rows = pii.labelled_table(5, seed=1234)
    got = field.decode([[pii.EDGE, *(field.class_of(t) for t in tokens), pii.EDGE] for tokens, _ in rows])
    right = [pii.LABELS[x] == y for (_, labels), g in zip(rows, got) for x, y in zip(g, labels)]
    assert np.mean(right) > 0.985


def test_viterbi_equals_all_labellings(field):
    import itertools

    rng = np.random.default_rng(0)
    emit = rng.normal(size=(6, 4, 5))
    sizes = np.array([4, 3, 1, 4, 2, 4])
    got = field.viterbi(emit, sizes)
    for i, n in enumerate(sizes):
        value = lambda ls: sum(emit[i, t, x] for t, x in enumerate(ls)) + field.pair[0, ls[0]] + field.pair[ls[-1], 0] + sum(field.pair[a, b] for a, b in zip(ls, ls[1:]))  # noqa: B023, E731
        assert tuple(got[i, :n]) == max(itertools.product(range(5), repeat=n), key=value)


def test_windows_decode_like_whole_texts(field):
    assert field.local
    whole = pii.Field(field.names, field.own, field.before, field.after, field.pair)
    whole.local = False
    r = random.Random(8)
    bank = ["w", "call", "at", "dot", "com", "tel", "host", "net", "contact", "555-123-4567", "(017)", "x@y.org", "10.0.0.1", "2021", "(at)", "jane", "1234567", "4111111111111111", "phone:", "|", "page"]
    texts = [" ".join(r.choice(bank if r.random() < 0.4 else ["w", "word", "|"]) for _ in range(r.randint(1, 80))) for _ in range(600)]
    assert pii.find_spans(texts, field) == pii.find_spans(texts, whole)


def test_added_spans_and_redaction(field):
    cases = {"call (017) 555-7713 now": ["phone"], "contact john at mail dot com today": ["email"], "order 473696257 of 2021, version 1.2.3": [], "2353820953013749 4111111111111111 x": ["card"]}
    for text, kinds in cases.items():
        ((base, spans),) = pii.find_spans([text], field)
        assert [k for _, k, _ in spans] == kinds and set(base) <= set(spans)
    assert pii.redact("ab a@b.c, x", [(3, "email", 8)]) == "ab [EMAIL], x"
    assert pii.redact("0123456789", [(0, "ip", 5), (3, "phone", 8)]) == "[IP]89"


def test_pii_odd_rows(spark):
    docs = odd_docs(spark, [(20, "é a@b.cd 10.0.0.1", "en", "a", 1)])
    got = pii.find_pii(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["redacted"] is None and by[3]["redacted"] == "" and by[2]["spans"] == []
    assert [tuple(s) for s in by[20]["base_spans"]] == [(2, "email", 8), (9, "ip", 17)] and by[20]["redacted"] == "é [EMAIL] [IP]"
    assert pii.find_pii(docs.limit(0)).collect() == []
    assert by[20]["score"] == "mine"


# -- toxicity ------------------------------------------------------------------------------


def corpus(n, seed):
    r = random.Random(seed)
    clean = ["".join(r.choice(("ta", "ri", "mo", "len", "so", "ke", "bu")) for _ in range(r.randint(1, 4))) for _ in range(800)]
    ends = ["a", "er", "ing", "o", "lich", "ette", "um", "y", "ax", "ij"]
    out = []
    for k in range(n):
        words = [r.choice(clean) for _ in range(r.randint(5, 300))]
        bad = k % 5 == 0
        if bad:
            for _ in range(1 + len(words) // 50):
                words[r.randrange(len(words))] = r.choice(("vexq", "grzd", "idiw")) + r.choice(ends)
        out.append((k, " ".join(words), int(bad)))
    return out


def test_toxicity_on_held_out_rows_and_unseen_endings(spark):
    rows = corpus(1500, 1)
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score_toxicity(docs, labels, model=model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    want = {k: y for k, _, y in rows}
    held = [r for r in got if r["held"]]
    assert len(held) > 200 and np.mean([r["predicted"] == want[r["doc_id"]] for r in held]) > 0.97
    fresh = ["tari vexqophan mo len so", "so ke grzdwhich ri", "ta ri mo len so ke bu " * 40]
    scores = model.score(fresh, {})
    assert scores[0] > 0.3 and scores[1] > 0.3 and scores[2] < 0.3


def test_held_out_rows_are_never_learned(spark):
    import zlib

    rows = corpus(300, 2)
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t, _ in rows], DOCS)
    make = lambda flip: spark.createDataFrame([(k, 1, 1 - y if flip and zlib.crc32(str(k).encode()) % 4 == 2 else y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    a, b = toxicity.fit(docs, make(False)), toxicity.fit(docs, make(True))
    assert (a.gram == b.gram).all() and a.bias == b.bias


def test_toxicity_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, 1), (4, 1, 0), (4, None, None), (9, 1, 0), (None, 1, 1), (5, 1, 7)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert got[0].__fields__.count("score") == 1
    assert all(r["predicted"] == 0 for r in toxicity.score_toxicity(docs, labels.limit(0)).collect())
    assert toxicity.score_toxicity(docs.limit(0), labels).collect() == []


def test_windows_cover_all_words():
    for n in range(1, 200):
        a, b = toxicity.window_bounds(n)
        assert set(range(n)) == {i for x, y in zip(a, b) for i in range(x, y)}


def test_scores_do_not_depend_on_the_cache():
    rows = corpus(60, 3)
    model = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows], epochs=3)
    texts = [t for _, t, _ in rows]
    whole = model.score(texts, {})
    old, toxicity.CACHE = toxicity.CACHE, 50
    try:
        cache = {}
        assert np.allclose([model.score([t], cache)[0] for t in texts], whole)
    finally:
        toxicity.CACHE = old


# -- language model ------------------------------------------------------------------------


def brute_scores(docs, texts, least):
    words = lambda t: (t or "").lower().split()
    one = Counter(w for t in texts for w in words(t))
    two = Counter(p for t in texts for p in zip(words(t), words(t)[1:]))
    total = sum(one.values())
    out = {}
    for k, t in docs:
        w, s = words(t), 0.0
        for i, x in enumerate(w):
            if i == 0:
                s += math.log(max(one[x], 1) / total)
            else:
                pair = two[w[i - 1], x]
                s += math.log(pair / one[w[i - 1]]) if pair >= least and pair else math.log(0.4 * max(one[x], 1) / total)
        n, v = out.get(k, (0, 0.0))
        out[k] = (n + len(w), v + s)
    return out


@pytest.mark.parametrize("own,least", [(True, 1), (True, 2), (False, 1)])
def test_scores_equal_brute_force(spark, own, least):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    corpus_rows = ["the quick word word brown", "fox jumps over the lazy dog"]
    other = None if own else spark.createDataFrame([(k, t) for k, t in enumerate(corpus_rows)], "doc_id long, text string")
    want = brute_scores(rows, [t for _, t in rows] if own else corpus_rows, least)
    got = lm_score.score_documents(docs, other, min_count=least).collect()
    assert {r["doc_id"] for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, s = want[r["doc_id"]]
        assert r["n_words"] == n and r["log_score"] == pytest.approx(s, abs=1e-6)
        assert r["mean_log_score"] == (pytest.approx(s / n) if n else None)
    assert lm_score.score_documents(docs.limit(0)).collect() == []


@pytest.mark.parametrize("chunk,entries", [(3, 1_000_000), (200_000, 7), (50, 40)])
def test_chunks_and_partitions_change_nothing(spark, monkeypatch, chunk, entries):
    monkeypatch.setattr(lm_score, "CHUNK", chunk)
    monkeypatch.setattr(lm_score, "ENTRIES", entries)
    rows = [(k, f"of the w{k} of the" if k % 7 else "") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (1, 2):
        got = {r["doc_id"]: r["log_score"] for r in lm_score.score_documents(docs, min_count=least).collect()}
        for k, (_, s) in brute_scores(rows, [t for _, t in rows], least).items():
            assert got[k] == pytest.approx(s)


def test_frequent_ngrams_come_once_a_chunk(spark):
    docs = spark.createDataFrame([(k, "of the " * 50 + f"w{k}") for k in range(300)], "doc_id long, text string").coalesce(1)
    rows = lm_score.exploded(lm_score.chunks_of(docs, "doc_id", "text"), 2, 4, True, True).selectExpr("explode(arrays_zip(keys, n)) AS x").select("x.*")
    most = rows.groupBy("keys").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).orderBy(F.desc("n")).first()
    assert most["n"] == 300 * 50 and most["rows"] == 1


def plain_score(model, text):
    """Windows, words and n-grams one by one."""
    words = []
    for w in re.findall(r"\w+", (text or "").lower()):
        if w not in words:
            words.append(w)
    value = {}
    for w in words:
        bucket, _ = toxicity.word_grams([w])
        value[w] = sum(float(model.gram[b]) for b in bucket) / len(bucket)
    starts = range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE) if words else []
    best = max((sum(value[w] for w in words[s : s + toxicity.WINDOW]) / max(len(words[s : s + toxicity.WINDOW]), toxicity.LEAST) for s in starts), default=0.0)
    return 1 / (1 + np.exp(-(best + model.bias)))


def test_toxicity_scores_equal_a_plain_loop():
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BUCKET_BITS), -0.5)
    r = random.Random(2)
    texts = [None, "", "!?", "word", "Word WORD word", *(" ".join(r.choice(["ab", "abc", "xyzzy", "é", "über", f"w{r.randrange(500)}"]) for _ in range(n)) for n in (5, 15, 16, 17, 31, 32, 33, 48, 49, 400))]
    assert np.allclose(model.score(texts, {}), [plain_score(model, t) for t in texts], rtol=1e-9)


def test_toxicity_gradients_equal_differences():
    rng = np.random.default_rng(6)
    vocab = ["ab", "abc", "abd", "zz", "word", "wird", "ab"[::-1]]
    grams = toxicity.Grams(vocab)
    vec, soft, bias = rng.normal(0, 0.1, (1 << toxicity.BUCKET_BITS, toxicity.DIM)), rng.normal(0, 0.3, (toxicity.DIM, 2)), np.array([0.3, -0.2])
    ids, n, y, weight = np.array([0, 1, 4, 2, 2, 5, 6, 3]), np.array([3, 1, 4]), np.array([1, 0, 1]), np.array([0.5, 1.0, 0.25])

    def loss():
        out, at = 0.0, 0
        for k, size in enumerate(n):
            mean = np.zeros(toxicity.DIM)
            for w in ids[at : at + size]:
                mean += vec[toxicity.word_grams([vocab[w]])[0]].mean(axis=0) / max(size, toxicity.LEAST)
            z = toxicity.GAIN * (mean @ soft) + bias
            out -= weight[k] * (z[y[k]] - np.log(np.exp(z).sum()))
            at += size
        return out

    hit, g_vec, g_soft, g_bias = toxicity.gradients(vec, soft, bias, grams, ids, n, y, weight)
    assert set(hit) == {b for w in set(ids.tolist()) for b in toxicity.word_grams([vocab[w]])[0]}
    for array, at, want in [(vec, (hit[k], d), g_vec[k, d]) for k in range(0, len(hit), 3) for d in (0, 5)] + [(soft, (2, 1), g_soft[2, 1]), (bias, (0,), g_bias[0])]:
        held = array[at]
        array[at] = held + 1e-5
        up = loss()
        array[at] = held - 1e-5
        down = loss()
        array[at] = held
        assert (up - down) / 2e-5 == pytest.approx(want, rel=1e-4, abs=1e-8)


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text").join(labels, "doc_id"), labels).filter(toxicity.held_out(F.col("doc_id")))
    got = {(r["toxic"], r["predicted"]): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    # Some 360 toxic documents are there to learn from, an eighth of what training would take.
    assert got.get((0, 1), 0) <= 0.02 * (got[0, 0] + got.get((0, 1), 0)) and got[1, 1] >= 0.65 * (got[1, 1] + got.get((1, 0), 0))


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "x" * 10) for k in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append((texts, y)))
    toxicity.fit(docs, labels, chars=55)
    toxicity.fit(docs, labels, per_class=3)
    assert [y.count(1) for _, y in seen] == [5, 3] and [y.count(0) for _, y in seen] == [5, 3]
