import base64
import gzip
import hashlib
import io
import zlib

import numpy as np
import pytest

from weftgraph.llm import _common, packing, warc
from weftgraph.llm.queries import tokenizer_file

from .helpers import DOCS, odd_docs

PAGES = "page_id long, url string, html string, record_type string, digest string"


def pages(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "http://d/\r\nX: y", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 3), (6, "u", "z" * 3_000_000), (None, "u", "<p>x</p>"), (None, "u", "lonely"), (9, "u", "twice"), (9, "u", "twice"), (10, "u", "z" * 3_000_000)]
    return spark.createDataFrame([(*r, "mine", "mine") for r in rows], PAGES)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("least,archive", [(0, 1 << 26), (0, 100), (9, 1000)])
def test_round_trip(spark, tmp_path, least, archive):
    src = pages(spark)
    listed = warc.write_archives(src, f"file://{tmp_path}/w", least_bytes=least, archive_bytes=archive)
    got = warc.read_archives(listed, with_payload=True).collect()
    assert len(got) == src.count() == listed.agg({"records": "sum"}).first()[0]
    html = {}
    for r in src.collect():
        html.setdefault(r["page_id"], r["html"] or "")
    largest = {}
    for k, h in html.items():
        if k is not None and len(h.encode()) >= least:
            largest[h] = max(k, largest.get(h, k))
    for r in got:
        if r["page_id"] is None:
            continue
        k = int(r["page_id"])
        h = html[k]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(h.encode()), digest(h))
        first = largest.get(h, k)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == k else ("revisit", str(first)))
        assert (bytes(r["payload"]).decode() == h) if first == k else r["payload"] is None
    none = sorted((r["record_type"], r["refers_to"]) for r in got if r["page_id"] is None and r["record_type"] == "revisit")
    assert none == ([("revisit", "2")] if least == 0 else [])


def test_query_shape_and_empty_table(spark):
    out = warc.warc_round_trip(pages(spark))
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and out.count() == 11
    assert warc.warc_round_trip(pages(spark).limit(0)).collect() == []


def archive():
    return b"".join(warc.member(warc.record(k, f"http://h/{k}", (f"payload {k} " * k * 50).encode())) for k in range(1, 30))


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 18])
def test_reader_takes_any_pieces(size):
    got = list(warc.read_records(io.BytesIO(archive()), size))
    assert [h["warc-record-id"] for h, _ in got] == [f"<urn:page:{k}>" for k in range(1, 30)]
    assert all(warc.payload_of(h, b)[0] == len(f"payload {k} " * k * 50) for k, (h, b) in enumerate(got, 1))


def test_members_are_plain_gzip():
    assert gzip.decompress(archive()).count(b"WARC/1.1\r\n") == 29


def test_damage_is_found():
    good = archive()
    broken = warc.record(1, "u", b"hello").replace(b"hello", b"hellO")
    cases = [good[:-3], good[:10], b"plain text", warc.member(broken), warc.member(b"no version\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), warc.member(warc.record(1, "u", b"x") + b"more"), warc.member(warc.record(1, "u", b"xy").replace(b"Content-Length: 4", b"Content-Length: 1", 1))]
    for data in cases[:-1]:
        with pytest.raises(warc.BadRecord):
            list(warc.read_records(io.BytesIO(data)))


# -- packing -------------------------------------------------------------------------------


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    return [np.array([*e.ids, 1], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD_TEXTS = ["", None, " ", "Hello, World. It's 3.14!", "ΣΑΣ. İx, É. é, <|endoftext|>. <|EndOfText|>", "a., x,. ß. ﬁ. Å,  x y.\x1cz \t\r\n.", "²,½.①,", "É" * 3 + ". foo<|startoftext|>bar, Baz.", "日本語のテキスト。", "🙂🙂 ok.", "x" * 5000, "don't WE'LL they've. 's 't", "_a_. b_, c-d. e.f, ..", "\x00\x01. �"]


def test_encoder_equals_the_tokenizer():
    coder = packing.Encoder(tokenizer_file())
    assert coder.encode(ODD_TEXTS) == [x[:-1].tobytes() for x in whole_ids(ODD_TEXTS)]
    coder.words.clear()
    assert coder.encode(ODD_TEXTS) == [x[:-1].tobytes() for x in whole_ids(ODD_TEXTS)]


def test_encoder_of_another_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    coder, whole = packing.Encoder(path), Tokenizer.from_file(path)
    assert not coder.by_words and packing.Encoder(tokenizer_file()).by_words
    assert coder.encode(ODD_TEXTS) == [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch([x or "" for x in ODD_TEXTS], add_special_tokens=False)]


def check_packing(rows, ids, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == s[0]["capacity"] and (at == capacity or at & (at - 1) == 0) and at <= capacity
    assert sum(r["length"] for r in rows) == sum(map(len, ids))


@pytest.mark.parametrize("capacity,pool", [(2048, packing.POOL), (16, 100), (7, 50)])
def test_every_id_lies_in_one_piece(spark, capacity, pool):
    texts = [*ODD_TEXTS, *(f"some words {k} " * (k % 40) for k in range(120))]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOCS).repartition(3)
    rows = packing.pack(docs, tokenizer_file(), capacity, pool=pool, with_ids=True).collect()
    ids = whole_ids(texts)
    check_packing(rows, ids, capacity)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert sorted(by) == list(range(len(texts)))
    for k, mine in by.items():
        at = 0
        for r in sorted(mine, key=lambda r: r["start"]):
            part = ids[k][at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids[k])
            assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["ids"] == part.tolist()
            at += r["length"]
        assert at == len(ids[k])


def test_packing_odd_rows(spark):
    docs = odd_docs(spark)
    rows = packing.pack(docs, tokenizer_file()).collect()
    check_packing(rows, whole_ids([r["text"] for r in docs.collect()]), 2048)
    assert sum(r["doc_id"] == 5 and r["start"] == 0 for r in rows) == 2
    assert packing.pack(docs.limit(0), tokenizer_file()).collect() == []


def test_descending_pieces_go_to_the_cheapest_sequence():
    parts = packing.balance([4, 3, 2, 1], [5, 5], 1.0, 1.0)
    assert parts == [[(0, 4, 0, 0)], [(0, 3, 1, 0)], [(0, 2, 1, 3)], [(0, 1, 0, 4)]]
    cut = packing.balance([4, 4, 2], [5, 5], 1.0, 1.0)
    assert sum(n for p in cut for _, n, _, _ in p) == 10 and len(cut[2]) == 2
    assert packing.room_for(2048 * 2 + 13, 2048) == [2048, 2048, 8, 4, 1] and packing.room_for(0, 2048) == []


def test_costs_are_balanced():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 300, 4000).tolist()
    rooms = packing.room_for(sum(lengths), 2048)
    cost = np.zeros(len(rooms))
    for p in packing.balance(lengths, rooms, 1.0, 0.01):
        for _, n, s, _ in p:
            cost[s] += n + 0.01 * n * n
    full = cost[: sum(r == 2048 for r in rooms)]
    assert full.std() / full.mean() < 0.2


def test_encoder_keeps_words_that_come_again(monkeypatch):
    coder, looked = packing.Encoder(tokenizer_file()), []
    coder.words.clear()
    monkeypatch.setattr(packing, "WORDS", 60)
    monkeypatch.setattr(coder, "look_up", lambda words, f=coder.look_up: (looked.extend(words), f(words)))
    for k in range(30):
        texts = ["often, often", " ".join(f"new{k}x{i}" for i in range(10))]
        assert coder.encode(texts) == coder.encode_whole(texts)
        assert len(coder.words) + len(coder.old) <= 60
    assert looked.count("often") == 1
    many = [" ".join(f"w{i}" for i in range(200))]  # more than there is room for
    assert coder.encode(many) == coder.encode_whole(many)
    assert coder.encode(["often, often"]) == coder.encode_whole(["often, often"])


def test_workers_keep_nothing_for_other_operators():
    def task(batches):
        _common.per_process("other:2", dict)
        yield from batches

    _common.per_process("mine:1", lambda: "kept")
    assert list(_common.tidy(task, "mine:1")([1, 2])) == [1, 2]
    assert _common.per_process("mine:1", lambda: "made again") == "kept"
    list(_common.tidy(task)([]))
    assert _common.per_process("mine:1", lambda: "made again") == "made again"
    _common.release()
