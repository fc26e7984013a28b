"""The registered queries against their SQL, and the pipeline stage by stage."""

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import queries

from .helpers import components, odd_docs, pairs
from .test_shingles import exact, jaccard


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    out = con.sql(queries.ORACLE_SQL[name])
    cols = sorted(out.columns)
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == cols
    at = [out.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[i] for i in at)) for r in out.fetchall()) == sorted(repr(tuple(r)) for r in df.select(*cols).collect())


SHAPES = {
    "op1_ivfpq_search": ["query_id", "rank", "vec_id", "score"],
    "op2_crf_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op3_cost_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op4_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op5_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op6_lm_score": ["doc_id", "n_words", "log_score"],
    "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_simhash_dedup": ["doc_id", "fingerprint", "component_id"],
    "op9_minimax_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op10_source_mixing": ["doc_id", "text", "source", "replica", "shuffle_key"],
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_columns(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert [c for c in df.columns if c in SHAPES[name]] == SHAPES[name] and df.count() > 0


def test_sharding_digests(spark, sf_dir):
    rows = queries.op9_minimax_sharding(spark, sf_dir).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in rows)


def test_pii_digest(spark, sf_dir):
    import hashlib

    from weftgraph.llm.pii import base_spans, joined

    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op2_crf_pii(spark, sf_dir).collect():
        base = base_spans(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for _, k, _ in base) for x in ("email", "ip", "card", "phone")]
        assert set(joined(base).split(",")) <= set(r["spans"].split(",")) or not base


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = kept[name] = spark.read.parquet(f"{tmp_path}/{k}")
        assert name == "packing" or docs.columns == start.columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(kept["toxicity"]) < ids(start) and len(ids(kept["toxicity"])) > 0.85 * start.count()
    rows = [(r["doc_id"], exact(r["text"])) for r in kept["toxicity"].collect()]
    links = [(rows[a][0], rows[b][0]) for a, b in pairs(len(rows)) if jaccard(rows[a][1], rows[b][1]) >= 0.8]
    assert ids(kept["near_duplicates"]) == set(components([i for i, _ in rows], links).values())
    assert kept["near_duplicates"].count() == len(ids(kept["near_duplicates"]))
    assert ids(kept["personal_data"]) == ids(kept["near_duplicates"])
    assert kept["personal_data"].filter(F.col("text").rlike(r"[\w.+-]+@[\w-]+\.\w")).count() == 0
    assert kept["personal_data"].filter("n_chars <> length(text)").count() == 0
    assert ids(kept["packing"]) == ids(kept["mixing"]) <= ids(kept["personal_data"])
    total = kept["mixing"].count()
    assert kept["packing"].filter("start = 0").count() == total
    assert corpus_pipeline.run(spark, sf_dir).count() == kept["packing"].count()


def test_stages_take_odd_rows(spark, sf_dir):
    docs = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, sf_dir)
            assert (out.count() > 0) == (rows is docs)
            assert name == "packing" or out.columns == docs.columns
