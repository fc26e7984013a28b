"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from .ann import nearest
from .embedding_dedup import near_vectors
from .lm_score import score_documents
from .mixing import LAST, STEP, mix_sources
from .packing import pack
from .pii import KINDS, find_pii
from .sharding import minimax_shards
from .simhash import simhash_groups
from .toxicity import held_out, score_toxicity
from .warc import warc_round_trip


def op1_ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, (lambda k: lambda s: s == k)(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written("base_spans"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(table(spark, sf_dir, "documents"), min_count=2)
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file(), capacity=2048)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, table(spark, sf_dir, "labels"), threshold=0.3)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), words=3, radius=3)


def op9_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minimax_shards(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH held AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
total AS (SELECT sum(w) AS all_w, sum(n) AS all_n FROM held),
rates AS (SELECT source, all_n * w / all_w / n AS rate FROM held, total),
drawn AS (SELECT source, rate, greatest(1, ceil(rate / {STEP}))::INT AS draws FROM rates),
terms AS (
  SELECT source, draws, k, exp(-(rate / draws) + k * ln(rate / draws) - lgamma(k + 1)) AS p
  FROM drawn, range({LAST + 1}) AS r(k)
),
cdf AS (SELECT source, draws, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
lists AS (SELECT source, draws, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source, draws),
hashed AS (
  SELECT d.*, l.cdf, ('0x' || substr(md5('17:' || d.doc_id || ':' || i), 1, 13))::BIGINT / {float(2**52)} AS u
  FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source, range(1, 1 + l.draws) AS t(i)
),
counted AS (
  SELECT doc_id, text, lang, source, n_chars, sum(len(list_filter(cdf, lambda c: u >= c)))::BIGINT AS n
  FROM hashed GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, replica::INT AS replica,
  md5('17:order:' || doc_id || ':' || replica) AS shuffle_key
FROM counted, range(1, 1 + n) AS t(replica)
"""

OP6_SQL = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws
  FROM documents
),
toks AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split),
one AS (SELECT w, count(*) AS c FROM toks GROUP BY w),
total AS (SELECT sum(c) AS n FROM one),
pairs AS (SELECT a.doc_id, a.w AS v, b.w AS w FROM toks a JOIN toks b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
two AS (SELECT v, w, count(*) AS c FROM pairs GROUP BY v, w HAVING count(*) >= 2),
terms AS (
  SELECT p.doc_id, CASE WHEN t.c IS NOT NULL THEN ln(t.c) - ln(o.c) ELSE ln(0.4) + ln(k.c) - ln(total.n) END AS s
  FROM pairs p LEFT JOIN two t ON t.v = p.v AND t.w = p.w JOIN one o ON o.w = p.v JOIN one k ON k.w = p.w, total
  UNION ALL
  SELECT k.doc_id, ln(o.c) - ln(total.n) FROM toks k JOIN one o USING (w), total WHERE k.i = 1
),
sums AS (SELECT doc_id, sum(s) AS s FROM terms GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, round(coalesce(s.s, 0.0), 4) AS log_score,
  CASE WHEN len(d.ws) > 0 THEN round(s.s / len(d.ws), 6) END AS mean_log_score
FROM split d LEFT JOIN sums s USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ivfpq_search": op1_ivfpq_search,
    "op2_crf_pii": op2_crf_pii,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op3_cost_packing": op3_cost_packing,
    "op5_warc": op5_warc,
    "op6_lm_score": op6_lm_score,
    "op7_toxicity": op7_toxicity,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_minimax_sharding": op9_minimax_sharding,
    "op10_source_mixing": op10_source_mixing,
}
ORACLE_SQL: dict[str, str] = {"op6_lm_score": OP6_SQL, "op10_source_mixing": OP10_SQL}
