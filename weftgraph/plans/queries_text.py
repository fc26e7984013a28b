"""Queries over texts: tokens, weights, search and redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import filters, text, vectors
from . import starschema as star
from .shared import materialize, spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


HUMPS = "regexp_replace(regexp_replace({}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
TOKENS = "list_filter(regexp_split_to_array(lower(" + HUMPS + "), '[^a-z0-9]+'), lambda t: length(t) >= 2)"
TERMS = f"""
toks AS (SELECT doc_id, {TOKENS.format("text")} AS ts FROM documents),
each_ AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM toks),
tf AS (SELECT doc_id, term, count(*)::DOUBLE / any_value(n) AS tf FROM each_ GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
idf AS (SELECT term, df, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1)) + 1 AS idf FROM df)"""


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(star.table(spark, sf, "documents"))


@query(f"SELECT doc_id, len({TOKENS.format('text')})::INT AS n_tokens, len(list_distinct({TOKENS.format('text')}))::INT AS n_distinct FROM documents")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("doc_id", scalars.tokens(F.col("text")).alias("ts"))
    return d.select("doc_id", F.size("ts").alias("n_tokens"), F.size(F.array_distinct("ts")).alias("n_distinct"))


@query(f"WITH {TERMS} SELECT term, df::BIGINT AS df, round(idf, 9) AS idf FROM idf")
def doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    _, vocab = vectors.tfidf(_docs(spark, sf), "doc_id", F.col("text"))
    return vocab.select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"""WITH {TERMS}, w AS (SELECT doc_id, term, round(tf * idf, 9) AS weight FROM tf JOIN idf USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS n FROM w) SELECT doc_id, term, weight FROM r WHERE n <= 3""")
def tfidf_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    weights, _ = vectors.tfidf(_docs(spark, sf), "doc_id", F.col("text"))
    w = weights.select(F.col("id").alias("doc_id"), "term", F.round("weight", 9).alias("weight"))
    return filters.top_per_group(w, ["doc_id"], [F.desc("weight"), F.col("term")], 3)


POSTINGS = """
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS term FROM documents) GROUP BY 1, 2)"""


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(text.postings(_docs(spark, sf), "doc_id", ("text",)), "postings")


@query(f"WITH {POSTINGS} SELECT term, count(*)::BIGINT AS docs, sum(tf)::BIGINT AS occurrences FROM post GROUP BY 1")
def fts_postings(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


@query(f"""WITH {POSTINGS}, len_ AS (SELECT doc_id, sum(tf)::DOUBLE AS l FROM post GROUP BY 1), agg AS (SELECT count(*)::DOUBLE AS n, avg(l) AS m FROM len_),
hits AS (SELECT p, doc_id, sum(tf)::DOUBLE AS tf FROM post, (VALUES ('the'), ('thtion')) q(p) WHERE starts_with(term, p) GROUP BY 1, 2),
df AS (SELECT p, count(*) AS df FROM hits GROUP BY 1),
parts AS (SELECT doc_id, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m)) AS s FROM hits JOIN df USING (p) JOIN len_ USING (doc_id), agg)
SELECT doc_id AS node_id, round(sum(s), 6) AS score FROM parts GROUP BY 1 HAVING count(*) = 2""")
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    return text.bm25(_index(spark, sf), "the thtion").select("node_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'idiot')")
def like_search(spark: SparkSession, sf: str) -> DataFrame:
    return text.like(_docs(spark, sf), "Idiot", ("text",)).select("doc_id", "lang")


def _sql_redaction() -> tuple[str, str]:
    """Text and count of the secrets' patterns, one after the other, then of the masked names; a
    pattern with a back reference is written out for each quotation mark."""
    quote = lambda s: s.replace("'", "''")
    now, count = "text", "0"
    for p, label in text.SECRETS:
        count += f" + len(regexp_extract_all({now}, '{quote(p)}'))"
        now = f"regexp_replace({now}, '{quote(p)}', '[{label}]', 'g')"
    for q in ('"', "'"):
        p = f"(?i)({text.SENSITIVE})\\s*[:=]\\s*{q}([^\\n]+?){q}"
        count += f" + len(regexp_extract_all({now}, '{quote(p)}'))"
        now = f"regexp_replace({now}, '{quote(p)}', '\\1 = \"[REDACTED]\"', 'g')"
    return now, count


REDACTED, REDACTIONS = _sql_redaction()


@query(f"SELECT doc_id, md5({REDACTED}) AS digest, ({REDACTIONS})::INT AS redactions FROM documents")
def redact_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("doc_id", text.redact(F.col("text")).alias("r"))
    return d.select("doc_id", F.md5("r.text").alias("digest"), F.col("r.redaction_count").alias("redactions"))


@query(f"SELECT source, sum({REDACTIONS})::BIGINT AS redactions, count(*) FILTER (({REDACTIONS}) > 0)::BIGINT AS documents FROM documents GROUP BY 1")
def redaction_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("source", text.redact(F.col("text")).alias("r"))
    return d.groupBy("source").agg(F.sum(F.col("r.redaction_count").cast("long")).alias("redactions"), F.sum(F.col("r.had_redactions").cast("long")).alias("documents"))


@query("SELECT p_partkey, lower(regexp_replace(regexp_replace('HTTPServer' || replace(p_brand, '#', '') || 'FieldName', '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z\\d])([A-Z])', '\\1_\\2', 'g')) AS snake FROM part")
def snake_case(spark: SparkSession, sf: str) -> DataFrame:
    p = star.table(spark, sf, "part")
    return p.select("p_partkey", scalars.snake_case(F.concat(F.lit("HTTPServer"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("FieldName"))).alias("snake"))


@query("SELECT doc_id, substr(sha256(source || '::' || lang || '::' || doc_id), 1, 12) AS id, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    return d.select("doc_id", scalars.digest(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("id"), scalars.fingerprint(F.col("text").cast("binary")).alias("content_hash"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'python' WHEN page_id % 4 = 1 THEN 'typescript' WHEN page_id % 4 = 2 THEN 'ruby' END AS language,
CASE WHEN page_id % 4 = 3 THEN '.' ELSE 'src/' || page_id END AS dir FROM pages""")
def path_functions(spark: SparkSession, sf: str) -> DataFrame:
    p = star.table(spark, sf, "pages").select("page_id")
    i = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("src/"), i, F.lit("/a.py"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("src/"), i, F.lit("/b.TSX"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("src/"), i, F.lit("/c.rake"))).otherwise("README")
    return p.select("page_id", scalars.language_of(path).alias("language"), scalars.dirname(path).alias("dir"))


@query("SELECT item_id, trim(text) AS cleaned FROM benchmark")
def clean_comments(spark: SparkSession, sf: str) -> DataFrame:
    b = star.table(spark, sf, "benchmark")
    return b.select("item_id", scalars.clean_comment(F.concat(F.lit("/** "), F.trim("text"), F.lit(" */"))).alias("cleaned"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 37) || '...' ELSE text END AS short, substr(text, 1, 200) AS summary FROM documents")
def truncate_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    return d.select("doc_id", scalars.ellipsis(F.col("text"), 40).alias("short"), F.substring("text", 1, 200).alias("summary"))


@query("SELECT s_suppkey, '**' || s_name || '**' || chr(10) || 'Location: s.py:1-3' || chr(10) || 'Complexity: 2' || CASE WHEN s_acctbal >= 0 THEN '' ELSE chr(10) || 'Visibility: private/internal' END || chr(10) || 'Size: 3 lines' AS summary FROM supplier")
def heuristic_summaries(spark: SparkSession, sf: str) -> DataFrame:
    s = star.table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.lit("method").alias("node_type"), F.lit("").alias("signature"), F.lit("").alias("docstring"), F.lit("s.py").alias("file_path"), F.lit(1).alias("line_start"), F.lit(3).alias("line_end"), F.lit(2).alias("complexity"), F.array().cast("array<string>").alias("decorators"), (F.col("s_acctbal") >= 0).alias("is_public"))
    return s.select("s_suppkey", text.detailed_summary().alias("summary"))
