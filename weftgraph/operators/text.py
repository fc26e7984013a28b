"""Text search and redaction with built-in expressions."""

from __future__ import annotations

import re
import unicodedata
import warnings
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import run_starts, runs
from ..plans.shared import materialize

FTS_FIELDS = ("name", "summary_short", "docstring")
K1, B = 1.2, 0.75  # of BM25


# -- search --------------------------------------------------------------------------------


def _unmarked() -> tuple[str, str]:
    """Letters with marks and what they are without, for letters of one code point."""
    pairs = [(c, [x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)]) for c in map(chr, range(0xC0, 0x2000))]
    held = [(c, base[0]) for c, base in pairs if len(base) == 1 and base[0] != c]
    return "".join(c for c, _ in held), "".join(b for _, b in held)


MARKED, UNMARKED = _unmarked()


def plain(text: str) -> str:
    """Lower case without marks: "Café" is "cafe"."""
    return re.sub(r"[\u0300-\u036f]", "", text.lower().translate(str.maketrans(MARKED, UNMARKED)))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, without marks."""
    bare = F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, UNMARKED), r"[\u0300-\u036f]", "")
    return F.filter(F.split(bare, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def unique(rows: DataFrame, id_col: str) -> bool:
    """Whether no id occurs twice; only ids are shuffled."""
    return rows.groupBy(id_col).agg(F.count("*").alias("__n")).filter("__n > 1").isEmpty()


def counted(rows: DataFrame, column: str) -> DataFrame:
    """rows with x for the array's list of terms: each term (term) and how often it is there (n),
    counted within the row."""
    placed = rows.withColumn(column, F.array_sort(column)).withColumn("__at", run_starts(F.col(column)))
    return placed.withColumn("x", F.explode(runs(F.col(column), F.col("__at")))).drop(column, "__at")


def postings(nodes: DataFrame, id_col: str = "id", fields: tuple[str, ...] = FTS_FIELDS) -> DataFrame:
    """(node_id, term, tf): how often each term occurs in a node's fields. Only where ids repeat
    are counts of several rows added up, in a shuffle."""
    each = nodes.select(F.col(id_col).alias("node_id"), words(F.concat_ws(" ", *fields)).alias("__words"))
    each = counted(each, "__words").select("node_id", "x.term", F.col("x.n").alias("tf"))
    return each if unique(nodes, id_col) else each.groupBy("node_id", "term").agg(F.sum("tf").alias("tf"))


def indexed(nodes: DataFrame, id_col: str = "id", fields: tuple[str, ...] = FTS_FIELDS) -> DataFrame:
    """postings, each with a hash of the text that it is from."""
    text = F.concat_ws(" ", *fields)
    if unique(nodes, id_col):
        each = nodes.select(F.col(id_col).alias("node_id"), F.xxhash64(text).alias("text_hash"), words(text).alias("__words"))
        return counted(each, "__words").select("node_id", "x.term", F.col("x.n").alias("tf"), "text_hash")
    hashed = nodes.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("text_hash"))
    return postings(nodes, id_col, fields).join(hashed, F.col("node_id") == F.col("__id")).drop("__id")


def current_postings(stored: DataFrame, nodes: DataFrame, id_col: str = "id", fields: tuple[str, ...] = FTS_FIELDS) -> DataFrame:
    """Postings of nodes: the stored ones (see indexed) of texts that are as they were, those of
    other nodes made anew. Only the texts' hashes are looked at where nothing changed."""
    now = nodes.select(F.col(id_col).alias("node_id"), F.xxhash64(F.concat_ws(" ", *fields)).alias("text_hash"))
    good = stored.join(now, ["node_id", "text_hash"], "left_semi").select("node_id", "term", "tf")
    known = stored.select("node_id", "text_hash").distinct()
    changed = materialize(now.join(known, ["node_id", "text_hash"], "left_anti").select("node_id"), "changed")  # ids alone; a short list is broadcast
    return good.unionByName(postings(nodes.join(changed, F.col(id_col) == F.col("node_id"), "left_semi"), id_col, fields))


def refresh_postings(old: DataFrame, changed: DataFrame, id_col: str = "id", fields: tuple[str, ...] = FTS_FIELDS) -> DataFrame:
    """Postings with those of the changed nodes made anew."""
    return old.join(changed.select(F.col(id_col).alias("node_id")), "node_id", "left_anti").unionByName(postings(changed, id_col, fields))


def bm25(index: DataFrame, query: str) -> DataFrame:
    """(node_id, score) of the nodes that hold, for every word of the query, a term that begins
    with it. The terms of a prefix count together.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); k1 and b as above; lengths in terms.
    """
    prefixes = sorted({w for w in re.split(r"[\W_]+", plain(query)) if w})
    if not prefixes:
        return index.select("node_id", F.lit(0.0).alias("score")).limit(0)
    tfs = [f"__tf{i}" for i in range(len(prefixes))]
    sums = [F.sum(F.when(F.col("term").startswith(p), F.col("tf")).otherwise(0)).alias(c) for p, c in zip(prefixes, tfs, strict=True)]
    held = materialize(index.groupBy("node_id").agg(F.sum("tf").alias("length"), *sums), "lengths")  # a row of numbers for each node, read twice
    n, mean, *dfs = held.agg(F.count("*"), F.avg("length"), *[F.count_if(F.col(c) > 0) for c in tfs]).first()  # one row
    part = lambda c, df: F.log(1 + (F.lit(float(n)) - F.lit(df) + 0.5) / (F.lit(df) + 0.5)) * F.col(c) * (K1 + 1) / (F.col(c) + K1 * (1 - B + B * F.col("length") / F.lit(float(mean or 1.0))))
    score = reduce(lambda a, b: a + b, [part(c, df) for c, df in zip(tfs, dfs, strict=True)])
    return held.filter(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in tfs])).select("node_id", score.alias("score"))


def like(nodes: DataFrame, query: str, fields: tuple[str, ...]) -> DataFrame:
    """Nodes that hold the query anywhere in the fields, in any case."""
    return nodes.filter(F.lower(F.concat_ws("\n", *fields)).contains(query.lower()))


def search(nodes: DataFrame, index: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The best nodes by BM25, then importance; by substring where BM25 finds none."""
    found = bm25(index, query)
    if found.isEmpty():
        return like(nodes, query, ("name", "summary_short", "docstring", "file_path")).withColumn("score", F.lit(0.0)).orderBy(F.desc("importance"), "id").limit(limit)
    return nodes.join(found, F.col("id") == F.col("node_id")).drop("node_id").orderBy(F.desc("score"), F.desc("importance"), "id").limit(limit)


# -- redaction -----------------------------------------------------------------------------

#: Patterns of secrets and what takes their place, in the order of application.
SECRETS = (
    (r"""(?i)(?:api[_-]?key|token|secret|password|passwd|pwd|auth|credential|private[_-]?key|access[_-]?key|client[_-]?secret)\s*[:=]\s*['"]([^'"]{8,})['"]""", "REDACTED_SECRET"),
    (r"(?:AKIA|ABIA|ACCA|ASIA)[0-9A-Z]{16}", "REDACTED_AWS_KEY"),
    (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "REDACTED_JWT"),
    (r"""(?i)(?:mongodb|postgres|mysql|redis|amqp|mssql)://[^\s'"]+""", "REDACTED_CONN_STRING"),
    (r"-----BEGIN (?:RSA |EC |DSA )?PRIVATE KEY-----", "REDACTED_PRIVATE_KEY"),
    (r"""(?i)(?:DATABASE_URL|SECRET_KEY|ENCRYPTION_KEY|SIGNING_KEY)\s*=\s*['"]([^'"]+)['"]""", "REDACTED_ENV_SECRET"),
    (r"Bearer\s+[A-Za-z0-9_\-\.]{20,}", "REDACTED_BEARER_TOKEN"),
    (r"\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b", "REDACTED_INTERNAL_IP"),
)
#: Names whose quoted values are masked.
SENSITIVE = "secret|password|passwd|pwd|token|api_key|apikey|auth|credential|private_key|access_key"


def _java_error(pattern: str) -> str:
    """What Java, which runs the pattern, has against it; empty if nothing."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("patterns are checked by a running session")
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException) as e:
        return str(e).split("\n")[0]
    return ""


@dataclass
class Redaction:
    enabled: bool = True
    builtin: bool = True
    sensitive: list[str] = field(default_factory=lambda: [SENSITIVE])
    custom: list[str] = field(default_factory=list)
    whitelist: list[str] = field(default_factory=list)

    def steps(self) -> list[tuple[str, str]]:
        """(Java pattern, replacement) in order. Custom patterns that don't compile are skipped
        with a warning."""
        out = [(p, f"[{label}]") for p, label in SECRETS] if self.builtin else []
        for p in self.custom:
            wrong = _java_error(p)
            if wrong:
                warnings.warn(f"the redaction pattern {p!r} is skipped: {wrong}", stacklevel=2)
            else:
                out.append((p, "[REDACTED_CUSTOM]"))
        return out + [(rf"(?i)({names})\s*[:=]\s*(['\"])(.+?)\2", '$1 = "[REDACTED]"') for names in self.sensitive]


def redact(text: Column, rules: Redaction | None = None) -> Column:
    """struct(text, had_redactions, redaction_count). Each pattern is counted on the text as the
    ones before it left it; whitelisted names are marked at last."""
    rules = rules or Redaction()
    if not rules.enabled:
        return F.struct(text.alias("text"), F.lit(False).alias("had_redactions"), F.lit(0).alias("redaction_count"))
    now, count = text, F.lit(0)
    for step in rules.steps():
        count = count + F.regexp_count(now, F.lit(step[0]))
        now = F.regexp_replace(now, step[0], step[1])
    for name in rules.whitelist:
        now = F.replace(now, F.lit(f'{name} = "[REDACTED]"'), F.lit(f'{name} = "[WHITELISTED]"'))
    return F.struct(now.alias("text"), (count > 0).alias("had_redactions"), count.alias("redaction_count"))


def redact_nodes(nodes: DataFrame, rules: Redaction | None = None) -> DataFrame:
    """Code and summary redacted; has_redacted_content if either was."""
    done = nodes.withColumn("__c", redact(F.coalesce("raw_code", F.lit("")), rules)).withColumn("__s", redact(F.coalesce("summary_short", F.lit("")), rules))
    return done.withColumn("raw_code", F.col("__c.text")).withColumn("summary_short", F.col("__s.text")).withColumn("has_redacted_content", F.col("__c.had_redactions") | F.col("__s.had_redactions")).drop("__c", "__s")


# -- summaries -----------------------------------------------------------------------------


#: The labels of a description.
LABELS = {"place": "Location: ", "doc": "Documentation: ", "marks": "Decorators: ", "complexity": "Complexity: ", "private": "Visibility: private/internal", "size": "Size: ", "unit": " lines", "module": "Module: ", "class": "class ", "file": "File: "}


def detailed_summary() -> Column:
    """A description of a node: a bold title, then a line for each of its fields that says
    something about a node of its type."""
    label = lambda name, value: F.concat(F.lit(LABELS[name]), value)
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    kind = F.col("node_type")
    callee, cls, module = kind.isin("function", "method"), kind == "class", kind == "module"
    title = F.when(callee, F.coalesce(F.nullif("signature", F.lit("")), F.col("name"))).when(cls, label("class", F.col("name"))).when(module, label("module", F.col("name"))).otherwise(F.concat_ws(": ", "node_type", "name"))
    lines = [
        F.concat(F.lit("**"), title, F.lit("**")),
        F.when((callee | cls | module) & (text("docstring") != ""), label("doc", F.substring("docstring", 1, 300))),
        F.when(~module, label("place", F.concat("file_path", F.lit(":"), F.concat_ws("-", F.col("line_start").cast("string"), F.col("line_end").cast("string"))))),
        F.when(module, label("file", F.col("file_path"))),
        F.when(callee, label("complexity", F.col("complexity").cast("string"))),
        F.when((callee | cls) & (F.size(F.coalesce("decorators", F.array().cast("array<string>"))) > 0), label("marks", F.array_join("decorators", ", "))),
        F.when(callee & ~F.col("is_public"), F.lit(LABELS["private"])),
        F.when(callee, label("size", F.concat((F.col("line_end") - F.col("line_start") + 1).cast("string"), F.lit(LABELS["unit"])))),
    ]
    return F.concat_ws("\n", *lines)


def summarize(nodes: DataFrame, mode: str = "ast_only", api_summaries: DataFrame | None = None) -> DataFrame:
    """summary_detailed by mode: ast_only from the fields, api_only from api_summaries (id,
    summary) where one is given, both: the API's first. Without one the fields speak."""
    own = nodes.withColumn("__own", detailed_summary())
    if mode == "ast_only" or api_summaries is None:
        return own.withColumn("summary_detailed", F.col("__own")).withColumn("summary_mode", F.lit("heuristic")).drop("__own")
    told = own.join(api_summaries.select(F.col("id"), F.col("summary").alias("__api")), "id", "left")
    text = F.coalesce("__api", "__own") if mode == "api_only" else F.concat_ws("\n\n", "__api", "__own")
    label = F.when(F.col("__api").isNull(), "heuristic").otherwise("api" if mode == "api_only" else "both")
    return told.withColumn("summary_detailed", text).withColumn("summary_mode", label).drop("__own", "__api")
