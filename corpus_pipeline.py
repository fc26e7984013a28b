"""Preparing a training corpus: five stages over `documents`, each stored before the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns what stays.
All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm._common import col, discard, keep, materialize, scratch, table
from weftgraph.llm.mixing import mix_sources
from weftgraph.llm.packing import pack
from weftgraph.llm.pii import find_pii
from weftgraph.llm.queries import tokenizer_file
from weftgraph.llm.simhash import drop_similar
from weftgraph.llm.toxicity import score_toxicity

TOXIC_FROM = 0.3
CAPACITY = 2048

#: No SQL form: learned scores, near-duplicate components and packing have none.
ORACLE_SQL: str | None = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_FROM; null and empty texts score low and stay.

    Very long texts are scored whole, repeated rows alike; an empty table gives an empty result,
    and columns of other names are carried.
    """
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), threshold=TOXIC_FROM, score_name="__score", predicted_name="__predicted")
    return scored.filter(F.col("__predicted") == 0).select(*[col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one with the smallest id: documents link if their sets
    of five-word shingles have a Jaccard similarity of 0.8 or more, found by the SimHash join.

    Of repeated rows and of rows with one id and one text one stays; null texts and texts without
    words are one component; very long texts count whole. An empty table gives an empty result.
    """
    return drop_similar(docs, words=5, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind in brackets; n_chars is
    the new length. A null text stays null, and its n_chars what it was. Repeated rows stay, very
    long texts are searched whole, an empty table gives an empty result."""
    found = find_pii(docs)
    made = {"text": F.col("redacted"), "n_chars": F.coalesce(F.length("redacted").cast("long"), F.col("n_chars"))}
    return found.select(*[made[c].alias(c) if c in made else col(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have weights like the roots of their
    sizes, dealt out globally. A null source is a source of its own; repeated rows are drawn
    alike; texts are not looked at. An empty table gives an empty result."""
    return mix_sources(docs).select(*[col(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of CAPACITY tokens. A null text is an empty one
    (a piece with the end id alone), very long texts are cut at sequences' ends, repeated rows
    are packed each. An empty table gives an empty result."""
    return pack(docs, tokenizer_file(), capacity=CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns. Of the tables in between only that which it reads stays."""
    docs, made = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(spark, *made)
        made = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
