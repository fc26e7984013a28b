"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source of n rows and weight w gets the rate  target_rows * w / sum(w) / n.  Each document
draws its number of copies from a Poisson distribution of that mean, by inverting the
distribution function at a number that is hashed from seed and document id, so a draw can be
repeated anywhere. Documents are exploded by their counts and dealt out by a hash of the copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import col, materialize

STEP = 8.0  # a larger mean is a sum of independent draws of mean STEP or less
FEW_SOURCES = 10_000  # their rates (about 600 bytes each) are broadcast; more are joined by shuffle
LAST = 63  # P(X > 63) for mean 8 is below 2**-52, the step of the hashed numbers


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5, equal in any SQL engine."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | DataFrame | None = None, target_rows: float | None = None, power: float = 0.5) -> DataFrame:
    """source, rows, rate, draws and cdf of each source.

    weights: by source, as a dict or a DataFrame (source, weight); a source without one gets 0
    and vanishes. None: rows ** power, which flattens the mix. target_rows: expected number of
    rows out, by default as many as in. A null source is a source of its own (in a dict: None).
    """
    spark: SparkSession = docs.sparkSession
    held = docs.groupBy(col(source_col).alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        held = held.withColumn("weight", F.pow(F.col("rows").cast("double"), F.lit(power)))
    else:
        if isinstance(weights, dict):
            weights = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        given = weights.select(F.col("source").alias("given_source"), F.col("weight").cast("double"))
        held = held.join(given, F.col("source").eqNullSafe(F.col("given_source")), "left").select("source", "rows", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    held = materialize(held, "mix-sources")
    total = held.agg(F.sum("weight").alias("weight"), F.sum("rows").alias("rows")).first()
    want = float(target_rows if target_rows is not None else total["rows"] or 0)
    rate = F.lit(want) * F.col("weight") / F.lit(float(total["weight"])) / F.col("rows") if total["weight"] else F.lit(0.0)
    rates = held.select("source", "rows", rate.alias("rate"))
    rates = rates.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int"))
    mean = F.col("rate") / F.col("draws")
    steps = F.transform(F.sequence(F.lit(1), F.lit(LAST)), lambda k: k.cast("double"))
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    cdf = F.aggregate(
        steps,
        start,
        lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * mean / k)).alias("c")),
        lambda s: s["c"],
    )
    return rates.withColumn("cdf", cdf)


def mix_sources(docs: DataFrame, weights: dict[str, float] | DataFrame | None = None, target_rows: float | None = None, power: float = 0.5, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with each row as often as its draw says, dealt out globally.

    Adds replica (1, 2, ...) and shuffle_key; input columns of those names are replaced. Rows
    come out partitioned by a hash of shuffle_key and sorted by it within each partition. A
    null id draws as the empty string; repeated ids draw alike. Texts play no part, so null,
    empty and very long ones are ordinary rows. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("replica", "shuffle_key")]
    rates = source_rates(docs, source_col, weights, target_rows, power)
    few = rates.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    rates = rates.select(F.col("source").alias("__mix_source"), F.col("draws").alias("__mix_draws"), F.col("cdf").alias("__mix_cdf"))
    if few:
        rates = F.broadcast(rates)
    name = F.coalesce(col(id_col).cast("string"), F.lit(""))
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col("__mix_draws")),
        F.lit(0),
        lambda n, i: n + F.size(F.filter(F.col("__mix_cdf"), lambda c: unit_hash(F.lit(str(seed)), name, i.cast("string")) >= c)),
    )
    copies = (
        docs.select(*[col(c) for c in names])
        .join(rates, col(source_col).eqNullSafe(F.col("__mix_source")))
        .withColumn("__mix_n", draw)
        .filter("__mix_n > 0")
        .select(*[col(c) for c in names], F.explode(F.sequence(F.lit(1), F.col("__mix_n"))).alias("replica"))
    )
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), name, F.col("replica").cast("string"))))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
