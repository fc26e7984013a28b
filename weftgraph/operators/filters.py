"""Projections, filters, look-ups and orderings over graph tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import basename
from .schema import active


def by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("id") == node_id)


def edges_from(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.filter(F.col("source_id") == node_id)


def edges_to(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.filter(F.col("target_id") == node_id)


def active_items(nodes: DataFrame, category: str) -> DataFrame:
    """The category's nodes that are not archived, most important first."""
    return nodes.filter((F.col("category") == category) & active()).orderBy(F.desc("importance"), "id")


def tasks(nodes: DataFrame, status: str | None = None, priority: str | None = None, include_archived: bool = False) -> DataFrame:
    keep = (F.col("category") == "tasks") & F.col("node_type").isin("task", "subtask")
    for name, value in (("task_status", status), ("priority", priority)):
        if value:
            keep = keep & (F.coalesce(name, F.lit("")) == value)
    return nodes.filter(keep if include_archived else keep & active()).orderBy(F.desc("importance"), "id")


def insights(nodes: DataFrame, topic: str | None = None) -> DataFrame:
    keep = (F.col("node_type") == "insight") & active()
    if topic:
        keep = keep & F.lower("name").startswith(f"insight/{topic.strip().lower()}")
    return nodes.filter(keep).orderBy(F.desc("importance"), "id")


# -- the key:value mini language -----------------------------------------------------------

FILTER_KEYS = ("type", "file", "layer", "edge")


def parse_query(text: str) -> tuple[dict[str, str], str]:
    """The first `key:value` of each known key, lower-cased, and the text without them. If
    nothing but filters is left the whole text is what is searched."""
    found: dict[str, str] = {}
    rest = text
    for key in FILTER_KEYS:
        m = re.search(rf"\b{key}:(\S+)", rest)
        if m:
            found[key] = m[1].lower()
            rest = (rest[: m.start()] + rest[m.end() :]).strip()
    return found, " ".join(rest.split()) or text


def apply_filters(nodes: DataFrame, found: dict[str, str], edges: DataFrame | None = None, language: str | None = None, include_archived: bool = False) -> DataFrame:
    """The nodes that pass all filters; before any limit, so none is missed."""
    if "type" in found:
        nodes = nodes.filter(F.lower("node_type") == found["type"])
    if "file" in found:
        nodes = nodes.filter(F.lower("file_path").contains(found["file"]))
    if "layer" in found:
        nodes = nodes.filter(F.lower("category") == found["layer"])
    if language:
        nodes = nodes.filter(F.lower("language") == language.lower())
    if not include_archived:
        nodes = nodes.filter(active())
    return having_edge(nodes, edges, found["edge"]) if "edge" in found and edges is not None else nodes


def having_edge(nodes: DataFrame, edges: DataFrame, edge_type: str) -> DataFrame:
    """Nodes at either end of an edge of the type."""
    some = edges.filter(F.lower("edge_type") == edge_type)
    ends = some.select(F.explode(F.array("source_id", "target_id")).alias("__end"))
    return nodes.join(ends, F.col("id") == F.col("__end"), "left_semi")


def resolve_item(nodes: DataFrame, title_or_id: str) -> DataFrame:
    """The node of that id, else the first task whose name contains the text (any case)."""
    rank = F.when(F.col("id") == title_or_id, 0).when((F.col("category") == "tasks") & (F.instr(F.lower("name"), title_or_id.lower()) > 0), 1)
    return nodes.withColumn("__rank", rank).filter("__rank IS NOT NULL").orderBy("__rank", F.desc("importance"), "id").limit(1).drop("__rank")


def match_files(nodes: DataFrame, refs: DataFrame, most: int = 3) -> DataFrame:
    """(ref, id, score): for each file reference (ref) the code nodes whose path fits it best.

    3: the same path, 2: one ends with the other, 1: the same file name; only the best score of
    a reference counts, and of it the first `most` ids. Suffixes need not begin at a slash.

    All are equal joins: on the path, on the suffixes of either side that are as long as something
    of the other, and on the file name. Nodes are brought down to the first `most` ids of each key
    before they are joined, so a file name that very many files bear adds `most` rows a reference.
    """
    target = F.regexp_replace(F.regexp_replace(F.trim("ref"), r"^[/\\]+", ""), r"\\", "/")
    r = refs.select("ref").distinct().withColumn("__t", target).filter("__t <> ''")
    n = nodes.filter((F.col("category") == "codebase") & (F.coalesce("file_path", F.lit("")) != "")).select("id", F.regexp_replace("file_path", r"\\", "/").alias("__p"))
    lengths = lambda df, c: sorted(x[0] for x in df.select(F.length(c)).distinct().collect())  # noqa: E731 - path lengths: few
    suffixes = lambda c, sizes: F.explode(F.transform(F.filter(F.array(*[F.lit(k) for k in sizes]).cast("array<int>"), lambda k: k < F.length(c)), lambda k: F.right(c, k)))

    def first(keys: DataFrame) -> DataFrame:
        return top_per_group(keys, ["__key"], [F.col("id")], most)

    paths = first(n.select("id", F.col("__p").alias("__key")))
    of_nodes = first(n.select("id", suffixes(F.col("__p"), lengths(r, "__t")).alias("__key")))
    names = first(n.select("id", basename(F.col("__p")).alias("__key")).filter("__key <> ''"))
    of_refs = r.select("ref", suffixes(F.col("__t"), lengths(n, "__p")).alias("__key"))
    found = [
        r.select("ref", F.col("__t").alias("__key")).join(paths, "__key").select("ref", "id", F.lit(3).alias("score")),
        r.select("ref", F.col("__t").alias("__key")).join(of_nodes, "__key").select("ref", "id", F.lit(2).alias("score")),
        of_refs.join(paths, "__key").select("ref", "id", F.lit(2).alias("score")),
        r.select("ref", basename(F.col("__t")).alias("__key")).join(names, "__key").select("ref", "id", F.lit(1).alias("score")),
    ]
    scored = found[0].union(found[1]).union(found[2]).union(found[3]).groupBy("ref", "id").agg(F.max("score").alias("score"))
    best = scored.join(scored.groupBy("ref").agg(F.max("score").alias("score")), ["ref", "score"])
    return top_per_group(best, ["ref"], [F.col("id")], most).select("ref", "id", "score")


def visible(nodes: DataFrame, category: str | None = None, types: list[str] | None = None, language: str | None = None, least: float = 0.0, status: str | None = None, text: str = "") -> DataFrame:
    """What a viewer shows: all conditions that are given."""
    keep: Column = F.coalesce(F.col("importance"), F.lit(0.0)) >= least
    if category:
        keep = keep & (F.col("category") == category)
    if types:
        keep = keep & F.col("node_type").isin(types)
    if language:
        keep = keep & (F.col("language") == language)
    if status:
        keep = keep & (F.coalesce(F.nullif("task_status", F.lit("")), F.col("bug_status")) == status)
    if text:
        keep = keep & F.lower(F.concat_ws("\n", "name", "summary_short")).contains(text.lower())
    return nodes.filter(keep)


def visible_edges(edges: DataFrame, shown: DataFrame) -> DataFrame:
    ids = shown.select("id")
    return edges.join(ids, edges.source_id == ids.id, "left_semi").join(ids, edges.target_id == ids.id, "left_semi")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group; Spark limits each group before its shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")


def truncated(nodes: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Texts and lists cut to what a view shows."""
    def cut(name: str) -> Column:
        if name not in limits:
            return F.col(name)
        kind = nodes.schema[name].dataType.typeName()
        return (F.slice(name, 1, limits[name]) if kind == "array" else F.substring(name, 1, limits[name])).alias(name)

    return nodes.select(*[cut(c) for c in nodes.columns])
