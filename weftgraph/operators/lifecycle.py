"""Bugs, tasks, insights: adding, updating and archiving them; staleness of an index."""

from __future__ import annotations

import hashlib
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import match_files, resolve_item
from .schema import NODES, PRIORITIES, STATUS_ALIASES, TASK_STATUSES, active, conform

LINKS = {"bug": (3, 0.8), "task": (2, 0.7), "insight": (2, 0.6)}  # fixed values: nodes per file, weight


def item_id(*parts: str) -> str:
    return hashlib.sha256("::".join(parts).encode()).hexdigest()[:12]


def _links(nodes: DataFrame, item: str, kind: str, files: list[str], most_files: int) -> DataFrame:
    most, weight = LINKS[kind]
    spark = nodes.sparkSession
    refs = spark.createDataFrame([(f,) for f in files[:most_files]], "ref string")
    found = match_files(nodes, refs, most).select("id").distinct()
    return found.select(F.lit(item).alias("source_id"), F.col("id").alias("target_id"), F.lit("relates_to").alias("edge_type"), F.lit("").alias("context"), F.lit(weight).alias("weight"))


def _node(spark: SparkSession, **values: object) -> DataFrame:
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return conform(row, NODES)


def add_bug(nodes: DataFrame, description: str, files: list[str] | None = None, severity: str = "medium", day: date | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, links) of a bug that was found by hand."""
    when = (day or date.today()).isoformat()
    key = item_id("bug", "manual", when, description)
    node = _node(nodes.sparkSession, id=key, name=f"bug: {description[:80]}", node_type="bug", file_path=(files or [""])[0], summary_short=description[:200], category="bugs", severity=severity, bug_status="open", importance=0.5)
    return node, _links(nodes, key, "bug", files or [], 1)


def add_task(nodes: DataFrame, title: str, phase: str = "", files: list[str] | None = None, priority: str = "medium", status: str = "pending") -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a task and, where one is named, its phase."""
    status = STATUS_ALIASES.get(status, status)
    if status not in TASK_STATUSES or priority not in PRIORITIES:
        raise ValueError(f"unknown status or priority: {status}, {priority}")
    spark, key = nodes.sparkSession, item_id("task", "manual", title)
    made = _node(spark, id=key, name=f"task: {title[:80]}", node_type="task", file_path=(files or [""])[0], summary_short=title[:200], category="tasks", task_status=status, priority=priority, importance=0.5)
    links = _links(nodes, key, "task", files or [], 5)
    if phase:
        top = item_id("phase", "manual", phase)
        made = made.unionByName(_node(spark, id=top, name=f"phase: {phase[:80]}", node_type="phase", file_path="", summary_short=f"Phase: {phase}"[:200], category="tasks", task_status="in_progress", importance=0.5))
        links = links.unionByName(spark.createDataFrame([(top, key, "phase_contains", "", 1.0)], links.schema))
    return made, links


def add_insight(nodes: DataFrame, text: str, topic: str = "general", files: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, links); the same topic and beginning of the text (any case) is the same insight."""
    subject = topic.strip().lower() or "general"
    key = item_id("insight", subject, text[:100].lower())
    node = _node(nodes.sparkSession, id=key, name=f"insight/{subject}: {text[:60]}", node_type="insight", file_path="", summary_short=text[:200], summary_detailed=text[:1000], category="insights", importance=0.5)
    return node, _links(nodes, key, "insight", files or [], 5)


def update_task(nodes: DataFrame, title_or_id: str, status: str | None = None, priority: str | None = None) -> DataFrame:
    """nodes with the task changed; ValueError for unknown values or tasks."""
    status = STATUS_ALIASES.get(status or "", status)
    if (status and status not in TASK_STATUSES) or (priority and priority not in PRIORITIES):
        raise ValueError(f"unknown status or priority: {status}, {priority}")
    row = resolve_item(nodes, title_or_id).first()
    if row is None:
        raise ValueError(f"no task {title_or_id!r}")
    for name, value in (("task_status", status), ("priority", priority)):
        if value:
            nodes = nodes.withColumn(name, F.when(F.col("id") == row["id"], F.lit(value)).otherwise(F.col(name)))
    return nodes


def archive(nodes: DataFrame, ids: DataFrame, archived: bool = True) -> DataFrame:
    """The nodes of ids (id) archived, at three tenths of their importance; taking one back from
    the archive does not restore it."""
    mark = ids.select(F.col("id").alias("__id")).distinct()
    hit = F.col("__id").isNotNull()
    score = F.when(hit & active(), F.round(F.col("importance") * 0.3, 3)).otherwise(F.col("importance")) if archived else F.col("importance")
    joined = nodes.join(mark, F.col("id") == F.col("__id"), "left").withColumn("importance", score)
    return joined.withColumn("archived", F.when(hit, F.lit(archived)).otherwise(F.coalesce("archived", F.lit(False)))).select(*nodes.columns)


def archive_completed(nodes: DataFrame) -> DataFrame:
    """Fixed bugs and done tasks archived, in one pass."""
    done = active() & (((F.col("category") == "bugs") & (F.col("bug_status") == "fixed")) | ((F.col("category") == "tasks") & (F.col("task_status") == "done")))
    hit = F.coalesce(done, F.lit(False))
    return nodes.withColumn("__hit", hit).withColumn("importance", F.when(F.col("__hit"), F.round(F.col("importance") * 0.3, 3)).otherwise(F.col("importance"))).withColumn("archived", F.col("__hit") | F.coalesce("archived", F.lit(False))).drop("__hit")


def staleness(head: str, state: dict, commits_behind: int, changed_files: int, threshold: int = 5) -> str:
    """uninitialised, healthy or stale."""
    if not state.get("last_full_index") and not state.get("total_nodes"):
        return "uninitialised"
    if state.get("last_commit") == head and not changed_files:
        return "healthy"
    return "stale" if commits_behind >= threshold or changed_files else "healthy"
