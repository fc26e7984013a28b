"""Markdown logs of bugs and tasks as nodes and edges, with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import EXTENSIONS, digest
from ..operators.filters import match_files
from ..operators.schema import EDGES, NODES, conform

ENDS = "|".join(e.replace(".", r"\.") for e in sorted(e for es in EXTENSIONS.values() for e in es))
GOTCHA = r"(?m)^## (\d{4}-\d{2}-\d{2}) — (.+)$"  # an em dash


def _value(body: Column, key: str) -> Column:
    """The value of a bold key: up to the next bold key, an empty line or the end."""
    return F.trim(F.regexp_extract(body, rf"(?s)\*\*{key}\*\*:\s*(.+?)(?=\n\*\*|\n\n|\z)", 1))


def _entries(logs: DataFrame, heading: str) -> DataFrame:
    """(file_path, ordinal, body): the text cut before each line that the heading fits."""
    cut = F.split(F.col("content"), rf"(?m)(?={heading})")
    return logs.select("file_path", "content", F.posexplode(cut).alias("ordinal", "body")).filter(F.col("body").rlike(rf"(?m)\A{heading}"))


def parse_gotchas(logs: DataFrame) -> DataFrame:
    """Bug nodes of (file_path, content): one for each dated heading. Those with a fix are fixed."""
    e = _entries(logs, r"^## \d{4}-\d{2}-\d{2} — .+$")
    day, title = F.regexp_extract("body", GOTCHA, 1), F.trim(F.regexp_extract("body", GOTCHA, 2))
    file = F.regexp_extract(_value(F.col("body"), "File"), rf"`([^`]+(?:{ENDS}))(?::[\d\-]+)?`", 1)
    cause, fix = _value(F.col("body"), "Root cause"), _value(F.col("body"), "Fix")
    out = e.select(
        digest("bug", F.col("file_path"), day, title).alias("id"), F.concat(F.lit("bug: "), F.substring(title, 1, 80)).alias("name"), F.lit("bug").alias("node_type"),
        F.when(file != "", file).otherwise(F.col("file_path")).alias("file_path"), F.substring(title, 1, 200).alias("summary_short"), F.concat_ws("\n", F.nullif(cause, F.lit("")), F.nullif(fix, F.lit(""))).alias("summary_detailed"),
        F.lit("bugs").alias("category"), F.lit("medium").alias("severity"), F.when(fix != "", "fixed").otherwise("open").alias("bug_status"), digest("body").alias("content_hash"),
    )
    return conform(out, NODES)


def parse_tasks(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a phase for each log and a task for each `## Fix/Task/Step N — title`; in
    logs without such headings for each second-level heading but the status line."""
    clean = F.regexp_replace("content", r"(?s)```.*?```", "")
    title = F.regexp_extract("content", r"(?m)^# (.+)$", 1)
    phase = F.when(title != "", F.trim(title)).otherwise(F.col("file_path"))
    complete = F.upper(F.regexp_extract("content", r"(?i)##\s+Status:\s*(COMPLETE|IN PROGRESS|PENDING)", 1)) == "COMPLETE"
    phase_id = digest("phase", F.col("file_path"), phase)
    phases = logs.select(phase_id.alias("id"), F.concat(F.lit("phase: "), F.substring(phase, 1, 80)).alias("name"), F.lit("phase").alias("node_type"), "file_path", F.substring(F.concat(F.lit("Phase: "), phase), 1, 200).alias("summary_short"), F.lit("tasks").alias("category"), F.when(complete, "done").otherwise("in_progress").alias("task_status"))
    strict = r"^## (?:Fix|Task|Step) \d+ — .+$"
    has = F.col("content").rlike(rf"(?m){strict}")
    marked = logs.withColumn("phase_id", phase_id).withColumn("content", clean)
    ids = marked.select("file_path", "phase_id")
    rows = _entries(marked.filter(has), strict).unionByName(_entries(marked.filter(~has), r"^## (?!Status).+$")).join(ids, "file_path")
    head = F.regexp_extract("body", r"(?m)\A## (.+)$", 1)
    name = F.trim(F.when(F.instr(head, " — ") > 0, F.substring_index(head, " — ", -1)).otherwise(head))
    box = F.lower(F.regexp_extract("body", r"\*\*Status\*\*:\s*\[([xX ])\]", 1))
    ref = rf"\*\*File\*\*:\s*`([^`]+(?:{ENDS}))`(?:\s+lines?\s+(\d+)[–\-]+(\d+))?"
    file = F.regexp_extract("body", ref, 1)
    number = lambda k: F.coalesce(F.nullif(F.regexp_extract("body", ref, k), F.lit("")).cast("int"), F.lit(0))
    task_id = digest("task", F.col("file_path"), name)
    tasks = rows.select(task_id.alias("id"), F.concat(F.lit("task: "), F.substring(name, 1, 80)).alias("name"), F.lit("task").alias("node_type"), F.when(file != "", file).otherwise(F.col("file_path")).alias("file_path"), number(2).alias("line_start"), number(3).alias("line_end"), F.substring(name, 1, 200).alias("summary_short"), F.substring(F.trim("body"), 1, 600).alias("summary_detailed"), F.lit("tasks").alias("category"), F.when(box == "x", "done").otherwise("pending").alias("task_status"), digest("body").alias("content_hash"))
    edges = rows.select(F.col("phase_id").alias("source_id"), task_id.alias("target_id"), F.lit("phase_contains").alias("edge_type"), F.lit("").alias("context"), F.lit(1.0).alias("weight")).distinct()
    one = tasks.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("content_hash"))).filter("n = 1").drop("n")
    return conform(phases, NODES).unionByName(conform(one, NODES)), conform(edges, EDGES)


def import_logs(logs: DataFrame, nodes: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the logs (file_path, content, modified) that are newer than their state
    (file_path, last_indexed), with links to the code that they name. Logs whose name tells of
    tasks are task logs."""
    known = states.select("file_path", "last_indexed")
    fresh = logs.join(known, "file_path", "left").filter("last_indexed IS NULL OR modified > last_indexed").select("file_path", "content")
    is_tasks = F.lower("file_path").contains("task")
    task_nodes, edges = parse_tasks(fresh.filter(is_tasks))
    made = task_nodes.unionByName(parse_gotchas(fresh.filter(~is_tasks)))
    refs = made.filter("node_type IN ('bug', 'task')").select("id", "node_type", F.col("file_path").alias("ref"))
    found = refs.join(match_files(nodes, refs.select("ref")).select("ref", F.col("id").alias("target_id")), "ref")
    weight = F.when(F.col("node_type") == "bug", 0.8).otherwise(0.7)
    links = found.select(F.col("id").alias("source_id"), "target_id", F.lit("relates_to").alias("edge_type"), F.lit("").alias("context"), weight.alias("weight")).distinct()
    return made, edges.unionByName(conform(links, EDGES))
