"""Overviews, boards, topics and texts that must fit a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import digest, dirname, ellipsis
from .filters import top_per_group
from .graph import OVERVIEWS
from .schema import NODES, active, conform

CHARS_PER_TOKEN = 4
DEFAULT_TOKENS = 500


def code_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter((F.col("category") == "codebase") & ~F.col("node_type").isin(*OVERVIEWS))


def directory_overview(nodes: DataFrame, most: int = 4) -> DataFrame:
    """(dir, files, classes, functions, key): per directory, key its most important entities."""
    code = code_nodes(nodes).withColumn("dir", dirname(F.col("file_path")))
    counts = code.groupBy("dir").agg(F.count_distinct("file_path").alias("files"), F.sum((F.col("node_type") == "class").cast("long")).alias("classes"), F.sum((F.col("node_type") == "function").cast("long")).alias("functions"))
    best = top_per_group(code.filter(F.col("node_type").isin("class", "function")), ["dir"], [F.desc("importance"), F.col("id")], most)
    order = F.sort_array(F.collect_list(F.struct((-F.coalesce("importance", F.lit(0.0))).alias("r"), F.col("id"), F.col("name"))))
    key = best.groupBy("dir").agg(F.array_join(F.transform(order, lambda x: x["name"]), ", ").alias("key"))
    return counts.join(key, "dir", "left").select("dir", "files", "classes", "functions", F.coalesce("key", F.lit("")).alias("key"))


def directory_nodes(nodes: DataFrame) -> DataFrame:
    """The overviews as nodes."""
    d = directory_overview(nodes)
    shown = F.when(F.col("dir") == ".", "(root)").otherwise(F.col("dir"))
    text = F.concat(shown, F.lit(": "), "files", F.lit(" file(s), "), "classes", F.lit(" class(es), "), "functions", F.lit(" function(s)."), F.when(F.col("key") != "", F.concat(F.lit(" Key: "), "key", F.lit("."))).otherwise(""))
    made = d.select(digest("__dir__", "directory_overview", F.col("dir")).alias("id"), F.concat(F.lit("dir: "), shown).alias("name"), F.lit("directory_overview").alias("node_type"), F.col("dir").alias("file_path"), F.substring(text, 1, 200).alias("summary_short"), F.lit("heuristic").alias("summary_mode"), F.lit("codebase").alias("category"), F.lit(0.9).alias("importance"))
    return conform(made.withColumn("content_hash", digest(F.col("summary_short"))), NODES)


def project_overview(nodes: DataFrame) -> DataFrame:
    """One node that sums up the code: counts, top modules and entities."""
    code = code_nodes(nodes)
    top = lambda kinds, k: [r["name"] for r in code.filter(F.col("node_type").isin(*kinds)).orderBy(F.desc("importance"), "id").limit(k).select("name").collect()]
    counts = {r["node_type"]: r["n"] for r in code.groupBy("node_type").agg(F.count("*").alias("n")).collect()}  # a row for each type
    files = code.agg(F.count_distinct("file_path")).first()[0]
    modules, entities = top(["module"], 6), top(["class", "function"], 5)
    short = f"Project: {files} files, {sum(counts.values())} nodes." + (f" Top modules: {', '.join(modules)}." if modules else "")
    long = short + "\n" + "\n".join(f"{k}: {v}" for k, v in sorted(counts.items())) + ("\nKey entities: " + ", ".join(entities) if entities else "")
    row = nodes.sparkSession.createDataFrame([(short[:200], long[:1000])], "summary_short string, summary_detailed string")
    made = row.select(digest("__project__", "project_overview", "root").alias("id"), F.lit("project overview").alias("name"), F.lit("project_overview").alias("node_type"), F.lit("__project__").alias("file_path"), "summary_short", "summary_detailed", F.lit("codebase").alias("category"), F.lit(1.0).alias("importance"))
    return conform(made.withColumn("content_hash", digest(F.col("summary_short"))), NODES)


def regenerate_overviews(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All overviews anew, with their edges."""
    from .graph import overview_edges

    old = nodes.filter(F.col("node_type").isin(*OVERVIEWS)).select("id")
    kept = nodes.filter(~F.col("node_type").isin(*OVERVIEWS))
    made = kept.unionByName(project_overview(nodes), allowMissingColumns=True).unionByName(directory_nodes(nodes), allowMissingColumns=True)
    rest = edges.join(old, edges.source_id == old.id, "left_anti").join(old, edges.target_id == old.id, "left_anti")
    return made, rest.unionByName(overview_edges(made), allowMissingColumns=True)


BOARD = ("in_progress", "testing", "pending", "done")


def task_board(nodes: DataFrame) -> DataFrame:
    """(status, position, tasks): tasks by status, in BOARD's order, unknown ones last."""
    status = F.coalesce(F.nullif("task_status", F.lit("")), F.lit("pending"))
    place = F.coalesce(*[F.when(status == s, F.lit(k)) for k, s in enumerate(BOARD)], F.lit(len(BOARD)))
    held = nodes.filter((F.col("category") == "tasks") & active())
    return held.groupBy(status.alias("status")).agg(F.min(place).alias("position"), F.count("*").alias("tasks")).orderBy("position", "status")


def code_refs(items: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """(id, ref, position): the first code nodes that each item relates to."""
    code = nodes.filter("category = 'codebase'").select(F.col("id").alias("ref"))
    rel = edges.filter("edge_type = 'relates_to'").select(F.col("source_id").alias("id"), F.col("target_id").alias("ref")).distinct()
    linked = rel.join(items.select("id"), "id", "left_semi").join(code, "ref", "left_semi")
    return linked.withColumn("position", F.row_number().over(Window.partitionBy("id").orderBy("ref"))).filter(F.col("position") <= most).select("id", "ref", "position")


def topic(name: Column) -> Column:
    """What stands between the slash and the colon of an insight's name, else 'general'."""
    found = F.regexp_extract(name, "/([^:]+):", 1)
    return F.when(found == "", "general").otherwise(F.trim(found))


def insight_topics(nodes: DataFrame) -> DataFrame:
    held = nodes.filter((F.col("node_type") == "insight") & active())
    return held.groupBy(topic(F.col("name")).alias("topic")).agg(F.count("*").alias("n"))


def char_budget(lines: DataFrame, group: list[str], order: list[Column], text: str, budget: Column | int) -> DataFrame:
    """The first lines of each group until one would exceed the budget; a line break counts one."""
    w = Window.partitionBy(*group).orderBy(*order)
    used = F.sum(F.length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("used", used).filter(F.col("used") <= budget)


def scaled(chars: int, tokens: int) -> int:
    """A share of the default budget, for a budget of so many tokens."""
    return int(chars * tokens / DEFAULT_TOKENS)


def context_snapshot(nodes: DataFrame, edges: DataFrame, tokens: int = DEFAULT_TOKENS) -> str:
    """A short text: open bugs, tasks in progress and insights, each within its share."""
    parts = []
    bugs = nodes.filter((F.col("category") == "bugs") & active() & (F.coalesce("bug_status", F.lit("")) != "fixed"))
    work = nodes.filter((F.col("category") == "tasks") & active() & (F.coalesce("task_status", F.lit("pending")) != "done") & (F.col("node_type") != "phase"))
    notes = nodes.filter((F.col("node_type") == "insight") & active())
    for title, items, share in (("Open bugs", bugs, 600), ("Tasks", work, 600), ("Insights", notes, 500)):
        line = F.concat(F.lit("- "), ellipsis(F.coalesce(F.nullif("summary_short", F.lit("")), F.col("name")), 100))
        first = items.withColumn("line", line).orderBy(F.desc("importance"), "id").limit(scaled(share, tokens) // 3 + 1)
        rows = char_budget(first.withColumn("g", F.lit(0)), ["g"], [F.desc("importance"), F.col("id")], "line", scaled(share, tokens))
        lines = [r["line"] for r in rows.orderBy(F.desc("importance"), "id").collect()]  # within the budget
        if lines:
            parts.append("\n".join([f"## {title}", *lines]))
    top = code_nodes(nodes).orderBy(F.desc("importance"), "id").limit(5).collect()
    if top:
        parts.append("\n".join(["## Key code", *[f"- {r['name']} ({r['node_type']}) {r['file_path']}" for r in top]]))
    return "\n\n".join(parts)


def impact_report(found: DataFrame, nodes: DataFrame, start: str, most_files: int = 20) -> str:
    """The impact of one node as text, its largest files first."""
    from .graph import impact_by_file

    mine = found.filter(F.col("start") == start)
    total, direct = mine.agg(F.count("*"), F.sum((F.col("hop") == 1).cast("int"))).first()
    files = impact_by_file(mine, nodes).limit(most_files).collect()
    return "\n".join([f"{start}: {total} affected, {direct or 0} directly", *[f"{r['file_path']} ({r['affected']}): {r['names']}" for r in files]])
