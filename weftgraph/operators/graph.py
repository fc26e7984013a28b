"""Degrees, importance, neighbourhoods, chains, impact and trees of a typed graph.

Traversals advance all their starts together, one join per hop, and store each frontier in the
shared folder, so their lineage stays short. Results are sets: they don't depend on edge order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import materialize
from .schema import EDGE_TYPES, OTHER_WEIGHT, TYPE_WEIGHTS

IMPACT_EDGES = ("calls", "inherits", "implements")
OVERVIEWS = ("project_overview", "directory_overview")


def end_counts(edges: DataFrame) -> DataFrame:
    """(end, i, o): the edges into and out of each end, in one pass over the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("target_id").alias("end"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source_id").alias("end"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    return ends.groupBy(F.col("x.end").alias("end")).agg(F.sum("x.i").alias("i"), F.sum("x.o").alias("o"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree."""
    counts = end_counts(edges)
    out = nodes.select("id").join(counts, F.col("id") == F.col("end"), "left")
    return out.select("id", F.coalesce("i", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("o", F.lit(0)).cast("long").alias("out_degree"))


def type_weight(node_type: Column) -> Column:
    return F.coalesce(*[F.when(node_type == t, F.lit(w)) for t, w in TYPE_WEIGHTS.items()], F.lit(OTHER_WEIGHT))


def importance(nodes: DataFrame, edges: DataFrame, respect_archived: bool = False) -> DataFrame:
    """nodes with importance: in-degree + half the out-degree + the type's weight, a fifth more
    if public, divided by the largest, to three digits. respect_archived: archived nodes get
    three tenths of it."""
    raw = (F.col("in_degree") * 1.0 + F.col("out_degree") * 0.5 + type_weight(F.col("node_type"))) * F.when(F.coalesce("is_public", F.lit(True)), 1.2).otherwise(1.0)
    counts = materialize(end_counts(edges), "degrees")  # three narrow columns, read twice
    scored = nodes.drop("importance").join(counts, F.col("id") == F.col("end"), "left").withColumn("in_degree", F.coalesce("i", F.lit(0))).withColumn("out_degree", F.coalesce("o", F.lit(0))).withColumn("__raw", raw)
    largest = scored.agg(F.max("__raw")).first()[0] or 1.0  # one number
    score = F.round(F.col("__raw") / F.lit(float(largest)), 3)
    if respect_archived:
        score = F.when(F.coalesce("archived", F.lit(False)), F.round(score * 0.3, 3)).otherwise(score)
    return scored.withColumn("importance", score).drop("__raw", "in_degree", "out_degree", "end", "i", "o")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(measure, value) for total_nodes, total_files and total_edges."""
    n = nodes.agg(F.count("*").alias("total_nodes"), F.count_distinct("file_path").alias("total_files"))
    e = edges.agg(F.count("*").alias("total_edges"))
    parts = n.selectExpr("stack(2, 'total_nodes', total_nodes, 'total_files', total_files) AS (measure, value)").union(e.selectExpr("'total_edges' AS measure", "total_edges AS value"))
    return parts


def type_counts(nodes: DataFrame, column: str = "node_type") -> DataFrame:
    return nodes.groupBy(column).agg(F.count("*").alias("n"))


def incident(edges: DataFrame) -> DataFrame:
    """Each edge once at either end: id, direction (in, out), other, edge_type, weight."""
    side = lambda end, other, d: F.struct(F.col(end).alias("id"), F.lit(d).alias("direction"), F.col(other).alias("other"))
    return edges.select(F.explode(F.array(side("source_id", "target_id", "out"), side("target_id", "source_id", "in"))).alias("x"), "edge_type", "weight").select("x.*", "edge_type", "weight")


def edge_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and for each type of EDGE_TYPES the share of the node's edge ends; ends of other types
    count in the denominator only; a loop counts twice."""
    parts = incident(edges).groupBy("id").agg(F.count("*").alias("n"), *[F.sum((F.col("edge_type") == t).cast("int")).alias(t) for t in EDGE_TYPES])
    joined = nodes.select("id").join(parts, "id", "left")
    return joined.select("id", *[F.coalesce(F.col(t) / F.col("n"), F.lit(0.0)).alias(t) for t in EDGE_TYPES])


LIST_MOST = 100_000  # edges of a node that stand in one row


def adjacency(edges: DataFrame, most: int = LIST_MOST) -> DataFrame:
    """id, part and the node's edges as lists, incoming and outgoing. A node of more than `most`
    edges has several parts, each with its next edges, incoming ones first."""
    item = F.struct("edge_type", "other", "weight")
    place = F.row_number().over(Window.partitionBy("id").orderBy("direction", "edge_type", "other", "weight")) - 1
    cut = incident(edges).withColumn("part", F.floor(place / most).cast("int"))
    lists = [F.sort_array(F.collect_list(F.when(F.col("direction") == d, item))).alias(n) for d, n in (("in", "incoming"), ("out", "outgoing"))]
    return cut.groupBy("id", "part").agg(*lists)


def connections_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(nodes, edges)
    text = F.concat_ws(", ", F.when(F.col("out_degree") > 0, F.concat(F.lit("→ "), "out_degree", F.lit(" out"))), F.when(F.col("in_degree") > 0, F.concat(F.lit("← "), "in_degree", F.lit(" in"))))
    return d.select("id", F.when(text == "", "no connections").otherwise(text).alias("connections_summary"))


def neighborhood(nodes: DataFrame, edges: DataFrame, starts: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(start, role, id) for each start (id): callers, callees, parent, children, siblings, one
    hop. Of several parents the one with the largest id is the parent."""
    if types:
        edges = edges.filter(F.col("edge_type").isin(types))
    ids = nodes.select(F.col("id").alias("__n"))
    e = edges.filter(F.col("edge_type").isin("calls", "contains")).select("source_id", "target_id", "edge_type").distinct()
    s = starts.select(F.col("id").alias("start")).distinct().join(ids, F.col("start") == F.col("__n"), "left_semi")
    into = s.join(e, F.col("start") == F.col("target_id")).join(ids, F.col("source_id") == F.col("__n"), "left_semi")
    out = s.join(e, F.col("start") == F.col("source_id")).join(ids, F.col("target_id") == F.col("__n"), "left_semi")
    callers = into.filter("edge_type = 'calls'").select("start", F.lit("caller").alias("role"), F.col("source_id").alias("id"))
    near = out.select("start", F.when(F.col("edge_type") == "calls", "callee").otherwise("child").alias("role"), F.col("target_id").alias("id"))
    parent = into.filter("edge_type = 'contains'").groupBy("start").agg(F.max("source_id").alias("id"))
    kids = e.filter("edge_type = 'contains'").select(F.col("source_id").alias("id"), F.col("target_id").alias("kid"))
    siblings = parent.join(kids, "id").filter("kid <> start").join(ids, F.col("kid") == F.col("__n"), "left_semi").select("start", F.lit("sibling").alias("role"), F.col("kid").alias("id"))
    return callers.union(near).union(parent.select("start", F.lit("parent").alias("role"), "id")).union(siblings)


def call_chains(nodes: DataFrame, edges: DataFrame, starts: DataFrame, direction: str = "up", max_depth: int = 5) -> DataFrame:
    """Distinct (start, chain) of simple paths over calls. A chain ends at a node without further
    calls, before a node that it already holds, or at max_depth nodes."""
    here, there = ("target_id", "source_id") if direction == "up" else ("source_id", "target_id")
    ids = nodes.select(F.col("id").alias("__n"))
    step = edges.filter("edge_type = 'calls'").select(F.col(here).alias("__here"), F.col(there).alias("__next")).distinct()
    known = step.join(ids, F.col("__next") == F.col("__n"), "left_semi")
    front = starts.select(F.col("id").alias("start")).distinct().join(ids, F.col("start") == F.col("__n"), "left_semi").select("start", F.array("start").alias("chain"))
    done = front.filter(F.lit(False))
    for depth in range(1, max_depth + 1):
        if depth == max_depth:
            done = done.union(front)
            break
        last = F.element_at("chain", -1)
        leaves = front.withColumn("__last", last).join(step, F.col("__last") == F.col("__here"), "left_anti").select("start", "chain")
        grown = materialize(front.withColumn("__last", last).join(known, F.col("__last") == F.col("__here")).select("start", "chain", "__next"), "chains")
        seen = F.array_contains(F.col("chain"), F.col("__next"))
        done = done.union(leaves).union(grown.filter(seen).select("start", "chain"))
        front = grown.filter(~seen).select("start", F.array_append("chain", F.col("__next")).alias("chain"))
    return done.distinct()


def impact(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int = 3) -> DataFrame:
    """(start, id, hop) of all that depends on each start over IMPACT_EDGES, nearest hop, at most
    max_depth + 1 hops away. Overviews are walked through but not returned."""
    ids = nodes.select(F.col("id").alias("__n"))
    back = edges.filter(F.col("edge_type").isin(*IMPACT_EDGES)).select(F.col("target_id").alias("__to"), F.col("source_id").alias("__from")).distinct()
    back = materialize(back.join(ids, F.col("__from") == F.col("__n"), "left_semi"), "impact-edges")  # read at each hop
    front = starts.select(F.col("id").alias("start"), "id").distinct().join(ids, F.col("id") == F.col("__n"), "left_semi").withColumn("hop", F.lit(0))
    seen = front = materialize(front, "impact")
    for hop in range(1, max_depth + 2):
        nxt = front.join(back, F.col("id") == F.col("__to")).select("start", F.col("__from").alias("id")).distinct()
        front = materialize(nxt.join(seen, ["start", "id"], "left_anti").withColumn("hop", F.lit(hop)), "impact")
        if front.isEmpty():
            break
        seen = seen.union(front)
    shown = nodes.filter(~F.coalesce(F.col("node_type").isin(*OVERVIEWS), F.lit(False))).select(F.col("id").alias("__n"))
    return seen.filter("hop > 0").join(shown, F.col("id") == F.col("__n"), "left_semi")


def impact_by_file(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(start, file_path, affected, names), most affected first."""
    named = found.join(nodes.select("id", "name", "file_path"), "id")
    return named.groupBy("start", "file_path").agg(F.count("*").alias("affected"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names")).orderBy("start", F.desc("affected"), "file_path")


TREE_EDGES = ("contains", "phase_contains", "task_contains")


def containment_tree(nodes: DataFrame, edges: DataFrame, max_depth: int = 6, types: tuple[str, ...] = TREE_EDGES) -> DataFrame:
    """(root, id, depth, path) from every node that is nobody's child (depth 0) down."""
    ids = nodes.select(F.col("id").alias("__n"))
    e = edges.filter(F.col("edge_type").isin(*types)).select(F.col("source_id").alias("__up"), F.col("target_id").alias("__down")).distinct()
    e = materialize(e.join(ids, F.col("__down") == F.col("__n"), "left_semi"), "tree-edges")  # read at each depth
    front = nodes.select("id").join(e, F.col("id") == F.col("__down"), "left_anti").select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), F.array("id").alias("path"))
    front = materialize(front, "tree")
    tree = front
    for depth in range(1, max_depth + 1):
        nxt = front.join(e, F.col("id") == F.col("__up")).filter(~F.array_contains(F.col("path"), F.col("__down")))
        front = materialize(nxt.select("root", F.col("__down").alias("id"), F.lit(depth).alias("depth"), F.array_append("path", F.col("__down")).alias("path")), "tree")
        if front.isEmpty():
            break
        tree = tree.union(front)
    return tree


def prune_tree(tree: DataFrame, shown: DataFrame) -> DataFrame:
    """Tree rows that are shown or have something shown below."""
    keep = tree.join(shown.select(F.col("id").alias("__s")), F.col("id") == F.col("__s"), "left_semi").select(F.explode("path").alias("id")).distinct()
    return tree.join(keep, "id", "left_semi")


#: The order in which a node's groups are shown, outgoing before incoming.
GROUP_ORDER = [(t, d) for t in ("contains", "defines", "calls", "imports", "inherits", "implements", "uses", "references", "queries", "writes_to", "relates_to", "phase_contains", "fixed_by") for d in ("out", "in")]


def _relations(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, edge_type, direction, other, __imp) of the starts, and the same with their position."""
    rel = incident(edges).join(starts.select(F.col("id").alias("__s")).distinct(), F.col("id") == F.col("__s"), "left_semi").select("id", "edge_type", "direction", "other").distinct()
    rel = rel.join(nodes.select(F.col("id").alias("other"), F.coalesce("importance", F.lit(0.0)).alias("__imp")), "other")
    place = F.row_number().over(Window.partitionBy("id", "edge_type", "direction").orderBy(F.desc("__imp"), "other"))
    return rel, rel.withColumn("position", place)


def relationship_groups(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, edge_type, direction, group_rank, other, position): each start's relations, groups in
    GROUP_ORDER, others by importance."""
    rank = F.coalesce(*[F.when((F.col("edge_type") == t) & (F.col("direction") == d), F.lit(k)) for k, (t, d) in enumerate(GROUP_ORDER)], F.lit(len(GROUP_ORDER)))
    return _relations(nodes, edges, starts)[1].select("id", "edge_type", "direction", rank.alias("group_rank"), "other", "position")


def relationship_tree(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_hops: int = 2, per_group: int = 10) -> DataFrame:
    """(root, path, id, edge_type, direction, hop, back_reference, has_more): from each start the
    first per_group relations of each group, then theirs; an ancestor is a leaf that refers back.
    Groups are limited before their shuffle and counted apart, so a hub is never sorted whole."""
    front = starts.select(F.col("id").alias("root"), F.array("id").alias("path"), "id").distinct()
    out = None
    group = ["id", "edge_type", "direction"]
    for hop in range(1, max_hops + 1):
        rel, placed = _relations(nodes, edges, front)
        sizes = rel.groupBy(*group).agg(F.count("*").alias("__size"))
        step = placed.filter(F.col("position") <= per_group).join(sizes, group).withColumnRenamed("id", "__at")
        rows = front.select("root", "path", F.col("id").alias("__from")).join(step, F.col("__from") == F.col("__at"))
        back = F.array_contains(F.col("path"), F.col("other"))
        rows = materialize(rows.select("root", F.array_append("path", F.col("other")).alias("path"), F.col("other").alias("id"), "edge_type", "direction", F.lit(hop).alias("hop"), back.alias("back_reference"), (F.col("__size") > per_group).alias("has_more")), "relations")
        out = rows if out is None else out.union(rows)
        front = rows.filter("NOT back_reference").select("root", "path", "id").distinct()
    return out


def last_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, parent, value) for a tree map: the largest containing id, value at least 0.05."""
    up = edges.filter("edge_type = 'contains'").groupBy("target_id").agg(F.max("source_id").alias("parent"))
    return nodes.join(up, F.col("id") == F.col("target_id"), "left").select("id", "parent", F.greatest(F.coalesce("importance", F.lit(0.0)), F.lit(0.05)).alias("value"))


def resolve_edges(unresolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of target names: candidates have the name, or it as last dotted segment; one of the
    same file comes first, then the smallest id. Names without a candidate are left out.

    Candidates are first brought down to one for each name and file and one for each name, so a
    name that very many nodes bear adds no more rows than any other."""
    names = lambda c: F.explode(F.array_distinct(F.array(c, F.element_at(F.split(c, r"\."), -1))))
    keys = nodes.select("id", F.col("file_path").alias("__file"), names("name").alias("target_name")).filter("target_name <> ''")
    in_file = keys.groupBy("target_name", "__file").agg(F.min("id").alias("__near"))
    anywhere = keys.groupBy("target_name").agg(F.min("id").alias("__any"))
    asked = ["source_id", "edge_type", "__asked", "__file"]
    wanted = unresolved.select("source_id", "edge_type", F.col("target_name").alias("__asked"), F.col("file_path").alias("__file"), "weight", "context", names("target_name").alias("target_name"))
    met = wanted.join(anywhere, "target_name").join(in_file, ["target_name", "__file"], "left")
    best = F.min(F.struct(F.col("__near").isNull().alias("far"), F.coalesce("__near", "__any").alias("id")))
    found = met.groupBy(*asked).agg(best.alias("best"), F.max("weight").alias("weight"), F.min("context").alias("context"))
    return found.groupBy("source_id", F.col("best.id").alias("target_id"), "edge_type").agg(F.max("weight").alias("weight"), F.min("context").alias("context")).select("source_id", "target_id", "edge_type", "context", "weight")


def external_packages(unresolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """First segments of import targets that no node bears and that are not private."""
    head = F.element_at(F.split("target_name", r"\."), 1)
    names = unresolved.filter("edge_type = 'imports'").select(head.alias("package")).filter("package <> '' AND NOT startswith(package, '_')").distinct()
    own = nodes.select(F.element_at(F.split("name", r"\."), 1).alias("package")).distinct()
    return names.join(own, "package", "left_anti")


def overview_edges(nodes: DataFrame) -> DataFrame:
    """Containment of overviews: the project holds directories (1.0), these their modules (0.9)."""
    from ..functions.scalars import dirname

    dirs = nodes.filter("node_type = 'directory_overview'").select(F.col("id").alias("__dir"), F.col("file_path").alias("__path"))
    project = nodes.filter("node_type = 'project_overview'").agg(F.min("id")).first()[0]  # there is one
    top = dirs.filter(F.lit(project is not None)).select(F.lit(project).cast("string").alias("source_id"), F.col("__dir").alias("target_id"), F.lit("contains").alias("edge_type"), F.lit(1.0).alias("weight"))
    modules = nodes.filter("node_type = 'module'").select(F.col("id").alias("target_id"), dirname(F.col("file_path")).alias("__path"))
    low = dirs.join(modules, "__path").select(F.col("__dir").alias("source_id"), "target_id", F.lit("contains").alias("edge_type"), F.lit(0.9).alias("weight"))
    return top.union(low)


def start_ids(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")
