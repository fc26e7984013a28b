"""Building and refreshing a graph from a source tree: full, incremental and one-file updates."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, rollup, schema as S, store as st, text, vectors
from ..sources import database, files as src, python_code
from .shared import materialize


def extract(files: DataFrame, known: DataFrame | None = None, rules: text.Redaction | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, unresolved) of (file_path, content): parsed, resolved among themselves and
    the known nodes, with schema nodes and query edges, and with secrets redacted."""
    raw_nodes, raw_edges = python_code.parse_files(files)
    nodes = materialize(S.conform(raw_nodes, S.NODES), "nodes")
    unresolved = materialize(S.conform(raw_edges, S.UNRESOLVED), "unresolved")
    columns = database.detect_orm(nodes).unionByName(database.scan_ddl(files))
    columns = materialize(columns, "columns")
    db_nodes, db_edges = database.schema_graph(columns)
    if columns.isEmpty():
        db_nodes, db_edges = db_nodes.limit(0), db_edges.limit(0)
    every = nodes.unionByName(db_nodes)
    pool = every if known is None else every.unionByName(S.conform(known, S.NODES).join(every.select("id"), "id", "left_anti"))
    edges = S.conform(graph.resolve_edges(unresolved, pool), S.EDGES).unionByName(db_edges)
    edges = edges.unionByName(database.trace_queries(pool, edges))
    good, _ = st.valid_edges(edges.dropDuplicates(["source_id", "target_id", "edge_type"]), pool)
    return text.redact_nodes(every, rules).select(*every.columns), good, unresolved


def full_index(spark: SparkSession, root: str, out: st.Store, include: list[str] | None = None, rules: text.Redaction | None = None, components: int = vectors.COMPONENTS, embed: bool = True) -> dict[str, int]:
    """Index the tree at root into the store; what the code layer held before is replaced."""
    files = materialize(src.discover(spark, root, include), "files")
    nodes, edges, unresolved = extract(files, rules=rules)
    others = out.read("nodes").filter(~F.col("category").isin("codebase", "database"))
    links = out.read("edges").join(others.select("id"), F.col("source_id") == F.col("id"), "left_semi")
    nodes = nodes.unionByName(others)
    nodes = S.conform(graph.importance(nodes, edges), S.NODES)
    nodes, edges = rollup.regenerate_overviews(nodes, edges.unionByName(links))
    edges, rejected = st.valid_edges(S.conform(edges, S.EDGES), nodes)
    nodes = materialize(S.conform(text.summarize(nodes), S.NODES), "nodes")
    edges = materialize(S.conform(edges, S.EDGES), "edges")
    made = {"nodes": nodes, "edges": edges, "unresolved": unresolved, "postings": text.indexed(nodes)}
    if embed:
        made["embeddings"], model = vectors.embed_all(nodes, edges, components)
        made["model"] = model.rows(spark)
    stats = _state(spark, root, nodes, edges, files, out, made, full=True)
    out.write_all(made)
    return stats


def _state(spark: SparkSession, root: str, nodes: DataFrame, edges: DataFrame, files: DataFrame, out: st.Store, made: dict[str, DataFrame], full: bool) -> dict[str, int]:
    """Adds the state of files and index to the tables that are to be written; the totals."""
    now = F.current_timestamp()
    made["file_state"] = _file_state(files)
    stats = {r["measure"]: r["value"] for r in graph.graph_stats(nodes, edges).collect()}
    state = spark.createDataFrame([("main", head_commit(root), stats["total_nodes"], stats["total_edges"], stats["total_files"], "ast_only")], "key string, last_commit string, total_nodes long, total_edges long, total_files long, index_mode string")
    made["index_state"] = state.withColumn("last_full_index", now if full else F.lit(out.state()["last_full_index"])).withColumn("last_update", now)
    return stats


def _file_state(files: DataFrame) -> DataFrame:
    now = F.current_timestamp()
    return src.states(files).select("file_path", "content_hash", F.lit("sha256").alias("fingerprint_kind"), now.alias("last_indexed"), now.alias("last_verified"))


def incremental_update(spark: SparkSession, root: str, out: st.Store, include: list[str] | None = None, rules: text.Redaction | None = None) -> dict[str, int]:
    """Bring the store up to the tree: by fingerprints, files that are new or changed are parsed
    anew, those that are gone go, and all names are resolved again against what is there."""
    files = materialize(src.discover(spark, root, include), "files")
    diff = materialize(st.file_diff(src.states(files), out.read("file_state")), "diff")
    counts = {r["change"]: r["n"] for r in diff.groupBy("change").agg(F.count("*").alias("n")).collect()}  # four rows at most
    if not set(counts) - {"same"}:
        return counts
    touched = diff.filter("change <> 'same'").select("file_path")
    fresh = files.join(diff.filter("change IN ('new', 'changed')"), "file_path", "left_semi")
    old = out.read("nodes").filter(~F.col("node_type").isin(*graph.OVERVIEWS)).join(touched, "file_path", "left_anti")
    nodes, edges, unresolved = extract(fresh, old, rules)
    names = out.read("unresolved").join(touched, "file_path", "left_anti").unionByName(unresolved)
    every = old.join(nodes.select("id"), "id", "left_anti").unionByName(nodes)
    gone = out.read("nodes").join(touched, "file_path", "left_semi").select("id")
    # What is resolved from names is made anew; of the rest, schema edges among it, what begins in a touched file goes.
    named = F.col("edge_type").isin("contains", "calls", "imports", "inherits", "implements")
    schema_ids = old.filter("category = 'database'").select(F.col("id").alias("__db"))
    kept = out.read("edges").join(gone, F.col("source_id") == F.col("id"), "left_anti").join(schema_ids, F.col("source_id") == F.col("__db"), "left").filter(~named | F.col("__db").isNotNull()).drop("__db")
    whole = S.conform(graph.resolve_edges(names, every), S.EDGES).unionByName(edges).unionByName(kept)
    whole, _ = st.valid_edges(whole.dropDuplicates(["source_id", "target_id", "edge_type"]), every)
    every, whole = rollup.regenerate_overviews(S.conform(graph.importance(every, whole), S.NODES), whole)
    every = materialize(S.conform(text.summarize(every), S.NODES), "nodes")
    whole = materialize(S.conform(st.valid_edges(whole, every)[0], S.EDGES), "edges")
    made = {"nodes": every, "edges": whole, "unresolved": names, "postings": _postings(out, every)}
    model = vectors.load_model(out.read("model"))
    held = out.read("embeddings").first()
    if model is not None and held is not None:  # the index was made with vectors
        components = len(held["embedding"]) - vectors.STRUCT_DIMS
        made["embeddings"], model = vectors.update_embeddings(every, whole, out.read("embeddings"), model, components)
        made["model"] = model.rows(spark)
    _state(spark, root, every, whole, files, out, made, full=False)
    out.write_all(made)
    return counts


def _postings(out: st.Store, nodes: DataFrame) -> DataFrame:
    """The stored postings brought up to nodes."""
    hashes = nodes.select(F.col("id").alias("node_id"), F.xxhash64(F.concat_ws(" ", *text.FTS_FIELDS)).alias("text_hash"))
    return text.current_postings(out.read("postings"), nodes).join(hashes, "node_id")


def micro_update(out: st.Store, files: DataFrame) -> None:
    """Replace what a few files (file_path, content) gave, their names and their states among it;
    importance, overviews and vectors stay, those of nodes that are gone excepted."""
    before, links = out.read("nodes"), out.read("edges")
    own = files.select("file_path")
    nodes, edges, unresolved = extract(files, before.join(own, "file_path", "left_anti"))
    gone = before.join(own, "file_path", "left_semi").select("id", "importance")
    old_nodes, _, _ = st.delete_files(before, links, files)
    fresh = text.summarize(S.conform(nodes, S.NODES).drop("importance").join(gone, "id", "left"))
    whole = materialize(old_nodes.join(nodes.select("id"), "id", "left_anti").unionByName(S.conform(fresh, S.NODES)), "nodes")
    # Edges from elsewhere into these files stay where their end is still there.
    kept = links.join(gone.select("id"), F.col("source_id") == F.col("id"), "left_anti")
    links = materialize(st.valid_edges(kept.unionByName(edges).dropDuplicates(["source_id", "target_id", "edge_type"]), whole)[0], "edges")
    names = out.read("unresolved").join(own, "file_path", "left_anti").unionByName(unresolved)
    states = out.read("file_state").join(own, "file_path", "left_anti").unionByName(_file_state(files))
    vectors_left = out.read("embeddings").join(whole.select("id"), F.col("node_id") == F.col("id"), "left_semi")
    out.write_all({"nodes": whole, "edges": links, "unresolved": names, "file_state": states, "embeddings": vectors_left, "postings": _postings(out, whole)})


def head_commit(root: str) -> str:
    """The commit that the tree is at; '' without version control."""
    done = subprocess.run(["git", "-C", root.removeprefix("file://"), "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    return done.stdout.strip() if done.returncode == 0 else ""
