"""What a user asks of an indexed graph: search, inspection, impact, status, sessions."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, graph, lifecycle, rollup, schema as S, text, vectors
from ..operators.store import Store
from ..sources import version_control as vc


def search(store: Store, query: str, model: vectors.Model | None = None, limit: int = 10, language: str | None = None, include_archived: bool = False, components: int = vectors.COMPONENTS) -> DataFrame:
    """(id, name, node_type, file_path, score, match_type) for `key:value` filters and free text.

    By vectors where a model is given, else (or if they find nothing) by BM25 and substrings.
    Filters hold before the limit, so none of the best is lost to it. BM25 counts over all nodes,
    from the stored postings; nodes that changed since are indexed anew.
    """
    found, words = filters.parse_query(query)
    nodes, edges = store.read("nodes"), store.read("edges")
    allowed = filters.apply_filters(nodes, found, edges, language, include_archived)
    shown = ["id", "name", "node_type", "file_path", "score", "match_type"]
    if model is not None:
        asked = vectors.embed_query(store.spark, words, model, components)
        ids = allowed.select(F.col("id").alias("node_id"))
        sims = vectors.similarity(store.read("embeddings").join(ids, "node_id", "left_semi"), asked).select(F.col("node_id").alias("id"), "similarity")
        ranked = vectors.semantic_search(allowed, edges, sims, words, limit).join(nodes.select("id", "name", "node_type", "file_path"), "id")
        if any(asked):
            return ranked.select(*shown).orderBy(F.desc("score"), "id")
    ranked = text.search(allowed, text.current_postings(store.read("postings"), nodes), words, limit)
    return ranked.withColumn("match_type", F.lit("text")).select(*shown).orderBy(F.desc("score"), "id")


def inspect(store: Store, node_id: str, chain_depth: int = 4) -> dict[str, list]:
    """One node, its neighbourhood by role (at most ten of each) and its call chains (at most
    three each way). A ValueError if there is no such node."""
    nodes, edges = store.read("nodes"), store.read("edges")
    row = filters.by_id(nodes, node_id).first()
    if row is None:
        raise ValueError(f"no node {node_id!r}")
    start = graph.start_ids(store.spark, node_id)
    near = graph.neighborhood(nodes, edges, start).join(nodes.select("id", "name"), "id")
    out: dict[str, list] = {"node": [row.asDict()]}
    for r in filters.top_per_group(near, ["role"], [F.col("name"), F.col("id")], 10).orderBy("role", "name", "id").collect():
        out.setdefault(r["role"], []).append(r["name"])
    for way in ("up", "down"):
        found = graph.call_chains(nodes, edges, start, way, chain_depth).filter(F.size("chain") > 1)
        out[f"chains_{way}"] = [r["chain"] for r in found.orderBy(F.desc(F.size("chain")), "chain").limit(3).collect()]
    return out


def impact(store: Store, node_id: str, max_depth: int = 3) -> str:
    """What depends on a node, as a report by file."""
    nodes = store.read("nodes")
    found = graph.impact(nodes, store.read("edges"), graph.start_ids(store.spark, node_id), max_depth)
    return rollup.impact_report(found, nodes, node_id)


def status(store: Store, root: str, threshold: int = 5) -> dict[str, object]:
    """State of the index against the tree: uninitialised, healthy or stale, and why."""
    state = store.state()
    behind = vc.commits_behind(root, state["last_commit"] or "")
    changed = vc.changed_files(store.spark, root, state["last_commit"] or "").count() if state["last_commit"] else 0
    return {"status": lifecycle.staleness(vc.head(root), state, behind, changed, threshold), "commits_behind": behind, "changed_files": changed, **{k: state[k] for k in ("total_nodes", "total_edges", "total_files", "last_commit")}}


def enrich(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """nodes with what a language server knows: facts (id, lsp_type_info, lsp_hover_doc,
    lsp_diagnostics), one row a node; texts are cut to 300 and 500 characters, lists to ten."""
    names = ("lsp_type_info", "lsp_hover_doc", "lsp_diagnostics")
    f = facts.select("id", F.substring("lsp_type_info", 1, 300).alias("__0"), F.substring("lsp_hover_doc", 1, 500).alias("__1"), F.slice("lsp_diagnostics", 1, 10).alias("__2"))
    joined = nodes.join(f, "id", "left")
    made = {n: F.coalesce(F.col(f"__{k}"), F.col(n)).alias(n) for k, n in enumerate(names)}
    return joined.select(*[made.get(c, F.col(c)) for c in nodes.columns])


def worth_enriching(nodes: DataFrame, least: float = 0.3) -> DataFrame:
    """Important code nodes that are not made by the index itself."""
    return nodes.filter((F.col("importance") >= least) & (F.col("category") == "codebase") & ~F.col("file_path").startswith("__"))


# -- sessions and sinks --------------------------------------------------------------------


def start_session(store: Store, session_id: str, now: datetime | None = None) -> str:
    """Log a session and return the context that it begins with."""
    _log(store, session_id, now, {"event": "start"})
    return rollup.context_snapshot(store.read("nodes"), store.read("edges"))


def end_session(store: Store, session_id: str, now: datetime | None = None) -> int:
    """Archive what is finished, close the session's entry; how many items were archived."""
    nodes = store.read("nodes")
    done = lifecycle.archive_completed(nodes)
    count = done.filter(S.active()).count()
    archived = nodes.filter(S.active()).count() - count
    if archived:
        store.write("nodes", done)
    _log(store, session_id, now, {"event": "end", "archived": str(archived)}, end=True)
    return archived


def _log(store: Store, session_id: str, now: datetime | None, data: dict[str, str], end: bool = False) -> None:
    when = now or datetime.now(timezone.utc)
    row = store.spark.createDataFrame([(session_id, when, when if end else None, data)], S.SESSION_LOG)
    from ..operators.store import upsert_sessions

    store.write("session_log", upsert_sessions(store.read("session_log"), row))


def recent_sessions(store: Store, most: int = 10) -> DataFrame:
    return store.read("session_log").orderBy(F.desc("started_at"), "session_id").limit(most)


def dashboard_rows(nodes: DataFrame, edges: DataFrame, most: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as a viewer takes them: the most important nodes with short texts, and the
    edges among them."""
    limits = {"summary_short": 200, "summary_detailed": 800, "lsp_hover_doc": 300, "raw_code": 3000, "lsp_diagnostics": 10}
    shown = filters.truncated(nodes.orderBy(F.desc("importance"), "id").limit(most), limits)
    return shown, filters.visible_edges(edges, shown)


def write_dashboard(nodes: DataFrame, edges: DataFrame, folder: str, most: int = 5000) -> None:
    """dashboard_rows as JSON lines under folder/nodes and folder/edges."""
    for name, df in zip(("nodes", "edges"), dashboard_rows(nodes, edges, most)):
        df.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")


def markdown_context(spark: SparkSession, store: Store, root: str = "") -> str:
    """The session's context as Markdown: snapshot, topics, sizes and the last commits."""
    nodes = store.read("nodes")
    topics = ", ".join(f"{r['topic']} ({r['n']})" for r in rollup.insight_topics(nodes).orderBy(F.desc("n"), "topic").limit(10).collect())
    sizes = ", ".join(f"{r['measure']} {r['value']}" for r in graph.graph_stats(nodes, store.read("edges")).orderBy("measure").collect())
    parts = [rollup.context_snapshot(nodes, store.read("edges")), f"## Insight topics\n{topics}" if topics else "", f"## Sizes\n{sizes}"]
    log = vc.recent_log(root) if root else []
    return "\n\n".join([p for p in parts if p] + (["## Commits\n" + "\n".join(f"- {x}" for x in log)] if log else []))
