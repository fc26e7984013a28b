"""Graph operators against small models in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import filters, graph, schema, store
from weftgraph.plans import shared, starschema

NODE = "id string, name string, node_type string, file_path string, is_public boolean, category string, archived boolean, importance double"


def nodes(spark, *ids, kind="function", **more):
    return spark.createDataFrame([(i, i, more.get(i, kind), f"{i[0]}.py", not i.startswith("_"), "codebase", None, 0.0) for i in ids], NODE)


def edges(spark, *pairs, kind="calls"):
    return spark.createDataFrame([(*p, *([kind] if len(p) == 2 else []), 1.0) for p in pairs], "source_id string, target_id string, edge_type string, weight double")


def scores(df):
    return {r["id"]: r["importance"] for r in df.collect()}


def test_callee_of_two_is_most_important(spark):
    s = scores(graph.importance(nodes(spark, "a", "b", "c"), edges(spark, ("a", "c"), ("b", "c"))))
    assert s["c"] == 1.0 and s["a"] == s["b"] == pytest.approx((0.5 + 0.2) / (2 + 0.2), abs=1e-3)


def test_type_and_visibility_weigh_without_edges(spark):
    s = scores(graph.importance(nodes(spark, "f", "_p", "k", "u", k="class", u="unheard"), edges(spark).limit(0)))
    assert s == {"k": 1.0, "f": 0.5, "_p": 0.417, "u": 0.125}
    assert scores(graph.importance(nodes(spark, "f").limit(0), edges(spark))) == {}


def test_archived_nodes_can_keep_their_decay(spark):
    n = nodes(spark, "a", "b").withColumn("archived", F.col("id") == "b")
    assert scores(graph.importance(n, edges(spark).limit(0), respect_archived=True)) == {"a": 1.0, "b": 0.3}


def test_profile_shares_and_loops(spark):
    e = edges(spark, ("a", "b"), ("a", "a"), ("a", "b", "uses"), ("a", "b", "queries"))
    row = {r["id"]: r for r in graph.edge_profile(nodes(spark, "a", "b", "c"), e).collect()}
    assert row["a"]["calls"] == 3 / 5 and row["a"]["uses"] == 1 / 5 and row["c"]["calls"] == 0


def test_neighborhood_roles(spark):
    e = edges(spark, ("p", "x", "contains"), ("p", "y", "contains"), ("x", "c", "contains"), ("a", "x"), ("x", "b"), ("ghost", "x"))
    n = nodes(spark, "p", "x", "y", "c", "a", "b")
    got = {(r["role"], r["id"]) for r in graph.neighborhood(n, e, graph.start_ids(spark, "x", "nobody")).collect()}
    assert got == {("parent", "p"), ("sibling", "y"), ("child", "c"), ("caller", "a"), ("callee", "b")}
    only = {(r["role"], r["id"]) for r in graph.neighborhood(n, e, graph.start_ids(spark, "x"), ["calls"]).collect()}
    assert only == {("caller", "a"), ("callee", "b")}


def chains_model(out, start, depth):
    got = set()

    def walk(chain):
        if len(chain) == depth or not out.get(chain[-1]):
            got.add(tuple(chain))
            return
        for x in out[chain[-1]]:
            if x in chain:
                got.add(tuple(chain))
            else:
                walk([*chain, x])

    walk([start])
    return got


@pytest.mark.parametrize("seed", range(4))
def test_chains_equal_the_model(spark, seed):
    r = random.Random(seed)
    ids = [f"n{k}" for k in range(7)]
    pairs = sorted({(r.choice(ids), r.choice(ids)) for _ in range(10)})
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    got = {tuple(x["chain"]) for x in graph.call_chains(nodes(spark, *ids), edges(spark, *pairs), graph.start_ids(spark, "n0"), "down", 4).collect()}
    assert got == chains_model(out, "n0", 4)


def test_chain_depth_and_cycle(spark):
    line = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"))
    n = nodes(spark, "a", "b", "c", "d", "e")
    down = graph.call_chains(n, line, graph.start_ids(spark, "a"), "down", 2).collect()
    assert [r["chain"] for r in down] == [["a", "b"]]
    up = graph.call_chains(n, line, graph.start_ids(spark, "c"), "up").collect()
    assert [r["chain"] for r in up] == [["c", "b", "a"]]
    loop = graph.call_chains(nodes(spark, "x", "y"), edges(spark, ("x", "y"), ("y", "x")), graph.start_ids(spark, "x"), "down").collect()
    assert [r["chain"] for r in loop] == [["x", "y"]]


@pytest.mark.parametrize("seed", range(3))
def test_impact_equals_breadth_first_search(spark, seed):
    r = random.Random(seed)
    ids = [f"n{k}" for k in range(15)]
    pairs = sorted({(r.choice(ids), r.choice(ids), r.choice(["calls", "inherits", "uses"])) for _ in range(25)})
    back = {}
    for a, b, kind in pairs:
        if kind != "uses":
            back.setdefault(b, set()).add(a)
    seen, front = {"n0": 0}, {"n0"}
    for hop in range(1, 4):
        front = {a for x in front for a in back.get(x, ())} - set(seen)
        seen |= dict.fromkeys(front, hop)
    got = {x["id"]: x["hop"] for x in graph.impact(nodes(spark, *ids), edges(spark, *pairs), graph.start_ids(spark, "n0"), max_depth=2).collect()}
    assert got == {k: v for k, v in seen.items() if v}


def test_impact_walks_through_overviews(spark):
    n = nodes(spark, "a", "o", "z", o="directory_overview")
    got = graph.impact(n, edges(spark, ("o", "a"), ("z", "o")), graph.start_ids(spark, "a")).collect()
    assert {(r["id"], r["hop"]) for r in got} == {("z", 2)}


def test_tree_and_cycles(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("a", "ghost"), kind="contains")
    tree = graph.containment_tree(nodes(spark, "a", "b", "c", "x", "y"), e)
    assert {(r["id"], r["depth"]) for r in tree.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_resolution_prefers_the_same_file(spark):
    n = spark.createDataFrame([("1", "run", "a.py"), ("2", "run", "b.py"), ("3", "pkg.mod.go", "c.py")], "id string, name string, file_path string")
    u = spark.createDataFrame([("s", "x.run", "calls", "", "b.py", 1.0), ("s", "run", "imports", "", "z.py", 1.0), ("s", "go", "calls", "", "q.py", 1.0), ("s", "nothing", "calls", "", "q.py", 1.0), ("s", "a.", "calls", "", "q.py", 1.0)], "source_id string, target_name string, edge_type string, context string, file_path string, weight double")
    got = {(r["target_id"], r["edge_type"]) for r in graph.resolve_edges(u, n).collect()}
    assert got == {("2", "calls"), ("1", "imports"), ("3", "calls")}


def test_query_language():
    assert filters.parse_query("type:class auth") == ({"type": "class"}, "auth")
    assert filters.parse_query("type:Class type:x file:A.py") == ({"type": "class", "file": "a.py"}, "type:x")
    assert filters.parse_query("layer:bugs") == ({"layer": "bugs"}, "layer:bugs")
    assert filters.parse_query("subtype:x") == ({}, "subtype:x")


def test_file_references(spark):
    n = spark.createDataFrame([("1", "app/auth.py", "codebase"), ("2", "tests/auth.py", "codebase"), ("3", "auth.py", "bugs"), ("4", "my_auth.py", "codebase")], "id string, file_path string, category string")
    refs = spark.createDataFrame([("app/auth.py",), ("/x/tests/auth.py",), ("other/auth.py",), ("auth.py",), ("none.go",)], "ref string")
    got = {(r["ref"], r["id"], r["score"]) for r in filters.match_files(n, refs).collect()}
    assert got == {("app/auth.py", "1", 3), ("/x/tests/auth.py", "2", 2), ("other/auth.py", "1", 1), ("other/auth.py", "2", 1), ("auth.py", "1", 2), ("auth.py", "2", 2), ("auth.py", "4", 2)}


def test_upserts_replace_whole_rows(spark):
    now = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")
    new = spark.createDataFrame([("a", 9, None, 1), ("a", 8, "z", 2), ("c", 3, "w", 1)], "id string, n int, s string, __version int")
    assert {tuple(r) for r in store.upsert(now, new, ["id"]).collect()} == {("a", 8, "z"), ("b", 2, "y"), ("c", 3, "w")}


def test_sessions_keep_their_start(spark):
    t = "session_id string, started_at timestamp, ended_at timestamp, data map<string,string>"
    from datetime import datetime

    old = spark.createDataFrame([("s", datetime(2024, 1, 1), None, {})], t)
    new = spark.createDataFrame([("s", datetime(2024, 1, 2), datetime(2024, 1, 3), {"k": "v"}), ("r", datetime(2024, 1, 2), None, {})], t)
    got = {r["session_id"]: r for r in store.upsert_sessions(old, new).collect()}
    assert got["s"]["started_at"] == datetime(2024, 1, 1) and got["s"]["data"] == {"k": "v"} and len(got) == 2


def test_dangling_edges_are_set_apart(spark):
    good, bad = store.valid_edges(edges(spark, ("a", "b"), ("a", "x"), ("x", "a")), nodes(spark, "a", "b"))
    assert good.count() == 1 and bad.count() == 2


def test_store_swaps_snapshots(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    assert s.read("nodes").count() == 0 and s.state()["index_mode"] == "ast_only"
    s.write("nodes", nodes(spark, "a", "b"))
    first = s.current("nodes")
    s.upsert("nodes", nodes(spark, "b", "c", kind="class"))
    assert {(r["id"], r["node_type"]) for r in s.read("nodes").collect()} == {("a", "function"), ("b", "class"), ("c", "class")}
    assert s.current("nodes") != first and s.read("nodes").schema == schema.NODES
    s.write("nodes", s.read("nodes").filter("id = 'a'"))
    assert s.read("nodes").count() == 1


def test_only_some_fields_can_be_edited(spark):
    n = nodes(spark, "a", "b")
    got = {r["id"]: r["importance"] for r in store.update_field(n, "a", "importance", 0.7).collect()}
    assert got == {"a": 0.7, "b": 0.0}
    with pytest.raises(ValueError):
        store.update_field(n, "a", "id", "z")


def test_unknown_values_are_found(spark):
    n = spark.createDataFrame([("a", "class", None, None, None), ("b", "klass", None, None, None), ("c", "task", "later", None, None), ("d", "task", "done", None, "urgent")], "id string, node_type string, task_status string, bug_status string, priority string")
    assert {r["id"] for r in schema.invalid_nodes(n).collect()} == {"b", "c", "d"}


def test_two_writers(spark, tmp_path):
    a, b = store.Store(spark, f"file://{tmp_path}/store"), store.Store(spark, f"file://{tmp_path}/store")
    a.write("nodes", nodes(spark, "a"))
    first, second = a.read("nodes"), b.read("nodes")
    a.write("nodes", first.unionByName(schema.conform(nodes(spark, "b"), schema.NODES)))
    b.write("edges", edges(spark, ("a", "b")))  # another table: both stay
    with pytest.raises(store.Conflict):
        b.write("nodes", second.limit(0))
    assert a.read("nodes").count() == 2 and a.read("edges").count() == 1
    a.write_all({"nodes": a.read("nodes").limit(1), "edges": a.read("edges").limit(0)})
    assert b.read("nodes").count() == 1 and b.read("edges").count() == 0
    b.write("nodes", nodes(spark, "z"))
    assert [r["id"] for r in a.read("nodes").collect()] == ["z"]


def test_a_hot_name_adds_no_rows(spark):
    n = spark.range(100_000).selectExpr("concat('n', lpad(id, 6, '0')) AS id", "'run' AS name", "concat('f', id % 50, '.py') AS file_path")
    u = spark.range(200).selectExpr("concat('s', id) AS source_id", "'x.run' AS target_name", "'calls' AS edge_type", "'' AS context", "concat('f', id % 100, '.py') AS file_path", "1.0D AS weight", "id AS ordinal")
    got = {r["source_id"]: r["target_id"] for r in graph.resolve_edges(u, n).collect()}
    assert got == {f"s{k}": f"n{k % 100 if k % 100 < 50 else 0:06d}" for k in range(200)}


def test_file_references_equal_brute_force(spark):
    paths = [f"{d}{f}" for d in ("", "a/", "b/a/", "src/x/", "a\\") for f in ("main.py", "in.py", "util.py", "x.py")]
    refs = ["main.py", "/a/main.py", "in.py", "n.py", "b\\a\\util.py", "repo/src/x/x.py", "zzz/util.py", "none.txt", " a/x.py ", ""]
    n = spark.createDataFrame([(f"{k:03d}", "codebase", p) for k, p in enumerate(paths)], "id string, category string, file_path string")
    want = set()
    for ref in refs:
        t = ref.strip().lstrip("/\\").replace("\\", "/")
        score = {}
        for k, p in enumerate(p.replace("\\", "/") for p in paths):
            score[f"{k:03d}"] = 0 if not t else 3 if p == t else 2 if p.endswith(t) or t.endswith(p) else 1 if p.split("/")[-1] == t.split("/")[-1] else 0
        best = max(score.values())
        want |= {(ref, i, best) for i in sorted(i for i, s in score.items() if s == best)[:3] if best}
    got = filters.match_files(n, spark.createDataFrame([(r,) for r in refs], "ref string"))
    assert {(r["ref"], r["id"], r["score"]) for r in got.collect()} == want


def test_hubs_in_lists_and_trees(spark):
    n = nodes(spark, "hub", *(f"k{i:03d}" for i in range(50)))
    e = edges(spark, *(("hub", f"k{i:03d}") for i in range(50)))
    parts = {r["part"]: len(r["outgoing"]) for r in graph.adjacency(e, most=20).filter("id = 'hub'").collect()}
    assert parts == {0: 20, 1: 20, 2: 10}
    tree = graph.relationship_tree(n, e, n.filter("id = 'hub'"), max_hops=1, per_group=5).collect()
    assert len(tree) == 5 and all(r["has_more"] for r in tree)


def test_a_cluster_needs_a_shared_folder():
    from weftgraph.plans import shared

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):
            return {}

    spark = type("Session", (), {"sparkContext": Context()})()
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        Context.master = master
        with pytest.raises(ValueError):
            shared.shared_dir(spark)


def test_scratch_deletes_what_is_not_kept(spark):
    import glob

    from weftgraph.plans.shared import keep, materialize, scratch, shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    with scratch(spark):
        materialize(nodes(spark, "a"), "scratch-gone")
        held = keep(materialize(nodes(spark, "a", "b"), "scratch-kept"))
    assert held.count() == 2 and not glob.glob(f"{folder}/scratch-gone-*") and glob.glob(f"{folder}/scratch-kept-*")


def test_tasks_group_no_more_lines_when_the_table_grows(spark, sf_dir, monkeypatch):
    assert shared.deal(spark.range(1000), "id", rows=100).rdd.getNumPartitions() == 10
    monkeypatch.setitem(shared.deal.__kwdefaults__, "rows", 200)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    made = starschema.edges(spark, sf_dir).filter("edge_type <> 'contains'")
    assert made.rdd.getNumPartitions() >= 2 * (lines // 200)  # as many as the session's shuffles before


def test_edges_stay_where_they_are_when_few_ends_are_missing(spark, monkeypatch):
    e, n = edges(spark, ("a", "b"), ("a", "x"), ("x", "a"), ("x", "y"), (None, "a")), nodes(spark, "a", "b", "b")
    for most in (store.SHORT, 0):
        monkeypatch.setattr(store, "SHORT", most)
        good, bad = store.valid_edges(e, n)
        assert [(r["source_id"], r["target_id"]) for r in good.collect()] == [("a", "b")]
        assert sorted(str((r["source_id"], r["target_id"])) for r in bad.collect()) == ["('a', 'x')", "('x', 'a')", "('x', 'y')", "(None, 'a')"]
        if most:
            assert "rightHint=(strategy=broadcast)" in bad._jdf.queryExecution().optimizedPlan().toString()  # edges were shuffled twice before
