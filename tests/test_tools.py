"""Search, inspection, status, sessions and settings on a small index."""

import json
import subprocess
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import lifecycle, schema, store, vectors
from weftgraph.plans import indexing, tools
from weftgraph.plans.config import Config
from weftgraph.sources import version_control as vc


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("src")
    (root / "auth.py").write_text('"""Logins."""\n\n\nclass Auth:\n    """Checks passwords."""\n\n    def login(self, name):\n        return check(name)\n\n\ndef check(name):\n    """Look a password up."""\n    return bool(name)\n\n\ndef main():\n    check("x")\n')
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "first")
    out = store.Store(spark, f"file://{tmp_path_factory.mktemp('store')}")
    indexing.full_index(spark, f"file://{root}", out, components=8, embed=False)
    made, model = vectors.embed_all(out.read("nodes"), out.read("edges"), 8)
    out.write("embeddings", made)
    return root, out, model


def test_search(indexed):
    _, out, model = indexed
    rows = tools.search(out, "type:function password", model, components=8).collect()
    assert {r["name"] for r in rows} <= {"check", "main"} and rows[0]["name"] == "check"
    assert [r["name"] for r in tools.search(out, "type:class password").collect()] == ["Auth"]
    assert tools.search(out, "zzzz", model, components=8).count() == 0


def test_inspect_and_impact(indexed):
    _, out, _ = indexed
    key = out.read("nodes").filter("name = 'check'").first()["id"]
    got = tools.inspect(out, key)
    assert got["caller"] == ["Auth.login", "main"] and len(got["chains_up"]) == 2 and got["parent"] == ["auth"]
    assert "2 affected, 2 directly" in tools.impact(out, key)
    with pytest.raises(ValueError):
        tools.inspect(out, "nothing")


def test_status_and_git(indexed, spark, tmp_path):
    root, out, _ = indexed
    assert tools.status(out, str(root))["status"] == "healthy" and len(vc.recent_log(str(root))) == 1
    (root / "auth.py").write_text("x = 1\n")
    assert tools.status(out, str(root)) | {"total_nodes": 0, "total_edges": 0} == {"status": "stale", "commits_behind": 0, "changed_files": 1, "total_nodes": 0, "total_edges": 0, "total_files": out.state()["total_files"], "last_commit": vc.head(str(root))}
    assert vc.head(str(tmp_path)) == "" and vc.commits_behind(str(root), "nothing") == 0
    assert tools.status(store.Store(spark, f"file://{tmp_path}/none"), str(root))["status"] == "uninitialised"


def test_sessions(indexed):
    _, out, _ = indexed
    bug, _ = lifecycle.add_bug(out.read("nodes"), "It hangs")
    out.upsert("nodes", bug.withColumn("bug_status", F.lit("fixed")))
    assert "## Key code" in tools.start_session(out, "s1", datetime(2024, 1, 1))
    assert tools.end_session(out, "s1", datetime(2024, 1, 2)) == 1 and tools.end_session(out, "s2", datetime(2024, 1, 3)) == 0
    rows = tools.recent_sessions(out).collect()
    assert [r["session_id"] for r in rows] == ["s2", "s1"] and rows[1]["started_at"] == datetime(2024, 1, 1) and rows[1]["data"]["archived"] == "1"


def test_enrich_and_dashboard(indexed, spark, tmp_path):
    root, out, _ = indexed
    nodes = out.read("nodes")
    key = nodes.filter("name = 'check'").first()["id"]
    facts = spark.createDataFrame([(key, "t" * 400, "doc", [str(k) for k in range(20)])], "id string, lsp_type_info string, lsp_hover_doc string, lsp_diagnostics array<string>")
    row = tools.enrich(nodes, facts).filter(F.col("id") == key).first()
    assert len(row["lsp_type_info"]) == 300 and row["lsp_hover_doc"] == "doc" and len(row["lsp_diagnostics"]) == 10
    assert tools.enrich(nodes, facts).schema.names == schema.NODES.names and tools.worth_enriching(nodes).filter("name = 'check'").count() == 1
    tools.write_dashboard(nodes, out.read("edges"), f"{tmp_path}/d", most=4)
    assert spark.read.json(f"{tmp_path}/d/nodes").count() == 4
    assert "## Sizes" in tools.markdown_context(spark, out, str(root)) and "- " in tools.markdown_context(spark, out, str(root))


def test_config():
    c = Config.loads(json.dumps({"include_patterns": ["**/*.py"], "mode": "both", "unknown": 1, "redaction": {"custom": ["a+"], "old": 2}}))
    assert c.include == ["**/*.py"] and c.summary_mode == "both" and c.redaction.custom == ["a+"]
    c.add_exclude("x/**")
    c.add_exclude("x/**")
    c.add_redaction_pattern(r"ID-\d+")
    c.set_staleness_threshold(9)
    assert Config.loads(c.dumps()) == c and c.exclude == ["x/**"]
    for bad in (lambda: c.set_mode("fast"), lambda: c.set_staleness_threshold(0)):
        with pytest.raises(ValueError):
            bad()
