"""Scanning code, schemas and logs; indexing a tree; streams."""

import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import lifecycle, rollup, schema, store, text, vectors
from weftgraph.plans import indexing, registry
from weftgraph.sources import database, files, logs, packages
from weftgraph.sources.other_code import parse_other
from weftgraph.sources.python_code import parse_files, parse_python
from weftgraph.streaming import ingest

MODULE = '"""Animals."""\nimport helpers\n\n\ndef greet(name: str) -> str:\n    """Say hello."""\n    return "hi " + name\n\n\ndef compute(x):\n    if x and x > 1:\n        return greet(str(x))\n    return 0\n\n\ndef _hidden():\n    pass\n\n\nclass Animal:\n    def speak(self):\n        return ""\n\n\nclass Dog(Animal):\n    @property\n    def speak(self):\n        return compute(2)\n'
SECOND = "from zoo import greet\n\nPASSWORD = 'hunter2hunter2'\n\n\ndef main():\n    greet('you')\n"
MODEL = "class User(Base):\n    __tablename__ = 'users'\n    id = Column(Integer, primary_key=True)\n\n\ndef load(session):\n    return session.query(User).all()\n"


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "pkg/__pycache__").mkdir(parents=True)
    (root / "zoo.py").write_text(MODULE)
    (root / "pkg/app.py").write_text(SECOND)
    (root / "pkg/models.py").write_text(MODEL)
    (root / "pkg/__pycache__/x.py").write_text("junk = 1")
    (root / "schema.sql").write_text("CREATE TABLE posts (id INT PRIMARY KEY, user_id INT NOT NULL REFERENCES users(id));")
    (root / "pkg/__init__.py").write_text("")
    (root / "README.md").write_text("no code")
    (root / "pyproject.toml").write_text("[project]")
    return root


def test_discovery(spark, tree):
    found = {r["file_path"]: r["language"] for r in files.discover(spark, f"file://{tree}").collect()}
    assert found == {"zoo.py": "python", "pkg/__init__.py": "python", "pkg/app.py": "python", "pkg/models.py": "python", "schema.sql": "sql"}
    assert files.expand_braces("**/*.{ts,tsx}") == ["**/*.ts", "**/*.tsx"]
    every = files.discover(spark, f"file://{tree}", include=["**"], exclude=())
    got = {r["language"]: (r["markers"], r["files"]) for r in files.detect_languages(every).collect()}
    assert got == {"python": (1, 5), "sql": (0, 1)}


def test_python_nodes_and_edges():
    nodes, edges = parse_python("zoo.py", MODULE)
    kinds = {(n["node_type"], n["name"]) for n in nodes}
    assert kinds == {("module", "zoo"), ("function", "greet"), ("function", "compute"), ("function", "_hidden"), ("class", "Animal"), ("method", "Animal.speak"), ("class", "Dog"), ("method", "Dog.speak")}
    by = {n["name"]: n for n in nodes}
    assert by["compute"]["complexity"] == 3 and not by["_hidden"]["is_public"] and by["greet"]["docstring"] == "Say hello." and by["Dog.speak"]["decorators"] == ["property"]
    links = {(e["edge_type"], e["target_name"]) for e in edges}
    assert {("imports", "helpers"), ("calls", "greet"), ("inherits", "Animal"), ("calls", "compute")} <= links
    broken, none = parse_python("x.py", "def (")
    assert [n["node_type"] for n in broken] == ["module"] and none == []
    assert parse_other("x.txt", "class A") == ([], [])


OTHERS = {
    "a.ts": ('import {x} from "./y";\nexport interface P { a: number }\nexport class A extends B implements C {\n  run() {}\n}\nexport const go = (a: number) => {\n  return foo(a) && bar.baz(1);\n};\n', {("interface", "P"), ("class", "A"), ("function", "go")}, {("imports", "./y"), ("inherits", "B"), ("implements", "C"), ("calls", "foo"), ("calls", "baz")}),
    "m.go": ('package m\nimport "fmt"\ntype T struct {\n A int\n}\nfunc (t *T) Run(x int) {\n fmt.Println(x)\n}\n', {("struct", "T"), ("method", "T.Run")}, {("imports", "fmt"), ("calls", "Println")}),
    "l.rs": ("use std::io;\npub struct S { a: i32 }\nimpl Tr for S {\n  pub fn f(&self) { go(1); }\n}\n", {("struct", "S"), ("method", "S.f")}, {("imports", "std::io"), ("implements", "Tr"), ("calls", "go")}),
    "r.rb": ("require 'set'\nclass A < B\n  def go(x)\n    run(x) if x\n  end\nend\n", {("class", "A"), ("method", "A.go")}, {("imports", "set"), ("inherits", "B"), ("calls", "run")}),
    "p.php": ("<?php\nuse App\\Db;\nclass A extends B {\n  public function go($x) {\n    run($x);\n  }\n}\n", {("class", "A"), ("method", "A.go")}, {("imports", "App\\Db"), ("inherits", "B"), ("calls", "run")}),
}


@pytest.mark.parametrize("path", sorted(OTHERS))
def test_other_languages(path):
    source, kinds, links = OTHERS[path]
    nodes, edges = parse_other(path, source)
    assert kinds <= {(n["node_type"], n["name"]) for n in nodes}
    assert links <= {(e["edge_type"], e["target_name"]) for e in edges}


PARAMETERS = ["a", "b", "c", "d", "e", "f", "g", "h"]
LONG_HEADERS = {
    "a.js": ("function go(\n" + "".join(f"  {p}, // one :(\n" for p in PARAMETERS) + ") {\n  if (a) target(a);\n}\n", 12),
    "b.js": ("function go(\n  { x, y },\n" + "".join(f"  {p} = ')',\n" for p in PARAMETERS) + ") {\n  if (a) target(a);\n}\n", 13),
    "a.ts": ("function go(\n" + "".join(f"  {p}: {{ x: number; }},\n" for p in PARAMETERS) + "): void {\n  if (a) target(a);\n}\n", 12),
    "a.go": ("func go(\n" + "".join(f"\t{p} int,\n" for p in PARAMETERS) + ") error {\n\tif a { target(a) }\n}\n", 12),
    "a.rs": ("fn go<'a>(\n" + "".join(f"    {p}: &'a [u8; 4],\n" for p in PARAMETERS) + ") -> u8\nwhere\n" + "".join(f"    {p.upper()}: Clone,\n" for p in PARAMETERS) + "{\n    if a { target(a) }\n}\n", 22),
    "a.php": ("<?php\nfunction go(\n" + "".join(f"    ${p},\n" for p in PARAMETERS) + "): int\n{\n    if ($a) { target($a); }\n}\n", 14),
}


@pytest.mark.parametrize("path", sorted(LONG_HEADERS))
def test_one_parameter_a_line(path):
    source, last = LONG_HEADERS[path]
    nodes, edges = parse_other(path, source + "\nfunction after() {\n}\n")
    go = next(n for n in nodes if n["name"] == "go")
    assert go["line_end"] == last and go["complexity"] > 1 and "target" in {e["target_name"] for e in edges if e["source_id"] == go["id"] and e["edge_type"] == "calls"}


def test_headers_without_a_body():
    nodes, _ = parse_other("a.ts", "function f(\n  a: string,\n  b: string,\n): void;\nconst g = (x: number) => foo(x, {a: 1})\nfunction h({ a })\n{\n  run(a)\n}\n")
    assert {n["name"]: (n["line_start"], n["line_end"]) for n in nodes if n["node_type"] == "function"} == {"f": (1, 4), "g": (5, 5), "h": (6, 9)}


def test_long_definitions_keep_their_code(spark):
    pad = "".join(f"    # filler line number {k} of a long class\n" for k in range(300))
    late = "    late = Column(Integer, primary_key=True)\n"
    model = "class User(Base):\n    __tablename__ = 'users'\n" + pad + late
    work = "def work(session):\n" + pad + "    api_key = 'abcdefgh12345'\n    return session.query(User).all()\n"
    other = "class Box {\n" + "  // filler line of a long class\n" * 400 + "  // the end\n}\n"
    df = spark.createDataFrame([("m.py", model + "\n\n" + work), ("b.js", other)], "file_path string, content string")
    nodes, edges, _ = indexing.extract(df)
    by = {(r["node_type"], r["name"]): r for r in nodes.collect()}
    assert any(kind == "column" and name.endswith("late") for kind, name in by)
    assert by["function", "work"]["has_redacted_content"] and by["function", "work"]["raw_code"].endswith("session.query(User).all()") and "abcdefgh12345" not in by["function", "work"]["raw_code"]
    assert by["class", "Box"]["raw_code"].endswith("// the end\n}") and len(by["module", "m"]["raw_code"]) == len(by["module", "b"]["raw_code"]) == 8000
    ids = {r["id"]: r["name"] for r in by.values()}
    assert ("work", "users", "queries") in {(ids[r["source_id"]], ids[r["target_id"]], r["edge_type"]) for r in edges.collect()}


def test_files_without_content(spark):
    df = spark.createDataFrame([("a.py", None), (None, "x = 1"), ("b.go", "")], "file_path string, content string")
    nodes, edges = parse_files(df)
    assert {r["name"] for r in nodes.collect()} == {"a", "b"} and edges.count() == 0


ORMS = {
    "sqlalchemy": ("class U(Base):\n    __tablename__ = 'users'\n    id = Column(Integer, primary_key=True)\n    name = Column(String, nullable=False)\n    org = Column(Integer, ForeignKey('orgs.id'))", "users", [("id", True, True, ""), ("name", False, False, ""), ("org", False, True, "orgs.id")]),
    "django": ("class BlogPost(models.Model):\n    title = models.CharField(max_length=9)\n    owner = models.ForeignKey('UserAccount', null=True)", "blog_post", [("title", False, False, ""), ("owner", False, True, "user_account.id")]),
    "typeorm": ('@Entity("people")\nclass P {\n  @PrimaryGeneratedColumn()\n  id: number;\n  @Column()\n  nick?: string;\n}', "people", [("id", True, False, ""), ("nick", False, True, "")]),
    "gorm": ('type BlogPost struct {\n ID uint `gorm:"primaryKey"`\n Title string `gorm:"column:headline;not null"`\n}', "blog_posts", [("id", True, True, ""), ("headline", False, False, "")]),
    "diesel": ("#[derive(Queryable)]\n#[diesel(table_name = posts)]\npub struct BlogPost {\n    pub id: i32,\n    pub title: String,\n}", "posts", [("id", False, True, ""), ("title", False, True, "")]),
}


@pytest.mark.parametrize("orm", sorted(ORMS))
def test_orm(spark, orm):
    code, table, cols = ORMS[orm]
    n = spark.createDataFrame([("n1", "BlogPost", "struct" if orm in ("gorm", "diesel") else "class", "f", code, "")], "id string, name string, node_type string, file_path string, raw_code string, summary_short string")
    rows = database.detect_orm(n).orderBy("ordinal").collect()
    assert {r["table_name"] for r in rows} == {table}
    assert [(r["column_name"], r["is_primary"], r["is_nullable"], r["foreign_key"]) for r in rows] == cols


def test_prisma():
    rows = database.parse_prisma("s.prisma", "model User {\n  id Int @id\n  name String?\n  posts Post[]\n  @@map(\"people\")\n}\n")
    assert [(r[0], r[4], r[6], r[7]) for r in rows] == [("people", "id", True, False), ("people", "name", False, True)]


def test_sqlite_catalog_and_graph(spark, tmp_path):
    path = str(tmp_path / "x.db")
    con = sqlite3.connect(path)
    con.executescript("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, email TEXT); CREATE TABLE posts (id INTEGER PRIMARY KEY, user_id INTEGER REFERENCES users(id), title TEXT);")
    con.close()
    columns = database.sqlite_catalog(spark, path)
    nodes, edges = database.schema_graph(columns, "x")
    assert {r["id"] for r in nodes.filter("node_type <> 'column'").collect()} == {"db::x", "table::users", "table::posts"}
    assert ("col::posts::user_id", "col::users::id", "references") in {tuple(r)[:3] for r in edges.select("source_id", "target_id", "edge_type").collect()}
    assert database.connection_kind("mysql+pymysql://h/d") == "mysql"
    with pytest.raises(ValueError):
        database.connection_kind("oracle://x")
    assert database.find_connection({}, 'DATABASE_URL="postgres://h/d"') == "postgres://h/d" and database.find_connection({}) is None


def test_information_schema(spark):
    c = spark.createDataFrame([("t", "id", "int", "NO", 1), ("t", "u", "int", "YES", 2)], "table_name string, column_name string, data_type string, is_nullable string, ordinal_position int")
    k = spark.createDataFrame([("t", "id", "PRIMARY KEY", None, None), ("t", "u", "FOREIGN KEY", "users", "id")], "table_name string, column_name string, constraint_type string, ref_table string, ref_column string")
    rows = database.catalog_rows(c, k).orderBy("ordinal").collect()
    assert [(r["column_name"], r["is_primary"], r["is_nullable"], r["foreign_key"]) for r in rows] == [("id", True, False, ""), ("u", False, True, "users.id")]


def test_log_import(spark):
    from datetime import datetime

    gotchas = "# Log\n\n## 2024-01-02 — Crash in zoo\n\n**File**: `zoo.py`\n**Root cause**: none\n**Fix**: restart\n\n## 2024-01-03 — Open one\n\ntext\n"
    tasks = "# Phase one\n\n## Status: COMPLETE\n\n## Fix 1 — Do it\n**Status**: [x] done\n**File**: `pkg/app.py` lines 3-9\n\n## Fix 2 — More\n**Status**: [ ] open\n"
    df = spark.createDataFrame([("gotchas.md", gotchas, datetime(2024, 1, 1)), ("tasks.md", tasks, datetime(2024, 1, 1)), ("old-tasks.md", tasks, datetime(2020, 1, 1))], "file_path string, content string, modified timestamp")
    code = spark.createDataFrame([("c1", "zoo.py", "codebase"), ("c2", "pkg/app.py", "codebase")], "id string, file_path string, category string")
    states = spark.createDataFrame([("old-tasks.md", datetime(2022, 1, 1))], "file_path string, last_indexed timestamp")
    nodes, edges = logs.import_logs(df, code, states)
    got = {(r["node_type"], r["name"], r["bug_status"] or r["task_status"]) for r in nodes.collect()}
    assert got == {("bug", "bug: Crash in zoo", "fixed"), ("bug", "bug: Open one", "open"), ("phase", "phase: Phase one", "done"), ("task", "task: Do it", "done"), ("task", "task: More", "pending")}
    assert sorted((r["edge_type"], r["weight"]) for r in edges.collect()) == [("phase_contains", 1.0), ("phase_contains", 1.0), ("relates_to", 0.7), ("relates_to", 0.8)]
    plain = spark.createDataFrame([("tasks.md", "no headings\n## Status: x\n## Only title\n")], "file_path string, content string")
    assert {r["name"] for r in logs.parse_tasks(plain)[0].collect()} == {"phase: tasks.md", "task: Only title"}


def test_package_docs(spark):
    wanted = spark.createDataFrame([("requests", "pypi"), ("left-pad", None), ("github.com/x/y", None), ("nowhere", None)], "package_name string, registry string")

    def fetch(url):
        answers = {"pypi.org/pypi/requests/": {"info": {"version": "2", "summary": "HTTP"}}, "npmjs.org/left-pad/": {"version": "1", "description": "pads"}, "golang.org/github.com/x/y/": {"Version": "v1"}}
        return next((v for k, v in answers.items() if k in url), None)

    got = {r["package_name"]: (r["registry"], r["version"]) for r in packages.fetch_docs(wanted, fetch).collect()}
    assert got == {"requests": ("pypi", "2"), "left-pad": ("npm", "1"), "github.com/x/y": ("go", "v1")}


def test_full_and_incremental_index(spark, tree, tmp_path):
    out = store.Store(spark, f"file://{tmp_path}/store")
    stats = indexing.full_index(spark, f"file://{tree}", out, components=8)
    nodes = {r["name"]: r for r in out.read("nodes").collect()}
    assert stats["total_nodes"] == len(out.read("nodes").collect()) and {"greet", "Dog", "main", "users", "posts", "dir: pkg", "project overview"} <= set(nodes)
    assert nodes["greet"]["importance"] > nodes["_hidden"]["importance"]
    assert nodes["app"]["has_redacted_content"] and "hunter2" not in nodes["app"]["raw_code"]
    named = {r["id"]: r["name"] for r in out.read("nodes").collect()}
    links = {(named[r["source_id"]], named[r["target_id"]], r["edge_type"]) for r in out.read("edges").collect()}
    assert {("main", "greet", "calls"), ("compute", "greet", "calls"), ("Dog", "Animal", "inherits"), ("User", "users", "defines"), ("load", "users", "queries"), ("project overview", "dir: pkg", "contains"), ("dir: pkg", "app", "contains")} <= links
    assert out.read("embeddings").count() == len(nodes) or out.read("embeddings").count() > 0
    assert indexing.incremental_update(spark, f"file://{tree}", out) == {"same": 5}
    (tree / "pkg/app.py").write_text(SECOND.replace("def main", "def start"))
    (tree / "schema.sql").unlink()
    (tree / "new.py").write_text("def fresh():\n    start()\n")
    assert indexing.incremental_update(spark, f"file://{tree}", out) == {"same": 3, "changed": 1, "removed": 1, "new": 1}
    named = {r["id"]: r["name"] for r in out.read("nodes").collect()}
    links = {(named[r["source_id"]], named[r["target_id"]], r["edge_type"]) for r in out.read("edges").collect()}
    assert "main" not in named.values() and "posts" not in named.values()
    assert {("start", "greet", "calls"), ("fresh", "start", "calls"), ("compute", "greet", "calls")} <= links
    one = spark.createDataFrame([("new.py", "def fresher():\n    greet('x')\n")], "file_path string, content string")
    indexing.micro_update(out, one)
    assert {"fresher", "greet"} <= {r["name"] for r in out.read("nodes").collect()} and out.read("nodes").filter("name = 'fresh'").count() == 0
    snapshot = rollup.context_snapshot(out.read("nodes"), out.read("edges"))
    assert "## Key code" in snapshot and len(snapshot) < 4 * rollup.DEFAULT_TOKENS


def test_items(spark):
    code = schema.conform(spark.createDataFrame([("c1", "zoo.py", "zoo"), ("c2", "lib/zoo.py", "zoo2")], "id string, file_path string, name string"), schema.NODES)
    bug, links = lifecycle.add_bug(code, "It crashes", ["zoo.py"])
    assert bug.first()["bug_status"] == "open" and [(r["target_id"], r["weight"]) for r in links.collect()] == [("c1", 0.8)]
    task, links = lifecycle.add_task(code, "Fix it", "One", ["lib/zoo.py"], status="new")
    assert {(r["node_type"], r["task_status"]) for r in task.collect()} == {("task", "pending"), ("phase", "in_progress")} and {r["edge_type"] for r in links.collect()} == {"relates_to", "phase_contains"}
    a, b = lifecycle.add_insight(code, "Caches are warm", "Perf ")[0].first(), lifecycle.add_insight(code, "caches ARE warm", "perf")[0].first()
    assert a["id"] == b["id"] and a["importance"] == 0.5 and a["name"].startswith("insight/perf:")
    nodes = code.unionByName(task)
    done = lifecycle.update_task(nodes, "fix", status="done", priority="high")
    assert {(r["task_status"], r["priority"]) for r in done.filter("node_type = 'task'").collect()} == {("done", "high")}
    with pytest.raises(ValueError):
        lifecycle.update_task(nodes, "fix", status="soon")
    with pytest.raises(ValueError):
        lifecycle.update_task(nodes, "nothing like it", status="done")
    gone = lifecycle.archive_completed(done).filter("node_type = 'task'").first()
    assert gone["archived"] and gone["importance"] == 0.15
    back = lifecycle.archive(lifecycle.archive_completed(done), spark.createDataFrame([(gone["id"],)], "id string"), False).filter(F.col("id") == gone["id"]).first()
    assert not back["archived"] and back["importance"] == 0.15
    assert lifecycle.staleness("a", {}, 0, 0) == "uninitialised" and lifecycle.staleness("a", {"total_nodes": 1, "last_commit": "a"}, 0, 0) == "healthy" and lifecycle.staleness("b", {"total_nodes": 1, "last_commit": "a"}, 9, 0) == "stale"


def test_stream_of_files(spark, tmp_path):
    from datetime import datetime

    out = store.Store(spark, f"file://{tmp_path}/store")
    extract = lambda df: (lambda n, e: (n, spark.createDataFrame([], schema.EDGES)))(*parse_files(df))

    def push(path, text, day):
        spark.createDataFrame([(path, text, datetime(2024, 1, day))], ingest.FILES).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.ingest(ingest.file_stream(spark, f"{tmp_path}/in"), out, extract, f"{tmp_path}/ck").awaitTermination(60)
        return {r["name"] for r in out.read("nodes").collect()}

    assert push("a.py", "def one():\n    pass\n", 1) == {"a", "one"}
    assert push("a.py", "def two():\n    pass\n", 2) == {"a", "two"}
    assert push("a.py", "def two():\n    pass\n", 3) == {"a", "two"}
    assert push("b.py", "def three():\n    pass\n", 4) == {"a", "two", "b", "three"}
    assert out.read("file_state").count() == 2


def test_streamed_windows_equal_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/ev")
    q = ingest.windowed_counts(stream, "ts", ["event_type"], "value").writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: {(r["window_start"], r["event_type"]): (r["n"], round(r["total"], 6)) for r in df.collect()}
    assert key(spark.table("win")) == key(ingest.windowed_counts(events, "ts", ["event_type"], "value"))


def test_update_leaves_nothing_behind(spark, tmp_path):
    root, out = tmp_path / "src", store.Store(spark, f"file://{tmp_path}/store")
    root.mkdir()
    filler = "".join(f"    x{k} = {k}\n" for k in range(1200))
    (root / "a.py").write_text(f'def load():\n{filler}    run("SELECT id FROM users")\n\n\ndef other():\n    pass\n')
    (root / "schema.sql").write_text("CREATE TABLE users (\n  id INTEGER PRIMARY KEY\n);\n")
    indexing.full_index(spark, f"file://{root}", out, components=4)
    asks = lambda: {(r["edge_type"]) for r in out.read("edges").filter("edge_type = 'queries'").collect()}
    assert asks() == {"queries"}  # the statement stands after the first 10,000 characters
    before, vectors_before = out.state(), {r["node_id"] for r in out.read("embeddings").collect()}
    (root / "a.py").write_text("def load():\n    pass\n\n\ndef fresh():\n    load()\n")
    indexing.incremental_update(spark, f"file://{root}", out)
    after, nodes = out.state(), out.read("nodes").collect()
    ids = {r["id"] for r in nodes}
    assert asks() == set() and after["last_update"] > before["last_update"] and after["last_full_index"] == before["last_full_index"]
    assert after["total_nodes"] == len(nodes) and all(r["summary_detailed"] for r in nodes)
    held = {r["node_id"] for r in out.read("embeddings").collect()}
    assert held == ids != vectors_before and len({len(r["embedding"]) for r in out.read("embeddings").collect()}) == 1
    one = spark.createDataFrame([("a.py", "def load():\n    pass\n\n\ndef fresher():\n    load()\n")], "file_path string, content string")
    indexing.micro_update(out, one)
    (root / "a.py").write_text(one.first()["content"])
    assert indexing.incremental_update(spark, f"file://{root}", out) == {"same": 2}
    assert {r["source_id"] for r in out.read("unresolved").collect()} <= {r["id"] for r in out.read("nodes").collect()}
    whole = store.Store(spark, f"file://{tmp_path}/whole")
    indexing.full_index(spark, f"file://{root}", whole, components=4)
    key = lambda s: sorted((r["source_id"], r["target_id"], r["edge_type"]) for r in s.read("edges").collect())
    assert key(out) == key(whole) and {r["id"] for r in out.read("nodes").collect()} == {r["id"] for r in whole.read("nodes").collect()}


def test_trees_are_listed_by_tasks(spark, tmp_path):
    for name in ("top.py", "a/__init__.py", "a/b/c.py", "d e/x#y.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    listed = files.list_files(spark, f"file://{tmp_path}")
    assert {r["file_path"]: r["size"] for r in listed.collect()} == {n: len(n) for n in ("top.py", "a/__init__.py", "a/b/c.py", "d e/x#y.py")}
    assert {r["file_path"]: r["content"] for r in files.read_contents(listed).collect()}["a/b/c.py"] == "a/b/c.py"


def test_stored_model_and_postings(spark):
    n = spark.createDataFrame([("a", "read café file", ""), ("b", "write file", ""), ("c", "walk dog", ""), ("d", "feed dog", "")], "id string, name string, docstring string")
    n = schema.conform(n, schema.NODES)
    made, model = vectors.embed_all(n, spark.createDataFrame([], schema.EDGES), 3)
    back = vectors.load_model(model.rows(spark))
    assert np.allclose(back.components, model.components) and np.allclose(back.mean, model.mean) and vectors.load_model(spark.createDataFrame([], schema.MODEL)) is None
    assert np.allclose(vectors.embed_query(spark, "dog", back, 3), vectors.embed_query(spark, "dog", model, 3))
    stored = text.indexed(n)
    changed = n.withColumn("name", F.when(F.col("id") == "a", "read book").otherwise(F.col("name")))
    rows = lambda df: sorted((r["node_id"], r["term"], r["tf"]) for r in df.collect())
    assert rows(text.current_postings(stored, changed)) == rows(text.postings(changed))
    assert [r["node_id"] for r in text.bm25(text.postings(n), "Cafe").collect()] == ["a"] and [r["node_id"] for r in text.bm25(text.postings(n), "café").collect()] == ["a"]


def test_patterns_are_checked_by_java(spark):
    with pytest.warns(UserWarning):
        kept = text.Redaction(custom=[r"(?P<x>a)", r"\p{Lu}{3}-\d+"]).steps()
    assert [p for p, label in kept if label == "[REDACTED_CUSTOM]"] == [r"\p{Lu}{3}-\d+"]


def test_traced_code_is_searched_by_all_cores_and_only_where_a_pattern_may_match(spark, sf_dir, monkeypatch):
    held = []
    monkeypatch.setattr(database, "trace_queries", lambda nodes, edges: held.append(nodes) or edges.withColumn("context", F.lit("")))
    registry.QUERIES["traced_queries"](spark, sf_dir)
    assert held[0].filter("node_type = 'function'").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # one task for all before
    code = [("a", "SELECT x\nFROM A1", "go"), ("b", "Insert Into B1", ""), ("c", "uPDATE C1 SET x", ""), ("d", "DELETE from D1", ""), ("e", "db.session.query(E1)", "python"), ("f", "select(F1)", "python"), ("g", "G1.query.filter", "python"), ("h", "session.add(H1)", "python"), ("i", "insert(I1)", "python"), ("j", "J1.objects.get", "python"), ("k", "K1.objects.create", "python"), ("l", "getRepository(L1).save", "typescript"), ("m", "createQueryBuilder('M1')", "javascript"), ("n", "db.First(&N1)", "go"), ("o", "db.Save(&O1)", "go"), ("p", "db.Unscoped().Delete(&P1)", "go"), ("q", "Q1::table.load", "rust"), ("r", "diesel::delete(R1::table)", "rust"), ("s", "session.query(S1)", "go"), ("t", None, "python")]
    found = {(r["id"], r["name"]) for r in database.table_refs(spark.createDataFrame(code, "id string, raw_code string, language string")).collect()}
    assert found == {(i, i.upper() + "1") for i in "abcdefghijklmnopqr"}
