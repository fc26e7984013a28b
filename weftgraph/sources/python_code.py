"""Python sources to nodes and unresolved edges, by the standard library's syntax tree."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.shared import materialize

NODE_SCHEMA = "id string, name string, node_type string, file_path string, line_start int, line_end int, signature string, docstring string, complexity int, is_public boolean, decorators array<string>, content_hash string, language string, raw_code string, summary_short string, category string"
EDGE_SCHEMA = "source_id string, target_name string, edge_type string, context string, file_path string, weight double, ordinal long"
#: What is not worth a call edge at module level.
COMMON = ("print", "len", "range", "str", "int", "float", "list", "dict", "set", "tuple", "super", "isinstance", "getattr", "setattr", "hasattr")
MODULE_CODE = 8000  # characters of its text that a module node holds; other nodes hold all of theirs
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.IfExp, ast.comprehension, ast.BoolOp, ast.match_case)


def short_id(*parts: str) -> str:
    return hashlib.sha256("::".join(parts).encode("utf-8", "surrogatepass")).hexdigest()[:12]


def called(node: ast.AST) -> Iterator[str]:
    for n in ast.walk(node):
        if isinstance(n, ast.Call):
            f = n.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
            if len(name) > 1:
                yield name


def complexity(node: ast.AST) -> int:
    return min(100, 1 + sum(isinstance(n, BRANCHES) for n in ast.walk(node)))


def parse_python(path: str, source: str) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of one file; a file that doesn't parse gives its module alone."""
    nodes: list[dict] = []
    edges: list[dict] = []
    lines = source.splitlines()
    stem = path.rsplit("/", 1)[-1].removesuffix(".py")

    def add(kind: str, name: str, first: int, last: int, doc: str = "", signature: str = "", public: bool = True, marks: list[str] | None = None, cx: int = 1) -> str:
        code = "\n".join(lines[max(first - 1, 0) : last])
        key = short_id(path, kind, name)
        nodes.append({"id": key, "name": name, "node_type": kind, "file_path": path, "line_start": first, "line_end": last, "signature": signature[:256], "docstring": doc, "complexity": cx, "is_public": public, "decorators": marks or [], "content_hash": hashlib.sha256(code.encode("utf-8", "surrogatepass")).hexdigest()[:16], "language": "python", "raw_code": code[:MODULE_CODE] if kind == "module" else code, "summary_short": (doc.strip().split("\n")[0] if doc.strip() else f"{kind} {name}")[:200], "category": "codebase"})
        return key

    def link(source_id: str, target: str, kind: str, weight: float = 1.0) -> None:
        edges.append({"source_id": source_id, "target_name": target, "edge_type": kind, "context": "", "file_path": path, "weight": weight, "ordinal": len(edges)})

    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        add("module", stem, 1, max(len(lines), 1))
        return nodes, edges
    module = add("module", stem, 1, max(len(lines), 1), ast.get_docstring(tree) or "")

    def visit(body: list[ast.stmt], owner: str, prefix: str) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{prefix}.{n.name}" if prefix else n.name
                result = f" -> {ast.unparse(n.returns)}" if n.returns else ""
                sign = f"{'async ' if isinstance(n, ast.AsyncFunctionDef) else ''}def {n.name}({ast.unparse(n.args)}){result}"
                key = add("method" if prefix else "function", name, n.lineno, n.end_lineno or n.lineno, ast.get_docstring(n) or "", sign, not n.name.startswith("_"), [ast.unparse(d) for d in n.decorator_list], complexity(n))
                edges.append({"source_id": owner, "target_name": name, "edge_type": "contains", "context": "", "file_path": path, "weight": 1.0, "ordinal": len(edges)})
                for name in dict.fromkeys(called(n)):
                    link(key, name, "calls")
            elif isinstance(n, ast.ClassDef):
                key = add("class", n.name, n.lineno, n.end_lineno or n.lineno, ast.get_docstring(n) or "", f"class {n.name}({', '.join(map(ast.unparse, n.bases))})", not n.name.startswith("_"), [ast.unparse(d) for d in n.decorator_list], complexity(n))
                link(owner, n.name, "contains")
                for base in n.bases:
                    link(key, ast.unparse(base), "inherits")
                visit(n.body, key, n.name)
            elif isinstance(n, ast.Import):
                for a in n.names:
                    link(module, a.name, "imports")
            elif isinstance(n, ast.ImportFrom):
                link(module, ("." * n.level) + (n.module or ""), "imports")
                for a in n.names:
                    if n.module and a.name != "*":
                        link(module, f"{n.module}.{a.name}", "imports")
            elif not prefix:
                if isinstance(n, (ast.Assign, ast.AnnAssign)):
                    for target in n.targets if isinstance(n, ast.Assign) else [n.target]:
                        if isinstance(target, ast.Name) and target.id.isupper():
                            add("constant", target.id, n.lineno, n.end_lineno or n.lineno)
                            link(module, target.id, "contains")
                for name in dict.fromkeys(called(n)):
                    if name not in COMMON:
                        link(module, name, "calls", 0.5)

    visit(tree.body, module, "")
    return nodes, edges


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, unresolved edges) of (file_path, content), from one pass over the files that is
    stored: a row is a node or, where its target_name is not null, an edge."""
    from .other_code import parse_other

    node_schema, edge_schema = T.StructType.fromDDL(NODE_SCHEMA), T.StructType.fromDDL(EDGE_SCHEMA)
    both = T.StructType([*node_schema.fields, *(f for f in edge_schema.fields if f.name not in node_schema.names)])
    layout = to_arrow_schema(both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, source in zip(b["file_path"].to_pylist(), b["content"]):
                made = parse_python if path.endswith(".py") else parse_other
                nodes, edges = made(path, source.as_py() or "")
                yield from pa.Table.from_pylist([*nodes, *edges], schema=layout).to_batches(max_chunksize=5000)

    rows = files.select("file_path", "content").filter("file_path IS NOT NULL")
    parsed = materialize(rows.mapInArrow(run, both), "parsed")
    return parsed.filter("target_name IS NULL").select(*node_schema.names), parsed.filter("target_name IS NOT NULL").select(*edge_schema.names)
