"""Sources of other languages to nodes and unresolved edges, by patterns.

Coarser than a syntax tree: declarations at line starts, blocks by braces or `end`. Names, kinds,
lines, imports and calls come out; unusual layouts may be missed.
"""

from __future__ import annotations

import hashlib
import re

from .python_code import MODULE_CODE, short_id

C_LIKE = {"javascript", "typescript", "go", "rust", "php"}
ENDINGS = {".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".rb": "ruby", ".rake": "ruby", ".php": "php"}
DECLARED: dict[str, list[tuple[str, str]]] = {
    "javascript": [("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)(?:\s+extends\s+([\w.]+))?"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>")],
    "typescript": [("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type_alias", r"^\s*(?:export\s+)?type\s+(\w+)\s*="), ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)(?:<[^>]*>)?(?:\s+extends\s+([\w.]+))?"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::\s*[\w<>\[\]| ]+)?=>")],
    "go": [("method", r"^func\s+\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("struct", r"^type\s+(\w+)\s+struct\b"), ("interface", r"^type\s+(\w+)\s+interface\b"), ("type_alias", r"^type\s+(\w+)\s+(?!struct|interface)\S"), ("constant", r"^const\s+(\w+)")],
    "rust": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"), ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"), ("type_alias", r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)\s*="), ("constant", r"^\s*(?:pub(?:\([^)]*\))?\s+)?const\s+(\w+)")],
    "ruby": [("class", r"^\s*class\s+(\w+)(?:\s*<\s*([\w:]+))?"), ("module", r"^\s*module\s+(\w+)"), ("function", r"^\s*def\s+(?:self\.)?(\w+[?!]?)")],
    "php": [("class", r"^\s*(?:abstract\s+|final\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?"), ("interface", r"^\s*interface\s+(\w+)"), ("trait", r"^\s*trait\s+(\w+)"), ("function", r"^\s*(?:public\s+|private\s+|protected\s+|static\s+)*function\s+(\w+)")],
}
IMPORTED = {
    "javascript": r"(?:import\s[^;]*?from\s*|import\s*|require\(\s*)['\"]([^'\"]+)['\"]", "typescript": r"(?:import\s[^;]*?from\s*|import\s*|require\(\s*)['\"]([^'\"]+)['\"]",
    "go": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$", "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "ruby": r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", "php": r"^\s*use\s+([\w\\]+)",
}
BRANCH = re.compile(r"\b(?:if|elsif|else if|for|while|case|catch|match|rescue|when|unless)\b|&&|\|\||\?[^.:?]")
WORDS = {"if", "for", "while", "switch", "return", "catch", "function", "func", "fn", "match", "elsif", "unless", "def", "class", "new", "sizeof", "typeof", "await", "super"}
CALL = re.compile(r"(?<![\w.])(?:\w+(?:\.|::|->))*(\w{2,}[?!]?)\s*\(")

#: What may hold brackets that don't count in the header of a declaration: comments and short texts.
QUOTED = re.compile(r"/\*.*?\*/|//.*|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)'|'[^',<>&]*'|`[^`]*`")
GOES_ON = re.compile(r"(?:[,|&+=:]|->|=>|\bwhere)\s*$|^\s*$")


def block_end(lines: list[str], first: int, language: str) -> int:
    """The last line (from 0) of the declaration that begins at `first`."""
    if language not in C_LIKE:
        indent = len(lines[first]) - len(lines[first].lstrip())
        for k in range(first + 1, len(lines)):
            if re.match(rf"\s{{{indent}}}end\b", lines[k]):
                return k
        return first
    depth, held, last = 0, 0, first  # braces, brackets of the header, the last line that the header surely goes on after
    opened = body = False
    for k in range(first, len(lines)):
        line = lines[k] if body else QUOTED.sub("", lines[k])
        for c in line:
            if not body:
                held += (c in "([") - (c in ")]")
            depth += (c == "{") - (c == "}")
            opened |= c == "{"
            body |= c == "{" and held <= 0
        if opened and depth <= 0 and (body or held <= 0 and not "".join(lines[k + 1 : k + 2]).lstrip().startswith("{")):
            return k
        if not opened and held <= 0 and (line.rstrip().endswith(";") or k > last + 5):
            return k
        if held > 0 or GOES_ON.search(line):
            last = k
    return len(lines) - 1 if body else first


def parse_other(path: str, source: str) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of one file; unknown endings give none."""
    language = ENDINGS.get("." + path.rsplit(".", 1)[-1].lower() if "." in path else "")
    if not language:
        return [], []
    lines = source.splitlines()
    nodes: list[dict] = []
    edges: list[dict] = []

    def add(kind: str, name: str, first: int, last: int) -> str:
        code = "\n".join(lines[first : last + 1])
        above = []
        k = first - 1
        while k >= 0 and re.match(r"\s*(///?|#(?!\[|!)|\*|/\*)", lines[k]):
            above.insert(0, re.sub(r"^\s*(?:/\*+|\*+/|\*|/{2,3}|#)\s?|\s*\*/\s*$", "", lines[k]))
            k -= 1
        marks = []
        while k >= 0 and re.match(r"\s*(@\w|#\[)", lines[k]):
            marks.insert(0, lines[k].strip())
            k -= 1
        public = bool(re.match("[A-Z]", name.rsplit(".", 1)[-1])) if language == "go" else "pub" in lines[first] if language == "rust" and lines else not name.rsplit(".", 1)[-1].startswith("_")
        key = short_id(path, kind, name, str(first + 1))
        sign = lines[first].strip().rstrip("{").strip() if lines else ""
        nodes.append({"id": key, "name": name, "node_type": kind, "file_path": path, "line_start": first + 1, "line_end": last + 1, "signature": sign[:256], "docstring": "\n".join(above).strip(), "complexity": min(100, 1 + len(BRANCH.findall(code))) if kind in ("function", "method") else 1, "is_public": public, "decorators": marks, "content_hash": hashlib.sha256(code.encode("utf-8", "surrogatepass")).hexdigest()[:16], "language": language, "raw_code": code if nodes else code[:MODULE_CODE], "summary_short": f"{kind} {name}"[:200], "category": "codebase"})
        return key

    def link(source_id: str, target: str, kind: str) -> None:
        edges.append({"source_id": source_id, "target_name": target, "edge_type": kind, "context": "", "file_path": path, "weight": 1.0, "ordinal": len(edges)})

    module = add("module", path.rsplit("/", 1)[-1].rsplit(".", 1)[0], 0, max(len(lines) - 1, 0))
    open_: list[tuple[int, str, str]] = []  # (last line, id, name) of the classes around
    skip = -1
    for k, line in enumerate(lines):
        while open_ and open_[-1][0] < k:
            open_.pop()
        for kind, pattern in DECLARED[language]:
            m = re.match(pattern, line)
            if not m:
                continue
            owner = m.groupdict().get("owner")
            name = m[2] if owner else m[1]
            last = block_end(lines, k, language)
            inside = open_[-1] if open_ and k > skip else None
            if kind == "function" and inside:
                kind, name = "method", f"{inside[2]}.{name}"
            elif owner:
                name = f"{owner}.{name}"
            key = add(kind, name, k, last)
            link(inside[1] if inside else module, name, "contains")
            if kind in ("class", "interface", "trait", "struct", "module"):
                if kind == "class" and m.re.groups >= 2 and m[2]:
                    link(key, m[2], "inherits")
                open_.append((last, key, name))
            elif kind in ("function", "method"):
                body = "\n".join(lines[k : last + 1])
                for callee in dict.fromkeys(c for c in CALL.findall(body[len(line.split("(")[0]) + 1 :]) if c not in WORDS):
                    link(key, callee, "calls")
            break
        impl = re.match(r"^\s*impl(?:<[^>]*>)?\s+(?:([\w:]+)(?:<[^>]*>)?\s+for\s+)?(\w+)", line) if language == "rust" else None
        if impl:
            open_.append((block_end(lines, k, language), module, impl[2]))
            if impl[1]:
                link(short_id(path, "struct", impl[2], str(next((i + 1 for i, x in enumerate(lines) if re.search(rf"\bstruct\s+{impl[2]}\b", x)), 0))), impl[1].split("::")[-1], "implements")
        elif language in ("typescript", "php") and (m := re.search(r"\bimplements\s+([\w, \\]+)", line)) and open_:
            for base in m[1].split(","):
                link(open_[-1][1], base.strip(), "implements")
    for m in re.finditer(IMPORTED[language], source, re.MULTILINE):
        link(module, m[1], "imports")
    return nodes, edges
