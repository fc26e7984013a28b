"""Column functions: names, paths, tokens, comments and digests. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File endings by language.
EXTENSIONS = {
    "python": (".py",), "javascript": (".js", ".jsx", ".mjs", ".cjs"), "typescript": (".ts", ".tsx"), "rust": (".rs",),
    "go": (".go",), "sql": (".sql",), "ruby": (".rb", ".rake"), "php": (".php",),
}

#: Files that mark a project of a language.
MARKERS = {
    "python": ("pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "Pipfile", "poetry.lock"),
    "javascript": ("package.json",), "typescript": ("tsconfig.json", "tsconfig.base.json"), "rust": ("Cargo.toml",),
    "go": ("go.mod",), "ruby": ("Gemfile", "Gemfile.lock"), "php": ("composer.json", "composer.lock"),
}


def digest(*parts: Column | str, length: int = 12) -> Column:
    """The first hexadecimal digits of the SHA-256 of parts joined by '::'."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.substring(F.sha2(F.concat_ws("::", *cols), 256), 1, length)


def fingerprint(content: Column) -> Column:
    """Digest of a file's bytes."""
    return F.substring(F.sha2(content, 256), 1, 16)


def dirname(path: Column) -> Column:
    """The folder of a path; '.' for a bare name, as POSIX has it."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language_of(path: Column) -> Column:
    """The language of a path by its ending, or null."""
    ending = extension(path)
    return F.coalesce(*[F.when(ending.isin(*ends), F.lit(name)) for name, ends in EXTENSIONS.items()])


def tokens(text: Column) -> Column:
    """Lower-case tokens of two characters or more; camelCase is split at its humps."""
    humps = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(humps), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def run_starts(values: Column) -> Column:
    """The places of a sorted array at which its runs of equal values begin, and its length."""
    return F.filter(F.sequence(F.lit(0), F.size(values)), lambda i: (i == 0) | (i == F.size(values)) | (F.get(values, i) != F.get(values, i - 1)))


def runs(values: Column, starts: Column) -> Column:
    """(term, n) for each run of equal values of a sorted array, of its run_starts."""
    pairs = F.zip_with(starts, F.slice(starts, 2, 1 << 30), lambda a, b: F.struct(F.get(values, a).alias("term"), (b - a).cast("long").alias("n")))
    return F.filter(pairs, lambda x: x["n"].isNotNull())


def compose_text(*parts: Column) -> Column:
    """The parts that are not empty, joined by blanks."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def snake_case(name: Column) -> Column:
    s = F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(s, r"([a-z\d])([A-Z])", "$1_$2"))


def snake_plural(name: Column) -> Column:
    s = snake_case(name)
    return F.when(s.endswith("s"), s).otherwise(F.concat(s, F.lit("s")))


def is_public(name: Column, language: Column) -> Column:
    """By the naming customs of the language: capitals in Go and Rust, no underscore elsewhere."""
    return F.when(language.isin("go", "rust"), name.rlike("^[A-Z]")).otherwise(~name.rlike("^_"))


def is_constant_name(name: Column) -> Column:
    """ALL_CAPS, or Pascal case without an underscore."""
    return name.rlike("^[A-Z][A-Z0-9_]*$") | name.rlike("^[A-Z][A-Za-z0-9]*$")


def clean_comment(raw: Column) -> Column:
    """A documentation comment without its markers: block marks, then line marks, in order."""
    steps = [(r"^\s*/\*+\s*", ""), (r"\s*\*+/\s*\z", ""), (r"(?m)^\s*\*\s?", ""), (r"(?m)^\s*/{1,3}\s?", ""), (r"(?m)^\s*#\s?", ""), (r"(?m)^\s*--\s?", "")]
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, raw))


def strip_quotes(name: Column) -> Column:
    return F.regexp_replace(name, "^[`\"\\[\\]']+|[`\"\\[\\]']+$", "")


def ellipsis(text: Column, length: int) -> Column:
    """The text, or its beginning and '...' if it is longer than length."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 3), F.lit("..."))).otherwise(text)


def vector_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    scale = vector_norm(a) * vector_norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(vector_dot(a, b) / scale)


def unit(a: Column) -> Column:
    """a at length one; a zero vector stays."""
    norm = vector_norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))
