"""Source trees as tables: discovery, languages, file states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import EXTENSIONS, MARKERS, basename, fingerprint, language_of

#: What is never indexed, and what is not of one language.
EXCLUDES = ("**/__pycache__/**", "**/*.egg-info/**", "**/.venv/**", "**/venv/**", "**/node_modules/**", "**/.git/**")
OWN_EXCLUDES = {
    "javascript": ("**/dist/**", "**/build/**", "**/.next/**", "**/coverage/**"), "typescript": ("**/dist/**", "**/build/**", "**/.next/**", "**/coverage/**"),
    "rust": ("**/target/**", "**/.cargo/**"), "go": ("**/vendor/**", "**/pkg/**"), "ruby": ("**/vendor/bundle/**",), "php": ("**/vendor/**",),
}


def expand_braces(pattern: str) -> list[str]:
    """`a.{x,y}` as a.x and a.y; one level."""
    if "{" not in pattern or "}" not in pattern:
        return [pattern]
    head, _, rest = pattern.partition("{")
    body, _, tail = rest.partition("}")
    return [f"{head}{part}{tail}" for part in body.split(",")]


def glob_regex(pattern: str) -> str:
    """A Java pattern for a glob: ** crosses folders and may be empty, * and ? don't cross."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() and c not in "_/" else c
            i += 1
    return f"^{out}$"


def matches_any(path: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    every = [glob_regex(p) for pattern in patterns for p in expand_braces(pattern)]
    return path.rlike("|".join(every)) if every else F.lit(False)


def includes(languages: list[str]) -> list[str]:
    """Patterns of the languages' files; Python's where there are none."""
    return [f"**/*{e}" for name in languages for e in EXTENSIONS[name]] or ["**/*.py"]


LISTED = "path string, file_path string, size long, modified timestamp"


def _opened(path: str):
    """(file system, path there) of a path as Hadoop writes it: nothing is escaped, and local ones
    have one slash."""
    from urllib.parse import quote

    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(quote("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path, safe=":/@"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """LISTED rows of all files under root. The driver lists the folders of the root only; each of
    them is walked by the task that has its row. Spark's own file sources would pass over names
    that begin with an underscore, such as __init__.py."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toString().rstrip("/") + "/"
    folders = [s.getPath().getName() for s in fs.listStatus(top) if s.isDirectory()]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        for pdf in batches:
            for folder, deep in zip(pdf["folder"], pdf["deep"]):
                source, at = _opened(base)
                at = at.rstrip("/")
                open_ = [f"{at}/{folder}" if folder else at]
                while open_:
                    rows = []
                    for f in source.get_file_info(pafs.FileSelector(open_.pop())):
                        if f.type == pafs.FileType.Directory:
                            open_ += [f.path] if deep else []
                        elif f.type == pafs.FileType.File:
                            name = f.path[len(at) + 1 :]
                            rows.append((base + name, name, f.size, f.mtime))
                    yield pd.DataFrame(rows, columns=["path", "file_path", "size", "modified"])

    tops = spark.createDataFrame([("", False), *((f, True) for f in folders)], "folder string, deep boolean")
    return tops.repartition(min(len(folders) + 1, 10_000)).mapInPandas(walk, LISTED)


def read_contents(listed: DataFrame) -> DataFrame:
    """(file_path, content, modified, size) of listed files; each is read by the task that has
    its row. Bytes that are not UTF-8 are replaced; a file that is gone has no content."""
    def read(path: str) -> str | None:
        try:
            fs, at = _opened(path)
            with fs.open_input_stream(at, compression=None) as f:
                return f.read().decode("utf-8", "replace")
        except OSError:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for k in range(0, len(whole), 200):
                pdf = whole.iloc[k : k + 200]
                yield pd.DataFrame({"file_path": pdf["file_path"], "content": pdf["path"].map(read), "modified": pdf["modified"], "size": pdf["size"]})

    return listed.mapInPandas(run, "file_path string, content string, modified timestamp, size long")


def discover(spark: SparkSession, root: str, include: list[str] | None = None, exclude: tuple[str, ...] = EXCLUDES) -> DataFrame:
    """(file_path relative to root, content, modified, size, language) of the files under root
    that match include and neither exclude nor what their language leaves out."""
    listed = list_files(spark, root)
    at, language = F.col("file_path"), language_of(F.col("file_path"))
    own = F.coalesce(*[F.when(language == name, matches_any(at, some)) for name, some in OWN_EXCLUDES.items()], F.lit(False))
    wanted = matches_any(at, include or includes(list(EXTENSIONS))) & ~matches_any(at, exclude) & ~own
    return read_contents(listed.filter(wanted)).withColumn("language", language)


def detect_languages(files: DataFrame) -> DataFrame:
    """(language, markers, files) of a tree: languages whose project files or sources are there."""
    name = basename(F.col("file_path"))
    marked = F.coalesce(*[F.when(name.isin(*names), F.lit(lang)) for lang, names in MARKERS.items()])
    both = files.select(F.explode(F.array(F.struct(marked.alias("language"), F.lit(1).alias("m"), F.lit(0).alias("f")), F.struct(language_of(F.col("file_path")).alias("language"), F.lit(0).alias("m"), F.lit(1).alias("f")))).alias("x"))
    return both.filter("x.language IS NOT NULL").groupBy(F.col("x.language").alias("language")).agg(F.sum("x.m").alias("markers"), F.sum("x.f").alias("files"))


def states(files: DataFrame) -> DataFrame:
    """(file_path, content_hash) as the store keeps them."""
    return files.select("file_path", fingerprint(F.col("content")).alias("content_hash"))
