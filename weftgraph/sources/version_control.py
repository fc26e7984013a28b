"""What git says about a tree; small facts, asked by the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


def _git(root: str, *args: str) -> str:
    """The command's output; '' where there is no repository or no git."""
    try:
        done = subprocess.run(["git", "-C", root.removeprefix("file://"), *args], capture_output=True, text=True, check=False, timeout=30)
    except (OSError, subprocess.TimeoutExpired):
        return ""
    return done.stdout if done.returncode == 0 else ""


def head(root: str) -> str:
    return _git(root, "rev-parse", "HEAD").strip()


def commits_behind(root: str, since: str) -> int:
    """Commits since the given one; 0 if it is unknown."""
    out = _git(root, "rev-list", "--count", f"{since}..HEAD").strip() if since else ""
    return int(out) if out.isdigit() else 0


def changed_files(spark: SparkSession, root: str, since: str) -> DataFrame:
    """(file_path) of files that differ from a commit, in the tree or in later commits."""
    names = set(_git(root, "diff", "--name-only", since).splitlines()) if since else set()
    names |= {line[3:] for line in _git(root, "status", "--porcelain").splitlines() if len(line) > 3}
    return spark.createDataFrame([(n,) for n in sorted(names)], "file_path string")


def recent_log(root: str, most: int = 5) -> list[str]:
    return _git(root, "log", "--oneline", f"-{most}").splitlines()
