"""Documentation of packages from registries, fetched by tasks through a pluggable client."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.schema import PACKAGE_DOCS

#: Where each registry serves a package's description, in order of preference.
REGISTRIES = {"pypi": "https://pypi.org/pypi/{}/json", "npm": "https://registry.npmjs.org/{}/latest", "crates": "https://crates.io/api/v1/crates/{}", "go": "https://proxy.golang.org/{}/@latest"}
LANGUAGES = {"python": "pypi", "javascript": "npm", "typescript": "npm", "rust": "crates", "go": "go"}

Fetch = Callable[[str], dict | None]


def http_fetch(url: str, timeout: float = 10.0) -> dict | None:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return json.load(r)
    except (OSError, ValueError):
        return None


def read_doc(registry: str, name: str, data: dict) -> dict:
    """The registry's answer as a row of PACKAGE_DOCS, but for the time."""
    if registry == "pypi":
        d = data.get("info") or {}
        return {"version": d.get("version"), "summary": d.get("summary"), "description": d.get("description"), "homepage_url": d.get("home_page"), "doc_url": d.get("docs_url")}
    if registry == "npm":
        return {"version": data.get("version"), "summary": data.get("description"), "description": data.get("readme"), "homepage_url": data.get("homepage"), "doc_url": None}
    if registry == "crates":
        d = data.get("crate") or {}
        return {"version": d.get("newest_version"), "summary": d.get("description"), "description": d.get("description"), "homepage_url": d.get("homepage"), "doc_url": d.get("documentation")}
    return {"version": data.get("Version"), "summary": None, "description": None, "homepage_url": f"https://{name}", "doc_url": f"https://pkg.go.dev/{name}"}


def supported(name: Column, registry: Column) -> Column:
    """Whether a registry could have a package of that name."""
    return F.when(registry == "go", name.contains("/") & name.contains(".")).when(registry == "npm", name.rlike(r"^(@[\w.-]+/)?[\w.-]+$")).otherwise(name.rlike(r"^[\w.-]+$"))


def fetch_docs(packages: DataFrame, fetch: Fetch = http_fetch) -> DataFrame:
    """PACKAGE_DOCS of (package_name, registry): the named registry's, or where it is null the
    first that has the package. Packages that no registry has give no row."""
    order = list(REGISTRIES)
    each = packages.select("package_name", F.explode(F.when(F.col("registry").isNotNull(), F.array("registry")).otherwise(F.array(*[F.lit(r) for r in order]))).alias("registry")).distinct()
    wanted = each.filter(supported(F.col("package_name"), F.col("registry")) & F.col("registry").isin(order))
    fields = [f.name for f in PACKAGE_DOCS if f.name != "fetched_at"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, registry in zip(pdf["package_name"], pdf["registry"]):
                data = fetch(REGISTRIES[registry].format(name))
                if data:
                    rows.append({"package_name": name, "registry": registry} | read_doc(registry, name, data))
            yield pd.DataFrame(rows, columns=fields)

    got = wanted.mapInPandas(run, ", ".join(f"{f} string" for f in fields))
    place = F.coalesce(*[F.when(F.col("registry") == r, F.lit(k)) for k, r in enumerate(order)])
    first = got.withColumn("n", F.row_number().over(Window.partitionBy("package_name").orderBy(place))).filter("n = 1").drop("n")
    return first.withColumn("fetched_at", F.current_timestamp())
