"""New and changed files against a manifest of what was done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["path", "mtime", "size"]


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (path, mtime in whole seconds, size) the manifest does not hold."""
    return files.withColumn("mtime", F.floor("mtime").cast("bigint")).join(manifest.select(*KEY), KEY, "left_anti")


def mark(manifest: DataFrame, done: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The manifest after a run: successes are marked, failures are tried again."""
    ok = done if failed is None else done.join(failed.select("path"), "path", "left_anti")
    return manifest.join(ok.select("path"), "path", "left_anti").select(*KEY).union(ok.select(*KEY))
