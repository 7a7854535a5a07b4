"""Readers and writers of chunk files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CHUNK, conform
from ..session import broadcast_if_small, exists, settle


def read_jsonl(spark: SparkSession, paths: str | list[str], schema=CHUNK, mode: str = "FAILFAST", recursive: bool = False) -> DataFrame:
    """JSON lines with the fixed schema: unknown keys are dropped, blank lines skipped, a bad line is an error (mode PERMISSIVE drops it)."""
    r = spark.read.schema(schema).option("mode", mode)
    if recursive:
        r = r.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    return r.json(paths)


def read_sound(spark: SparkSession, paths: str | list[str], schema=CHUNK, warn=lambda p: None) -> DataFrame:
    """JSON lines of all files below the paths but those with a bad line, which are left out whole and named to ``warn``."""
    full = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    r = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    df = settle(r.json(paths).withColumn("__file", F.col("_metadata.file_path")), "jsonl")
    bad = settle(df.where("__bad is not null").select("__file").distinct(), "bad-files")
    for row in bad.toLocalIterator():
        warn(row[0])
    return df.join(broadcast_if_small(bad, 300), "__file", "left_anti").select(*schema.fieldNames())


def read_parquet(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Parquet chunks; older files without some columns are migrated, extra that is no JSON becomes {}."""
    df = spark.read.option("mergeSchema", "true").parquet(*([paths] if isinstance(paths, str) else paths))
    return conform(df).withColumn("extra", valid_json(F.col("extra")))


def valid_json(extra):
    """The JSON text, or {} where it is null or broken."""
    return F.when(F.try_parse_json(extra).isNotNull(), extra).otherwise(F.lit("{}"))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: parquet, else JSON lines."""
    return read_parquet(spark, path) if path.rstrip("/").endswith(".parquet") else read_jsonl(spark, path)


def combine(spark: SparkSession, paths: list[str], warn=lambda p: None) -> DataFrame:
    """All files that exist, one after the other; missing ones are reported to ``warn``."""
    out = None
    for p in paths:
        if not exists(spark, p):
            warn(p)
            continue
        df = conform(read_any(spark, p))
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], CHUNK)


def chunk_paths(spark: SparkSession, roots: list[str], skip: tuple[str, ...] = ("train.jsonl", "val.jsonl")) -> list[str]:
    """JSONL files under the roots of any file system, nested or flat, each once, in order; of written tables the folder."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    found: dict[str, None] = {}
    for root in roots:
        top = hadoop.Path(root)
        fs = top.getFileSystem(conf)
        if not fs.exists(top):
            continue
        names, files = [], fs.listFiles(top, True)
        while files.hasNext():
            p = files.next().getPath()
            inside = p.getParent().getName().endswith(".jsonl")
            name = p.getParent() if inside and not p.getName().startswith(("_", ".")) else p
            if name.getName().endswith(".jsonl") and name.getName() not in skip:
                names.append(name.toString())
        found |= dict.fromkeys(sorted(names))
    return list(found)


def rows_per_file(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, n`` of lines that are not blank; the total has a null path."""
    t = spark.read.text(paths).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("path"))
    return t.rollup("path").agg(F.count("*").alias("n"))


def peek(df: DataFrame) -> DataFrame:
    """One row that looks like a chunk."""
    return df.where(F.col("text").isNotNull() | F.col("chunk_id").isNotNull()).limit(1)


def write_jsonl(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.option("ignoreNullFields", "false").json(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_kinds(chunks: DataFrame, path: str) -> None:
    """One folder for each source (its relative id without the ending) and kind; a kind without rows has none."""
    from ..operators.dataset import kinds

    kinds(chunks).withColumn("stem", F.regexp_replace("source_id", r"\.[^./]*$", "")).write.partitionBy("stem", "kind").json(path)


def stem(path):
    """File name without folders and ending."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def relative_id(path, root: str):
    """Path below the root; a file outside keeps its name alone."""
    r = root.rstrip("/") + "/"
    bare = F.regexp_replace(path, "^file:(//)?(?=/)", "")
    return F.when(F.startswith(bare, F.lit(r)), F.substring(bare, len(r) + 1, 1 << 20)).otherwise(F.substring_index(bare, "/", -1))


def check_namespace(namespace: str) -> str:
    """A valid name, and not the books' own: raised before anything is written."""
    import re

    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,62}", namespace):
        raise ValueError(f"bad namespace {namespace!r}")
    if namespace == "public":
        raise ValueError("web pages do not go into the namespace of the books")
    return namespace
