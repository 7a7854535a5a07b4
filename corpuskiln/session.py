"""Session helpers: table loading, shared checkpoints, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size of a side that may be broadcast; beyond it the join shuffles.
BROADCAST_LIMIT_BYTES = 64 << 20


def local_session(cpus: int | str = "*", partitions: int = 8, name: str = "corpuskiln", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CORPUSKILN_DRIVER_MEMORY", "12g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test-data table."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, least: int = 1 << 18) -> DataFrame:
    """A table in fewer partitions than there are cores, dealt out to all of them; small ones and those of enough partitions stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < least or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder of this machine; a cluster
    without it raises, because a machine-local folder would be lost with its executor.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("corpuskiln.shared.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="corpuskiln-")
        spark.conf.set("corpuskiln.shared.dir", conf)
    return conf


def by_volume(df: DataFrame, rows: int, *keys: str, each: int = 1_000_000) -> DataFrame:
    """``df`` of so many rows, dealt out by its keys to partitions of at most ``each`` rows on average where the session's own number of
    shuffle partitions would make larger ones; else as it is, so that the planner chooses. For keys without hot values."""
    n = -(-rows // each)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


#: Tables written inside open scopes, the innermost last.
_scopes: list[list[str]] = []


#: Spark's setting that deletes the shuffle files of a query when it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, label: str = "t", clean: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors. With ``clean`` the shuffle
    files of the writing go at once, for large shuffles that follow each other."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    try:
        spark.conf.set(CLEANUP, "true" if clean else before)
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder of this path, on any file system Spark reads?"""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file of any file system Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete the table of a settled DataFrame that nothing reads any more; others are left alone."""
    path = getattr(df, "_settled_path", None)
    if path:
        remove(df.sparkSession, path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are deleted at the end, when the result has been written or collected."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast hint when a count proves the side small; otherwise the join shuffles both sides.

    ``df`` should be settled first, as it is counted here.
    """
    return F.broadcast(df) if df.limit(limit // row_bytes + 1).count() * row_bytes <= limit else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="corpuskiln-ship-"), "corpuskiln.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith((".py", ".json")):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("corpuskiln", os.path.relpath(full, root)))
    sc.addPyFile(out)
    _shipped.add(sc.applicationId)
