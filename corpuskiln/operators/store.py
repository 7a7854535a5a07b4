"""Mutations and reports of the chunk and vector tables. Every write goes to a new version; a path being read is never overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CHUNK, VECTOR
from ..session import BROADCAST_LIMIT_BYTES, remove, settle


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: a partial aggregation over the whole row."""
    rest = [c for c in rows.columns if c not in order]
    m = rows.groupBy(key).agg(F.max(F.struct(*order, *[c for c in rest if c != key])).alias("__r"))
    return m.select(*[F.col(key) if c == key else F.col(f"__r.{c}").alias(c) for c in rows.columns])


def last_of_stored(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The same over a stored table, in which few keys are repeated: the keys are counted alone first, and only rows of repeated ones are
    shuffled whole. Where the repeated keys do not fit a broadcast, all rows are."""
    repeated = settle(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "repeated")
    if repeated.count() * 64 > BROADCAST_LIMIT_BYTES:
        return last_wins(rows, key, order)
    several = F.broadcast(repeated)
    # the anti join keeps every row without a key; of those, too, the last one counts
    once = rows.where(F.col(key).isNotNull()).join(several, key, "left_anti")
    more = rows.join(several, key, "left_semi").union(rows.where(F.col(key).isNull()))
    return once.select(*rows.columns).union(last_wins(more.select(*rows.columns), key, order))


def upsert(target: DataFrame, source: DataFrame, key: str = "chunk_id", keep: tuple[str, ...] = ("created_at",), order: list[str] | None = None) -> DataFrame:
    """Rows of ``source`` replace those of ``target`` by key; ``keep`` columns stay as they are in the target; a null chunk_index becomes 0."""
    s = last_wins(source, key, order) if order else source
    t = target.withColumn("__t", F.lit(True))
    s = s.select(key, F.lit(True).alias("__s"), *[F.col(c).alias(f"__new_{c}") for c in target.columns if c != key])
    j = t.join(s, key, "full_outer")

    def pick(c: str):
        if c == key:
            return F.col(c)
        new = F.col(f"__new_{c}")
        x = F.when(F.col("__t").isNotNull() & F.lit(c in keep), F.col(c)).when(F.col("__s").isNotNull(), new).otherwise(F.col(c))
        return (F.coalesce(x, F.lit(0)) if c == "chunk_index" else x).alias(c)

    return j.select(*[pick(c) for c in target.columns])


def upsert_vectors(target: DataFrame, source: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Vectors are replaced whole: model and created_at come from the source."""
    return upsert(target, source, key, keep=())


def delete_sources(chunks: DataFrame, vectors: DataFrame, source_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the chunks of these sources; vectors go with their chunk."""
    gone = chunks.join(source_ids.select("source_id").distinct(), "source_id", "left_semi").select("chunk_id")
    return chunks.join(source_ids.select("source_id").distinct(), "source_id", "left_anti").select(*chunks.columns), vectors.join(gone, "chunk_id", "left_anti")


def reingest(chunks: DataFrame, vectors: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete what the fresh chunks' sources had, then add them."""
    c, v = delete_sources(chunks, vectors, fresh.select("source_id"))
    return c.unionByName(fresh, allowMissingColumns=True), v


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.where(~F.coalesce("is_parent", F.lit(False))).join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def append_new(stored: DataFrame, incoming: DataFrame, key: str = "chunk_id", order: list[str] | None = None) -> DataFrame:
    """Rows of ``incoming`` whose key is not stored, one per key."""
    return last_wins(incoming, key, order or [c for c in incoming.columns if c != key][:1]).join(stored.select(key), key, "left_anti")


def counts(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: ``n_chunks, n_children, n_vectors, n_missing``."""
    c = chunks.where(~F.coalesce("is_parent", F.lit(False))).join(vectors.select("chunk_id", F.lit(1).alias("v")), "chunk_id", "left").agg(F.count("*").alias("n_children"), F.count_if(F.col("v").isNull()).alias("n_missing"))
    return chunks.agg(F.count("*").alias("n_chunks")).crossJoin(F.broadcast(c)).crossJoin(F.broadcast(vectors.agg(F.count("*").alias("n_vectors"))))


def source_report(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``source_type, source_id, n_chunks, n_parents, n_embedded`` in order of the source."""
    v = vectors.select("chunk_id", F.lit(1).alias("v"))
    return chunks.join(v, "chunk_id", "left").groupBy("source_type", "source_id").agg(F.count("*").alias("n_chunks"), F.count_if("is_parent").alias("n_parents"), F.count("v").alias("n_embedded"))


def index_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_index").agg(F.count("*").alias("n"))


def watermark(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: ``watermark, n_rows``; the row counts show what edits and deletions leave unmoved."""
    a = chunks.agg(F.max("created_at").alias("c"), F.count("*").alias("n"))
    b = vectors.agg(F.max("created_at").alias("v"), F.count("*").alias("m"))
    return a.crossJoin(F.broadcast(b)).select(F.greatest("c", "v").alias("watermark"), (F.col("n") + F.col("m")).alias("n_rows"))


def nearest_rank(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Percentiles by the rule value[min(n - 1, int(p * n))] of the sorted values; counted by value, so no group is gathered."""
    h = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*by)
    h = h.withColumn("upto", F.sum("k").over(w.orderBy(value))).withColumn("n", F.sum("k").over(w))
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n")))
    return h.groupBy(*by).agg(*[F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(name) for name, p in points.items()], F.max("n").alias("n"))


def keep_last(names: list[str], n: int = 7) -> list[str]:
    """Snapshots to remove: all but the last n by name."""
    return sorted(names)[:-n] if n else sorted(names)


def by_ids(rows: DataFrame, ids: list[str], key: str = "chunk_id") -> DataFrame:
    """Point lookup: the rows of these ids; the list is pushed down to the scan."""
    return rows.where(F.col(key).isin(list(dict.fromkeys(ids)))) if ids else rows.limit(0)


def create_tables(spark: SparkSession, database: str, location: str | None = None) -> None:
    """The chunk and vector tables, if they are not there; running it again changes nothing."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`" + (f" LOCATION '{location}'" if location else ""))
    for name, schema in (("chunks", CHUNK), ("vectors", VECTOR)):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet")


def counted(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The rows with their statistics taken while they are written: number, empty texts, parents, last creation. Read ``observation.get`` after the write."""
    o = Observation(name)
    return rows.observe(o, F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("n_empty"), F.count_if(F.coalesce("is_parent", F.lit(False))).alias("n_parents"), F.max("created_at").alias("last_created")), o


def snapshot(tables: dict[str, DataFrame], root: str, name: str, keep: int = 7) -> list[str]:
    """Write every table below ``root/name`` and remove all snapshots but the last ``keep``. A snapshot counts once its marker stands, which is
    written last, so an aborted one is never the newest. The names left."""
    spark = next(iter(tables.values())).sparkSession
    base = root.rstrip("/")
    for table, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/{name}/{table}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(base)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.create(hadoop.Path(f"{base}/{name}/_COMPLETE"), True).close()
    done = [s.getPath().getName() for s in fs.listStatus(top) if s.isDirectory() and fs.exists(hadoop.Path(s.getPath(), "_COMPLETE"))]
    gone = keep_last(done, keep)
    for n in gone:
        remove(spark, f"{base}/{n}")
    return sorted(set(done) - set(gone))
