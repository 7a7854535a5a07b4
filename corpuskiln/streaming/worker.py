"""Workers: repeated runs of a step over what is new, as Structured Streaming with foreachBatch."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embed, store
from ..schema import CHUNK

log = logging.getLogger(__name__)


def guarded(step: Callable[[DataFrame, int], None], failures: list | None = None) -> Callable[[DataFrame, int], None]:
    """A batch that fails is logged and the stream goes on."""

    def run(df: DataFrame, batch: int) -> None:
        try:
            step(df, batch)
        except Exception as e:  # noqa: BLE001
            log.exception("batch %s failed", batch)
            if failures is not None:
                failures.append((batch, repr(e)))

    return run


def watch_chunks(spark: SparkSession, folder: str, step: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None, failures: list | None = None):
    """Runs ``step`` on every new JSONL file of chunks; without an interval, over what is there now and then ends."""
    s = spark.readStream.schema(CHUNK).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(folder)
    w = s.writeStream.option("checkpointLocation", checkpoint).foreachBatch(guarded(step, failures))
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def embed_missing(chunks: DataFrame, vectors: DataFrame, model: str = "hashing", dim: int = 1024, encode: Callable[[list[str]], list] | None = None) -> DataFrame:
    """Vectors of the children that have none: ``chunk_id, embedding, model, created_at``."""
    v = embed.Embedder(model, dim, encode).transform(store.missing_vectors(chunks, vectors))
    return v.select("chunk_id", "embedding", F.lit(model).alias("model"), F.current_timestamp().alias("created_at"))


def snapshot_due(chunks: DataFrame, vectors: DataFrame, last: str | None) -> tuple[bool, str | None]:
    """Whether the tables moved since the watermark ``last`` (its text and the row count), and the watermark now."""
    r = store.watermark(chunks, vectors).collect()[0]
    now = None if r["watermark"] is None else f"{r['watermark'].isoformat()}/{r['n_rows']}"
    return now is not None and now != last, now


def snapshot_name(at) -> str:
    return at.strftime("%Y%m%d-%H%M%S")


def every(seconds: float, step: Callable[[int], None], rounds: int | None = None, failures: list | None = None, stop: threading.Event | None = None) -> int:
    """Run ``step`` (a crawl, a snapshot) again and again, ``seconds`` apart; a round that fails is logged and the next one comes. Ends after
    ``rounds`` or when ``stop`` is set; the number of rounds run."""
    n, end = 0, stop or threading.Event()
    while not end.is_set() and (rounds is None or n < rounds):
        try:
            step(n)
        except Exception as e:  # noqa: BLE001
            log.exception("round %s failed", n)
            if failures is not None:
                failures.append((n, repr(e)))
        n += 1
        if rounds is None or n < rounds:
            end.wait(seconds)
    return n
