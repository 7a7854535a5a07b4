"""Problem 9: the reading level of each document.

Method: graded texts give every word a distribution over the levels, of equal weight for each level;
its acquisition grade is where that distribution's mass up to a level passes half, interpolated. A
document's known words give a histogram of grades, of which a few quantiles are taken; they are
calibrated on the graded texts: each level has a mean and a spread of the quantiles, and a document
gets the level that is nearest.

The lexicon and the calibration are fitted on at most MAX_SAMPLES graded texts (the smallest ids); each
document is judged alone over all its words, in one pass without a shuffle of texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

MAX_SAMPLES = 10_000
QUANTILES = (0.25, 0.5, 0.6, 0.7, 0.8, 0.9)
BINS = 256
_EDGES = ".,;:!?()\"'[]“”‘’—–-"


def words_of(text: str) -> list[str]:
    return [x for w in text.lower().split() if (x := w.strip(_EDGES))]


class Reader:
    """Grades of words and the calibrated quantiles."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.levels = sorted({v for v, _ in rows})
        place = {v: k for k, v in enumerate(self.levels)}
        counts = [Counter() for _ in self.levels]
        docs: Counter = Counter()
        for v, t in rows:
            w = words_of(t)
            counts[place[v]].update(w)
            docs.update(set(w))
        totals = [max(1, sum(c.values())) for c in counts]
        self.bins: dict[str, int] = {}
        for w, n in docs.items():
            if n < 2:
                continue  # names
            mass = np.array([c[w] / s for c, s in zip(counts, totals)])
            up = np.cumsum(mass / mass.sum())
            k = int(np.searchsorted(up, 0.5))
            before = up[k - 1] if k else 0.0
            grade = k + (0.5 - before) / max(up[k] - before, 1e-12)
            self.bins[w] = min(BINS - 1, int(grade / max(1, len(self.levels)) * BINS))
        x = np.array([self.features(t) for _, t in rows]) if rows else np.zeros((0, len(QUANTILES)))
        y = np.array([place[v] for v, _ in rows])
        self.mean = np.array([x[y == k].mean(axis=0) for k in range(len(self.levels))])
        spread = np.array([((x[y == k] - self.mean[k]) ** 2).mean(axis=0) for k in range(len(self.levels))])
        self.spread = np.sqrt(spread.mean(axis=0)) + 0.01 if len(rows) else spread

    def features(self, text: str) -> np.ndarray:
        """Quantiles of the grades of a text's known words; without one, of no grade at all (the lowest)."""
        get, h = self.bins.get, [0] * BINS
        for w, n in Counter(words_of(text)).items():
            b = get(w)
            if b is not None:
                h[b] += n
        total = np.cumsum(h)
        if not total[-1]:
            return np.zeros(len(QUANTILES))
        return np.searchsorted(total, np.array(QUANTILES) * total[-1]) / BINS

    def level(self, text: str | None) -> int | None:
        if not text or not self.levels:
            return None
        d = (((self.features(text) - self.mean) / self.spread) ** 2).sum(axis=1)
        return int(self.levels[int(d.argmin())])


def fit(samples: DataFrame, level_col: str = "level", text_col: str = "text", order: str = "sample_id") -> Reader:
    rows = samples.where(F.col(level_col).isNotNull() & F.col(text_col).isNotNull()).orderBy(order).limit(MAX_SAMPLES).select(level_col, text_col).collect()
    return Reader([(int(r[0]), r[1]) for r in rows])


def reading_levels(df: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, level`` of each id once (of several texts, the highest level). Null and empty texts, and all without samples, have null level; other columns are ignored."""
    ship(df.sparkSession)
    reader = fit(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([reader.level(t) for t in b.column(1).to_pylist()], pa.int32())], names=["id", "level"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, level int").groupBy("id").agg(F.max("level").alias("level"))
