"""The k best rows of each query by a sum over shared terms, exactly: no pair of a query and a row leaves the task that met it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Queries scored at once, and cells of a slice of rows by terms.
GROUP, CELLS = 64, 1 << 22
#: Largest 1 + ln(tf) is below this, as a text has fewer than 2^31 words.
MOST = 22.5

#: Of the rows of a batch, in order: row, term and weight of each cell that is not zero.
Cells = tuple[np.ndarray, np.ndarray, np.ndarray]


def _key(x: object) -> tuple:
    """Order of ids: null first, as in Spark."""
    return x is not None, x


class Asked:
    """Queries as lists of terms by number: ``ids``, the places where each list starts, terms and their weights. Every list has a term."""

    def __init__(self, ids: list, lists: list[list[int]], weights: list[list[float]] | None = None):
        self.ids, self.sizes = ids, np.array([len(x) for x in lists], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.terms = np.array([t for x in lists for t in x], dtype=np.int64)
        self.weights = np.ones(len(self.terms)) if weights is None else np.array([w for x in weights for w in x], dtype=np.float64)

    def __len__(self) -> int:
        return len(self.ids)


def by_words(ids: list, texts: list[list[str]]) -> tuple[Asked, list[str]]:
    """Queries of distinct words, and the words by number."""
    at: dict[str, int] = {}
    lists = [[at.setdefault(w, len(at)) for w in t] for t in texts]
    return Asked(ids, lists), list(at)


class Best:
    """The best rows of each query so far: by the number of terms if they are counted, then by the rounded score, then by the smaller id."""

    def __init__(self, asked: Asked, n_terms: int, k: int, digits: int, counted: bool, distance: bool):
        self.asked, self.n_terms, self.k, self.digits, self.counted, self.distance = asked, n_terms, k, digits, counted, distance
        # a counted term weighs more than all scores of a query together
        self.step = 2.0 ** np.ceil(np.log2(MOST * max(1, asked.sizes.max()))) if counted else 0.0
        self.slack = 2 * 10.0**-digits + self.step * float(asked.sizes.max()) ** 2 * 1e-15
        n = len(asked)
        self.low = np.full(n, 1e-300)  # a row needs this raw score
        self.last = (np.zeros(n), np.full(n, -np.inf), np.full(n, None, dtype=object))  # the k-th best row: count, score, id
        self.full = np.zeros(n, dtype=bool)
        self.held = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0)]  # query, row, count, score
        self.names: list[np.ndarray] = []
        self.seen = self.waiting = 0
        self.new: list[list[np.ndarray]] = []

    def take(self, ids: list, cells: Cells) -> None:
        """The rows of a batch: their ids and cells."""
        width = max(64, min(1024, CELLS // self.n_terms))
        row, term, weight = cells
        names = np.array(ids + [None], dtype=object)[:-1]
        cuts = np.searchsorted(row, np.arange(0, len(ids) + width, width))
        grid = np.zeros((self.n_terms, width))
        for i, lo in enumerate(range(0, len(ids), width)):
            at = slice(cuts[i], cuts[i + 1])
            own = names[lo : lo + width]
            order = sorted(range(len(own)), key=lambda j, own=own: _key(own[j]))  # among equals the first column is the smaller id
            place = np.empty(len(own), dtype=np.int64)
            place[order] = np.arange(len(own))
            col = place[row[at] - lo]
            grid[term[at], col] = weight[at] + self.step
            self._slice(grid[:, : len(own)] if len(own) < width else grid, own[order])
            grid[term[at], col] = 0
        if self.waiting > self.k * len(self.asked):
            self._settle()

    def _slice(self, grid: np.ndarray, names: np.ndarray) -> None:
        a, k, n = self.asked, self.k, len(names)
        self.names.append(names)
        raw = np.empty((GROUP, n))
        for lo in range(0, len(a), GROUP):
            hi = min(lo + GROUP, len(a))
            s = raw[: hi - lo]
            for q in range(lo, hi):
                x, z = a.starts[q], a.starts[q + 1]
                np.dot(a.weights[x:z], grid[a.terms[x:z]], out=s[q - lo])
            low = self.low[lo:hi]
            if n > 4 * k and not self.full[lo:hi].all():
                low = np.maximum(low, np.partition(s, n - k, axis=1)[:, n - k] - self.slack)
            q, c = np.nonzero(s >= low[:, None])
            if len(q):
                self._add(q + lo, c, s[q, c], grid, names)
        self.seen += n

    def _add(self, q: np.ndarray, c: np.ndarray, raw: np.ndarray, grid: np.ndarray, names: np.ndarray) -> None:
        if self.counted:  # without the rounding of the large sums
            size = self.asked.sizes[q]
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            cell = grid[self.asked.terms[np.repeat(self.asked.starts[q] - start, size) + np.arange(size.sum())], np.repeat(c, size)]
            hit = cell > 0
            count = np.add.reduceat(hit.astype(np.float64), start)
            score = np.round(np.add.reduceat(np.where(hit, cell - self.step, 0.0), start), self.digits)
        else:
            count, score = np.zeros(len(q)), -np.round(1 - raw, self.digits) if self.distance else np.round(raw, self.digits)
        b_count, b_score, b_name = (x[q] for x in self.last)
        level = (count == b_count) & (score == b_score)
        keep = ~self.full[q] | (count > b_count) | (count == b_count) & (score > b_score)
        tied = np.flatnonzero(level & self.full[q])
        if len(tied):
            keep[tied] = [_key(x) < _key(y) for x, y in zip(names[c[tied]], b_name[tied])]
        if self.distance:
            keep &= score > -1  # no bucket shared
        q, c, count, score = q[keep], c[keep], count[keep], score[keep]
        if len(q) > 2 * self.k * GROUP:
            at = self._first(q, c, count, score)
            q, c, count, score = q[at], c[at], count[at], score[at]
        if len(q):
            self.new.append([q, c + self.seen, count, score])
            self.waiting += len(q)

    def _first(self, q: np.ndarray, place: np.ndarray, count: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Where the k best of each query stand, in order; ``place`` is the order of the ids."""
        at = np.lexsort((place, -score, -count, q))
        own = q[at]
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, dtype=np.int64)
        return at[np.arange(len(own)) - np.repeat(start, np.diff(np.concatenate([start, [len(own)]]))) < self.k]

    def _settle(self) -> None:
        q, row, count, score = (np.concatenate([h, *x]) for h, x in zip(self.held, zip(*self.new) if self.new else [()] * 4))
        self.new, self.waiting = [], 0
        rows, which = np.unique(row, return_inverse=True)
        names = np.concatenate([*self.names, np.array([None], dtype=object)])[rows]
        order = sorted(range(len(rows)), key=lambda j: _key(names[j]))
        place = np.empty(len(rows), dtype=np.int64)
        place[order] = np.arange(len(rows))
        at = self._first(q, place[which], count, score)
        q, which, count, score = q[at], which[at], count[at], score[at]
        # rows are numbered anew, so that only the ids of rows held are kept
        self.names, self.seen, self.held = [names], len(names), [q, which, count, score]
        sizes = np.bincount(q, minlength=len(self.asked))
        ends = np.cumsum(sizes) - 1
        done = np.flatnonzero(sizes >= self.k)
        at = ends[done]
        self.full[done] = True
        for mine, x in zip(self.last, (count[at], score[at], names[which[at]])):
            mine[done] = x
        self.low[done] = np.maximum(1e-300, count[at] * self.step + score[at] + (1.0 if self.distance else 0.0) - self.slack)

    def rows(self) -> tuple[list, list, np.ndarray, np.ndarray]:
        """Query, id, count and score of each row held."""
        self._settle()
        q, row, count, score = self.held
        return [self.asked.ids[i] for i in q.tolist()], self.names[0][row].tolist(), count, score


def word_cells(lists: pa.Array, value_set: pa.Array, weigh: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Cells:
    """Cells of lists of words by the numbers of those in ``value_set``: ``weigh`` gets tf, term and the length of the list."""
    import pyarrow.compute as pc

    sizes = np.array(lists.value_lengths().fill_null(0), dtype=np.int64)
    at = np.array(pc.index_in(lists.flatten(), value_set=value_set).fill_null(-1), dtype=np.int64)
    known = np.flatnonzero(at >= 0)
    cell, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes)[known] * len(value_set) + at[known], return_counts=True)
    row, term = cell // len(value_set), cell % len(value_set)
    return row, term, weigh(tf.astype(np.float64), term, sizes[row])


def vector_cells(lists: pa.Array) -> Cells:
    """Cells of lists of (bucket, weight)."""
    flat = lists.flatten()
    return np.repeat(np.arange(len(lists)), np.array(lists.value_lengths().fill_null(0), dtype=np.int64)), np.array(flat.field("bucket"), dtype=np.int64), np.array(flat.field("weight"), dtype=np.float64)


def search(asked: Asked, n_terms: int, k: int, cells: Callable[[pa.Array], Cells], types: tuple[pa.DataType, pa.DataType], digits: int, counted: bool = False, distance: bool = False):
    """For ``mapInArrow`` over (id, list): ``query_id, chunk_id, matched, score`` of the task's k best rows a query; with ``distance`` the score
    is one less the distance, negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(asked, n_terms, k, digits, counted, distance)
        for b in batches:
            if b.num_rows:
                best.take(b.column(0).to_pylist(), cells(b.column(1)))
        q, c, count, score = best.rows()
        for lo in range(0, len(q), 50_000):
            at = slice(lo, lo + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(q[at], types[0]), pa.array(c[at], types[1]), pa.array(count[at].astype(np.int64)), pa.array(score[at])], names=["query_id", "chunk_id", "matched", "score"])

    return run
