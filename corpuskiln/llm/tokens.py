"""Sizes of texts in tokens of a public tokenizer; its files stay where they are, their path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: One counter per file and worker process.
_loaded: dict[str, Counter] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Counter:
    """Counts tokens of a byte-level BPE; a text's special strings are ordinary text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> int:
        return len(self.coder.encode_ordinary(text))


def counter(path: str) -> Counter:
    """One per worker process."""
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def token_counts(df: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` (long) of each row; a null text has 0 tokens. Whole texts are counted."""
    ship(df.sparkSession)
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpuskiln.llm.tokens import counter

        count = counter(path)
        for b in batches:
            n = [count(t) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, f"{kinds}, n_tokens bigint")
