"""Vector expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def bucket(word: Column, dim: int = 1024) -> Column:
    """md5 of a word modulo ``dim``: the last digits for a power of two, else folded over the four 8-digit words of the hash."""
    if dim & (dim - 1) == 0 and dim <= 1 << 32:
        return F.conv(F.substring(F.md5(word), 25, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(dim - 1)).cast("int")
    h, rest = F.md5(word), F.lit(0).cast("bigint")
    for k in range(4):
        part = F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("bigint")
        rest = (rest * ((1 << 32) % dim) + part) % dim
    return rest.cast("int")
