"""Row-local vector functions on ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_vector(columns: list[str]) -> Column:
    """Columns of one row as a vector; null if any of them is missing."""
    values = [F.col("`" + c.replace("`", "``") + "`").cast("double") for c in columns]
    missing = values[0].isNull()
    for v in values[1:]:
        missing = missing | v.isNull()
    return F.when(~missing, F.array(*values))


def doubles(vector) -> Column:
    return _col(vector).cast("array<double>")


def write_vector(vector) -> Column:
    """``[a,b,…]``"""
    parts = F.transform(_col(vector), lambda x: x.cast("string"))
    return F.when(_col(vector).isNotNull(), F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")))


def read_vector(text) -> Column:
    return F.from_json(_col(text), "array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b, zero_norm: float | None = None) -> Column:
    """Null if a side is missing; ``zero_norm`` (null by default) if a side has no length."""
    size = norm(a) * norm(b)
    value = F.when(size > 0, dot(a, b) / size).when(size == 0, F.lit(zero_norm).cast("double"))
    return F.when(_col(a).isNotNull() & _col(b).isNotNull(), value)


def unit_vector(a) -> Column:
    """Scaled to length one; a zero vector stays as it is."""
    # the length goes in as an array, as a lambda would compute it again for every element
    sizes = F.array_repeat(norm(a), F.size(_col(a)))
    return F.zip_with(_col(a), sizes, lambda x, s: F.when(s > 0, x / s).otherwise(x))


def mean_of(vectors, dim: int) -> Column:
    """Element-wise mean of an array of vectors; null for an empty array."""
    v = _col(vectors)
    total = F.aggregate(
        v, F.array_repeat(F.lit(0.0), dim), lambda s, x: F.zip_with(s, x, lambda p, q: p + q)
    )
    return F.when(F.size(v) > 0, F.transform(total, lambda x: x / F.size(v)))
