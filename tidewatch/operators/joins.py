"""Joins that need more than ``DataFrame.join``: null-safe keys, row position, chains of metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordering import BLOCK_ROWS, in_order
from tidewatch.session import text_bytes

#: What is numbered in one task.
BLOCK_BYTES = 64_000_000


def left_join(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Left join on keys with different names; the left names stay."""
    renamed = right.withColumnsRenamed({r: l for l, r in keys.items()})
    return left.join(renamed, list(keys), "left")


def full_join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full join in which a missing key meets a missing key."""
    l, r = left.alias("l"), right.alias("r")
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    return l.join(r, on, "full").select(
        *[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys],
        *[F.col(f"l.{c}") for c in left.columns if c not in keys],
        *[F.col(f"r.{c}") for c in right.columns if c not in keys],
    )


def join_metrics(first: DataFrame, *others: DataFrame, on: list[str]) -> DataFrame:
    """Metric tables side by side, for the keys of the first one."""
    return reduce(lambda a, b: a.join(b, on, "left"), others, first)


def rows_in_block(df: DataFrame, rows: int, block_bytes: int = BLOCK_BYTES) -> int:
    """How many of the table's rows one task may number, by what its texts and other columns take on average."""
    texts = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    size = 8 * len(df.columns) + (text_bytes(df, texts) / max(rows, 1) if texts else 0)
    return max(1, min(BLOCK_ROWS, int(block_bytes / size)))


def bind_columns(
    left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Row n beside row n, in the given orders. A differing number of rows is an error.

    Rows with long texts are numbered in shorter blocks, so that no task reads more than about ``block_bytes``.
    """
    n_left, n_right = left.count(), right.count()
    if n_left != n_right:
        raise ValueError(f"{n_left} rows cannot be bound to {n_right}")
    blocks = [rows_in_block(side, n_left, block_bytes) for side in (left, right)]
    a = in_order(left, [], left_order, ordinal="_row", block_rows=blocks[0], longest=n_left).rows
    b = in_order(right, [], right_order, ordinal="_row", block_rows=blocks[1], longest=n_right).rows
    return a.join(b, "_row").drop("_row")


def align_by_ordinal(
    left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str],
    ordinal: str = "time",
) -> DataFrame:
    """Two series joined by their position, the left one kept whole."""
    a = in_order(left, [], left_order, ordinal=ordinal).rows
    b = in_order(right, [], right_order, ordinal=ordinal).rows
    return a.join(b, ordinal, "left")
