"""Ranks of all rows of a table by a distributed radix sort, least significant digit first.

Rows have places 0, 1, … and lie in blocks of consecutive places. A pass takes one digit of the composite
key: it counts the digits of each block, turns the counts into offsets (of the digit over the whole table,
then of the block within the digit) and moves every row to its offset plus its place among the rows of its
block and digit. Such a pass keeps the order of the passes before, so after the most significant digit the
places are ranks. No step needs more than one block's rows of one digit in one task, whatever the keys are;
only the totals of the digits, at most 2**``BITS`` numbers, reach the driver. Every pass is stored, so a lost
executor repeats one pass.

Keys are long columns without nulls. Rows of equal keys get different ranks in an order fixed by where they
were stored. An empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import stored

BITS = 12
#: Rows of a block: a thousandth of the table within these powers of two.
LEAST_BLOCK, LARGEST_BLOCK = 8, 20
LOWEST = -(1 << 63)


def digits_of(column: str, low: int, high: int, ascending: bool, bits: int) -> list[Column]:
    """The digits of a key column in which its values differ, the least significant first."""
    if high - low < 1 << 63:
        value, spread = (F.col(column) - F.lit(low) if ascending else F.lit(high) - F.col(column)), high - low
    else:  # the difference has no long; with the sign turned, the bits order the values as they are
        value, spread = F.col(column).bitwiseXOR(F.lit(LOWEST)), (low ^ high) % (1 << 64)
        value = value if ascending else F.bitwise_not(value)
    mask = F.lit((1 << bits) - 1).cast("long")
    return [F.shiftrightunsigned(value, shift).bitwiseAND(mask).cast("int") for shift in range(0, spread.bit_length(), bits)]


def counting_pass(rows: DataFrame, digit: Column, block_bits: int, label: str) -> DataFrame:
    """The rows with ``_at`` moved to its place after a stable counting sort by the digit."""
    spark, columns = rows.sparkSession, [c for c in rows.columns if c != "_at"]
    placed = rows.withColumns({"_block": F.shiftright("_at", block_bits), "_digit": digit})
    within = Window.partitionBy("_block", "_digit").orderBy("_at")
    placed = stored(placed.withColumn("_place", F.row_number().over(within) - 1).drop("_at"), label)
    counts = placed.groupBy("_digit", "_block").agg(F.count(F.lit(1)).alias("n"))
    before, starts = 0, []
    for digit_value, n in sorted(map(tuple, counts.groupBy("_digit").agg(F.sum("n")).collect())):
        starts.append((digit_value, before))
        before += n
    first = F.broadcast(spark.createDataFrame(starts, "_digit int, first long"))
    earlier = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(first, "_digit")
    offsets = offsets.select("_digit", "_block", (F.col("first") + F.col("earlier")).alias("offset"))
    moved = placed.join(offsets, ["_digit", "_block"])
    return moved.select(*columns, (F.col("offset") + F.col("_place")).alias("_at"))


def ranked(rows: DataFrame, keys: list[tuple[str, bool]], rank: str = "rank", bits: int = BITS, block_bits: int | None = None) -> DataFrame:
    """The rows with their rank 1, 2, … by ``keys``: (column, ascending), the most significant first."""
    names = [f"c{i}" for i in range(len(rows.columns))]
    at = {c: names[rows.columns.index(c)] for c, _ in keys}
    placed = stored(rows.toDF(*names).withColumn("_at", F.monotonically_increasing_id()), "radix-rows")
    bounds = placed.agg(F.count(F.lit(1)), *[f(at[c]) for c, _ in keys for f in (F.min, F.max)]).first()
    n, *ends = bounds
    if block_bits is None:
        block_bits = min(LARGEST_BLOCK, max(LEAST_BLOCK, n.bit_length() - 10))
    passes = []
    for i, (c, ascending) in reversed(list(enumerate(keys))):
        passes += digits_of(at[c], ends[2 * i] or 0, ends[2 * i + 1] or 0, ascending, bits)
    # even without differing digits one pass is needed, which makes the places dense
    for i, digit in enumerate(passes or [F.lit(0)] if n else []):
        placed = counting_pass(placed, digit, block_bits, f"radix-pass-{i}")
    return placed.select(*names, (F.col("_at") + 1).alias("_rank")).toDF(*rows.columns, rank)
