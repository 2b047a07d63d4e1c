"""Rows of a unit in time order, for units of any length.

A window over ``partitionBy(unit)`` puts a whole unit into one task. That is the right plan while
every unit fits, so it is used then. When a unit is longer than ``block_rows``, ordinals come from
counted slices of the order key, and later windows run over blocks of ``block_rows`` consecutive
rows: bounded frames see the rows next to the block border through copies of them, expanding sums
start from the sum of the earlier blocks. Both ways give the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import settle, small_side

BLOCK_ROWS = 1_000_000


def order_number(df: DataFrame, name: str) -> Column:
    """A value that never decreases along the order of the column: a double, or the text itself."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.StringType):
        return c
    raise TypeError(f"{name}: {kind.simpleString()} cannot order a series")


def bytes_in_common(a: str, b: str) -> Column:
    """How many bytes two texts begin with alike."""
    same = F.expr(
        f"filter(sequence(1, least(octet_length({a}), octet_length({b})) + 1),"
        f" i -> substring(encode({a}, 'UTF-8'), i, 1) <> substring(encode({b}, 'UTF-8'), i, 1)"
        f" OR i > least(octet_length({a}), octet_length({b})))[0] - 1"
    )
    return same


def text_number(text: str, skip: str) -> Column:
    """The six bytes after the first ``skip`` ones as a double."""
    head = F.expr(f"hex(substring(encode({text}, 'UTF-8'), {skip} + 1, 6))")
    return F.conv(F.rpad(head, 12, "0"), 16, 10).cast("double")


@dataclass(frozen=True)
class OrderedRows:
    rows: DataFrame
    unit: tuple[str, ...]
    order: tuple[str, ...]
    block_rows: int
    split: bool
    ordinal: str = "t"
    longest: int | None = None

    # -- windows -------------------------------------------------------------------------------

    def _block(self) -> Column:
        return F.floor((F.col(self.ordinal) - 1) / F.lit(self.block_rows))

    def rolling(
        self, columns: dict[str, Callable[[WindowSpec], Column]], back: int = 0, ahead: int = 0
    ) -> OrderedRows:
        """Columns over frames that reach at most ``back`` rows up and ``ahead`` rows down."""
        if not self.split:
            w = Window.partitionBy(*self.unit).orderBy(*self.order)
            return replace(self, rows=self.rows.withColumns({k: f(w) for k, f in columns.items()}))
        place = F.col(self.ordinal) - 1
        # every block whose frames reach this row; a frame may be longer than a block
        first = F.greatest(F.floor((place - ahead) / F.lit(self.block_rows)), F.lit(0).cast("long"))
        last = F.floor((place + back) / F.lit(self.block_rows))
        spread = (
            self.rows.withColumn("_home", self._block())
            .withColumn("_block", F.explode(F.sequence(first, last)))
        )
        w = Window.partitionBy(*self.unit, "_block").orderBy(self.ordinal)
        done = spread.withColumns({k: f(w) for k, f in columns.items()})
        return replace(self, rows=done.filter("_home = _block").drop("_home", "_block"))

    def running(self, sums: dict[str, Column]) -> OrderedRows:
        """Sums of expressions from the first row of the unit up to and with the current row."""
        if not self.split:
            w = (
                Window.partitionBy(*self.unit)
                .orderBy(*self.order)
                .rowsBetween(Window.unboundedPreceding, Window.currentRow)
            )
            return replace(
                self, rows=self.rows.withColumns({k: F.sum(e).over(w) for k, e in sums.items()})
            )
        keys = [*self.unit, "_block"]
        rows = self.rows.withColumn("_block", self._block())
        inside = (
            Window.partitionBy(*keys)
            .orderBy(self.ordinal)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        before = (
            Window.partitionBy(*self.unit)
            .orderBy("_block")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = (
            rows.groupBy(*keys)
            .agg(*[F.sum(e).alias(k) for k, e in sums.items()])
            .select(*keys, *[F.sum(k).over(before).alias(f"_before_{k}") for k in sums])
            .filter("_block > 0")
        )
        # small, but made of all rows: stored, so that the next step does not make it again
        carry = small_side(settle(carry))
        rows = rows.withColumns({k: F.sum(e).over(inside) for k, e in sums.items()})
        rows = rows.join(carry, keys, "left").withColumns(
            {
                k: F.coalesce(F.col(k) + F.col(f"_before_{k}"), F.col(k), F.col(f"_before_{k}"))
                for k in sums
            }
        )
        return replace(self, rows=rows.drop("_block", *[f"_before_{k}" for k in sums]))

    def running_rank(self, cell: str, name: str) -> OrderedRows:
        """How many rows of the same unit and cell have come so far, the current one included."""
        if not self.split:
            w = Window.partitionBy(*self.unit, cell).orderBy(*self.order)
            return replace(self, rows=self.rows.withColumn(name, F.row_number().over(w)))
        keys = [*self.unit, cell, "_block"]
        rows = self.rows.withColumn("_block", self._block())
        before = (
            Window.partitionBy(*self.unit, cell)
            .orderBy("_block")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = rows.groupBy(*keys).count().select(
            *keys, F.sum("count").over(before).alias("_before")
        )
        carry = small_side(settle(carry.filter("_before IS NOT NULL")))
        inside = Window.partitionBy(*keys).orderBy(self.ordinal)
        rows = (
            rows.withColumn(name, F.row_number().over(inside))
            .join(carry, keys, "left")
            .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        )
        return replace(self, rows=rows.drop("_block", "_before"))

    def anchored(self, columns: dict[str, Column]) -> OrderedRows:
        """The unit's first non-null value of each expression, on every row from there on."""
        if not self.split:
            w = (
                Window.partitionBy(*self.unit)
                .orderBy(*self.order)
                .rowsBetween(Window.unboundedPreceding, Window.currentRow)
            )
            firsts = {k: F.first(e, ignorenulls=True).over(w) for k, e in columns.items()}
            return replace(self, rows=self.rows.withColumns(firsts))
        t = F.col(self.ordinal)
        firsts = self.rows.groupBy(*self.unit).agg(
            *[
                F.min(F.when(e.isNotNull(), F.struct(t.alias("t"), e.alias("v")))).alias(k)
                for k, e in columns.items()
            ]
        )
        rows = self._beside(firsts)
        rows = rows.withColumns({k: F.when(F.col(k)["t"] <= t, F.col(k)["v"]) for k in columns})
        return replace(self, rows=rows)

    def with_length(self, name: str) -> OrderedRows:
        """The number of rows of the unit."""
        if not self.split:
            w = Window.partitionBy(*self.unit)
            return replace(self, rows=self.rows.withColumn(name, F.count(F.lit(1)).over(w)))
        lengths = self.rows.groupBy(*self.unit).agg(F.count(F.lit(1)).alias(name))
        return replace(self, rows=self._beside(lengths))

    def _beside(self, per_unit: DataFrame) -> DataFrame:
        """A stored table of one row per unit next to the rows."""
        per_unit = small_side(settle(per_unit))
        if not self.unit:
            one = F.lit(0).alias("_one")
            return self.rows.select("*", one).join(per_unit.select("*", one), "_one").drop("_one")
        return self.rows.join(per_unit, list(self.unit), "left")

    # -- projections ---------------------------------------------------------------------------

    def with_columns(self, columns: dict[str, Column]) -> OrderedRows:
        return replace(self, rows=self.rows.withColumns(columns))

    def drop(self, *names: str) -> OrderedRows:
        return replace(self, rows=self.rows.drop(*names))


def in_order(
    df: DataFrame,
    unit: list[str] | tuple[str, ...],
    order: list[str] | tuple[str, ...],
    ordinal: str = "t",
    block_rows: int = BLOCK_ROWS,
    longest: int | None = None,
) -> OrderedRows:
    """Number the rows of every unit 1, 2, … along ``order``; its last column must break ties.

    Unit lengths are counted first; ``longest`` saves that where a bound on them is known.
    """
    unit, order = tuple(unit), tuple(order)
    if longest is None:
        lengths = df.groupBy(*unit).agg(F.count(F.lit(1)).alias("n"))
        longest = lengths.agg(F.max("n")).first()[0] or 0
    if unit and longest <= block_rows:
        w = Window.partitionBy(*unit).orderBy(*order)
        rows = df.withColumn(ordinal, F.row_number().over(w).cast("long"))
        return OrderedRows(rows, unit, order, block_rows, False, ordinal, longest)
    rows = _number_long_units(df, unit, order, ordinal, block_rows)
    return OrderedRows(rows, unit, order, block_rows, True, ordinal, longest)


def _number_long_units(df, unit, order, ordinal, block_rows) -> DataFrame:
    """Ordinals from slices of the order key, cut finer until no slice is longer than a block."""
    numbers = [f"_o{i}" for i in range(len(order))]
    texts = [isinstance(df.schema[c].dataType, T.StringType) for c in order]
    # a missing order value sorts first
    rows = df.withColumns(
        {
            n: F.coalesce(order_number(df, c), F.lit("") if text else F.lit(-1e300))
            for n, c, text in zip(numbers, order, texts)
        }
    )
    keys: list[str] = list(unit)
    depth = 0
    while True:
        bounds = [b for n in numbers for b in (F.min(n).alias(f"{n}_lo"), F.max(n).alias(f"{n}_hi"))]
        long_groups = (
            rows.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("_n"), *bounds)
            .filter(F.col("_n") > block_rows)
            # a group all of whose order values agree cannot be cut any further
            .filter(" OR ".join(f"{n}_lo < {n}_hi" for n in numbers))
        )
        # texts are told apart by the bytes after those that all of the group's begin with
        for n, text in zip(numbers, texts):
            if text:
                long_groups = long_groups.withColumn(f"{n}_skip", bytes_in_common(f"{n}_lo", f"{n}_hi"))
        differ = F.coalesce(
            *[
                F.when(
                    F.col(f"{n}_lo") < F.col(f"{n}_hi"),
                    text_number(f"{n}_lo", f"{n}_skip") < text_number(f"{n}_hi", f"{n}_skip") if text
                    else F.col(f"{n}_hi") - F.col(f"{n}_lo") > 1e-290,
                )
                for n, text in zip(numbers, texts)
            ]
        )
        long_groups = long_groups.filter(differ)
        # at most rows / block_rows rows; stored, as the rows of every finer cut are joined to it
        long_groups = settle(long_groups)
        if long_groups.isEmpty():
            break
        # cut along the first order column that still varies inside the group
        pieces = F.ceil(F.col("_n") / block_rows) * 4
        cut = F.lit(None).cast("long")
        for n, text in reversed(list(zip(numbers, texts))):
            value, lo, hi = F.col(n), F.col(f"{n}_lo"), F.col(f"{n}_hi")
            if text:
                value, low, high = (text_number(x, f"{n}_skip") for x in (n, f"{n}_lo", f"{n}_hi"))
            else:
                low, high = lo, hi
            piece = F.floor((value - low) / ((high - low) / pieces))
            cut = F.when(lo < hi, F.least(piece, pieces - 1)).otherwise(cut)
        extra = ["_n", *[c for c in long_groups.columns if c.startswith("_o")]]
        slice_name = f"_s{depth}"
        if keys:
            long_groups = small_side(long_groups)
            rows = rows.join(long_groups, keys, "left")
        else:
            only = long_groups.first()
            rows = rows.withColumns({e: F.lit(only[e]) for e in extra})
        rows = rows.withColumn(slice_name, F.coalesce(cut, F.lit(0))).drop(*extra)
        keys.append(slice_name)
        depth += 1
    slices = [k for k in keys if k not in unit]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    offset = F.lit(0)
    if slices:
        before = (
            Window.partitionBy(*(unit or [F.lit(0)]))
            .orderBy(*slices)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        counts = counts.select(*keys, F.sum("_n").over(before).alias("_before"))
        counts = settle(counts.filter("_before IS NOT NULL"))
        rows = rows.join(small_side(counts), keys, "left")
        offset = F.coalesce("_before", F.lit(0))
    inside = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    rows = rows.withColumn(ordinal, (F.row_number().over(inside) + offset).cast("long"))
    return rows.drop("_before", *slices, *numbers)
