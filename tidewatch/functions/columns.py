"""Column shaping: selection by name and type, renames, recodes, keys, validity filters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import require_columns, small_side

# The key columns of each reporting system and their common names.
KEY_COLUMNS = {
    "asrs": {"date": "event_date", "acn": "event_num", "cmbd_narrative": "event_text"},
    "rail": {"Date": "event_date", "Accident.Number": "event_num", "Narrative": "event_text"},
    "nrc": {"event_date": "event_date", "event_num": "event_num"},
    "phmsa": {"date": "event_date", "report_no": "event_num", "cmbd_narrative": "event_text"},
    "psn": {
        "FLR_SUBMIT_DATE": "event_date",
        "Report_ID": "event_num",
        "Narrative_merged": "event_text",
    },
}


def quoted(name: str) -> Column:
    """A column whose name may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def harmonise_keys(df: DataFrame, source: str) -> DataFrame:
    """Give a source's key columns their common names and make the event number a string."""
    if source not in KEY_COLUMNS:
        raise ValueError(f"unknown source {source!r}")
    renames = KEY_COLUMNS[source]
    require_columns(df, renames)
    df = df.withColumnsRenamed(renames)
    return df.withColumn("event_num", F.col("event_num").cast("string"))


def snake_case(name: str) -> str:
    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub(r"[^0-9a-z]+", "_", parts.lower()).strip("_") or "x"


def clean_names(df: DataFrame) -> DataFrame:
    """Snake-case names; a repeated name gets ``_2``, ``_3``, …"""
    seen: dict[str, int] = {}
    names = []
    for raw in df.columns:
        name = snake_case(raw)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def pick(
    df: DataFrame,
    names=(),
    starts_with: str | tuple[str, ...] | None = None,
    ends_with: str | tuple[str, ...] | None = None,
    contains: str | None = None,
    numeric: bool = False,
    without=(),
) -> list[str]:
    """Names of columns that satisfy every given condition; listed names must exist."""
    require_columns(df, names)
    chosen = []
    for f in df.schema.fields:
        if f.name in without or (names and f.name not in names):
            continue
        if starts_with is not None and not f.name.startswith(starts_with):
            continue
        if ends_with is not None and not f.name.endswith(ends_with):
            continue
        if contains is not None and contains not in f.name:
            continue
        if numeric and not isinstance(f.dataType, T.NumericType):
            continue
        chosen.append(f.name)
    return sorted(chosen, key=list(names).index) if names else chosen


def select_columns(df: DataFrame, **conditions) -> DataFrame:
    return df.select(*[quoted(c) for c in pick(df, **conditions)])


def with_prefix(df: DataFrame, prefix: str, columns: list[str] | None = None) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in (columns or df.columns)})


def relocate(df: DataFrame, *first: str, last: tuple[str, ...] = ()) -> DataFrame:
    middle = [c for c in df.columns if c not in first and c not in last]
    return df.select(*[quoted(c) for c in (*first, *middle, *last)])


def valid_text(text: str, placeholders: tuple[str, ...] = ()) -> Column:
    """Not missing, not empty, no placeholder, and valid UTF-8."""
    c = F.col(text)
    ok = c.isNotNull() & (c != "") & F.is_valid_utf8(c)
    return ok & ~c.isin(*placeholders) if placeholders else ok


def real_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows with a key that is not a repeated header line."""
    return df.filter(F.col(key).isNotNull() & (F.lower(key) != F.lit(key.lower())))


def year_between(date: str, first: int, last: int) -> Column:
    return F.year(date).between(first, last)


def members(df: DataFrame, column: str, values) -> DataFrame:
    """Rows whose value is in a list, or in the same column of a table."""
    if isinstance(values, DataFrame):
        return df.join(small_side(values.select(column).distinct()), column, "left_semi")
    return df.filter(F.col(column).isin(*values))


def non_members(df: DataFrame, column: str, values) -> DataFrame:
    if isinstance(values, DataFrame):
        return df.join(small_side(values.select(column).distinct()), column, "left_anti")
    return df.filter(~F.col(column).isin(*values))


def recode(df: DataFrame, column: str, mapping: dict[str, str], lower: bool = False) -> DataFrame:
    """Replace listed values; everything else keeps its (lower-cased) value."""
    base = F.lower(column) if lower else F.col(column)
    value = reduce(
        lambda chain, pair: chain.when(base == pair[0], F.lit(pair[1])),
        list(mapping.items())[1:],
        F.when(base == next(iter(mapping)), F.lit(next(iter(mapping.values())))),
    )
    return df.withColumn(column, value.otherwise(base))


def recode_by_table(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``mapping`` has columns ``old`` and ``new``; unlisted values stay."""
    names = small_side(mapping.select(F.col("old").alias(column), F.col("new").alias("_new")))
    joined = df.join(names, column, "left")
    return joined.withColumn(column, F.coalesce("_new", column)).drop("_new").select(*df.columns)


def two_way(condition: Column, yes, no) -> Column:
    """``no`` only where the condition is false; a null condition gives null."""
    return F.when(condition, F.lit(yes)).when(~condition, F.lit(no))


def by_ranges(column: str, ranges: list[tuple[float, float, float]]) -> Column:
    """(low, high, code) ranges, both ends included; null outside of all of them."""
    low, high, code = ranges[0]
    chain = F.when(F.col(column).between(low, high), F.lit(code))
    for low, high, code in ranges[1:]:
        chain = chain.when(F.col(column).between(low, high), F.lit(code))
    return chain


def compose_key(*parts, sep: str = "_") -> Column:
    return F.concat_ws(sep, *[F.col(p) if isinstance(p, str) else p for p in parts])


def split_key(df: DataFrame, column: str, names: list[str], sep: str = "_") -> DataFrame:
    return df.withColumns(
        {n: F.split_part(F.col(column), F.lit(sep), F.lit(i + 1)) for i, n in enumerate(names)}
    )


def to_share(df: DataFrame, prefix: str, total: str, drop_total: bool = True) -> DataFrame:
    """Divide a family of counts by a total per row; a zero total gives null."""
    family = pick(df, starts_with=prefix, without=(total,))
    df = df.withColumns({c: F.try_divide(F.col(c).cast("double"), F.col(total)) for c in family})
    return df.drop(total) if drop_total else df


def to_long(df: DataFrame, keys: list[str], columns: list[str], name="variable", value="value"):
    return df.unpivot(keys, columns, name, value)
