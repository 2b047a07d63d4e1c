"""The event registry and the tables keyed by its event ids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import relocate
from tidewatch.operators.ordering import in_order
from tidewatch.session import PART_ROWS

KEY = ["system_source", "event_num"]


def event_id(source: str | Column = "system_source", number: str | Column = "event_num") -> Column:
    """The same id for the same source and number, wherever and whenever it is computed.

    A separator inside the source is escaped, so no two keys share an id; null without a key.
    """
    source = F.col(source) if isinstance(source, str) else source
    number = F.col(number) if isinstance(number, str) else number
    escaped = F.regexp_replace(source.cast("string"), r"([\\|])", r"\\$1")
    return F.sha2(F.concat(escaped, F.lit("|"), number.cast("string")), 256)


def disambiguate(df: DataFrame, key: str, order: list[str], keep: str = "event_num_orig") -> DataFrame:
    """Number repeated keys ``key_1``, ``key_2``, … along ``order``; the original stays beside it."""
    rows = in_order(df.withColumn(keep, F.col(key)), [keep], order, ordinal="_k").rows
    named = F.concat_ws("_", F.col(keep), F.col("_k").cast("string"))
    return relocate(rows.withColumn(key, named).drop("_k"), key, last=(keep,))


def register(registry: DataFrame, events: DataFrame, source: str) -> DataFrame:
    """The registry with the source's events that were not in it yet."""
    new = events.select(
        F.lit(source).alias("system_source"),
        F.col("event_date").cast("date").alias("event_date"),
        F.col("event_num").cast("string").alias("event_num"),
    )
    new = new.filter("event_num IS NOT NULL")
    new = new.groupBy(*KEY).agg(F.min("event_date").alias("event_date"))
    new = new.join(registry, KEY, "left_anti").withColumn("eid", event_id())
    return registry.unionByName(new.select(*registry.columns))


def with_event_ids(registry: DataFrame, events: DataFrame, source: str) -> DataFrame:
    """The events with their ids in front; null for an event that is not registered.

    Only registry rows the events ask for are joined.
    """
    asked = events.select(F.col("event_num").cast("string").alias("event_num")).distinct()
    ids = (
        registry.filter(F.col("system_source") == source)
        .join(asked, "event_num", "left_semi")
        .select("eid", "event_num")
    )
    events = events.withColumn("event_num", F.col("event_num").cast("string"))
    return relocate(events.join(ids, "event_num", "left"), "eid")


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """The column, empty, unless the table has it."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def upsert_column(
    target: DataFrame, updates: DataFrame, registry: DataFrame, column: str
) -> tuple[DataFrame, DataFrame]:
    """Set one column for the events in ``updates`` (system_source, event_num, column).

    Returns the new table and the updates that could not be applied because none or several
    registered events answer to their key, because they are repeated, or because the target has no
    row of their event. An update to null is applied like any other.
    """
    ids = registry.select("eid", *KEY)
    matches = ids.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_ids"), F.min("eid").alias("eid"))
    given = updates.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_updates"), F.first(column).alias("_new")
    )
    resolved = given.join(matches, KEY, "left")
    usable = (F.col("n_ids") == 1) & (F.col("n_updates") == 1)
    report = [*KEY, "n_updates", F.coalesce("n_ids", F.lit(0)).alias("n_ids")]
    good = resolved.filter(usable)
    bad = resolved.filter(~F.coalesce(usable, F.lit(False))).select(*report)
    bad = bad.unionByName(good.join(target.select("eid"), "eid", "left_anti").select(*report))
    good = good.select("eid", "_new", F.lit(True).alias("_given"))
    value = F.when(F.col("_given"), F.col("_new")).otherwise(F.col(column))
    merged = target.join(good, "eid", "left").withColumn(column, value)
    return merged.select(*target.columns), bad


def violations(
    table: DataFrame,
    registry: DataFrame | None = None,
    key: str = "eid",
    vector_sizes: dict[str, int] | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """(rule, key, n): repeated or missing keys, keys without a registry row, wrong vector lengths.

    Keys are dealt out into parts of about ``part_rows`` rows, as parts of a bounded number of bytes hold any number of short keys.
    """
    size = max(table.count(), registry.count() if registry is not None else 0)
    parts = max(math.ceil(size / part_rows), table.sparkSession.sparkContext.defaultParallelism)
    counts = table.select(key).repartition(parts, key).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    checks = [
        counts.filter((F.col("n") > 1) | F.col(key).isNull())
        .select(F.lit("primary key").alias("rule"), F.col(key).cast("string").alias("key"), "n")
    ]
    if registry is not None:
        checks.append(
            counts.join(registry.select(key).repartition(parts, key), key, "left_anti")
            .select(F.lit("foreign key"), F.col(key).cast("string"), "n")
        )
    for column, size in (vector_sizes or {}).items():
        checks.append(
            table.filter(F.col(column).isNotNull() & (F.size(column) != size)).groupBy(key).count()
            .select(F.lit(f"length of {column}"), F.col(key).cast("string"), F.col("count"))
        )
    result = checks[0]
    for c in checks[1:]:
        result = result.union(c)
    return result


def events_with_vectors(
    embeddings: DataFrame, registry: DataFrame, raw: DataFrame, source: str, columns: list[str],
    vectors: list[str],
) -> DataFrame:
    """Vectors of a source's events next to columns of its raw table."""
    linked = embeddings.select("eid", *vectors).join(registry.select("eid", "system_source"), "eid", "left")
    linked = linked.join(raw.select("eid", *columns), "eid", "left")
    return linked.filter(F.col("system_source") == source).drop("system_source")


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been written yet: resuming without counting rows."""
    return df.join(done.select(key), key, "left_anti")


def from_row(df: DataFrame, order: list[str], first: int) -> DataFrame:
    """Rows from the n-th on in a given order."""
    return in_order(df, [], order, ordinal="_row").rows.filter(F.col("_row") >= first).drop("_row")
