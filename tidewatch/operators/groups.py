"""Aggregations per group, group-size filters and column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.quantiles import quantiles
from tidewatch.session import small_side


def mean_sd(df: DataFrame, by: list[str], columns: list[str], sd_suffix: str = "std") -> DataFrame:
    """``x_mean`` and ``x_std`` of every column per group."""
    stats = [
        s for c in columns
        for s in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_{sd_suffix}"))
    ]
    return df.groupBy(*by).agg(*stats)


def group_count(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def count_true(df: DataFrame, by: list[str], flag: Column, name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(flag).alias(name))


def groups_of_size(df: DataFrame, by: list[str], at_least: int) -> DataFrame:
    """Rows of groups that have enough of them: counts first, then a semi join, so that no group
    has to fit into one task."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least)
    return df.join(small_side(sizes), by, "left_semi")


def day_of(column: str) -> Column:
    return F.date_trunc("day", F.col(column).cast("timestamp"))


def month_counts(df: DataFrame, time: str, name: str) -> DataFrame:
    month = F.date_trunc("month", F.col(time).cast("timestamp")).alias("month")
    return df.groupBy(month).agg(F.count(F.lit(1)).alias(name))


def rate_by_level(df: DataFrame, level: str, count: str) -> DataFrame:
    total = F.sum(count)
    return df.groupBy(level).agg(
        total.alias(f"sum_{count}"), (total / F.count(F.lit(1))).alias("rate")
    )


def date_spine(daily: DataFrame, day: str) -> DataFrame:
    """Every day between the first and the last one, empty days included."""
    ends = daily.agg(F.min(day).cast("date").alias("lo"), F.max(day).cast("date").alias("hi"))
    spine = ends.select(F.explode(F.sequence("lo", "hi")).alias("_day"))
    dated = daily.withColumn("_day", F.col(day).cast("date")).drop(day)
    return spine.join(dated, "_day", "left").withColumnRenamed("_day", day)


def ordered_text(
    df: DataFrame, by: list[str], order: list[str], text: str, name: str, sep: str = " "
) -> DataFrame:
    """The texts of a group, in order, pasted together.

    The group's text is one value, so it must fit into one; for the terms of groups of any size,
    count them by group with ``term_counts`` instead of pasting first.
    """
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return df.groupBy(*by).agg(F.array_join(parts["_text"], sep).alias(name))


def profile(df: DataFrame, columns: list[str], shares=(0.25, 0.5, 0.75)) -> DataFrame:
    """Rows, missing values, mean, sd and quantiles of every column: one row per column."""
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[s for i, c in enumerate(columns) for x in [F.col(c).cast("double")] for s in (
            F.count_if(x.isNull()).alias(f"missing{i}"), F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"sd{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"))],
    ).first()
    cuts = quantiles(df, columns, list(shares))
    rows = [
        (c, stats["n"], *[stats[f"{k}{i}"] for k in ("missing", "mean", "sd", "lo")], *cuts[c], stats[f"hi{i}"])
        for i, c in enumerate(columns)
    ]
    names = ["mean double", "sd double", "p0 double", *[f"p{round(q * 100)} double" for q in shares], "p100 double"]
    schema = "variable string, n bigint, n_missing bigint, " + ", ".join(names)
    return df.sparkSession.createDataFrame(rows, schema)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    bucket = F.width_bucket(F.col(column).cast("double"), F.lit(low), F.lit(high), F.lit(bins))
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def with_group_end(df: DataFrame, by: list[str]) -> DataFrame:
    """One extra row per group holding only its key, to part the series of two groups."""
    ends = df.select(*by).distinct().withColumn("group_end", F.lit(True))
    return df.withColumn("group_end", F.lit(False)).unionByName(ends, allowMissingColumns=True)
