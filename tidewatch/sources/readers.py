"""Report tables from files and stored tables."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.columns import quoted, real_rows
from tidewatch.functions.text import count_word_runs, read_month
from tidewatch.session import small_side


def read_csv(spark: SparkSession, path, schema: str | None = None, sep: str = ",") -> DataFrame:
    """CSV with a header; give the schema where it is known, as inferring reads the file twice."""
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"', sep=sep)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_delimited(spark: SparkSession, path, sep: str = "$", schema: str | None = None) -> DataFrame:
    """A header file with its own delimiter, one record per line, so that it can be split."""
    reader = spark.read.options(header=True, sep=sep)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_two_line_header(
    spark: SparkSession, path: str, skip: int = 3, columns: int | None = None
) -> DataFrame:
    """A CSV whose names are spread over two lines: each name is line 1 + line 2 + ``.``.

    ``skip`` lines from the top of a file hold no data; only the first ``columns`` columns are read.
    A file may be read in parallel: a line's place comes from its number within the file's first
    block, so data that equals a header line stays. Files of a folder that begin without the header
    lose nothing.
    """
    head = [r["value"] for r in spark.read.text(path).limit(skip).collect()]
    first, second = list(csv.reader(head[:2]))
    width = max(len(first), len(second))
    first, second = ([*x, *[""] * (width - len(x))] for x in (first, second))
    keep = range(columns or width)
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"),
    )
    tops = lines.filter("_block = 0").groupBy("_file").agg(F.min("_at").alias("_top"))
    placed = lines.join(small_side(tops), "_file", "left")
    place = F.when(F.col("_block") == 0, F.col("_at") - F.col("_top")).cast("int")
    header = (place < len(head)) & F.get(F.array(*map(F.lit, head)), place).eqNullSafe(F.col("value"))
    data = placed.filter(~F.coalesce(header, F.lit(False)) & (F.trim("value") != ""))
    schema = ", ".join(f"c{i} string" for i in range(width))
    rows = data.select(F.from_csv("value", F.lit(schema), {"escape": '"'}).alias("r"))
    return rows.select(*[F.col(f"r.c{i}").alias(f"{first[i]}{second[i]}.") for i in keep])


def read_many(
    spark: SparkSession, path: str | list[str], schema: str | None = None, recursive: bool = True,
    provenance: str | None = None,
) -> DataFrame:
    """All CSV files below a folder that share one layout, with the file name on request."""
    reader = spark.read.options(header=True, recursiveFileLookup=recursive)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.withColumn(provenance, F.col("_metadata.file_path")) if provenance else df


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows of tables with differing columns; what a table lacks becomes null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_table(spark: SparkSession, name_or_path: str, **jdbc_options) -> DataFrame:
    """A stored table: parquet folder, catalogue table, or a database table with JDBC options."""
    if jdbc_options:
        return spark.read.format("jdbc").options(dbtable=name_or_path, **jdbc_options).load()
    if "/" in name_or_path:
        return spark.read.parquet(name_or_path)
    return spark.read.table(name_or_path)


def clean_asrs(df: DataFrame) -> DataFrame:
    """Aviation reports: header echoes off, month to date, narratives merged, words counted."""
    narratives = [c for c in df.columns if c.startswith("report_")]
    merged = F.concat_ws(" ", *[quoted(c) for c in narratives])
    df = real_rows(df, "acn").withColumn("date", read_month("time_date"))
    df = df.withColumn("cmbd_narrative", merged)
    return df.withColumn("tot_wc", count_word_runs("cmbd_narrative"))
