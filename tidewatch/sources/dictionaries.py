"""Dictionaries and feature maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def liwc_dictionary(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A ``%``-delimited category header and pattern lines as (dict, category, pattern).

    The header stands between the two ``%`` lines, so a pattern may begin with digits. A dictionary is a
    small file, read in one piece; only the places of its ``%`` lines reach the driver.
    """
    lines = spark.read.text(path).coalesce(1).select(
        F.trim("value").alias("line"), F.monotonically_increasing_id().alias("at")
    )
    signs = [r["at"] for r in lines.filter("line = '%'").orderBy("at").limit(2).collect()]
    end = signs[1] if len(signs) == 2 else -1
    parts = lines.filter("line NOT IN ('', '%')").select("at", F.split("line", r"\t+").alias("p"))
    is_header = F.col("at") < end
    heads = parts.filter(is_header).select(
        F.col("p")[0].alias("id"), F.trim(F.get("p", F.lit(1))).alias("category")
    )
    body = parts.filter(~is_header).select(
        F.col("p")[0].alias("pattern"), F.explode(F.slice("p", 2, F.size("p"))).alias("id")
    )
    return body.withColumn("id", F.trim("id")).join(heads, "id").select(
        F.lit(name).alias("dict"), "category", "pattern"
    )


def csv_dictionary(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A CSV with the columns category and pattern."""
    rows = spark.read.csv(path, header=True, schema="category STRING, pattern STRING")
    return rows.select(F.lit(name).alias("dict"), "category", "pattern")


def read_dictionary(spark: SparkSession, path: str, name: str) -> DataFrame:
    return (liwc_dictionary if path.endswith(".dic") else csv_dictionary)(spark, path, name)


def feature_names(feature_map: DataFrame) -> DataFrame:
    """Distinct ``prefix‖variables`` of the rows that are not marked to be dropped."""
    kept = feature_map.filter(F.col("drop").isNull())
    name = F.concat(F.coalesce("prefix", F.lit("")), "variables")
    return kept.select(name.alias("var_name")).distinct()
