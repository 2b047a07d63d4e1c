"""Sinks: CSV export, appends and stage tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def export_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("errorifexists").options(header=True, escape='"', sep=sep).csv(path)


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def stage_path(base: str, source: str, window: int, stage: str) -> str:
    return os.path.join(base, f"source={source}", f"window={window}", stage)


def save_stage(df: DataFrame, base: str, source: str, window: int, stage: str) -> DataFrame:
    """Write an intermediate result once and go on from the stored table."""
    path = stage_path(base, source, window, stage)
    df.write.mode("errorifexists").parquet(path)
    return load_stage(df.sparkSession, base, source, window, stage)


def load_stage(spark: SparkSession, base: str, source: str, window: int, stage: str) -> DataFrame:
    return spark.read.parquet(stage_path(base, source, window, stage))
