"""Session settings, the shared scratch folder and the size checks used before any broadcast."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
#: Text, and rows of short columns, that one task gets of what is dealt out by key.
PART_BYTES = 16_000_000
PART_ROWS = 1_000_000


def local_session(cpus: int | str = "*", app: str = "tidewatch") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tidewatch-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody has written to yet, inside the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, for wide results that several later steps read few columns of."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a result that several later steps read, on reliable storage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores where the input has too few files for that; larger inputs stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def text_bytes(df: DataFrame, columns: list[str]) -> int:
    return df.agg(F.sum(sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c in columns), F.lit(0)))).first()[0] or 0


def parts_of(df: DataFrame, text: str, part_bytes: int = PART_BYTES) -> int:
    """How many parts of bounded size the texts make; no fewer than there are cores."""
    return max(math.ceil(text_bytes(df, [text]) / part_bytes), df.sparkSession.sparkContext.defaultParallelism)


def is_bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the row count is checked; otherwise leave a shuffle join to AQE."""
    return F.broadcast(df) if is_bounded(df, max_rows) else df


def counted_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast where the rows are counted few; otherwise joined by merging, for however small Spark may take either side."""
    return F.broadcast(df) if is_bounded(df, max_rows) else df.hint("merge")


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
