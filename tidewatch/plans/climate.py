"""The composite climate vector: features that vary, over all reporting systems together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import pick, quoted, to_share
from tidewatch.functions.vectors import to_vector
from tidewatch.operators.screening import varying_columns
from tidewatch.session import require_columns
from tidewatch.sources.readers import union_by_name

KEYS = ("dataSet_num", "event_num", "sys_source")


def pooled_features(sources: dict[str, DataFrame], features: list[str], total: str = "liwc_WC") -> DataFrame:
    """Features of all sources, one below the other, with dictionary counts as shares of the words."""
    keys = [k for k in KEYS if k != "sys_source"]
    frames = [
        require_columns(df, [*features, *keys]).select(*[quoted(c) for c in (*features, *keys)])
        .withColumn("sys_source", F.lit(name))
        for name, df in sources.items()
    ]
    return to_share(union_by_name(frames), "gi_", total)


def climate_vectors(
    sources: dict[str, DataFrame], features: list[str], total: str = "liwc_WC",
    prefix: str = "comp_clim_", name: str = "composite_climate_vec",
) -> DataFrame:
    """Keys, the features that vary (prefixed) and their vector; events with a gap are left out."""
    pooled = pooled_features(sources, features, total)
    numeric = pick(pooled, numeric=True, without=KEYS)
    kept = varying_columns(pooled, numeric)
    named = pooled.select(*KEYS, *[quoted(c).cast("double").alias(prefix + c) for c in kept]).na.drop()
    return named.withColumn(name, to_vector([prefix + c for c in kept]))
