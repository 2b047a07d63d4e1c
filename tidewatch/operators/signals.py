"""Early-warning signals of one series per unit, over an expanding window.

Every statistic is a function of running sums, so a unit is read once in time order and nothing is
recomputed per row. Sums are taken of differences to the unit's first value, which keeps them exact
for constant series and well conditioned for the rest.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordering import BLOCK_ROWS, OrderedRows, in_order

SINGLE_METRICS = ("ar1", "SD", "skew")


def metric_codes(metrics) -> list[tuple[str, ...]]:
    """All non-empty subsets, named as the sum of their members."""
    return [c for size in range(1, len(metrics) + 1) for c in combinations(metrics, size)]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def expanding_mean_sd(seq: OrderedRows, names: list[str]) -> OrderedRows:
    """``x_mean`` and ``x_sd`` of the non-null values so far, for every named column."""
    seq = seq.anchored({f"{x}_a": F.col(x) for x in names})
    sums = {}
    for x in names:
        d = F.col(x) - F.col(f"{x}_a")
        sums |= {
            f"{x}_n": F.when(F.col(x).isNotNull(), 1.0),
            f"{x}_1": d,
            f"{x}_2": d * d,
        }
    seq = seq.running(sums)
    stats = {}
    for x in names:
        n, s1, s2 = F.col(f"{x}_n"), F.col(f"{x}_1"), F.col(f"{x}_2")
        spread = F.greatest(s2 - s1 * s1 / n, F.lit(0.0))
        stats[f"{x}_mean"] = F.col(f"{x}_a") + s1 / n
        stats[f"{x}_sd"] = F.when(n > 1, F.sqrt(spread / F.nullif(n - 1, F.lit(0.0))))
    seq = seq.with_columns(stats)
    return seq.drop(*[f"{x}_{s}" for x in names for s in ("a", "n", "1", "2")])


def expanding_moments(seq: OrderedRows, x: str) -> OrderedRows:
    """``SD``, population ``skew`` and the lag-one slope ``ar1`` of rows 1..t."""
    seq = seq.rolling({"_lx": lambda w: F.lag(x).over(w)}, back=1).anchored({"_a": F.col(x)})
    d, dl = F.col(x) - F.col("_a"), F.col("_lx") - F.col("_a")
    paired = F.col("_lx").isNotNull()
    seq = seq.running(
        {
            "_n": F.lit(1.0),
            "_s1": d,
            "_s2": d * d,
            "_s3": d * d * d,
            "_c": F.when(paired, 1.0),
            "_sx": F.when(paired, d),
            "_sl": dl,
            "_sll": dl * dl,
            "_sxl": d * dl,
        }
    )
    n, s1, s2, s3 = (F.col(f"_{k}") for k in ("n", "s1", "s2", "s3"))
    c, sx, sl, sll, sxl = (F.col(f"_{k}") for k in ("c", "sx", "sl", "sll", "sxl"))
    mean = s1 / n
    m2 = F.greatest(s2 / n - mean * mean, F.lit(0.0))
    m3 = s3 / n - 3 * mean * s2 / n + 2 * mean * mean * mean
    spread = F.greatest(s2 - s1 * s1 / n, F.lit(0.0))
    seq = seq.with_columns(
        {
            "SD": F.when(n > 1, F.sqrt(spread / F.nullif(n - 1, F.lit(0.0)))),
            "skew": _ratio(m3, F.pow(m2, F.lit(1.5))),
            "ar1": _ratio(sxl - sx * sl / c, sll - sl * sl / c),
        }
    )
    return seq.drop("_lx", "_a", *[f"_{k}" for k in "n s1 s2 s3 c sx sl sll sxl".split()])


def single_signals(
    df: DataFrame,
    unit: list[str],
    order: list[str],
    metric: str,
    burn_in: int = 50,
    threshold: float = 2.0,
    block_rows: int = BLOCK_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """One row per event after the burn-in, with score, running mean and sd, strength and crossing
    of every metric code (``<i>_score``, ``<i>_mean``, ``<i>_sd``, ``<i>_str``, ``<i>_crossed``)."""
    seq = in_order(df.na.drop(subset=[metric]), unit, order, block_rows=block_rows, longest=longest)
    seq = expanding_moments(seq, metric)
    return _scored(seq, SINGLE_METRICS, burn_in, threshold).rows.filter(F.col("t") > burn_in)


def _scored(seq: OrderedRows, metrics, burn_in: int, threshold: float) -> OrderedRows:
    kept = {f"_m_{m}": F.when(F.col(seq.ordinal) >= burn_in, F.col(m)) for m in metrics}
    seq = expanding_mean_sd(seq.with_columns(kept), list(kept))
    z = {
        m: _ratio(F.col(f"_m_{m}") - F.col(f"_m_{m}_mean"), F.col(f"_m_{m}_sd")) for m in metrics
    }
    codes = metric_codes(metrics)
    scores = {
        f"c{i}_score": sum((z[m] for m in code[1:]), z[code[0]]) for i, code in enumerate(codes)
    }
    seq = seq.with_columns(scores).drop(
        *[f"_m_{m}{s}" for m in metrics for s in ("", "_mean", "_sd")], *metrics
    )
    seq = expanding_mean_sd(seq, list(scores))
    strength = {
        f"c{i}_str": _ratio(
            F.col(f"c{i}_score") - F.col(f"c{i}_score_mean"), F.col(f"c{i}_score_sd")
        )
        for i in range(len(codes))
    }
    seq = seq.with_columns(strength)
    return seq.with_columns(
        {
            f"c{i}_crossed": F.coalesce(F.col(f"c{i}_str") > threshold, F.lit(False))
            for i in range(len(codes))
        }
    )


def signals_long(signals: DataFrame, keys: list[str], metrics=SINGLE_METRICS) -> DataFrame:
    """One row per event and metric code."""
    rows = [
        F.struct(
            F.lit(" + ".join(code)).alias("metric_code"),
            F.col(f"c{i}_score").alias("metric_score"),
            F.col(f"c{i}_score_mean").alias("rolling_mean"),
            F.col(f"c{i}_score_sd").alias("rolling_sd"),
            F.col(f"c{i}_str").alias("str"),
            F.col(f"c{i}_crossed").alias("threshold_crossed"),
        )
        for i, code in enumerate(metric_codes(metrics))
    ]
    return signals.select(*keys, F.inline(F.array(*rows)))


def crossing_count(signals: DataFrame, name: str, n_codes: int = 7) -> DataFrame:
    """How many codes cross at each event, without the per-code columns."""
    total = sum((F.col(f"c{i}_crossed").cast("int") for i in range(1, n_codes)),
                F.col("c0_crossed").cast("int"))
    details = [f"c{i}_{s}" for i in range(n_codes)
               for s in ("score", "score_mean", "score_sd", "str", "crossed")]
    return signals.withColumn(name, total).drop(*details)


def crossings_by_metric(
    df: DataFrame,
    unit: list[str],
    order: list[str],
    metrics: list[str],
    burn_in: int = 50,
    threshold: float = 2.0,
    block_rows: int = BLOCK_ROWS,
    longest: int | None = None,
    carry: tuple[str, ...] = (),
    keep_early: bool = False,
) -> DataFrame:
    """``<metric>_crossed`` for several series in one pass: melted, partitioned by unit and metric.

    ``longest`` is a bound on the rows of a unit, where known. ``carry`` names further columns of the
    events to keep; with ``keep_early`` events up to the burn-in stay, without counts.
    """
    long = df.select(
        *unit, *order, *carry,
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x"))
                           for m in metrics])),
    )
    seq = in_order(long.na.drop(subset=["x"]), [*unit, "metric"], order, "_t", block_rows, longest)
    signals = _scored(expanding_moments(seq, "x"), SINGLE_METRICS, burn_in, threshold).rows
    counts = crossing_count(signals, "crossed")
    late = F.col("_t") > burn_in
    if not keep_early:
        counts = counts.filter(late)
    return counts.groupBy(*unit, *order, *carry).agg(
        *[F.max(F.when(late & (F.col("metric") == m), F.col("crossed"))).alias(f"{m}_crossed")
          for m in metrics]
    )


def join_signals(left: DataFrame, right: DataFrame, key: str = "eid") -> DataFrame:
    """Single and joint signals side by side, whichever side has the event."""
    return left.join(right, key, "full")


def attach_outcomes(signals: DataFrame, outcomes: DataFrame, unit: str, key: str = "eid"):
    return signals.join(outcomes, key, "left").na.drop(subset=[unit])
