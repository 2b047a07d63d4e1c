"""Inter-event times and burstiness along the events of a unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.ordering import OrderedRows

SECONDS = {"secs": 1, "mins": 60, "hours": 3600, "days": 86400, "weeks": 604800}


def micros_of(seq: OrderedRows, time: str) -> Column:
    """Whole microseconds: as a double, seconds since 1970 would lose some."""
    kind, c = seq.rows.schema[time].dataType, F.col(time)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long") * 86_400_000_000
    return F.unix_micros(c.cast("timestamp"))


def inter_event_times(
    seq: OrderedRows, time: str, unit: str = "days", name: str = "inter_event_dur"
) -> OrderedRows:
    """Time since the previous event of the unit; null for the first."""
    now = micros_of(seq, time)
    seq = seq.with_columns({"_now": now}).rolling({"_last": lambda w: F.lag("_now").over(w)}, back=1)
    gap = (F.col("_now") - F.col("_last")) / F.lit(1e6) / F.lit(float(SECONDS[unit]))
    return seq.with_columns({name: gap}).drop("_now", "_last")


def burstiness_of(r: Column, n: Column, corrected: bool = False, variant: str = "published"):
    """B from r = sd/mean of n gaps; ``corrected`` allows for a finite number of gaps."""
    if not corrected:
        return F.try_divide(r - 1, r + 1)
    if variant == "published":
        lead = F.sqrt(n + 1) * r
    elif variant == "reference":
        lead = F.sqrt(n + r)
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return F.try_divide(lead - F.sqrt(n - 1), (F.sqrt(n + 1) - 2) * r + F.sqrt(n - 1))


def rolling_burstiness(
    seq: OrderedRows,
    duration: str = "inter_event_dur",
    k: int = 10,
    corrected: bool = False,
    variant: str = "published",
    name: str = "b_param",
) -> OrderedRows:
    """Burstiness of the k-1 gaps between the last k events; null until there are k events."""
    frame = lambda w: w.rowsBetween(-(k - 2), 0)
    seq = seq.rolling(
        {
            "_mean": lambda w: F.avg(duration).over(frame(w)),
            "_sd": lambda w: F.stddev_samp(duration).over(frame(w)),
            "_gaps": lambda w: F.count(duration).over(frame(w)).cast("double"),
        },
        back=k - 2,
    )
    r = F.try_divide(F.col("_sd"), F.col("_mean"))
    value = burstiness_of(r, F.col("_gaps"), corrected, variant)
    return seq.with_columns({name: F.when(F.col(seq.ordinal) >= k, value)}).drop(
        "_mean", "_sd", "_gaps"
    )
