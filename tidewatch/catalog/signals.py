"""Inter-event times, burstiness and early-warning signals on the event log."""

from pyspark.sql import functions as F

from tidewatch.catalog.book import load, query, r6, rounded
from tidewatch.operators.groups import groups_of_size
from tidewatch.operators.ordering import in_order
from tidewatch.operators.series import inter_event_times, rolling_burstiness
from tidewatch.operators.signals import (
    crossing_count,
    crossings_by_metric,
    signals_long,
    single_signals,
)

UNIT, ORDER = ["user_id"], ["ts", "event_id"]
MIN_EVENTS, BURN_IN = 40, 20


def event_series(spark, sf_dir, unit="hours", min_events=MIN_EVENTS):
    """Events of units with enough of them, numbered, with the time since the previous one."""
    events = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    events = groups_of_size(events.na.drop(subset=UNIT), UNIT, min_events)
    return inter_event_times(in_order(events, UNIT, ORDER), "ts", unit)


# The event log with ordinals and gaps, as SQL.
EVENT_SERIES = f"""
gated AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n_unit FROM events
                         WHERE user_id IS NOT NULL) WHERE n_unit >= {MIN_EVENTS}),
series AS (SELECT event_id, ts, user_id, event_type, value,
                  row_number() OVER w AS t,
                  (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 / 3600 AS gap_hours
           FROM gated WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def signal_ctes(source: str, x: str, by: str, order: str, burn_in: int = BURN_IN) -> str:
    """Expanding signals of column x of a relation, ending in relation ``scored`` with c0..c6."""
    codes = ["ar1", "sd", "skew", "ar1+sd", "ar1+skew", "sd+skew", "ar1+sd+skew"]
    w = f"(PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    score = ", ".join(
        " + ".join(f"z_{m}" for m in code.split("+")) + f" AS c{i}" for i, code in enumerate(codes)
    )
    strength = ", ".join(
        f"avg(c{i}) OVER w AS mean{i}, stddev_samp(c{i}) OVER w AS sd{i}, "
        f"(c{i} - avg(c{i}) OVER w) / nullif(stddev_samp(c{i}) OVER w, 0) AS str{i}"
        for i in range(7)
    )
    return f"""
lagged AS (SELECT *, {x} AS x, row_number() OVER o AS tt, lag({x}) OVER o AS lx FROM {source}
           WINDOW o AS (PARTITION BY {by} ORDER BY {order})),
moments AS (SELECT *, stddev_samp(x) OVER w AS sd_, regr_slope(x, lx) OVER w AS ar1_,
                   avg(x) OVER w AS mu, avg(x*x) OVER w AS mu2, avg(x*x*x) OVER w AS mu3
            FROM lagged WINDOW w AS {w}),
shaped AS (SELECT *, CASE WHEN tt >= {burn_in} THEN sd_ END AS m_sd,
                  CASE WHEN tt >= {burn_in} THEN ar1_ END AS m_ar1,
                  CASE WHEN tt >= {burn_in} AND mu2 - mu*mu > 0
                       THEN (mu3 - 3*mu*mu2 + 2*mu*mu*mu) / pow(mu2 - mu*mu, 1.5) END AS m_skew
           FROM moments),
standard AS (SELECT *, (m_sd - avg(m_sd) OVER w) / nullif(stddev_samp(m_sd) OVER w, 0) AS z_sd,
                    (m_ar1 - avg(m_ar1) OVER w) / nullif(stddev_samp(m_ar1) OVER w, 0) AS z_ar1,
                    (m_skew - avg(m_skew) OVER w) / nullif(stddev_samp(m_skew) OVER w, 0) AS z_skew
             FROM shaped WINDOW w AS {w}),
composite AS (SELECT *, {score} FROM standard),
scored AS (SELECT *, {strength} FROM composite WINDOW w AS {w})"""


CROSSED = " + ".join(f"CASE WHEN str{i} > 2 THEN 1 ELSE 0 END" for i in range(7))


@query(
    "event_early_warnings",
    f"""WITH {EVENT_SERIES},
melted AS (SELECT user_id, ts, event_id, 'value' AS metric, value AS v FROM series
           UNION ALL SELECT user_id, ts, event_id, 'gap', gap_hours FROM series
           WHERE gap_hours IS NOT NULL),
{signal_ctes('melted', 'v', 'user_id, metric', 'ts, event_id')},
counts AS (SELECT event_id, metric, {CROSSED} AS n FROM scored WHERE tt > {BURN_IN}),
wide AS (SELECT event_id, max(n) FILTER (metric = 'value') AS value_crossed,
                max(n) FILTER (metric = 'gap') AS gap_crossed FROM counts GROUP BY event_id)
SELECT series.user_id, series.event_id, t, value_crossed, gap_crossed
FROM series LEFT JOIN wide USING (event_id)""",
)
def event_early_warnings(spark, sf_dir):
    """How many warning thresholds are crossed at each event of each unit, for two series."""
    seq = event_series(spark, sf_dir, "hours")
    series = seq.rows.withColumnRenamed("inter_event_dur", "gap")
    crossed = crossings_by_metric(
        series, UNIT, ORDER, ["value", "gap"], BURN_IN, longest=seq.longest, carry=("t",), keep_early=True
    )
    return crossed.select("user_id", "event_id", "t", "value_crossed", "gap_crossed")


@query(
    "value_signals_by_code",
    f"""WITH {EVENT_SERIES}, {signal_ctes('series', 'value', 'user_id', 'ts, event_id')},
codes AS (""" + " UNION ALL ".join(
        f"SELECT user_id, event_id, tt, '{name}' AS metric_code, c{i} AS s, mean{i} AS m, sd{i} AS d, "
        f"str{i} AS str FROM scored WHERE tt > {BURN_IN}"
        for i, name in enumerate(["ar1", "SD", "skew", "ar1 + SD", "ar1 + skew", "SD + skew",
                                  "ar1 + SD + skew"])
    ) + """)
SELECT user_id, event_id, tt AS t, metric_code, round(s, 6) + 0.0 AS metric_score,
       round(m, 6) + 0.0 AS rolling_mean, round(d, 6) + 0.0 AS rolling_sd,
       round(str, 6) + 0.0 AS str, coalesce(str > 2, false) AS threshold_crossed FROM codes""",
)
def value_signals_by_code(spark, sf_dir):
    """Every metric code of the single-series signals, in long form."""
    seq = event_series(spark, sf_dir)
    signals = single_signals(seq.rows, UNIT, ORDER, "value", BURN_IN, longest=seq.longest)
    long = signals_long(signals, ["user_id", "event_id", "t"])
    return rounded(long, "metric_score", "rolling_mean", "rolling_sd", "str")


@query(
    "crossings_of_all_codes",
    f"""WITH {EVENT_SERIES}, {signal_ctes('series', 'value', 'user_id', 'ts, event_id')}
SELECT user_id, count(*) AS events, CAST(sum({CROSSED}) AS BIGINT) AS crossings FROM scored
WHERE tt > {BURN_IN} GROUP BY user_id""",
)
def crossings_of_all_codes(spark, sf_dir):
    """Crossings per unit."""
    seq = event_series(spark, sf_dir)
    signals = single_signals(seq.rows, UNIT, ORDER, "value", BURN_IN, longest=seq.longest)
    counts = crossing_count(signals, "crossed")
    return counts.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum("crossed").alias("crossings")
    )


@query(
    "inter_event_hours",
    f"WITH {EVENT_SERIES} SELECT user_id, event_id, t, round(gap_hours, 6) + 0.0 AS gap_hours "
    "FROM series",
)
def inter_event_hours(spark, sf_dir):
    seq = event_series(spark, sf_dir, "hours")
    return seq.rows.select("user_id", "event_id", "t", r6("inter_event_dur").alias("gap_hours"))


def burstiness_sql(value: str) -> str:
    return f"""WITH {EVENT_SERIES},
gaps AS (SELECT *, avg(gap_hours) OVER w AS m, stddev_samp(gap_hours) OVER w AS s,
                CAST(count(gap_hours) OVER w AS DOUBLE) AS n
         FROM series WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
                                  ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
ratio AS (SELECT *, s / nullif(m, 0) AS r FROM gaps)
SELECT user_id, event_id, CASE WHEN t >= 10 THEN round({value}, 6) + 0.0 END AS b_param FROM ratio"""


def burstiness(spark, sf_dir, corrected, variant="published"):
    seq = rolling_burstiness(event_series(spark, sf_dir), k=10, corrected=corrected, variant=variant)
    return seq.rows.select("user_id", "event_id", r6("b_param").alias("b_param"))


@query("burstiness_rolling", burstiness_sql("(r - 1) / (r + 1)"))
def burstiness_rolling(spark, sf_dir):
    return burstiness(spark, sf_dir, False)


@query(
    "burstiness_corrected",
    burstiness_sql("(sqrt(n+1)*r - sqrt(n-1)) / ((sqrt(n+1) - 2)*r + sqrt(n-1))"),
)
def burstiness_corrected(spark, sf_dir):
    return burstiness(spark, sf_dir, True)


@query(
    "burstiness_corrected_as_coded",
    burstiness_sql("(sqrt(n+r) - sqrt(n-1)) / ((sqrt(n+1) - 2)*r + sqrt(n-1))"),
)
def burstiness_corrected_as_coded(spark, sf_dir):
    return burstiness(spark, sf_dir, True, "reference")
