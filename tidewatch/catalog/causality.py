"""Forecast skill and cross mapping of the event series, per unit."""

from pyspark.sql import functions as F

from tidewatch.catalog.book import query, rounded
from tidewatch.catalog.signals import EVENT_SERIES, MIN_EVENTS, ORDER, UNIT, event_series
from tidewatch.operators import causality as M

DIMS = [2, 3, 4, 5]
LAGS = ", ".join(f"lag(value, {i}) OVER w AS x{i}" for i in range(1, 5))
LEADS = ", ".join(f"lead(value, {i}) OVER w AS y{i}" for i in range(1, 11))


def distance(e: int) -> str:
    return "sqrt((a.value - b.value)^2" + "".join(f" + (a.x{i} - b.x{i})^2" for i in range(1, e)) + ")"


def skill_sql(pairs: list[tuple[int, int]]) -> str:
    """CTEs ending in ``skills`` (user_id, e, step, n_forecasts, rho)."""
    near = " UNION ALL ".join(
        f"""SELECT a.user_id, {e} AS e, {s} AS step, a.t, a.y{s} AS actual, b.y{s} AS y, {distance(e)} AS d,
 row_number() OVER (PARTITION BY a.user_id, a.t ORDER BY {distance(e)}, b.t) AS k FROM pts a JOIN pts b
 ON a.user_id = b.user_id AND a.t <> b.t WHERE a.x{e - 1} IS NOT NULL AND b.x{e - 1} IS NOT NULL
 AND a.y{s} IS NOT NULL AND b.y{s} IS NOT NULL QUALIFY k <= {e + 1}""" for e, s in pairs)
    return f"""{EVENT_SERIES}, pts AS (SELECT *, {LAGS}, {LEADS} FROM series
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
near AS ({near}),
weighted AS (SELECT *, min(d) OVER (PARTITION BY user_id, e, step, t) AS d0 FROM near),
forecast AS (SELECT user_id, e, step, t, any_value(actual) AS actual,
 sum(CASE WHEN d0 > 0 THEN exp(-d / d0) ELSE (d = 0)::INT END * y) / sum(CASE WHEN d0 > 0 THEN exp(-d / d0)
 ELSE (d = 0)::INT END) AS predicted FROM weighted GROUP BY 1, 2, 3, 4),
skills AS (SELECT user_id, e, step, count(*) AS n_forecasts, covar_samp(predicted, actual)
 / nullif(stddev_samp(predicted) * stddev_samp(actual), 0) AS rho FROM forecast GROUP BY 1, 2, 3)"""


def skills(spark, sf_dir, pairs):
    seq = event_series(spark, sf_dir)
    points = M.delay_points(seq.rows.drop("t"), UNIT, ORDER, "value", max(DIMS), 10, longest=seq.longest)
    return M.forecasts(points, UNIT, max(DIMS), 10, pairs, longest=seq.longest, scored=True)


@query(
    "forecast_skill_by_dimension",
    f"""WITH {skill_sql([(e, 1) for e in DIMS])} SELECT user_id, e AS E, n_forecasts, round(rho, 6) + 0.0 AS rho FROM skills""",
)
def forecast_skill_by_dimension(spark, sf_dir):
    return rounded(skills(spark, sf_dir, [(e, 1) for e in DIMS]).drop("step"), "rho")


@query(
    "best_dimension",
    f"""WITH {skill_sql([(e, 1) for e in DIMS])} SELECT user_id, arg_max(e, abs(rho)) AS E FROM skills GROUP BY 1""",
)
def best_dimension(spark, sf_dir):
    return M.best_dimension(skills(spark, sf_dir, [(e, 1) for e in DIMS]), UNIT)


@query(
    "skill_decay_over_steps",
    f"""WITH {skill_sql([(3, s) for s in range(1, 11)])}, fit AS (SELECT user_id, regr_slope(rho, step) AS slope,
 corr(rho, step) AS r FROM skills GROUP BY 1)
SELECT user_id, round(slope, 6) + 0.0 AS rho_slope, round(greatest(0, 1 - abs(r * (1 + (1 - r*r) / 2 + 3 * (1 - r*r)^2 / 8
 + 5 * (1 - r*r)^3 / 16))), 6) + 0.0 AS rho_p FROM fit""",
)
def skill_decay_over_steps(spark, sf_dir):
    found = skills(spark, sf_dir, [(3, s) for s in range(1, 11)])
    return rounded(M.slope_test(found, UNIT), "rho_slope", "rho_p")


SIZES, ITERATIONS = [10, 20, 40], 10
#: What every draw of a library starts from; the same text is hashed by ``operators.causality.draw``.
DRAW = "('0x' || md5({key} || '|' || iteration || '|' || place || '|1')[1:8])::BIGINT"


def cross_map_sql(points: str, keys: list[str], max_e: int, name: str) -> str:
    """CTEs from a relation (keys, e, n, t, x0 …, a) of delay points to ``name`` (keys, iteration, l, rho)."""
    k = ", ".join(keys)
    on = " AND ".join(f"q.{c} = b.{c}" for c in keys)
    key = " || '|' || ".join(f"{c}::VARCHAR" for c in keys)
    d = "sqrt((q.x0 - b.x0)^2" + "".join(f" + CASE WHEN q.e > {i} THEN (q.x{i} - b.x{i})^2 ELSE 0 END" for i in range(1, max_e)) + ")"
    near = " UNION ALL ".join(
        f"""SELECT *, {size} AS l FROM {name}_d WHERE place <= {size}
 QUALIFY row_number() OVER (PARTITION BY {k}, iteration, t ORDER BY d, place) <= e + 1""" for size in SIZES)
    return f"""
{name}_units AS (SELECT {k}, any_value(e) AS e, any_value(n) AS n FROM {points} GROUP BY {k}),
{name}_draws AS (SELECT {k}, iteration, place, e + {DRAW.format(key=key)} % (n - e + 1) AS t FROM {name}_units,
 (SELECT unnest(range(1, {ITERATIONS + 1})) AS iteration), (SELECT unnest(range(1, {max(SIZES) + 1})) AS place)),
{name}_lib AS (SELECT p.*, iteration, place FROM {name}_draws JOIN {points} p USING ({k}, t)),
{name}_d AS (SELECT {", ".join("q." + c for c in keys)}, q.e, iteration, place, q.t, q.a AS actual, b.a AS y, {d} AS d
 FROM {points} q JOIN {name}_lib b ON {on} AND q.t <> b.t),
{name}_near AS ({near}),
{name}_near0 AS (SELECT *, min(d) OVER (PARTITION BY {k}, iteration, l, t) AS d0 FROM {name}_near),
{name}_found AS (SELECT {k}, iteration, l, t, any_value(actual) AS actual,
 sum(CASE WHEN d0 > 0 THEN exp(-d / d0) ELSE (d = 0)::INT END * y) / sum(CASE WHEN d0 > 0 THEN exp(-d / d0) ELSE (d = 0)::INT END) AS p
 FROM {name}_near0 GROUP BY {k}, iteration, l, t),
{name} AS (SELECT {k}, iteration, l, covar_samp(p, actual) / nullif(stddev_samp(p) * stddev_samp(actual), 0) AS rho
 FROM {name}_found GROUP BY {k}, iteration, l)"""


def delays(source: str, x: str, by: str, order: str, max_e: int, others: str = "") -> str:
    """Columns of delay points of one relation: t, n, x0 … and others."""
    lags = "".join(f", lag({x}, {i}) OVER w AS x{i}" for i in range(1, max_e))
    return f"""SELECT {by}, row_number() OVER w AS t, count(*) OVER (PARTITION BY {by}) AS n, {x} AS x0{lags}{others}
 FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY {order})"""


@query(
    "cross_map_skill_by_size",
    f"""WITH {EVENT_SERIES}, gaps AS (SELECT * FROM series WHERE gap_hours IS NOT NULL),
points AS (SELECT *, 3 AS e FROM ({delays("gaps", "gap_hours", "user_id", "ts, event_id", 3, ", value AS a")}) WHERE t >= 3),
{cross_map_sql("points", ["user_id"], 3, "rhos")}
SELECT user_id, l AS L, round(avg(rho), 6) + 0.0 AS rho, round(stddev_samp(rho), 6) + 0.0 AS sd_rho FROM rhos GROUP BY 1, 2""",
)
def cross_map_skill_by_size(spark, sf_dir):
    """Mean and sd of cross-map skill by library size; libraries are drawn by a keyed MD5."""
    seq = event_series(spark, sf_dir, "hours")
    series = seq.rows.drop("t").na.drop(subset=["inter_event_dur"])
    dims = series.select("user_id").distinct().withColumn("E", F.lit(3))
    rhos = M.cross_map(series, UNIT, ORDER, "value", "inter_event_dur", dims, 3, SIZES, ITERATIONS,
                       longest=seq.longest)
    return rounded(M.skill_by_size(rhos, UNIT), "rho", "sd_rho")


def summary_sql(max_e: int, alpha: float = 0.3) -> str:
    """Dimension and decay of each series, the gate, and cross mapping of the pair both ways."""
    leads = ", ".join(f"lead(x, {i}) OVER w AS y{i}" for i in range(1, 11))
    d = lambda e: "sqrt((a.x0 - b.x0)^2" + "".join(f" + (a.x{i} - b.x{i})^2" for i in range(1, e)) + ")"
    search = lambda source, e, s: f"""SELECT a.user_id, a.side, {e} AS e, {s} AS step, a.t, a.y{s} AS actual, b.y{s} AS y, {d(e)} AS d
 FROM {source} a JOIN {source} b ON a.user_id = b.user_id AND a.side = b.side AND a.t <> b.t WHERE a.t >= {e} AND b.t >= {e}
 AND a.y{s} IS NOT NULL AND b.y{s} IS NOT NULL{" AND a.dim = " + str(e) if source == "chosen" else ""}
 QUALIFY row_number() OVER (PARTITION BY a.user_id, a.side, a.t ORDER BY {d(e)}, b.t) <= {e + 1}"""  # noqa: E731
    skills = lambda name, near: f"""{name}_near AS ({near}),
{name}_near0 AS (SELECT *, min(d) OVER (PARTITION BY user_id, side, e, step, t) AS d0 FROM {name}_near),
{name}_found AS (SELECT user_id, side, e, step, t, any_value(actual) AS actual, sum(CASE WHEN d0 > 0 THEN exp(-d / d0) ELSE (d = 0)::INT END * y)
 / sum(CASE WHEN d0 > 0 THEN exp(-d / d0) ELSE (d = 0)::INT END) AS predicted FROM {name}_near0 GROUP BY 1, 2, 3, 4, 5),
{name} AS (SELECT user_id, side, e, step, covar_samp(predicted, actual) / nullif(stddev_samp(predicted) * stddev_samp(actual), 0) AS rho
 FROM {name}_found GROUP BY 1, 2, 3, 4)"""  # noqa: E731
    union = lambda parts: " UNION ALL ".join(parts)
    ways = {"ab": ("b", "a"), "ba": ("a", "b")}  # the effect's coordinates and the cause read off them
    points = "".join(
        f""", {w}_points AS (SELECT * FROM (SELECT p.*, s.{cause}_e AS e FROM ({delays("pairs", effect, "user_id", "ts, event_id", max_e, f", {cause} AS a")}) p
 JOIN gated_pairs s USING (user_id)) WHERE t >= e), keyed_{w} AS (SELECT *, 'value' AS k1, 'gap' AS k2 FROM {w}_points),
{cross_map_sql(f"keyed_{w}", ["user_id", "k1", "k2"], max_e, w)},
{w}_p AS (SELECT user_id, avg(CASE WHEN high > low THEN 0.0 ELSE 1.0 END) AS p FROM (SELECT user_id, iteration, arg_min(rho, l) AS low, arg_max(rho, l) AS high
 FROM {w} GROUP BY 1, 2) GROUP BY 1)""" for w, (effect, cause) in ways.items())
    return f"""WITH {EVENT_SERIES}, pairs AS (SELECT user_id, ts, event_id, value AS a, gap_hours AS b FROM series WHERE value IS NOT NULL AND gap_hours IS NOT NULL),
counts AS (SELECT user_id, count(*) AS n_events FROM pairs GROUP BY 1),
sides AS (SELECT user_id, ts, event_id, 'a' AS side, value AS x FROM series WHERE value IS NOT NULL
 UNION ALL SELECT user_id, ts, event_id, 'b', gap_hours FROM series WHERE gap_hours IS NOT NULL),
pts AS (SELECT user_id, side, row_number() OVER w AS t, x AS x0, {", ".join(f"lag(x, {i}) OVER w AS x{i}" for i in range(1, max_e))}, {leads}
 FROM sides WHERE user_id IN (SELECT user_id FROM counts WHERE n_events >= {MIN_EVENTS}) WINDOW w AS (PARTITION BY user_id, side ORDER BY ts, event_id)),
{skills("skills", union(search("pts", e, 1) for e in range(2, max_e + 1)))},
dims AS (SELECT user_id, side, arg_max(e, (abs(rho), -e)) AS dim FROM skills WHERE rho IS NOT NULL GROUP BY 1, 2),
chosen AS (SELECT * FROM pts JOIN dims USING (user_id, side)),
{skills("decay", union(search("chosen", e, s) for e in range(2, max_e + 1) for s in range(1, 11)))},
fit AS (SELECT user_id, side, any_value(e) AS e, regr_slope(rho, step) AS slope, corr(rho, step) AS r, count(rho) AS n FROM decay GROUP BY 1, 2),
tests AS (SELECT user_id, side, e, slope, CASE WHEN n = 10 THEN greatest(0, 1 - abs(r * (1 + (1 - r*r) / 2 + 3 * (1 - r*r)^2 / 8 + 5 * (1 - r*r)^3 / 16))) END AS p FROM fit),
gated_pairs AS (SELECT a.user_id, a.e AS a_e, b.e AS b_e, a.slope AS a_slope, a.p AS a_p, b.slope AS b_slope, b.p AS b_p
 FROM tests a JOIN tests b ON a.user_id = b.user_id AND a.side = 'a' AND b.side = 'b' WHERE a.p <= {alpha} AND b.p <= {alpha}){points}
SELECT 'events' AS system_source, c.user_id AS org_unit, 'value' AS a_var, 'gap' AS b_var, n_events::INT AS n_events, a_e::INT AS a_e_dim, b_e::INT AS b_e_dim,
 round(a_slope, 6) + 0.0 AS a_rho_slope, round(a_p, 6) + 0.0 AS a_rho_p, round(b_slope, 6) + 0.0 AS b_rho_slope, round(b_p, 6) + 0.0 AS b_rho_p,
 round(ab_p.p, 6) + 0.0 AS a_cause_b, round(ba_p.p, 6) + 0.0 AS b_cause_a, ab_p.p IS NOT NULL AND ba_p.p IS NOT NULL AS run_complete
FROM counts c LEFT JOIN (gated_pairs JOIN ab_p USING (user_id) JOIN ba_p USING (user_id)) ON c.user_id = gated_pairs.user_id"""


@query("causality_summary", summary_sql(5))
def causality_summary(spark, sf_dir):
    """Summary rows per unit: inter-event time against value, both ways."""
    series = event_series(spark, sf_dir, "hours").rows.drop("t").withColumnRenamed("inter_event_dur", "gap")
    found = M.causality_table(series, "user_id", ORDER, ["value"], ["gap"], "events", MIN_EVENTS, max_e=5,
                              sizes=SIZES, iterations=ITERATIONS)
    return rounded(found, "a_rho_slope", "a_rho_p", "b_rho_slope", "b_rho_p", "a_cause_b", "b_cause_a")
