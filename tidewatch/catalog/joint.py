"""Signals of two series together. With two series every eigenproblem has a closed form in SQL."""

from pyspark.sql import functions as F

from tidewatch.catalog.book import load, query, rounded
from tidewatch.catalog.signals import BURN_IN, EVENT_SERIES, ORDER, UNIT, event_series
from tidewatch.operators.joint_signals import JOINT_METRICS, joint_signals
from tidewatch.operators.signals import attach_outcomes, join_signals

W = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def information_sql(source: str, series: list[str], name: str = "information") -> str:
    """CTEs ending in ``name`` (user_id, tt, info): at every row all rows so far are ranked and binned anew."""
    p = len(series)
    ranks = ", ".join(f"(row_number() OVER (PARTITION BY user_id, tt ORDER BY {x}, s) - 1) * bins // tt AS b_{x}" for x in series)
    parts = [*[f"b_{x}" for x in series], ", ".join(f"b_{x}" for x in series)]
    sums = " UNION ALL ".join(
        f"SELECT user_id, tt, {1 if i < p else -1} AS sign, sum(n * ln(n)) AS w FROM (SELECT user_id, tt, count(*) AS n FROM {name}_bins GROUP BY user_id, tt, {c}) GROUP BY 1, 2"
        for i, c in enumerate(parts))
    return f"""{name}_pairs AS (SELECT b.user_id, b.tt, greatest(2, floor(cbrt(b.tt) + 1e-9)::BIGINT) AS bins, a.tt AS s, {", ".join("a." + x for x in series)}
  FROM {source} a JOIN {source} b ON a.user_id = b.user_id AND a.tt <= b.tt WHERE b.tt >= {BURN_IN}),
{name}_bins AS (SELECT user_id, tt, {ranks} FROM {name}_pairs),
{name} AS (SELECT user_id, tt, {p - 1} * ln(tt) - sum(sign * w) / tt AS info FROM ({sums}) GROUP BY 1, 2)"""


def det3(rows: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a}*({e}*{i} - {f}*{h}) - {b}*({d}*{i} - {f}*{g}) + {c}*({d}*{h} - {e}*{g}))"


def form3(w: str, m: str) -> str:
    """w' m w for columns w0.. and m00.. ."""
    return "(" + " + ".join(f"{w}{i}*{m}{i}{j}*{w}{j}" for i in range(3) for j in range(3)) + ")"


def null_vector(m: str, out: str) -> str:
    """Columns of the unit vector that the singular matrix m takes to zero: the longest cross product of two rows."""
    cross = [[f"({m}{i}{(k + 1) % 3}*{m}{j}{(k + 2) % 3} - {m}{i}{(k + 2) % 3}*{m}{j}{(k + 1) % 3})" for k in range(3)] for i, j in ((0, 1), (0, 2), (1, 2))]
    size = ["(" + " + ".join(f"{c}*{c}" for c in v) + ")" for v in cross]
    pick = lambda k: f"CASE WHEN {size[0]} >= greatest({size[1]}, {size[2]}) THEN {cross[0][k]} / sqrt({size[0]}) WHEN {size[1]} >= {size[2]} THEN {cross[1][k]} / sqrt({size[1]}) ELSE {cross[2][k]} / sqrt({size[2]}) END"
    return ", ".join(f"{pick(k)} AS {out}{k}" for k in range(3))


def joint3_sql(source: str) -> str:
    """CTEs from ``source`` (user_id, event_id, ts, tt, x, y, z) to ``strong3``: the joint metrics of three series.

    Eigenvalues are the roots of the characteristic cubic by cosines, eigenvectors the cross products of its rows.
    """
    v, r = ["x", "y", "z"], range(3)
    cov = ", ".join(
        f"covar_samp({a}, {b}) OVER w AS {name}{i}{j}" for i in r for j in r
        for name, a, b in (("g", v[i], v[j]), ("p", v[i], "l" + v[j]), ("l", "l" + v[i], "l" + v[j]), ("d", f"{v[i]} - l{v[i]}", f"{v[j]} - l{v[j]}")))
    mat = lambda m: [[f"{m}{i}{j}" for j in r] for i in r]
    mixed = lambda base, other: " + ".join(det3([[f"{other}{i}{j}" if j == k else f"{base}{i}{j}" for j in r] for i in r]) for k in r)
    root = lambda k: f"(2 * sqrt(greatest(-q1 / 3, 0)) * cos((acos(greatest(-1, least(1, 3 * q0 / (2 * q1) * sqrt(-3 / q1)))) - {k} * 2 * pi()) / 3))"
    cubic = lambda a, b, c: f"({b}) / ({a}) AS k2, ({c}) / ({a}) AS k1"
    ar = [f"p{i}{i} / nullif(l{i}{i}, 0)" for i in r]
    return f"""lags3 AS (SELECT *, lag(x) OVER o AS lx, lag(y) OVER o AS ly, lag(z) OVER o AS lz FROM {source} WINDOW o AS (PARTITION BY user_id ORDER BY tt)),
{information_sql(source, v, "information3")},
cov3 AS (SELECT user_id, event_id, ts, tt, {cov} FROM lags3 WINDOW w AS {W}),
late3 AS (SELECT cov3.*, info FROM cov3 JOIN information3 USING (user_id, tt)),
scaled3 AS (SELECT *, {", ".join(f"g{i}{j} / sqrt(g{i}{i} * g{j}{j}) AS r{i}{j}, d{i}{j} / sqrt(g{i}{i} * g{j}{j}) AS e{i}{j}, p{i}{j} / sqrt(g{i}{i} * g{j}{j}) AS u{i}{j}, l{i}{j} / sqrt(g{i}{i} * g{j}{j}) AS m{i}{j}" for i in r for j in r)},
  (g00 + g11 + g22) / 3 AS mid FROM late3),
pca3 AS (SELECT *, mid + 2 * size * cos(acos(greatest(-1, least(1, {det3([[f"(g{i}{j} - {'mid' if i == j else '0'})" for j in r] for i in r])} / (2 * size * size * size)))) / 3) AS top
  FROM (SELECT *, sqrt((power(g00 - mid, 2) + power(g11 - mid, 2) + power(g22 - mid, 2) + 2 * (g01*g01 + g02*g02 + g12*g12)) / 6) AS size FROM scaled3)),
axis3 AS (SELECT *, {null_vector("t", "w")} FROM (SELECT *, {", ".join(f"g{i}{j} - {'top' if i == j else '0'} AS t{i}{j}" for i in r for j in r)} FROM pca3)),
cubic3 AS (SELECT *, {cubic(det3(mat("r")), f"-({mixed('r', 'e')})", mixed('e', 'r'))}, -{det3(mat("e"))} / {det3(mat("r"))} AS k0 FROM axis3),
root3 AS (SELECT *, least({root(0)}, {root(1)}, {root(2)}) - k2 / 3 AS mu
  FROM (SELECT *, k1 - k2*k2/3 AS q1, 2*k2*k2*k2/27 - k2*k1/3 + k0 AS q0 FROM cubic3)),
maf3 AS (SELECT *, {null_vector("n", "f")} FROM (SELECT *, {", ".join(f"e{i}{j} - mu * r{i}{j} AS n{i}{j}" for i in r for j in r)} FROM root3)),
metrics3 AS (SELECT user_id, event_id, ts, tt, ({" + ".join(ar)}) / 3 AS meanAR, greatest({", ".join(ar)}) AS maxAR,
  (sqrt(g00) + sqrt(g11) + sqrt(g22)) / 3 AS meanSD, greatest(sqrt(g00), sqrt(g11), sqrt(g22)) AS maxSD, mu AS eigenMAF,
  {form3("f", "u")} / {form3("f", "m")} AS mafAR, sqrt({form3("f", "r")}) AS mafSD, {form3("w", "p")} / {form3("w", "l")} AS pcaAR,
  sqrt(top) AS pcaSD, top AS eigenCOV, greatest(g01, g02, g12) AS maxCOV, info AS mutINFO FROM maf3),
strong3 AS (SELECT *, {", ".join(f"({m} - avg({m}) OVER w) / nullif(stddev_samp({m}) OVER w, 0) AS {m}_str" for m in JOINT_METRICS)}
  FROM metrics3 WINDOW w AS {W})"""


JOINT = f"""{EVENT_SERIES},
xy AS (SELECT *, value AS x, gap_hours AS y, row_number() OVER o AS tt, lag(value) OVER o AS lx,
  lag(gap_hours) OVER o AS ly FROM series WHERE gap_hours IS NOT NULL
  WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
{information_sql("xy", ["x", "y"])},
cov AS (SELECT *, var_samp(x) OVER w AS a, covar_samp(x, y) OVER w AS b, var_samp(y) OVER w AS c,
  covar_samp(x, lx) OVER w AS p11, covar_samp(x, ly) OVER w AS p12, covar_samp(y, lx) OVER w AS p21,
  covar_samp(y, ly) OVER w AS p22, covar_samp(lx, lx) OVER w AS l11, covar_samp(lx, ly) OVER w AS l12,
  covar_samp(ly, ly) OVER w AS l22, covar_samp(x - lx, x - lx) OVER w AS d11,
  covar_samp(x - lx, y - ly) OVER w AS d12, covar_samp(y - ly, y - ly) OVER w AS d22
  FROM xy WINDOW w AS {W}),
lead_ AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS top,
  (d11*c + d22*a - 2*d12*b) AS q1, a*c - b*b AS q2, d11*d22 - d12*d12 AS q0 FROM cov JOIN information USING (user_id, tt) WHERE tt >= {BURN_IN}),
root AS (SELECT *, (q1 - sqrt(q1*q1 - 4*q2*q0)) / (2*q2) AS mu, b AS w1, top - a AS w2 FROM lead_),
maf AS (SELECT *, (mu*b - d12) * sqrt(a) AS u1, (d11 - mu*a) * sqrt(c) AS u2 FROM root),
unit AS (SELECT *, u1 / sqrt(u1*u1 + u2*u2) / sqrt(a) AS v1, u2 / sqrt(u1*u1 + u2*u2) / sqrt(c) AS v2 FROM maf),
metrics AS (SELECT user_id, event_id, ts, tt, (p11/l11 + p22/l22) / 2 AS meanAR, greatest(p11/l11, p22/l22) AS maxAR,
  (sqrt(a) + sqrt(c)) / 2 AS meanSD, greatest(sqrt(a), sqrt(c)) AS maxSD, mu AS eigenMAF,
  (v1*v1*p11 + v1*v2*(p12 + p21) + v2*v2*p22) / (v1*v1*l11 + 2*v1*v2*l12 + v2*v2*l22) AS mafAR,
  sqrt(v1*v1*a + 2*v1*v2*b + v2*v2*c) AS mafSD,
  (w1*w1*p11 + w1*w2*(p12 + p21) + w2*w2*p22) / (w1*w1*l11 + 2*w1*w2*l12 + w2*w2*l22) AS pcaAR,
  sqrt(top) AS pcaSD, top AS eigenCOV, b AS maxCOV, info AS mutINFO FROM unit),
strong AS (SELECT *, """ + ", ".join(
    f"({m} - avg({m}) OVER w) / nullif(stddev_samp({m}) OVER w, 0) AS {m}_str" for m in JOINT_METRICS
) + f" FROM metrics WINDOW w AS {W})"
MULTI = " + ".join(f"CASE WHEN {m}_str > 2 THEN 1 ELSE 0 END" for m in JOINT_METRICS)


def joint(spark, sf_dir):
    seq = event_series(spark, sf_dir, "hours")
    series = seq.rows.withColumnRenamed("inter_event_dur", "gap").drop("t")
    return series, joint_signals(series, UNIT, ORDER, ["value", "gap"], burn_in=BURN_IN, longest=seq.longest)


@query(
    "joint_signal_metrics",
    f"WITH {JOINT} SELECT event_id, tt AS t, " + ", ".join(
        f"round({m}, 5) + 0.0 AS {m}" for m in JOINT_METRICS
    ) + f" FROM strong WHERE tt > {BURN_IN}",
)
def joint_signal_metrics(spark, sf_dir):
    """The twelve expanding metrics of value and inter-event time."""
    return rounded(joint(spark, sf_dir)[1].select("event_id", "t", *JOINT_METRICS), *JOINT_METRICS, digits=5)


@query(
    "joint_signal_strengths",
    f"WITH {JOINT} SELECT event_id, CAST({MULTI} AS BIGINT) AS multi_crossed, " + ", ".join(
        f"round({m}_str, 4) + 0.0 AS {m}_str" for m in JOINT_METRICS
    ) + f" FROM strong WHERE tt > {BURN_IN}",
)
def joint_signal_strengths(spark, sf_dir):
    signals = joint(spark, sf_dir)[1].withColumn("multi_crossed", F.col("multi_crossed").cast("bigint"))
    names = [f"{m}_str" for m in JOINT_METRICS]
    return rounded(signals.select("event_id", "multi_crossed", *names), *names, digits=4)


@query(
    "signals_with_outcomes",
    f"""WITH {JOINT}, multi AS (SELECT event_id, {MULTI} AS n FROM strong WHERE tt > {BURN_IN})
SELECT s.event_id, s.user_id, n AS multi_crossed, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS outcome
FROM series s LEFT JOIN multi USING (event_id)""",
)
def signals_with_outcomes(spark, sf_dir):
    """Joint signals of all events, next to the outcome of each event."""
    series, signals = joint(spark, sf_dir)
    both = join_signals(series.select("event_id", "user_id"), signals.select("event_id", "multi_crossed"), "event_id")
    outcome = F.when(F.col("event_type") == "error", 1).otherwise(0).alias("outcome")
    return attach_outcomes(both, load(spark, sf_dir, "events").select("event_id", outcome), "user_id", "event_id")
