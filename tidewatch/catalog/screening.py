"""Feature screening, correlation, factors and regression on line items and orders."""

from pyspark.sql import functions as F

from tidewatch.catalog.book import ORACLE, load, query, r6, rounded
from tidewatch.catalog.linear_sql import cholesky_distance_sql, components_sql, correlation_sql, eigen_sql, least_squares_sql
from tidewatch.catalog.signals import EVENT_SERIES, ORDER, UNIT, event_series
from tidewatch.functions.columns import to_long
from tidewatch.operators import factors as FA
from tidewatch.operators import regression as R
from tidewatch.operators import screening as S
from tidewatch.operators.groups import groups_of_size

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "price_each"]


def features(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    return lines.withColumn("price_each", F.col("l_extendedprice") / F.col("l_quantity"))


LINES = "(SELECT *, l_extendedprice / l_quantity AS price_each FROM lineitem)"
SCREENED = ["l_linenumber", "rare", "fixed", "l_discount"]
SCREEN_SQL = """(SELECT l_linenumber, CASE WHEN l_orderkey % 200 = 0 THEN 1 ELSE 0 END AS rare, 7 AS fixed,
 l_discount FROM lineitem)"""


def screened(spark, sf_dir):
    rare = F.when(F.col("l_orderkey") % 200 == 0, 1).otherwise(0)
    return load(spark, sf_dir, "lineitem").select(
        "l_linenumber", rare.alias("rare"), F.lit(7).alias("fixed"), "l_discount")


@query(
    "near_zero_variance",
    "WITH " + ", ".join(
        f"c{i} AS (SELECT {c}, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC) AS r FROM {SCREEN_SQL} GROUP BY 1), "
        f"v{i} AS (SELECT '{c}' AS variable, coalesce(max(n) FILTER (r = 1) / max(n) FILTER (r = 2), 0) AS q, "
        f"100.0 * count(*) / sum(n) AS u, count(*) = 1 AS z FROM c{i})" for i, c in enumerate(SCREENED)
    ) + ", v AS (" + " UNION ALL ".join(f"SELECT * FROM v{i}" for i in range(4)) + """)
SELECT variable, round(q, 6) AS freq_ratio, round(CAST(u AS DOUBLE), 6) AS percent_unique, z AS zero_var,
 z OR (q > 19 AND u <= 10) AS nzv FROM v""",
)
def near_zero_variance(spark, sf_dir):
    return rounded(S.near_zero_variance(screened(spark, sf_dir), SCREENED), "freq_ratio", "percent_unique")


@query(
    "column_spread",
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, round(stddev_samp({c}), 6) + 0.0 AS sd, round(median(CAST({c} AS DOUBLE)), 6) + 0.0 "
        f"AS median, round(mad(CAST({c} AS DOUBLE)) * 1.4826, 6) + 0.0 AS mad FROM {SCREEN_SQL}" for c in SCREENED),
)
def column_spread(spark, sf_dir):
    return rounded(S.column_spread(screened(spark, sf_dir), SCREENED), "sd", "median", "mad")


@query(
    "varying_columns",
    f"""SELECT variable FROM ({ORACLE['near_zero_variance']}) JOIN ({ORACLE['column_spread']}) USING (variable)
WHERE NOT nzv AND sd > 0 AND mad > 0""",
)
def varying_columns(spark, sf_dir):
    df = screened(spark, sf_dir)
    return spark.createDataFrame([(c,) for c in S.varying_columns(df, SCREENED)], "variable string")


@query(
    "robust_standardised",
    "WITH m AS (SELECT " + ", ".join(f"median({c}) AS m_{c}, mad({c}) * 1.4826 AS d_{c}" for c in FEATURES)
    + f" FROM {LINES}) SELECT l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(f"round(({c} - m_{c}) / d_{c}, 6) + 0.0 AS {c}" for c in FEATURES) + f" FROM {LINES}, m",
)
def robust_standardised(spark, sf_dir):
    df = features(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", *FEATURES)
    return rounded(S.robust_standardise(df, FEATURES), *FEATURES)


PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]


@query(
    "correlations_pairwise",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM "
                       "(SELECT * REPLACE (nullif(l_tax, 0) AS l_tax) FROM " + LINES + ")" for a, b in PAIRS),
)
def correlations_pairwise(spark, sf_dir):
    df = features(spark, sf_dir).withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    return rounded(S.correlations(df, FEATURES), "r")


@query(
    "correlations_complete_rows",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM {LINES} WHERE l_tax <> 0"
                       for a, b in PAIRS),
)
def correlations_complete_rows(spark, sf_dir):
    df = features(spark, sf_dir).withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    return rounded(S.correlations(df, FEATURES, complete_rows=True), "r")


@query(
    "wide_to_long",
    "UNPIVOT (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) ON p_size, p_retailprice "
    "INTO NAME variable VALUE value",
)
def wide_to_long(spark, sf_dir):
    parts = load(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return to_long(parts, ["p_partkey"], ["p_size", "p_retailprice"])


def icc_sql(table: str, group: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, round((msb - msw) / (msb + (k0 - 1) * msw), 6) + 0.0 AS icc FROM (
SELECT sum(n * (m - g) * (m - g)) / (count(*) - 1) AS msb, sum(n * v) / (sum(n) - count(*)) AS msw,
 (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS k0 FROM (SELECT CAST(count(*) AS DOUBLE) AS n, avg({c}) AS m,
 var_pop({c}) AS v FROM {table} GROUP BY {group}), (SELECT avg({c}) AS g FROM {table}))""" for c in columns)


@query("icc_by_supplier", icc_sql(LINES, "l_suppkey", FEATURES))
def icc_by_supplier(spark, sf_dir):
    return rounded(S.icc(features(spark, sf_dir), "l_suppkey", FEATURES), "icc")


@query(
    "icc_of_large_units",
    icc_sql("(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS c FROM events) WHERE c >= 65 "
            "AND year(ts) BETWEEN 1999 AND 2024)", "user_id", ["value"]),
)
def icc_of_large_units(spark, sf_dir):
    events = groups_of_size(load(spark, sf_dir, "events"), ["user_id"], 65)
    return rounded(S.icc(events.filter(F.year("ts").between(1999, 2024)), "user_id", ["value"]), "icc")


@query(
    "mahalanobis_distance",
    f"""WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_discount) AS my, var_samp(l_quantity) AS a,
 covar_samp(l_quantity, l_discount) AS b, var_samp(l_discount) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round((c * dx * dx - 2 * b * dx * dy + a * dy * dy) / (a * c - b * b), 6) + 0.0
 AS mahad FROM (SELECT *, l_quantity - mx AS dx, l_discount - my AS dy FROM lineitem, s)""",
)
def mahalanobis_distance(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    d = S.mahalanobis(rows, ["l_quantity", "l_discount"])
    return rounded(d.select("l_orderkey", "l_linenumber", "l_partkey", "mahad"), "mahad")


TWO = ["l_quantity", "l_extendedprice"]


@query(
    "bartlett_sphericity",
    """SELECT round(-(n - 1 - 9 / 6.0) * ln(1 - r * r), 4) AS chi_square, 1::BIGINT AS df, n FROM
(SELECT CAST(count(*) AS BIGINT) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem)""",
)
def bartlett_sphericity(spark, sf_dir):
    b = FA.bartlett(features(spark, sf_dir), TWO)
    return rounded(spark.createDataFrame([(b.chi_square, b.df, b.n)], "chi_square double, df long, n long"),
                   "chi_square", digits=4)


THREE = ["l_quantity", "l_extendedprice", "price_each"]


@query(
    "kmo_adequacy",
    f"""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r12, corr(l_quantity, price_each) AS r13,
 corr(l_extendedprice, price_each) AS r23 FROM {LINES}),
q AS (SELECT *, (r12 - r13*r23) / sqrt((1 - r13*r13) * (1 - r23*r23)) AS q12,
 (r13 - r12*r23) / sqrt((1 - r12*r12) * (1 - r23*r23)) AS q13,
 (r23 - r12*r13) / sqrt((1 - r12*r12) * (1 - r13*r13)) AS q23 FROM c)
SELECT 'l_quantity' AS variable, round((r12^2 + r13^2) / (r12^2 + r13^2 + q12^2 + q13^2), 6) AS kmo FROM q
UNION ALL SELECT 'l_extendedprice', round((r12^2 + r23^2) / (r12^2 + r23^2 + q12^2 + q23^2), 6) FROM q
UNION ALL SELECT 'price_each', round((r13^2 + r23^2) / (r13^2 + r23^2 + q13^2 + q23^2), 6) FROM q
UNION ALL SELECT 'overall', round((r12^2 + r13^2 + r23^2) / (r12^2 + r13^2 + r23^2 + q12^2 + q13^2 + q23^2), 6) FROM q""",
)
def kmo_adequacy(spark, sf_dir):
    overall, each = FA.kmo(features(spark, sf_dir), THREE)
    return rounded(spark.createDataFrame([*each.items(), ("overall", overall)], "variable string, kmo double"), "kmo")


P, KEYS = len(FEATURES), ["l_orderkey", "l_linenumber", "l_partkey"]
EIGEN = f"{correlation_sql(LINES, FEATURES, 'r')}, {eigen_sql('r', P, 'eigen')}"
NOISE_DRAWS = """draws AS (SELECT run, r, c, sqrt(-2 * ln((('0x' || h[1:8])::BIGINT + 0.5) / 4294967296)) * cos(2 * pi() * (('0x' || h[9:16])::BIGINT + 0.5) / 4294967296) AS z
 FROM (SELECT run, r, c, md5('1|' || run || '|' || r || '|' || c) AS h FROM (SELECT unnest(range({runs})) AS run), (SELECT unnest(range({p})) AS r), (SELECT unnest(range({p})) AS c)) WHERE c <= r),
lower AS (SELECT run, r, c, CASE WHEN c < r THEN z ELSE sqrt(f * greatest(1 - 2 / (9 * f) + z * sqrt(2 / (9 * f)), 0) ^ 3) END AS a FROM (SELECT d.*, n - 1.0 - r AS f FROM draws d, r)),
cross_ AS (SELECT x.run, x.r, y.r AS c, sum(x.a * y.a) AS s FROM lower x JOIN lower y ON x.run = y.run AND x.c = y.c GROUP BY 1, 2, 3),
noise AS (SELECT run, list(s / sqrt(a.d * b.d) ORDER BY r, c) AS m FROM cross_ JOIN (SELECT run, r AS r1, s AS d FROM cross_ WHERE r = c) a USING (run) JOIN (SELECT run, r AS r2, s AS d FROM cross_ WHERE r = c) b USING (run)
 WHERE r = r1 AND c = r2 GROUP BY run)"""


@query(
    "factor_count",
    f"""WITH RECURSIVE {EIGEN}, {NOISE_DRAWS.format(runs=100, p=P)}, {eigen_sql('noise', P, 'random', ('run',))},
limits AS (SELECT k, avg(value) AS mean, quantile_cont(value, 0.95) AS p95 FROM random GROUP BY k)
SELECT k::INT AS component, round(value, 6) AS eigenvalue, round(value / {P}, 6) AS share, round(mean, 6) AS noise_mean, round(p95, 6) AS noise_p95,
 value > 1 AS kaiser, value > mean AS parallel FROM eigen JOIN limits USING (k)""",
)
def factor_count(spark, sf_dir):
    """Scree table and parallel analysis of the line item features."""
    return rounded(FA.factor_count(features(spark, sf_dir), FEATURES), "eigenvalue", "share", "noise_mean", "noise_p95")


@query(
    "bartlett_all_features",
    f"""WITH RECURSIVE {EIGEN} SELECT round(-(any_value(n) - 1 - {2 * P + 5} / 6.0) * sum(ln(value)), 3) AS chi_square, {P * (P - 1) // 2}::BIGINT AS df,
 any_value(n) AS n FROM eigen, r""",
)
def bartlett_all_features(spark, sf_dir):
    b = FA.bartlett(features(spark, sf_dir), FEATURES)
    return rounded(spark.createDataFrame([(b.chi_square, b.df, b.n)], "chi_square double, df long, n long"), "chi_square", digits=3)


@query(
    "kmo_all_features",
    f"""WITH RECURSIVE {EIGEN}, inverse AS (SELECT i, j, sum(vec[i + 1] * vec[j + 1] / value) AS q FROM eigen, (SELECT unnest(range({P})) AS i), (SELECT unnest(range({P})) AS j) GROUP BY 1, 2),
cells AS (SELECT x.i, x.j, r.m[x.i * {P} + x.j + 1] ^ 2 AS r2, x.q ^ 2 / (a.q * b.q) AS q2 FROM inverse x JOIN inverse a ON a.i = x.i AND a.j = x.i
 JOIN inverse b ON b.i = x.j AND b.j = x.j, r WHERE x.i <> x.j)
SELECT {FEATURES}[i + 1] AS variable, round(sum(r2) / (sum(r2) + sum(q2)), 6) AS kmo FROM cells GROUP BY i UNION ALL
SELECT 'overall', round(sum(r2) / (sum(r2) + sum(q2)), 6) FROM cells""",
)
def kmo_all_features(spark, sf_dir):
    overall, each = FA.kmo(features(spark, sf_dir), FEATURES)
    return rounded(spark.createDataFrame([*each.items(), ("overall", overall)], "variable string, kmo double"), "kmo")


@query(
    "mahalanobis_all_features",
    f"""WITH {cholesky_distance_sql(LINES, FEATURES, ", ".join(KEYS), "distances")} SELECT {", ".join(KEYS)}, round(mahad, 5) + 0.0 AS mahad FROM distances""",
)
def mahalanobis_all_features(spark, sf_dir):
    rows = features(spark, sf_dir).select(*KEYS, *FEATURES)
    return rounded(S.mahalanobis(rows, FEATURES).select(*KEYS, "mahad"), "mahad", digits=5)


@query(
    "component_scores_all_features",
    f"""WITH RECURSIVE {EIGEN}, {components_sql('eigen', P, 3, 'rotated')},
stats AS (SELECT [{", ".join(f"avg({c})" for c in FEATURES)}] AS mean, [{", ".join(f"stddev_samp({c})" for c in FEATURES)}] AS sd FROM {LINES}),
z AS (SELECT {", ".join(KEYS)}, list_transform(range({P}), lambda i: ([{", ".join(f"{c}::DOUBLE" for c in FEATURES)}][i + 1] - mean[i + 1]) / sd[i + 1]) AS z FROM {LINES}, stats),
w AS (SELECT {", ".join(f"any_value(weight) FILTER (f = {f}) AS w{f}" for f in (1, 2, 3))} FROM rotated)
SELECT {", ".join(KEYS)}, {", ".join(f"round(list_dot_product(z, w{f}), 5) + 0.0 AS RC{f}" for f in (1, 2, 3))} FROM z, w""",
)
def component_scores_all_features(spark, sf_dir):
    """Scores of every row on three rotated components of all features."""
    rows = features(spark, sf_dir)
    c = FA.principal_components(rows, FEATURES, 3)
    return rounded(FA.factor_scores(rows, c, KEYS), "RC1", "RC2", "RC3", digits=5)


@query(
    "principal_component_scores",
    """WITH s AS (SELECT avg(l_quantity) AS mx, stddev_samp(l_quantity) AS sx, avg(l_extendedprice) AS my,
 stddev_samp(l_extendedprice) AS sy, corr(l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(((l_quantity - mx) / sx + sign(r) * (l_extendedprice - my) / sy)
 / sqrt(2 * (1 + abs(r))), 6) + 0.0 AS RC1 FROM lineitem, s""",
)
def principal_component_scores(spark, sf_dir):
    rows = features(spark, sf_dir)
    c = FA.principal_components(rows, TWO, 1)
    return rounded(FA.factor_scores(rows, c, ["l_orderkey", "l_linenumber", "l_partkey"]), "RC1")


@query(
    "rotated_loadings",
    f"""WITH RECURSIVE {EIGEN}, {components_sql('eigen', P, 3, 'rotated')}
SELECT {FEATURES}[i] AS variable, 'RC' || f AS factor, round(loading[i], 6) + 0.0 AS loading FROM (SELECT *, generate_subscripts(loading, 1) AS i FROM rotated)""",
)
def rotated_loadings(spark, sf_dir):
    """Rotated loadings of the robustly standardised features, whose correlations are those of the features."""
    c = FA.principal_components(S.robust_standardise(features(spark, sf_dir), FEATURES), FEATURES, 3)
    return rounded(FA.loadings_table(spark, c), "loading")


@query(
    "scores_on_source_rows",
    """WITH s AS (SELECT avg(p_size) AS mx, stddev_samp(p_size) AS sx, avg(p_retailprice) AS my,
 stddev_samp(p_retailprice) AS sy, corr(p_size, p_retailprice) AS r FROM part)
SELECT p_partkey, p_brand, CASE WHEN p_size <> 10 THEN round(((p_size - mx) / sx + sign(r) * (p_retailprice - my) / sy)
 / sqrt(2 * (1 + abs(r))), 6) + 0.0 END AS RC1 FROM part, (SELECT avg(p_size) AS mx, stddev_samp(p_size) AS sx,
 avg(p_retailprice) AS my, stddev_samp(p_retailprice) AS sy, corr(p_size, p_retailprice) AS r FROM part
 WHERE p_size <> 10) s""",
)
def scores_on_source_rows(spark, sf_dir):
    """Rows without a score keep their place."""
    parts = load(spark, sf_dir, "part").withColumn("size", F.nullif(F.col("p_size").cast("double"), F.lit(10.0)))
    c = FA.principal_components(parts, ["size", "p_retailprice"], 1)
    scores = FA.factor_scores(parts, c, ["p_partkey"])
    return rounded(FA.attach_scores(parts.select("p_partkey", "p_brand"), scores, "p_partkey"), "RC1")


@query(
    "linear_model",
    """WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS n, regr_slope(l_extendedprice, l_quantity) AS b,
 regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx,
 regr_syy(l_extendedprice, l_quantity) AS syy, avg(l_quantity) AS mx FROM lineitem),
e AS (SELECT *, sqrt((syy - b * b * sxx) / (n - 2)) AS s FROM s),
terms AS (SELECT 'l_quantity' AS term, n - 2 AS f, b AS estimate, s / sqrt(sxx) AS std_error FROM e
 UNION ALL SELECT '(Intercept)', n - 2, a, s * sqrt(1 / n + mx * mx / sxx) FROM e),
tails AS (SELECT term, 1 - 2 * any_value(width) / 3 * any_value(top) * sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
  * (1 + (k * width) ^ 2 / f) ^ (-(f + 1) / 2)) AS p FROM (SELECT term, f, least(abs(estimate / std_error), 40) / 4000 AS width,
  exp(lgamma((f + 1) / 2) - lgamma(f / 2)) / sqrt(f * pi()) AS top FROM terms), (SELECT unnest(range(4001)) AS k) GROUP BY term)
SELECT term, round(estimate, 4) + 0.0 AS estimate, round(std_error, 4) AS std_error, round(estimate / std_error, 3) + 0.0 AS t,
 greatest(round(p, 6), 0) + 0.0 AS p FROM terms JOIN tails USING (term)""",
)
def linear_model(spark, sf_dir):
    fit = R.linear_model(load(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return rounded(rounded(rounded(fit, "estimate", "std_error", digits=4), "t", digits=3), "p")


@query(
    "lagged_regression_by_unit",
    f"""WITH {EVENT_SERIES}, l AS (SELECT user_id, value AS y, lag(value) OVER w AS x FROM series
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, round(regr_slope(y, x), 6) + 0.0 AS slope, round(regr_intercept(y, x), 6) + 0.0 AS intercept,
 regr_count(y, x)::BIGINT AS n FROM l GROUP BY 1""",
)
def lagged_regression_by_unit(spark, sf_dir):
    series = event_series(spark, sf_dir).rows.drop("t")
    rows, terms = R.lagged_design(series, UNIT, ORDER, "value", [], outcome_lags=1)
    fit = R.least_squares_by_unit(rows, UNIT, "y", terms)
    pick = lambda t: F.max(F.when(F.col("term") == t, F.col("estimate")))
    return fit.groupBy("user_id").agg(
        r6(pick("value_lag1")).alias("slope"), r6(pick("(Intercept)")).alias("intercept"), F.max("n").alias("n"))


SIGNAL_TERMS = ["outcome_lag1", "outcome_lag2", "x_inter_event_dur_lag1", "x_inter_event_dur", "x_inter_event_dur_lead1"]


@query(
    "outcome_on_signals",
    f"""WITH RECURSIVE {EVENT_SERIES}, marked AS (SELECT *, (event_type = 'error')::INT::DOUBLE AS outcome FROM series),
design AS (SELECT user_id, outcome AS y, lag(outcome) OVER w AS outcome_lag1, lag(outcome, 2) OVER w AS outcome_lag2, lag(gap_hours) OVER w AS x_inter_event_dur_lag1,
 gap_hours AS x_inter_event_dur, lead(gap_hours) OVER w AS x_inter_event_dur_lead1 FROM marked WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
whole AS (SELECT * FROM design WHERE {" AND ".join(f"{t} IS NOT NULL" for t in ["y", *SIGNAL_TERMS])}),
{least_squares_sql("whole", "user_id", "y", SIGNAL_TERMS, "fits")}
SELECT user_id, term, n, round(estimate, 6) + 0.0 AS estimate, round(std_error, 6) + 0.0 AS std_error, round(t, 4) + 0.0 AS t FROM fits""",
)
def outcome_on_signals(spark, sf_dir):
    """The outcome of each event on its own past and on the signal before, at and after the event."""
    series = event_series(spark, sf_dir, "hours").rows.drop("t")
    series = series.withColumn("outcome", (F.col("event_type") == "error").cast("double"))
    rows, terms = R.lagged_design(series, UNIT, ORDER, "outcome", ["inter_event_dur"], outcome_lags=2)
    fit = R.least_squares_by_unit(rows, UNIT, "y", terms)
    return rounded(rounded(fit, "estimate", "std_error"), "t", digits=4)
