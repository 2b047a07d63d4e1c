"""Similarity, screening, factors, regression and causality against numpy and known answers."""

import datetime as dt

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.operators import array_sums as AS
from tidewatch.operators import causality as M
from tidewatch.operators import factors as FA
from tidewatch.operators import regression as R
from tidewatch.operators import screening as S
from tidewatch.operators import similarity as V
from tidewatch.operators.ordering import in_order
from tidewatch.plans.climate import climate_vectors
from tidewatch.functions.score_names import EMOTION_VOCABULARY, LIWC
from tidewatch.plans.coding import Scores, code_events, combine_phmsa_narratives, emotion_scores, liwc_scores
from tidewatch.plans.measures import day_metrics, monthly_counts_with_signals, unit_series, unit_signals

# -- similarity --------------------------------------------------------------------------------------


def cos(a, b):
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    rows = [("u", i, rng.normal(size=4).tolist()) for i in range(30)]
    rows[7] = ("u", 7, None)
    rows[11] = ("u", 11, [0.0] * 4)
    return rows + [("v", 100 + i, rng.normal(size=4).tolist()) for i in range(5)] + [("w", 200, [1.0, 0.0, 0.0, 0.0])]


@pytest.mark.parametrize("block_rows", [10**6, 9])
def test_similarity_to_recent(spark, vectors, block_rows):
    df = spark.createDataFrame(vectors, "unit string, eid long, vec array<double>")
    got = V.unit_similarity(df, "unit", "eid", "vec", [1, 3, 5], 1, block_rows=block_rows)
    got = {r["eid"]: r for r in got.collect()}
    for unit in "uvw":
        part = [r for r in vectors if r[0] == unit]
        for i, (_, eid, vec) in enumerate(part):
            for k in (1, 3, 5):
                value = got[eid][f"cos_sim_rw_vec_{k}"]
                seen = [np.array(p[2]) for p in part[max(i - k, 0) : i] if p[2] is not None]
                valid = i >= k and vec is not None and seen and (k == 1 or 2 * k < len(part))
                if valid and np.linalg.norm(vec) > 0 and np.linalg.norm(np.mean(seen, 0)) > 0:
                    assert value == pytest.approx(cos(np.array(vec), np.mean(seen, 0)), abs=1e-12)
                else:
                    assert value is None


def test_mixed_lengths(spark):
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>")
    with pytest.raises(ValueError):
        V.vector_length(df, "v")


def test_pairwise_is_the_sum_over_pairs(spark, vectors):
    df = spark.createDataFrame(vectors, "unit string, eid long, vec array<double>")
    got = {r["unit"]: r for r in V.pairwise_similarity(df, ["unit"], "vec", 4).collect()}
    for unit in "uv":
        m = np.array([r[2] for r in vectors if r[0] == unit and r[2] is not None])
        size = np.linalg.norm(m, axis=1, keepdims=True)
        u = m / np.where(size > 0, size, 1)
        sim = (u @ u.T)[~np.eye(len(u), dtype=bool)]
        assert got[unit]["mean_sim"] == pytest.approx(sim.mean(), abs=1e-12)
        assert got[unit]["std_sim"] == pytest.approx(sim.std(), abs=1e-12)
    assert got["w"]["mean_sim"] is None and got["w"]["std_sim"] is None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-100, 100).filter(lambda x: abs(x) > 1e-3), min_size=3, max_size=3), st.floats(0.1, 50))
def test_cosine_ignores_scale(spark, v, scale):
    from tidewatch.functions.vectors import cosine

    df = spark.createDataFrame([(v, [x * scale for x in v], [-x for x in v])], "a array<double>, b array<double>, c array<double>")
    r = df.select(cosine("a", "b").alias("b"), cosine("a", "c").alias("c")).first()
    assert r["b"] == pytest.approx(1.0) and r["c"] == pytest.approx(-1.0)


# -- screening, factors, regression -------------------------------------------------------------------


@pytest.fixture(scope="module")
def features():
    rng = np.random.default_rng(2)
    n = 400
    f = rng.normal(size=(n, 2))
    x = np.column_stack([
        f[:, 0] + 0.3 * rng.normal(size=n), f[:, 0] + 0.4 * rng.normal(size=n), f[:, 0] + 0.5 * rng.normal(size=n),
        f[:, 1] + 0.3 * rng.normal(size=n), f[:, 1] + 0.4 * rng.normal(size=n), f[:, 1] + 0.5 * rng.normal(size=n)])
    return x * [1, 2, 3, 4, 5, 6] + [0, 0, 10, 0, 100, 0]


COLS = [f"v{i}" for i in range(6)]


@pytest.fixture(scope="module")
def frame(spark, features):
    rows = [(i, "g" + str(i % 7), *map(float, r), 1.0, 1.0 if i < 390 else float(i), 0.0 if i % 3 else float(i))
            for i, r in enumerate(features)]
    return spark.createDataFrame(rows, "id int, g string, " + ", ".join(f"{c} double" for c in COLS) + ", fixed double, nearly double, half double").cache()


def test_varying_columns(frame):
    names = [*COLS, "fixed", "nearly", "half"]
    assert S.varying_columns(frame, names) == COLS
    assert S.varying_columns(frame, names, screen_frequency=False) == COLS
    nzv = {r["variable"]: r for r in S.near_zero_variance(frame, names).collect()}
    assert nzv["fixed"]["zero_var"] and nzv["fixed"]["nzv"] and nzv["nearly"]["nzv"] and not nzv["half"]["nzv"]
    assert nzv["nearly"]["freq_ratio"] == 390.0


def test_factorability(frame, features):
    n, p = features.shape
    r = np.corrcoef(features.T)
    b = FA.bartlett(frame, COLS)
    assert b.n == n and b.df == 15
    assert b.chi_square == pytest.approx(-(n - 1 - 17 / 6) * np.log(np.linalg.det(r)))
    assert FA.chi_square_upper(b.chi_square, b.df) < 1e-6
    assert FA.chi_square_upper(14.34, 15) == pytest.approx(0.5, abs=0.005)
    overall, each = FA.kmo(frame, COLS)
    assert 0.6 < overall < 0.9 and set(each) == set(COLS)
    with pytest.raises(ValueError):
        FA.bartlett(frame, [*COLS, "fixed"])
    count = {r["component"]: r for r in FA.factor_count(frame, COLS, 40).collect()}
    assert sum(r["kaiser"] for r in count.values()) == sum(r["parallel"] for r in count.values()) == 2
    assert sum(r["share"] for r in count.values()) == pytest.approx(1.0)


def test_noise_eigenvalues_are_those_of_noise(spark):
    got = {r["component"]: r["noise_mean"] for r in FA.noise_eigenvalues(spark, 50, 4, 300).collect()}
    rng = np.random.default_rng(1)
    draws = [np.linalg.eigvalsh(np.corrcoef(rng.normal(size=(50, 4)).T))[::-1] for _ in range(2000)]
    assert [got[i] for i in range(1, 5)] == pytest.approx(np.mean(draws, 0).tolist(), abs=0.03)


def varimax_value(loadings):
    h = np.sqrt((loadings**2).sum(1, keepdims=True))
    q = (loadings / h) ** 2
    return ((q**2).mean(0) - q.mean(0) ** 2).sum()


def test_components(frame, features):
    c = FA.principal_components(frame, COLS, 2)
    z = (features - features.mean(0)) / features.std(0, ddof=1)
    plain = FA.principal_components(frame, COLS, 2, rotate=False)
    # rotation keeps what is explained, and no other angle does better
    assert (c.loadings @ c.loadings.T) == pytest.approx(plain.loadings @ plain.loadings.T)
    best = max(varimax_value(plain.loadings @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]))
               for a in np.linspace(0, np.pi, 721))
    assert varimax_value(c.loadings) >= best - 1e-6
    assert (np.abs(c.loadings[:3, :]).argmax(1) == np.abs(c.loadings[0]).argmax()).all()
    scores = FA.factor_scores(frame, c, ["id"])
    got = np.array([r[1:] for r in sorted(scores.collect())])
    assert got == pytest.approx(z @ c.weights)
    assert np.cov(got.T) == pytest.approx(np.eye(2), abs=1e-8)
    assert FA.attach_scores(frame, scores, "id").count() == 400
    full = FA.principal_components(frame, COLS, 6, rotate=False)
    assert full.loadings @ full.loadings.T == pytest.approx(np.corrcoef(features.T))


def test_distance_and_correlation(frame, features):
    got = {r["id"]: r["mahad"] for r in S.mahalanobis(frame, COLS).collect()}
    off = features - features.mean(0)
    want = np.einsum("ni,ij,nj->n", off, np.linalg.inv(np.cov(features.T)), off)
    assert [got[i] for i in range(400)] == pytest.approx(want.tolist())
    r = {(x["a"], x["b"]): x["r"] for x in S.correlations(frame, ["v0", "v1", "fixed"]).collect()}
    assert r["v0", "v1"] == pytest.approx(np.corrcoef(features[:, 0], features[:, 1])[0, 1])
    assert r["v0", "fixed"] is None


def test_icc(spark):
    same = [(g, float(i)) for g in range(4) for i in range(5)]
    apart = [(g, 10.0 * g + 0.1 * i) for g in range(4) for i in range(5)]
    for rows, check in ((same, lambda v: v <= 0), (apart, lambda v: v > 0.99)):
        df = spark.createDataFrame(rows, "g int, x double")
        assert check(S.icc(df, "g", ["x"]).first()["icc"])


def test_regression(spark, frame, features):
    fit = {r["term"]: r for r in R.linear_model(frame, "v0", ["v1", "v3"]).collect()}
    x = np.column_stack([features[:, 1], features[:, 3], np.ones(400)])
    beta, rss, *_ = np.linalg.lstsq(x, features[:, 0], rcond=None)
    assert [fit[t]["estimate"] for t in ("v1", "v3", "(Intercept)")] == pytest.approx(beta.tolist())
    by_unit = R.least_squares_by_unit(frame.na.drop(), ["g"], "v0", ["v1", "v3"])
    got = {(r["g"], r["term"]): r for r in by_unit.collect()}
    for g in range(7):
        x, y = features[g::7], features[g::7, 0]
        design = np.column_stack([x[:, 1], x[:, 3], np.ones(len(x))])
        beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
        se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / (len(x) - 3))
        rows = [got[f"g{g}", t] for t in ("v1", "v3", "(Intercept)")]
        assert [r["estimate"] for r in rows] == pytest.approx(beta.tolist())
        assert [r["std_error"] for r in rows] == pytest.approx(se.tolist())
    # too few rows for the terms: no estimates, but the unit is listed
    short = R.least_squares_by_unit(frame.limit(2).withColumn("g", F.lit("s")), ["g"], "v0", ["v1", "v3"]).collect()
    assert len(short) == 3 and all(r["estimate"] is None for r in short)


def test_lagged_design(spark):
    df = spark.createDataFrame([("u", i, float(i * i), float(i)) for i in range(6)], "u string, t0 int, y double, s double")
    rows, names = R.lagged_design(df, ["u"], ["t0"], "y", ["s"], outcome_lags=1)
    assert names == ["y_lag1", "x_s_lag1", "x_s", "x_s_lead1"]
    assert sorted(tuple(r)[1:] for r in rows.collect()) == [(float(i * i), float((i - 1) ** 2), i - 1.0, float(i), i + 1.0) for i in range(1, 5)]
    diff, _ = R.lagged_design(df, ["u"], ["t0"], "y", [], outcome_lags=1, difference=True)
    assert sorted(r["y"] for r in diff.collect()) == [3.0, 5.0, 7.0, 9.0]


# -- causality ---------------------------------------------------------------------------------------


def coupled(n=220):
    """x drives y, y does not drive x."""
    x, y = np.empty(n), np.empty(n)
    x[0], y[0] = 0.4, 0.2
    for i in range(n - 1):
        x[i + 1] = x[i] * (3.8 - 3.8 * x[i])
        y[i + 1] = y[i] * (3.5 - 3.5 * y[i] - 0.1 * x[i])
    return x, y


@pytest.fixture(scope="module")
def maps(spark):
    x, y = coupled()
    rng = np.random.default_rng(1)
    rows = [("map", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    rows += [("noise", i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(120, 2)))]
    rows += [("short", i, float(i), 1.0) for i in range(10)]
    rows += [("flat", i, 1.0, float(i % 5)) for i in range(60)]
    return spark.createDataFrame(rows, "unit string, i int, x double, y double").cache()


def brute_skill(x, e, step):
    n = len(x)
    at = [t for t in range(e - 1, n - step)]
    emb = np.array([[x[t - j] for j in range(e)] for t in at])
    pred, act = [], []
    for a, t in enumerate(at):
        d = np.sqrt(((emb - emb[a]) ** 2).sum(1))
        d[a] = np.inf
        near = np.argsort(d, kind="stable")[: e + 1]
        w = np.exp(-d[near] / d[near[0]]) if d[near[0]] > 0 else (d[near] == 0).astype(float)
        pred.append((w * np.array([x[at[s] + step] for s in near])).sum() / w.sum())
        act.append(x[t + step])
    return np.corrcoef(pred, act)[0, 1]


@pytest.mark.parametrize("block", [512, 37])
def test_forecasts(spark, maps, block):
    series = maps.filter("unit IN ('map', 'noise')")
    points = M.delay_points(series, ["unit"], ["i"], "x", 4, 3)
    found = M.forecasts(points, ["unit"], 4, 3, [(2, 1), (4, 1), (3, 3)], block)
    got = {(r["unit"], r["E"], r["step"]): r["rho"] for r in M.skill(found, ["unit", "E", "step"]).collect()}
    series = {"map": coupled()[0], "noise": np.random.default_rng(1).normal(size=(120, 2))[:, 0]}
    for (unit, e, s), rho in got.items():
        assert rho == pytest.approx(brute_skill(series[unit], e, s), abs=1e-9)
    assert len(got) == 6 and got["map", 2, 1] > 0.99 and abs(got["noise", 2, 1]) < 0.4


def test_exact_matches(spark):
    df = spark.createDataFrame([("u", i, float(i % 3)) for i in range(30)], "unit string, i int, x double")
    points = M.delay_points(df, ["unit"], ["i"], "x", 2, 1)
    for block in (512, 7):
        rows = M.forecasts(points, ["unit"], 2, 1, [(2, 1)], block).collect()
        assert len(rows) == 28 and all(r["predicted"] == r["actual"] for r in rows)


def test_slope_and_dimension(spark):
    rows = [("u", s, 0.9 - 0.05 * s + 0.01 * (s % 3)) for s in range(1, 11)] + [("v", 1, 0.5)]
    rows += [("w", s, 0.25) for s in range(1, 11)]
    df = spark.createDataFrame(rows, "u string, step int, rho double")
    got = {r["u"]: r for r in M.slope_test(df, ["u"]).collect()}
    s, y = np.arange(1, 11), np.array([r[2] for r in rows[:10]])
    slope, r = np.polyfit(s, y, 1)[0], np.corrcoef(s, y)[0, 1]
    assert got["u"]["rho_slope"] == pytest.approx(slope)
    # the density of t with 8 degrees of freedom, integrated numerically
    t = abs(r) * np.sqrt(8 / (1 - r * r))
    grid = np.linspace(-t, t, 2_000_001)
    dens = (1 + grid**2 / 8) ** -4.5 * 35 / (64 * np.sqrt(2))  # gamma ratio for 8 degrees of freedom
    assert got["u"]["rho_p"] == pytest.approx(max(1 - np.trapezoid(dens, grid), 0), abs=1e-7)
    assert got["v"]["rho_p"] is None and got["w"]["rho_p"] is None
    skills = spark.createDataFrame([("a", 2, -0.9), ("a", 3, 0.9), ("a", 4, 0.1), ("b", 2, None)], "u string, E int, rho double")
    assert {r["u"]: r["E"] for r in M.best_dimension(skills, ["u"]).collect()} == {"a": 2, "b": None}


@pytest.mark.parametrize("block", [512, 50])
def test_cross_map_direction(spark, maps, block):
    df = maps.filter("unit IN ('map', 'noise')")
    dims = spark.createDataFrame([("map", 2), ("noise", 2)], "unit string, E int")
    run = lambda cause, effect: M.cross_map(df, ["unit"], ["i"], cause, effect, dims, 2, [10, 40, 150], 12, block=block)
    forward = run("x", "y")
    by_size = {(r["unit"], r["L"]): r["rho"] for r in M.skill_by_size(forward, ["unit"]).collect()}
    # the driver can be read off what it drives, better with more points
    assert by_size["map", 150] > by_size["map", 40] > by_size["map", 10] and by_size["map", 150] > 0.8
    back = {(r["unit"], r["L"]): r["rho"] for r in M.skill_by_size(run("y", "x"), ["unit"]).collect()}
    assert back["map", 150] < by_size["map", 150] - 0.2 and abs(by_size["noise", 150]) < 0.3
    p = {r["unit"]: r["p"] for r in M.growth_test(forward, ["unit"]).collect()}
    assert p["map"] == 0.0
    again = {tuple(r) for r in run("x", "y").collect()}
    assert again == {tuple(r) for r in forward.collect()}


def test_causality_table(spark, maps):
    got = M.causality_table(maps, "unit", ["i"], ["x"], ["y"], "src", min_rows=50, max_e=4, sizes=[10, 150], iterations=8)
    rows = {r["org_unit"]: r for r in got.collect()}
    assert set(rows) == {"map", "noise", "short", "flat"} and rows["short"]["n_events"] == 10
    assert rows["map"]["run_complete"] and rows["map"]["a_cause_b"] <= 0.1 and rows["map"]["a_e_dim"] >= 2
    for u in ("short", "flat"):
        assert not rows[u]["run_complete"] and rows[u]["a_cause_b"] is None and rows[u]["a_rho_p"] is None


# -- whole runs --------------------------------------------------------------------------------------


def test_coding_order_and_filters(spark):
    reports = spark.createDataFrame([(3, "NoneNone"), (1, "It was closed.None"), (2, None), (4, "ok")], "id int, Narrative string")
    scores = spark.createDataFrame([(30, 0.3), (10, 0.1), (20, 0.2), (40, 0.4)], "TextID int, tone double")
    table = Scores(scores, prefix="liwc_", order=("TextID",), report_order=("id",))
    coded = {r["id"]: r for r in code_events(reports, "rail", "id", [table]).collect()}
    assert {i: (r["Narrative"], r["liwc_tone"]) for i, r in coded.items()} == {1: ("It was closed.", 0.1), 4: ("ok", 0.4)}
    assert coded[1]["PV_aux_pas"] == pytest.approx(1 / 3)
    n = spark.createDataFrame([(1, "n/a", "x n/a n/a"), (2, None, None), (3, "NO COMMENTS PROVIDED.", ""), (4, None, "y")],
                              "id int, narrative1 string, narrative2 string")
    assert [tuple(r) for r in combine_phmsa_narratives(n).collect()] == [(1, " x  n/a")]


def test_named_scores(spark):
    liwc = spark.createDataFrame([(str(i), *[float(i)] * len(LIWC)) for i in (1, 2)], "report_no string, " + ", ".join(f"`{c}` double" for c in LIWC))
    emo = spark.createDataFrame([(i, *[float(-i)] * len(EMOTION_VOCABULARY)) for i in (1, 2)], "n int, " + ", ".join(f"{c} double" for c in EMOTION_VOCABULARY))
    reports = spark.createDataFrame([("2", "b"), ("1", "a"), ], "report_no string, cmbd_narrative string")
    coded = code_events(reports, "phmsa", "report_no", [liwc_scores(liwc, "report_no"), emotion_scores(emo, ["n"], ["report_no"])], passive=False)
    got = {r["report_no"]: r for r in coded.collect()}
    assert len(coded.columns) == 2 + len(LIWC) + len(EMOTION_VOCABULARY)
    assert got["2"]["liwc_WC"] == 2.0 and got["2"]["liwc_function."] == 2.0 and got["1"]["emo_voc_Neg_CWR"] == -1.0
    with pytest.raises(ValueError):
        liwc_scores(liwc.drop("WC"))


def test_climate(spark):
    rows = [(f"a_{i}", str(i), float(i), 10.0, 1.0, float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "dataSet_num string, event_num string, gi_a double, liwc_WC double, liwc_c double, liwc_d double")
    got = climate_vectors({"nrc": df, "rail": df.limit(3)}, ["gi_a", "liwc_WC", "liwc_c", "liwc_d"])
    assert got.columns == ["dataSet_num", "event_num", "sys_source", "comp_clim_gi_a", "comp_clim_liwc_d", "composite_climate_vec"]
    assert got.count() == 43
    assert got.filter("event_num = '7' AND sys_source = 'nrc'").first()["composite_climate_vec"] == [0.7, 2.0]


@pytest.mark.parametrize("block_rows", [10**6, 17])
def test_measures_and_signals(spark, block_rows):
    rng = np.random.default_rng(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(u, start + dt.timedelta(days=float(d)), i + 1000 * k, rng.normal(size=3).tolist())
            for k, (u, n) in enumerate((("a", 45), ("b", 30), ("c", 4))) for i, d in enumerate(np.cumsum(rng.exponential(size=n)))]
    df = spark.createDataFrame(rows, "unit string, ts timestamp, eid long, vec array<double>")
    series = unit_series(df, "unit", "ts", ["vec"], min_events=20, block_rows=block_rows)
    assert series.count() == 75 and series.filter("b_param IS NULL").count() == 18
    metrics = ["cos_sim_rw_vec_1", "inter_event_dur", "b_param"]
    got = unit_signals(series, "unit", "ts", metrics, burn_in=10, threshold=1.0, block_rows=block_rows)
    rows = {r["eid"]: tuple(r[f"{m}_crossed"] for m in metrics) + (r["multi_crossed"],) for r in got.collect()}
    assert len(rows) == 75 - 18 and sum(v[0] is None for v in rows.values()) == 20
    if not hasattr(test_measures_and_signals, "rows"):
        test_measures_and_signals.rows = rows
    assert rows == test_measures_and_signals.rows


def test_days(spark):
    rows = [("u", d, [float(d), 1.0], float(i)) for d in range(3) for i in range(2)]
    df = spark.createDataFrame(rows, "unit string, day int, vec array<double>, s double")
    got = {r["day"]: r for r in day_metrics(df, ["unit"], "day", "vec", ["s"]).collect()}
    assert set(got) == {1, 2} and got[1]["lag_sim"] == pytest.approx(np.sqrt(0.5))
    assert got[2]["mean_sim"] == pytest.approx(1.0) and got[2]["s_mean"] == 0.5
    t = spark.createDataFrame([(1, 5), (2, 6)], "time long, n int")
    out = monthly_counts_with_signals(t, [t.select("time", F.col("n").alias("c")).limit(1)])
    assert out.count() == 2 and out.columns == ["time", "n", "c"]
    rolled = V.rolling_day_similarity(df, ["unit"], "day", "vec", min_days=2)
    assert rolled.count() == 3 and V.rolling_day_similarity(df, ["unit"], "day", "vec", min_days=3).count() == 0
    assert in_order(df, ["unit"], ["day", "s"]).rows.count() == 6


def test_library_lengths_follow_the_unit(spark):
    x, y, rows = 0.4, 0.2, []
    for t in range(160):
        x, y = x * (3.8 - 3.8 * x), y * (3.5 - 3.5 * y - 0.1 * x)
        rows.append(("u", t, x, y))
    series = spark.createDataFrame(rows, "u string, t int, x double, y double")
    dims = spark.createDataFrame([("u", 2)], "u string, E int")
    rhos = M.cross_map(series, ["u"], ["t"], "x", "y", dims, 2, None, iterations=2).collect()
    lengths = sorted({r["L"] for r in rhos})
    assert lengths == M.unit_sizes(160, 2) and lengths[0] == 4 and lengths[-1] == 160
    assert all(r["rho"] is not None for r in rhos if r["L"] > 50)


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 120)) + 1000
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 3.3
    names = [f"v{i}" for i in range(120)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"{n} double" for n in names))
    got = {(r["a"], r["b"]): r["r"] for r in S.correlations(df.repartition(5), names).collect()}
    for i, j in ((0, 1), (3, 90), (60, 119)):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert got[names[i], names[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert got["v0", "v7"] is None and len(got) == 120 * 119 / 2
    few = ["v1", "v2", "v3"]
    n, mean, cov = S.moment_matrices(df, few)
    whole = x[~np.isnan(x[:, 1:4]).any(axis=1), 1:4]
    assert n == len(whole) and np.allclose(mean, whole.mean(axis=0)) and np.allclose(cov, np.cov(whole.T))


def brute_cross_map(x, cause, e, sizes, iterations, key, seed=1):
    """rho per (iteration, L) by hand, with the draws hashed again."""
    n, out = len(x), {}
    at = list(range(e, n + 1))
    emb = {t: np.array([x[t - 1 - j] for j in range(e)]) for t in at}
    for it in range(1, iterations + 1):
        draws = [e + int(hashlib.md5(f"{key}|{it}|{p}|{seed}".encode()).hexdigest()[:8], 16) % (n - e + 1) for p in range(1, max(sizes) + 1)]
        for size in sizes:
            pred, act = [], []
            for t in at:
                near = sorted((np.sqrt(sum((emb[t] - emb[s]) ** 2)), p, cause[s - 1]) for p, s in enumerate(draws[:size]) if s != t)[: e + 1]
                d0 = near[0][0]
                w = [np.exp(-d / d0) if d0 > 0 else float(d == 0) for d, _, _ in near]
                pred.append(sum(a * y for a, (_, _, y) in zip(w, near)) / sum(w))
                act.append(cause[t - 1])
            out[it, size] = np.corrcoef(pred, act)[0, 1]
    return out


@pytest.mark.parametrize("block", [512, 16])
def test_cross_map_against_brute_force(spark, block):
    x, y = coupled(60)
    df = spark.createDataFrame([("map", 7, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "unit string, k int, i int, x double, y double")
    dims = spark.createDataFrame([("map", 7, 3)], "unit string, k int, E int")
    got = M.cross_map(df, ["unit", "k"], ["i"], "x", "y", dims, 3, [6, 20, 37], 12, block=block).collect()
    want = brute_cross_map(y, x, 3, [6, 20, 37], 12, "map|7")
    assert {(r["iteration"], r["L"]) for r in got} == set(want)
    for r in got:
        assert r["rho"] == pytest.approx(want[r["iteration"], r["L"]], abs=1e-9)


def test_library_blocks_give_the_same_lengths(spark, maps):
    dims = spark.createDataFrame([("map", 2), ("noise", 3)], "unit string, E int")
    df = maps.filter("unit IN ('map', 'noise')")
    whole, blocks = ({(r["unit"], r["iteration"], r["L"]): r["rho"] for r in M.cross_map(df, ["unit"], ["i"], "x", "y", dims, 3, None, 3, block=b).collect()} for b in (512, 64))
    assert set(whole) == set(blocks) and all(whole[k] == pytest.approx(blocks[k], abs=1e-9) for k in whole)


def test_each_series_is_searched_once(spark, maps, monkeypatch):
    searched = []
    real = M.forecasts

    def watched(points, keys, *rest, **more):
        searched.append(sorted(tuple(r) for r in points.select("series").distinct().collect()))
        return real(points, keys, *rest, **more)

    monkeypatch.setattr(M, "forecasts", watched)
    df = maps.filter("unit = 'map'").selectExpr("unit", "i", "x", "y", "x * x AS x2", "y + 1 AS y1")
    got = M.causality_table(df, "unit", ["i"], ["x", "y"], ["x2", "y1"], "src", max_e=3, sizes=[10, 100], iterations=2)
    assert got.count() == 4
    # two searches in all, for the dimension and for the decay, each over four series although there are four pairs
    assert searched == [[("x",), ("x2",), ("y",), ("y1",)]] * 2


def test_a_point_visits_few_tiles_of_a_long_series(spark):
    n, block = 20_000, 256
    x = np.empty(n)
    x[0] = 0.4
    for i in range(n - 1):
        x[i + 1] = x[i] * (3.9 - 3.9 * x[i])
    df = spark.createDataFrame([("u", i, float(v)) for i, v in enumerate(x)], "unit string, i int, x double")
    points = M.delay_points(df, ["unit"], ["i"], "x", 3, 1)
    tiled = M.tiles(points, ["unit"], block)
    sizes = [r["count"] for r in tiled.groupBy("_tile").count().collect()]
    assert sum(sizes) == n and max(sizes) <= block and len(sizes) < 2 * n / block
    near = M.forecasts(points, ["unit"], 3, 1, [(2, 1), (3, 1)], block)
    got = {(r["E"], r["t"]): r["predicted"] for r in near.filter("t % 400 = 0").collect()}
    for (e, t), predicted in got.items():
        emb = np.column_stack([x[e - 1 - j : n - 1 - j] for j in range(e)])
        d = np.sqrt(((emb - emb[t - e]) ** 2).sum(1))
        d[t - e] = np.inf
        at = np.argsort(d, kind="stable")[: e + 1]
        w = np.exp(-d[at] / d[at[0]])
        assert predicted == pytest.approx((w * x[at + e]).sum() / w.sum(), abs=1e-9)
    assert len(got) == 2 * 49
    # a row for each search and tile that a point is in or visits
    head = [M.T.StructField(c, k) for c, k in (("unit", M.T.StringType()), ("E", M.T.IntegerType()), ("step", M.T.IntegerType()), ("t", M.T.LongType()))]
    rows = M.tile_neighbours(tiled.cache(), ["unit"], 3, 1, [(2, 1), (3, 1)], M.T.StructType(head)).count()
    assert rows < 5 * 2 * n < len(sizes) * n / 5


def test_short_series_share_a_search(spark):
    df = spark.range(0, 4000).selectExpr("cast(id % 80 as string) AS unit", "id DIV 80 AS i", "sin(id * id) AS x", "cos(id) AS y")
    points = M.delay_points(df, ["unit"], ["i"], "x", 3, 2)
    dims = df.selectExpr("unit", "3 AS E").distinct()
    for found in (M.forecasts(points, ["unit"], 3, 2, [(2, 1), (3, 2)]), M.forecasts(points.withColumn("E", F.lit(2)), ["unit"], 3, 2, None, scored=True),
                  M.cross_map(df, ["unit"], ["i"], "x", "y", dims, 3, [10, 30], 12)):
        # a stream of whole series, not a call and a message for each of them
        plan = plan_of(found)
        assert "MapInArrow" in plan and "FlatMapGroupsInArrow" not in plan
    lengths, kinds = np.tile(np.arange(45, 95), 40), np.repeat([2, 3], 1000)
    stacks = list(M._alike(lengths, kinds))
    assert sorted(np.concatenate(stacks)) == list(range(2000)) and len(stacks) < 150
    assert all(len(set(kinds[s])) == 1 and len(s) * max(lengths[s]) ** 2 <= M.STACKED for s in stacks)


def brute_forecasts(x, e, step):
    """{t: (predicted, actual)} by hand; an equally near earlier point comes first."""
    n, out = len(x), {}
    known = [t for t in range(e, n - step + 1) if all(np.isfinite(x[t - 1 - j]) for j in range(e)) and np.isfinite(x[t - 1 + step])]
    for t in known:
        near = sorted((math.sqrt(sum((x[t - 1 - j] - x[s - 1 - j]) ** 2 for j in range(e))), s) for s in known if s != t)[: e + 1]
        if near:
            d0 = near[0][0]
            w = [math.exp(-d / d0) if d0 > 0 else float(d == 0) for d, _ in near]
            out[t] = (sum(a * x[s - 1 + step] for a, (_, s) in zip(w, near)) / sum(w), x[t - 1 + step])
    return out


def test_stacked_series_against_brute_force(spark):
    rng = np.random.default_rng(3)
    series = {(f"u{k}", None if k % 5 else k): rng.normal(size=n).round(1) for k, n in enumerate([1, 2, 5, 9, 23, 24, 25, 40, 40, 41])}
    series["ties", 1] = np.arange(30.0) % 4
    series["gaps", 1] = np.where(np.arange(50) % 7 == 3, np.nan, rng.normal(size=50).round(1))
    series["ends", 1] = np.where(np.arange(40) == 20, np.inf, rng.normal(size=40))
    series["flat", 1] = np.full(30, 0.1)
    rows = [(*key, i, float(v)) for key, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "unit string, k int, i int, x double")
    keys, pairs = ["unit", "k"], [(2, 1), (3, 1), (3, 2), (3, 4), (1, 3)]
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        points = M.delay_points(df, keys, ["i"], "x", 3, 4)
        found = M.forecasts(points, keys, 3, 4, pairs)
        got = {(r["unit"], r["k"], r["E"], r["step"], r["t"]): (r["predicted"], r["actual"]) for r in found.collect()}
        scores = {tuple(r)[:4]: tuple(r)[4:] for r in M.forecasts(points, keys, 3, 4, pairs, scored=True).collect()}
        chosen = points.withColumn("E", F.when(F.col("unit") < "u", 2).otherwise(3))
        own = {tuple(r)[:4]: tuple(r)[4:] for r in M.forecasts(chosen, keys, 3, 4, None, scored=True).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    want = {(*key, e, s, t): pair for key, x in series.items() for e, s in pairs for t, pair in brute_forecasts(x, e, s).items()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    reference = {tuple(r)[:4]: tuple(r)[4:] for r in M.skill(found, [*keys, "E", "step"]).collect()}
    assert set(scores) == set(reference) == {k[:4] for k in want}
    for k, (n, rho) in reference.items():
        assert scores[k][0] == n
        assert scores[k][1] == (None if rho is None else pytest.approx(rho, abs=1e-9)) or k[0] == "flat"
    assert all(scores[k][1] is None for k in scores if k[0] == "flat")
    assert {k[2:] for k in own if k[0] == "ties"} == {(2, s) for s in range(1, 5)}
    assert all(own[k] == pytest.approx(scores[k], abs=1e-9) for k in own if k in scores and None not in scores[k])


@pytest.mark.parametrize("block", [512, 16])
def test_equal_distances_of_unequal_squares(spark, block):
    # two sums of squares may differ in their last bit and have one root: the earlier point is the neighbour
    x = np.random.default_rng(20).integers(0, 60, 60) / 10
    df = spark.createDataFrame([("u", i, float(v)) for i, v in enumerate(x)], "unit string, i int, x double")
    points = M.delay_points(df, ["unit"], ["i"], "x", 3, 1)
    got = {r["t"]: r["predicted"] for r in M.forecasts(points, ["unit"], 3, 1, [(3, 1)], block).collect()}
    want = brute_forecasts(x, 3, 1)
    assert set(got) == set(want) and all(got[t] == pytest.approx(want[t][0], abs=1e-9) for t in want)


@pytest.mark.parametrize("sizes", [[6, 20, 37], None])
def test_stacked_cross_map_against_brute_force(spark, sizes):
    rng = np.random.default_rng(4)
    units = {f"u{k}": (2 + k % 2, rng.normal(size=(n, 2)).round(1)) for k, n in enumerate([2, 12, 30, 31, 31, 45])}
    rows = [(u, i, float(a), float(b)) for u, (_, xy) in units.items() for i, (a, b) in enumerate(xy)]
    df = spark.createDataFrame(rows, "unit string, i int, x double, y double")
    dims = spark.createDataFrame([(u, e) for u, (e, _) in units.items()], "unit string, E int")
    got = {tuple(r)[:3]: r["rho"] for r in M.cross_map(df, ["unit"], ["i"], "x", "y", dims, 3, sizes, 12).collect()}
    for u, (e, xy) in units.items():
        if len(xy) > 10:
            want = brute_cross_map(xy[:, 1], xy[:, 0], e, sizes or M.unit_sizes(len(xy), e), 12, u)
            assert {k[1:] for k in got if k[0] == u} == set(want)
            assert all(got[u, *k] == pytest.approx(want[k], abs=1e-9) for k in want)


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("table_bytes", [V.GRAM_BYTES, 0])
def test_pairwise_similarity_of_few_and_many_groups(spark, table_bytes):
    rng = np.random.default_rng(6)
    rows = []
    for g, n in enumerate([1, 2, 3, 5, 6, 7, 40, 300]):  # around and far beyond the width of 6
        v = rng.normal(size=(n, 6))
        v[n // 2] = 0.0 if n > 2 else v[0]
        if n == 300:
            v[:200] = v[0]  # copies
        rows += [(g, "x" if g % 2 else None, x.tolist()) for x in v]
    df = spark.createDataFrame(rows, "g int, h string, vec array<double>").repartition(5)
    found = V.pairwise_similarity(df, ["g"], "vec", 6, table_bytes=table_bytes)
    assert "Generate" not in plan_of(found)
    got = {r["g"]: r for r in found.collect()}
    for g in range(8):
        m = np.array([r[2] for r in rows if r[0] == g])
        size = np.linalg.norm(m, axis=1, keepdims=True)
        u = m / np.where(size > 0, size, 1.0)
        if len(u) == 1:
            assert got[g]["mean_sim"] is None and got[g]["std_sim"] is None
            continue
        pairs = (u @ u.T)[~np.eye(len(u), dtype=bool)]
        assert got[g]["mean_sim"] == pytest.approx(pairs.mean(), abs=1e-9) and got[g]["std_sim"] == pytest.approx(pairs.std(), abs=1e-7)


def test_mean_vectors_of_very_many_groups(spark):
    df = spark.range(40_000).selectExpr("id div 2 AS g", "IF(id % 7 = 0, NULL, 'k') AS k", "transform(sequence(1, 256), i -> CASE WHEN (id + i) % 50 = 0 THEN NULL ELSE cast((id * i) % 11 AS double) END) AS vec")
    found = V.mean_vector(df, ["g", "k"], "vec", "m")
    assert "Generate" not in plan_of(found)
    assert found.groupBy("g", "k").count().filter("count > 1").count() == 0
    for r in found.filter("g % 4000 = 3").collect():
        ids = [i for i in (2 * r["g"], 2 * r["g"] + 1) if (i % 7 == 0) == (r["k"] is None)]
        for i in (1, 100, 256):
            values = [(x * i) % 11 for x in ids if (x + i) % 50]
            assert r["m"][i - 1] == (pytest.approx(sum(values) / len(values)) if values else None)


def test_array_sums_across_batches(spark, monkeypatch):
    monkeypatch.setattr(AS, "PENDING_BYTES", 0)
    df = spark.range(3000).selectExpr("id % 3 AS g", "array(1D, cast(id AS double)) AS a").repartition(4)
    with_small = df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r["g"]: r["a"] for r in AS.sum_arrays(df, ["g"], "a").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_small)
    assert got == {g: [1000.0, float(sum(range(g, 3000, 3)))] for g in range(3)}
    assert AS.sum_arrays(df.filter("g > 5"), ["g"], "a").collect() == []
    mixed = spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "g int, a array<double>").coalesce(1)
    with pytest.raises(Exception, match="one length"):
        AS.sum_arrays(mixed, ["g"], "a").collect()


def test_hundreds_of_columns_are_planned_and_scored(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 365)) @ np.diag(np.linspace(1, 3, 365)) + 5
    x[3, 7] = np.nan
    names = [f"v{i}" for i in range(365)]
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in row)) for i, row in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in names))
    whole = np.delete(x, 3, 0)
    weights = rng.normal(size=(365, 29))
    c = FA.Components(names, whole.mean(0), whole.std(0, ddof=1), weights, weights)
    scores = FA.factor_scores(df, c, ["id"])
    assert len(plan_of(scores)) < 200_000 and scores.columns == ["id", *c.names]
    got = {r["id"]: [r[n] for n in c.names] for r in scores.filter("id < 20").collect()}
    assert set(got) == set(range(20)) - {3}
    for i, row in got.items():
        assert row == pytest.approx((x[i] - c.mean) / c.sd @ weights, abs=1e-9)
    some = names[:200]
    found = {r["id"]: r["mahad"] for r in S.mahalanobis(df.select("id", *some), some).collect()}
    off, inverse = whole[:, :200] - whole[:, :200].mean(0), np.linalg.inv(np.cov(whole[:, :200].T))
    assert found[3] is None
    assert [found[i] for i in range(300) if i != 3] == pytest.approx(np.einsum("ni,ij,nj->n", off, inverse, off), rel=1e-6)
