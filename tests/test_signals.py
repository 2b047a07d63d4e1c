"""Signals against their definitions, recomputed from scratch at every row, and cut against whole."""

import datetime as dt
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.operators.joint_signals import EIGEN_METRICS, JOINT_METRICS, eigen_metrics, information_path, joint_signals, multi_information
from tidewatch.operators.ordering import in_order
from tidewatch.operators.series import inter_event_times, rolling_burstiness
from tidewatch.plans.measures import unit_signals
from tidewatch.operators.signals import (
    attach_outcomes,
    crossing_count,
    crossings_by_metric,
    join_signals,
    metric_codes,
    signals_long,
    single_signals,
)

BURN = 8


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    rows, eid = [], 0
    for unit, n in (("long", 60), ("b", 25), ("c", 9), ("one", 1)):
        x = np.cumsum(rng.normal(size=(n, 3)), axis=0) * 0.3 + rng.normal(size=(n, 3)) + 50
        for i in range(n):
            eid += 1
            rows.append((unit, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i // 2), eid, *map(float, x[i])))
    rows += [("flat", dt.datetime(2024, 1, 1, i), 1000 + i, 0.1, 0.1, 0.1) for i in range(20)]
    return rows


@pytest.fixture(scope="module")
def series(spark, data):
    return spark.createDataFrame(data, "unit string, ts timestamp, eid long, x double, y double, z double").cache()


def matrix(data, unit):
    rows = sorted([r for r in data if r[0] == unit], key=lambda r: (r[1], r[2]))
    return np.array([r[3:] for r in rows]), [r[2] for r in rows]


def sd(v):
    return np.std(v, ddof=1) if len(v) > 1 else np.nan


def strengths(m, burn):
    """Per row: (value − mean)/sd of the finite values from the burn-in on."""
    out = np.full(len(m), np.nan)
    for t in range(burn - 1, len(m)):
        seen = m[burn - 1 : t + 1]
        seen = seen[np.isfinite(seen)]
        if np.isfinite(m[t]) and len(seen) > 1 and sd(seen) > 0:
            out[t] = (m[t] - seen.mean()) / sd(seen)
    return out


def from_scratch(x, burn):
    n = len(x)
    metrics = {k: np.full(n, np.nan) for k in ("ar1", "SD", "skew")}
    for t in range(n):
        v = x[: t + 1]
        metrics["SD"][t] = sd(v)
        if v.std() > 0:
            metrics["skew"][t] = ((v - v.mean()) ** 3).mean() / v.std() ** 3
        if t >= 2 and np.var(v[:-1]) > 0:
            metrics["ar1"][t] = np.polyfit(v[:-1], v[1:], 1)[0]
    z = {k: strengths(m, burn) for k, m in metrics.items()}
    codes = [c for s in (1, 2, 3) for c in combinations(("ar1", "SD", "skew"), s)]
    return {c: strengths(sum(z[m] for m in c), burn) for c in codes}


def test_metric_codes():
    assert metric_codes(("a", "b")) == [("a",), ("b",), ("a", "b")]


@pytest.mark.parametrize("block_rows", [10**6, 11])
def test_single_signals(series, data, block_rows):
    got = single_signals(series, ["unit"], ["ts", "eid"], "x", BURN, block_rows=block_rows)
    long = {(r["eid"], r["metric_code"]): r for r in signals_long(got, ["eid", "t"]).collect()}
    for unit in ("long", "b", "c", "one", "flat"):
        m, eids = matrix(data, unit)
        want = from_scratch(m[:, 0], BURN) if unit != "flat" else None
        for i, eid in enumerate(eids):
            for code in metric_codes(("ar1", "SD", "skew")):
                row = long.get((eid, " + ".join(code)))
                assert (row is None) == (i + 1 <= BURN)
                if row is None:
                    continue
                value = np.nan if want is None else want[code][i]
                if np.isnan(value):
                    assert row["str"] is None and row["threshold_crossed"] is False
                else:
                    assert row["str"] == pytest.approx(value, rel=1e-6, abs=1e-8)
                    assert row["threshold_crossed"] == (value > 2)


def test_counts_by_metric_equal_one_by_one(series):
    both = crossings_by_metric(series, ["unit"], ["ts", "eid"], ["x", "y"], BURN, threshold=1.0)
    both = {r["eid"]: r for r in both.collect()}
    for m in ("x", "y"):
        one = crossing_count(single_signals(series, ["unit"], ["ts", "eid"], m, BURN, 1.0), "n").collect()
        assert {r["eid"]: r["n"] for r in one} == {e: r[f"{m}_crossed"] for e, r in both.items()}
        assert 0 < max(r["n"] for r in one) <= 7


def joint_from_scratch(x, burn):
    n, p = x.shape
    m = {k: np.full(n, np.nan) for k in JOINT_METRICS}

    def binned(v):
        """Equal shares of the rows so far, as many as the cube root of their number."""
        bins = max(2, int(np.cbrt(len(v)) + 1e-9))
        ranks = np.argsort(np.argsort(v, axis=0, kind="stable"), axis=0, kind="stable")
        return ranks * bins // len(v)

    def entropy(labels):
        _, c = np.unique(labels, axis=0, return_counts=True)
        q = c / c.sum()
        return -(q * np.log(q)).sum()

    for t in range(burn - 1, n):
        v, cells = x[: t + 1], binned(x[: t + 1])
        cov = np.cov(v.T)
        ar = np.array([np.polyfit(v[:-1, j], v[1:, j], 1)[0] for j in range(p)])
        w = np.linalg.eigh(cov)[1][:, -1]
        s = (v - v.mean(0)) / v.std(0, ddof=1)
        g0, gd = np.cov(s.T), np.cov(np.diff(s, axis=0).T)
        chol = np.linalg.inv(np.linalg.cholesky(g0))
        values, vectors = np.linalg.eigh(chol @ gd @ chol.T)
        u = chol.T @ vectors[:, 0]
        u = u / np.linalg.norm(u)
        slope = lambda y: np.polyfit(y[:-1], y[1:], 1)[0]
        sds = v.std(0, ddof=1)
        found = dict(
            meanAR=ar.mean(), maxAR=ar.max(), meanSD=sds.mean(), maxSD=sds.max(), eigenMAF=values[0],
            mafAR=slope(s @ u), mafSD=sd(s @ u), pcaAR=slope(v @ w), pcaSD=sd(v @ w), eigenCOV=sd(v @ w) ** 2,
            maxCOV=max(cov[i, j] for i in range(p) for j in range(i)),
            mutINFO=sum(entropy(cells[:, j : j + 1]) for j in range(p)) - entropy(cells),
        )
        for k, f in found.items():
            m[k][t] = f
    return m


@pytest.mark.parametrize("block_rows", [10**6, 23])
def test_joint_signals(series, data, block_rows):
    got = joint_signals(series, ["unit"], ["ts", "eid"], ["x", "y", "z"], burn_in=BURN, block_rows=block_rows)
    rows = {r["eid"]: r for r in got.collect()}
    for unit in ("long", "b"):
        x, eids = matrix(data, unit)
        want = joint_from_scratch(x, BURN)
        for i, eid in enumerate(eids):
            if i + 1 <= BURN:
                assert eid not in rows
                continue
            for m in JOINT_METRICS:
                assert rows[eid][m] == pytest.approx(want[m][i], rel=1e-6, abs=1e-8), (unit, i, m)
        for m in JOINT_METRICS:
            strong = strengths(want[m], BURN)
            for i in range(BURN, len(eids)):
                if np.isfinite(strong[i]):
                    assert rows[eids[i]][f"{m}_str"] == pytest.approx(strong[i], rel=1e-4, abs=1e-5)
    flat = [r for r in rows.values() if r["unit"] == "flat"]
    assert flat and all(r["multi_crossed"] == 0 and r["eigenMAF"] is None for r in flat)


@pytest.mark.parametrize("first", [1, 2, 40, 219])
def test_information_path_from_any_row(first):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(220, 3))
    x[:, 1] = np.round(x[:, 0] + rng.normal(size=220), 1)  # with ties
    x[100:120] = x[100]

    def entropy(labels):
        q = np.unique(labels, axis=0, return_counts=True)[1] / len(labels)
        return -(q * np.log(q)).sum()

    got = information_path(x, first)
    assert len(got) == 221 - first
    for t in range(first, 221):
        bins = max(2, int(np.cbrt(t) + 1e-9))
        ranks = np.argsort(np.argsort(x[:t], axis=0, kind="stable"), axis=0, kind="stable")
        cells = ranks * bins // t
        want = sum(entropy(cells[:, j : j + 1]) for j in range(3)) - entropy(cells)
        assert got[t - first] == pytest.approx(want, abs=1e-9)


def test_information_by_stretches(series):
    seq = in_order(series.na.drop(subset=["x", "y"]), ["unit"], ["ts", "eid"])
    whole, parts = ({r["eid"]: r["m"] for r in multi_information(seq, ["x", "y"], BURN, "m", stretch=s).rows.select("eid", "m").collect()} for s in (8192, 17))
    assert set(whole) == set(parts)
    for k, v in whole.items():
        assert (v is None) == (parts[k] is None) and (v is None or v == pytest.approx(parts[k], abs=1e-9))


def test_eigen_metrics_of_bad_matrices():
    good = np.eye(2)
    bad = np.full((2, 2), np.nan)
    stack = lambda a: np.stack([a, bad, np.zeros((2, 2))])
    out = eigen_metrics(*[stack(good)] * 4)
    assert out.shape == (3, len(EIGEN_METRICS))
    assert np.isfinite(out[0]).all() and np.isnan(out[1:]).all()


def test_unknown_metric(series):
    with pytest.raises(ValueError):
        joint_signals(series, ["unit"], ["ts", "eid"], ["x", "y"], metrics=("nope",))


def test_burstiness_and_ties(spark):
    start = dt.datetime(2024, 1, 1)
    hours = [0, 0, 1, 3, 3, 10, 11, 11, 20, 40, 41, 41]
    rows = [("u", start + dt.timedelta(hours=h), i) for i, h in enumerate(hours)]
    rows += [("same", start, 100 + i) for i in range(12)]
    df = spark.createDataFrame(rows, "unit string, ts timestamp, eid long")
    for block_rows in (10**6, 11):
        seq = inter_event_times(in_order(df, ["unit"], ["ts", "eid"], block_rows=block_rows), "ts", "hours")
        seq = rolling_burstiness(seq, k=10)
        got = {r["eid"]: r for r in seq.rows.collect()}
        gaps = np.diff(hours)
        assert got[0]["inter_event_dur"] is None and got[1]["inter_event_dur"] == 0.0
        assert [got[i + 1]["inter_event_dur"] for i in range(11)] == list(map(float, gaps))
        for i in range(9, 12):
            g = gaps[i - 9 : i]
            r = g.std(ddof=1) / g.mean()
            assert got[i]["b_param"] == pytest.approx((r - 1) / (r + 1))
        assert all(got[i]["b_param"] is None for i in range(9))
        # no time passes at all: the mean gap is zero, so there is no value
        assert all(got[100 + i]["b_param"] is None for i in range(12))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(0.01, 1000), min_size=3, max_size=12))
def test_burstiness_is_bounded(spark, gaps):
    r = float(np.std(gaps, ddof=1) / np.mean(gaps))
    from tidewatch.operators.series import burstiness_of

    row = spark.range(1).select(
        burstiness_of(F.lit(r), F.lit(float(len(gaps)))).alias("b"),
        burstiness_of(F.lit(r), F.lit(float(len(gaps))), True).alias("c"),
    ).first()
    assert -1 <= row["b"] <= 1
    # the corrected form is made for the population sd, so with the sample sd it may pass 1
    assert row["c"] >= -1 - 1e-9
    with pytest.raises(ValueError):
        burstiness_of(F.lit(r), F.lit(3.0), True, "other")


def test_join_and_outcomes(spark):
    a = spark.createDataFrame([("e1", "u", 1), ("e2", None, 2)], "eid string, unit string, n int")
    b = spark.createDataFrame([("e1", 5), ("e3", 6)], "eid string, m int")
    joined = join_signals(a, b)
    assert joined.count() == 3
    out = attach_outcomes(joined, spark.createDataFrame([("e1", 1)], "eid string, harm int"), "unit").collect()
    assert [(r["eid"], r["harm"]) for r in out] == [("e1", 1)]


def test_single_counts_without_the_joint_ones(spark):
    rows = [(u, i, float((i * 37 + u) % 11), float((i * i) % 7)) for u in range(2) for i in range(90)]
    series = spark.createDataFrame(rows, "unit long, at long, x double, y double").withColumn("eid", F.col("at"))
    both = unit_signals(series, "unit", "at", ["x", "y"], burn_in=50)
    single = unit_signals(series, "unit", "at", ["x", "y"], burn_in=50, joint=False)
    assert "multi_crossed" in both.columns and "multi_crossed" not in single.columns
    assert sorted(map(str, both.drop("multi_crossed").collect())) == sorted(map(str, single.collect())) and single.count() == 180
