"""Early-warning signals of several series per unit together, over an expanding window.

The covariance matrices of a row come from running sums; small eigenproblems, batched over rows, leave the
JVM. Multi-information ranks all rows so far anew at every row: a task takes a stretch of rows of one unit and the
values before them, sets up the ranks once and then only moves the rows that a new one pushes over a bin's border.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.ordering import BLOCK_ROWS, OrderedRows, in_order
from tidewatch.operators.signals import _ratio, expanding_mean_sd

#: Rows of a unit that one task goes through; the rows before them are only ranked.
STRETCH = 8192

JOINT_METRICS = (
    "meanAR", "maxAR", "meanSD", "maxSD", "eigenMAF", "mafAR", "mafSD", "pcaAR", "pcaSD", "eigenCOV",
    "maxCOV", "mutINFO",
)
EIGEN_METRICS = ("eigenCOV", "pcaSD", "pcaAR", "eigenMAF", "mafAR", "mafSD")


def eigen_metrics(g0, g1, glag, gdiff):
    """Batched (rows, p, p) covariances → one row per input row, in the order of EIGEN_METRICS.

    ``g0`` of the series, ``g1`` with their lag, ``glag`` of the lags, ``gdiff`` of the differences.
    The autocorrelation of a projection w is w'g1w / w'glag w, its regression on its own lag.
    """
    out = np.full((len(g0), 6), np.nan)
    diagonal = np.einsum("nii->ni", g0)
    ok = np.isfinite(g0).all((1, 2)) & np.isfinite(gdiff).all((1, 2)) & (diagonal > 0).all(1)
    if not ok.any():
        return out
    g0, g1, glag, gdiff = g0[ok], g1[ok], glag[ok], gdiff[ok]
    sd = np.sqrt(diagonal[ok])

    def form(w, m):
        return np.einsum("ni,nij,nj->n", w, m, w)

    with np.errstate(divide="ignore", invalid="ignore"):
        values, basis = np.linalg.eigh(g0)
        w = basis[:, :, -1]
        top = np.maximum(values[:, -1], 0.0)
        pca = [top, np.sqrt(top), form(w, g1) / form(w, glag)]
        # min-max autocorrelation factors on the series at unit variance: whiten, then rotate
        scale = sd[:, :, None] * sd[:, None, :]
        values, basis = np.linalg.eigh(g0 / scale)
        full = values[:, 0] > 1e-10 * values[:, -1]
        white = basis / np.sqrt(np.maximum(values, 1e-300))[:, None, :]
        inner = np.swapaxes(white, 1, 2) @ (gdiff / scale) @ white
        inner[~full] = np.eye(g0.shape[1])
        smooth, rotation = np.linalg.eigh(inner)
        w = np.einsum("nij,nj->ni", white, rotation[:, :, 0])
        w = w / np.linalg.norm(w, axis=1, keepdims=True)
        maf = [smooth[:, 0], form(w, g1 / scale) / form(w, glag / scale), np.sqrt(form(w, g0 / scale))]
        maf = [np.where(full, m, np.nan) for m in maf]
    out[ok] = np.stack([*pca, *maf], axis=1)
    out[~np.isfinite(out)] = np.nan
    return out


def _largest(values: list[Column]) -> Column:
    """Null if any value is missing, which ``greatest`` would pass over."""
    known = reduce(lambda a, b: a & b, [v.isNotNull() for v in values])
    return F.when(known, F.greatest(*values) if len(values) > 1 else values[0])


def _eigen_udf(p: int):
    schema = ", ".join(f"{m} double" for m in EIGEN_METRICS)

    @F.pandas_udf(schema)
    def run(g0: pd.Series, g1: pd.Series, glag: pd.Series, gdiff: pd.Series) -> pd.DataFrame:
        def cube(s):
            cells = np.array([np.asarray(v, dtype=float) for v in s])
            return cells.reshape(len(s), p, p)

        return pd.DataFrame(eigen_metrics(*map(cube, (g0, g1, glag, gdiff))), columns=EIGEN_METRICS)

    return run


def expanding_covariances(seq: OrderedRows, series: list[str]) -> OrderedRows:
    """Columns ``_g0``, ``_g1``, ``_glag``, ``_gdiff``: flat p×p matrices of rows 1..t.

    Differences to the first value make the sums over rows 2..t equal to those over 1..t, and the
    sums over the lagged rows equal to those less the current row, so few sums are needed.
    """
    p = range(len(series))
    seq = seq.anchored({f"_a{i}": F.col(x) for i, x in enumerate(series)})
    seq = seq.with_columns({f"_d{i}": F.col(x) - F.col(f"_a{i}") for i, x in enumerate(series)})
    seq = seq.rolling({f"_l{i}": (lambda w, i=i: F.lag(f"_d{i}").over(w)) for i in p}, back=1)
    sums = {f"_s{i}": F.col(f"_d{i}") for i in p}
    sums |= {f"_s{i}_{j}": F.col(f"_d{i}") * F.col(f"_d{j}") for i in p for j in p if i <= j}
    sums |= {f"_p{i}_{j}": F.col(f"_d{i}") * F.col(f"_l{j}") for i in p for j in p}
    seq = seq.running(sums)
    n = F.col(seq.ordinal).cast("double")
    c = n - 1
    d = [F.col(f"_d{i}") for i in p]
    s = [F.col(f"_s{i}") for i in p]
    lag = [s[i] - d[i] for i in p]

    def ss(i, j):
        return F.col(f"_s{min(i, j)}_{max(i, j)}")

    def over(value: Column, df: Column) -> Column:
        return F.when(df > 0, value / F.nullif(df, F.lit(0.0)))

    def g0(i, j):
        return over(ss(i, j) - s[i] * s[j] / n, n - 1)

    def late(i, j):
        return over(ss(i, j) - s[i] * s[j] / F.nullif(c, F.lit(0.0)), c - 1)

    def g1(i, j):
        return over(F.col(f"_p{i}_{j}") - s[i] * lag[j] / F.nullif(c, F.lit(0.0)), c - 1)

    def glag(i, j):
        return over(ss(i, j) - d[i] * d[j] - lag[i] * lag[j] / F.nullif(c, F.lit(0.0)), c - 1)

    flat = lambda f: F.array(*[f(i, j) for i in p for j in p])
    seq = seq.with_columns(
        {
            "_g0": flat(g0),
            "_g1": flat(g1),
            "_glag": flat(glag),
            "_gdiff": flat(lambda i, j: late(i, j) - g1(i, j) - g1(j, i) + glag(i, j)),
        }
    )
    spent = [f"_{k}{i}" for k in "adls" for i in p]
    spent += [f"_s{i}_{j}" for i in p for j in p if i <= j] + [f"_p{i}_{j}" for i in p for j in p]
    return seq.drop(*spent)


def bin_count(t: int) -> int:
    """The cube root of the rows so far, rounded down, but two at least."""
    bins = round(t ** (1 / 3))
    return max(2, bins - (bins**3 > t))


class Bins:
    """Equal shares of the rows so far for one series: row of rank r (from 0) among t is in bin r·bins // t."""

    def __init__(self, x: np.ndarray, bins: int):
        order = np.argsort(x, kind="stable")
        self.bins, self.rows = bins, order.tolist()
        self.values = x[order].tolist()
        digit = np.empty(len(x), np.int64)
        digit[order] = np.arange(len(x)) * bins // len(x)
        self.digit = digit.tolist()

    def add(self, value: float) -> list[tuple[int, int]]:
        """A further row; (row, bins moved) of those that its rank and the new borders push into another bin."""
        row, before, moved = len(self.rows), len(self.rows), []
        at = bisect_right(self.values, value)  # equal values rank in order of arrival
        self.values.insert(at, value)
        self.rows.insert(at, row)
        self.digit.append(at * self.bins // (row + 1))
        for k in range(1, self.bins):
            old = -(-k * before // self.bins)
            old += old >= at  # where the first row of bin k is now
            new = -(-k * (before + 1) // self.bins)
            for i in range(min(old, new), max(old, new)):
                other = self.rows[i]
                if other != row:
                    now = i * self.bins // (before + 1)
                    moved.append((other, now - self.digit[other]))
                    self.digit[other] = now
        return moved


def information_path(x: np.ndarray, first: int) -> np.ndarray:
    """Σ marginal entropies − joint entropy of rows 1..t for t = first..len(x), in nats."""
    n, p = x.shape
    weight = np.zeros(n + 2)
    weight[2:] = np.arange(2, n + 2) * np.log(np.arange(2, n + 2))
    weight, out, bins = weight.tolist(), [], 0
    for t in range(first, n + 1):
        if bin_count(t) != bins:
            bins = bin_count(t)
            series = [Bins(x[:t, i], bins) for i in range(p)]
            cells = sum(np.array(s.digit) * bins**i for i, s in enumerate(series))
            names, sizes = np.unique(cells, return_counts=True)
            count, cell = dict(zip(names.tolist(), sizes.tolist())), cells.tolist()
            joint = sum(weight[c] for c in count.values())
        else:
            changes: dict[int, int] = {}
            for i, s in enumerate(series):
                for row, by in s.add(float(x[t - 1, i])):
                    changes[row] = changes.get(row, 0) + by * bins**i
            for row, by in changes.items():
                if by:
                    c = count[cell[row]]
                    joint += weight[c - 1] - weight[c]
                    count[cell[row]] = c - 1
                    cell[row] += by
                    c = count.get(cell[row], 0)
                    joint += weight[c + 1] - weight[c]
                    count[cell[row]] = c + 1
            own = sum(s.digit[t - 1] * bins**i for i, s in enumerate(series))
            c = count.get(own, 0)
            joint += weight[c + 1] - weight[c]
            count[own] = c + 1
            cell.append(own)
        borders = [-(-k * t // bins) for k in range(bins + 1)]
        one = sum(weight[b - a] for a, b in zip(borders, borders[1:]))
        out.append((p - 1) * np.log(t) - (p * one - joint) / t)
    return np.array(out)


def multi_information(seq: OrderedRows, series: list[str], burn_in: int, name: str, stretch: int = STRETCH) -> OrderedRows:
    """Σ marginal entropies − joint entropy of rows 1..t from t = burn_in on, in nats.

    At every row each series' values so far are cut anew into bins of equal shares, as many as the cube root of
    the rows so far. Equal values rank in order of arrival.
    """
    unit = list(seq.unit)
    rows = seq.with_length("_n").rows.select(*unit, F.col(seq.ordinal).cast("long").alias("_t"), "_n", F.array(*series).alias("_x"))
    last = lambda c: F.floor((F.col(c) - 1) / F.lit(stretch))
    rows = rows.withColumn("_part", F.explode(F.sequence(last("_t"), last("_n"))))
    schema = T.StructType([rows.schema[u] for u in unit] + [T.StructField("_t", T.LongType()), T.StructField(name, T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_t")
        x = table.column("_x").combine_chunks().flatten().to_numpy().reshape(table.num_rows, len(series))
        first = max(table.column("_part")[0].as_py() * stretch + 1, burn_in, 1)
        found = information_path(x, first)
        t = np.arange(first, first + len(found))
        key = [pa.array([table.column(u)[0].as_py()] * len(t), table.schema.field(u).type) for u in unit]
        return pa.table([*key, pa.array(t, pa.int64()), pa.array(found, pa.float64())], names=[*unit, "_t", name])

    found = rows.groupBy(*unit, "_part").applyInArrow(run, schema).withColumnRenamed("_t", seq.ordinal)
    return replace(seq, rows=seq.rows.withColumn(seq.ordinal, F.col(seq.ordinal).cast("long")).join(found, [*unit, seq.ordinal], "left"))


def joint_signals(
    df: DataFrame,
    unit: list[str],
    order: list[str],
    series: list[str],
    metrics: tuple[str, ...] = JOINT_METRICS,
    burn_in: int = 50,
    threshold: float = 2.0,
    block_rows: int = BLOCK_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """One row per event after the burn-in: each metric, its strength ``<m>_str``, ``<m>_crossed``,
    and ``multi_crossed``, the number of crossings."""
    unknown = set(metrics) - set(JOINT_METRICS)
    if unknown or len(series) < 2:
        raise ValueError(f"unknown metrics {sorted(unknown)} or fewer than two series")
    df = df.na.drop(subset=series).withColumns({x: F.col(x).cast("double") for x in series})
    p = len(series)
    seq = in_order(df, unit, order, block_rows=block_rows, longest=longest)
    if "mutINFO" in metrics:
        seq = multi_information(seq, series, burn_in, "mutINFO")
    seq = expanding_covariances(seq, series)
    cell = lambda m, i, j: F.col(m)[i * p + j]
    sds = [F.when(cell("_g0", i, i) >= 0, F.sqrt(cell("_g0", i, i))) for i in range(p)]
    ars = [_ratio(cell("_g1", i, i), cell("_glag", i, i)) for i in range(p)]
    pairs = [cell("_g0", i, j) for i in range(p) for j in range(i)]
    mean = lambda xs: reduce(lambda a, b: a + b, xs) / F.lit(float(len(xs)))
    native = {
        "meanAR": mean(ars), "maxAR": _largest(ars), "meanSD": mean(sds), "maxSD": _largest(sds),
        "maxCOV": _largest(pairs),
    }
    late = F.col(seq.ordinal) >= burn_in
    seq = seq.with_columns({m: F.when(late, native[m]) for m in metrics if m in native})
    if "mutINFO" in metrics:
        seq = seq.with_columns({"mutINFO": F.when(late, F.col("mutINFO"))})
    eigen = [m for m in metrics if m in EIGEN_METRICS]
    if eigen:
        found = _eigen_udf(p)("_g0", "_g1", "_glag", "_gdiff")
        seq = seq.with_columns({"_eigen": found})
        finite = lambda m: F.when(late & ~F.isnan(F.col("_eigen")[m]), F.col("_eigen")[m])
        seq = seq.with_columns({m: finite(m) for m in eigen}).drop("_eigen")
    seq = seq.drop("_g0", "_g1", "_glag", "_gdiff")
    seq = expanding_mean_sd(seq, list(metrics))
    seq = seq.with_columns(
        {f"{m}_str": _ratio(F.col(m) - F.col(f"{m}_mean"), F.col(f"{m}_sd")) for m in metrics}
    ).drop(*[f"{m}_{s}" for m in metrics for s in ("mean", "sd")])
    seq = seq.with_columns(
        {f"{m}_crossed": F.coalesce(F.col(f"{m}_str") > threshold, F.lit(False)) for m in metrics}
    )
    total = reduce(lambda a, b: a + b, [F.col(f"{m}_crossed").cast("int") for m in metrics])
    return seq.with_columns({"multi_crossed": total}).rows.filter(F.col(seq.ordinal) > burn_in)
