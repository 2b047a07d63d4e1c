"""Which features vary enough, robust scaling, correlation, outlier distance, intraclass correlation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.matrices import apply_matrix
from tidewatch.operators.quantiles import quantiles

MAD_SCALE = 1.4826  # fixed value: consistent with the standard deviation of a normal distribution


def melted(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns]
    return df.select(*(keys or []), F.inline(F.array(*cells)))


def near_zero_variance(
    df: DataFrame, columns: list[str], freq_cut: float = 95 / 5, unique_cut: float = 10.0
) -> DataFrame:
    """Per column: ratio of its two most frequent values, % of distinct values, and the verdict."""
    counts = melted(df, columns).filter("x IS NOT NULL").groupBy("variable", "x").agg(
        F.count(F.lit(1)).alias("n")
    )
    # the two largest counts by aggregation: the largest, how often it occurs, and the next one
    top = counts.groupBy("variable", "n").agg(F.count(F.lit(1)).alias("times"))
    best = top.groupBy("variable").agg(
        F.max(F.struct("n", "times")).alias("first"), F.sum("times").alias("distinct"),
        F.sum(F.col("n") * F.col("times")).alias("total"),
    )
    second = (
        top.join(F.broadcast(best.select("variable", F.col("first.n").alias("_n"))), "variable")
        .filter("n < _n").groupBy("variable").agg(F.max("n").alias("next"))
    )
    n_rows = df.count()
    out = best.join(second, "variable", "left")
    runner_up = F.when(F.col("first.times") > 1, F.col("first.n")).otherwise(F.col("next"))
    out = out.select(
        "variable",
        F.coalesce(F.col("first.n") / runner_up, F.lit(0.0)).alias("freq_ratio"),
        (F.lit(100.0) * F.col("distinct") / F.lit(n_rows)).alias("percent_unique"),
        (F.col("distinct") == 1).alias("zero_var"),
    )
    verdict = F.col("zero_var") | (
        (F.col("freq_ratio") > freq_cut) & (F.col("percent_unique") <= unique_cut)
    )
    return out.withColumn("nzv", verdict)


def column_spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: sd, median and scaled median absolute deviation."""
    sds = df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in columns]).first()
    medians = {c: q[0] for c, q in quantiles(df, columns, [0.5]).items()}
    off = df.select(*[F.abs(F.col(c).cast("double") - F.lit(medians[c])).alias(c) for c in columns])
    mads = {c: q[0] for c, q in quantiles(off, columns, [0.5]).items()}
    return df.sparkSession.createDataFrame(
        [(c, sds[c], medians[c], None if mads[c] is None else mads[c] * MAD_SCALE) for c in columns],
        "variable string, sd double, median double, mad double",
    )


def varying_columns(df: DataFrame, columns: list[str], screen_frequency: bool = True) -> list[str]:
    """Columns that pass the frequency screen and have neither zero sd nor zero MAD."""
    kept = set(columns)
    if screen_frequency:
        kept -= {r["variable"] for r in near_zero_variance(df, columns).filter("nzv").collect()}
    spread = {r["variable"]: r for r in column_spread(df, sorted(kept)).collect()} if kept else {}
    return [c for c in columns if c in kept and c in spread
            and (spread[c]["sd"] or 0) > 0 and (spread[c]["mad"] or 0) > 0]


def robust_standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x − median) / MAD. One row of statistics per column comes to the driver."""
    stats = {r["variable"]: r for r in column_spread(df, columns).collect()}
    return df.withColumns(
        {c: F.try_divide(F.col(c).cast("double") - F.lit(stats[c]["median"]), F.lit(stats[c]["mad"]))
         for c in columns}
    )


def cross_sums(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The columns' means, and four p×p sums over the rows in which both columns of a cell have a value:
    their number, and of the first column's values (less its mean) the sum, the sum of squares and the
    sum of products with the second.

    Every task adds up matrix products of its Arrow batches; the tasks' matrices meet by row, so a few
    hundred columns cost no planning. NaN counts as missing. p rows of 4·p numbers reach the driver.
    """
    p = len(columns)
    df = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(columns)])
    first = df.agg(*[F.avg(f"c{i}") for i in range(p)]).first()
    mean = np.array([np.nan if m is None else m for m in first], dtype=float)

    def add_up(batches):
        total = np.zeros((4, p, p))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
            there = ~np.isnan(x)
            x, there = np.where(there, x - mean, 0.0), there.astype(float)
            total += (there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x)
        yield _rows(np.arange(p), total)

    def _rows(i, total):
        cells = pa.array(total.transpose(1, 0, 2).ravel())
        lists = pa.ListArray.from_arrays(np.arange(len(i) + 1, dtype=np.int32) * 4 * p, cells)
        return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), lists], names=["i", "s"])

    def meet(table):
        together = np.stack([c.as_py() for c in table.column("s")]).sum(axis=0).reshape(4, 1, p)
        return pa.Table.from_batches([_rows(np.array([table.column("i")[0].as_py()]), together)])

    parts = df.mapInArrow(add_up, "i int, s array<double>")
    sums = np.zeros((4, p, p))
    for row in parts.groupBy("i").applyInArrow(meet, "i int, s array<double>").collect():
        sums[:, row["i"], :] = np.array(row["s"]).reshape(4, p)
    return mean, sums


def _covariances(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Covariance of each pair and variance of its first column, over the pair's common rows."""
    n, x, xx, xy = sums
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = np.where(n > 1, (xy - x * x.T / n) / (n - 1), np.nan)
        var = np.where(n > 1, (xx - x * x / n) / (n - 1), np.nan)
    return cov, var


def correlations(df: DataFrame, columns: list[str], complete_rows: bool = False) -> DataFrame:
    """(a, b, r) for every pair a < b; a constant side gives null. Rows with a null on either side, or
    with ``complete_rows`` in any column, are left out."""
    spark = df.sparkSession
    if complete_rows:
        df = df.na.drop(subset=columns)
    mean, sums = cross_sums(df, columns)
    cov, var = _covariances(sums)
    flat = ~(var > 1e-24 * (1 + mean[:, None] ** 2))  # what is left of a constant is rounding
    rows = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            fixed = flat[i, j] or flat[j, i]
            rows.append((a, columns[j], None if fixed else float(cov[i, j] / np.sqrt(var[i, j] * var[j, i]))))
    return spark.createDataFrame(rows, "a string, b string, r double")


def moment_matrices(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Complete rows: their number, means and covariance matrix."""
    mean, sums = cross_sums(df.na.drop(subset=columns), columns)
    cov, _ = _covariances(sums)
    flat = ~(np.diag(cov) > 1e-24 * (1 + mean**2))
    cov[flat, :] = cov[:, flat] = 0.0
    return int(sums[0, 0, 0]), mean, cov


def correlation_matrix(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray]:
    n, _, cov = moment_matrices(df, columns)
    sd = np.sqrt(np.diag(cov))
    if not (sd > 0).all():
        raise ValueError("a constant column has no correlations")
    return n, cov / np.outer(sd, sd)


def mahalanobis(df: DataFrame, columns: list[str], name: str = "mahad") -> DataFrame:
    """Squared distance of each complete row from the mean, in units of the covariance."""
    _, mean, cov = moment_matrices(df, columns)
    # with cov = LLᵀ the distance is the squared length of the row less the mean, times the inverse of Lᵀ
    factor = np.linalg.inv(np.linalg.cholesky(cov)).T
    return apply_matrix(df, columns, df.columns, mean, factor, [name], lengths=True)


def icc(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """One-way random-effects intraclass correlation of every column, for groups of any sizes."""
    long = melted(df, columns, [group]).filter(F.col("x").isNotNull() & F.col(group).isNotNull())
    groups = long.groupBy("variable", group).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("x").alias("mean"),
        F.var_pop("x").alias("var"),
    )
    totals = groups.groupBy("variable").agg(
        F.count(F.lit(1)).cast("double").alias("a"), F.sum("n").alias("N"),
        F.sum(F.col("n") * F.col("n")).alias("N2"), F.sum(F.col("n") * F.col("var")).alias("within"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
    )
    between = groups.join(F.broadcast(totals.select("variable", "grand")), "variable").groupBy("variable").agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("between")
    )
    k0 = (F.col("N") - F.col("N2") / F.col("N")) / (F.col("a") - 1)
    msb = F.try_divide(F.col("between"), F.col("a") - 1)
    msw = F.try_divide(F.col("within"), F.col("N") - F.col("a"))
    return totals.join(between, "variable").select(
        "variable", F.try_divide(msb - msw, msb + (F.when(F.col("a") > 1, k0) - 1) * msw).alias("icc")
    )
