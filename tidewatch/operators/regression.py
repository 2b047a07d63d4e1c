"""Least squares from sums Spark adds up: one table of coefficients, or one per unit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.ordering import BLOCK_ROWS, in_order


def linear_model(df: DataFrame, outcome: str, predictors: list[str]) -> DataFrame:
    """(term, estimate, std_error, t, p) of an ordinary least-squares fit over complete rows."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in (outcome, *predictors)]).na.drop()
    features = VectorAssembler(inputCols=predictors, outputCol="_x").transform(rows)
    fit = LinearRegression(featuresCol="_x", labelCol=outcome, solver="normal").fit(features)
    s = fit.summary
    # the summary lists the intercept last
    terms = [*predictors, "(Intercept)"]
    estimates = [*fit.coefficients.toArray(), fit.intercept]
    table = zip(terms, estimates, s.coefficientStandardErrors, s.tValues, s.pValues)
    return df.sparkSession.createDataFrame(
        [(t, *map(float, v)) for t, *v in table],
        "term string, estimate double, std_error double, t double, p double",
    )


def lagged_design(
    df: DataFrame,
    unit: list[str],
    order: list[str],
    outcome: str,
    signals: list[str],
    outcome_lags: int = 2,
    signal_lags: tuple[int, ...] = (1, 0, -1),
    difference: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, list[str]]:
    """Outcome, its lags and the signals before, at and after each row; rows with gaps left out."""
    seq = in_order(df, unit, order, block_rows=block_rows)
    if difference:
        seq = seq.rolling({"_d": lambda w: F.col(outcome) - F.lag(outcome).over(w)}, back=1)
        seq = seq.with_columns({outcome: F.col("_d")}).drop("_d")
    columns = {
        f"{outcome}_lag{i}": (lambda w, i=i: F.lag(outcome, i).over(w).cast("double"))
        for i in range(1, outcome_lags + 1)
    }
    for s in signals:
        for lag in signal_lags:
            name = s if lag == 0 else f"{s}_lag{lag}" if lag > 0 else f"{s}_lead{-lag}"
            columns[f"x_{name}"] = lambda w, s=s, lag=lag: (
                (F.lag(s, lag) if lag >= 0 else F.lead(s, -lag)).over(w).cast("double")
            )
    back = max([outcome_lags, *[lag for lag in signal_lags if lag > 0], 1])
    ahead = max([0, *[-lag for lag in signal_lags]])
    rows = seq.rolling(columns, back=back, ahead=ahead).rows
    names = list(columns)
    return rows.select(*unit, F.col(outcome).cast("double").alias("y"), *names).na.drop(), names


def least_squares_by_unit(df: DataFrame, unit: list[str], outcome: str, terms: list[str]) -> DataFrame:
    """Coefficients per unit. Normal equations are sums, so a unit of any length is added up in many
    tasks and one row per unit is solved."""
    names = ["_one", *terms]
    rows = df.withColumn("_one", F.lit(1.0))
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    # deviations from the mean over all rows keep the sums well conditioned
    centre = df.agg(F.avg(outcome).alias("_y"), *[F.avg(t).alias(t) for t in terms]).first()
    if centre["_y"] is None:
        centre = {c: 0.0 for c in ("_y", *terms)}
    shifted = {t: F.col(t) - F.lit(float(centre[t])) for t in terms}
    rows = rows.withColumns(shifted | {"_y": F.col(outcome) - F.lit(float(centre["_y"]))})
    sums = rows.groupBy(*unit).agg(
        F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in cells]).alias("xx"),
        F.array(*[F.sum(F.col(n) * F.col("_y")) for n in names]).alias("xy"),
        F.sum(F.col("_y") * F.col("_y")).alias("yy"),
        F.count(F.lit(1)).alias("n"),
    )
    k = len(names)
    mean_y, mean_x = float(centre["_y"]), np.array([float(centre[t]) for t in terms])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                rec = row._asdict() if hasattr(row, "_asdict") else dict(zip(batch.columns, row))
                gram = np.zeros((k, k))
                for (i, j), v in zip(cells, rec["xx"]):
                    gram[i, j] = gram[j, i] = v
                key = [rec[u] for u in unit]
                df_left = rec["n"] - k
                if df_left < 1 or np.linalg.matrix_rank(gram, tol=1e-9 * max(gram.max(), 1e-300)) < k:
                    out += [(*key, t, rec["n"], None, None, None) for t in ("(Intercept)", *terms)]
                    continue
                inverse = np.linalg.inv(gram)
                beta = inverse @ np.asarray(rec["xy"], dtype=float)
                s2 = max(rec["yy"] - beta @ np.asarray(rec["xy"], dtype=float), 0.0) / df_left
                # undo the shift of the intercept
                turn = np.eye(k)
                turn[0, 1:] = -mean_x
                cov = turn @ (inverse * s2) @ turn.T
                beta = turn @ beta
                beta[0] += mean_y
                se = np.sqrt(np.diag(cov))
                out += [
                    (*key, t, rec["n"], float(b), float(e), float(b / e) if e > 0 else None)
                    for t, b, e in zip(("(Intercept)", *terms), beta, se)
                ]
            yield pd.DataFrame(out, columns=[*unit, "term", "n", "estimate", "std_error", "t"])

    schema = T.StructType(
        [df.schema[u] for u in unit]
        + [T.StructField("term", T.StringType()), T.StructField("n", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("estimate", "std_error", "t")]
    )
    return sums.mapInPandas(solve, schema)
