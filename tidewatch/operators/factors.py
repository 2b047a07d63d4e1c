"""Factorability, number of factors, rotated principal components and their scores.

Spark adds up the correlation matrix; what follows is p×p and done on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.matrices import apply_matrix
from tidewatch.operators.screening import correlation_matrix, moment_matrices


@dataclass(frozen=True)
class Bartlett:
    chi_square: float
    df: int
    n: int


def bartlett(df: DataFrame, columns: list[str]) -> Bartlett:
    """Is the correlation matrix more than noise?"""
    n, r = correlation_matrix(df, columns)
    p = len(columns)
    _, log_det = np.linalg.slogdet(r)
    return Bartlett(float(-(n - 1 - (2 * p + 5) / 6) * log_det), p * (p - 1) // 2, n)


def kmo(df: DataFrame, columns: list[str]) -> tuple[float, dict[str, float]]:
    """Sampling adequacy over all and per variable, from correlations and partial correlations."""
    _, r = correlation_matrix(df, columns)
    inverse = np.linalg.inv(r)
    scale = np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    partial = -inverse / scale
    r2, q2 = r**2, partial**2
    np.fill_diagonal(r2, 0.0)
    np.fill_diagonal(q2, 0.0)
    each = r2.sum(0) / (r2.sum(0) + q2.sum(0))
    return float(r2.sum() / (r2.sum() + q2.sum())), dict(zip(columns, map(float, each)))


def standard_normal(key: str) -> float:
    """A normal number by the polar angle and radius from the first two 32-bit words of the key's MD5."""
    digest = md5(key.encode()).hexdigest()
    radius, angle = ((int(digest[i : i + 8], 16) + 0.5) / 2**32 for i in (0, 8))
    return math.sqrt(-2 * math.log(radius)) * math.cos(2 * math.pi * angle)


def noise_eigenvalues(
    spark: SparkSession, n: int, p: int, iterations: int = 100, seed: int = 1
) -> DataFrame:
    """Mean and 95th percentile of the eigenvalues of the correlations of n rows of p noise columns.

    The cross-products of normal noise are drawn by their triangular factor, so an iteration costs
    p² draws however many rows it stands for. Draws are hashes of seed, iteration and place (see ``standard_normal``); the
    chi-squares on the diagonal are cubes of normals, which is close where rows outnumber columns by far.
    """
    free = n - 1.0 - np.arange(p)
    if free.min() < 1:
        raise ValueError("more rows than columns expected")

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i in batch["id"]:
                z = np.array([[standard_normal(f"{seed}|{i}|{r}|{c}") if c <= r else 0.0 for c in range(p)] for r in range(p)])
                a = np.tril(z, -1)
                a[np.diag_indices(p)] = np.sqrt(free * np.maximum(1 - 2 / (9 * free) + np.diag(z) * np.sqrt(2 / (9 * free)), 0) ** 3)
                s = a @ a.T
                d = np.sqrt(np.diag(s))
                values = np.linalg.eigvalsh(s / np.outer(d, d))[::-1]
                out += [(int(i), k + 1, float(v)) for k, v in enumerate(values)]
            yield pd.DataFrame(out, columns=["iteration", "component", "eigenvalue"])

    runs = spark.range(0, iterations, 1, max(1, iterations // 10)).mapInPandas(
        simulate, "iteration long, component int, eigenvalue double"
    )
    return runs.groupBy("component").agg(
        F.avg("eigenvalue").alias("noise_mean"), F.percentile("eigenvalue", 0.95).alias("noise_p95")
    )


def factor_count(df: DataFrame, columns: list[str], iterations: int = 100, seed: int = 1) -> DataFrame:
    """Scree table with the components kept by the eigenvalue-one rule and by parallel analysis."""
    n, r = correlation_matrix(df, columns)
    values = np.linalg.eigvalsh(r)[::-1]
    spark = df.sparkSession
    scree = spark.createDataFrame(
        [(i + 1, float(v), float(v / len(columns))) for i, v in enumerate(values)],
        "component int, eigenvalue double, share double",
    )
    noise = noise_eigenvalues(spark, n, len(columns), iterations, seed)
    return scree.join(noise, "component").select(
        "*", (F.col("eigenvalue") > 1).alias("kaiser"),
        (F.col("eigenvalue") > F.col("noise_mean")).alias("parallel"),
    )


def varimax(loadings: np.ndarray, tolerance: float = 1e-12, rounds: int = 10_000) -> np.ndarray:
    """Rotation that makes the squared loadings of each factor as unequal as it can; rows are
    weighted to equal length while rotating."""
    p, k = loadings.shape
    if k < 2:
        return np.eye(k)
    length = np.sqrt((loadings**2).sum(1, keepdims=True))
    x = loadings / np.where(length > 0, length, 1.0)
    rotation = np.eye(k)
    for _ in range(rounds):
        z = x @ rotation
        u, _, vt = np.linalg.svd(x.T @ (z**3 - z * (z**2).mean(0)))
        moved = np.abs(u @ vt - rotation).max()
        rotation = u @ vt
        if moved < tolerance:
            break
    return rotation


@dataclass(frozen=True)
class Components:
    columns: list[str]
    mean: np.ndarray
    sd: np.ndarray
    loadings: np.ndarray  # variables × factors
    weights: np.ndarray  # standardised variables → scores

    @property
    def names(self) -> list[str]:
        return [f"RC{i + 1}" for i in range(self.loadings.shape[1])]


def principal_components(df: DataFrame, columns: list[str], n_factors: int, rotate: bool = True) -> Components:
    """Components of the correlation matrix of complete rows, rotated, each with a positive sum of
    loadings, in order of explained variance."""
    _, mean, cov = moment_matrices(df, columns)
    sd = np.sqrt(np.diag(cov))
    r = cov / np.outer(sd, sd)
    values, vectors = np.linalg.eigh(r)
    keep = np.argsort(values)[::-1][:n_factors]
    loadings = vectors[:, keep] * np.sqrt(np.maximum(values[keep], 0.0))
    if rotate:
        loadings = loadings @ varimax(loadings)
    total = loadings.sum(0)
    # loadings that cancel have no sign of their own; the first variable gives them one
    total = np.where(np.abs(total) > 1e-8 * np.abs(loadings).sum(0), total, loadings[0])
    loadings = loadings * np.where(total < 0, -1.0, 1.0)
    loadings = loadings[:, np.argsort(-(loadings**2).sum(0), kind="stable")]
    return Components(columns, mean, sd, loadings, np.linalg.solve(r, loadings))


def factor_scores(df: DataFrame, c: Components, keys: list[str]) -> DataFrame:
    """Scores of complete rows, by key: the standardised columns times the weights, computed where the rows are."""
    rows = df.na.drop(subset=c.columns)
    return apply_matrix(rows, c.columns, keys, c.mean, c.weights / c.sd[:, None], c.names)


def loadings_table(spark: SparkSession, c: Components) -> DataFrame:
    rows = [(v, n, float(c.loadings[i, j])) for i, v in enumerate(c.columns) for j, n in enumerate(c.names)]
    return spark.createDataFrame(rows, "variable string, factor string, loading double")


def attach_scores(df: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Factor scores back on the source rows, by the key both have kept."""
    names = [c for c in scores.columns if c.startswith("RC")]
    return df.join(scores.select(key, *names), key, "left")


def chi_square_upper(x: float, df: int) -> float:
    """Upper tail probability, by the Wilson–Hilferty normal approximation."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))
