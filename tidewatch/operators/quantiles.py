"""Exact quantiles of columns of any length.

Spark's exact ``percentile`` keeps all distinct values of a group in one task, so it is used for
bounded input only. Beyond, a quantile is found by counting: the value range is cut into bins, the
bin that holds the wanted rank is cut again, until few values are left. Only counts reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT_ROWS = 1_000_000
BINS = 1000
FEW = 10_000


def quantiles(
    df: DataFrame, columns: list[str], shares: list[float], exact_rows: int = EXACT_ROWS, few: int = FEW
) -> dict[str, list[float | None]]:
    """Per column, the quantiles of its non-null values, interpolated linearly between ranks."""
    df = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    if df.limit(exact_rows + 1).count() <= exact_rows:
        at = F.array(*[F.lit(float(s)) for s in shares])
        row = df.agg(*[F.percentile(c, at).alias(c) for c in columns]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(shares) for c in columns}
    ends = df.agg(*[
        s for i, c in enumerate(columns)
        for s in (F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))
    ]).first()
    wanted = {}
    for i, c in enumerate(columns):
        for s in shares if ends[f"n{i}"] else []:
            place = s * (ends[f"n{i}"] - 1)
            for rank in {math.floor(place), math.ceil(place)}:
                wanted[c, rank] = (ends[f"lo{i}"], ends[f"hi{i}"])
    values = _ranked_values(df, wanted, few)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        out[c] = []
        for s in shares:
            if not ends[f"n{i}"]:
                out[c].append(None)
                continue
            place = s * (ends[f"n{i}"] - 1)
            low, high = values[c, math.floor(place)], values[c, math.ceil(place)]
            out[c].append(low + (high - low) * (place - math.floor(place)))
    return out


def _ranked_values(df: DataFrame, wanted: dict, few: int) -> dict:
    """(column, rank from 0) → value, by narrowing [lo, hi] around each rank."""
    done, open_ = {}, {k: (lo, hi, k[1]) for k, (lo, hi) in wanted.items()}
    while open_:
        for k in [k for k, (lo, hi, _) in open_.items() if lo == hi]:
            done[k] = open_.pop(k)[0]
        if not open_:
            break
        ids = list(open_)
        parts = []
        for i, k in enumerate(ids):
            lo, hi, _ = open_[k]
            x, step = F.col(k[0]), (hi - lo) / BINS
            piece = F.least(F.floor((x - F.lit(lo)) / F.lit(step)), F.lit(BINS - 1)) if step > 0 else F.lit(0)
            parts.append(F.when(x.between(lo, hi), F.struct(F.lit(i).alias("i"), piece.cast("int").alias("bin"), x.alias("x"))))
        cells = df.select(F.inline(F.array_compact(F.array(*parts)))).groupBy("i", "bin").agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")
        )
        table: dict[int, list] = {}
        for r in cells.collect():
            table.setdefault(r["i"], []).append(r)
        for i, k in enumerate(ids):
            before, rank = 0, open_[k][2]
            for r in sorted(table[i], key=lambda r: r["bin"]):
                if rank < before + r["n"]:
                    break
                before += r["n"]
            rank -= before
            if r["n"] <= few:
                near = df.filter(F.col(k[0]).between(r["lo"], r["hi"])).select(k[0]).collect()
                done[k] = sorted(v[0] for v in near)[rank]
                del open_[k]
            elif (r["lo"], r["hi"]) == open_[k][:2]:
                # the bins cannot get any narrower: count the values themselves
                done[k] = _by_value(df, k[0], r["lo"], r["hi"], rank)
                del open_[k]
            else:
                open_[k] = (r["lo"], r["hi"], rank)
    return done


def _by_value(df: DataFrame, column: str, lo: float, hi: float, rank: int) -> float:
    counts = df.filter(F.col(column).between(lo, hi)).groupBy(column).count().orderBy(column)
    before = 0
    for r in counts.toLocalIterator():
        if rank < before + r["count"]:
            return r[column]
        before += r["count"]
    raise AssertionError("rank beyond the last value")
