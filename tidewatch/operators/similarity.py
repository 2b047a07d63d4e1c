"""Similarity of an event's vector to earlier ones, and of the vectors of a group to each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.vectors import cosine, doubles, mean_of, unit_vector
from tidewatch.operators.array_sums import group_starts, lists, map_groups, matrix, sum_arrays
from tidewatch.operators.groups import groups_of_size
from tidewatch.operators.ordering import BLOCK_ROWS, OrderedRows, in_order
from tidewatch.session import settle

#: Products of all groups that one task may hold.
GRAM_BYTES = 64_000_000


def vector_length(df: DataFrame, column: str) -> int:
    """The common length of a vector column; a mixed one is an error."""
    sizes = df.filter(F.col(column).isNotNull()).agg(
        F.min(F.size(column)).alias("lo"), F.max(F.size(column)).alias("hi")
    ).first()
    if sizes["lo"] is None or sizes["lo"] != sizes["hi"]:
        raise ValueError(f"{column}: vectors of one length expected, got {sizes['lo']}..{sizes['hi']}")
    return sizes["lo"]


def similarity_to_previous(
    seq: OrderedRows, vector: str, name: str, zero_norm: float | None = None
) -> OrderedRows:
    """Cosine with the vector of the event before."""
    seq = seq.rolling({"_last": lambda w: F.lag(vector).over(w)}, back=1)
    return seq.with_columns({name: cosine(vector, "_last", zero_norm)}).drop("_last")


def similarity_to_recent(
    seq: OrderedRows, vector: str, k: int, dim: int, name: str
) -> OrderedRows:
    """Cosine with the mean vector of the k events before; null until there are k of them.

    A missing vector counts as an event but not in the mean. The window must be shorter than half
    the unit, otherwise the unit's column is null; k = 1 means the previous event.
    """
    if k == 1:
        return similarity_to_previous(seq, vector, name)
    frame = lambda w: w.rowsBetween(-k, -1)
    seq = seq.rolling(
        {
            "_recent": lambda w: F.collect_list(vector).over(frame(w)),
            "_rows": lambda w: F.count(F.lit(1)).over(frame(w)),
        },
        back=k,
    )
    seq = seq.with_length("_n")
    full = (F.col("_rows") == k) & (F.col("_n") > 2 * k)
    value = F.when(full, cosine(vector, mean_of("_recent", dim)))
    return seq.with_columns({name: value}).drop("_recent", "_rows", "_n")


def unit_similarity(
    df: DataFrame,
    unit: str,
    date: str,
    vector: str,
    ks: list[int],
    min_events: int = 100,
    key: str = "eid",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Units with enough events, in time order, with ``cos_sim_rw_<vector>_<k>`` for every k."""
    gated = groups_of_size(df, [unit], min_events)
    dim = vector_length(df, vector)
    seq = in_order(gated, [unit], [date, key], block_rows=block_rows)
    for k in ks:
        seq = similarity_to_recent(seq, vector, k, dim, f"cos_sim_rw_{vector}_{k}")
    return seq.rows


def mean_vector(df: DataFrame, by: list[str], vector: str, name: str) -> DataFrame:
    """Element-wise mean per group. Partial sums leave each task, never the vectors."""
    values = F.transform(doubles(vector), lambda x: F.coalesce(x, F.lit(0.0)))
    known = F.transform(doubles(vector), lambda x: x.isNotNull().cast("double"))
    sums = sum_arrays(df.filter(F.col(vector).isNotNull()).select(*by, F.concat(values, known).alias("_sums")), by, "_sums")
    half = (F.size("_sums") / 2).cast("int")
    mean = F.zip_with(F.slice("_sums", F.lit(1), half), F.slice("_sums", half + 1, half), lambda s, n: F.try_divide(s, n))
    return sums.select(*by, mean.alias(name))


def day_similarity(
    df: DataFrame,
    unit: list[str],
    day: str,
    vector: str,
    name: str = "lag_sim",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Cosine of a day's mean vector with that of the unit's previous day that has events."""
    days = mean_vector(df, [*unit, day], vector, "mean_embedding")
    seq = in_order(days, unit, [day], block_rows=block_rows)
    return similarity_to_previous(seq, "mean_embedding", name, zero_norm=0.0).rows


def rolling_day_similarity(
    df: DataFrame, unit: list[str], day: str, vector: str, min_days: int = 120,
    name: str = "rolling_sim",
) -> DataFrame:
    """Units with more than ``min_days`` days: mean pairwise cosine of a day and the one before,
    which for two days is their cosine."""
    days = mean_vector(df, [*unit, day], vector, "mean_embedding")
    kept = groups_of_size(days, unit, min_days + 1)
    return similarity_to_previous(in_order(kept, unit, [day]), "mean_embedding", name, 0.0).rows


# -- similarity inside a group -------------------------------------------------------------------


def pairwise_similarity(
    df: DataFrame, by: list[str], vector: str, dim: int, with_sd: bool = True, table_bytes: int = GRAM_BYTES
) -> DataFrame:
    """Mean and sd (of all ordered pairs) of the cosine between the vectors of a group.

    With u the vectors at length one, n of them, n1 not zero, s = Σu and G = Σuuᵀ:
    mean = (|s|² − n1) / (n(n−1)) and mean of squares = (|G|² − n1) / (n(n−1)). So a group is summed
    up, never paired: the work grows with its rows, and a hot group is added up in many tasks.
    """
    u = df.select(*by, unit_vector(doubles(vector)).alias("_u")).filter("_u IS NOT NULL")
    u = u.withColumn("_n1", F.when(F.exists("_u", lambda x: x != 0), 1).otherwise(0))
    counts = u.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum("_n1").cast("double").alias("_n1")
    )
    pairs = F.col("_n") * (F.col("_n") - 1)
    mean = F.when(F.col("_n") > 1, (F.col("_s2") - F.col("_n1")) / F.nullif(pairs, F.lit(0.0)))
    if not with_sd:
        sums = sum_arrays(u, by, "_u").select(*by, squared("_u").alias("_s2"))
        return counts.join(sums, by).select(*by, F.col("_n").alias("n"), mean.alias("mean_sim"))
    counts = settle(counts)
    result = counts.join(_sum_and_gram_squares(u.select(*by, "_u"), counts, by, dim, table_bytes), by)
    second = F.when(F.col("_n") > 1, (F.col("_g2") - F.col("_n1")) / F.nullif(pairs, F.lit(0.0)))
    sd = F.when(F.col("_n") > 1, F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))))
    return result.select(*by, F.col("_n").alias("n"), mean.alias("mean_sim"), sd.alias("std_sim"))


def squared(column: str) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda a, x: a + x * x)


def _sum_and_gram_squares(u: DataFrame, counts: DataFrame, by: list[str], dim: int, table_bytes: int) -> DataFrame:
    """(by, _s2, _g2): |Σu|² and |Σuuᵀ|² per group.

    Few groups: every task adds up d×d products for all of them. Many groups: those of at most d rows come together and
    have n×n products instead; larger ones are cut into parts that add up d×d products one after the other.
    """
    if counts.count() * (dim + dim * dim) * 8 <= table_bytes:
        return _from_products(u.mapInArrow(_products_of_task(by, dim), _product_schema(u, by)), by)
    sized = u.join(counts.select(*by, "_n"), by)
    few = sized.filter(F.col("_n") <= dim).select(*by, "_u")

    def square(rows: pa.RecordBatch) -> list[float]:
        m = matrix(rows.column("_u"))
        products = m @ m.T
        return [float(products.sum()), float((products * products).sum())]

    numbers = [T.StructField(c, T.DoubleType()) for c in ("_s2", "_g2")]
    small = map_groups(few, by, square, numbers)
    # copies of a vector meet first, so that the rest of a group can be dealt out by the vector's hash
    many = sized.filter(F.col("_n") > dim).groupBy(*by, "_n", "_u").agg(F.count(F.lit(1)).cast("double").alias("_w"))
    many = many.withColumn("_part", F.pmod(F.xxhash64("_u"), F.ceil(F.col("_n") / (8 * dim))))
    part = [*by, "_part"]
    sorted_rows = many.repartition(*part).sortWithinPartitions(*part).select(*part, "_u", "_w")
    products = sorted_rows.mapInArrow(_products_of_runs(part, by, dim), _product_schema(u, by))
    return small.unionByName(_from_products(products, by))


def _product_schema(u: DataFrame, by: list[str]) -> T.StructType:
    return T.StructType([u.schema[b] for b in by] + [T.StructField("_row", T.IntegerType()), T.StructField("_sums", T.ArrayType(T.DoubleType()))])


def _product_rows(heads: pa.RecordBatch, by: list[str], sums: np.ndarray, grams: np.ndarray) -> pa.RecordBatch:
    """d + 1 rows for each of some groups: the sum of its vectors, then the rows of its products."""
    n, dim = sums.shape
    rows = np.concatenate([sums[:, None, :], grams], axis=1).reshape(n * (dim + 1), dim)
    keys = heads.take(pa.array(np.repeat(np.arange(n), dim + 1)))
    return pa.RecordBatch.from_arrays([*keys.columns, pa.array(np.tile(np.arange(dim + 1), n), pa.int32()), lists(rows)], names=[*by, "_row", "_sums"])


def _products_of_task(by: list[str], dim: int):
    def run(batches):
        groups: dict[tuple, int] = {}
        heads, sums, grams = [], np.zeros((0, dim)), np.zeros((0, dim, dim))
        for batch in batches:
            if not batch.num_rows:
                continue
            m, (order, starts) = matrix(batch.column("_u")), group_starts(batch, by)
            ends = [*starts[1:].tolist(), batch.num_rows]
            for a, b in zip(starts.tolist(), ends):
                head = batch.select(by).slice(int(order[a]), 1)
                at = groups.setdefault(tuple(c[0].as_py() for c in head.columns), len(groups))
                if at == len(heads):
                    heads.append(head)
                    sums, grams = np.concatenate([sums, np.zeros((1, dim))]), np.concatenate([grams, np.zeros((1, dim, dim))])
                x = m[order[a:b]]
                sums[at] += x.sum(0)
                grams[at] += x.T @ x
        for at, head in enumerate(heads):
            yield _product_rows(head, by, sums[at : at + 1], grams[at : at + 1])

    return run


def _products_of_runs(part: list[str], by: list[str], dim: int):
    def run(batches):
        head, here, total, gram = None, None, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            if not batch.num_rows:
                continue
            m, w, (order, starts) = matrix(batch.column("_u")), batch.column("_w").to_numpy(), group_starts(batch, part)
            ends = [*starts[1:].tolist(), batch.num_rows]
            for a, b in zip(starts.tolist(), ends):
                rows = batch.slice(a, 1)
                key = tuple(rows.column(c)[0].as_py() for c in part)
                if key != here:
                    if head is not None:
                        yield _product_rows(head, by, total[None], gram[None])
                    head, here, total, gram = rows.select(by), key, np.zeros(dim), np.zeros((dim, dim))
                x, n = m[order[a:b]], w[order[a:b]]
                total += n @ x
                gram += (x * n[:, None]).T @ x
        if head is not None:
            yield _product_rows(head, by, total[None], gram[None])

    return run


def _from_products(products: DataFrame, by: list[str]) -> DataFrame:
    """The rows of one group's products are added up apart, so a hot group is spread over d + 1 keys."""
    rows = sum_arrays(products, [*by, "_row"], "_sums").select(*by, "_row", squared("_sums").alias("_x"))
    first = F.col("_row") == 0
    return rows.groupBy(*by).agg(F.sum(F.when(first, F.col("_x"))).alias("_s2"), F.sum(F.when(~first, F.col("_x"))).alias("_g2"))


# -- similarity of neighbouring documents ----------------------------------------------------------


def neighbour_similarity(counts: DataFrame, previous: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Cosine of a document's term counts with those of the one before it.

    ``counts`` is (key, term, n), ``previous`` is (key, previous key). Every count goes to the pair in
    which its document is the later one and to the pair in which it is the earlier one; all sums of
    a pair come from these rows, so the work follows the number of terms, not of document pairs. ``parts`` is how many tasks
    share the pairs' terms.
    """
    following = previous.filter("previous IS NOT NULL").select(
        F.col("previous").alias(key), F.col(key).alias("_next")
    )
    none = F.lit(None).cast("long")

    def side(pair: str, late: Column, early: Column) -> Column:
        return F.struct(F.col(pair).alias("_pair"), late.alias("late"), early.alias("early"))

    sides = F.array(
        side(key, F.col("n"), none), F.when(F.col("_next").isNotNull(), side("_next", none, F.col("n")))
    )
    cells = counts.join(following, key, "left").select("term", F.inline(F.array_compact(sides)))
    # together by pair, so that the sums by term and the sums by pair move nothing any more
    dealt = cells.repartition(parts, "_pair") if parts else cells.repartition("_pair")
    cells = dealt.groupBy("_pair", "term").agg(
        F.max("late").alias("late"), F.max("early").alias("early")
    )
    late, early = F.col("late").cast("double"), F.col("early").cast("double")
    sums = cells.groupBy("_pair").agg(
        F.sum(late * early).alias("dot"), F.sum(late * late).alias("l2"), F.sum(early * early).alias("e2")
    )
    value = F.coalesce("dot", F.lit(0.0)) / F.sqrt(F.col("l2") * F.col("e2"))
    return (
        previous.filter("previous IS NOT NULL").select(key, "previous")
        .join(sums, F.col(key) == F.col("_pair"), "left")
        .select(key, "previous", F.when(F.col("l2").isNotNull() & F.col("e2").isNotNull(), value).alias("similarity"))
    )
