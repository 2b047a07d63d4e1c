"""Long units, cut into blocks, must give what one window over the whole unit gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators.ordering import in_order
from tidewatch.operators.quantiles import quantiles


def rows_with_a_hot_unit(n=400, seed=3):
    """A third of the rows in one unit, many of them at one instant; ids as text."""
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        unit = "hot" if i % 3 == 0 else f"u{rng.randrange(12)}"
        moment = start if i % 2 == 0 else start + dt.timedelta(seconds=rng.randrange(10**6))
        moment = None if i % 21 == 0 else moment
        rows.append((unit, moment, f"{rng.getrandbits(64):016x}", rng.choice([None, rng.gauss(5, 2)])))
    return rows


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(rows_with_a_hot_unit(), "unit string, ts timestamp, eid string, x double").cache()


def table(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in map(
        lambda r: tuple("" if v is None else str(round(v, 8)) if isinstance(v, float) else str(v) for v in r), df.collect()))


@pytest.mark.parametrize("unit", [["unit"], []])
@pytest.mark.parametrize("block_rows", [7, 50])
def test_ordinals(events, unit, block_rows):
    seq = in_order(events, unit, ["ts", "eid"], block_rows=block_rows)
    assert seq.split
    w = Window.partitionBy(*(unit or [F.lit(1)])).orderBy("ts", "eid")
    want = events.withColumn("t", F.row_number().over(w))
    assert table(seq.rows.select("eid", "t")) == table(want.select("eid", "t"))


def test_slices_are_no_longer_than_a_block(events):
    """The hot unit must not meet in one task when its ordinals are made."""
    seq = in_order(events, ["unit"], ["ts", "eid"], block_rows=10)
    plan = seq.rows._jdf.queryExecution().executedPlan().toString()
    assert "_s0" in plan and "_s1" in plan


def test_texts_that_begin_alike_are_cut_where_they_differ(spark):
    """Keys such as event_000001 must not stay one slice."""
    rows = [(f"event_{i:06d}", i) for i in range(2000)] + [("event_", -1), ("", -2), (None, -3), ("event_000001x", 0)]
    df = spark.createDataFrame(rows, "k string, i int").orderBy(F.rand(1))
    seq = in_order(df, [], ["k", "i"], block_rows=100)
    plan = seq.rows._jdf.queryExecution().optimizedPlan().toString()
    assert "_s0" in plan and "_s1" in plan
    got = [r["i"] for r in seq.rows.orderBy("t").collect()]
    want = [r["i"] for r in df.orderBy("k", "i").collect()]
    assert got == want


def test_a_frame_may_be_longer_than_a_block(events):
    def sums(seq):
        return seq.rolling({"s": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-25, 17))}, back=25, ahead=17).rows

    split, whole = (in_order(events, ["unit"], ["ts", "eid"], block_rows=b) for b in (7, 10_000))
    assert split.split and not whole.split
    assert table(sums(split).select("eid", "s")) == table(sums(whole).select("eid", "s"))


@pytest.mark.parametrize("block_rows", [7, 50])
def test_frames_and_sums(events, block_rows):
    def measures(seq):
        seq = seq.rolling(
            {
                "last": lambda w: F.lag("x", 2).over(w),
                "next": lambda w: F.lead("x").over(w),
                "recent": lambda w: F.sum("x").over(w.rowsBetween(-4, 1)),
            },
            back=4, ahead=1,
        )
        seq = seq.with_columns({"cell": F.when(F.col("x") > 5, "hi").otherwise("lo")})
        seq = seq.running({"total": F.col("x"), "n": F.when(F.col("x").isNotNull(), 1.0)})
        seq = seq.anchored({"first": F.col("x")}).running_rank("cell", "place")
        return seq.rows.select("eid", "t", "last", "next", "recent", "total", "n", "first", "place")

    plain = in_order(events, ["unit"], ["ts", "eid"])
    assert not plain.split
    cut = in_order(events, ["unit"], ["ts", "eid"], block_rows=block_rows)
    assert cut.split
    assert table(measures(cut)) == table(measures(plain))


def test_sums_over_the_whole_table(events):
    seq = in_order(events, [], ["ts", "eid"], block_rows=60)
    seq = seq.anchored({"first": F.col("eid")}).with_length("n").running({"total": F.lit(1.0)})
    rows = sorted(seq.rows.select("t", "eid", "first", "n", "total").collect())
    assert [r["total"] for r in rows] == [float(i + 1) for i in range(400)]
    assert {(r["first"], r["n"]) for r in rows} == {(rows[0]["eid"], 400)}



def test_regular_units_need_one_exchange(events):
    seq = in_order(events, ["unit"], ["ts", "eid"])
    seq = seq.rolling({"last": lambda w: F.lag("x").over(w)}, back=1).running({"total": F.col("x")})
    executed = seq.rows._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Window [") == 1
    assert executed.count("Exchange hashpartitioning") == 1
    assert executed.count("Sort [") == 1


@pytest.mark.parametrize("few", [3, 1000])
def test_quantiles_by_counting(spark, few):
    rng = random.Random(5)
    rows = [(rng.gauss(0, 1) ** 5, float(rng.randrange(4)), None if i % 3 else float(i)) for i in range(999)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    want = quantiles(df, ["a", "b", "c"], shares)
    got = quantiles(df, ["a", "b", "c"], shares, exact_rows=10, few=few)
    for c in want:
        assert got[c] == pytest.approx(want[c], rel=1e-12)


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0)] * 20, "a double, b double")
    assert quantiles(df, ["a", "b"], [0.5], exact_rows=5) == {"a": [None], "b": [1.0]}
