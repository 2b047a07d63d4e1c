import numpy as np
import pytest
from pyspark.sql import types as T

from tidewatch.llm import one_bit_codes as C

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       *[T.StructField(c, T.StringType()) for c in ("id", "vec", "node", "score", "rank", "cell", "part")]])


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], *["x"] * 7) for i, v in rows], SCHEMA)


def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 48)) * 2
    rows = [(i, centres[i % 12] + rng.normal(size=48)) for i in range(1200)]
    rows += [(2000 + i, rows[5][1]) for i in range(300)]  # one very common vector
    rows += [(3000 + i, rows[7][1] + rng.normal(size=48) * 1e-3) for i in range(300)]  # and one of near copies
    rows += [(4000, rows[0][1]), (5, rows[5][1]), (4020, [0.0] * 48), (4040, None), (4060, [None] + [1.0] * 47), (4080, [float("inf")] * 48)]
    rows += [(4100, [1.0, 2.0]), (4120, [2.0, -1.0]), (4140, [3.0]), (None, rows[3][1]), (4160, [])]
    return [(i, None if v is None else list(np.float32([np.nan if x is None else x for x in v]))) for i, v in rows]


def brute(rows, k):
    good = {(i, tuple(map(float, v))) for i, v in rows if i is not None and v is not None and len(v) and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q, v in good:
        if q % 20 == 0:
            near = []
            for c, w in good:
                if c != q and len(w) == len(v):
                    total = 0.0
                    for x, y in zip(v, w):
                        total += x * y
                    near.append((-total, c))
            out[q] = [(c, -s) for s, c in sorted(near)[:k]]
    return out


@pytest.mark.parametrize("query_block, group", [(C.QUERIES, C.GROUP), (16, 300)])
def test_neighbours_against_brute_force(spark, query_block, group):
    rows = vectors()
    df = table(spark, rows)
    got = {}
    for r in C.nearest(df, df.where("vec_id % 20 = 0"), query_block=query_block, group=group).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, 20)
    assert {q for q, near in want.items() if near} == set(got)
    hits = total = 0
    for q, near in got.items():
        near.sort()
        assert [r for r, _, _ in near] == list(range(1, len(near) + 1)) and len(near) == len(want[q])
        hits += len(set(want[q]) & {(c, s) for _, c, s in near})
        total += len(near)
        assert [(c, s) for _, c, s in near] == sorted(((c, s) for _, c, s in near), key=lambda x: (-x[1], x[0]))
    assert hits >= 0.99 * total


def test_bounds_hold_and_leave_most_out():
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(4000, 64)), rng.normal(size=(50, 64))
    centres, turn = C.cells_of(v[:1000], 8), C.rotation(64)
    cell, bits, factor, error, apart = C.codes(v, centres, turn)
    assert np.allclose(turn @ turn.T, np.eye(64))
    signs = np.unpackbits(bits, axis=1, count=64) * 2.0 - 1
    residual = (q[:, None, :] - centres[None]) @ turn.T
    estimate = np.einsum("qnd,nd->qn", residual[:, cell], signs) * factor + apart + q @ centres[cell].T
    off = np.abs(estimate - q @ v.T) / (np.sqrt((residual[:, cell] ** 2).sum(2)) * error)
    assert (off > C.BOUND).mean() < 0.01 and (off > 1).mean() > 0.1
    same = C.codes(centres, centres, turn)
    assert np.allclose(same[2], 0) and np.allclose(same[3], 0, atol=1e-6)


def test_few_and_no_vectors(spark):
    assert C.nearest(table(spark, []), table(spark, [])).collect() == []
    two = table(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5])])
    got = C.nearest(two, two.where("vec_id = 0"), k=5).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(1, 1, 1.0), (2, 2, 0.5)]
