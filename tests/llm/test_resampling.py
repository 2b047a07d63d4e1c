import hashlib
import math
import random
import re
import zlib

import pytest

from tidewatch.llm import radix, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target, percent=5):
    s, t = [0] * 10000, [0] * 10000
    for text in docs:
        for b in features(text[1])[1]:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log(float(a + 1) * float(sum(s) + 10000) / (float(b + 1) * float(sum(t) + 10000)))) for a, b in zip(t, s)]
    rows = []
    for i, text in docs:
        n, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def corpus(odd):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Über", "日本", "ABC"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([3, 19, 20, 21, 60, 400])))) for i in range(100, 300)]
    return list(odd) + rows + rows[:5] + [(7, rows[0][1]), (-9, rows[0][1])]


def test_draw_against_brute_force(spark, table, odd):
    rows = corpus(odd)
    target = [(1, None), (2, ""), *[(3 + i, " ".join(f"w{(7 * i + j) % 40}" for j in range(30))) for i in range(20)]]
    got = resampling.resample(table(rows, clashing=True), table(target, clashing=True), percent=30)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, [t for _, t in target], 30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_drawn_rows_keep_their_columns(table, odd):
    docs, target = table(corpus(odd), clashing=True), table([(1, "w1 w2 w3 w4")])
    ids = {r.doc_id for r in resampling.resample(docs, target, percent=10).collect() if r.rank}
    kept = resampling.drawn(docs, target, percent=10)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == ids


def test_empty_tables(table):
    assert resampling.resample(table([]), table([(1, "a b c")])).collect() == []
    assert [r.weight for r in resampling.resample(table([(1, "a")]), table([])).collect()] == [math.floor(1000 * math.log(10001 / 20000))]


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_pieces_of_a_text_give_the_same_features(monkeypatch, piece):
    rng = random.Random(2)
    texts = [" ,".join(rng.choices(["a", "bcd", "efghij", "日本語"], k=50)), "one", "", ";;; two words", "x" * 300]
    want = [features(t) for t in texts]
    monkeypatch.setattr(resampling, "PIECE", piece)
    for text, (n, found) in zip(texts, want):
        got_n, parts = resampling.feature_buckets(text)
        assert got_n == n and sorted(int(b) for p in parts for b in p) == sorted(found)


@pytest.mark.parametrize("block_bits, bits", [(2, 13), (8, 16), (20, 32)])
def test_ranks_are_those_of_a_sort(spark, block_bits, bits):
    rng = random.Random(block_bits)
    rows = [(rng.choice([-5, 0, 7, 10**7]), rng.randint(0, 40), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a long, b long, _rank long").repartition(7)
    got = radix.ranked(df, [("a", False), ("b", True), ("_rank", True)], bits=bits, block_bits=block_bits)
    want = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    assert [tuple(r)[:3] for r in sorted(got.collect(), key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 501))


def test_ranks_of_extreme_and_equal_keys(spark):
    ends = spark.createDataFrame([(2**63 - 1,), (-(2**63),), (0,), (-1,)], "k long")
    for up in (True, False):
        got = [r.k for r in sorted(radix.ranked(ends, [("k", up)]).collect(), key=lambda r: r["rank"])]
        assert got == sorted((r.k for r in ends.collect()), reverse=not up)
    same = radix.ranked(spark.createDataFrame([(3,)] * 9, "k long"), [("k", True)])
    assert sorted(r["rank"] for r in same.collect()) == list(range(1, 10))
    assert radix.ranked(ends.where("k is null"), [("k", True)]).collect() == []
