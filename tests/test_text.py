"""Text functions and narrative scores on edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch import session
from tidewatch.functions import text as X
from tidewatch.functions.columns import valid_text
from tidewatch.functions.text import words
from tidewatch.operators import scoring
from tidewatch.operators.groups import ordered_text
from tidewatch.operators.scoring import (
    dictionary_hits,
    dictionary_scores,
    dictionary_table,
    merged_frequencies,
    new_text_vectors,
    text_frequencies,
    token_features,
    passive_rule,
    passive_voice,
    sentiment,
    term_counts,
    text_vectors,
    token_statistics,
    tokens,
)
from tidewatch.session import parts_of, scratch_path
from tidewatch.sources.dictionaries import feature_names, liwc_dictionary, read_dictionary

TEXTS = [
    (1, "The valve was closed, slowly; the VALVE!"), (2, ""), (3, None), (4, "None"), (5, "..."),
    (6, "Élève déjà-vu l’eau"), (7, "in the in the end"), (8, "NoneNone"), (9, "theatre thesis the them"),
]
ENTRIES = [
    ("d", "det", "the"), ("d", "th", "the*"), ("d", "th", "thesis"), ("d", "both", "valve"), ("e", "both", "VALVE"),
    ("e", "place", "in the"), ("e", "place", "the in"), ("e", "open", "val*"), ("e", "none", "zzz"), ("e", "long", "in the en*"),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "eid int, text string").cache()


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, "dict string, category string, pattern string")


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("r")).first()["r"]


def test_valid_text(spark, texts):
    assert [r["eid"] for r in texts.filter(valid_text("text", ("None",))).orderBy("eid").collect()] == [1, 5, 6, 7, 8, 9]
    broken = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xff\xfe"),)], "b binary").select(F.col("b").cast("string").alias("text"))
    assert broken.filter(valid_text("text")).count() == 1


@pytest.mark.parametrize(
    "function, extra, value, want",
    [
        (X.count_word_runs, (), "Élève d’eau, 2 a_b", 5), (X.count_blank_separated, (), "  a  b\n c ", 3),
        (X.count_blank_separated, (), "   ", 0), (X.remove_all, ("NoneNone",), "aNoneNonebNoneNone", "ab"),
        (X.remove_first, ("n/a",), "x\nn/a n/a", "x\n n/a"), (X.remove_first, ("A.",), "AB A.", "AB "),
        (X.remove_at_end, ("None",), "None at None", "None at "), (X.read_month, (), "202313", None),
    ],
)
def test_row_functions(spark, function, extra, value, want):
    assert one(spark, function("x", *extra), value) == want


def test_dates(spark):
    got = [str(one(spark, c, v)) for c, v in (
        (X.read_mdy("x"), "3/7/2004"), (X.read_ymd("x"), "2004-03-07"), (X.read_month("x"), "200403"), (X.read_mdy("x"), "31/1/2004"))]
    assert got == ["2004-03-07", "2004-03-07", "2004-03-01", "None"]


def test_tokens(texts):
    rows = {}
    for r in tokens(texts, "eid", "text").collect():
        rows.setdefault(r["eid"], []).append((r["pos"], r["token"]))
    assert [t for _, t in sorted(rows[6])] == ["élève", "déjà-vu", "l’eau"]
    assert 2 not in rows and 3 not in rows and 5 not in rows
    stats = {r["eid"]: (r["tokens"], r["types"]) for r in token_statistics(texts, "eid", "text").collect()}
    assert stats[7] == (5, 3) and stats[3] == (0, 0)


def test_dictionary(texts, entries):
    got = {r["eid"]: r.asDict() for r in dictionary_scores(texts, "eid", "text", entries).collect()}
    assert len(got) == len(TEXTS)
    pick = lambda eid: {k: v for k, v in got[eid].items() if k[:2] in ("d_", "e_") and v}
    assert pick(1) == {"d_det": 2, "d_th": 2, "d_both": 2, "e_both": 2, "e_open": 2}
    assert pick(7) == {"d_det": 2, "d_th": 2, "e_place": 3, "e_long": 1}
    # a word that matches a literal and a wildcard of one category counts once
    assert pick(9) == {"d_det": 1, "d_th": 4}
    assert pick(3) == pick(2) == pick(5) == {} and got[3]["e_none"] == 0


def test_dictionary_too_long_to_broadcast(texts, entries, monkeypatch):
    want = {(r["eid"], r["feature"], r["n"]) for r in dictionary_hits(texts, "eid", "text", entries).collect()}
    monkeypatch.setattr("tidewatch.operators.scoring.is_bounded", lambda df: False)
    got = {(r["eid"], r["feature"], r["n"]) for r in dictionary_hits(texts, "eid", "text", entries).collect()}
    assert got == want


def test_dictionary_files(spark):
    path = scratch_path(spark, "dic") + ".dic"
    lines = ["%", "1\tone", "2\ttwo", "%", "aa*\t1\t2", "bb\t2", ""]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    rows = {(r["category"], r["pattern"]) for r in liwc_dictionary(spark, path, "d").collect()}
    assert rows == {("one", "aa*"), ("two", "aa*"), ("two", "bb")}
    csv = scratch_path(spark, "dic") + ".csv"
    spark.createDataFrame([("one", "x")], "category string, pattern string").write.option("header", True).csv(csv)
    assert [tuple(r) for r in read_dictionary(spark, csv, "d").collect()] == [("d", "one", "x")]
    names = spark.createDataFrame([("gi_", "a", None), ("gi_", "a", None), (None, "b", None), ("gi_", "c", "x")],
                                  "prefix string, variables string, drop string")
    assert {r[0] for r in feature_names(names).collect()} == {"gi_a", "b"}


@pytest.mark.parametrize(
    "text, count",
    [
        ("The valve was closed by hand", 1), ("It is being repaired", 1), ("The door has opened", 0),
        ("He got hit", 1), ("She was happy", 0), ("It was quickly and quietly taken", 0),
        ("It was very quietly slowly broken", 0), ("It was not quickly found; parts were lost", 2), ("", 0),
    ],
)
def test_passive(spark, text, count):
    df = spark.createDataFrame([(text,)], "text string").select(X.words("text").alias("w"))
    assert df.select(passive_rule(F.col("w"))).first()[0] == count


def test_passive_ratio(texts):
    got = {r["eid"]: r["PV_aux_pas"] for r in passive_voice(texts, "text").collect()}
    assert got[1] == pytest.approx(1 / 7) and got[2] is None and got[7] == 0.0


def test_sentiment(spark):
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "token string, valence double")
    cases = {1: "good", 2: "very good", 3: "not good", 4: "GOOD day", 5: "good!!!!!!", 6: "bad", 7: "", 8: None,
             9: "the day", 10: "slightly bad", 11: "GOOD"}
    df = spark.createDataFrame(list(cases.items()), "eid int, text string")
    got = {r["eid"]: r for r in sentiment(df, "eid", "text", lexicon).collect()}
    comp = lambda s: s / np.sqrt(s * s + 15)
    want = {1: 1.9, 2: 1.9 + 0.293, 3: 1.9 * -0.74, 4: 1.9 + 0.733, 5: 1.9 + 4 * 0.292, 6: -2.5, 7: 0, 8: 0, 9: 0,
            10: -2.5 + 0.293, 11: 1.9}
    for eid, s in want.items():
        assert got[eid]["compound"] == pytest.approx(comp(s)), eid
    assert got[9]["neu"] == 1.0 and got[1]["pos"] == 1.0 and got[7]["neu"] == 0.0
    assert got[2]["pos"] + got[2]["neu"] == pytest.approx(1.0)


def test_terms_and_vectors(spark):
    df = spark.createDataFrame([(1, "The cats opened the doors"), (2, "a cat opens doors"), (3, "")], "eid int, text string")
    terms = {(r["eid"], r["term"], r["n"]) for r in term_counts(df, "eid", "text").collect()}
    assert terms == {(1, "cat", 1), (1, "open", 1), (1, "door", 1), (2, "cat", 1), (2, "open", 1), (2, "door", 1)}
    v = {r["eid"]: np.array(r["embedding"]) for r in text_vectors(df, "eid", "text", 32).collect()}
    assert set(v) == {1, 2, 3} and all(len(x) == 32 for x in v.values())
    assert np.linalg.norm(v[1]) == pytest.approx(1.0)
    stored = spark.createDataFrame([(1,)], "eid int")
    assert [r["eid"] for r in new_text_vectors(df, stored, "eid", "text", dim=32).orderBy("eid").collect()] == [2, 3]


def test_vectors_of_batches_equal_those_of_one_run(spark, tmp_path):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["red", "green", "blue", "door", "pump", "valve"], size=n)) for n in rng.integers(0, 9, 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "eid int, text string")
    state, seen = str(tmp_path / "state"), spark.createDataFrame([], "eid int")
    options = dict(key="eid", text="text", frequencies_path=state, dim=16)
    first = new_text_vectors(df.filter("eid < 15"), seen, batch="a", **options)
    assert first.count() == 15
    second = new_text_vectors(df, first, batch="b", **options)
    again = new_text_vectors(df, first, batch="b", **options)  # a batch stored again replaces itself
    whole = {r["eid"]: r["embedding"] for r in text_vectors(df, "eid", "text", 16).collect()}
    for got in (second, again):
        rows = {r["eid"]: r["embedding"] for r in got.collect()}
        assert set(rows) == set(range(15, 40))
        for i, v in rows.items():
            assert v == pytest.approx(whole[i], abs=1e-12)
    # texts of a later batch alone would be weighed differently
    alone = {r["eid"]: r["embedding"] for r in text_vectors(df.filter("eid >= 15"), "eid", "text", 16).collect()}
    assert any(np.abs(np.array(alone[i]) - whole[i]).max() > 1e-3 for i in alone)
    apart = merged_frequencies(text_frequencies(df.filter("eid < 15"), "eid", "text", 16), text_frequencies(df.filter("eid >= 15"), "eid", "text", 16))
    assert {tuple(r) for r in apart.collect()} == {tuple(r) for r in text_frequencies(df, "eid", "text", 16).collect()}


def test_large_dictionaries_match_small_ones(spark):
    df = spark.createDataFrame([(1, "the theatre thaws thrice"), (2, "a an and at ate the"), (3, ""), (4, None), (5, "of the thorn of the")], "eid int, text string")
    words = [("d", "one", "t*"), ("d", "one", "th*"), ("d", "the", "the"), ("e", "the", "the*"), ("e", "a", "a*"), ("e", "pair", "of th*"), ("e", "none", "zz*")]
    patterns = spark.createDataFrame(words, "dict string, category string, pattern string")
    few, many = ({tuple(r) for r in dictionary_hits(df, "eid", "text", patterns, n).collect()} for n in (1000, 0))
    assert few == many and (1, "d_one", 4) in many and (5, "e_pair", 2) in many
    vocabulary = spark.createDataFrame([("theatre",), ("t",)], "token string")
    table = dictionary_table(patterns)
    feature = F.concat_ws("_", "dict", "category").alias("feature")
    literals = table.filter(~F.col("is_prefix")).select(F.col("stem").alias("token"), feature)
    found = token_features(vocabulary, literals, table.filter("is_prefix").select("stem", "n_tokens", feature))
    assert {tuple(r) for r in found.collect()} == {("theatre", "d_one"), ("theatre", "e_the"), ("t", "d_one")}


def test_ordered_text(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None)], "g int, t int, text string")
    assert ordered_text(df, ["g"], ["t"], "text", "all").first()["all"] == "a b"


def test_a_text_without_words_has_a_zero_vector(spark):
    df = spark.createDataFrame([(1, "one two"), (2, ""), (3, None), (4, "!?")], "eid int, text string")
    got = {r["eid"]: r["embedding"] for r in text_vectors(df, "eid", "text", dim=8).collect()}
    assert sorted(got) == [1, 2, 3, 4] and any(got[1]) and all(got[i] == [0.0] * 8 for i in (2, 3, 4))


def test_parts_of_term_counts_follow_the_length_of_the_texts(spark, monkeypatch):
    docs = spark.range(300).select("id", F.concat_ws(" ", F.lit("reports"), F.repeat(F.lit("engine stopped "), 40), F.col("id")).alias("text"))
    usual = {tuple(r) for r in scoring.term_counts(docs, "id", "text").collect()}
    monkeypatch.setattr(scoring, "parts_of", lambda df, text: parts_of(df, text, 5_000))
    small = scoring.term_counts(docs, "id", "text")
    assert small.rdd.getNumPartitions() == math.ceil(session.text_bytes(docs, ["text"]) / 5_000) > 30
    assert {tuple(r) for r in small.collect()} == usual and len(usual) == 1200


def test_words_of_texts_stay_where_they_are_while_few_fit_a_long_dictionary(spark):
    docs = spark.createDataFrame([(1, "the thin thing in the end"), (2, "thin air"), (3, None)], "id long, text string")
    patterns = spark.createDataFrame([("a", "x", "th*"), ("a", "y", "the"), ("a", "z", "in the"), ("b", "x", "t*")], "dict string, category string, pattern string")
    found = scoring.dictionary_hits(docs, "id", "text", patterns, broadcast_rows=0)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().sparkPlan().toString()
    expected = sorted({tuple(r) for r in scoring.dictionary_hits(docs, "id", "text", patterns).collect()})
    assert sorted(tuple(r) for r in found.collect()) == expected and (1, "a_z", 1) in expected
    texts = docs.select("id", F.explode(words("text")).alias("token"))
    table = scoring.dictionary_table(patterns).filter("n_tokens = 1")
    feature = F.concat_ws("_", "dict", "category").alias("feature")
    sides = table.filter("NOT is_prefix").select(F.col("stem").alias("token"), feature), table.filter("is_prefix").select("stem", "n_tokens", feature)
    ways = [sorted(tuple(r) for r in scoring._hits_by_vocabulary(texts, "id", *sides, n).collect()) for n in (0, 100)]
    assert ways[0] == ways[1] and (1, "b_x", 4) in ways[0]


def test_only_rare_words_of_texts_move_to_a_long_dictionary(spark, monkeypatch):
    rare = [(i, f"the thin thing in the end of them t{i} x{i}") for i in range(60)]
    docs = spark.createDataFrame([*rare, (60, "in the"), (61, None), (None, "of them")], "id long, text string")
    patterns = spark.createDataFrame([("a", "x", "th*"), ("a", "y", "the"), ("a", "z", "in the"), ("a", "z", "of th*"), ("b", "x", "t*"), ("b", "y", "x1*"), ("b", "z", "zebra")], "dict string, category string, pattern string")
    usual = sorted(map(str, scoring.dictionary_hits(docs, "id", "text", patterns).collect()))
    made, kept, ways = {}, session.stored, []
    hits = scoring._hits_by_vocabulary

    def seen(df, label):
        made[label] = kept(df, label)
        return made[label]

    monkeypatch.setattr(scoring, "stored", seen, raising=False)
    for most in (200, 20, 0):  # all words are frequent, those of all texts are, or none
        monkeypatch.setattr(scoring, "_hits_by_vocabulary", lambda *sides: hits(*sides, most))
        made.clear()
        assert sorted(map(str, scoring.dictionary_hits(docs, "id", "text", patterns, broadcast_rows=0).collect())) == usual
        phrases = {r["token"] for r in made["vocabulary"].collect() if " " in r["token"]}
        assert phrases == {"in the", "of them"}  # no others begin with the first word of a pattern of two
        moved = made.get("hits-and-rare-words")
        ways.append({r["token"] for r in moved.filter("token IS NOT NULL").collect()} if moved else None)
    own = {f"{c}{i}" for i in range(60) for c in "tx"}
    assert ways[0] is None and ways[1] == own and ways[2] == own | phrases | set("the thin thing in end of them".split())


def test_vocabulary_is_not_broadcast_to_a_long_dictionary(spark, monkeypatch):
    words_ = session.stored(spark.createDataFrame([("the",), ("thin",), ("of them",)], "token string"), "vocabulary")  # a small file
    table = scoring.dictionary_table(spark.createDataFrame([("a", "x", "th*"), ("a", "y", "the")], "dict string, category string, pattern string"))
    sides = table.filter("NOT is_prefix").select(F.col("stem").alias("token"), F.lit("y").alias("feature")), table.filter("is_prefix").select("stem", "n_tokens", F.lit("x").alias("feature"))
    monkeypatch.setattr(scoring, "is_bounded", lambda df: False)
    found = token_features(words_, *sides)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan
    assert sorted(tuple(r) for r in found.collect()) == [("the", "x"), ("the", "y"), ("thin", "x")]
