import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import language, toxicity

ENDINGS = {"aa": "ing tion the and of ly ed".split(), "bb": "heit keit ung der die sch".split(), "cc": "ción ado que los mente es".split()}


def sentence(rng, lang, words=25):
    return " ".join("".join(rng.choice(ENDINGS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


def test_subwords_against_brute_force():
    texts = ["ab c", "", "éa1b", "x", "LONGER word, and: more"]
    raw, borders = language.lowered(pa.array(texts))
    found, owner = language.subword_buckets(raw, borders, 1 << 16)
    for i, text in enumerate(texts):
        coded = b"\0" + bytes(int(language.LETTERS[c]) for c in text.lower().encode()) + b"\0"
        want = []
        for size in language.SUBWORDS:
            for at in range(len(coded) - size + 1):
                part = coded[at : at + size]
                if 0 in part[1:-1] or part[0] == part[-1] == 0:
                    continue
                value = int.from_bytes(part, "big") ^ (size << 40)
                want.append((value * int(language.SPREAD) & (2**64 - 1)) >> 48)
        assert sorted(found[owner == i].tolist()) == sorted(want)


def test_language_of_held_out_texts(table, odd):
    rng = random.Random(3)
    rows = [(i, sentence(rng, lang), lang, "h") for i, lang in enumerate(rng.choices(list(ENDINGS), k=400))]
    model = language.fit(table(rows[:250]))
    docs = table(rows[250:] + [(9000 + i, t) for i, (_, t) in enumerate(odd)], clashing=True)
    got = {r.doc_id: r for r in language.identify(docs, model, keep=["doc_id", "lang"]).collect()}
    right = [got[i].lang_pred == lang for i, _, lang, _ in rows[250:]]
    assert np.mean(right) > 0.97
    assert np.mean([got[i].accepted for i, *_ in rows[250:]]) > 0.97
    for i in (9000, 9001, 9002):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_no_labelled_text_means_und(table):
    docs = table([(1, "some words"), (2, None)])
    model = language.fit(docs)
    assert model is None
    assert {r.lang_pred for r in language.identify(docs, model).collect()} == {"und"}
    assert language.identify(table([]), model).collect() == []


def toxic_rows(rng, n):
    """Label 1 needs an insult and a mention of the group, which neither alone makes."""
    rows = []
    for i in range(n):
        words = [f"word{rng.randint(0, 60)}" for _ in range(20)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["scum"] * insult + ["neighbours"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def test_factors_learn_what_two_terms_mean_together(spark, table):
    rows = toxic_rows(random.Random(4), 900)
    docs = table([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:600]] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model, keep=["doc_id"]).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows[600:]]) > 0.9
    alike = toxicity.ToxicityModel(model.place, model.weight, model.factors * 0, model.bias, model.slope, model.shift)
    linear = {r.doc_id: r.predicted for r in toxicity.score(docs, alike, keep=["doc_id"]).collect()}
    assert np.mean([linear[i] == y for i, _, y in rows[600:]]) < np.mean([got[i].predicted == y for i, _, y in rows[600:]])


def test_many_rare_groups_are_learned_with_many_insults():
    rng = random.Random(5)
    letters = "bcdfghjklmnprstvwz"
    names = ["".join(x) for x in {tuple(rng.choice(letters) for _ in range(7)): 0 for _ in range(80)}]
    insults, groups = names[:10], names[10:40]

    def text():
        words = [f"word{rng.randint(0, 60)}" for _ in range(20)]
        insult, group = rng.random() < 0.1, rng.random() < 0.3
        words += [rng.choice(insults)] * insult + [rng.choice(groups)] * group
        rng.shuffle(words)
        return " ".join(words), insult, group

    def term_sets(rows):
        owner, term = toxicity.terms(pa.array([t for t, *_ in rows]))
        cuts = np.searchsorted(owner, np.arange(len(rows) + 1))
        return [(int(i and g), term[a:b]) for (_, i, g), a, b in zip(rows, cuts, cuts[1:], strict=False)]

    rows = [text() for _ in range(6400)]
    kept = set(toxicity.kept_terms(term_sets(rows), toxicity.TERMS).tolist())
    held = [set(toxicity.terms(pa.array([w]))[1].tolist()) <= kept for w in groups]
    assert sum(held) >= 26
    model = toxicity.train(term_sets(rows))
    later = [r for r in (text() for _ in range(6000)) if r[1]]
    score = model.scores(pa.array([t for t, *_ in later])) >= 0.5
    assert np.mean(score == np.array([g for *_, g in later])) > 0.85


def test_scores_are_the_machines_formula():
    rng = np.random.default_rng(0)
    place = np.full(toxicity.BUCKETS, -1)
    texts = pa.array(["one two three", "three four", "", None])
    owner, term = toxicity.terms(texts)
    known = np.unique(term)
    place[known] = np.arange(len(known))
    model = toxicity.ToxicityModel(place, rng.normal(size=len(known)), rng.normal(size=(len(known), 3)), -0.3, 1.5, 0.2)
    got = model.scores(texts)
    for i in range(4):
        at = place[term[owner == i]]
        raw = model.bias + model.weight[at].sum() + sum(model.factors[a] @ model.factors[b] for k, a in enumerate(at) for b in at[k + 1 :])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(1.5 * raw + 0.2))))


def test_toxicity_without_labels_and_of_odd_rows(spark, table, odd):
    docs = table(odd, clashing=True)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, none), keep=["doc_id"]).collect()
    assert len(rows) == len(odd) and all(r.score < 1e-9 and r.predicted == 0 for r in rows)
    ones = spark.createDataFrame([(2, 1), (3, 1)], "doc_id bigint, toxic int")
    assert all(r.predicted == 1 for r in toxicity.score(docs, toxicity.fit(docs, ones)).collect())
    assert toxicity.score(table([]), toxicity.fit(table([]), none)).select(F.col("score")).collect() == []
