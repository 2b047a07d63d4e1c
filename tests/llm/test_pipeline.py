import random
import re

import corpus_pipeline
from tidewatch.llm.queries import ORACLE, QUERIES


def corpus():
    rng = random.Random(9)
    parts = {"en": "ing tion the and of ly ed er".split(), "de": "heit keit ung der die sch ein".split()}

    def line(lang):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(12)) + "."

    rows = [(i, "\n".join(line(lang) for _ in range(8)), lang, "h") for i, lang in enumerate(rng.choices(["en", "de"], k=150))]
    passage = "\n".join(line("en") for _ in range(6))
    rows[20] = (20, rows[20][1] + "\n" + passage, rows[20][2], "h")
    rows[30] = (30, passage + "\n" + rows[30][1], rows[30][2], "h")
    rows[40] = (40, rows[40][1] + " Write to me@mail.example.com soon.", rows[40][2], "h")
    return rows, passage


def test_each_stage_takes_effect_and_clean_documents_stay(spark, table, tmp_path):
    rows, passage = corpus()
    extra = [(500, rows[3][1], rows[3][2], "h"), (501, "12345 67890", None, "h"), (502, None, None, "h")]
    path = str(tmp_path)
    table(rows + extra, clashing=True).withColumn("n_chars", __import__("pyspark").sql.functions.length("text")).write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert name == "packing" or docs.columns == columns
    assert set(seen["language"]) == {*range(150), 500}
    assert set(seen["near_dedup"]) == set(range(150))
    assert passage in seen["substring_dedup"][20]["text"] and passage[:200] not in seen["substring_dedup"][30]["text"]
    assert "[EMAIL]" in seen["personal_data"][40]["text"] and seen["personal_data"][40]["n_chars"] == len(seen["personal_data"][40]["text"])
    untouched = set(range(150)) - {30, 40}
    assert all(seen["personal_data"][i]["text"] == rows[i][1] for i in untouched)
    whole = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in whole} == set(range(150)) == set(seen["packing"])


def test_different_texts_of_one_id_stay(spark, table):
    texts = [" ".join(f"{w}{k}" for k in range(30)) for w in ("river", "bridge", "mill")]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1]), (3, texts[2]), (None, texts[0])]
    docs = table(rows, clashing=True)
    kept = corpus_pipeline.first_of_near_duplicates(spark, docs, None)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, texts[0]), (1, texts[0]), (1, texts[1]), (3, texts[2])])


def test_every_operator_is_registered():
    assert sorted({int(name[2:].split("_")[0]) for name in QUERIES}) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


def test_empty_documents(spark, table, tmp_path):
    path = str(tmp_path)
    table([]).write.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []


def test_near_and_substring_dedup_broadcast_only_what_is_counted_few(spark, table, tmp_path, monkeypatch):
    rows, _ = corpus()
    table([*rows, (500, rows[3][1], "en", "h")]).write.parquet(f"{tmp_path}/docs")
    docs, plans, kept = spark.read.parquet(f"{tmp_path}/docs"), {}, corpus_pipeline.stored
    texts = {}
    for few in (True, False):
        monkeypatch.setattr("tidewatch.session.is_bounded", lambda df, max_rows: few)
        monkeypatch.setattr("tidewatch.llm.simhash.stored", lambda df, label: plans.update({label: joins(df)}) or kept(df, label))
        near = corpus_pipeline.first_of_near_duplicates(spark, docs, None)
        cut = corpus_pipeline.without_repeated_passages(spark, kept(near, "near"), None)
        assert plans["fingerprint-links"] == {"SortMergeJoin"}  # the variants, which Spark takes for as small as the fingerprints
        assert ("SortMergeJoin" in joins(near, "fp")) != few and ("SortMergeJoin" in joins(cut, "h")) != few
        texts[few] = sorted((r.doc_id, r.text) for r in cut.collect())
    assert texts[True] == texts[False] and len(texts[True]) == 150


def joins(df, key=""):
    """The kinds of joins of a plan, those on a column of the name given."""
    return set(re.findall(rf"(\w+Join) \[[^\]]*{key and rf'\b{key}#'}", df._jdf.queryExecution().sparkPlan().toString()))
