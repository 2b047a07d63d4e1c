"""Sources, column shaping and the registry on edge cases."""

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.functions.vectors import cosine, read_vector, to_vector, unit_vector, write_vector
from tidewatch.operators import joins as J
from tidewatch.operators.groups import date_spine, groups_of_size, histogram, with_group_end
from tidewatch.plans.measures import source_similarity
from tidewatch.session import require_columns, scratch_path, shared_dir
from tidewatch.sources.dictionaries import liwc_dictionary
from tidewatch.sources.pages import REPORT_FIELDS, anchors, by_id, by_tag, extract_fields, narratives, split_bad
from tidewatch.sources.readers import read_csv, read_many, read_two_line_header, union_by_name
from tidewatch.tables import registry as R
from tidewatch.tables.writers import append, export_csv, load_stage, save_stage


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "`Event Num` int, `event.num` double, gi_a string")
    assert C.clean_names(df).columns == ["event_num", "event_num_2", "gi_a"]
    assert C.pick(df, numeric=True) == ["Event Num", "event.num"]
    assert C.pick(df, names=("gi_a", "event.num")) == ["gi_a", "event.num"]
    with pytest.raises(ValueError):
        C.pick(df, names=("nope",))
    assert C.relocate(df, "gi_a").columns[0] == "gi_a"
    assert C.with_prefix(df, "p_", ["gi_a"]).columns[-1] == "p_gi_a"
    with pytest.raises(ValueError):
        require_columns(df, ["a", "gi_a"])


def test_harmonise(spark):
    df = spark.createDataFrame([("1/2/2020", 7, "t")], "Date string, `Accident.Number` int, Narrative string")
    got = C.harmonise_keys(df, "rail")
    assert got.columns == ["event_date", "event_num", "event_text"] and got.first()["event_num"] == "7"
    with pytest.raises(ValueError):
        C.harmonise_keys(df, "moon")


def test_recodes(spark):
    df = spark.createDataFrame([("A",), ("b",), (None,)], "x string")
    assert {r[0] for r in C.recode(df, "x", {"a": "z"}, lower=True).collect()} == {"b", "z", None}
    got = [r[0] for r in df.select(C.two_way(F.col("x") == "A", 1, 0)).collect()]
    assert got == [1, 0, None]
    table = spark.createDataFrame([("A", "q")], "old string, new string")
    assert {r[0] for r in C.recode_by_table(df, "x", table).collect()} == {"q", "b", None}
    levels = spark.range(11).select(C.by_ranges("id", [(1, 2, 1), (3, 5, 2), (6, 9, 3)]))
    assert [r[0] for r in levels.collect()] == [None, 1, 1, 2, 2, 2, 3, 3, 3, 3, None]
    share = spark.createDataFrame([(1, 2, 4), (1, 2, 0)], "gi_a int, gi_b int, wc int")
    assert rows(C.to_share(share, "gi_", "wc")) == [(0.25, 0.5), (None, None)]


def test_headers_and_files(spark):
    path = scratch_path(spark, "two")
    lines = ["Time,Place,X", " Date, Name, y", ",,", '202301,"a, b",1', "202302,c,2"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    df = read_two_line_header(spark, path, skip=3, columns=2)
    assert df.columns == ["Time Date.", "Place Name."] and rows(df) == [("202301", "a, b"), ("202302", "c")]
    out = scratch_path(spark, "csv")
    wild = spark.createDataFrame([(1, 'say "hi",\nthen go'), (2, None)], "id int, text string")
    export_csv(wild, out)
    assert rows(read_csv(spark, out, "id int, text string")) == rows(wild)
    assert read_csv(spark, out).schema["id"].dataType.simpleString() == "int"
    tree = scratch_path(spark, "tree")
    for part in ("a", "b/c"):
        spark.range(2).write.option("header", True).csv(f"{tree}/{part}")
    many = read_many(spark, tree, "id long", provenance="file")
    assert many.count() == 4 and many.select("file").distinct().count() >= 2
    u = union_by_name([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")])
    assert rows(u) == [(1, None), (None, 2)]


def test_pages(spark):
    page = "".join(f'<span id="{i}"> {n} &amp; <b>x</b></span>' for n, i in REPORT_FIELDS.items())
    broken = page.replace('id="ContentPlaceHolderMainPageContent_Label1State"', "")
    df = spark.createDataFrame([(1, page), (2, broken), (3, None)], "page_id int, html string")
    fields = extract_fields(df, "html", {n: by_id(i) for n, i in REPORT_FIELDS.items()})
    good, bad = split_bad(fields, list(REPORT_FIELDS))
    assert good.select("page_id", "facility", "event_text").collect() == [(1, "facility & x", "event_text & x")]
    assert rows(bad.select("page_id")) == [(2,), (3,)]


def test_sections_and_anchors(spark):
    end1 = "PART VII - RECOMMENDATIONS/ACTIONS TAKEN TO PREVENT RECURRENCE"
    start2, end2 = "individual company. Continue on additional sheets if necessary.", "PART VIII – CONTACT INFORMATION"
    text = f"Describe: first {end1} x Describe:\n second {end1} {start2} Describe: third \n{end2}"
    df = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "id int, report string")
    got = narratives(df, "report").select("id", "narrative1", "narrative2")
    assert rows(got) == [(1, "second", "third"), (2, "", ""), (3, "", "")]
    cell = '<A HREF = http://x/y?a=1 target="_blank">E-1</A>'
    links = anchors(spark.createDataFrame([(cell,), ("E-2",)], "c string"), "c")
    assert rows(links.select("report_no", "doc_link")) == [("E-1", "http://x/y?a=1")]


def test_joins(spark):
    a = spark.createDataFrame([(None, 1), ("k", 2)], "k string, x int")
    b = spark.createDataFrame([(None, 3), ("m", 4)], "k string, y int")
    assert rows(J.full_join_null_safe(a, b, ["k"])) == sorted([(None, 1, 3), ("k", 2, None), ("m", None, 4)], key=str)
    left = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "i int, x string")
    right = spark.createDataFrame([(30, "C"), (10, "A"), (20, "B")], "j int, y string")
    assert rows(J.bind_columns(left, right, ["i"], ["j"]).select("x", "y")) == [("a", "A"), ("b", "B"), ("c", "C")]
    with pytest.raises(ValueError):
        J.bind_columns(left, right.limit(2), ["i"], ["j"])
    assert rows(J.align_by_ordinal(left, right.limit(1), ["i"], ["j"]).select("x", "y"))[1:] == [("b", None), ("c", None)]


def test_registry(spark):
    base = spark.createDataFrame([("nrc", "2020-01-01", "1")], "system_source string, event_date string, event_num string")
    base = base.withColumn("event_date", F.to_date("event_date")).withColumn("eid", R.event_id())
    events = spark.createDataFrame([("1", "2020-01-01"), ("2", "2020-01-02"), ("2", "2020-01-05"), (None, "2020-01-03")],
                                   "event_num string, event_date string")
    nrc = R.register(base, events, "nrc")
    assert nrc.count() == 2 and R.register(nrc, events, "nrc").count() == 2
    both = R.register(nrc, events, "rail")
    assert both.count() == 4 and both.select("eid").distinct().count() == 4
    got = R.with_event_ids(both, events, "rail")
    assert got.columns[0] == "eid" and got.count() == 4 and got.filter("eid IS NULL").count() == 1
    named = R.disambiguate(events.na.drop(), "event_num", ["event_date"])
    assert rows(named.select("event_num", "event_num_orig")) == [("1_1", "1"), ("2_1", "2"), ("2_2", "2")]


def test_upsert_and_integrity(spark):
    reg = spark.createDataFrame([("s", "1", "e1"), ("s", "2", "e2"), ("s", "2", "e3"), ("s", "4", "e4")],
                                "system_source string, event_num string, eid string")
    target = spark.createDataFrame([("e1", 1), ("e2", 2), ("e4", 4)], "eid string, v int")
    updates = spark.createDataFrame([("s", "1", 10), ("s", "2", 20), ("s", "9", 90), ("s", "4", 40), ("s", "4", 41)],
                                    "system_source string, event_num string, v int")
    new, bad = R.upsert_column(target, updates, reg, "v")
    assert rows(new) == [("e1", 10), ("e2", 2), ("e4", 4)]
    assert rows(bad) == [("s", "2", 1, 2), ("s", "4", 2, 1), ("s", "9", 1, 0)]
    more = spark.createDataFrame([("s", "1", None), ("s", "5", 50)], "system_source string, event_num string, v int")
    wide_reg = reg.union(spark.createDataFrame([("s", "5", "e5")], reg.schema))
    new, bad = R.upsert_column(target, more, wide_reg, "v")
    assert rows(new) == [("e1", None), ("e2", 2), ("e4", 4)] and rows(bad) == [("s", "5", 1, 1)]
    t = spark.createDataFrame([("e1", [1.0]), ("e1", [1.0, 2.0]), ("x", None), (None, [1.0])], "eid string, vec array<double>")
    found = {(r["rule"], r["key"]) for r in R.violations(t, reg, vector_sizes={"vec": 1}).collect()}
    assert found == {("primary key", "e1"), ("primary key", None), ("foreign key", "x"), ("foreign key", None), ("length of vec", "e1")}
    wide = R.add_column(R.add_column(target, "gi_vec", "array<double>"), "v", "int")
    assert wide.columns == ["eid", "v", "gi_vec"]
    assert rows(R.remaining(target, t, "eid").select("eid")) == [("e2",), ("e4",)]
    assert R.from_row(target, ["eid"], 3).collect() == [("e4", 4)]


def test_stages(spark):
    base = scratch_path(spark, "stages")
    assert save_stage(spark.range(3), base, "nrc", 5, "x").count() == 3
    assert load_stage(spark, base, "nrc", 5, "x").count() == 3
    path = scratch_path(spark, "append")
    append(spark.range(2), path)
    append(spark.range(3), path)
    assert spark.read.parquet(path).count() == 5
    assert shared_dir(spark) == shared_dir(spark)


def test_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, x int")
    assert groups_of_size(df, ["g"], 2).count() == 2
    assert rows(with_group_end(df, ["g"]).filter("group_end")) == [("a", None, True), ("b", None, True)]
    days = spark.createDataFrame([("2024-01-01", 1), ("2024-01-03", 2)], "d string, n int").withColumn("d", F.to_date("d"))
    assert [r["n"] for r in date_spine(days, "d").orderBy("d").collect()] == [1, None, 2]
    assert rows(histogram(df, "x", 0.0, 4.0, 2)) == [(1, 1), (2, 2)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0], [0.0, 0.0], None)],
                               "a array<double>, b array<double>, z array<double>, n array<double>")
    r = df.select(cosine("a", "b").alias("same"), cosine("a", "z").alias("zero"), cosine("a", "z", 0.0).alias("zero0"),
                  cosine("a", "n").alias("null"), unit_vector("a").alias("u"), unit_vector("z").alias("uz"),
                  read_vector(write_vector("a")).alias("back"), write_vector("n").alias("wn")).first()
    assert r["same"] == pytest.approx(1.0) and r["zero"] is None and r["zero0"] == 0.0 and r["null"] is None
    assert r["u"] == pytest.approx([0.6, 0.8]) and r["uz"] == [0.0, 0.0] and r["back"] == [3.0, 4.0] and r["wn"] is None
    cols = spark.createDataFrame([(1, 2.5), (None, 1.0)], "x int, `y.z` double").select(to_vector(["x", "y.z"]).alias("v"))
    assert [r["v"] for r in cols.collect()] == [[1.0, 2.5], None]


def test_event_ids_do_not_collide(spark):
    keys = spark.createDataFrame([("a", "b|c"), ("a|b", "c"), ("a\\", "|b"), ("a", None), (None, "a")], "system_source string, event_num string")
    ids = [r["i"] for r in keys.select(R.event_id().alias("i")).collect()]
    assert len(set(ids[:3])) == 3 and ids[3:] == [None, None]


def test_two_line_header_drops_by_place(spark, tmp_path):
    (tmp_path / "t.csv").write_text('"First, of",Last\n col, col\n,\n1,x\n,\n"First, of",Last\n2,"y, ""z"""\n')
    got = read_two_line_header(spark, str(tmp_path / "t.csv"), skip=3)
    assert got.columns == ["First, of col.", "Last col."]
    assert [tuple(r) for r in got.collect()] == [("1", "x"), (None, None), ("First, of", "Last"), ("2", 'y, "z"')]


def test_dictionary_patterns_may_be_numbers(spark, tmp_path):
    (tmp_path / "d.dic").write_text("%\n1\tanger\n2\tcalls\n%\n911\t2\nhate*\t1\t2\n")
    got = liwc_dictionary(spark, str(tmp_path / "d.dic"), "d")
    assert sorted((r["category"], r["pattern"]) for r in got.collect()) == [("anger", "hate*"), ("calls", "911"), ("calls", "hate*")]


def test_an_element_ends_at_its_own_closing_tag(spark):
    html = [
        '<div id="x">a<div>b<DIV class="q">c</div></div>d<br/></div>e</div>', '<p id="x">one</p><p>two</p>',
        '<div id="x">never closed', "nothing", None, '<div id="x"><div/>self</div>rest',
    ]
    pages = spark.createDataFrame([(h,) for h in html], "html string")
    got = [r["f"] for r in extract_fields(pages, "html", {"f": by_id("x")}).collect()]
    assert got == ["abcd", "one", None, None, None, "self"]


def test_many_tags_and_fields_of_a_page(spark):
    deep = '<p id="a">' + "<p>x" * 3000 + "</p>" * 3000 + "end</p>" + "<q>y</q>" * 3000 + "<Q data='>'>last"
    pages = spark.createDataFrame([(deep,), ('<i\nid="b"\n>one</i><a id="c">two</A >',)], "html string")
    fields = {"a": by_id("a"), "b": by_id("b"), "c": by_id("c"), "q": by_tag("q"), "none": by_tag("table")}
    got = extract_fields(pages, "html", fields).collect()
    assert got[0]["a"] == "x" * 3000 + "end" and got[0]["q"] == "y" and got[0]["none"] is None and got[0]["b"] is None
    assert (got[1]["b"], got[1]["c"], got[1]["a"]) == ("one", "two", None)


def test_key_checks_deal_keys_out_by_their_number(spark):
    """The more keys, the more parts, whatever their bytes; repeated, missing and unknown keys are found."""
    table = spark.range(1000).select((F.col("id") % 900).alias("eid")).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    found = R.violations(table, spark.range(850).select(F.col("id").alias("eid")), part_rows=50)
    assert found.rdd.getNumPartitions() == 2 * 21
    rows = {(r.rule, r.key): r.n for r in found.collect()}
    expected = {("primary key", str(i)): 2 for i in range(100)} | {("primary key", None): 1}
    assert rows == expected | {("foreign key", str(i)): 1 for i in range(850, 900)} | {("foreign key", None): 1}


def test_long_texts_are_bound_in_short_blocks(spark):
    left = spark.range(400).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    right = spark.range(400).select((F.col("id") * 3).alias("place"), (F.col("id") + 7).alias("score"))
    assert J.rows_in_block(left, 400, 20_000) == 19 and J.rows_in_block(right, 400, 20_000) == 1250
    sizes = J.in_order(left, [], ["id"], ordinal="_row", block_rows=19, longest=400).rows.groupBy("_row").count().count()
    bound = J.bind_columns(left, right, ["id"], ["place"], block_bytes=20_000)
    assert sizes == 400 and [(r.id, r.score) for r in bound.orderBy("id").collect()] == [(i, i + 7) for i in range(400)]


@pytest.mark.parametrize("block_rows", [20, 1000])
def test_shared_vectors_give_the_same_similarities(spark, block_rows):
    """Ids put in order, vectors met afterwards: as with a vector beside each event."""
    shared = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(7)] + [(7, None)], "vec_id long, vec array<double>")
    raw = spark.range(300).select(
        F.col("id").cast("string").alias("eid"), (F.col("id") % 4).alias("unit"),
        F.concat(F.lit("20"), F.lpad((F.col("id") * 7 % 26).cast("string"), 2, "0"), F.lit("-03-04")).alias("day"))
    registry = raw.select("eid", F.lit("nrc").alias("system_source"))
    ids = raw.select("eid", (F.col("eid").cast("long") * 5 % 8).alias("vec_id"))
    args = (registry, raw, "nrc", "unit", "day", ["vec"])
    options = dict(min_events=10, block_rows=block_rows)
    by_id = source_similarity(ids, *args, shared=shared, **options)
    beside = source_similarity(ids.join(shared, "vec_id").drop("vec_id"), *args, **options)
    values = [{r.eid: (r.t, r.cos_sim_rw_vec_1) for r in d.collect()} for d in (by_id, beside)]
    assert values[0] == values[1] and len(values[0]) > 250 and "vec_id" not in by_id.columns
