"""Whole runs: narrative coding, climate vectors, rolling measures, daily metrics."""

from pyspark.sql import functions as F

from tidewatch.catalog.book import load, query, r6, rounded, texts

from tidewatch.catalog.joint import MULTI, joint3_sql
from tidewatch.catalog.signals import BURN_IN, CROSSED, signal_ctes
from tidewatch.catalog.similarity import TOKENS, V
from tidewatch.functions.vectors import doubles
from tidewatch.operators.joint_signals import JOINT_METRICS, joint_signals
from tidewatch.plans.climate import climate_vectors
from tidewatch.plans.coding import Scores, clean_reports, code_events, combine_phmsa_narratives
from tidewatch.plans.measures import (
    day_metrics,
    source_similarity,
    unit_language_metrics,
    unit_series,
    unit_signals,
)
from tidewatch.tables.registry import event_id


def word_dictionary(spark):
    rows = [("gi", "article", "the"), ("gi", "article", "a"), ("gi", "link", "and"), ("gi", "link", "wi*")]
    return spark.createDataFrame(rows, "dict string, category string, pattern string")


CODED = f"""{TOKENS}, counts AS (SELECT doc_id, count(*) FILTER (token IN ('the', 'a')) AS gi_article,
 count(*) FILTER (token = 'and' OR starts_with(token, 'wi')) AS gi_link FROM tokens GROUP BY 1)"""


@query(
    "reports_coded",
    f"""WITH {CODED} SELECT d.doc_id, quality AS liwc_quality, n_chars AS emo_voc_n,
 coalesce(gi_article, 0) AS gi_article, coalesce(gi_link, 0) AS gi_link FROM documents d
 LEFT JOIN labels USING (doc_id) LEFT JOIN counts USING (doc_id) WHERE text <> '' AND text <> 'None'""",
)
def reports_coded(spark, sf_dir):
    """Reports with scores joined by key and bound by position, filtered, scored."""
    docs = texts(spark, sf_dir)
    reports = docs.select("doc_id", F.col("text").alias("cmbd_narrative"))
    by_key = Scores(load(spark, sf_dir, "labels"), ["quality"], "liwc_", key="doc_id")
    by_position = Scores(docs.select(F.col("doc_id").alias("TextID"), F.col("n_chars").alias("n")), ["n"],
                         "emo_voc_", order=("TextID",), report_order=("doc_id",))
    coded = code_events(reports, "phmsa", "doc_id", [by_key, by_position], word_dictionary(spark))
    return coded.select("doc_id", "liwc_quality", "emo_voc_n", "gi_article", "gi_link")


@query(
    "rail_reports_coded",
    f"""WITH {CODED}
SELECT d.doc_id, md5(text) AS narrative, n_chars AS liwc_n, coalesce(gi_article, 0) AS gi_article, coalesce(gi_link, 0) AS gi_link
FROM documents d LEFT JOIN counts USING (doc_id) WHERE text <> '' AND text <> 'None' AND d.doc_id % 7 <> 0""",
)
def rail_reports_coded(spark, sf_dir):
    """Accident narratives with the fillers of two empty fields, scores bound by position to all rows before texts are cleaned and filtered."""
    docs = texts(spark, sf_dir)
    filler = F.when(F.col("doc_id") % 7 == 0, F.lit("NoneNone")).when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("NoneNone"))).otherwise(F.concat("text", F.lit("None")))
    reports = docs.select("doc_id", filler.alias("Narrative"))
    by_position = Scores(docs.select(F.col("doc_id").alias("TextID"), F.col("n_chars").alias("n")), ["n"], "liwc_", order=("TextID",), report_order=("doc_id",))
    coded = code_events(reports, "rail", "doc_id", [by_position], word_dictionary(spark))
    return coded.select("doc_id", F.md5("Narrative").alias("narrative"), "liwc_n", "gi_article", "gi_link")


@query(
    "hospital_reports_coded",
    f"""WITH {CODED} SELECT d.doc_id, quality AS emo_voc_quality, coalesce(gi_article, 0) AS gi_article, coalesce(gi_link, 0) AS gi_link
FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN counts USING (doc_id) WHERE text <> '' AND d.doc_id % 5 <> 0""",
)
def hospital_reports_coded(spark, sf_dir):
    """Patient-safety reports, some without a narrative, with scores joined by key."""
    docs = texts(spark, sf_dir)
    reports = docs.select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("Narrative_merged"))
    by_key = Scores(load(spark, sf_dir, "labels"), ["quality"], "emo_voc_", key="doc_id")
    coded = code_events(reports, "psn", "doc_id", [by_key], word_dictionary(spark), passive=False)
    return coded.select("doc_id", "emo_voc_quality", "gi_article", "gi_link")


@query(
    "facility_reports_clean",
    """SELECT o_orderkey AS X_key, strftime(o_orderdate, '%Y-%m-%d') AS event_date2, lower(o_orderpriority) AS event_text,
 CASE lower(c_mktsegment) WHEN 'household' THEN 'davis besse' ELSE lower(c_mktsegment) END AS facility
FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def facility_reports_clean(spark, sf_dir):
    o = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    mdy = F.date_format("o_orderdate", "M/d/yyyy")
    facility = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "DAVIS-BESSE").otherwise(F.col("c_mktsegment"))
    raw = o.select(
        F.col("o_orderkey").alias("X_key"), F.lit(1).alias("X"), mdy.alias("event_date"),
        mdy.alias("notification_date"), F.col("o_orderpriority").alias("event_text"), facility.alias("facility"),
    )
    clean = clean_reports(raw, "nrc")
    return clean.select("X_key", F.date_format("event_date2", "yyyy-MM-dd").alias("event_date2"), "event_text", "facility")


@query(
    "narratives_combined",
    """WITH n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS narrative1,
 CASE WHEN doc_id % 10 = 0 THEN NULL ELSE text END AS narrative2 FROM documents)
SELECT doc_id, md5(concat_ws(' ', narrative1, narrative2)) AS narrative FROM n
WHERE NOT (narrative1 IS NULL AND narrative2 IS NULL) AND narrative1 IS NOT NULL""",
)
def narratives_combined(spark, sf_dir):
    """Placeholder phrases in both narratives go; a first narrative is required, as the filter on it
    drops missing ones."""
    d = load(spark, sf_dir, "documents")
    first = F.concat("lang", F.lit("NO COMMENTS PROVIDED."), F.lit("n/a"))
    second = F.concat(F.lit("NO COMMENTS PROVIDED"), F.lit("n/a"), "text")
    n = d.select(
        "doc_id", F.when(F.col("doc_id") % 5 != 0, first).alias("narrative1"),
        F.when(F.col("doc_id") % 10 != 0, second).alias("narrative2"),
    )
    return combine_phmsa_narratives(n).select("doc_id", F.md5("cmbd_narrative").alias("narrative"))


@query(
    "climate_vector_cells",
    """WITH f AS (SELECT *, l_extendedprice / l_quantity AS words FROM lineitem)
SELECT CASE WHEN l_returnflag = 'N' THEN 'nrc' ELSE 'rail' END AS sys_source, l_orderkey || '_' || l_partkey AS event_num,
 round(l_quantity / words, 6) + 0.0 AS c0, round(l_tax, 6) + 0.0 AS c1 FROM f""",
)
def climate_vector_cells(spark, sf_dir):
    """Two sources pooled, counts to shares, constant columns out, the rest as a vector."""
    f = load(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.concat_ws("_", "l_orderkey", "l_partkey").alias("event_num"),
        F.concat_ws("_", "l_returnflag", "l_orderkey").alias("dataSet_num"),
        F.col("l_quantity").alias("gi_quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("liwc_WC"),
        F.lit(3.0).alias("liwc_fixed"), F.col("l_tax").alias("liwc_tax"),
    )
    sources = {"nrc": f.filter("l_returnflag = 'N'"), "rail": f.filter("l_returnflag <> 'N'")}
    v = climate_vectors(sources, ["gi_quantity", "liwc_WC", "liwc_fixed", "liwc_tax"])
    cell = lambda i: F.col("composite_climate_vec")[i]
    return v.select("sys_source", "event_num", r6(cell(0)).alias("c0"), r6(cell(1)).alias("c1"))


# -- rolling measures --------------------------------------------------------------------------------

# Events with the vector whose id is the event's modulo the number of vectors.
JOINED = f"""e AS (SELECT event_id, ts, user_id, {V} AS vec FROM events JOIN embeddings ON vec_id = event_id %
  (SELECT count(*) FROM embeddings)),
g AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n_unit FROM e),
s AS (SELECT event_id, ts, user_id, row_number() OVER w AS t,
  list_cosine_similarity(vec, lag(vec) OVER w) AS sim,
  (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 / 86400 AS gap
  FROM g WHERE n_unit >= 40 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, stddev_samp(gap) OVER w / nullif(avg(gap) OVER w, 0) AS r FROM s
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
series AS (SELECT event_id, ts, user_id, t, sim, gap, CASE WHEN t >= 10 THEN (r - 1) / (r + 1) END AS burst FROM b)"""


def event_vectors(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings").select("vec_id", doubles("embedding").alias("vec"))
    n = v.count()
    e = load(spark, sf_dir, "events").select("event_id", "ts", "user_id").withColumn("vec_id", F.col("event_id") % n)
    return e.join(v, "vec_id").drop("vec_id")


def measures(spark, sf_dir):
    return unit_series(event_vectors(spark, sf_dir), "user_id", "ts", ["vec"], "event_id", min_events=40)


@query(
    "unit_measures",
    f"""WITH {JOINED} SELECT event_id, user_id, round(sim, 6) + 0.0 AS cos_sim_rw_vec_1, round(gap, 6) + 0.0
 AS inter_event_dur, round(burst, 6) + 0.0 AS b_param FROM series""",
)
def unit_measures(spark, sf_dir):
    """Similarity, inter-event time and burstiness per event, from one ordering of each unit."""
    names = ["cos_sim_rw_vec_1", "inter_event_dur", "b_param"]
    return rounded(measures(spark, sf_dir).select("event_id", "user_id", *names), *names)


@query(
    "source_similarity",
    f"""WITH o AS (SELECT o_orderkey, o_custkey % 20 AS unit, CAST(o_orderdate AS DATE) AS day, {V} AS vec FROM orders
 JOIN embeddings ON vec_id = o_orderkey % (SELECT count(*) FROM embeddings)),
g AS (SELECT *, count(*) OVER (PARTITION BY unit) AS n FROM o),
w AS (SELECT o_orderkey, unit, list_cosine_similarity(vec, lag(vec) OVER
 (PARTITION BY unit ORDER BY day, sha256('nrc|' || o_orderkey))) AS sim FROM g WHERE n >= 60 AND year(day) BETWEEN 1999 AND 2023)
SELECT sha256('nrc|' || o_orderkey) AS eid, unit, round(sim, 6) + 0.0 AS cos_sim_rw_vec_1 FROM w""",
)
def source_similarity_query(spark, sf_dir):
    """Vectors, registry and raw table joined for one source, gated, dated, ordered, compared."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", doubles("embedding").alias("vec"))
    n = v.count()
    o = load(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % n).alias("vec_id"), (F.col("o_custkey") % 20).alias("unit"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.lit("nrc").alias("system_source"),
        F.col("o_orderkey").cast("string").alias("event_num"),
    ).withColumn("eid", event_id())
    embeddings = o.join(v.select("vec_id"), "vec_id", "left_semi").select("eid", "vec_id")
    rows = source_similarity(embeddings, o.select("eid", "system_source"), o.select("eid", "unit", "day"), "nrc",
                             "unit", "day", ["vec"], min_events=60, shared=v)
    return rounded(rows.select("eid", "unit", "cos_sim_rw_vec_1"), "cos_sim_rw_vec_1")


@query(
    "unit_measure_signals",
    f"""WITH {JOINED},
whole AS (SELECT * FROM series WHERE sim IS NOT NULL AND gap IS NOT NULL AND burst IS NOT NULL),
melted AS (SELECT user_id, ts, event_id, 'sim' AS metric, sim AS v FROM whole UNION ALL
  SELECT user_id, ts, event_id, 'gap', gap FROM whole UNION ALL SELECT user_id, ts, event_id, 'burst', burst FROM whole),
{signal_ctes('melted', 'v', 'user_id, metric', 'ts, event_id')},
counts AS (SELECT event_id, metric, {CROSSED} AS n FROM scored WHERE tt > {BURN_IN})
SELECT w.event_id, w.user_id, max(n) FILTER (metric = 'sim') AS cos_sim_rw_vec_1_crossed,
 max(n) FILTER (metric = 'gap') AS inter_event_dur_crossed, max(n) FILTER (metric = 'burst') AS b_param_crossed
FROM whole w LEFT JOIN counts USING (event_id) GROUP BY 1, 2""",
)
def unit_measure_signals(spark, sf_dir):
    """Crossing counts of the three measures on their own; the joint count is checked elsewhere."""
    metrics = ["cos_sim_rw_vec_1", "inter_event_dur", "b_param"]
    return unit_signals(measures(spark, sf_dir), "user_id", "ts", metrics, "event_id", BURN_IN, joint=False).select(
        "event_id", "user_id", *[f"{m}_crossed" for m in metrics])


JOINT3 = f"""{JOINED},
xyz AS (SELECT user_id, event_id, ts, sim AS x, gap AS y, burst AS z, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tt
  FROM series WHERE sim IS NOT NULL AND gap IS NOT NULL AND burst IS NOT NULL),
{joint3_sql("xyz")}"""


@query(
    "unit_joint_signal_counts",
    f"""WITH {JOINT3}, counts AS (SELECT event_id, {MULTI} AS n FROM strong3 WHERE tt > {BURN_IN})
SELECT user_id, CAST(sum(n) AS BIGINT) AS crossings, count(*) AS events FROM xyz LEFT JOIN counts USING (event_id) GROUP BY 1""",
)
def unit_joint_signal_counts(spark, sf_dir):
    """Crossings of the twelve joint metrics of three measures, per unit."""
    metrics = ["cos_sim_rw_vec_1", "inter_event_dur", "b_param"]
    signals = unit_signals(measures(spark, sf_dir), "user_id", "ts", metrics, "event_id", BURN_IN)
    return signals.groupBy("user_id").agg(F.sum("multi_crossed").alias("crossings"), F.count(F.lit(1)).alias("events"))


@query(
    "unit_joint_metrics",
    f"WITH {JOINT3} SELECT event_id, tt AS t, " + ", ".join(f"round({m}, 5) + 0.0 AS {m}" for m in JOINT_METRICS) + f" FROM strong3 WHERE tt > {BURN_IN}",
)
def unit_joint_metrics(spark, sf_dir):
    """The twelve metrics of three measures at every event after the burn-in."""
    metrics = ["cos_sim_rw_vec_1", "inter_event_dur", "b_param"]
    whole = measures(spark, sf_dir).na.drop(subset=metrics).select("user_id", "ts", "event_id", *metrics)
    found = joint_signals(whole, ["user_id"], ["ts", "event_id"], metrics, burn_in=BURN_IN)
    return rounded(found.select("event_id", F.col("t").cast("bigint").alias("t"), *JOINT_METRICS), *JOINT_METRICS, digits=5)


DAILY = f"""e AS (SELECT vec_id, label, vec_id // 100 AS day, {V} AS v FROM embeddings),
x AS (SELECT label, day, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM e),
m AS (SELECT label, day, pos, avg(x) AS x FROM x GROUP BY ALL),
d AS (SELECT label, day, list(x ORDER BY pos) AS v FROM m GROUP BY label, day),
lagged AS (SELECT label, day, list_cosine_similarity(v, lag(v) OVER (PARTITION BY label ORDER BY day)) AS lag_sim FROM d),
p AS (SELECT a.label, a.day, avg(list_cosine_similarity(a.v, b.v)) AS mean_sim, stddev_pop(list_cosine_similarity(a.v, b.v))
 AS std_sim FROM e a JOIN e b ON a.label = b.label AND a.day = b.day AND a.vec_id <> b.vec_id GROUP BY 1, 2),
c AS (SELECT label, day, avg(v[1]) AS first_mean, stddev_samp(v[1]) AS first_std FROM e GROUP BY 1, 2)"""


@query(
    "daily_language_metrics",
    f"""WITH {DAILY} SELECT label, day, round(lag_sim, 6) + 0.0 AS lag_sim, round(mean_sim, 6) + 0.0 AS mean_sim,
 round(std_sim, 6) + 0.0 AS std_sim, round(first_mean, 6) + 0.0 AS first_mean, round(first_std, 6) + 0.0 AS first_std
FROM lagged LEFT JOIN p USING (label, day) LEFT JOIN c USING (label, day) WHERE lag_sim IS NOT NULL""",
)
def daily_language_metrics(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").withColumn("vec", doubles("embedding"))
    e = e.withColumns({"day": F.floor(F.col("vec_id") / 100), "first": F.col("vec")[0]})
    m = day_metrics(e, ["label"], "day", "vec", ["first"])
    return rounded(m, "lag_sim", "mean_sim", "std_sim", "first_mean", "first_std")


@query(
    "unit_language_metrics",
    f"""WITH e AS (SELECT vec_id, label, {V} AS v FROM embeddings), p AS (SELECT a.label,
 avg(list_cosine_similarity(a.v, b.v)) AS mean_sim, stddev_pop(list_cosine_similarity(a.v, b.v)) AS std_sim
 FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1)
SELECT label, round(avg(v[1]), 6) + 0.0 AS first_mean, round(stddev_samp(v[1]), 6) + 0.0 AS first_std,
 round(any_value(mean_sim), 6) + 0.0 AS mean_sim, round(any_value(std_sim), 6) + 0.0 AS std_sim
FROM e LEFT JOIN p USING (label) GROUP BY label""",
)
def unit_language_metrics_query(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").withColumn("vec", doubles("embedding"))
    m = unit_language_metrics(e.withColumn("first", F.col("vec")[0]), "label", "vec", ["first"])
    return rounded(m, "first_mean", "first_std", "mean_sim", "std_sim")
