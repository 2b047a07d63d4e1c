"""Column shaping, filters, joins, unions, groups, windows and sorts on the star schema."""

from pyspark.sql import functions as F

from tidewatch.catalog.book import load, query, r6, rounded
from tidewatch.catalog.signals import EVENT_SERIES, event_series
from tidewatch.functions import columns as C
from tidewatch.operators import groups as G
from tidewatch.operators import joins as J
from tidewatch.operators.ordering import in_order

# -- columns -----------------------------------------------------------------------------------------


@query(
    "harmonised_keys",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS event_date, CAST(o_orderkey AS VARCHAR) AS event_num,
 o_orderpriority AS event_text, 'rail_' || o_orderkey AS data_set_num, 'rail' AS sys_source FROM orders""",
)
def harmonised_keys(spark, sf_dir):
    raw = load(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"),
        F.col("o_orderkey").alias("Accident.Number"), F.col("o_orderpriority").alias("Narrative"),
    )
    keyed = C.harmonise_keys(raw, "rail").withColumn("sys_source", F.lit("rail"))
    return keyed.withColumn("data_set_num", C.compose_key("sys_source", "event_num"))


@query(
    "clean_column_names",
    "SELECT p_partkey AS part_key, p_name AS part_name, p_size AS x_size, p_brand AS x_size_2 FROM part",
)
def clean_column_names(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    return C.clean_names(p.toDF("PartKey", "part.name", "X size", "X-Size"))


@query(
    "columns_by_condition",
    """SELECT l_quantity AS li_l_quantity, l_extendedprice AS li_l_extendedprice, l_tax AS li_l_tax
FROM lineitem""",
)
def columns_by_condition(spark, sf_dir):
    """Selected by prefix, type and exclusion, reordered and renamed by a prefix."""
    lines = load(spark, sf_dir, "lineitem")
    names = C.pick(lines, starts_with="l_", numeric=True, without=("l_discount", "l_linenumber"))
    names = [n for n in names if not n.endswith("key")]
    return C.with_prefix(C.relocate(lines.select(*names), "l_tax"), "li_")


@query(
    "valid_rows",
    """SELECT o_orderkey, year(o_orderdate) AS y FROM orders
WHERE o_orderkey IS NOT NULL AND year(o_orderdate) BETWEEN 1995 AND 1997 AND o_orderstatus IN ('F', 'O')
AND o_orderpriority NOT IN ('5-LOW')""",
)
def valid_rows(spark, sf_dir):
    o = C.real_rows(load(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey").cast("string")), "k")
    o = o.filter(C.year_between("o_orderdate", 1995, 1997))
    o = C.non_members(C.members(o, "o_orderstatus", ["F", "O"]), "o_orderpriority", ["5-LOW"])
    return o.select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("y"))


@query(
    "rows_without_nulls",
    "SELECT doc_id, quality, lang FROM documents JOIN labels USING (doc_id)",
)
def rows_without_nulls(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang")
    joined = d.join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.na.drop(subset=["quality"]).select("doc_id", "quality", "lang")


@query(
    "members_of_table",
    """SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def members_of_table(spark, sf_dir):
    poor = load(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    returned = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("o_orderkey"))
    o = C.members(load(spark, sf_dir, "orders"), "o_custkey", poor)
    return C.non_members(o, "o_orderkey", returned).select("o_orderkey")


@query(
    "recoded_values",
    """SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'household' THEN 'home' WHEN 'machinery' THEN 'works'
 ELSE lower(c_mktsegment) END AS c_mktsegment, CASE WHEN c_acctbal < 0 THEN 1 WHEN c_acctbal >= 0 THEN 0 END
 AS debt, CASE WHEN c_nationkey BETWEEN 1 AND 2 THEN 1 WHEN c_nationkey BETWEEN 3 AND 5 THEN 2
 WHEN c_nationkey BETWEEN 6 AND 9 THEN 3 END AS level FROM customer""",
)
def recoded_values(spark, sf_dir):
    c = C.recode(load(spark, sf_dir, "customer"), "c_mktsegment",
                 {"household": "home", "machinery": "works"}, lower=True)
    return c.select(
        "c_custkey", "c_mktsegment", C.two_way(F.col("c_acctbal") < 0, 1, 0).alias("debt"),
        C.by_ranges("c_nationkey", [(1, 2, 1), (3, 5, 2), (6, 9, 3)]).alias("level"),
    )


@query(
    "recoded_by_table",
    """SELECT p_partkey, CASE WHEN p_brand LIKE '%1' THEN upper(p_brand) ELSE p_brand END AS p_brand FROM part""",
)
def recoded_by_table(spark, sf_dir):
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    names = parts.select(F.col("p_brand").alias("old"), F.upper("p_brand").alias("new")).distinct()
    return C.recode_by_table(parts, "p_brand", names.filter(F.col("old").endswith("1")))


@query(
    "keys_built_and_split",
    """SELECT l_orderkey || '_' || l_linenumber AS k, CAST(l_orderkey AS VARCHAR) AS a,
 CAST(l_linenumber AS VARCHAR) AS b FROM lineitem""",
)
def keys_built_and_split(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(C.compose_key("l_orderkey", "l_linenumber").alias("k"))
    return C.split_key(lines, "k", ["a", "b"])


@query(
    "shares_of_total",
    """SELECT p_partkey, round(p_size / p_retailprice, 6) + 0.0 AS gi_size,
 round(length(p_name) / p_retailprice, 6) + 0.0 AS gi_name FROM part""",
)
def shares_of_total(spark, sf_dir):
    parts = load(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").alias("gi_size"), F.length("p_name").alias("gi_name"),
        F.col("p_retailprice").alias("total"),
    )
    return rounded(C.to_share(parts, "gi_", "total"), "gi_size", "gi_name")


# -- joins and unions --------------------------------------------------------------------------------


@query(
    "left_join_on_renamed_keys",
    """SELECT o_orderkey, c_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""",
)
def left_join_on_renamed_keys(spark, sf_dir):
    o = J.left_join(load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer"), {"o_custkey": "c_custkey"})
    o = J.left_join(o, load(spark, sf_dir, "nation"), {"c_nationkey": "n_nationkey"})
    o = J.left_join(o, load(spark, sf_dir, "region"), {"n_regionkey": "r_regionkey"})
    return o.select("o_orderkey", "c_name", "r_name")


@query(
    "full_join_null_safe",
    """WITH a AS (SELECT nullif(c_nationkey, 3) AS k, count(*) AS n_customers FROM customer GROUP BY 1),
b AS (SELECT nullif(s_nationkey, 3) AS k, count(*) AS n_suppliers FROM supplier WHERE s_nationkey <> 7 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, n_customers, n_suppliers FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k""",
)
def full_join_null_safe(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.nullif("c_nationkey", F.lit(3)).alias("k"))
    s = load(spark, sf_dir, "supplier").filter("s_nationkey <> 7").select(F.nullif("s_nationkey", F.lit(3)).alias("k"))
    return J.full_join_null_safe(G.group_count(c, ["k"], "n_customers"), G.group_count(s, ["k"], "n_suppliers"), ["k"])


@query(
    "right_join",
    """SELECT doc_id, toxic, lang FROM labels RIGHT JOIN documents USING (doc_id)""",
)
def right_join(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return load(spark, sf_dir, "labels").select("doc_id", "toxic").join(docs, "doc_id", "right")


@query(
    "metric_tables_joined",
    """WITH a AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
b AS (SELECT l_suppkey AS k, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
c AS (SELECT s_suppkey AS k, s_name FROM supplier) SELECT k, n, q, s_name FROM a LEFT JOIN b USING (k)
LEFT JOIN c USING (k)""",
)
def metric_tables_joined(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "k")
    q = lines.filter("l_returnflag = 'R'").groupBy("k").agg(F.max("l_quantity").alias("q"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    return J.join_metrics(G.group_count(lines, ["k"]), q, s, on=["k"])


@query(
    "columns_bound_by_position",
    """SELECT doc_id, n_chars, cls FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS i
 FROM documents) JOIN (SELECT doc_id % 7 AS cls, row_number() OVER (ORDER BY n_chars, doc_id) AS i FROM documents)
USING (i)""",
)
def columns_bound_by_position(spark, sf_dir):
    """Scores that come without a key, in a row order of their own."""
    d = load(spark, sf_dir, "documents")
    scores = d.select((F.col("doc_id") % 7).alias("cls"), F.col("n_chars").alias("o1"), F.col("doc_id").alias("o2"))
    bound = J.bind_columns(d.select("doc_id", "n_chars"), scores, ["doc_id"], ["o1", "o2"])
    return bound.select("doc_id", "n_chars", "cls")


@query(
    "series_aligned_by_ordinal",
    """WITH a AS (SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS m, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m') AS m2, count(*) AS n2 FROM lineitem GROUP BY 1)
SELECT time, m, n, m2, n2 FROM (SELECT row_number() OVER (ORDER BY m) AS time, * FROM a)
LEFT JOIN (SELECT row_number() OVER (ORDER BY m2) AS time, * FROM b) USING (time)""",
)
def series_aligned_by_ordinal(spark, sf_dir):
    month = lambda c: F.date_format(c, "yyyy-MM")
    a = G.month_counts(load(spark, sf_dir, "orders"), "o_orderdate", "n").select(month("month").alias("m"), "n")
    b = G.month_counts(load(spark, sf_dir, "lineitem"), "l_shipdate", "n2").select(month("month").alias("m2"), "n2")
    return J.align_by_ordinal(a, b, ["m"], ["m2"])


@query(
    "distinct_values",
    "SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2",
)
def distinct_values(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey").distinct()
    return G.group_count(lines, ["l_returnflag", "l_linestatus"], "suppliers")


@query(
    "group_separators",
    """SELECT user_id, event_id, false AS group_end FROM events UNION ALL SELECT DISTINCT user_id, NULL, true FROM events""",
)
def group_separators(spark, sf_dir):
    return G.with_group_end(load(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"])


# -- groups ------------------------------------------------------------------------------------------


@query(
    "mean_and_sd_by_group",
    "SELECT l_suppkey, " + ", ".join(
        f"round(avg({c}), 6) + 0.0 AS {c}_mean, round(stddev_samp({c}), 6) + 0.0 AS {c}_std"
        for c in ("l_quantity", "l_extendedprice", "l_discount")) + " FROM lineitem GROUP BY 1",
)
def mean_and_sd_by_group(spark, sf_dir):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    stats = G.mean_sd(load(spark, sf_dir, "lineitem"), ["l_suppkey"], cols)
    return rounded(stats, *[c for c in stats.columns if c != "l_suppkey"])


@query("group_counts", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def group_counts(spark, sf_dir):
    return G.group_count(load(spark, sf_dir, "events"), ["event_type", "user_id"])


@query(
    "flags_counted",
    "SELECT user_id, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1",
)
def flags_counted(spark, sf_dir):
    return G.count_true(load(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "error", "errors")


@query(
    "daily_outcome",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) + 0.0 AS mean_value, max(value) AS max_value,
 min(value) AS min_value FROM events GROUP BY 1""",
)
def daily_outcome(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy(G.day_of("ts").alias("day"))
    return e.agg(
        r6(F.avg("value")).alias("mean_value"), F.max("value").alias("max_value"), F.min("value").alias("min_value")
    ).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "days_without_gaps",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT strftime(s.day, '%Y-%m-%d') AS day, n FROM (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d),
 (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day) s LEFT JOIN d ON d.day = s.day""",
)
def days_without_gaps(spark, sf_dir):
    o = load(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    daily = o.groupBy(G.day_of("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return G.date_spine(daily, "day").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "accident_rate_by_level",
    """WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n,
 count(*) FILTER (o_orderstatus = 'P') % 4 AS level FROM orders GROUP BY 1)
SELECT level, CAST(sum(n) AS BIGINT) AS sum_n, round(sum(n) / count(*), 6) + 0.0 AS rate FROM m GROUP BY 1""",
)
def accident_rate_by_level(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    m = G.month_counts(o, "o_orderdate", "n")
    p = G.month_counts(o.filter("o_orderstatus = 'P'"), "o_orderdate", "p")
    m = m.join(p, "month", "left").withColumn("level", F.coalesce("p", F.lit(0)) % 4)
    return rounded(G.rate_by_level(m, "level", "n"), "rate")


@query(
    "groups_of_size",
    "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 65)",
)
def groups_of_size(spark, sf_dir):
    return G.groups_of_size(load(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], 65)


@query(
    "column_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) AS n, count(*) FILTER ({c} IS NULL) AS n_missing, "
        f"round(avg({c}), 6) + 0.0 AS mean, round(stddev_samp({c}), 6) + 0.0 AS sd, CAST(min({c}) AS DOUBLE) AS p0, "
        + ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {q}), 6) + 0.0 AS p{round(q*100)}" for q in (0.25, 0.5, 0.75))
        + f", CAST(max({c}) AS DOUBLE) AS p100 FROM (SELECT *, nullif(l_linenumber, 7) AS line FROM lineitem)"
        for c in ("l_quantity", "l_extendedprice", "line")),
)
def column_profile(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").withColumn("line", F.nullif("l_linenumber", F.lit(7)))
    p = G.profile(lines, ["l_quantity", "l_extendedprice", "line"])
    return rounded(p, "mean", "sd", "p25", "p50", "p75")


@query(
    "column_means",
    "SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_tax), 6) AS l_tax FROM lineitem",
)
def column_means(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").agg(r6(F.avg("l_quantity")).alias("l_quantity"), r6(F.avg("l_tax")).alias("l_tax"))


@query(
    "histogram",
    """SELECT CAST(CASE WHEN n_chars < 0 THEN 0 WHEN n_chars >= 20000 THEN 21 ELSE n_chars // 1000 + 1 END AS BIGINT)
 AS bucket, count(*) AS n FROM documents GROUP BY 1""",
)
def histogram(spark, sf_dir):
    return G.histogram(load(spark, sf_dir, "documents"), "n_chars", 0.0, 20000.0, 20)


# -- windows, sorts ----------------------------------------------------------------------------------


@query(
    "event_neighbours",
    f"""WITH {EVENT_SERIES} SELECT event_id, t, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS following,
round(avg(value) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) + 0.0 AS two_row_mean,
round(avg(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) + 0.0 AS expanding_mean
FROM series WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def event_neighbours(spark, sf_dir):
    """Lag, lead, a two-row frame and an expanding frame, from one sort."""
    seq = event_series(spark, sf_dir).rolling(
        {
            "previous": lambda w: F.lag("event_id").over(w),
            "following": lambda w: F.lead("event_id").over(w),
            "two_row_mean": lambda w: F.avg("value").over(w.rowsBetween(-1, 0)),
        },
        back=1, ahead=1,
    ).running({"_sum": F.col("value")})
    rows = seq.rows.withColumn("expanding_mean", F.col("_sum") / F.col("t"))
    return rounded(rows.select("event_id", "t", "previous", "following", "two_row_mean", "expanding_mean"),
                   "two_row_mean").withColumn("expanding_mean", r6("expanding_mean", 9))


@query(
    "global_ordinal",
    "SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS n FROM (SELECT event_id, ts FROM events)",
)
def global_ordinal(spark, sf_dir):
    """A number per row over the whole table, without one task that holds all rows."""
    e = load(spark, sf_dir, "events").select("event_id", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("later"))
    return in_order(e, [], ["later", "event_id"], "n").rows.select("event_id", "n")


@query(
    "global_ordinal_by_text",
    "SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) AS n FROM customer",
)
def global_ordinal_by_text(spark, sf_dir):
    """Numbered along names that all begin alike, in slices cut where they differ."""
    names = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return in_order(names, [], ["c_name", "c_custkey"], "n", block_rows=1000).rows.select("c_custkey", "n")


@query(
    "whole_table_burstiness",
    """WITH g AS (SELECT event_id, row_number() OVER w AS t, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 / 86400 AS gap
 FROM events WINDOW w AS (ORDER BY ts, event_id)), f AS (SELECT *, stddev_samp(gap) OVER w / avg(gap) OVER w AS r FROM g
 WINDOW w AS (ORDER BY t ROWS BETWEEN 48 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN t >= 50 THEN round((r - 1) / (r + 1), 6) + 0.0 END AS b_param FROM f""",
)
def whole_table_burstiness(spark, sf_dir):
    """Burstiness of the last 50 events whatever their unit."""
    from tidewatch.operators.series import inter_event_times, rolling_burstiness

    seq = in_order(load(spark, sf_dir, "events").select("event_id", "ts"), [], ["ts", "event_id"])
    return rolling_burstiness(inter_event_times(seq, "ts"), k=50).rows.select("event_id", r6("b_param").alias("b_param"))


@query(
    "first_rows_sorted",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5",
)
def first_rows_sorted(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(5)


@query(
    "best_row_per_group",
    """SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS largest FROM orders GROUP BY 1""",
)
def best_row_per_group(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_totalprice").alias("largest"))
