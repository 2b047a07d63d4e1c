"""Sources, sinks and the keyed registry, over the given tables."""

from pyspark.sql import functions as F

from tidewatch.catalog.book import load, query
from tidewatch.functions.columns import clean_names
from tidewatch.operators.groups import ordered_text
from tidewatch.sources.pages import anchors, by_id, by_tag, extract_fields, narratives, split_bad
from tidewatch.sources.pages import NARRATIVE_1, NARRATIVE_2
from tidewatch.sources.readers import (
    clean_asrs,
    read_csv,
    read_delimited,
    read_many,
    read_table,
    read_two_line_header,
    union_by_name,
)
from tidewatch.session import scratch_path
from tidewatch.tables.registry import (
    add_column,
    disambiguate,
    event_id,
    events_with_vectors,
    from_row,
    register,
    remaining,
    upsert_column,
    violations,
    with_event_ids,
)
from tidewatch.tables.writers import append, export_csv, save_stage

# -- sources and sinks -------------------------------------------------------------------------------


@query("csv_export_and_scan", "SELECT doc_id, lang, n_chars, length(text) AS text_length, md5(text) AS hash FROM documents")
def csv_export_and_scan(spark, sf_dir):
    """Whole texts, with quotes, commas and line breaks, out to CSV and back."""
    path = scratch_path(spark, "documents-csv")
    export_csv(load(spark, sf_dir, "documents"), path)
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    back = read_csv(spark, path, schema)
    length = F.length("text").cast("bigint").alias("text_length")
    return back.select("doc_id", "lang", "n_chars", length, F.md5("text").alias("hash"))


@query(
    "delimited_scan",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def delimited_scan(spark, sf_dir):
    path = scratch_path(spark, "customer-dollar")
    export_csv(load(spark, sf_dir, "customer"), path, sep="$")
    return read_delimited(
        spark, path, "$",
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    )


@query(
    "many_files_scan",
    """SELECT event_type AS kind, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events
GROUP BY 1""",
)
def many_files_scan(spark, sf_dir):
    """A folder tree of files of one layout, told apart by the path they came from."""
    path = scratch_path(spark, "events-tree")
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    events.write.partitionBy("event_type").option("header", True).csv(path)
    rows = read_many(spark, path, "event_id BIGINT, user_id BIGINT", provenance="file")
    kind = F.regexp_extract("file", r"event_type=([^/]+)/", 1).alias("kind")
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))


@query(
    "differing_tables_union",
    """SELECT c_custkey AS key, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""",
)
def differing_tables_union(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    s = load(spark, sf_dir, "supplier")
    return union_by_name([
        c.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("acctbal"),
                 F.col("c_mktsegment").alias("segment")),
        s.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("acctbal")),
    ])


@query(
    "two_line_header_scan",
    "SELECT CAST(s_suppkey AS VARCHAR) AS supplier_key, s_name AS supplier_name FROM supplier",
)
def two_line_header_scan(spark, sf_dir):
    """Names over two lines, one more line to skip, and a column left out."""
    path = scratch_path(spark, "supplier-two-lines")
    rows = load(spark, sf_dir, "supplier").select(
        F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name", F.col("s_acctbal").cast("string"))
        .alias("value"),
        F.col("s_suppkey").alias("n"),
    )
    head = spark.createDataFrame(
        [("Supplier,Supplier,Account", -3), (" key, name, balance", -2), (",,", -1)], "value string, n bigint"
    )
    # one folder, one file per part; the header lines come first in the first part
    head.unionByName(rows).orderBy("n").select("value").write.text(path)
    two = read_two_line_header(spark, path, skip=3, columns=2)
    return clean_names(two)


@query(
    "stored_table_scan",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
)
def stored_table_scan(spark, sf_dir):
    """Filter and columns reach the parquet scan."""
    orders = read_table(spark, f"{sf_dir}/orders.parquet")
    return orders.filter("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@query(
    "appended_table",
    "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
)
def appended_table(spark, sf_dir):
    path = scratch_path(spark, "orders-append")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    for status in ("F", "O", "P"):
        append(orders.filter(F.col("o_orderstatus") == status), path)
    return read_table(spark, path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stage_table",
    "SELECT user_id, count(*) AS n FROM events GROUP BY user_id",
)
def stage_table(spark, sf_dir):
    counts = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return save_stage(counts, scratch_path(spark, "stages"), "events", 10, "unit_counts")


PAGE_FIELDS_SQL = (
    r"""WITH f AS (SELECT page_id, html,
  regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1) AS title,
  regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1) AS h1,
  regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1) AS article FROM pages)
SELECT page_id, """ + ", ".join(
        "CASE WHEN regexp_matches(html, '(?is)<" + c + r"\b[^>]*>(.*?)</" + c + r"\s*>') THEN "
        + "regexp_replace(" + "replace(" * 8 + f"regexp_replace({c}, '(?s)<[^>]*>', '', 'g')"
        + ", '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), "
          "'&middot;', '·'), '&copy;', '©'), '&amp;', '&')"
        + r", '^\s+|\s+$', '', 'g')" + f" END AS {c}" for c in ("title", "h1", "article")
    ) + " FROM f"
)


@query("page_fields", PAGE_FIELDS_SQL)
def page_fields(spark, sf_dir):
    fields = {c: by_tag(c) for c in ("title", "h1", "article")}
    pages = load(spark, sf_dir, "pages").select("page_id", "html")
    return extract_fields(pages, "html", fields).drop("html")


@query("page_fields_by_id", PAGE_FIELDS_SQL)
def page_fields_by_id(spark, sf_dir):
    """The same elements found by their ids, which the pages get first."""
    html = F.col("html")
    for tag in ("title", "h1", "article"):
        html = F.regexp_replace(html, rf"(?i)<({tag})\b", f'<$1 class="c" id="the-{tag}"')
    pages = load(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    return extract_fields(pages, "html", {t: by_id(f"the-{t}") for t in ("title", "h1", "article")}).drop("html")


@query(
    "pages_without_a_field",
    r"""SELECT page_id FROM pages WHERE NOT (regexp_matches(html, '(?is)<title\b[^>]*>(.*?)</title\s*>')
AND regexp_matches(html, '(?is)<table\b[^>]*>(.*?)</table\s*>'))""",
)
def pages_without_a_field(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", "html")
    fields = extract_fields(pages, "html", {c: by_tag(c) for c in ("title", "table")})
    return split_bad(fields, ["title", "table"])[1].select("page_id")


@query(
    "report_sections",
    rf"""WITH t AS (SELECT doc_id, 'x{NARRATIVE_1[0]}old{NARRATIVE_1[1]} {NARRATIVE_1[0]} ' || text ||
  ' {NARRATIVE_1[1]} {NARRATIVE_2[0]} Describe: ' || lang || ' {NARRATIVE_2[1]}' AS report, text, lang FROM documents)
SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS narrative1, lang AS narrative2 FROM t""",
)
def report_sections(spark, sf_dir):
    """Narratives between markers, the last pair of markers counting."""
    docs = load(spark, sf_dir, "documents")
    report = F.concat(
        F.lit(f"x{NARRATIVE_1[0]}old{NARRATIVE_1[1]} {NARRATIVE_1[0]} "), "text",
        F.lit(f" {NARRATIVE_1[1]} {NARRATIVE_2[0]} Describe: "), "lang", F.lit(f" {NARRATIVE_2[1]}"),
    )
    rows = narratives(docs.select("doc_id", report.alias("report")), "report")
    return rows.select("doc_id", "narrative1", "narrative2")


@query(
    "anchors",
    "SELECT page_id, CAST(page_id AS VARCHAR) AS report_no, url AS doc_link FROM pages WHERE page_id % 3 <> 0",
)
def anchors_query(spark, sf_dir):
    """Rows that hold an anchor, with its text and target; the others have none."""
    number = F.col("page_id").cast("string")
    cell = F.when(
        F.col("page_id") % 3 != 0,
        F.concat(F.lit("<A HREF = "), "url", F.lit(' target="_blank">'), number, F.lit("</A>")),
    ).otherwise(number)
    rows = load(spark, sf_dir, "pages").select("page_id", cell.alias("incident"))
    return anchors(rows, "incident").select("page_id", "report_no", "doc_link")


@query(
    "monthly_reports_clean",
    r"""SELECT CAST(conv_id AS VARCHAR) AS acn, strftime(min(make_date(2000 + CAST(conv_id % 20 AS INT),
  CAST(conv_id % 12 + 1 AS INT), 1)), '%Y-%m-%d') AS date,
  len(regexp_extract_all(string_agg(text, ' ' ORDER BY turn), '[\p{L}\p{N}_]+')) AS tot_wc
FROM conversations GROUP BY conv_id""",
)
def monthly_reports_clean(spark, sf_dir):
    """Header echoes off, YYYYMM to a date, narrative columns merged and counted."""
    turns = load(spark, sf_dir, "conversations")
    side = F.when(F.col("turn") % 2 == 0, "report_1narrative").otherwise("report_2narrative")
    told = ordered_text(turns.withColumn("side", side), ["conv_id", "side"], ["turn"], "text", "told")
    wide = told.groupBy("conv_id").pivot("side", ["report_1narrative", "report_2narrative"]).agg(F.max("told"))
    month = F.format_string("%d%02d", 2000 + F.col("conv_id") % 20, F.col("conv_id") % 12 + 1)
    rows = wide.select(
        F.col("conv_id").cast("string").alias("acn"), month.alias("time_date"),
        "report_1narrative", "report_2narrative",
    )
    echo = rows.limit(1).select(F.lit("ACN").alias("acn"), F.lit("Date").alias("time_date"),
                                F.lit("x").alias("report_1narrative"), F.lit("y").alias("report_2narrative"))
    clean = clean_asrs(rows.unionByName(echo))
    return clean.select("acn", F.date_format("date", "yyyy-MM-dd").alias("date"),
                        F.col("tot_wc").cast("bigint").alias("tot_wc"))


# -- registry ----------------------------------------------------------------------------------------

SQL_EID = "sha256(system_source || '|' || event_num)"


def order_registry(spark, sf_dir):
    """A registry of orders (source ``orders``), as if registered earlier up to 1998."""
    o = load(spark, sf_dir, "orders")
    return o.filter("year(o_orderdate) < 1998").select(
        F.lit("orders").alias("system_source"),
        F.to_date("o_orderdate").alias("event_date"),
        F.col("o_orderkey").cast("string").alias("event_num"),
    ).withColumn("eid", event_id())


@query(
    "registry_append",
    """WITH r AS (SELECT 'orders' AS system_source, CAST(o_orderkey AS VARCHAR) AS event_num,
  CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT system_source, event_num, strftime(d, '%Y-%m-%d') AS event_date, """ + SQL_EID + " AS eid FROM r",
)
def registry_append(spark, sf_dir):
    """Registering all orders again adds those that are missing, once."""
    o = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_num"), F.col("o_orderdate").alias("event_date")
    )
    registry = register(order_registry(spark, sf_dir), o, "orders")
    return registry.withColumn("event_date", F.date_format("event_date", "yyyy-MM-dd"))


@query(
    "registry_lookup",
    """SELECT CAST(l_orderkey AS VARCHAR) AS event_num, l_linenumber, l_partkey, CASE WHEN year(o_orderdate) < 1998
THEN sha256('orders|' || CAST(l_orderkey AS VARCHAR)) END AS eid
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""",
)
def registry_lookup(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_num"), "l_linenumber", "l_partkey"
    )
    return with_event_ids(order_registry(spark, sf_dir), lines, "orders")


@query(
    "duplicate_event_numbers",
    """SELECT CAST(l_orderkey AS VARCHAR) || '_' || row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS event_num,
  CAST(l_orderkey AS VARCHAR) AS event_num_orig, l_linenumber, l_partkey FROM lineitem""",
)
def duplicate_event_numbers(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").withColumn("event_num", F.col("l_orderkey").cast("string"))
    rows = disambiguate(lines, "event_num", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return rows.select("event_num", "event_num_orig", "l_linenumber", "l_partkey")


@query(
    "vector_upsert",
    """SELECT sha256('docs|' || vec_id) AS eid, CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN
 n_chars ELSE -1 END AS score FROM embeddings LEFT JOIN documents d ON d.doc_id = vec_id
 LEFT JOIN labels l ON l.doc_id = vec_id""",
)
def vector_upsert(spark, sf_dir):
    """A whole-column update: given values replace, all other rows keep theirs."""
    target, updates, registry = upsert_tables(spark, sf_dir)
    return upsert_column(target, updates, registry, "score")[0]


@query(
    "vector_upsert_rejected",
    """SELECT 'docs' AS system_source, CAST(doc_id AS VARCHAR) AS event_num, 1::BIGINT AS n_updates,
 0::BIGINT AS n_ids FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings JOIN labels ON doc_id = vec_id)""",
)
def vector_upsert_rejected(spark, sf_dir):
    return upsert_column(*upsert_tables(spark, sf_dir), "score")[1]


def upsert_tables(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings")
    registry = vectors.select(
        F.lit("docs").alias("system_source"), F.col("vec_id").cast("string").alias("event_num")
    ).withColumn("eid", event_id())
    target = registry.select("eid", F.lit(-1).cast("bigint").alias("score"))
    labelled = load(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("event_num"))
    known = registry.join(labelled, "event_num", "left_semi")
    updates = load(spark, sf_dir, "documents").select(
        F.lit("docs").alias("system_source"), F.col("doc_id").cast("string").alias("event_num"),
        F.col("n_chars").alias("score"),
    )
    return target, updates, known


@query(
    "schema_evolution",
    """SELECT count(*) AS n, count(*) FILTER (score IS NULL) AS empty, min(n_chars) AS least FROM
 (SELECT n_chars, NULL AS score FROM documents)""",
)
def schema_evolution(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    wide = add_column(add_column(docs, "gi_vec", "array<double>"), "n_chars", "bigint")
    return wide.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gi_vec").isNull()).alias("empty"),
                    F.min("n_chars").alias("least"))


@query(
    "key_violations",
    """SELECT 'primary key' AS rule, CAST(l_orderkey AS VARCHAR) AS key, count(*) AS n FROM lineitem
 GROUP BY l_orderkey HAVING count(*) > 1
UNION ALL SELECT 'foreign key', CAST(l_orderkey AS VARCHAR), count(*) FROM lineitem
 WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE year(o_orderdate) < 1998) GROUP BY l_orderkey""",
)
def key_violations(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("eid"))
    orders = load(spark, sf_dir, "orders").filter("year(o_orderdate) < 1998")
    return violations(lines, orders.select(F.col("o_orderkey").alias("eid")))


@query(
    "vector_length_violations",
    "SELECT 'length of vec' AS rule, CAST(vec_id AS VARCHAR) AS key, 1::BIGINT AS n FROM embeddings WHERE label = 3",
)
def vector_length_violations(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    short = F.when(F.col("label") == 3, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    return violations(e.select("vec_id", short.alias("vec")), key="vec_id", vector_sizes={"vec": 64})


@query(
    "vectors_with_raw_columns",
    """SELECT sha256('s' || label % 2 || '|' || vec_id) AS eid, quality, len(embedding) AS dim
FROM embeddings LEFT JOIN labels ON doc_id = vec_id WHERE label % 2 = 1""",
)
def vectors_with_raw_columns(spark, sf_dir):
    """Vectors, registry and raw table of one source."""
    e = load(spark, sf_dir, "embeddings")
    keyed = e.select(
        "vec_id", "embedding", F.concat(F.lit("s"), (F.col("label") % 2).cast("string")).alias("system_source"),
        F.col("vec_id").cast("string").alias("event_num"),
    ).withColumn("eid", event_id())
    raw = keyed.join(load(spark, sf_dir, "labels"), F.col("doc_id") == F.col("vec_id")).select("eid", "quality")
    rows = events_with_vectors(keyed, keyed.select("eid", "system_source"), raw, "s1", ["quality"], ["embedding"])
    return rows.select("eid", "quality", F.size("embedding").cast("bigint").alias("dim"))


@query("resume_by_key", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_by_key(spark, sf_dir):
    return remaining(load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels"), "doc_id")


@query("resume_from_row", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey OFFSET 999")
def resume_from_row(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return from_row(orders, ["o_orderdate", "o_orderkey"], 1000).select("o_orderkey")
