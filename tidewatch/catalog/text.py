"""Text functions and narrative scores on the documents."""

from pyspark.sql import functions as F

from tidewatch.catalog.book import load, query, r6, rounded, texts
from tidewatch.catalog.similarity import TOKENS, WORD_SQL
from tidewatch.functions import text as X
from tidewatch.functions.columns import valid_text
from tidewatch.operators.groups import ordered_text
from tidewatch.operators.scoring import (
    AUXILIARIES,
    BOOST_DOWN,
    BOOST_UP,
    IRREGULAR_PARTICIPLES,
    NEGATIONS,
    dictionary_hits,
    dictionary_scores,
    passive_voice,
    sentiment,
)
from tidewatch.session import scratch_path
from tidewatch.sources.dictionaries import feature_names, read_dictionary

# Dictionaries of words that occur in the documents: (dictionary, category, pattern).
ENTRIES = [
    ("fn", "article", "the"), ("fn", "article", "a"), ("fn", "link", "and"), ("fn", "link", "with"),
    ("fn", "place", "in the"), ("fn", "place", "of the"), ("fn", "place", "at"), ("fn", "any", "th*"),
    ("fn", "any", "the"), ("st", "ing", "ing*"), ("st", "er", "er*"), ("st", "er", "erth"),
    ("st", "rare", "zebra"), ("st", "phrase", "of th*"),
]
LEXICON = [("the", 0.4), ("of", -0.6), ("and", 1.2), ("with", -1.5), ("is", 0.9), ("that", -0.3),
           ("not", -0.8), ("for", 1.9), ("de", 0.7), ("la", -1.1), ("und", 1.3), ("que", -0.2)]


def entries(spark):
    return spark.createDataFrame(ENTRIES, "dict string, category string, pattern string")


def lexicon(spark):
    return spark.createDataFrame(LEXICON, "token string, valence double")


def sql_values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def runs_sql(entries) -> str:
    """CTEs ending in ``found``: the words and pairs of words that fit a pattern of each category."""
    return f"""{TOKENS},
runs AS (SELECT doc_id, pos * 2 AS spot, token, 1 AS size FROM tokens UNION ALL
  SELECT doc_id, pos * 2 + 1, token || ' ' || nxt, 2 FROM (SELECT *, lead(token) OVER (PARTITION BY doc_id
    ORDER BY pos) AS nxt FROM tokens) WHERE nxt IS NOT NULL),
dic AS (SELECT d || '_' || c AS feature, rtrim(p, '*') AS stem, p LIKE '%*' AS is_prefix,
    len(string_split(p, ' ')) AS size FROM (VALUES {sql_values(entries)}) v(d, c, p)),
found AS (SELECT DISTINCT doc_id, spot, feature FROM runs JOIN dic ON runs.size = dic.size
  AND CASE WHEN is_prefix THEN starts_with(token, stem) ELSE token = stem END)"""


RUNS = runs_sql(ENTRIES)
#: Stems down to one letter, which words share with very many others.
SHORT_STEMS = [*ENTRIES, ("one", "t", "t*"), ("one", "a", "a*"), ("one", "de", "de*"), ("two", "t", "t*"), ("two", "pair", "t t*")]


@query("dictionary_hits", f"WITH {RUNS} SELECT doc_id, feature, count(*) AS n FROM found GROUP BY 1, 2")
def dictionary_hits_query(spark, sf_dir):
    """Matches per text and category, several dictionaries in one pass over the words."""
    return dictionary_hits(texts(spark, sf_dir), "doc_id", "text", entries(spark))


@query("dictionary_hits_large", f"WITH {runs_sql(SHORT_STEMS)} SELECT doc_id, feature, count(*) AS n FROM found GROUP BY 1, 2")
def dictionary_hits_large(spark, sf_dir):
    """The same by the way of a dictionary too long to broadcast: the vocabulary probes stems of each length."""
    patterns = spark.createDataFrame(SHORT_STEMS, "dict string, category string, pattern string")
    return dictionary_hits(texts(spark, sf_dir), "doc_id", "text", patterns, broadcast_rows=0)


FEATURES = sorted({f"{d}_{c}" for d, c, _ in ENTRIES})


@query(
    "dictionary_scores",
    f"WITH {RUNS} SELECT d.doc_id, " + ", ".join(
        f"count(*) FILTER (feature = '{f}') AS {f}" for f in FEATURES
    ) + " FROM documents d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id",
)
def dictionary_scores_query(spark, sf_dir):
    docs = texts(spark, sf_dir).select("doc_id", "text")
    return dictionary_scores(docs, "doc_id", "text", entries(spark)).drop("text")


@query(
    "dictionary_from_file",
    f"""WITH {TOKENS} SELECT doc_id, count(*) FILTER (token IN ('the', 'a')) AS n_article,
count(*) FILTER (token IN ('and', 'with') OR starts_with(token, 'th')) AS n_link FROM tokens GROUP BY doc_id
HAVING count(*) FILTER (token IN ('the', 'a', 'and', 'with') OR starts_with(token, 'th')) > 0""",
)
def dictionary_from_file(spark, sf_dir):
    """A category file in the %-delimited layout, read and applied."""
    path = scratch_path(spark, "words") + ".dic"
    body = ["%", "1\tarticle", "2\tlink", "%", "the\t1", "a\t1", "and\t2", "with\t2", "th*\t2"]
    spark.createDataFrame([(line,) for line in body], "value string").coalesce(1).write.text(path)
    hits = dictionary_hits(
        texts(spark, sf_dir), "doc_id", "text", read_dictionary(spark, path, "w")
    )
    n = lambda c: F.sum(F.when(F.col("feature") == f"w_{c}", F.col("n")).otherwise(0)).alias(f"n_{c}")
    return hits.groupBy("doc_id").agg(n("article"), n("link"))


@query(
    "feature_map",
    """SELECT DISTINCT lower(p_type) || '_' || p_brand AS var_name FROM part WHERE p_size <= 30""",
)
def feature_map(spark, sf_dir):
    """Names from a map of prefixes and variables, marked rows left out."""
    parts = load(spark, sf_dir, "part").select(
        F.concat(F.lower("p_type"), F.lit("_")).alias("prefix"), F.col("p_brand").alias("variables"),
        F.when(F.col("p_size") > 30, 1).alias("drop"),
    )
    return feature_names(parts)


AUX = sql_list(AUXILIARIES)


def adverb(c: str) -> str:
    return f"coalesce(regexp_matches({c}, '^.{{2,}}ly$') OR {c} IN ('not', 'never', 'also', 'being', 'been'), false)"


def aux(c: str) -> str:
    return f"coalesce({c} IN ({AUX}), false)"


@query(
    "passive_voice_ratio",
    f"""WITH {TOKENS}, near AS (SELECT doc_id, token, lag(token) OVER w AS a, lag(token, 2) OVER w AS b,
  lag(token, 3) OVER w AS c FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
hits AS (SELECT doc_id, count(*) AS n FROM near WHERE (regexp_matches(token, '^.{{2,}}(?:ed|en)$')
  OR token IN ({sql_list(IRREGULAR_PARTICIPLES)})) AND ({aux('a')} OR ({adverb('a')} AND ({aux('b')} OR
  ({adverb('b')} AND {aux('c')})))) GROUP BY doc_id),
wc AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM documents)
SELECT doc_id, round(coalesce(n, 0) / nullif(CASE WHEN s = '' THEN 0
  ELSE len(regexp_split_to_array(s, '\\s+')) END, 0), 6) + 0.0 AS passive
FROM wc LEFT JOIN hits USING (doc_id)""",
)
def passive_voice_ratio(spark, sf_dir):
    docs = texts(spark, sf_dir).select("doc_id", "text")
    return rounded(passive_voice(docs, "text", name="passive").drop("text"), "passive")


BOOST_SQL = " ".join(
    f"+ sgn * {fade} * CASE WHEN p{n} IN ({sql_list(BOOST_UP)}) THEN 0.293 "
    f"WHEN p{n} IN ({sql_list(BOOST_DOWN)}) THEN -0.293 ELSE 0 END"
    for n, fade in ((1, 1.0), (2, 0.95), (3, 0.9))
)
NEGATE_SQL = " ".join(
    f"* CASE WHEN p{n} IN ({sql_list(NEGATIONS)}) THEN -0.74 ELSE 1 END" for n in (1, 2, 3)
)


SENTIMENT = f"""WITH raw AS (SELECT doc_id, unnest(w) AS raw, generate_subscripts(w, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, {WORD_SQL}) AS w FROM documents)),
tok AS (SELECT *, lower(raw) AS token, raw = upper(raw) AND raw <> lower(raw) AND length(raw) > 1 AS caps
  FROM raw),
near AS (SELECT *, lag(token) OVER w AS p1, lag(token, 2) OVER w AS p2, lag(token, 3) OVER w AS p3,
  bool_or(caps) OVER d AND bool_or(NOT caps) OVER d AS mixed
  FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos), d AS (PARTITION BY doc_id)),
lex AS (SELECT * FROM (VALUES {sql_values(LEXICON)}) v(token, valence)),
val AS (SELECT doc_id, valence, CASE WHEN valence < 0 THEN -1.0 ELSE 1.0 END AS sgn, caps AND mixed AS loud,
  p1, p2, p3 FROM near LEFT JOIN lex USING (token)),
s AS (SELECT doc_id, coalesce((CAST(valence AS DOUBLE) + CASE WHEN loud AND valence <> 0 THEN sgn * 0.733
  ELSE 0 END {BOOST_SQL}) {NEGATE_SQL}, 0) AS s FROM val),
sums AS (SELECT d.doc_id, least(length(regexp_replace(text, '[^!]', '', 'g')), 4) * 0.292 AS shout,
  coalesce(sum(s), 0) AS total, coalesce(sum(CASE WHEN s > 0 THEN s + 1 END), 0) AS up,
  coalesce(sum(CASE WHEN s < 0 THEN s - 1 END), 0) AS down, count(s) FILTER (s = 0) AS flat
  FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, text),
loud AS (SELECT doc_id, total + CASE WHEN total > 0 THEN shout WHEN total < 0 THEN -shout ELSE 0 END AS total,
  up + CASE WHEN up > -down THEN shout ELSE 0 END AS up, down - CASE WHEN up < -down THEN shout ELSE 0 END
  AS down, flat FROM sums),
scored AS (SELECT doc_id, total / sqrt(total * total + 15) AS compound, coalesce(-down / nullif(up - down + flat, 0), 0) AS neg,
  coalesce(up / nullif(up - down + flat, 0), 0) AS pos, coalesce(flat / nullif(up - down + flat, 0), 0) AS neu FROM loud)"""


@query(
    "sentiment_scores",
    f"""{SENTIMENT} SELECT doc_id, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("compound", "neg", "pos", "neu"))} FROM scored""",
)
def sentiment_scores(spark, sf_dir):
    scores = sentiment(texts(spark, sf_dir), "doc_id", "text", lexicon(spark))
    return rounded(scores, "compound", "neg", "pos", "neu")


@query(
    "word_counts",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS INTEGER) AS runs,
 CAST(CASE WHEN s = '' THEN 0 ELSE len(regexp_split_to_array(s, '\s+')) END AS INTEGER) AS parts
FROM (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents)""",
)
def word_counts(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "doc_id", X.count_word_runs("text").alias("runs"), X.count_blank_separated("text").alias("parts")
    )


@query(
    "merged_narratives",
    """SELECT doc_id, md5(concat_ws(' ', lang, CASE WHEN toxic = 1 THEN 'toxic' END, text)) AS merged
FROM documents LEFT JOIN labels USING (doc_id)""",
)
def merged_narratives(spark, sf_dir):
    docs = texts(spark, sf_dir).join(load(spark, sf_dir, "labels"), "doc_id", "left")
    note = F.when(F.col("toxic") == 1, "toxic")
    return docs.select("doc_id", F.md5(X.merge_text("lang", note, "text")).alias("merged"))


@query(
    "placeholders_removed",
    r"""SELECT doc_id, md5(replace(text, 'the', '')) AS every,
 md5(CASE WHEN contains(text, 'the') THEN text[:instr(text, 'the') - 1] || text[instr(text, 'the') + 3:]
     ELSE text END) AS first_only,
 md5(CASE WHEN suffix(text, '.') THEN text[:-2] ELSE text END) AS at_end FROM documents""",
)
def placeholders_removed(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "doc_id",
        F.md5(X.remove_all("text", "the")).alias("every"),
        F.md5(X.remove_first("text", "the")).alias("first_only"),
        F.md5(X.remove_at_end("text", ".")).alias("at_end"),
    )


@query(
    "text_predicates",
    r"""SELECT doc_id, upper(lang) AS lang, substr(trim(lower(text)), 1, 20) AS head FROM documents
WHERE regexp_matches(text, 'th[aeiou]n') AND NOT contains(text, 'zz') AND text IS NOT NULL AND text <> ''""",
)
def text_predicates(spark, sf_dir):
    docs = texts(spark, sf_dir).filter(valid_text("text", ("None",)))
    docs = docs.filter(F.col("text").rlike("th[aeiou]n") & ~F.col("text").contains("zz"))
    return docs.select(
        "doc_id", F.upper("lang").alias("lang"), F.substring(F.trim(F.lower("text")), 1, 20).alias("head")
    )


@query(
    "dates_from_text",
    """SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS mdy,
 strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS ymd,
 strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, NULL AS broken FROM orders""",
)
def dates_from_text(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return o.select(
        "o_orderkey",
        day(X.read_mdy(F.date_format("o_orderdate", "M/d/yyyy"))).alias("mdy"),
        day(X.read_ymd(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("ymd"),
        day(X.read_month(F.date_format("o_orderdate", "yyyyMM"))).alias("month"),
        day(X.read_mdy(F.concat(F.lit("13/"), F.date_format("o_orderdate", "d/yyyy")))).alias("broken"),
    )


@query(
    "ordered_conversations",
    """SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS story FROM conversations GROUP BY conv_id""",
)
def ordered_conversations(spark, sf_dir):
    rows = ordered_text(load(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text", "story")
    return rows.withColumn("story", F.md5("story"))


@query(
    "sentiment_by_day",
    f"""{SENTIMENT} SELECT o_orderdate::DATE AS day, count(*) AS n, round(avg(compound), 5) + 0.0 AS compound_mean,
 round(max(compound), 5) + 0.0 AS compound_max, round(avg(neg), 5) + 0.0 AS neg_mean, round(avg(pos), 5) + 0.0 AS pos_mean
FROM scored LEFT JOIN orders ON o_orderkey = doc_id GROUP BY 1""",
)
def sentiment_by_day(spark, sf_dir):
    """Mean and largest sentiment of each day's documents, a document being of the day of the order of its number."""
    days = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("day"))
    scores = sentiment(texts(spark, sf_dir), "doc_id", "text", lexicon(spark)).join(days, "doc_id", "left")
    by_day = scores.groupBy("day").agg(
        F.count(F.lit(1)).alias("n"), F.avg("compound").alias("compound_mean"), F.max("compound").alias("compound_max"),
        F.avg("neg").alias("neg_mean"), F.avg("pos").alias("pos_mean"),
    )
    return rounded(by_day, "compound_mean", "compound_max", "neg_mean", "pos_mean", digits=5)
