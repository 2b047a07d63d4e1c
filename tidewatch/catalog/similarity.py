"""Vector similarity on the stored embeddings: unit = label, order = vec_id."""

from pyspark.sql import functions as F

from tidewatch.catalog.book import ORACLE, load, query, r6, rounded, texts
from tidewatch.functions.vectors import cosine, doubles, read_vector, to_vector, write_vector
from tidewatch.operators.ordering import in_order
from tidewatch.operators.scoring import new_text_vectors, term_counts, text_vectors, token_statistics
from tidewatch.session import parts_of, scratch_path
from tidewatch.operators.similarity import (
    day_similarity,
    mean_vector,
    neighbour_similarity,
    pairwise_similarity,
    rolling_day_similarity,
    similarity_to_previous,
    unit_similarity,
)

DIM = 64
V = "CAST(embedding AS DOUBLE[])"


def vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").withColumn("vec", doubles("embedding")).drop("embedding")


def list_mean(frame: str) -> str:
    """Element-wise mean of the vectors collected in a column."""
    return (f"list_transform(range(1, {DIM} + 1), lambda i: "
            f"list_sum(list_transform({frame}, lambda v: v[i])) / len({frame}))")


@query(
    "similarity_to_previous_event",
    f"""SELECT vec_id, label, round(list_cosine_similarity(v, lag(v) OVER w), 6) + 0.0 AS sim
FROM (SELECT vec_id, label, {V} AS v FROM embeddings)
WINDOW w AS (PARTITION BY label ORDER BY vec_id)""",
)
def similarity_to_previous_event(spark, sf_dir):
    seq = in_order(vectors(spark, sf_dir), ["label"], ["vec_id"])
    rows = similarity_to_previous(seq, "vec", "sim").rows
    return rows.select("vec_id", "label", r6("sim").alias("sim"))


@query(
    "similarity_to_recent_events",
    f"""WITH e AS (SELECT vec_id, label, {V} AS v FROM embeddings),
framed AS (SELECT *, lag(v) OVER o AS v1, list(v) OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS f3,
                  list(v) OVER (o ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS f5,
                  count(*) OVER (PARTITION BY label) AS n
           FROM e WINDOW o AS (PARTITION BY label ORDER BY vec_id))
SELECT vec_id, label, round(list_cosine_similarity(v, v1), 6) + 0.0 AS cos_sim_rw_vec_1,
       CASE WHEN len(f3) = 3 AND n > 6 THEN round(list_cosine_similarity(v, {list_mean('f3')}), 6) + 0.0
       END AS cos_sim_rw_vec_3,
       CASE WHEN len(f5) = 5 AND n > 10 THEN round(list_cosine_similarity(v, {list_mean('f5')}), 6) + 0.0
       END AS cos_sim_rw_vec_5
FROM framed WHERE n >= 40""",
)
def similarity_to_recent_events(spark, sf_dir):
    rows = unit_similarity(vectors(spark, sf_dir), "label", "vec_id", "vec", [1, 3, 5], 40, "vec_id")
    names = [f"cos_sim_rw_vec_{k}" for k in (1, 3, 5)]
    return rounded(rows.select("vec_id", "label", *names), *names)


@query(
    "group_mean_vector",
    f"""WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos,
                          unnest({V}) AS x FROM embeddings)
SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) + 0.0 AS x FROM x GROUP BY label, pos""",
)
def group_mean_vector(spark, sf_dir):
    means = mean_vector(vectors(spark, sf_dir), ["label"], "vec", "m")
    return rounded(means.select("label", F.posexplode("m").alias("pos", "x")), "x")


@query(
    "group_pairwise_similarity",
    f"""WITH e AS (SELECT vec_id, label, {V} AS v FROM embeddings),
p AS (SELECT a.label, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b
      ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT label, round(avg(c), 6) + 0.0 AS mean_sim, round(stddev_pop(c), 6) + 0.0 AS std_sim
FROM p GROUP BY label""",
)
def group_pairwise_similarity(spark, sf_dir):
    sims = pairwise_similarity(vectors(spark, sf_dir), ["label"], "vec", DIM)
    return rounded(sims.select("label", "mean_sim", "std_sim"), "mean_sim", "std_sim")


DAYS = f"""x AS (SELECT label, vec_id // 20 AS day, generate_subscripts(embedding, 1) AS pos,
                       unnest({V}) AS x FROM embeddings),
m AS (SELECT label, day, pos, avg(x) AS x FROM x GROUP BY ALL),
d AS (SELECT label, day, list(x ORDER BY pos) AS v, count(*) OVER (PARTITION BY label) AS n_days
      FROM m GROUP BY label, day)"""


@query(
    "day_to_day_similarity",
    f"""WITH {DAYS}
SELECT label, day, round(list_cosine_similarity(v, lag(v) OVER w), 6) + 0.0 AS lag_sim FROM d
WINDOW w AS (PARTITION BY label ORDER BY day)""",
)
def day_to_day_similarity(spark, sf_dir):
    days = vectors(spark, sf_dir).withColumn("day", F.floor(F.col("vec_id") / 20))
    return rounded(
        day_similarity(days, ["label"], "day", "vec").select("label", "day", "lag_sim"), "lag_sim"
    )


@query(
    "rolling_day_similarity",
    f"""WITH {DAYS}
SELECT label, day, round(list_cosine_similarity(v, lag(v) OVER w), 6) + 0.0 AS rolling_sim FROM d
WHERE n_days > 21 WINDOW w AS (PARTITION BY label ORDER BY day)""",
)
def rolling_day_similarity_query(spark, sf_dir):
    days = vectors(spark, sf_dir).withColumn("day", F.floor(F.col("vec_id") / 20))
    sims = rolling_day_similarity(days, ["label"], "day", "vec", min_days=21)
    return rounded(sims.select("label", "day", "rolling_sim"), "rolling_sim")


@query(
    "columns_to_vector",
    """SELECT l_orderkey, l_linenumber, l_partkey,
       round(l_quantity, 6) + 0.0 AS x0, round(l_discount, 6) + 0.0 AS x1, round(l_tax, 6) + 0.0 AS x2
FROM lineitem""",
)
def columns_to_vector(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").withColumn(
        "v", to_vector(["l_quantity", "l_discount", "l_tax"])
    )
    cells = [r6(F.get("v", F.lit(i))).alias(f"x{i}") for i in range(3)]
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *cells)


@query(
    "vector_text_codec",
    f"""SELECT vec_id, len(embedding)::INT AS dim, round(list_sum(list_transform({V}, lambda x, i: x * i)), 6) + 0.0 AS total
FROM embeddings""",
)
def vector_text_codec(spark, sf_dir):
    text = vectors(spark, sf_dir).select("vec_id", read_vector(write_vector("vec")).alias("v"))
    total = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return text.select("vec_id", F.size("v").alias("dim"), r6(total).alias("total"))


@query(
    "cosine_of_pairs",
    f"""SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS sim
FROM (SELECT vec_id, {V} AS v FROM embeddings) a JOIN (SELECT vec_id, {V} AS v FROM embeddings) b
ON b.vec_id = a.vec_id + 1""",
)
def cosine_of_pairs(spark, sf_dir):
    a = vectors(spark, sf_dir).select("vec_id", "vec")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("next"))
    return a.join(b, "vec_id").select("vec_id", r6(cosine("vec", "next")).alias("sim"))


# Tokens of the documents in order, as SQL; the word pattern is that of functions.text.
WORD_SQL = r"""'[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*'"""
TOKENS = f"""tokens AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos
  FROM (SELECT doc_id, regexp_extract_all(lower(text), {WORD_SQL}) AS w FROM documents))"""


def stem_sql(c: str) -> str:
    for pattern, repl in ((r"^(.{3,})(?:ies)$", r"\1y"), (r"^(.{2,}[^s])s$", r"\1"),
                          (r"^(.{3,})(?:ing|edly|ed|ly)$", r"\1"), (r"^(.{3,})e$", r"\1")):
        c = f"regexp_replace({c}, '{pattern}', '{repl}')"
    return c


def stop_list() -> str:
    from tidewatch.functions.text import STOP_WORDS

    return ", ".join(f"'{w}'" for w in STOP_WORDS)


TERMS = f"""{TOKENS}, terms AS (SELECT doc_id, {stem_sql('token')} AS term, count(*) AS n FROM tokens
  WHERE token NOT IN ({stop_list()}) GROUP BY 1, 2)"""


@query("document_terms", f"WITH {TERMS} SELECT doc_id, term, n FROM terms")
def document_terms(spark, sf_dir):
    return term_counts(load(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "document_token_statistics",
    f"""WITH {TOKENS} SELECT d.doc_id, CAST(count(token) AS INTEGER) AS tokens,
CAST(count(DISTINCT token) AS INTEGER) AS types FROM documents d LEFT JOIN tokens USING (doc_id)
GROUP BY d.doc_id""",
)
def document_token_statistics(spark, sf_dir):
    return token_statistics(texts(spark, sf_dir), "doc_id", "text")


@query(
    "consecutive_document_similarity",
    f"""WITH {TERMS}, size AS (SELECT doc_id, sqrt(sum(n * n)) AS size FROM terms GROUP BY 1),
prev AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS previous FROM documents),
dots AS (SELECT p.doc_id, sum(a.n * b.n) AS dot FROM prev p JOIN terms a ON a.doc_id = p.doc_id
         JOIN terms b ON b.doc_id = p.previous AND b.term = a.term GROUP BY 1)
SELECT p.doc_id, p.previous, CASE WHEN x.size IS NOT NULL AND y.size IS NOT NULL
       THEN round(coalesce(dot, 0) / (x.size * y.size), 6) + 0.0 END AS similarity
FROM prev p LEFT JOIN size x ON x.doc_id = p.doc_id LEFT JOIN size y ON y.doc_id = p.previous
LEFT JOIN dots ON dots.doc_id = p.doc_id WHERE p.previous IS NOT NULL""",
)
def consecutive_document_similarity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    seq = in_order(docs.select("doc_id", "source"), ["source"], ["doc_id"]).rolling(
        {"previous": lambda w: F.lag("doc_id").over(w)}, back=1
    )
    parts = parts_of(docs, "text")
    counts = term_counts(docs, "doc_id", "text", parts=parts)
    # each text is in two pairs
    return rounded(neighbour_similarity(counts, seq.rows, "doc_id", 2 * parts), "similarity")


def md5_bucket(term, dim):
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


@query(
    "text_vectors_hashed",
    f"""WITH {TOKENS},
tf AS (SELECT doc_id, CAST(('0x' || md5(token)[1:8])::BIGINT % 64 AS INTEGER) AS bucket, count(*) AS tf
       FROM tokens GROUP BY 1, 2),
idf AS (SELECT bucket, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM tf GROUP BY 1),
w AS (SELECT doc_id, bucket, tf * idf AS w FROM tf JOIN idf USING (bucket)),
size AS (SELECT doc_id, sqrt(sum(w * w)) AS size FROM w GROUP BY 1)
SELECT doc_id, bucket, round(w / size, 6) + 0.0 AS w FROM w JOIN size USING (doc_id)
WHERE w <> 0""",
)
def text_vectors_hashed(spark, sf_dir):
    """Hashed TF-IDF vectors, shown as their non-zero cells."""
    v = text_vectors(load(spark, sf_dir, "documents"), "doc_id", "text", 64, md5_bucket)
    cells = v.select("doc_id", F.posexplode("embedding").alias("bucket", "w")).filter("w <> 0")
    return rounded(cells, "w")


@query(
    "new_text_vectors",
    ORACLE["text_vectors_hashed"].replace("WHERE w <> 0", "WHERE w <> 0 AND doc_id % 3 = 0"),
)
def new_text_vectors_query(spark, sf_dir):
    """Vectors of the documents that come second, weighed by the stored frequencies of both batches, as one run over all would."""
    documents, state = load(spark, sf_dir, "documents"), scratch_path(spark, "text-frequencies")
    first = documents.filter("doc_id % 3 <> 0")
    none = spark.createDataFrame([], "doc_id bigint")
    options = dict(key="doc_id", text="text", frequencies_path=state, dim=64, bucket=md5_bucket)
    before = new_text_vectors(first, none, batch="first", **options)
    v = new_text_vectors(documents, before, batch="second", **options)
    cells = v.select("doc_id", F.posexplode("embedding").alias("bucket", "w")).filter("w <> 0")
    return rounded(cells, "w")
