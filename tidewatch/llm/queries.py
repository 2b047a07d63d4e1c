"""The registered queries of the document operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.llm.common import read_documents
from tidewatch.llm import language, personal_data, pieces, toxicity
from tidewatch.llm.fingerprints import edited_likeness
from tidewatch.llm.line_quality import quality
from tidewatch.llm.one_bit_codes import nearest
from tidewatch.llm.packing import pack
from tidewatch.llm.prefix_trie import numbered_turns, prefix_nodes, with_family_heads
from tidewatch.llm.resampling import resample
from tidewatch.llm.simhash import near_duplicates
from tidewatch.llm.substrings import remove_repeats
from tidewatch.llm.token_counts import token_counts


def op1_substring_dedup(spark, sf_dir):
    return remove_repeats(read_documents(spark, sf_dir), keep=["doc_id", "text"])


def op2_fingerprints(spark, sf_dir):
    return edited_likeness(read_documents(spark, sf_dir))


def held_out(modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves the remainder; null ids are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def op3_language(spark, sf_dir):
    docs = read_documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out(3, 1)))
    rows = docs.select("doc_id", held_out(3, 1).alias("held_out"), "text")
    return language.identify(rows, model, keep=["doc_id", "held_out"])


def op4_toxicity(spark, sf_dir):
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~held_out(5, 0)))
    return toxicity.score(docs.withColumn("held_out", held_out(5, 0)), model, keep=["doc_id", "held_out"])


def op5_line_quality(spark, sf_dir):
    return quality(read_documents(spark, sf_dir))


OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents
), parts AS (
  SELECT doc_id, host, text,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM docs
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM parts WHERE len(words) > 8)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, range(8) AS r(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, host, text, words, array_to_string(words, ' ') AS line FROM (
    SELECT doc_id, host, text, list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM (SELECT doc_id, host, text, unnest(string_split(regexp_replace(lower(text), '[0-9]+', '0', 'g'), chr(10))) AS l FROM docs))
  WHERE len(words) > 0
), common AS (
  SELECT host, line FROM lines GROUP BY host, line HAVING count(DISTINCT doc_id) > 50
), removed AS (
  SELECT doc_id, count(*) AS lines, sum(len(words)) AS words FROM lines JOIN common USING (host, line) GROUP BY doc_id
), figures AS (
  SELECT p.doc_id, len(p.words) AS n_words, length(array_to_string(p.words, '')) AS word_chars,
    length(regexp_replace(p.text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(p.lines) - len(list_distinct(p.lines)) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, coalesce(r.lines, 0) AS removed_lines, coalesce(r.words, 0) AS removed_words
  FROM parts p LEFT JOIN covered c USING (doc_id) LEFT JOIN removed r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, removed_lines,
  CAST(removed_words AS BIGINT) AS removed_words,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND removed_words <= 0.5 * n_words AS kept
FROM figures
"""


def op6_merge_dropout(spark, sf_dir):
    return pieces.encode(read_documents(spark, sf_dir))


def op7_personal_data(spark, sf_dir):
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return personal_data.personal_data(docs, personal_data.fit(docs))


def op8_simhash(spark, sf_dir):
    return near_duplicates(read_documents(spark, sf_dir))


def op9_token_counts(spark, sf_dir):
    return token_counts(read_documents(spark, sf_dir))


def op10_best_fit_packing(spark, sf_dir):
    return pack(read_documents(spark, sf_dir))


def op11_importance_resampling(spark, sf_dir):
    return resample(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 of each different feature, byte by byte over the table of its polynomial 0xEDB88320.
OP11_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), texts AS (
  SELECT doc_id AS id, 0 AS target, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT NULL, 1, row_number() OVER (), coalesce(text, '') FROM benchmark
), words AS (
  SELECT id, target, row, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM texts
), features AS (
  SELECT target, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM words
), counted AS (
  SELECT target, row, f, count(*) AS n FROM features GROUP BY ALL
), bytes AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
), hashed AS (
  SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc_table
), in_buckets AS (
  SELECT target, row, bucket, n FROM counted JOIN hashed USING (f)
), sums AS (
  SELECT bucket, sum(n) FILTER (target = 1) AS t, sum(n) FILTER (target = 0) AS s FROM in_buckets GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE)))::BIGINT AS gain FROM sums
), weighed AS (
  SELECT row, sum(n) AS n_features, sum(n * gain) AS weight FROM in_buckets JOIN gains USING (bucket) WHERE target = 0 GROUP BY row
), scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('42:' || id)[1:8])::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (row) WHERE target = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_words >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""


def op12_prefix_trie(spark, sf_dir):
    turns = numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_nodes(*with_family_heads(turns))


OP12_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn FROM conversations WHERE conv_id IS NOT NULL
), lengths AS (
  SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id
), convs AS (
  SELECT c.conv_id, b.conv_id AS first, h, least(h, coalesce(b.n, 0)) AS taken FROM (
    SELECT conv_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 6 AS h FROM lengths, crc_table
  ) c LEFT JOIN lengths b ON b.conv_id = c.conv_id - c.conv_id % 100
), rebuilt AS (
  SELECT c.conv_id, pos, turn FROM convs c JOIN own o ON o.conv_id = c.first AND pos <= h
  UNION ALL SELECT c.conv_id, pos - h + taken, turn FROM convs c JOIN own o ON o.conv_id = c.conv_id AND pos > h
), paths AS (
  SELECT c.conv_id, coalesce(path, []) AS path FROM convs c LEFT JOIN (SELECT conv_id, list(turn ORDER BY pos) AS path FROM rebuilt GROUP BY 1) USING (conv_id)
), members AS (
  SELECT conv_id, path[1:d] AS node, d, d = len(path) AS ends FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM paths)
), nodes AS (
  SELECT node, d, count(*) AS n_convs, min(conv_id) AS conv_id,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY node, d
), children AS (
  SELECT node[1:d - 1] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
), measured AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(n.node[d].text) END AS saved
  FROM nodes n LEFT JOIN children c USING (node)
), sums AS (
  SELECT node[1:k] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM measured) GROUP BY 1
)
SELECT m.conv_id, m.d AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM measured m JOIN sums USING (node) LEFT JOIN nodes p ON m.d > 0 AND p.node = m.node[1:m.d - 1]
"""


def op13_one_bit_neighbours(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


#: All products, summed in order in double precision.
OP13_SQL = """
WITH vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM pairs QUALIFY rank <= 20
"""


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_fingerprints": op2_fingerprints,
    "op3_language": op3_language,
    "op4_toxicity": op4_toxicity,
    "op5_line_quality": op5_line_quality,
    "op6_merge_dropout": op6_merge_dropout,
    "op7_personal_data": op7_personal_data,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_one_bit_neighbours": op13_one_bit_neighbours,
}

ORACLE: dict[str, str] = {"op5_line_quality": OP5_SQL, "op11_importance_resampling": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_one_bit_neighbours": OP13_SQL}
