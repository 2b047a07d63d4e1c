"""Training-corpus pipeline over documents: each stage works on what its predecessor kept.

Null texts: language identification rejects them, as it does texts without letters. Rows of equal id and
text are one document; rows without id can not be told apart, so near-dedup lets them pass. Columns of any
name stay as they are. An empty table gives an empty result; texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import language, personal_data, substrings
from tidewatch.llm.common import stored
from tidewatch.llm.packing import pack
from tidewatch.llm.simhash import near_duplicates


def with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns given, n_chars (where there is one) being that of the text as it is now."""
    return docs.select(*[F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def identified(spark, docs, sf_dir):
    """Documents whose language is predicted with enough certainty."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language.fit(docs.where(~held_out))
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no name can clash with what is added
    kept = language.identify(rows, model, f"c{docs.columns.index('text')}").where("accepted")
    return kept.select(*rows.columns).toDF(*docs.columns)


def first_of_near_duplicates(spark, docs, sf_dir):
    """One document of each group whose SimHash fingerprints link: that of the least id, then of the least text hash."""
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    number, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    key = F.struct(number.alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"))
    named = rows.where(number.isNotNull()).withColumn("key", key)
    # repeated rows fall together before the join, so that no key of it is hot
    once = named.dropDuplicates(["key"])
    groups = near_duplicates(named.select("key", text.alias("text")), "key")
    first = groups.where("key = component_id").select("key").distinct()
    kept = once.join(first, "key", "left_semi").select(*rows.columns)
    return kept.unionByName(rows.where(number.isNull())).toDF(*docs.columns)


def without_repeated_passages(spark, docs, sf_dir):
    """Documents without passages that an earlier one has; documents of nothing else go."""
    cut = substrings.remove_repeats(docs)
    return with_length(cut.where(r"removed_sentences = 0 or text rlike '[^\\x20\\x09-\\x0D]'"), docs.columns)


def redacted(spark, docs, sf_dir):
    """Documents with personal data and secrets replaced by their kind."""
    return with_length(personal_data.redact(docs, personal_data.fit(docs)), docs.columns)


def packed(spark, docs, sf_dir):
    """The token sequences' places of every piece of every document."""
    return pack(docs)


STAGES = [
    ("language", identified),
    ("near_dedup", first_of_near_duplicates),
    ("substring_dedup", without_repeated_passages),
    ("personal_data", redacted),
    ("packing", packed),
]

#: Neither trained models nor packing can be said in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each one's result stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
