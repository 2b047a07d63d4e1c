"""Importance resampling of documents towards a target distribution.

A text's features are its runs of one to three words, hashed into ``BUCKETS`` buckets by CRC-32. A bucket's
gain is the thousandfold logarithm of its share in the target texts over its share in all documents, and a
document weighs the sum of its features' gains, read from one array. Keyed Gumbel noise turns weights into
scores whose highest are a draw without replacement; a distributed radix sort ranks them (see ``radix``).

Words are runs of bytes other than ASCII punctuation, blanks and controls, A-Z lower-cased, so other scripts'
words count too. Null and empty texts have no features and weigh 0; with ``least_words`` above 0 they are never
drawn. Texts are worked on whole, ``PIECE`` bytes at a time. Repeated rows each take part; equal scores are
ordered by id, then by the number of features. A null id counts as an empty one and comes after all others on a
tie. Ids are whole numbers. An empty table of documents gives an empty result, an empty target gains from
the smoothing alone. Other columns neither matter nor clash.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import attach, bounded_slices, id_and_text, stored
from tidewatch.llm.radix import ranked

BUCKETS = 10_000
LONGEST_RUN = 3
PIECE = 1_000_000
#: Bytes of words as they are, A-Z lower-cased; all others become blanks.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def word_pieces(text: str | None):
    """The words of a text in lists of bounded size."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(TABLE)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def feature_buckets(text: str | None, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> tuple[int, list[np.ndarray]]:
    """The number of words, and the buckets of all runs of up to ``longest`` words; a run's checksum goes on from its first words'."""
    n, last, found = 0, [], []
    for words in word_pieces(text):
        n += len(words)
        words = last + words
        spaced = [b" " + w for w in words]
        sums = list(map(crc32, words))
        every = sums[len(last) :]
        for k in range(1, longest):
            sums = list(map(crc32, spaced[k:], sums))
            # a run that ends among the words carried over was counted with them
            every += sums[max(0, len(last) - k) :]
        found.append(np.array(every, np.uint32) % np.uint32(buckets))
        last = words[-(longest - 1) :] if longest > 1 else []
    return n, found


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket holds; every task sends one sum per bucket."""

    def count(batches):
        sums = np.zeros(buckets, np.int64)
        for part in bounded_slices(batches, "text"):
            for text in part.column(0).to_pylist():
                for found in feature_buckets(text, buckets)[1]:
                    sums += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    parts = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def gains(target: np.ndarray, every: np.ndarray) -> np.ndarray:
    """The gain of each bucket, a whole number of thousandths."""
    t, s, k = float(target.sum()), float(every.sum()), len(every)
    return np.array([math.floor(1000 * math.log((a + 1.0) * (s + k) / ((b + 1.0) * (t + k)))) for a, b in zip(target, every)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every text."""

    def make():
        def compute(texts):
            rows = []
            for text in texts.to_pylist():
                n, found = feature_buckets(text, len(gain))
                rows.append((n, sum(map(len, found)), sum(int(gain[f].sum()) for f in found)))
            columns = zip(*rows) if rows else ((), (), ())
            return [pa.array(c, pa.int64()) for c in columns]

        return compute

    return attach(id_and_text(docs, id_col, text_col), "text", make, "n_words bigint, n_features bigint, weight bigint", keep=["id"])


def noise(id_col: str, seed: int) -> Column:
    """Thousandths of standard Gumbel noise from the first 32 bits of a hash of seed and id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: int = 42
) -> DataFrame:
    """One row per document: id, n_features, weight, score, and the rank of those drawn.

    Drawn are ``percent`` of a hundred of the documents of at least ``least_words`` words, rounded down.
    """
    gain = gains(bucket_counts(target, target_col), bucket_counts(docs, text_col))
    scored = weights(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise("id", seed))
    scored = stored(scored, "resampling-scores")
    fit = scored.where(F.col("n_words") >= least_words).drop("n_words").withColumns(
        {"missing": F.col("id").isNull().cast("long"), "number": F.coalesce(F.col("id").cast("long"), F.lit(0))}
    )
    placed = stored(ranked(fit, [("score", False), ("missing", True), ("number", True), ("n_features", True)]), "resampling-ranks")
    drawn = placed.count() * percent // 100
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    return placed.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(
        scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    )


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of the documents drawn, all columns as they are; rows that share a drawn id stay together."""
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    ids = resample(docs, target, id_col=id_col, **options).where("rank is not null").select(F.col(id_col).alias("drawn_id")).distinct()
    kept = rows.join(ids, F.col(f"c{docs.columns.index(id_col)}").eqNullSafe(F.col("drawn_id")), "left_semi")
    return kept.toDF(*docs.columns)
