"""SimHash near-duplicates found by deletion variants of few segments.

A fingerprint has 64 bits; texts link at three or fewer differing bits. Cut into two segments of 32
bits, two linked fingerprints agree in one segment up to a single bit, so they share one of its 32
one-wildcard variants (the segment with one bit left out). Equality of variants finds every link.
Fingerprints in one bucket are compared there while they are few. A bucket with more members than
``BUCKET`` is indexed again: its members agree on 31 bits, so the other segment is cut in two and its
variants join the key, then once more. After the third cut at most 2^11 different fingerprints can
share a key, so buckets end up bounded whatever the data. A bucket hands on one link per member, not
its pairs: members of one connected group there are linked to the group's least fingerprint.

Texts without words have fingerprint zero and link like any other; null text is empty text. Equal
fingerprints are one node, whatever their number, so copies make no pairs. Null ids take part but
never name a component unless all its ids are null.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import attach, id_and_text, stored
from tidewatch.llm.components import connected
from tidewatch.session import counted_side

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
MAX_DISTANCE = 3
BUCKET = 2048
#: Bits of the parts that the levels cut a segment into.
LEVELS = (32, 16, 8)


def shingle_hashes(text: str, width: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` words joined by a space; of all words where they are fewer."""
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    joined, ends, at = b" ".join(raw), [], -1
    for w in raw:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    last = ends[width - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, last)], np.uint64)  # noqa: B905


def bit_majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes."""
    if not len(hashes):
        return 0
    sums = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 4096):
        part = hashes[low : low + 4096]
        sums += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of every text as a signed long."""

    def make():
        def compute(texts):
            bits = np.array([bit_majority(shingle_hashes(t, width)) for t in texts.to_pylist()], np.uint64)
            return [pa.array(bits.view(np.int64))]

        return compute

    return attach(id_and_text(docs, id_col, text_col), "text", make, "fp bigint", keep=["id"])


def variants(half: int, fp: str = "fp", from_bit: str = "0"):
    """Array of (part, left out, rest): the one-wildcard variants of the two parts of a stretch of bits."""
    parts = []
    for part in (0, 1):
        bits = f"(shiftrightunsigned({fp}, {from_bit} + {part * half}) & {(1 << half) - 1}L)"
        parts.append(f"transform(sequence(0, {half - 1}), b -> struct({part} as part, b as hole, {bits} & ~shiftleft(1L, b) as rest))")
    return F.expr(f"concat({parts[0]}, {parts[1]})")


def next_index(members: DataFrame, level: int) -> DataFrame:
    """Variants of the bits that members of a bucket need not share; the key grows by the variant.

    Level 0 cuts all 64 bits; a later one cuts the half that the key above does not fix.
    """
    bits = LEVELS[level]
    if level == 0:
        v = members.withColumn("v", F.explode(variants(bits)))
        return v.select("fp", F.xxhash64("v").alias("key"), F.when(F.col("v.part") == 0, 32).otherwise(0).alias("open"))
    v = members.withColumn("v", F.explode(variants(bits, "fp", "open")))
    opened = F.col("open") + F.when(F.col("v.part") == 0, bits).otherwise(0)
    return v.select("fp", F.xxhash64("key", "v").alias("key"), opened.alias("open"))


def links_in_bucket(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """For each fingerprint linked to a smaller one in the bucket, directly or through others: (least, itself)."""
    if len(fps) == 2:
        low, high = sorted(fps.tolist())
        return [(low, high)] if 0 < ((low ^ high) & (2**64 - 1)).bit_count() <= distance else []
    fps = np.unique(fps)
    seen = np.zeros(len(fps), bool)
    out = []
    bits = fps.view(np.uint64)
    for i in range(len(fps)):
        if seen[i]:
            continue
        seen[i], front = True, [i]
        while front:
            j = front.pop()
            near = np.flatnonzero(~seen & (np.bitwise_count(bits ^ bits[j]) <= distance))
            seen[near] = True
            out.extend((int(fps[i]), int(fps[k])) for k in near)
            front.extend(near.tolist())
    return out


def bucket_links(buckets: DataFrame, distance: int) -> DataFrame:
    """(a, b) for every bucket given as an array ``fps`` of bounded length."""

    def run(batches):
        for batch in batches:
            pairs = []
            for fps in batch.column(0):
                pairs += links_in_bucket(np.array(fps.as_py(), np.int64), distance)
            a, b = zip(*set(pairs), strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return buckets.select("fps").mapInArrow(run, "a bigint, b bigint")


def fingerprint_links(nodes: DataFrame, distance: int = MAX_DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between different fingerprints that join the same pairs into groups as all links do."""
    index = next_index(nodes.select("fp"), 0)
    found = None
    for level in range(len(LEVELS)):
        last = level == len(LEVELS) - 1
        sizes = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        few = sizes if last else sizes.where(F.col("n") <= bucket)
        # by merging: Spark takes the variants for no larger than the fingerprints they are made from, and would broadcast them
        members = index.join(few.hint("merge"), "key").groupBy("key").agg(F.collect_list("fp").alias("fps"))
        links = bucket_links(members, distance)
        found = links if found is None else found.unionByName(links)
        if last:
            break
        many = stored(sizes.where(F.col("n") > bucket).select("key"), f"full-buckets-{level}")
        if many.isEmpty():
            break
        index = stored(next_index(index.join(counted_side(many), "key"), level + 1), f"bucket-index-{level + 1}")
    return found.distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = MAX_DISTANCE, bucket: int = BUCKET
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the least id reachable by links)."""
    if distance != MAX_DISTANCE:
        raise ValueError("two segments with one wildcard find links of three bits")
    prints = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-nodes")
    links = stored(fingerprint_links(nodes, distance, bucket), "fingerprint-links")
    groups = connected(links)
    labelled = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    least = labelled.groupBy("group").agg(F.min("least").alias("component_id"))
    # stored, so that both sides of the last join are plain shuffles and a hot fingerprint is split, unless few are broadcast
    named = stored(labelled.join(least, "group").select("fp", "component_id"), "components")
    return prints.join(counted_side(named), "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
