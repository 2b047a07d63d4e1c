"""Substring dedup by sliding sentence spans.

A text is cut into sentences at line ends and after closing punctuation. From every sentence a span runs over
at least ``SENTENCES`` consecutive sentences, as many more as it takes to reach ``WORDS`` words, and likewise
back from every sentence, so that a repeated passage is covered to its last sentence too. A span is hashed on its normalised sentences. A span that occurs more than once in the corpus keeps its first occurrence, by
id and then by position; every sentence that another occurrence covers is removed.
As each position starts a span, a repeated passage is found from its first whole sentence to its last,
wherever it stands. ``WORDS`` only keeps trivial runs ("Yes. No.") out. A sentence of more than ``ALONE`` words also makes a span by itself, so a repeated
passage without sentence ends inside is found too.

Spans are aggregated before they are shuffled, so a passage in a third of all documents gathers nowhere;
the join that marks its occurrences has a narrow, splittable side. Hashes have 96 bits.

Null and empty texts have no sentences and come back as they are (null stays null). Rows alike in id
and text count as one document and come back alike; texts of one id keep what they share among
themselves, and so do those without id, which come after all others. Kept sentences keep their characters, order and the
white space after them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import bounded_slices, stored
from tidewatch.session import counted_side

SENTENCES = 2
WORDS = 5
#: A single sentence of more words is a span by itself.
ALONE = 20
#: Where one sentence ends and the next begins: line ends, and closing punctuation before white space.
BREAK = re.compile(r"[.!?…。\n](?:(?<=\n)\s*|[^\w\s]*\s+)")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence, the white space after it included; together they are the whole text."""
    cuts = [0, *(m.end() for m in BREAK.finditer(text)), len(text)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def span_hashes(text: str, sentences: int = SENTENCES, words: int = WORDS, alone: int = ALONE) -> list[tuple[int, int, int, int, bool]]:
    """(first sentence, number of sentences, hash, check, repeated from earlier in the text) of the spans of a text."""
    parts = [text[a:b].lower().split() for a, b in sentence_spans(text)]
    counts = [len(p) for p in parts]
    digests = [xxhash.xxh3_128_digest(" ".join(p).encode("utf-8", "surrogatepass")) for p in parts]
    out, seen = [], set()

    def add(first: int, size: int, value: int) -> None:
        out.append((first, size, (value & (2**64 - 1)) - 2**63, (value >> 64) & 0x7FFFFFFF, value in seen))
        seen.add(value)

    end, total, forward = 0, 0, set()
    for i, count in enumerate(counts):
        while end < len(parts) and (end - i < sentences or total < words):
            total += counts[end]
            end += 1
        if total >= words and end - i >= sentences and count:
            forward.add((i, end))
            add(i, end - i, xxhash.xxh3_128_intdigest(b"".join(digests[i:end])))
        if count > alone:
            add(i, 1, xxhash.xxh3_128_intdigest(digests[i], seed=1))
        total -= count
    start, total = 0, 0
    for i, count in enumerate(counts):  # and the shortest spans that end with each sentence
        total += count
        while i - start >= sentences and total - counts[start] >= words:
            total -= counts[start]
            start += 1
        if total >= words and i + 1 - start >= sentences and (start, i + 1) not in forward:
            add(start, i + 1 - start, xxhash.xxh3_128_intdigest(b"".join(digests[start : i + 1])))
    return out


def spans(rows: DataFrame, sentences: int, words: int) -> DataFrame:
    """(id, th, at, size, h, c, again): all spans of the rows (id, th, text)."""

    def run(batches):
        for part in bounded_slices(batches):
            owner, made = [], []
            for i, text in enumerate(part.column(2).to_pylist()):
                found = span_hashes(text, sentences, words)
                owner += [i] * len(found)
                made += found
            at, size, h, c, again = np.array(made, np.int64).reshape(-1, 5).T
            own = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(k).take(own) for k in (0, 1)),
                    *(pa.array(x.astype(np.int32)) for x in (at, size)),
                    pa.array(h),
                    pa.array(c.astype(np.int32)),
                    pa.array(again.astype(bool)),
                ],
                names=["id", "th", "at", "size", "h", "c", "again"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, th bigint, at int, size int, h bigint, c int, again boolean"
    return rows.select("id", "th", "text").mapInArrow(run, schema)


def without(text: str, marks: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the marked sentences, and how many sentences and words went."""
    cuts = sentence_spans(text)
    gone = {k for at, size in marks for k in range(at, at + size)}
    words = sum(len(text[a:b].split()) for k, (a, b) in enumerate(cuts) if k in gone)
    return "".join(text[a:b] for k, (a, b) in enumerate(cuts) if k not in gone), len(gone), words


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = SENTENCES, words: int = WORDS, keep: list[str] | None = None
) -> DataFrame:
    """The kept columns (all of them, if not named) with the text deduplicated, and removed_sentences, removed_words."""
    keep = docs.columns if keep is None else keep
    added = ["removed_sentences", "removed_words"]
    keep = [c for c in keep if c.lower() not in added]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    found = spans(rows, sentences, words)
    repeated = found.groupBy("h", "c").agg(F.min("id").alias("id0"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = stored(repeated, "repeated-spans")  # then both sides of the join are plain shuffles, and a hot span is split, unless few are broadcast
    later = found.join(counted_side(repeated), ["h", "c"]).where("again or id > id0 or (id is null and id0 is not null)")
    marks = later.groupBy("id", "th").agg(F.collect_set(F.struct("at", "size")).alias("_marks"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"))
    marks = marks.select(F.col("id").alias("id1"), F.col("th").alias("th1"), F.col("_marks").alias("marks"))
    met = whole.join(marks, F.expr("id <=> id1 and th = th1"), "left").select(
        *[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col("row").getField(text_col).alias("_text"), "marks"
    )
    return cleaned(met, [docs.schema[c] for c in keep], text_col)


def cleaned(met: DataFrame, kept: list, text_col: str) -> DataFrame:
    """Cuts the marked sentences out of each row's text."""
    place = next((i for i, f in enumerate(kept) if f.name == text_col), None)
    schema = T.StructType([*kept, T.StructField("removed_sentences", T.IntegerType()), T.StructField("removed_words", T.IntegerType())])
    n = len(kept)

    def run(batches):
        for part in bounded_slices(batches, "_text"):
            texts, marks = part.column(n).to_pylist(), part.column(n + 1).to_pylist()
            done = [without(t, [(m["at"], m["size"]) for m in ms]) if ms else (t, 0, 0) for t, ms in zip(texts, marks, strict=True)]
            columns = [part.column(i) for i in range(n)]
            if place is not None:
                columns[place] = pa.array([d[0] for d in done], part.column(n).type)
            columns += [pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return met.mapInArrow(run, schema)
