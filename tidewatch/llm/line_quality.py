"""Quality rules on whole documents and on lines shared within a host, in DataFrame functions only.

Each text's own figures (words, symbols, repeated lines, repeated eight-word windows) come from array
functions inside its row. Across documents, every line with a word is normalised
(lower case, digits to 0, single spaces) and hashed with its host; a line standing in more than
``MOST_DOCUMENTS`` documents of one host is boilerplate and counts as removed, and a document that
loses more than ``MOST_LOST`` of its words that way is depleted. With ``copies=False`` exact copies count as one
document, so copying a document doesn't make its lines boilerplate. ``cleaned`` returns the texts without these lines.

The lines are stored once as hashes with their places. Line counts are aggregated before they are shuffled; the join of lines
with boilerplate lines is an inner equality join whose line side Spark can split. Repeated rows are one document. Null texts are empty: they have no words and fail. A null
host is a host of its own. Rows alike in id and text get the same verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
MOST_DOCUMENTS = 50
MOST_LOST = 0.5


def words_of(text):
    return F.array_remove(F.split(text, SPACE), "")


def own_figures(rows: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the rows' ``text``, which goes."""
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    kept = [c for c in rows.columns if c != "text"]
    split = rows.select(
        *kept,
        words_of(F.col("text")).alias("_words"),
        lines.alias("_lines"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    hashed = split.select(
        *kept,
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    window = F.expr(
        f"CASE WHEN n_words > {WINDOW} THEN transform(sequence(0, cast(n_words as int) - {WINDOW}), i -> xxhash64("
        + ", ".join(f"_hashes[i + {k}]" for k in range(WINDOW))
        + ")) ELSE array() END"
    )
    windows = hashed.withColumn("_windows", window).drop("_hashes")
    counted = windows.withColumn("_again", F.size("_windows") > F.size(F.array_distinct("_windows")))
    placed = counted.withColumn(
        "_placed", F.expr("CASE WHEN _again THEN sort_array(transform(_windows, (h, i) -> struct(h as h, i as i))) END")
    ).drop("_windows")
    starts = placed.withColumn(
        "_starts",
        F.expr(
            "CASE WHEN _again THEN filter(transform(_placed, (p, k) -> CASE WHEN p.h = get(_placed, k - 1).h OR p.h = get(_placed, k + 1).h THEN p.i END), i -> i IS NOT NULL) END"
        ),
    ).drop("_placed")
    covered = F.expr(f"CASE WHEN _again THEN size(array_distinct(flatten(transform(_starts, i -> sequence(i, i + {WINDOW - 1}))))) ELSE 0 END")
    return starts.withColumn("n_repeat_words", covered.cast("long")).drop("_again", "_starts")


def shared_lines(rows: DataFrame) -> DataFrame:
    """(id, th, at, line, n): the place, hash with the host, and words of every normalised line that has a word."""
    plain = F.regexp_replace(F.lower("text"), "[0-9]+", "0")
    lines = rows.select("id", "th", "host", F.posexplode(F.split(plain, "\n")).alias("at", "_line"))
    worded = lines.select("id", "th", "at", "host", words_of(F.col("_line")).alias("_words")).where(F.size("_words") > 0)
    return worded.select("id", "th", "at", F.xxhash64("host", F.array_join("_words", " ")).alias("line"), F.size("_words").alias("n"))


def lines_above(rows: DataFrame, most: int, copies: bool) -> DataFrame:
    """(id1, th1, at, n): place and words of every line that stands in too many documents of its host."""
    lines = stored(shared_lines(rows), "lines")
    each = lines.select("line", "th", *(["id"] if copies else [])).distinct()
    common = each.groupBy("line").agg(F.count("*").alias("documents")).where(F.col("documents") > most).select("line")
    common = stored(common, "common-lines")  # then both sides of the join are plain shuffles, and a hot line is split
    # rows alike in id and text have the same lines
    return lines.join(common, "line").select(F.col("id").alias("id1"), F.col("th").alias("th1"), "at", "n").distinct()


def with_host(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host")
    ).withColumn("th", F.xxhash64("text"))


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    most: int = MOST_DOCUMENTS,
    most_lost: float = MOST_LOST,
    copies: bool = True,
) -> DataFrame:
    """One row per document: its figures, base_failed, removed_lines, removed_words and kept."""
    rows = with_host(docs, id_col, text_col, host_col)
    removed = lines_above(rows, most, copies).groupBy("id1", "th1").agg(F.count("*").alias("removed_lines"), F.sum("n").alias("removed_words"))
    return verdict(own_figures(rows.select("id", "th", "text")), removed, id_col, most_lost)


def cleaned(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    most: int = MOST_DOCUMENTS,
    most_lost: float = MOST_LOST,
    copies: bool = True,
) -> DataFrame:
    """The rows with the text without its lines above the limit, and removed_lines, removed_words and kept."""
    added = ["removed_lines", "removed_words", "kept"]
    columns = [c for c in docs.columns if c.lower() not in added]
    marks = lines_above(with_host(docs, id_col, text_col, host_col), most, copies)
    removed = marks.groupBy("id1", "th1").agg(F.collect_list("at").alias("gone"), F.count("*").alias("removed_lines"), F.sum("n").alias("removed_words"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    left = F.array_join(F.filter(F.split(F.col("row").getField(text_col), "\n"), lambda line, i: ~F.array_contains("gone", i)), "\n")
    cut = F.when(F.col("gone").isNull(), F.col("row").getField(text_col)).otherwise(left)
    shown = [(cut if c == text_col else F.col("row").getField(c)).alias(c) for c in columns]
    return verdict(own_figures(held), removed, id_col, most_lost, shown, added)


def verdict(
    figures: DataFrame, removed: DataFrame, id_col: str, most_lost: float, shown: list | None = None, added: list[str] | None = None
) -> DataFrame:
    """The figures with the verdict; or, of ``shown`` columns and these, only those that ``added`` names."""
    zero = F.lit(0).cast("long")
    met = figures.join(removed, F.expr("id <=> id1 and th = th1"), "left")
    lost = F.coalesce("removed_words", zero)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    results = {
        "base_failed": failed,
        "removed_lines": F.coalesce("removed_lines", zero),
        "removed_words": lost,
        "kept": ~failed & (lost <= most_lost * F.col("n_words")),
    }
    if shown is None:
        shown, added = [F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], list(results)
    return met.select(*shown, *[results[c].alias(c) for c in added])
