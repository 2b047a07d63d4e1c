"""Row-local text functions: counts, clean-up, dates, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word: letters or digits, with inner apostrophes and hyphens.
WORD = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_word_runs(text) -> Column:
    """Runs of letters, digits and underscores, in any script."""
    return F.regexp_count(_col(text), F.lit(r"[\p{L}\p{N}_]+"))


def count_blank_separated(text) -> Column:
    squeezed = F.regexp_replace(_col(text), r"^\s+|\s+$", "")
    return F.when(squeezed == "", 0).otherwise(F.size(F.split(squeezed, r"\s+", -1)))


def merge_text(*columns, sep: str = " ") -> Column:
    """Texts pasted in order, missing ones left out."""
    return F.concat_ws(sep, *[_col(c) for c in columns])


def literal(pattern: str) -> str:
    return r"\Q" + pattern + r"\E"


def remove_all(text, phrase: str) -> Column:
    return F.replace(_col(text), F.lit(phrase), F.lit(""))


def remove_first(text, phrase: str) -> Column:
    """Only the first occurrence of a literal phrase."""
    return F.regexp_replace(_col(text), r"(?s)^(.*?)" + literal(phrase), "$1")


def remove_at_end(text, phrase: str) -> Column:
    return F.regexp_replace(_col(text), literal(phrase) + r"\z", "")


def read_date(text, *formats: str) -> Column:
    """The first format that fits; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(_col(text), F.lit(f)).cast("date") for f in formats])


def read_mdy(text) -> Column:
    return read_date(text, "M/d/yyyy")


def read_ymd(text) -> Column:
    return read_date(text, "yyyy-M-d")


def read_month(text) -> Column:
    """YYYYMM as the first day of the month."""
    return read_date(F.concat(F.substring(_col(text), 1, 6), F.lit("01")), "yyyyMMdd")


def words(text, lower: bool = True) -> Column:
    """Words of a text in order; an empty array for a missing text."""
    c = F.lower(_col(text)) if lower else _col(text)
    return F.coalesce(
        F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.array().cast("array<string>")
    )


def phrases(tokens: Column, size: int) -> Column:
    """Runs of ``size`` neighbouring words, joined by one blank.

    ``tokens`` must be a column, not an expression, which would be computed for every run.
    """
    if size == 1:
        return tokens
    runs = F.transform(
        F.sequence(F.lit(1), F.size(tokens) - (size - 1)),
        lambda i: F.array_join(F.slice(tokens, i, size), " "),
    )
    return F.when(F.size(tokens) >= size, runs).otherwise(F.array().cast("array<string>"))


# English function words left out of term counts.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing would should could
ought a an the and but if or because as until while of at by for with about against between into
through during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not only
own same so than too very will
""".split()


def stem(token) -> Column:
    """A short suffix rule: plural and verb endings off, as long as three letters remain."""
    c = _col(token)
    c = F.regexp_replace(c, r"^(.{3,})(?:ies)$", "$1y")
    c = F.regexp_replace(c, r"^(.{2,}[^s])s$", "$1")
    c = F.regexp_replace(c, r"^(.{3,})(?:ing|edly|ed|ly)$", "$1")
    return F.regexp_replace(c, r"^(.{3,})e$", "$1")
