"""From a source's raw reports to coded events."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import pick, quoted, recode, valid_text, with_prefix
from tidewatch.functions.score_names import EMOTION_VOCABULARY, LIWC
from tidewatch.functions.text import read_mdy, remove_all, remove_at_end, remove_first
from tidewatch.operators.joins import bind_columns
from tidewatch.operators.scoring import dictionary_scores, passive_voice
from tidewatch.session import require_columns

# Bookkeeping columns of the multi-dictionary program's output.
BOOKKEEPING = ("TextID", "Segment", "SegmentID", "TokenCount")

# Misspelt facilities and a mistyped date in the nuclear reports.
FACILITY_NAMES = {
    "columbia generating statiregion:": "columbia generating station",
    "davis-besse": "davis besse",
    "washington nuclear (wnp-2region:": "washington nuclear",
    "vogtle 1/2": "vogtle",
    "vogtle 3/4": "vogtle",
    "fort calhoun": "ft calhoun",
    "summer construction": "summer",
}
DATE_REPAIRS = {"11/20/2103": "11/20/2013"}


@dataclass(frozen=True)
class Source:
    text: str
    placeholders: tuple[str, ...] = ()


SOURCES = {
    "asrs": Source("cmbd_narrative"),
    "nrc": Source("event_text"),
    "rail": Source("Narrative", ("None",)),
    "phmsa": Source("cmbd_narrative"),
    "psn": Source("Narrative_merged"),
}


@dataclass(frozen=True)
class Scores:
    """A table of precomputed scores: which columns, their new prefix, and how rows are matched.

    With ``key`` the tables join on it. Without one the rows correspond by position, and both sides
    need an order: ``order`` for the scores, ``report_order`` for the reports.
    """

    table: DataFrame
    columns: list[str] = field(default_factory=list)
    prefix: str = ""
    key: str | None = None
    order: tuple[str, ...] = ()
    report_order: tuple[str, ...] = ()


def liwc_scores(table: DataFrame, key: str | None = None, order=(), report_order=()) -> Scores:
    """All columns of the word-count program; a missing one is an error."""
    return Scores(require_columns(table, LIWC), LIWC, "liwc_", key, tuple(order), tuple(report_order))


def emotion_scores(table: DataFrame, order, report_order) -> Scores:
    names = EMOTION_VOCABULARY
    return Scores(require_columns(table, names), names, "emo_voc_", None, tuple(order), tuple(report_order))


def clean_reports(df: DataFrame, source: str) -> DataFrame:
    """What is particular to one reporting system."""
    if source == "nrc":
        df = recode(df, "event_date", DATE_REPAIRS)
        df = df.withColumns(
            {
                "event_date2": read_mdy("event_date"),
                "notification_date2": read_mdy("notification_date"),
                "event_text": F.lower("event_text"),
            }
        )
        df = recode(df, "facility", FACILITY_NAMES, lower=True)
        return df.drop("X")
    if source == "rail":
        df = df.withColumn("Narrative", remove_all("Narrative", "NoneNone"))
        return df.withColumn("Narrative", remove_at_end("Narrative", "None"))
    return df


def combine_phmsa_narratives(df: DataFrame) -> DataFrame:
    """Placeholders off (their first occurrence), contact pages out, both narratives merged."""
    for phrase in ("NO COMMENTS PROVIDED.", "NO COMMENTS PROVIDED", "n/a"):
        df = df.withColumns({c: remove_first(c, phrase) for c in ("narrative1", "narrative2")})
    contact = F.col("narrative1").contains("PART VIII – CONTACT INFORMATION")
    df = df.filter(~(F.col("narrative1").isNull() & F.col("narrative2").isNull())).filter(~contact)
    merged = F.concat_ws(" ", "narrative1", "narrative2")
    df = df.withColumn("cmbd_narrative", merged).drop("narrative1", "narrative2")
    return df.filter(~F.col("cmbd_narrative").isin("", " "))


def add_scores(df: DataFrame, scores: Scores) -> DataFrame:
    table = scores.table
    columns = scores.columns or pick(
        table, without=(*BOOKKEEPING, *scores.order, *([scores.key] if scores.key else []))
    )
    if scores.key:
        table = table.select(quoted(scores.key), *[quoted(c) for c in columns])
        return df.join(with_prefix(table, scores.prefix, columns), scores.key, "left")
    names = {c: f"_order_{c}" for c in scores.order}
    table = table.select(
        *[quoted(c).alias(n) for c, n in names.items()],
        *[quoted(c).alias(scores.prefix + c) for c in columns],
    )
    return bind_columns(df, table, list(scores.report_order), list(names.values())).drop(*names.values())


def code_events(
    reports: DataFrame,
    source: str,
    key: str,
    scores: list[Scores] = (),
    dictionaries: DataFrame | None = None,
    passive: bool = True,
) -> DataFrame:
    """Clean, bind given scores, keep valid texts, then score the narratives.

    Scores come before the text filter, as those without a key match the unfiltered rows.
    """
    about = SOURCES[source]
    df = clean_reports(reports, source) if source != "rail" else reports
    for s in scores:
        df = add_scores(df, s)
    if source == "rail":
        df = clean_reports(df, source)
    df = df.filter(valid_text(about.text, about.placeholders))
    if dictionaries is not None:
        df = dictionary_scores(df, key, about.text, dictionaries)
    return passive_voice(df, about.text) if passive else df
