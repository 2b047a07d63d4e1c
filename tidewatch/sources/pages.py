"""Fields out of stored report pages and report texts."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element ids of the event report pages, by field.
REPORT_FIELDS = {
    "event_num": "ContentPlaceHolderMainPageContent_Label1EventNumber",
    "facility": "ContentPlaceHolderMainPageContent_Label1Facility",
    "emerg_class": "ContentPlaceHolderMainPageContent_Label1EmergencyClass",
    "10_cfr_sec": "ContentPlaceHolderMainPageContent_Label110CFRSection",
    "last_update_date": "ContentPlaceHolderMainPageContent_Label1LastUpdateDate",
    "event_date": "ContentPlaceHolderMainPageContent_Label1EventDate",
    "event_time": "ContentPlaceHolderMainPageContent_Label1EventTime",
    "notification_date": "ContentPlaceHolderMainPageContent_Label1NotificationDate",
    "notification_time": "ContentPlaceHolderMainPageContent_Label1NotificationTime",
    "region": "ContentPlaceHolderMainPageContent_Label1Region",
    "state": "ContentPlaceHolderMainPageContent_Label1State",
    "rx_type": "ContentPlaceHolderMainPageContent_Label1RXType",
    "unit": "ContentPlaceHolderMainPageContent_LabelUnit1",
    "scram_code": "ContentPlaceHolderMainPageContent_LabelSCRAMCode1",
    "rx_crit": "ContentPlaceHolderMainPageContent_LabelRXCrit1",
    "initial_pwr": "ContentPlaceHolderMainPageContent_LabelInitialPower1",
    "initial_rx_mode": "ContentPlaceHolderMainPageContent_LabelInitialRXMode1",
    "current_pwr": "ContentPlaceHolderMainPageContent_LabelCurrentPower1",
    "currenct_rx_mode": "ContentPlaceHolderMainPageContent_LabelCurrentRXMode1",
    "event_text": "ContentPlaceHolderMainPageContent_LabelEventText",
}


def by_id(element_id: str) -> str:
    """The opening tag of the element with that id; its name is group 1."""
    return rf'(?is)<(\w+)\b[^>]*\bid="{re.escape(element_id)}"[^>]*>'


def by_tag(tag: str) -> str:
    """The opening tag of the first element of that name."""
    return rf"(?is)<({tag})\b[^>]*>"


#: Every tag of a page: a slash before its name, the name, and a slash at its end.
TAG = re.compile(r"<(/?)(\w+)\b[^>]*?(/?)>", re.ASCII | re.DOTALL)


def elements(html: str | None, openings: list[re.Pattern]) -> list[str | None]:
    """What stands between each opening tag and its own closing tag, elements of the same name inside included;
    None where there is no such element or it is never closed. The page's tags are listed once."""
    if html is None:
        return [None] * len(openings)
    tags: dict[str, list[tuple[int, int, int]]] = {}  # name → (start, end, change of depth)
    for tag in TAG.finditer(html):
        change = -1 if tag[1] else 0 if tag[3] else 1
        tags.setdefault(tag[2].lower(), []).append((tag.start(), tag.end(), change))
    found: list[str | None] = []
    for opening in openings:
        start, depth, text = opening.search(html), 1, None
        if start:
            same = tags.get(start[1].lower(), [])
            for at, _, change in same[bisect_left(same, (start.end(),)) :]:
                depth += change
                if not depth:
                    text = html[start.end() : at]
                    break
        found.append(text)
    return found


def inner_text(html: Column) -> Column:
    """Text without tags, with the common entities read, trimmed."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                         ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def extract_fields(
    pages: DataFrame, html: str, locators: dict[str, str]
) -> DataFrame:
    """One text column per opening tag of an element (see ``by_id``, ``by_tag``); null where there is no element."""
    names = list(locators)

    @F.pandas_udf(T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(len(names))]))
    def scan(column: pd.Series) -> pd.DataFrame:
        openings = [re.compile(locators[n], re.ASCII) for n in names]
        rows = [elements(page, openings) for page in column]
        return pd.DataFrame(rows, columns=[f"f{i}" for i in range(len(names))], dtype=object)

    scanned = pages.withColumn("_elements", scan(html))
    return scanned.withColumns({n: inner_text(F.col(f"_elements.f{i}")) for i, n in enumerate(names)}).drop("_elements")


def split_bad(fields: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that have every required field, and the rows that lack one."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required])
    return fields.filter(whole), fields.filter(~whole)


# Markers around the two narratives of a hazardous-materials report.
NARRATIVE_1 = ("Describe:", "PART VII - RECOMMENDATIONS/ACTIONS TAKEN TO PREVENT RECURRENCE")
NARRATIVE_2 = (
    "individual company. Continue on additional sheets if necessary.",
    "PART VIII – CONTACT INFORMATION",
)


def section(text: str, start: str, end: str, prefix: str = "") -> Column:
    """The trimmed text between two markers, their last pair; empty if there is none."""
    pattern = r"(?s)\Q" + start + r"\E(.*?)\Q" + end + r"\E"
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    body = F.coalesce(F.element_at(F.when(F.size(found) > 0, found), -1), F.lit(""))
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    if prefix:
        body = F.regexp_replace(F.regexp_replace(body, r"^\Q" + prefix + r"\E", ""), r"^\s+|\s+$", "")
    return body


def narratives(df: DataFrame, text: str) -> DataFrame:
    return df.withColumns(
        {
            "narrative1": section(text, *NARRATIVE_1),
            "narrative2": section(text, *NARRATIVE_2, prefix="Describe:"),
        }
    )


def anchors(df: DataFrame, column: str) -> DataFrame:
    """Rows with an anchor, with its text and its target."""
    rows = df.filter(F.col(column).contains("<A HREF"))
    return rows.withColumns(
        {
            "report_no": F.regexp_extract(column, r'(?s)target="_blank">(.*)</A>', 1),
            "doc_link": F.regexp_extract(column, r"(?s)HREF = (.*) target", 1),
        }
    )
