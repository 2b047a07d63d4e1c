import pytest
from pyspark.sql import types as T

FIELDS = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
#: Columns whose names the operators also use, in part with another case.
CLASHING = ["id", "th", "h", "fp", "score", "Fingerprint", "row", "spans", "length", "slice", "ids", "n_tokens", "kept", "marks"]


@pytest.fixture(scope="session")
def table(spark):
    """A documents table of the given (id, text) or (id, text, lang, source), on demand with clashing extra columns."""

    def make(rows, clashing=False):
        rows = [(*r, *((None, "h1")[len(r) - 2 :] if len(r) < 4 else ())) for r in rows]
        extra = [T.StructField(c, T.StringType()) for c in CLASHING] if clashing else []
        return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], T.StructType(FIELDS + extra))

    return make


#: Nulls, empty and blank texts, ties, repeated rows, a missing id, a very long text.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two three four five six seven eight"),
    (4, "one two three four five six seven eight"),
    (4, "another text under the same id"),
    (None, "a text that has no id at all"),
    (6, "long " * 60_000),
    (7, "x" * 150_000),
    (8, "ünïcödé 日本 😀 <|endoftext|> ▁"),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
