"""Personal data and secrets: strict patterns, and boosted trees over high-recall candidates.

Everything that touches texts is DataFrame functions on the rows themselves: no shuffle, no Python.
Strict patterns find e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers; these
spans always stay. Beside them generators propose candidates far more freely, each on its own and so
overlapping: numbers with separators, dotted numbers, long mixed tokens, assignments to names such as
``password``, written-out addresses. A candidate is described by its format (length, digits, letters,
separators, checksums) and its context (words and signs before it, the characters around it).

Candidates that strict rules settle either way are the labels: those of all texts, counted by what describes
them. Trees are boosted on four fifths of them, by id and place, and the
rest sets for each generator the margin from which candidates are right in ``PRECISION`` of cases. The
trees then run as SQL expressions over every candidate of every text. Accepted candidates add spans where
they overlap no strict one and no longer accepted one.

Null and empty texts have no spans. Patterns are written so that a long run of one kind of character
is read once, not from each of its positions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.boosting import Boosted, boost, boost_table, threshold
from tidewatch.llm.common import stored
from tidewatch.session import BROADCAST_ROWS, is_bounded

KINDS = ["email", "ip", "card", "phone", "number", "address", "token", "secret", "contact"]
PRECISION = 0.99
#: Margins that thresholds are looked for among are rounded to this, where Spark counts them.
MARGIN_STEP = 1 / 1024
CONTEXT = 24
#: Pieces of a text placed in one go.
BLOCK = 64

#: Strict patterns. A run starts where no earlier position could start it, or right after a match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
CARD_LIKE = r"[0-9](?:[ -]?[0-9]){11}"
LOOSE_SEPARATOR = r"(?<![0-9])[ -]|[ -](?![0-9])"
CARD = r"[0-9][0-9 -]*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

#: Candidate generators: (kind, what a text must hold, pattern).
GENERATORS = [
    ("number", r"[0-9][0-9 ().+-]{6}", r"(?<![0-9A-Za-z])[+(]?[0-9][0-9 ().+-]*+"),
    ("address", r"[0-9]\.[0-9]", r"(?<![0-9.])[0-9][0-9.]*+"),
    ("token", r"[A-Za-z0-9_/+=-]{16}", r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])[A-Za-z0-9_/+=-]{16,}+"),
    (
        "secret",
        r"(?i)pass|pwd|token|secret|key",
        r"(?i)(?<![a-z])(?:password|passwd|pwd|pass|token|secret|api[_-]?key|access[_-]?key|key)[\"']?[ ]{0,2}[=:][ ]{0,2}[\"']?[^\s\"',;]{4,}+[\"']?",
    ),
    ("contact", r"@|[(\[](?i:at)[)\]]", r"(?<![^\s@<>\"',;])[^\s@<>\"',;]++ ?(?:@|[(\[](?i:at)[)\]]) ?[^\s@<>\"',;]++"),
]
FEATURES = [
    "kind", "length", "digits", "letters", "capitals", "dots", "separators", "groups", "plus", "bracket", "at",
    "luhn", "octets", "named", "assigned", "glued", "mixed",
]


def spans(text: Column, holds: Column, pattern: str) -> Column:
    """Array of (s, e, hit): matches of the pattern from left to right with their code-point offsets.

    ``holds`` spares texts that cannot match. Offsets are sums over the pieces between matches.
    """
    pieces = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), hit.alias("hit")),
    )
    nothing = F.expr("cast(array() as array<struct<s:int,e:int,hit:string>>)")
    return F.when(holds, named(pieces, lambda p: F.when(F.size(p) <= BLOCK, placed(p)["out"]).otherwise(placed_by_blocks(p)))).otherwise(nothing)


def named(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def placed(pieces: Column) -> Column:
    """(at, out) of the pieces: their whole length, and their matches with offsets from the first of them."""

    def add(acc, piece):
        start = acc["at"] + piece["gap"]
        end = start + F.char_length(piece["hit"])
        span = F.struct(start.alias("s"), end.alias("e"), piece["hit"].alias("hit"))
        return F.when(piece["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out")))

    nothing = F.expr("cast(array() as array<struct<s:int,e:int,hit:string>>)")
    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), nothing.alias("out")), add)


def placed_by_blocks(pieces: Column) -> Column:
    """The matches of many pieces: within blocks first, then moved by the length of the blocks before.

    Appending copies the array so far, so a text's matches would cost their square in one go.
    """
    numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int"))
    blocks = F.transform(numbers, lambda b: placed(F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK))))

    def moved(made):
        starts = F.aggregate(made, F.array(F.lit(0)), lambda acc, m: F.array_append(acc, F.element_at(acc, -1) + m["at"]))
        return F.flatten(
            F.zip_with(
                made,
                F.slice(starts, F.lit(1), F.size(made)),
                lambda m, start: F.transform(
                    m["out"], lambda x: F.struct((x["s"] + start).alias("s"), (x["e"] + start).alias("e"), x["hit"].alias("hit"))
                ),
            )
        )

    return named(blocks, moved)


def count_while(spans_: Column, holds) -> Column:
    """How many of the spans, from the first on, fulfil a condition that only some first ones do; found by halving."""
    steps = F.sequence(F.lit(1), F.floor(F.log2(F.size(spans_) + F.lit(0.5))).cast("int") + 1)

    def halve(acc, _):
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        lower = F.struct((middle + 1).alias("lo"), acc["hi"].alias("hi"))
        upper = F.struct(acc["lo"].alias("lo"), middle.alias("hi"))
        return F.when(acc["lo"] >= acc["hi"], acc).when(holds(F.get(spans_, middle)), lower).otherwise(upper)

    whole = F.struct(F.lit(0).alias("lo"), F.size(spans_).alias("hi"))
    return F.when(F.size(spans_) == 0, F.lit(0)).otherwise(F.aggregate(steps, whole, halve, lambda acc: acc["lo"]))


def by_kind(spans_: Column | str, kinds: range) -> Column:
    """One array of spans for each kind: each in order of place and without overlaps."""
    return F.array(*[F.filter(spans_, of_kind(k)) for k in kinds])


def any_meets(kinds: Column, c: Column, test=None) -> Column:
    """Whether a span of any kind's array overlaps ``c`` and passes the test.

    Of several of a kind only the first and the last can reach beyond ``c``, so a test that only spans not inside ``c`` can pass needs
    no others.
    """

    def meets(of_one):
        first = count_while(of_one, lambda x: x["e"] <= c["s"])
        last = count_while(of_one, lambda x: x["s"] < c["e"]) - 1
        if test is None:
            return last >= first
        return (last >= first) & (test(F.get(of_one, first)) | test(F.get(of_one, last)))

    return F.exists(kinds, meets)


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the checksum of a string of at most 19 digits holds."""
    places = F.split(F.reverse(digits), "")

    def value(d, i):
        d = d.cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.transform(places, lambda d, i: F.coalesce(value(d, i), F.lit(0))), F.lit(0), lambda a, v: a + v)
    return F.char_length(digits).between(1, 19) & (total % 10 == 0)


def strict_spans(rows: DataFrame) -> DataFrame:
    """Adds ``strict``: the base spans of ``text`` as (s, k, e), in order."""
    text = F.col("text")
    card_text = F.when(text.rlike(CARD_LIKE), F.regexp_replace(text, LOOSE_SEPARATOR, "\u0001")).otherwise(F.lit(""))
    found = (
        rows.withColumn("_email", spans(text, F.contains(text, F.lit("@")), EMAIL))
        .withColumn("_ip", F.filter(spans(text, text.rlike(r"[0-9]\.[0-9]"), IP), lambda x: x["hit"].rlike(OCTETS)))
        .withColumn("_card_text", card_text)
        .withColumn(
            "_card",
            F.filter(
                spans(F.col("_card_text"), F.col("_card_text") != "", CARD),
                lambda x: F.char_length(digits_of(x["hit"])).between(12, 19) & luhn(digits_of(x["hit"])),
            ),
        )
        .withColumn(
            "_phone",
            F.filter(spans(text, F.contains(text, F.lit("+")), PHONE), lambda x: F.char_length(digits_of(x["hit"])).between(9, 15)),
        )
    )
    kinds = [F.transform(f"_{kind}", as_span(k)) for k, kind in enumerate(KINDS[:4])]
    return found.withColumn("strict", F.sort_array(F.concat(*kinds))).drop("_email", "_ip", "_card_text", "_card", "_phone")


def as_span(k: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))


def of_kind(k: int):
    return lambda x: x["k"] == k


def trimmed(k: int):
    """A generator's match as a candidate, without separators and punctuation at its end."""

    def candidate(x):
        hit = F.regexp_replace(x["hit"], r"[ ().+,;:!?-]+$", "")
        return F.struct(x["s"].alias("s"), F.lit(k).alias("k"), (x["s"] + F.char_length(hit)).alias("e"), hit.alias("hit"))

    return candidate


def candidates(rows: DataFrame) -> DataFrame:
    """Adds ``candidates``: every generator's spans with their features and, where a strict rule settles it, a label."""
    text = F.col("text")
    every = []
    for kind, holds, pattern in GENERATORS:
        every.append(F.transform(spans(text, text.rlike(holds), pattern), trimmed(KINDS.index(kind))))
    proposed = rows.withColumn(
        "_proposed",
        F.filter(
            F.concat(*every),
            lambda c: F.when(c["k"] == KINDS.index("number"), F.char_length(digits_of(c["hit"])) >= 7)
            .when(c["k"] == KINDS.index("address"), F.size(F.split(c["hit"], r"\.")) >= 2)
            .otherwise(F.char_length(c["hit"]) >= 5),
        ),
    )
    described_all = named(by_kind("strict", range(4)), lambda kinds: F.transform("_proposed", lambda c: described(c, kinds)))
    return proposed.withColumn("candidates", described_all).drop("_proposed")


def described(c: Column, strict_kinds: Column) -> Column:
    """A candidate's place, features and label."""
    hit, text = c["hit"], F.col("text")
    before = F.substring(text, F.greatest(c["s"] - CONTEXT + 1, F.lit(1)), F.least(c["s"], F.lit(CONTEXT)))
    after = F.substring(text, c["e"] + 1, F.lit(1))
    digits = digits_of(hit)
    number = F.char_length(digits)
    flag = lambda condition: condition.cast("int")
    features = {
        "kind": c["k"],
        "length": F.char_length(hit),
        "digits": number,
        "letters": F.char_length(F.regexp_replace(hit, "[^A-Za-z]", "")),
        "capitals": F.char_length(F.regexp_replace(hit, "[^A-Z]", "")),
        "dots": F.char_length(F.regexp_replace(hit, "[^.]", "")),
        "separators": F.char_length(F.regexp_replace(hit, "[^ -]", "")),
        "groups": F.size(F.split(hit, "[^0-9]+")),
        "plus": flag(hit.startswith("+")),
        "bracket": flag(hit.rlike(r"[(\[]")),
        "at": flag(hit.rlike(r"@|[(\[](?i:at)[)\]]")),
        "luhn": flag(luhn(digits)),
        "octets": flag(hit.rlike(OCTETS)),
        "named": flag(F.concat(before, hit).rlike(r"(?i)pass|token|secret|key|phone|tel|call|mail|card|iban|account")),
        "assigned": flag(F.concat(before, hit).rlike(r"[=:]")),
        "glued": flag(F.substring(before, -1, 1).rlike(r"[\p{L}\p{N}]") | after.rlike(r"[\p{L}\p{N}]")),
        "mixed": flag(hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")),
    }
    return F.struct(
        c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), *[features[f].cast("int").alias(f) for f in FEATURES], settled(c, hit, number, strict_kinds).alias("label")
    )


def settled(c: Column, hit: Column, number: Column, strict_kinds: Column) -> Column:
    """1 or 0 where strict rules decide about a candidate, null where the trees must."""

    def same(of_one):
        found = F.get(of_one, count_while(of_one, lambda x: x["s"] < c["s"]))
        return F.coalesce((found["s"] == c["s"]) & (found["e"] == c["e"]), F.lit(False))

    strict = F.exists(strict_kinds, same)
    kind = c["k"]
    return (
        F.when(strict, 1)
        .when(kind == KINDS.index("number"), F.when((number < 9) | (number > 19), 0))
        .when(kind == KINDS.index("address"), F.when(F.size(F.split(hit, r"\.")) != 4, 0))
        .when(kind == KINDS.index("token"), F.when(hit.rlike("^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{32,64})$"), 1).when(~hit.rlike("[A-Za-z]") | ~hit.rlike("[0-9].*[0-9]"), 0))
        .when(
            kind == KINDS.index("secret"),
            F.when(hit.rlike(r"[=:][ ]{0,2}[\"']?(?=\S*[0-9])(?=\S*[A-Za-z])[^\s\"']{12,}"), 1).when(~hit.rlike(r"[=:][ ]{0,2}[\"']?\S*[0-9]"), 0),
        )
        .when(kind == KINDS.index("contact"), F.when(~hit.rlike(r"[.]|(?i)dot"), 0))
    )


@dataclass
class SpanModel:
    trees: Boosted
    least: dict[int, float]  # the margin of each kind from which on its candidates are redacted

    def accepts(self, c: Column) -> Column:
        """The trees and thresholds as one expression over a candidate."""

        def tree(node):
            if node.left is None:
                return F.lit(node.value)
            return F.when(c[FEATURES[node.feature]] <= node.cut, tree(node.left)).otherwise(tree(node.right))

        margin = F.lit(self.trees.start)
        for t in self.trees.trees:
            margin = margin + tree(t)
        least = F.coalesce(*[F.when(c["k"] == k, F.lit(v)) for k, v in self.least.items()], F.lit(0.0))
        return margin >= least


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return candidates(strict_spans(rows))


def settled_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kept_out, features, label, times): how often each description of a settled candidate occurs in all texts."""
    return (
        prepared(docs, id_col, text_col)
        # explode would have Spark infer a filter that computes the candidates once more
        .select("id", F.explode_outer("candidates").alias("c"))
        .where("c.label is not null")
        .groupBy((F.pmod(F.xxhash64(F.col("id").cast("string"), "c.s", "c.k"), F.lit(5)) == 0).alias("kept_out"), *[F.col(f"c.{f}").alias(f) for f in FEATURES], F.col("c.label").alias("label"))
        .agg(F.count(F.lit(1)).alias("times"))
    )


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION, most: int = BROADCAST_ROWS) -> SpanModel:
    """Boosted trees and thresholds from the settled candidates of all rows; without any, nothing is added.

    Candidates differ in few ways, so their counts come to the driver; more than ``most`` different ones stay a table.
    """
    vectors = stored(settled_vectors(docs, id_col, text_col), "settled-candidates")
    n = vectors.agg(F.sum("times")).first()[0] or 0
    used = ~F.col("kept_out") if n >= 100 else F.lit(True)
    if vectors.where(used & (F.col("label") == 1)).isEmpty():
        return SpanModel(Boosted(-10.0, []), {})
    rest = F.col("kept_out") if n >= 100 else F.lit(True)
    if is_bounded(vectors, most):
        # in a fixed order, so that sums come out the same every time
        rows = vectors.select(*FEATURES, "label", "times", used.alias("used"), rest.alias("rest")).orderBy(*FEATURES, "label", "kept_out").collect()
        table = np.array([tuple(r) for r in rows], float)
        x, y, times, train, test = table[:, : len(FEATURES)], table[:, -4], table[:, -3], table[:, -2] > 0, table[:, -1] > 0
        model = boost(x[train], y[train], times=times[train])
        margin, right, counts, kinds, step = model.margin(x[test]), y[test], times[test], x[test, 0].astype(int), 0.0
    else:
        model = boost_table(vectors.where(used), FEATURES, "label", "times")
        place = F.round(F.expr(model.sql(FEATURES)) / MARGIN_STEP).alias("m")
        found = vectors.where(rest).groupBy("kind", place, "label").agg(F.sum("times").alias("times")).orderBy("kind", "m", "label").collect()
        table = np.array([tuple(r) for r in found], float).reshape(-1, 4)
        kinds, margin, right, counts, step = table[:, 0].astype(int), table[:, 1] * MARGIN_STEP, table[:, 2], table[:, 3], MARGIN_STEP

    def least(k: int) -> float:
        # a kind without rows to calibrate on has the threshold of all kinds together
        of_kind_k = kinds == k if (kinds == k).any() else np.ones(len(kinds), bool)
        return threshold(margin[of_kind_k], right[of_kind_k], precision, counts[of_kind_k], step)

    return SpanModel(model, {k: least(k) for k in range(4, len(KINDS))})


def detected(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, strict, spans): strict spans and all spans, in order of start and kind."""
    rows = prepared(docs, id_col, text_col)
    chosen = rows.withColumn("_accepted", F.filter("candidates", model.accepts)).drop("candidates")
    beside = named(by_kind("strict", range(4)), lambda kinds: F.filter("_accepted", lambda c: ~any_meets(kinds, c)))
    free = chosen.withColumn("_free", beside).drop("_accepted")

    def longer(c):
        return lambda o: (o["e"] - o["s"] > c["e"] - c["s"]) | ((o["e"] - o["s"] == c["e"] - c["s"]) & (o["k"] > c["k"]))

    def standing(kinds):
        left = F.filter("_free", lambda c: ~any_meets(kinds, c, longer(c)))
        return F.transform(left, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))

    added = named(by_kind("_free", range(4, len(KINDS))), standing)
    return free.withColumn("spans", F.sort_array(F.concat("strict", added))).drop("_free")


def written(spans_column: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    each = F.transform(spans_column, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string")))
    return F.array_join(each, ",")


def redacted_text() -> Column:
    """``text`` with each span replaced by its kind in brackets; a span that begins inside another is part of it."""
    text, kinds = F.col("text"), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def add(acc, x):
        gap = F.substring(text, acc["at"] + 1, x["s"] - acc["at"])
        return (
            F.when(x["e"] <= acc["at"], acc)
            .when(x["s"] < acc["at"], F.struct(x["e"].alias("at"), acc["out"].alias("out")))
            .otherwise(F.struct(x["e"].alias("at"), F.concat(acc["out"], gap, F.get(kinds, x["k"])).alias("out")))
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("spans", start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size("spans") > 0, done).otherwise(text)


def personal_data(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of strict spans, their hash, and all spans as text."""
    counts = [F.size(F.filter("strict", of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return detected(docs, model, id_col, text_col).select(
        F.col("id").alias(id_col), *counts, F.sha2(written("strict"), 256).alias("base_sha256"), written("spans").alias("spans")
    )


def redact(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span of the text replaced by its kind; null texts stay null."""
    columns = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = detected(held, model, "row", "text")
    row = F.col("id")
    return found.select(
        *[
            F.when(row.getField(c).isNull(), F.lit(None)).otherwise(redacted_text()).alias(c) if c == text_col else row.getField(c).alias(c)
            for c in columns
        ]
    )
