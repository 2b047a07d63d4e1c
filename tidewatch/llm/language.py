"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's letters, lower-cased, are cut into subwords: runs of two to four UTF-8 bytes inside words,
with word borders. Each subword is hashed to one of ``BUCKETS`` embeddings; a text is the average of its
subwords' embeddings and a linear softmax over it gives the languages. Embeddings and softmax are trained
together by stochastic gradient descent in numpy on at most ``SAMPLE`` labelled documents, those
with the least hash of id and text; what is collected of each is its bounded bucket histogram, not its
text. A part of the sample is kept out of training: on it the softmax's temperature is set, and the
score below which a prediction is rejected, so that at most ``WRONGLY_REJECTED`` of the rightly labelled
texts fall below it, and never one above ``MOST_DOUBT``. The temperature only softens. As softmax and average are linear, scoring sums a table of one number per bucket
and language.

Predicted is the likeliest language, or ``und`` for null texts and texts without letters. ``accepted``
is false for ``und`` and for scores below the calibrated bound. Without any labelled text everything is
``und``. Language, source and id are never inputs of a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import attach, bounded_slices, hashed_share, utf8

UNKNOWN = "und"
BUCKETS = 1 << 16
SUBWORDS = (2, 3, 4)
DIMENSIONS = 16
SAMPLE = 4000
EPOCHS = 6
WRONGLY_REJECTED = 0.001
MOST_DOUBT = 0.6
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _letter_table() -> np.ndarray:
    """Each byte as part of a word; 0 for what is none."""
    table = np.zeros(256, np.uint64)
    for b in [*range(97, 123), *range(128, 256)]:
        table[b] = b
    return table


LETTERS = _letter_table()


def subword_buckets(raw: np.ndarray, borders: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all subwords, the text each belongs to) for lower-cased texts in one byte array.

    Every text is followed by a border byte, so no subword crosses from one text to the next.
    """
    n = len(borders) - 1
    letters = np.zeros(1 + len(raw) + n, np.uint64)
    letters[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(borders)) + 1] = LETTERS[raw]
    text = np.concatenate([[0], np.repeat(np.arange(n), np.diff(borders) + 1)])
    within, shift = letters > 0, np.uint64(64 - int(np.log2(buckets)))
    found, owner, value = [], [], letters
    inner = np.ones(len(letters), bool)  # borders may begin or end a subword, never stand inside
    for size in range(2, max(SUBWORDS) + 1):
        value = (value[:-1] << np.uint64(8)) | letters[size - 1 :]
        inner = inner[: len(value)] & within[size - 2 : -1] if size > 2 else inner[:-1]
        if size in SUBWORDS:
            chosen = np.flatnonzero(inner & (within[: len(value)] | within[size - 1 :]))
            found.append((((value[chosen] ^ np.uint64(size << 40)) * SPREAD) >> shift).astype(np.int64))
            owner.append(text[chosen + 1])
    return np.concatenate(found), np.concatenate(owner)


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array([(t or "").lower() for t in texts.to_pylist()], pa.large_string()))


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # a number per bucket and language
    bias: np.ndarray
    temperature: float
    least_score: float

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        raw, borders = lowered(texts)
        n, k = len(texts), len(self.languages)
        found, owner = subword_buckets(raw, borders, len(self.table))
        count = np.maximum(np.bincount(owner, minlength=n), 1)
        sums = np.stack([np.bincount(owner, self.table[found, c], minlength=n) for c in range(k)], axis=1)
        return softmax((sums / count[:, None] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def labelled_histograms(docs: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, buckets: int) -> list:
    """(label, buckets, counts) of at most ``sample`` labelled texts, those of the least hash."""
    labelled = hashed_share(docs.where(F.col(label_col).isNotNull()), id_col, 2 * sample)
    rows = (
        labelled.where(F.col(text_col).rlike(r"\p{L}"))
        .select(F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"), F.col(id_col).alias("id"), F.col(label_col).alias("label"))
        .orderBy("h", "label")
        .limit(sample)
        .select("h", "label")
        .distinct()
    )
    texts = labelled.select(F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"), F.col(text_col).alias("text"))
    # At most ``sample`` hashes are broadcast; repeated rows give one text, before anything is collected.
    chosen = texts.join(F.broadcast(rows), "h").groupBy("h", "label").agg(F.first("text").alias("text"))

    def run(batches):
        for part in bounded_slices(batches):
            raw, borders = lowered(part.column(2))
            found, owner = subword_buckets(raw, borders, buckets)
            keys, counts = np.unique(owner * buckets + found, return_counts=True)
            cuts = np.searchsorted(keys, np.arange(part.num_rows + 1) * buckets).astype(np.int32)
            cells = pa.ListArray.from_arrays(cuts, pa.array((keys % buckets).astype(np.int32)))
            many = pa.ListArray.from_arrays(cuts, pa.array(counts.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), cells, many], names=["h", "label", "cells", "counts"])

    table = chosen.mapInArrow(run, "h bigint, label string, cells array<int>, counts array<int>").toArrow()
    order = np.lexsort((table["label"].to_numpy(zero_copy_only=False).astype(str), table["h"].to_numpy()))
    return [(table["label"][i].as_py(), table["cells"][i].values.to_numpy(), table["counts"][i].values.to_numpy()) for i in order.tolist()]


def train(rows: list, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, seed: int = 7) -> LanguageModel | None:
    """Embeddings and softmax by gradient descent over the histograms, then temperature and rejection bound."""
    languages = sorted({label for label, *_ in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    kept_out = [r for i, r in enumerate(rows) if i % 5 == 0] if len(rows) >= 50 else rows
    used = [r for i, r in enumerate(rows) if i % 5] if len(rows) >= 50 else rows
    embeddings = rng.uniform(-1, 1, (buckets, dimensions)) / dimensions
    weights, bias = np.zeros((dimensions, len(languages))), np.zeros(len(languages))
    place = {label: i for i, label in enumerate(languages)}
    for epoch in range(epochs):
        rate = 2.0 * (1 - epoch / epochs)
        for i in rng.permutation(len(used)).tolist():
            label, cells, counts = used[i]
            if not len(cells):
                continue
            share = counts / counts.sum()
            mean = share @ embeddings[cells]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[place[label]] -= 1
            back = weights @ p
            weights -= rate * np.outer(mean, p)
            bias -= 0.05 * rate * p
            embeddings[cells] -= rate * share[:, None] * back
    table = embeddings @ weights
    z = np.array([(c / c.sum()) @ table[b] + bias if len(b) else bias for _, b, c in kept_out])
    truth = np.array([place[label] for label, *_ in kept_out])

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(z / t)[np.arange(len(z)), truth], 1e-12)).mean()

    temperature = min(np.geomspace(1, 20, 40).tolist(), key=loss)
    p = softmax(z / temperature)
    right = p.argmax(axis=1) == truth
    least = float(np.quantile(p.max(axis=1)[right], WRONGLY_REJECTED, method="lower")) if right.any() else 0.0
    least = min(least, MOST_DOUBT)
    return LanguageModel(languages, table.astype(np.float32), bias, temperature, least)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> LanguageModel | None:
    """A model learned from the rows given; the caller leaves out what is held out."""
    return train(labelled_histograms(docs, id_col, text_col, label_col, sample, BUCKETS))


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with lang_pred, score and accepted for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets

    def make():
        model = shared.value

        def compute(texts):
            has_letter = [any(map(str.isalpha, t or "")) for t in texts.to_pylist()]  # Unicode letters, as in ``fit``
            if model is None:
                n = len(texts)
                return [pa.array([UNKNOWN] * n), pa.array([0.0] * n, pa.float64()), pa.array([False] * n)]
            p = model.probabilities(texts)
            best = p.argmax(axis=1)
            score = np.where(has_letter, p[np.arange(len(p)), best], 0.0)
            names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, has_letter, strict=True)]
            return [pa.array(names, pa.string()), pa.array(score), pa.array((score >= model.least_score) & np.array(has_letter, bool))]

        return compute

    return attach(docs, text_col, make, "lang_pred string, score double, accepted boolean", keep=keep)
