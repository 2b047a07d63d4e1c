"""Toxicity by a factorization machine over hashed terms.

The terms of a text are the distinct hashes of its lower-cased words and of their first letters (4 to
7 bytes), so inflected forms share terms. The score of a set of terms is a bias, a weight per term and, for
every pair of terms, the product of their factors: what two terms mean only together (an insult and the
mention of a group) is learned where additive weights miss it. At most ``SAMPLE`` labelled documents,
those of the least id hash, are turned into term sets on the executors and collected; on the driver
the terms most associated with the label either way, by themselves or among texts that hold a toxic one, are kept and weights and factors are trained by
stochastic gradient descent with per-term step sizes. A fifth of the sample stays out of training and
calibrates the output to a probability.

Null and empty texts have no terms and get the score of the bias. Without labelled texts every score
is 0, without labels of both kinds the share of the label. Labels join by id; null ids and null labels
teach nothing. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import attach, bounded_slices, hashed_share, utf8
from tidewatch.llm.words import SpanHash, word_spans

BUCKETS = 1 << 20
SAMPLE = 8000
TERMS = 4096
LEAST_TEXTS = 4
LEAST_DISTANCE = 4.0
#: The same among texts that hold a term of label 1: four texts of four reach it where 3 in 10 are toxic.
LEAST_PAIRED = 3.0
FACTORS = 6
EPOCHS = 20
#: Bound of raw scores: texts of very many toxic terms say no more than that.
MOST = 20.0
PREFIXES = (4, 5, 6, 7)
LETTERS = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


def terms(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, term), by text; only those that ``known`` marks."""
    raw, borders = utf8(pa.array([(t or "").lower() for t in texts.to_pylist()], pa.large_string()))
    starts, ends, owner = word_spans(raw, borders, LETTERS)
    hashed = SpanHash(raw)
    found = []
    for size in (None, *PREFIXES):
        stops = ends if size is None else np.minimum(ends, starts + size)
        term = ((hashed(starts, stops) + np.uint64(size or 0)) & np.uint64(BUCKETS - 1)).astype(np.int64)
        keys = owner * BUCKETS + term
        found.append(keys if known is None else keys[known[term]])
    keys = np.unique(np.concatenate(found))
    return keys // BUCKETS, keys % BUCKETS


@dataclass
class ToxicityModel:
    place: np.ndarray  # of each bucket among the kept terms, -1 where none
    weight: np.ndarray
    factors: np.ndarray
    bias: float
    slope: float
    shift: float

    def raw_scores(self, owner: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Bias, weights and pairwise products per text, given kept terms."""
        out = self.bias + np.bincount(owner, self.weight[at], minlength=n)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            out += 0.5 * (np.bincount(owner, v, minlength=n) ** 2 - np.bincount(owner, v * v, minlength=n))
        return np.clip(out, -MOST, MOST)

    def scores(self, texts: pa.Array) -> np.ndarray:
        owner, term = terms(texts, self.place >= 0)
        return sigmoid(self.slope * self.raw_scores(owner, self.place[term], len(texts)) + self.shift)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def labelled_terms(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> list[tuple[int, np.ndarray]]:
    """(label, terms) of at most ``sample`` labelled texts; their ids and labels are broadcast, the texts stay where they are.

    An id that is labelled more than once has its highest label, one with several texts that of the least hash.
    """
    labelled = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = (
        hashed_share(labelled, id_col, 2 * sample)
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .withColumn("h", F.xxhash64(F.col("id").cast("string")))
        .orderBy("h", "id")
        .limit(sample)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "h", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("h", "label", "text")

    def run(batches):
        for part in bounded_slices(batches):
            owner, term = terms(part.column(2))
            cuts = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.ListArray.from_arrays(cuts, pa.array(term.astype(np.int32)))], names=["h", "label", "terms"]
            )

    table = rows.mapInArrow(run, "h bigint, label int, terms array<int>").toArrow()
    sets = [(table["label"][i].as_py(), table["terms"][i].values.to_numpy()) for i in np.argsort(table["h"].to_numpy(), kind="stable").tolist()]
    return sets


def distances(sets: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Standard deviations between each term's share of label 1 and the overall share; 0 for terms of too few texts."""
    seen, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for label, term in sets:
        seen[term] += 1
        toxic[term] += label
    share = np.mean([label for label, _ in sets])
    if share in (0.0, 1.0):
        return np.zeros(BUCKETS)
    distance = (toxic - seen * share) / np.sqrt(np.maximum(seen, 1) * share * (1 - share))
    distance[seen < LEAST_TEXTS] = 0
    return distance


def kept_terms(sets: list[tuple[int, np.ndarray]], limit: int) -> np.ndarray:
    """Terms of enough texts whose share of label 1 is far from the overall share, the farthest first.

    Terms that matter only together with such a term come next: those far from the share of the texts that hold a term of label 1.
    """
    alone = distances(sets)
    strong = alone > LEAST_DISTANCE
    together = [s for s in sets if strong[s[1]].any()]
    paired = distances(together) if together else np.zeros(BUCKETS)
    far, met = np.abs(alone), np.abs(paired)
    first = np.argsort(-far, kind="stable")[:limit]
    first = first[far[first] > LEAST_DISTANCE]
    met[first] = 0
    then = np.argsort(-met, kind="stable")[: limit - len(first)]
    return np.concatenate([first, then[met[then] > LEAST_PAIRED]])


def train(sets: list[tuple[int, np.ndarray]], limit: int = TERMS, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 11) -> ToxicityModel:
    """Weights and factors by gradient descent, then the calibration on the texts kept out."""
    place = np.full(BUCKETS, -1)
    share = float(np.mean([label for label, _ in sets])) if sets else 0.0
    if share in (0.0, 1.0):
        return ToxicityModel(place, np.zeros(1), np.zeros((1, 1)), MOST * (2 * share - 1), 2.0, 0.0)
    many = len(sets) >= 100
    used, kept_out = ([s for i, s in enumerate(sets) if (i % 5 > 0) == part or not many] for part in (True, False))
    chosen = kept_terms(used, limit)
    place[chosen] = np.arange(len(chosen))
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), factors)), float(np.log(share / (1 - share)))
    gw, gv = np.full(len(chosen), 1e-6), np.full((len(chosen), factors), 1e-2)
    rows = [(label, at[at >= 0]) for label, at in ((label, place[term]) for label, term in used)]
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            label, at = rows[i]
            vs = v[at]
            total = vs.sum(axis=0)
            z = bias + w[at].sum() + 0.5 * (total @ total - (vs * vs).sum())
            g = (sigmoid(z) - label) * (1.0 if not label else min(5.0, (1 - share) / share))
            bias -= 0.01 * g
            if not len(at):
                continue
            dw, dv = g + 1e-4 * w[at], g * (total - vs) + 1e-3 * vs
            gw[at] += dw * dw
            gv[at] += dv * dv
            w[at] -= 0.3 * dw / np.sqrt(gw[at])
            v[at] -= 0.02 * dv / np.sqrt(gv[at])
    model = ToxicityModel(place, w, v, bias, 1.0, 0.0)
    model.slope, model.shift = calibrated(model, kept_out)
    return model


def calibrated(model: ToxicityModel, sets: list[tuple[int, np.ndarray]]) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the raw scores of texts kept out of training.

    The slope is the likeliest one for slightly softened labels, by Newton steps that are halved until they
    help; the curve is moved so that it passes one half in the middle of the gap with the best F1.
    """
    at = [model.place[term] for _, term in sets]
    at = [a[a >= 0] for a in at]
    owner = np.repeat(np.arange(len(at)), [len(a) for a in at])
    z = model.raw_scores(owner, np.concatenate([*at, np.zeros(0, int)]).astype(int), len(at))
    label = np.array([label for label, _ in sets], float)
    ones, zeros = label.sum(), len(label) - label.sum()
    if not ones or not zeros:
        return 1.0, 0.0
    y = np.where(label > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([z, np.ones(len(z))], axis=1)

    def loss(beta):
        margin = x @ beta
        return float((np.logaddexp(0, margin) - y * margin).sum() + 5e-4 * beta @ beta)

    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ beta)
        hessian = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - y) + 1e-3 * beta)
        while loss(beta - step) > loss(beta) and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta - step
        if np.abs(step).max() < 1e-6:
            break
    slope = max(float(beta[0]), 0.05)
    order = np.argsort(-z, kind="stable")
    found = np.cumsum(label[order])
    f1 = 2 * found / (np.arange(1, len(z) + 1) + ones)
    f1[:-1][z[order][1:] == z[order][:-1]] = 0
    best = int(np.argmax(f1))
    below = z[order][best + 1] if best + 1 < len(z) else z[order][best] - 1
    return slope, -slope * float(z[order][best] + below) / 2


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE
) -> ToxicityModel:
    """A model learned from the labels given; the caller leaves out what is held out."""
    return train(labelled_terms(docs, labels, id_col, text_col, label_col, sample))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with score and predicted (score of one half or more) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of terms

    def make():
        model = shared.value

        def compute(texts):
            s = model.scores(texts)
            return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))]

        return compute

    return attach(docs, text_col, make, "score double, predicted int", keep=keep)
