"""Small gradient-boosted trees: trained on counted rows, in numpy or by sums that Spark makes, applied as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import settle

TREES = 24
DEPTH = 3
RATE = 0.4
LEAST_ROWS = 8
BINS = 32


@dataclass
class Node:
    value: float
    feature: int = -1
    cut: float = 0.0  # at most goes left
    left: Node | None = None
    right: Node | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.left.predict(x), self.right.predict(x))

    def sql(self, names: list[str]) -> str:
        if self.left is None:
            return f"{float(self.value)!r}D"
        test = f"{names[self.feature]} <= {float(self.cut)!r}D"
        return f"(CASE WHEN {test} THEN {self.left.sql(names)} ELSE {self.right.sql(names)} END)"


def best_split(sums: list[np.ndarray], cuts: list[np.ndarray]) -> tuple[int, int] | None:
    """The feature and place of its cut with the greatest gain; ``sums`` has (rows, gradient, curvature) by bin for each feature."""
    best, chosen = 1e-6, None
    for f, at in enumerate(cuts):
        if not len(at):
            continue
        (rows, g, h), (n, gs, hs) = sums[f].sum(1), np.cumsum(sums[f], axis=1)[:, :-1]
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        gain[(n < LEAST_ROWS) | (rows - n < LEAST_ROWS)] = 0
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, chosen = gain[k], (f, k)
    return chosen


def grow(
    x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, curvature: np.ndarray, depth: int, rate: float, times: np.ndarray
) -> Node:
    """A tree of Newton steps; each split has the greatest gain over all features' cuts."""
    leaf = Node(-rate * gradient.sum() / (curvature.sum() + 1.0))
    if depth == 0 or times.sum() < 2 * LEAST_ROWS:
        return leaf
    places = [np.searchsorted(at, x[:, f]) for f, at in enumerate(cuts)]
    sums = [np.array([np.bincount(p, w, minlength=len(at) + 1) for w in (times, gradient, curvature)]) for p, at in zip(places, cuts)]
    chosen = best_split(sums, cuts)
    if chosen is None:
        return leaf
    f, cut = chosen[0], float(cuts[chosen[0]][chosen[1]])
    left = x[:, f] <= cut
    sides = [grow(x[s], cuts, gradient[s], curvature[s], depth - 1, rate, times[s]) for s in (left, ~left)]
    return Node(leaf.value, f, cut, *sides)


@dataclass
class Boosted:
    start: float
    trees: list[Node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def sql(self, names: list[str]) -> str:
        return " + ".join([f"{float(self.start)!r}D", *(t.sql(names) for t in self.trees)])


def log_odds(positive: float, rows: float) -> float:
    share = (positive + 0.5) / (rows + 1)
    return float(np.log(share / (1 - share)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, times: np.ndarray | None = None) -> Boosted:
    """Trees for the log odds of y, each on the gradient that the ones before leave; ``times`` says how often a row occurs."""
    times = np.ones(len(y)) if times is None else times
    model = Boosted(log_odds((y * times).sum(), times.sum()), [])
    cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, BINS), method="lower"))[:-1] for c in x.T] if len(x) else []
    margin = np.full(len(y), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(x, cuts, (p - y) * times, np.maximum(p * (1 - p), 1e-6) * times, depth, rate, times)
        model.trees.append(tree)
        margin = margin + tree.predict(x)
    return model


def boost_table(rows: DataFrame, names: list[str], label: str, times: str, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Boosted:
    """The trees of ``boost`` for a table of any length: only sums by leaf, feature and bin reach the driver."""
    cuts = table_cuts(rows, names)
    bins = F.array(*[
        F.struct(F.lit(f).alias("f"), sum(((F.col(names[f]) > float(c)).cast("int") for c in at), F.lit(0)).alias("bin"))
        for f, at in enumerate(cuts) if len(at)
    ])
    total = rows.agg(F.sum(times).alias("n"), F.sum(F.col(times) * F.col(label)).alias("y")).first()
    model = Boosted(log_odds(total["y"] or 0, total["n"] or 0), [])
    if not any(map(len, cuts)):
        return model
    rows = settle(rows.select(*names, F.col(label).alias("_y"), F.col(times).cast("double").alias("_n"), bins.alias("_bins")))
    for _ in range(trees):
        p = 1 / (1 + F.exp(-F.col("_m")))
        sloped = rows.withColumn("_m", F.expr(model.sql(names)))
        sloped = sloped.withColumns({"_g": (p - F.col("_y")) * F.col("_n"), "_h": F.greatest(p * (1 - p), F.lit(1e-6)) * F.col("_n")})
        root = Node(0.0)
        leaves = [root]
        for level in range(depth):
            place = F.expr(_numbered(root, leaves).sql(names)).cast("int")
            cells = sloped.select(place.alias("leaf"), F.inline("_bins"), "_n", "_g", "_h").groupBy("leaf", "f", "bin")
            sums = [[np.zeros((3, len(at) + 1)) for at in cuts] for _ in leaves]
            for r in cells.agg(F.sum("_n"), F.sum("_g"), F.sum("_h")).collect():
                sums[r[0]][r[1]][:, r[2]] = r[3:]
            grown = []
            for leaf, of_leaf in zip(leaves, sums):
                n, g, h = next(s for s in of_leaf if s.shape[1] > 1).sum(1)
                leaf.value = -rate * g / (h + 1.0)
                chosen = best_split(of_leaf, cuts) if n >= 2 * LEAST_ROWS else None
                if chosen is not None:
                    leaf.feature, k = chosen
                    leaf.cut = float(cuts[leaf.feature][k])
                    sides = of_leaf[leaf.feature][:, : k + 1].sum(1), of_leaf[leaf.feature][:, k + 1 :].sum(1)
                    leaf.left, leaf.right = (Node(-rate * s[1] / (s[2] + 1.0)) for s in sides)
                    grown += [leaf.left, leaf.right]
            leaves = grown
            if not leaves:
                break
        model.trees.append(root)
    return model


def _numbered(node: Node, leaves: list[Node]) -> Node:
    """The tree with each leaf's place in the list as its value, -1 for leaves that are not in it."""
    if node.left is None:
        return Node(next((i for i, leaf in enumerate(leaves) if leaf is node), -1))
    return Node(0, node.feature, node.cut, _numbered(node.left, leaves), _numbered(node.right, leaves))


def table_cuts(rows: DataFrame, names: list[str]) -> list[np.ndarray]:
    """Of each column's different values those at even ranks, without the greatest."""
    cells = rows.select(F.inline(F.array(*[F.struct(F.lit(f).alias("f"), F.col(c).cast("double").alias("x")) for f, c in enumerate(names)]))).distinct()
    w = Window.partitionBy("f")
    ranked = cells.select("f", "x", F.row_number().over(w.orderBy("x")).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    ranks = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.floor((F.col("n") - 1) * i / (BINS - 1) + 1e-9) + 1)
    found = ranked.where(F.array_contains(ranks, F.col("r").cast("long"))).select("f", "x").collect()
    return [np.array(sorted(r["x"] for r in found if r["f"] == f)[:-1]) for f in range(len(names))]


def threshold(margin: np.ndarray, y: np.ndarray, precision: float, times: np.ndarray | None = None, step: float = 0.0) -> float:
    """The margin from which on rows not used in training are label 1 with at least this share; infinite where none shows it.

    It lies midway to the next margin, below which the share is no longer reached; where all rows together reach it,
    at the least margin or at even odds, whichever is lower. Margins rounded to a ``step`` stand for all within half of it;
    ``times`` says how often a row occurs.
    """
    times = np.ones(len(y)) if times is None else times
    order = np.argsort(-margin, kind="stable")
    m, right, rows = margin[order], np.cumsum((y * times)[order]), np.cumsum(times[order])
    last = np.append(m[1:] < m[:-1], True) if len(m) else np.zeros(0, bool)
    good = np.flatnonzero(last & (right / rows >= precision)) if len(m) else np.zeros(0, int)
    if not len(good):
        return float("inf")
    at = good[-1]
    return float((m[at] + m[at + 1]) / 2 if at + 1 < len(m) else min(m[at] - step / 2, 0.0))
