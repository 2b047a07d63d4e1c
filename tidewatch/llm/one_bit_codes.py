"""Nearest vectors by inner product, from randomly rotated one-bit codes and their error bounds.

Each vector is taken relative to the centre of its cell, rotated at random and kept as the signs of its
coordinates, packed, with three numbers: the factor that turns the product of signs and a rotated query into an
estimate, the factor of its error bound, and the share of the product that does not depend on the query's
residual. For a query the estimate is off by more than ``BOUND`` standard errors about once in a thousand, on either
side. Vectors whose upper bound reaches the query's worst kept score so far are reranked by the exact product,
summed in double precision from the first component to the last; all others are left out.

Equal vectors are one node with its ``k`` + 1 least ids, which is all that a result can name, and equal queries
are one query, so copies make no pairs. Queries lie in blocks of ``QUERIES`` and candidates in ``GROUP`` sized
groups; a task streams one group past one block and keeps ``k`` + 1 nodes for each query. No block or group depends
on a key that may be hot. Cells are fitted on at most ``SAMPLE`` vectors, picked by hash; all vectors are indexed.

Vectors that are null, zero or hold a null or non-finite component, and rows without id, take no part.
Vectors are compared only with those of their length. Rows that repeat an id with the same vector count once;
a query's own id is never among its results. Ties go to the smaller id. Empty tables give empty results. Other
columns neither matter nor clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import flat_lists, hashed_share, stored

CELLS = 64
SAMPLE = 16_384
BOUND = 3.0
QUERIES = 8_192
GROUP = 1 << 20
#: Estimates, and pairs to rerank, held at once.
ESTIMATES = 4_000_000
PAIRS = 1 << 16


def finite_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec, dim): the vectors that take part, as the bytes of doubles."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            keep, out = [], []
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.asarray(lists.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False))
            ends = np.cumsum(lengths)
            for i, (n, end) in enumerate(zip(lengths.tolist(), ends.tolist())):
                v = values[end - n : end]
                if n and np.isfinite(v).all() and v.any():
                    keep.append(i)
                    out.append((v + 0.0).tobytes())  # adding zero turns -0.0 into 0.0
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(out, pa.binary()), pa.array([len(v) // 8 for v in out], pa.int32())], names=["id", "vec", "dim"])

    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL")
    return rows.mapInArrow(run, "id bigint, vec binary, dim int")


def distinct_vectors(vectors: DataFrame, most: int) -> DataFrame:
    """(node, dim, vec, ids): every different vector once, with its ``most`` least ids; the node is a hash of the vector."""
    node = F.unhex(F.md5("vec")).alias("node")
    # a window limited by rank keeps at most ``most`` rows of a vector per task before they meet
    least = Window.partitionBy("node").orderBy("id")
    few = vectors.select(node, "id").distinct().withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= most)
    ids = few.groupBy("node").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return vectors.select(node, "dim", "vec").dropDuplicates(["node"]).join(ids, "node")


def matrix(column, dim: int) -> np.ndarray:
    """A binary column of doubles as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), dim)


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def cells_of(sample: np.ndarray, cells: int = CELLS, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres by k-means from spread-out starts."""
    rng, starts = np.random.default_rng(seed), [0]
    nearest = ((sample - sample[0]) ** 2).sum(1)
    while len(starts) < min(cells, len(sample)) and nearest.sum() > 0:
        starts.append(int(rng.choice(len(sample), p=nearest / nearest.sum())))
        nearest = np.minimum(nearest, ((sample - sample[starts[-1]]) ** 2).sum(1))
    centres = sample[starts]
    for _ in range(rounds):
        own = closest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def closest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * vectors @ centres.T, axis=1)


def fitted_cells(nodes: DataFrame, sample: int = SAMPLE, cells: int = CELLS) -> dict[int, np.ndarray]:
    """The centres for each length of vectors, from at most ``sample`` different ones."""
    rows = hashed_share(nodes.select("node", "dim", "vec"), "node", sample).limit(sample).toArrow()
    found = {}
    for dim in sorted(set(rows.column("dim").to_pylist())):
        part = rows.filter(pa.compute.equal(rows.column("dim"), dim)).sort_by("node")
        found[dim] = cells_of(matrix(part.column("vec"), dim), cells)
    return found


def codes(vectors: np.ndarray, centres: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """(cell, packed signs, factor of the estimate, factor of the error, share apart from the query's residual)."""
    dim = vectors.shape[1]
    cell = closest(vectors, centres)
    centre = centres[cell]
    turned = (vectors - centre) @ turn.T
    size = np.sqrt((turned**2).sum(1))
    spread = np.abs(turned).sum(1)  # sqrt(dim) * size * cosine between the residual and its signs
    with np.errstate(divide="ignore", invalid="ignore"):
        factor = np.where(spread > 0, size**2 / spread, 0.0)
        cosine2 = np.where(size > 0, spread**2 / (dim * size**2), 1.0)
    error = size * np.sqrt(np.maximum(1 - cosine2, 0) / np.maximum(cosine2, 1e-12) / max(dim - 1, 1))
    apart = (vectors * centre).sum(1) - (centre**2).sum(1)
    return cell, np.packbits(turned > 0, axis=1), factor, error, apart


def index(nodes: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """(node, dim, vec, ids, cell, code, factor, error, apart) of every node; lengths without centres have one at zero."""

    def run(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                cell, bits, *numbers = codes(matrix(part.column(2), dim), centres.get(dim, np.zeros((1, dim))), rotation(dim))
                made = [pa.array(cell, pa.int32()), pa.array([b.tobytes() for b in bits], pa.binary()), *(pa.array(x, pa.float64()) for x in numbers)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "cell", "code", "factor", "error", "apart"])

    fields = "node binary, dim int, vec binary, ids array<bigint>, cell int, code binary, factor double, error double, apart double"
    return nodes.select("node", "dim", "vec", "ids").mapInArrow(run, fields)


class Block:
    """A block of queries that candidates stream past; keeps the best ``k`` nodes of each."""

    def __init__(self, node: list[bytes], vectors: np.ndarray, centres: np.ndarray, k: int, bound: float):
        self.node, self.vectors, self.centres, self.k, self.bound = node, vectors, centres, k, bound
        turn = rotation(vectors.shape[1])
        self.turned = (vectors @ turn.T).astype(np.float32)
        self.turned_centres = centres @ turn.T
        self.with_centre = (vectors @ centres.T).astype(np.float32)
        self.residual = np.sqrt(np.maximum((vectors**2).sum(1)[:, None] - 2 * vectors @ centres.T + (centres**2).sum(1), 0)).astype(np.float32)
        self.small, self.size = vectors.astype(np.float32), np.sqrt((vectors**2).sum(1))
        self.score = np.full((len(node), k), -np.inf)
        self.least = np.full((len(node), k), np.iinfo(np.int64).max)
        self.place = np.full((len(node), k), -1)  # of the node among all that have passed
        self.ids: dict[int, list[int]] = {}  # of nodes that are or were kept, by place
        self.gone = 0

    def exact(self, q: np.ndarray, vectors: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Products of pairs, summed from the first component to the last."""
        out = np.zeros(len(q))
        for d in range(vectors.shape[1]):
            out += self.vectors[q, d] * vectors[c, d]
        return out

    def keep(self, q: np.ndarray, scores: np.ndarray, least: np.ndarray, c: np.ndarray) -> None:
        """The best k of the kept nodes and the given ones, for the queries given."""
        rows = np.unique(q)
        owner = np.concatenate([np.repeat(rows, self.k), q])
        score = np.concatenate([self.score[rows].ravel(), scores])
        first = np.concatenate([self.least[rows].ravel(), least[c]])
        place = np.concatenate([self.place[rows].ravel(), self.gone + c])
        order = np.lexsort((first, -score, owner))
        owner = owner[order]
        best = order[np.arange(len(owner)) - np.searchsorted(owner, owner) < self.k]
        for kept, values in ((self.score, score), (self.least, first), (self.place, place)):
            kept[rows] = values[best].reshape(len(rows), self.k)

    def pass_by(self, batch: pa.RecordBatch) -> None:
        """Rerank those of a batch of candidates whose upper bounds reach the scores kept."""
        dim = self.vectors.shape[1]
        cell = batch.column("cell").to_numpy()
        least = pa.compute.list_element(batch.column("ids"), 0).to_numpy()
        vectors = matrix(batch.column("vec"), dim)
        small, size = vectors.astype(np.float32), np.sqrt((vectors**2).sum(1))
        packed = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(cell), -1)
        signs = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
        factor, error, apart = (batch.column(c).to_numpy() for c in ("factor", "error", "apart"))
        # the rotated residual of a query is its rotation less its centre's, so the centre's part is a number of the candidate
        apart = (apart - factor * (self.turned_centres[cell] * signs).sum(1)).astype(np.float32)
        factor, error = factor.astype(np.float32), (self.bound * error).astype(np.float32)
        step = max(1, ESTIMATES // len(cell))
        wanted = np.zeros(len(cell), bool)
        for low in range(0, len(self.node), step):
            part = slice(low, low + step)
            upper = self.turned[part] @ signs.T
            upper *= factor
            upper += apart
            upper += self.with_centre[part][:, cell]
            fresh = np.flatnonzero(self.place[part, -1] < 0)
            if len(fresh):  # queries that keep fewer than k so far begin with the best estimates
                k = min(self.k, len(cell))
                likely = np.argpartition(-upper[fresh], k - 1, axis=1)[:, :k]
                q, c = np.repeat(fresh, k), likely.ravel()
                self.keep(q + low, self.exact(q + low, vectors, c), least, c)
                wanted[c] = True
            upper += self.residual[part][:, cell] * error
            upper += 1e-5 * (1 + np.abs(upper))
            if len(fresh):
                upper[q, c] = -np.inf
            q, c = np.nonzero((upper >= self.score[part, -1:].astype(np.float32)) & (upper > -np.inf))
            for at in range(0, len(q), PAIRS):
                qs, cs = q[at : at + PAIRS], c[at : at + PAIRS]
                # in single precision first, as few of those within the bounds are near in the end
                score = np.einsum("ij,ij->i", self.small[qs + low], small[cs])
                near = score >= self.score[qs + low, -1] - 1e-5 * self.size[qs + low] * size[cs]
                if near.any():
                    qs, cs = qs[near], cs[near]
                    self.keep(qs + low, self.exact(qs + low, vectors, cs), least, cs)
                    wanted[cs] = True
        ids = batch.column("ids")
        self.ids |= {self.gone + i: ids[i].as_py() for i in np.flatnonzero(wanted).tolist()}
        self.gone += len(cell)
        if len(self.ids) > 4 * self.place.size:
            kept = set(self.place.ravel().tolist())
            self.ids = {i: v for i, v in self.ids.items() if i in kept}

    def result(self) -> pa.RecordBatch:
        """One row per query: the k best ids of its nodes and their scores."""
        q, at = np.nonzero(self.place >= 0)
        ids = [self.ids[i] for i in self.place[q, at].tolist()]
        n = np.array([len(v) for v in ids], np.int64)
        owner, score = np.repeat(q, n), np.repeat(self.score[q, at], n)
        flat = np.array([i for v in ids for i in v], np.int64)
        order = np.lexsort((flat, -score, owner))
        owner = owner[order]
        best = np.arange(len(owner)) - np.searchsorted(owner, owner) < self.k
        order, n = order[best], np.bincount(owner[best], minlength=len(self.node))
        columns = [pa.array(self.node, pa.binary()), flat_lists(n, pa.array(score[order])), flat_lists(n, pa.array(flat[order]))]
        return pa.RecordBatch.from_arrays(columns, names=["query", "scores", "ids"])


def passed(stream: DataFrame, centres: dict[int, np.ndarray], k: int, bound: float) -> DataFrame:
    """(query, scores, ids) from rows sorted so that each part has its queries first, then its candidates."""

    def run(batches):
        part, block, names, rows = None, None, [], []
        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "block", "part", "candidate"))))
            start = 0
            while start < len(marks):
                end = start
                while end < len(marks) and marks[end] == marks[start]:
                    end += 1
                *here, candidate = marks[start]
                if here != part:
                    if block is not None:
                        yield block.result()
                    part, block, names, rows = here, None, [], []
                piece = batch.slice(start, end - start)
                if not candidate:
                    names += piece.column("node").to_pylist()
                    rows.append(matrix(piece.column("vec"), here[0]))
                elif names:
                    if block is None:
                        block = Block(names, np.concatenate(rows), centres.get(here[0], np.zeros((1, here[0]))), k, bound)
                    block.pass_by(piece)
                start = end
        if block is not None:
            yield block.result()

    return stream.mapInArrow(run, "query binary, scores array<double>, ids array<bigint>")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    bound: float = BOUND, query_block: int = QUERIES, group: int = GROUP, sample: int = SAMPLE, cells: int = CELLS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest vectors of every query, its own id left out."""
    spark = vectors.sparkSession
    every = stored(finite_vectors(vectors, id_col, vector_col), "vectors")
    nodes = stored(distinct_vectors(every, k + 1), "vector-nodes")
    centres = fitted_cells(nodes, sample, cells)
    candidates = stored(index(nodes, centres), "vector-codes")
    asked = stored(finite_vectors(queries, id_col, vector_col).select("id", "dim", "vec", F.unhex(F.md5("vec")).alias("node")).distinct(), "queries")
    searches = asked.select("dim", "vec", "node").dropDuplicates(["node"])
    n_queries, n_candidates = searches.count(), candidates.count()
    blocks = -(-n_queries // query_block) or 1
    # at least one part for each core; a part streams, so it may be large
    parts = max(-(-n_candidates // group), min(spark.sparkContext.defaultParallelism, -(-n_candidates // 1024)), 1)
    dealt = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(n)).cast("int")
    left = searches.withColumns({"block": dealt(blocks, "block"), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    left = left.select("dim", "block", "part", F.lit(0).alias("candidate"), "node", "vec", *[F.lit(None).cast(candidates.schema[c].dataType).alias(c) for c in ("ids", "cell", "code", "factor", "error", "apart")])
    right = candidates.withColumns({"part": dealt(parts, "part"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "candidate": F.lit(1)})
    stream = left.unionByName(right).repartition(4 * blocks * parts, "dim", "block", "part").sortWithinPartitions("dim", "block", "part", "candidate", "cell")
    found = stored(passed(stream, centres, k + 1, bound), "nearest-nodes")
    # of all parts the best k + 1 ids of each different query
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    each = found.select("query", F.explode(F.arrays_zip("scores", "ids")).alias("x"))
    few = each.select("query", F.col("x.scores").alias("score"), F.col("x.ids").alias("vec_id")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    lists = few.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best"))
    own = asked.select(F.col("id").alias("query_id"), F.col("node").alias("query")).join(lists, "query")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (F.lit(0.0) - F.col("x.s")).alias("score"))
