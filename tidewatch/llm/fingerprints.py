"""Bottom-k document fingerprints: the k least hashes of a text's distinct five-word shingles.

A fingerprint is text: the hashes in ascending order, eight bytes each, in base64; fewer than k when
the text has fewer shingles, and then it is the whole set. A text of one to four words has its whole
sequence as one shingle, a text without words (null or empty) none and the empty fingerprint. Two
fingerprints estimate resemblance and containment, one alone the number of distinct shingles, and
fingerprints of parts merge into that of their union, which is how parts of one document or whole
sources are summed up.

``edited_likeness`` needs each document's successor by id. Documents are dealt into slices of (id, text hash)
of about ``SLICE_BYTES`` of text each and sorted there; the first of each slice is also sent to the slice before, so
every document meets its successor in one task, and texts move once. Ids must be numbers; null ids come first and
equal ids follow each other by the text's hash, so neither gathers in one slice unless the texts are equal too:
rows alike in both stay together and pass through one task as a stream. Decimal ids are cut as doubles only.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import BATCH_BYTES, attach, hashed_share, stored, utf8
from tidewatch.llm.words import BASE, mixed, word_hashes

K = 256
WIDTH = 5
SLICE_BYTES = 64_000_000
KEYS_PER_SLICE = 32
PLACES = [mixed(np.array([i + 1], np.uint64) * BASE)[0] | np.uint64(1) for i in range(WIDTH)]


def sketches(texts: pa.Array, k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    """The k least distinct shingle hashes of each text, ascending."""
    raw, borders = utf8(texts)
    words, owner = word_hashes(raw, borders)
    n = len(texts)
    counts = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)])
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    owners = np.concatenate([owner, np.full(width, -1)])
    shingles = np.zeros(len(words), np.uint64)
    for i in range(width):
        shingles += np.where(owners[i : i + len(words)] == owner, padded[i : i + len(words)] * PLACES[i % len(PLACES)], np.uint64(0))
    shingles = mixed(shingles)
    out = []
    for i in range(n):
        part = shingles[first[i] : first[i] + max(counts[i] - width + 1, min(counts[i], 1))]
        out.append(np.unique(part)[:k])
    return out


def encoded(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode("ascii")


def decoded(fingerprint: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint or ""), ">u8").astype(np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of common shingles among the k least of the union; exact for texts of few shingles; two empty ones are equal."""
    union = np.union1d(a, b)[:k]
    return float(np.isin(union, np.intersect1d(a, b)).mean()) if len(union) else 1.0


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles, exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    if not len(a):
        return 1.0
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return min(1.0, j * (na + nb) / (1 + j) / na)


def fingerprint(docs: DataFrame, text_col: str = "text", k: int = K, width: int = WIDTH, keep: list[str] | None = None) -> DataFrame:
    """The kept columns with ``fingerprint`` of every whole text."""

    def make():
        return lambda texts: [pa.array([encoded(s) for s in sketches(texts, k, width)], pa.string())]

    return attach(docs, text_col, make, "fingerprint string", keep=keep)


def compared(pairs: DataFrame, a: str, b: str, k: int = K) -> DataFrame:
    """Pairs of fingerprint columns with resemblance, containment of a in b, and both shingle counts."""
    sent = pairs.withColumn("_pair", F.concat_ws(",", F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))

    def make():
        def compute(both):
            ab = [[decoded(x) for x in t.split(",")] for t in both.to_pylist()]
            rows = [(resemblance(x, y, k), containment(x, y, k), distinct_shingles(x, k), distinct_shingles(y, k)) for x, y in ab]
            return [pa.array(c, pa.float64()) for c in (zip(*rows, strict=True) if rows else [()] * 4)]

        return compute

    fields = "resemblance double, containment double, shingles_a double, shingles_b double"
    return attach(sent, "_pair", make, fields, keep=pairs.columns)


def merged(prints: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """One fingerprint per key, that of all its parts together.

    The parts' hashes are distinct per key before they meet, and only those that a slice of the key keeps
    among its k least go on, so what a key gathers is k times the number of slices, not its parts.
    """
    raw = F.unbase64(F.col("fingerprint"))
    each = F.expr("transform(sequence(1, length(_raw), 8), i -> substring(_raw, i, 8))")
    cells = (
        prints.select(*by, raw.alias("_raw"))
        .where(F.length("_raw") > 0)
        .select(*by, F.explode(each).alias("_cell"))
        .distinct()
        .withColumn("_slice", F.pmod(F.hash("_cell"), F.lit(256)))
    )
    for keys in ([*by, "_slice"], by):
        order = Window.partitionBy(*keys).orderBy("_cell")
        cells = cells.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
    gathered = cells.groupBy(*by).agg(F.sort_array(F.collect_list("_cell")).alias("_cells"))
    joined = F.expr("aggregate(_cells, cast('' as binary), (a, c) -> concat(a, c))")
    full = gathered.select(*by, F.base64(joined).alias("fingerprint"))
    return prints.select(*by).distinct().join(full, by, "left").withColumn("fingerprint", F.coalesce(F.regexp_replace("fingerprint", r"\s", ""), F.lit("")))


def ordered_bytes(ids: np.ndarray, missing: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Keys (id, h) as bytes of the same order: missing ids first, then whole numbers or doubles, then the hash."""
    if ids.dtype.kind == "f":
        bits = np.where(missing, 0.0, ids + 0.0).view(np.uint64)
        high = np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))
    else:
        high = ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    out = np.zeros((len(ids), 17), np.uint8)
    out[:, 0] = ~missing
    out[:, 1:9] = np.where(missing, np.uint64(0), high).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 9:] = (h.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def slice_column(kind: T.DataType, bounds: np.ndarray):
    """The number of bounds not above a row's (id, h), as a column function."""
    whole = isinstance(kind, T.IntegralType)

    @F.pandas_udf("int")
    def slice_of(ids: pd.Series, h: pd.Series) -> pd.Series:
        missing = ids.isna().to_numpy() if whole else np.zeros(len(ids), bool)
        values = ids.fillna(0).to_numpy("int64") if whole else ids.to_numpy("float64", na_value=0.0)
        return pd.Series(np.searchsorted(bounds, ordered_bytes(values, missing, h.to_numpy("int64")), side="right").astype("int32"))

    return slice_of


def sliced_by_id(docs: DataFrame, slices: int | None, slice_bytes: int = SLICE_BYTES) -> tuple[DataFrame, int]:
    """(id, text, slice, h, extra): rows dealt by id and text hash, a copy of each slice's first row for the slice before; and how many slices.

    Bounds come from about ``KEYS_PER_SLICE`` keys for each slice, weighed by the bytes of their texts. What reaches the driver
    grows with the number of slices, one for ``slice_bytes`` of text.
    """
    kind = docs.schema["id"].dataType
    hashed = docs.withColumn("h", F.xxhash64("text"))
    keys = stored(hashed.groupBy("id", "h").agg(F.sum(F.octet_length("text") + 32).alias("bytes")), "fingerprint-keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = slices or max(least, -(-total // slice_bytes))
    exact = isinstance(kind, (T.IntegralType, T.DoubleType, T.FloatType))
    # A double stands for a decimal id; then equal doubles are not cut by the hash. Missing ids get the least key there is.
    number = F.col("id") if isinstance(kind, T.IntegralType) else F.coalesce(F.col("id").cast("double"), F.lit(float("-inf")))
    place = F.col("h") if exact else F.lit(0).cast("long")
    sample = hashed_share(keys.withColumn("k", F.xxhash64("id", "h")), "k", KEYS_PER_SLICE * slices)
    picked = sample.select(F.col("id").isNull().alias("missing"), number.alias("id"), place.alias("h"), "bytes").toPandas()
    whole = isinstance(kind, T.IntegralType)
    missing = picked["missing"].to_numpy(bool) & whole
    values = picked["id"].fillna(0).to_numpy("int64" if whole else "float64")
    coded = ordered_bytes(values, missing, picked["h"].to_numpy("int64"))
    order = np.argsort(coded, kind="stable")
    weights = np.cumsum(picked["bytes"].to_numpy("float64")[order])
    cuts = np.searchsorted(weights, weights[-1] * np.arange(1, slices) / slices) if len(weights) else []
    bounds = np.unique(coded[order][cuts])
    slice_of = slice_column(kind, bounds)
    dealt = hashed.withColumn("slice", slice_of(number, place))
    firsts = keys.withColumn("slice", slice_of(number, place)).groupBy("slice").agg(F.min(F.struct("id", "h")).alias("f")).orderBy("slice").collect()
    copies = docs.sparkSession.createDataFrame(
        [(f["f"]["id"], f["f"]["h"], firsts[i - 1]["slice"]) for i, f in enumerate(firsts)],
        T.StructType([T.StructField("id2", kind), T.StructField("h2", T.LongType()), T.StructField("to", T.IntegerType())]),
    )
    # One row per slice is broadcast; rows alike in id and text count once.
    found = hashed.join(F.broadcast(copies), F.expr("id <=> id2 and h = h2")).dropDuplicates(["to"])
    extra = found.select("id", "text", F.col("to").alias("slice"), "h", F.lit(True).alias("extra"))
    return dealt.withColumn("extra", F.lit(False)).select("id", "text", "slice", "h", "extra").unionByName(extra), slices


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH, slices: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edit by the next document, and how alike they are.

    The edit replaces the last quarter of the code points by as many first ones of the next document (the
    first follows the last). Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A table of one row has itself as the next.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt, slices = sliced_by_id(rows, slices)
    dealt = dealt.repartitionById(slices, F.col("slice")).sortWithinPartitions("slice", "extra", "id", "h")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        held: list[tuple] = []  # (id, text, slice, extra, fingerprint) not yet met by its successor
        for batch in batches:
            ids, texts, where, extra = (batch.column(i) for i in range(4))
            start = 0
            sizes = np.cumsum(np.diff(utf8(texts)[1]))
            while start < batch.num_rows:
                base = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, base + BATCH_BYTES)))
                part = texts.slice(start, stop - start)
                new = list(
                    zip(
                        ids.slice(start, stop - start).to_pylist(),
                        part.to_pylist(),
                        where.slice(start, stop - start).to_pylist(),
                        extra.slice(start, stop - start).to_pylist(),
                        sketches(part, k, width),
                        strict=True,
                    )
                )
                line = held + new
                out = [(a, b) for a, b in zip(line, line[1:], strict=False) if not a[3] and a[2] == b[2]]
                edits = [a[1][: len(a[1]) - len(a[1]) // 4] + b[1][: len(a[1]) // 4] for a, b in out]
                edited = sketches(pa.array(edits, pa.large_string()), k, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[0] for a, _ in out], ids.type),
                        pa.array([len(a[1]) for a, _ in out], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
                        pa.array([encoded(a[4]) for a, _ in out], pa.string()),
                        pa.array([encoded(e) for e in edited], pa.string()),
                        pa.array([resemblance(a[4], e, k) for (a, _), e in zip(out, edited, strict=True)], pa.float64()),
                        pa.array([resemblance(a[4], b[4], k) for a, b in out], pa.float64()),
                    ],
                    names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
                held, start = line[-1:], stop

    return dealt.select("id", "text", "slice", "extra").mapInArrow(run, schema).withColumnRenamed("id", id_col)
