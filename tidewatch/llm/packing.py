"""Packing of documents into sequences of a fixed number of tokens by linear grouping.

Token lengths are whole numbers up to the capacity, so the packing of any number of documents depends
only on how many pieces have each length: one count per length reaches the driver, at most ``capacity``
of them whatever the table's size. There the lengths above a quarter of it are cut into groups of equal
cardinality, each rounded up to its longest member; a linear program over these few sizes (columns
generated by a knapsack) says how often each configuration is used; actual lengths replace the rounded
ones, and whatever is left is placed by best fit, longest first, into the room that remains. Equal
sequences are kept as one entry with a count, so the plan's size does not depend on the data either.
Documents then meet their places by length and rank among the pieces of that length, which is counted
per slice of a hash, so no length gathers in one task.

Null and empty texts are documents of no tokens, that is of the closing id alone. Rows alike in every
respect are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import bounded_slices, id_and_text, stored

CAPACITY = 2048
#: Lengths above this share of the capacity are grouped.
LARGE = 1 / 4
GROUPS = 128
SLICES = 1024
#: Characters whose class may depend on a library's Unicode version, and the start of a special string.
NEEDS_WHOLE_TOKENIZER = re.compile("[^\x00-\u024f]|<\\|")


@cache
def id_encoder(json_path: str, ranks_path: str):
    """The ids of a text as little-endian bytes, four each.

    Both files hold one vocabulary; the rank file's merges are the faster way for Latin text without
    special strings, all else goes to the full tokenizer.
    """
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        if NEEDS_WHOLE_TOKENIZER.search(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(fast.encode_ordinary(text), "<u4").tobytes()

    return encode


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    json_path: str | None = None,
    ranks_path: str | None = None,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32): documents as token ids with a closing 0, cut where longer than the capacity.

    All pieces of a cut document but the first are full.
    """
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = id_and_text(docs, id_col, text_col)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"

    def run(batches):
        encode = id_encoder(json_path, ranks_path)
        for part in bounded_slices(batches):
            row, made = [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                ids = encode(text) + b"\0\0\0\0"
                n = len(ids) // 4
                start, end, piece = 0, n if n <= capacity else n % capacity or capacity, 0
                while start < n:
                    row.append(i)
                    made.append((piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                    start, end, piece = end, end + capacity, piece + 1
            columns = np.array(made, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row, pa.int64())), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(run, schema)


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The most valuable set of sizes, repeats allowed, that fits."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k, (size, value) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
        if value <= 1e-12:
            continue
        for low in range(size, capacity + 1, size):
            high = min(low + size, capacity + 1)
            with_it = best[low - size : high - size] + value
            better = with_it > best[low:high] + 1e-12
            best[low:high][better], last[low:high][better] = with_it[better], k
    pattern, room = np.zeros(len(sizes)), int(np.argmax(best))
    value = best[room]
    while room > 0 and last[room] >= 0:
        pattern[last[room]] += 1
        room -= int(sizes[last[room]])
    return pattern, value


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Columns of sizes and how often to use each, a basic solution of min sum x with columns @ x = demand."""
    basis = np.diag((capacity // sizes).astype(float))
    inverse, uses = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    for _ in range(steps):
        column, value = best_pattern(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        change = (inverse * column).sum(axis=1)
        ratio = np.where(change > 1e-7, uses / np.where(change > 1e-7, change, 1), np.inf)
        out = int(np.argmax(np.where(ratio <= ratio.min() + 1e-9, change, 0)))  # of equal ones the safest pivot
        pivot, share = inverse[out] / change[out], ratio[out]
        inverse, uses = inverse - np.outer(change, pivot), np.maximum(uses - change * share, 0)
        inverse[out], uses[out] = pivot, share
        basis[:, out] = column
    return basis, uses


def rounded_groups(counts: np.ndarray, capacity: int, groups: int, least: int) -> list[tuple[int, list[list[int]]]]:
    """Large lengths, longest first, as groups of equal cardinality: (rounded size, [[length, count], ...])."""
    large = [(length, int(counts[length])) for length in range(capacity - 1, least, -1) if counts[length]]
    share = max(1, -(-sum(n for _, n in large) // groups))
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length, n in large:
        while n:
            if not room:
                if not out or out[-1][0] != length:
                    out.append((length, []))
                room = share
            take = min(n, room)
            out[-1][1].append([length, take])
            n, room = n - take, room - take
    return out


def remaining(members: list[list[int]]) -> list[list[int]]:
    """The group's actual lengths, without those used up."""
    while members and not members[0][1]:
        members.pop(0)
    return members


def plan_sequences(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, list[int]]]:
    """Sequences as (how many, lengths in each) for ``counts[length]`` pieces of every length."""
    left = np.array(counts, dtype=np.int64)
    runs: list[tuple[int, list[int]]] = [(int(left[capacity]), [capacity])] if left[capacity] else []
    left[capacity] = 0
    open_runs: list[list[tuple[int, list[int]]]] = [[] for _ in range(capacity + 1)]
    filled = np.zeros(capacity + 1, dtype=bool)

    def put(n: int, lengths: list[int]) -> None:
        room = capacity - sum(lengths)
        open_runs[room].append((n, lengths))
        filled[room] = True

    grouped = rounded_groups(left, capacity, groups, int(capacity * LARGE))
    if grouped:
        sizes = np.array([size for size, _ in grouped])
        demand = np.array([sum(n for _, n in members) for _, members in grouped], dtype=float)
        columns, uses = configurations(sizes, demand, capacity)
        for column, used in zip(columns.T, np.floor(uses + 1e-9).astype(int).tolist(), strict=True):
            slots = [k for k in np.flatnonzero(column) for _ in range(int(column[k]))]
            while used:
                heads = [members for k in slots if (members := remaining(grouped[k][1]))]
                if not heads:
                    break
                # The same actual lengths for as many sequences as they last in all slots; slots that share
                # a run of one length take turns, and a run too short for them ends in one sequence alone.
                sharing = {id(h): sum(h is other for other in heads) for h in heads}
                n = max(1, min(used, *(h[0][1] // sharing[id(h)] for h in heads)))
                lengths = []
                for members in heads:
                    if head := remaining(members):
                        head[0][1] -= n
                        left[head[0][0]] -= n
                        lengths.append(head[0][0])
                put(n, lengths)
                used -= n
    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n:
            rooms = np.flatnonzero(filled[length:])
            if not len(rooms):
                each = capacity // length
                whole, rest = divmod(n, each)
                if whole:
                    put(whole, [length] * each)
                if rest:
                    put(1, [length] * rest)
                break
            room = length + int(rooms[0])
            many, lengths = open_runs[room].pop()
            filled[room] = bool(open_runs[room])
            fits = min(n, many)
            put(fits, [*lengths, length])
            if many > fits:
                put(many - fits, lengths)
            n -= fits
    return runs + [run for rooms in open_runs for run in rooms]


def places(runs: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first rank, offset) for every slot of every run."""
    out, sequence, used = [], 0, {}
    for n, lengths in runs:
        offset = 0
        for length in lengths:
            first = used.get(length, 0)
            out.append((length, first, first + n - 1, sequence, offset))
            used[length] = first + n
            offset += length
        sequence += n
    return out


def ranked_by_length(pieces: DataFrame, slices: int = SLICES) -> DataFrame:
    """Pieces with their rank, from 0, among those of equal length."""
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(slices)))
    sizes = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "slice").orderBy("id", "piece", "ids_crc32")
    numbered = sliced.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(starts, ["length", "slice"]).withColumn("rank", F.col("base") + F.col("place")).drop("slice", "base", "place")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    groups: int = GROUPS,
    json_path: str | None = None,
    ranks_path: str | None = None,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, id_col, text_col, capacity, json_path, ranks_path), "token-pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most one row per length up to the capacity
        counts[length] = n
    slots = spark.createDataFrame(
        places(plan_sequences(counts, capacity, groups)),
        "length bigint, first_rank bigint, last_rank bigint, first_sequence bigint, offset bigint",
    )
    ranked = ranked_by_length(pieces)
    # The slots follow from one count per length, so their number is bounded by the capacity and the groups.
    return ranked.join(F.broadcast(slots), "length").where("rank between first_rank and last_rank").select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
        "offset",
    )
