"""The trie of conversation prefixes, by ROLLUP over turn-id columns.

A turn's id is a 128-bit hash of role and text followed by the number of code points of the text. The turns of
a conversation lie in blocks of positions, one column each: ``WIDTHS`` for the first blocks, then the last width
again and again. A block's rows are keyed by the node that the conversation reached in the block before, so
``GROUP BY node, ROLLUP (t0, t1, …)`` makes every prefix that ends in the block, and ``grouping_id()`` tells how
long it is. Sums over subtrees are the same ROLLUP over the nodes, from the last block back to the first; what
it totals per key goes to the node above. Counts, minima and sums are pre-aggregated, so a prefix that very many
conversations share gathers nowhere. Each block is stored; there are as many steps as blocks.

The ids of the conversations that end at a node are joined in bounded pieces and hashed from the sorted stream of
pieces, so no task holds them all.

Conversations are ordered by turn, null first, then by turn id; null role or text becomes empty. Rows without
conversation id take no part. Repeated rows are repeated turns. Equal conversations share all nodes. An empty
table has no nodes, as nobody is a member of the root. Texts of any length count whole. Other columns neither
matter nor clash.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored
from tidewatch.operators.ordering import in_order

WIDTHS = (8, 16, 32)  # grouping_id() has one bit for each column of a block and its key
FAMILY = 100
HEADS = 6
#: Conversation ids joined in one piece.
PIECE_BITS = 10
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes of hash and 8 bytes of text length."""
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    return F.unhex(F.concat(digest, F.lpad(F.hex(F.char_length(text).cast("long")), 16, "0")))


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, turn_id) with positions 1, 2, … in each conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.where(F.col(conv_col).isNotNull())
    turns = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), turn_id(role, text).alias("turn_id"))
    return in_order(turns, ["conv_id"], ["turn", "turn_id"], "pos").rows.select("conv_id", "pos", "turn_id")


def with_family_heads(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns, crc32 of the id modulo ``heads`` of them, are those of the first of their family.

    Gives the turns as (conv_id, pos, turn_id) and the conversations as (conv_id, n_turns), also those left without turns.
    """
    turns = stored(turns, "turns")
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    firsts = lengths.select(F.col("conv_id").alias("first"), F.col("own").alias("first_own"))
    convs = lengths.withColumns(
        {"h": F.crc32(F.col("conv_id").cast("string")) % heads, "first": F.col("conv_id") - F.col("conv_id") % family}
    ).join(firsts, "first", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("first_own", F.lit(0))))
    convs = stored(convs.select("conv_id", "first", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns")), "conversations")
    shared = turns.where(F.col("pos") < heads).withColumnRenamed("conv_id", "first").join(convs, "first").where("pos <= h")
    rest = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h")
    rebuilt = shared.select("conv_id", "pos", "turn_id").unionByName(rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_id"))
    return rebuilt, convs.select("conv_id", "n_turns")


def node_id(key: Column, turns: list[Column]) -> Column:
    """The hash of a key and the turns after it; a missing turn adds nothing."""
    return F.unhex(F.md5(F.concat(key, *[F.coalesce(t, F.lit(b"")) for t in turns])))


def spans(longest: int, widths: tuple[int, ...] = WIDTHS) -> list[tuple[int, int]]:
    """(first position before, width) of the blocks up to the longest conversation; at least one."""
    out = [(0, widths[0])]
    while sum(out[-1]) < longest:
        out.append((sum(out[-1]), widths[min(len(out), len(widths) - 1)]))
    return out


def rolled(rows: DataFrame, width: int, sums: str) -> DataFrame:
    """``sums`` for the key and every run of first columns of a block that has as many turns, with their number ``d``."""
    names = ", ".join(f"t{i}" for i in range(width))
    rows = rows.sparkSession.sql(f"SELECT key, {names}, {width} - bit_count(grouping_id()) AS d, {sums} FROM {{rows}} GROUP BY key, ROLLUP ({names})", rows=rows)
    return rows.where(F.size(F.filter(F.array(*[f"t{i}" for i in range(width)]), lambda t: t.isNotNull())) == F.col("d"))


def prefix_nodes(turns: DataFrame, convs: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """One row per node of the trie over turns (conv_id, pos, turn_id) of conversations (conv_id, n_turns)."""
    # neighbouring numbers of this order differ by at most a piece within one range
    convs = convs.select("conv_id", F.col("n_turns").cast("long")).repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    convs = stored(convs.withColumn("piece", F.shiftright(F.monotonically_increasing_id(), PIECE_BITS)), "ordered-conversations")
    blocks = spans(convs.agg(F.max("n_turns")).first()[0] or 0, widths)
    start = F.lit(0)
    for i, (before, _) in enumerate(blocks):
        start = F.when(F.col("pos") > before, F.lit(i)).otherwise(start)
    offset = F.element_at(F.array(*[F.lit(b) for b, _ in blocks]), F.col("block") + 1)
    slots = turns.withColumn("block", start).withColumn("slot", F.col("pos") - offset - 1)
    slots = slots.groupBy("block", "conv_id").agg(*[F.max(F.when(F.col("slot") == i, F.col("turn_id"))).alias(f"t{i}") for i in range(max(w for _, w in blocks))])
    slots = stored(slots, "turn-columns")

    reached = convs.withColumn("key", F.lit(b""))
    made, ends, out = [], [], ["id", "parent", "depth", "n_convs", "conv_id", "saved"]
    for i, (before, width) in enumerate(blocks):
        columns = [F.col(f"t{j}") for j in range(width)]
        own = slots.where(F.col("block") == i).select("conv_id", *columns)
        rows = stored(reached.join(own, "conv_id", "inner" if i else "left"), f"block-{i}")
        last = node_id(F.col("key"), columns)
        ended = rows.where(F.col("n_turns") <= before + width)
        ends.append(ended.select(F.when(F.col("n_turns") == 0, F.col("key")).otherwise(last).alias("id"), "piece", "conv_id"))
        reached = rows.where(F.col("n_turns") > before + width).select("conv_id", "n_turns", "piece", last.alias("key"))
        nodes = rolled(rows, width, "count(*) AS n_convs, min(conv_id) AS conv_id")
        if i:  # the key alone is a node of the block before
            nodes = nodes.where("d > 0")
        above = node_id(F.col("key"), [F.when(F.col("d") > j + 1, c) for j, c in enumerate(columns)])
        length = F.conv(F.hex(F.substring(F.element_at(F.array(*columns), F.greatest(F.col("d"), F.lit(1))), 17, 8)), 16, 10).cast("long")
        nodes = nodes.select(
            F.when(F.col("d") == 0, F.col("key")).otherwise(last).alias("id"),
            F.when(F.col("d") == 1, F.col("key")).when(F.col("d") > 1, above).alias("parent"),
            (F.col("d") + before).cast("long").alias("depth"), "n_convs", "conv_id",
            ((F.col("n_convs") - 1) * F.coalesce(length, F.lit(0))).alias("saved"), "key", *columns,
        )
        made.append(stored(nodes, f"nodes-{i}"))

    every = made[0].select(*out)
    for nodes in made[1:]:
        every = every.unionByName(nodes.select(*out))
    children = stored(every.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "id"), "children")

    below, totals = None, None
    for i, (_, width) in reversed(list(enumerate(blocks))):
        columns = [F.col(f"t{j}") for j in range(width)]
        rows = made[i].join(children, "id", "left").select("id", "key", *columns, "saved", F.col("n_children").isNull().cast("long").alias("leaves"))
        if below is not None:
            rows = rows.join(below, "id", "left").withColumns({c: F.col(c) + F.coalesce(f"{c}_below", F.lit(0)) for c in ("saved", "leaves")})
        sums = rolled(rows, width, "sum(saved) AS saved_tokens, sum(leaves) AS n_leaves")
        if i:
            sums = stored(sums, f"sums-{i}")
            below = sums.where("d = 0").select(F.col("key").alias("id"), F.col("saved_tokens").alias("saved_below"), F.col("n_leaves").alias("leaves_below"))
            sums = sums.where("d > 0")
        named = sums.select(F.when(F.col("d") == 0, F.col("key")).otherwise(node_id(F.col("key"), columns)).alias("id"), "saved_tokens", "n_leaves")
        totals = named if totals is None else totals.unionByName(named)

    ended = ends[0]
    for more in ends[1:]:
        ended = ended.unionByName(more)
    parents = every.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = every.drop("saved").join(totals, "id").join(children, "id", "left").join(hashed_ends(ended), "id", "left")
    found = found.join(parents, "parent", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def hashed_ends(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256): the hash of each node's ascending conversation ids joined by commas."""
    pieces = ends.groupBy("id", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    stream = pieces.repartition("id").sortWithinPartitions("id", "piece")

    def run(batches):
        node, state = None, None
        for batch in batches:
            done = []
            for i, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i != node or state is None:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = i, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield made(done)
        if state is not None:
            yield made([(node, state.hexdigest())])

    def made(rows):
        a, b = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.string())], names=["id", "ends_sha256"])

    return stream.select("id", "ids").mapInArrow(run, "id binary, ends_sha256 string")
