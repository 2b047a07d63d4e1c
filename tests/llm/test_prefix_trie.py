import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import types as T

from tidewatch.llm import prefix_trie as P


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = children[node]
        leaves[node] = sum(leaves[k] for k in kids) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in kids)
    rows = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(convs[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        rows.append((min(cs), len(node), parent, len(cs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in ("key", "pos", "id", "block", "t0", "turn_id")]])


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)


def conversations():
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 60), 100, 101, 103, 250, 251, 399, 1000, 1001, *range(2000, 2040)]:
        n = rng.choice([1, 2, 3, 5, 8, 9, 24, 25, 60]) if c not in (1000, 1001) else 90
        for t in range(n):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "hello, 日本 😀", "why?"]) if t < 2 else f"turn {t} {rng.randint(0, 1)}"))
    rows += [(2100 + i, t, "user", f"the same {t}") for i in range(150) for t in range(7)]  # one very common conversation
    rows += [(5, None, None, None), (6, 3, "user", None), (6, 3, None, "text"), (None, 0, "user", "nobody's"), (2101, 0, "user", "the same 0")]
    rows += [(-7, 0, "user", "x" * 50_000), (7000, 0, "", "")]
    return rows


def test_trie_against_brute_force(spark):
    rows = conversations()
    convs = rebuilt([r for r in rows if r[0] != -7])
    df = table(spark, [r for r in rows if r[0] != -7])
    for widths in (P.WIDTHS, (2, 3)):
        got = P.prefix_nodes(*P.with_family_heads(P.numbered_turns(df)), widths=widths)
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == brute(convs)


def test_conversations_without_turns_end_at_the_root(spark):
    # 101 has fewer turns than it would take from 100, which is missing
    taken = {c: zlib.crc32(str(c).encode()) % 6 for c in range(101, 200)}
    c = next(c for c, h in taken.items() if h)
    rows = [(c, 0, "user", "a"), (-7, 0, "user", "x" * 50_000)]
    got = P.prefix_nodes(*P.with_family_heads(P.numbered_turns(table(spark, rows)))).collect()
    assert rebuilt(rows)[c] == [] and sorted(map(tuple, got), key=str) == brute(rebuilt(rows))


def test_empty_conversations(spark):
    assert P.prefix_nodes(*P.with_family_heads(P.numbered_turns(table(spark, [])))).collect() == []
