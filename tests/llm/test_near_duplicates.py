import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import fingerprints, simhash, substrings
from tidewatch.llm.components import connected


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, links):
    group = {n: n for n in nodes}

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        group[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_prints(rng, centres, per_centre, bits):
    """Fingerprints around a few centres, so that links, chains and gaps all occur."""
    out = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        places = rng.sample(range(64), bits)
        for _ in range(per_centre):
            out.add(centre ^ sum(1 << p for p in rng.sample(places, rng.randint(0, 5))))
    return sorted(out)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_links_join_the_groups_that_all_links_join(spark):
    prints = near_prints(random.Random(1), 25, 12, 20)
    nodes = [signed(p) for p in prints]
    every = [(signed(a), signed(b)) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 3]
    want = brute_components(nodes, every)
    df = spark.createDataFrame([(n,) for n in nodes], "fp bigint")
    for bucket in (2048, 2):  # the second cuts every bucket again, and again
        links = [(r.a, r.b) for r in simhash.fingerprint_links(df, 3, bucket).collect()]
        assert all((a ^ b) & (2**64 - 1) for a, b in links)
        assert brute_components(nodes, links) == want


def test_variants_of_fingerprints_are_not_broadcast(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    spark.createDataFrame([(signed(rng.getrandbits(64)),) for _ in range(500)] + [(k,) for k in range(40)], "fp bigint").write.parquet(f"{tmp_path}/nodes")
    nodes, want, kept = spark.read.parquet(f"{tmp_path}/nodes"), None, simhash.stored
    for least in (True, False):  # full buckets few enough to broadcast, or not
        plans = []
        monkeypatch.setattr(simhash, "stored", lambda df, label: plans.append((label, df._jdf.queryExecution().sparkPlan().toString())) or kept(df, label))
        monkeypatch.setattr("tidewatch.session.is_bounded", lambda df, max_rows: least)
        links = simhash.fingerprint_links(nodes, bucket=4)
        made = [p for label, p in plans if label.startswith("bucket-index")]
        assert len(made) == 2 and all(("BroadcastHashJoin" in p) == least and ("SortMergeJoin" in p) != least for p in made)
        assert not re.search("BuildLeft", "".join(made))
        plan = links._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 3
        groups = brute_components(range(40), [(r.a, r.b) for r in links.collect() if 0 <= min(r.a, r.b) and max(r.a, r.b) < 40])
        want = want or groups
        assert groups == want and set(groups.values()) == {0}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = {r.node: r.group for r in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = brute_components(sorted({n for link in links for n in link}), links)
    assert got == want
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_near_duplicates_against_brute_force(table, odd):
    base = " ".join(f"w{i}" for i in range(120))
    rows = odd + [(20, base), (21, base.upper()), (22, base + " tail"), (23, base.replace("w60", "other")), (24, "quite a different text " * 9)]
    got = simhash.near_duplicates(table(rows, clashing=True)).collect()
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    assert sorted(((r.doc_id or 0), r.fingerprint) for r in got) == sorted(((i or 0), f"{p:016x}") for i, p in prints)
    distinct = sorted({p for _, p in prints})
    groups = brute_components(distinct, [(a, b) for a, b in itertools.combinations(distinct, 2) if (a ^ b).bit_count() <= 3])
    least = {}
    for i, p in prints:
        if i is not None:
            least[groups[p]] = min(least.get(groups[p], i), i)
    for r in got:
        assert r.component_id == least.get(groups[int(r.fingerprint, 16)])


def test_empty_tables(table):
    none = table([])
    assert simhash.near_duplicates(none).collect() == []
    assert fingerprints.edited_likeness(none).collect() == []
    assert substrings.remove_repeats(none).collect() == []


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_sketches_are_exact_below_k_and_close_above():
    rng = random.Random(2)
    texts = ["", "a", "a b", "b a", "a b c d e f a b c d e", *[" ".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(60)]]
    sketches = fingerprints.sketches(pa.array(texts))
    for (s, x), (t, y) in itertools.combinations(zip(texts, sketches, strict=True), 2):
        a, b = shingles(s), shingles(t)
        assert len(x) == len(a) == fingerprints.distinct_shingles(x)
        assert abs(fingerprints.resemblance(x, y) - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12
        if a and b:
            assert abs(fingerprints.containment(x, y) - len(a & b) / len(a)) < 1e-9
    words = [f"w{i}" for i in range(6000)]
    x, y = fingerprints.sketches(pa.array([" ".join(words[:4000]), " ".join(words[2000:])]))
    assert abs(fingerprints.resemblance(x, y) - 1 / 3) < 0.1
    assert abs(fingerprints.distinct_shingles(x) / 3996 - 1) < 0.25
    assert fingerprints.encoded(x) == fingerprints.encoded(fingerprints.decoded(fingerprints.encoded(x)))


def test_edits_by_the_next_document(table, odd):
    rows = [r for r in odd if r[0] is not None and r[0] != 4] + [(i, " ".join(f"w{j % (i + 3)}" for j in range(i))) for i in range(10, 60)]
    got = {r.doc_id: r for r in fingerprints.edited_likeness(table(rows, clashing=True), slices=7).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(ordered)
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        a, b = fingerprints.sketches(pa.array([text, edited]))
        assert got[i].n_chars == len(text)
        assert got[i].fingerprint == fingerprints.encoded(a)
        assert got[i].edited_fingerprint == fingerprints.encoded(b)
        assert got[i].near_edited == fingerprints.resemblance(a, b)
        assert got[i].near_next == fingerprints.resemblance(a, fingerprints.sketches(pa.array([following]))[0])
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    repeated = fingerprints.edited_likeness(table(odd), slices=3).collect()
    assert len(repeated) == len(odd)


def test_equal_and_missing_ids_are_cut_by_text(spark, table):
    rng = random.Random(9)
    big = 2**53
    rows = [(i, " ".join(f"v{rng.randint(0, 99)}" for _ in range(20))) for i in [None] * 40 + [big, big + 1, big + 2, -big - 1] + [7] * 40 for _ in (0, 1)]
    docs = table(rows).select(F.col("doc_id").alias("id"), "text")
    dealt, slices = fingerprints.sliced_by_id(docs, 16)
    by_slice = Counter(r.slice for r in dealt.where("not extra").collect())
    assert slices == 16 and len(by_slice) > 12 and max(by_slice.values()) < 30
    assert {i for (i,) in dealt.where("extra").select("slice").collect()} == set(by_slice)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = Counter()
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        q = len(text) // 4
        want[i, hashlib.sha256((text[: len(text) - q] + following[:q]).encode()).hexdigest()] += 1
    for kind in ("bigint", "double", "decimal(20,0)"):
        cast = docs.withColumn("id", F.col("id").cast(kind))
        if kind == "double":
            cast = cast.where(f"id is null or abs(id) < {big}")
            assert fingerprints.edited_likeness(cast, "id", slices=16).count() == 160
        else:
            got = Counter((None if r.id is None else int(r.id), r.edited_sha256) for r in fingerprints.edited_likeness(cast, "id", slices=16).collect())
            assert got == want


def test_slices_follow_the_bytes(table):
    docs = table([(i, "word " * 2000) for i in range(40)]).select(F.col("doc_id").alias("id"), "text")
    assert fingerprints.sliced_by_id(docs, None, 10_000)[1] == 41


def test_merged_fingerprints_are_those_of_the_union(table):
    rows = [(i, " ".join(f"w{j}" for j in range(i, i + 90)), None, f"s{i % 2}") for i in range(12)] + [(50, "", None, "s2")]
    prints = fingerprints.fingerprint(table(rows), keep=["source"])
    got = {r.source: r.fingerprint for r in fingerprints.merged(prints, ["source"], k=64).collect()}
    parts = {}
    for r in prints.collect():
        parts.setdefault(r.source, []).append(fingerprints.decoded(r.fingerprint))
    assert got == {s: fingerprints.encoded(np.unique(np.concatenate(p))[:64]) for s, p in parts.items()}


def test_compared_pairs(spark):
    a, b = (fingerprints.encoded(x) for x in fingerprints.sketches(pa.array(["a b c d e f", "a b c d e g"])))
    got = fingerprints.compared(spark.createDataFrame([(a, b), (a, None), ("", "")], "x string, y string"), "x", "y").collect()
    assert [round(r.resemblance, 6) for r in got] == [round(1 / 3, 6), 0.0, 1.0]


PASSAGE = (
    "The river rose in the night and took the bridge. Nobody had expected so much water this late. By morning the road was gone! "
    "People stood on both sides and waved. A boat came at noon, and it was far too small. They crossed it all the same, two at a time."
)


def test_repeated_passages_go_from_later_documents(table):
    rows = [
        (1, "First comes something else. " + PASSAGE + " And here it ends."),
        (2, "Another beginning without a stop " + PASSAGE + "\nAnother end, quite long, that nobody else has written."),
        (3, "Clean text stands alone. It shares nothing with others. Nothing at all is removed from it, not a single word."),
        (4, PASSAGE.upper() + " Tail."),
        (5, "Short line.\nOnly of.\n" * 2),
        (6, "Twice in one. " + PASSAGE + "\nBetween the two there is this.\n" + PASSAGE),
        (7, None),
        (8, "word " * 60 + "without any stop " + "more " * 30),
        (9, "Before it.\n" + "word " * 60 + "without any stop " + "more " * 30),
    ]
    got = {r.doc_id: r for r in substrings.remove_repeats(table(rows)).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1] and got[5].text == rows[4][1] and got[7].text is None
    assert got[2].text.startswith("Another beginning without a stop The river")  # its first sentence is not the passage's own
    assert "Nobody had expected" not in got[2].text and "two at a time" not in got[2].text and got[2].text.endswith("has written.")
    assert got[4].text == "Tail."
    assert got[6].text == "Twice in one. Between the two there is this.\n"
    assert got[8].removed_sentences == 0 and got[9].text == "Before it.\n"


def test_runs_of_short_sentences_go_too(table):
    short, longer = "Nobody came today. The door stayed shut.", "It rained again. " + "The road to the mill was closed. " * 2 + "We waited."
    rows = [(1, f"Some beginning. {short} An end here."), (2, f"Another start. {short} Something else."), (3, f"{longer}\nNew words."), (4, f"Old words.\n{longer}"), (5, "Yes. No. And one."), (6, "Yes. No. Not two.")]
    got = {r.doc_id: r.text for r in substrings.remove_repeats(table(rows)).collect()}
    assert got[1] == rows[0][1] and got[2] == "Another start. Something else." and got[3] == rows[2][1] and got[4] == "Old words.\n"
    assert got[5] == rows[4][1] and got[6] == rows[5][1]


def test_substring_dedup_of_odd_rows(table, odd):
    docs = table(odd, clashing=True)
    got = substrings.remove_repeats(docs)
    assert got.columns == [*docs.columns, "removed_sentences", "removed_words"]
    rows = got.collect()
    assert len(rows) == len(odd)
    assert sorted((r.doc_id or 0, r.text or "") for r in rows if r.doc_id != 6) == sorted((i or 0, t or "") for i, t in odd if i != 6)


def brute_removed(docs):
    """Sentences removed per document, for lists of sentences that do not repeat within a document."""

    def runs(sentences):
        n = [len(s.split()) for s in sentences]
        enough = lambda a, b: b - a >= 2 and sum(n[a:b]) >= 5
        ends = range(len(n) + 1)
        found = {(a, min(b for b in ends if enough(a, b))) for a in ends if any(enough(a, b) for b in ends)}
        found |= {(max(a for a in ends if enough(a, b)), b) for b in ends if any(enough(a, b) for a in ends)}
        return found | {(a, a + 1) for a in range(len(n)) if n[a] > 20}

    first, gone = {}, {i: set() for i in docs}
    for i in sorted(docs):
        for a, b in runs(docs[i]):
            key = tuple(s.lower() for s in docs[i][a:b])
            if first.setdefault(key, i) != i:
                gone[i] |= set(range(a, b))
    return gone


def test_repeated_spans_against_brute_force(table):
    rng = random.Random(21)
    pool = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 22]))) + "." for _ in range(60)]
    passages = [[f"Passage {p} part {k} of several." for k in range(6)] for p in range(3)]
    docs = {}
    for i in range(90):
        sentences = rng.sample(pool, rng.randint(1, 6))
        if i % 4 == 0:
            at, p = rng.randint(0, len(sentences)), rng.choice(passages)
            sentences[at:at] = p[rng.randint(0, 2) : rng.randint(4, 6)]
        docs[i] = list(dict.fromkeys(s.upper() if i % 5 == 0 else s for s in sentences))
    want = brute_removed(docs)
    got = {r.doc_id: r for r in substrings.remove_repeats(table([(i, " ".join(s)) for i, s in docs.items()], clashing=True), keep=["doc_id", "text"]).collect()}
    assert sum(map(bool, want.values())) > 20 and not all(want.values())
    for i, sentences in docs.items():
        left = [s for k, s in enumerate(sentences) if k not in want[i]]
        assert got[i].text.split() == " ".join(left).split() and got[i].removed_sentences == len(want[i]), i
