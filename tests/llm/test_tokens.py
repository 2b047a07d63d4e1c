import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewatch.llm import packing, pieces, token_counts

LETTERS = "abcdEFG'stre vmld 0123!?#.\n\t éÉßüÜñªº²½×÷ ĀāŁǅɏ日😀<|>▁"


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 50))) for _ in range(n)]


ODD_TEXTS = ["don't I'LL", "1234 ½²", "<|endoftext|>x", "a<|startoftext|> b", "é́ É ﬁ İ ß", "x\x1cy", "  two  spaces ", " \n a", "a \n b\n\n  c", "é ü\xa0 x"]


def test_counts_equal_the_library(table, odd):
    texts = ODD_TEXTS + random_texts(1, 400)
    rows = [(100 + i, t) for i, t in enumerate(texts)] + odd
    got = token_counts.token_counts(table(rows, clashing=True)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == sorted((i or 0, b, n) for i, b, n in want)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts.token_counts(table([])).collect() == []


def test_whole_tokens_are_proved():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = token_counts.whole_tokens(path)
    assert "the" in whole and len(whole) > 10_000
    library = Tokenizer.from_file(path)
    for text in random.Random(2).sample(sorted(whole), 300):
        assert len(library.encode(text, add_special_tokens=False).ids) == 1


def test_ids_equal_the_library():
    encode = packing.id_encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ODD_TEXTS + random_texts(3, 400):
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def check_plan(counts, capacity):
    runs = packing.plan_sequences(counts, capacity)
    placed = np.zeros(capacity + 1, int)
    for n, lengths in runs:
        assert n > 0 and sum(lengths) <= capacity
        for length in lengths:
            placed[length] += n
    assert (placed == counts).all()
    return sum(n for n, _ in runs)


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_every_length_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(2049, int)
    for length in np.minimum(rng.lognormal(6, 1, 3000).astype(int) + 1, 2048):
        counts[length] += 1
    least = -(-int((counts * np.arange(2049)).sum()) // 2048)
    assert check_plan(counts, 2048) <= 1.03 * least + 1
    assert check_plan(np.zeros(2049, int), 2048) == 0
    one = np.zeros(2049, int)
    one[1500] = 7
    assert check_plan(one, 2048) == 7


def test_packing_against_the_library(table, odd):
    rows = odd + [(100 + i, " ".join(f"word{j}" for j in range(n))) for i, n in enumerate([3, 700, 5000, 40, 40, 40, 900])]
    got = packing.pack(table(rows, clashing=True)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        n = len(ids)
        first = n if n <= 2048 else n % 2048 or 2048
        cuts = [0, *range(first, n + 1, 2048)]
        want += [(i or 0, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(table([])).collect() == []


def test_pieces_without_dropout_equal_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = pieces.Segmenter(path, 1, 0.0, 1)
    for text in [*ODD_TEXTS, *random_texts(5, 400), "a" * 3000, "<s></s><0x41><unk>", " "]:
        if "▁" not in text:
            assert np.frombuffer(plain.encode(text, 0), np.int32).tolist() == library.encode(text)


def test_short_and_long_agendas_agree():
    words = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    for text in random_texts(6, 200):
        for segment in words.segment.findall(pieces.SPACE + text.replace(" ", pieces.SPACE)):
            short, long = (merge(segment, words.rank, lambda *_: False) for merge in (pieces.merge_short, pieces.merge_long))
            assert short == long


def test_dropout_varies_and_decodes_losslessly(table, odd):
    rows = odd + [(100 + i, t) for i, t in enumerate(random_texts(7, 100))] + [(300 + i, f"segmentation of everything number {i}") for i in range(60)]
    docs = table(rows, clashing=True)
    made = pieces.encode(docs, keep=["doc_id"])
    back = pieces.decode(made).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    again = {(r.doc_id or 0, tuple(r.ids)) for r in pieces.encode(docs, keep=["doc_id"]).collect()}
    assert again == {(r.doc_id or 0, tuple(r.ids)) for r in made.collect()}
    starts = {tuple(r.ids)[:4] for r in made.where("doc_id >= 300").collect()}
    assert len(starts) > 1
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in made.where("doc_id between 100 and 199").collect():
        assert "▁" in dict(rows)[r.doc_id] or library.decode(list(r.ids)) == dict(rows)[r.doc_id]
    assert pieces.encode(table([])).collect() == []


def test_dropout_share(table):
    path = public_tokenizers.path("piece_bpe_32k.model")
    n = [sum(len(pieces.Segmenter(path, 1, p, 4).encode(f"important words number {i}", i)) for i in range(50)) for p in (0.0, 0.1, 0.9)]
    assert n[0] < n[1] < n[2]


def test_every_place_draws_among_all_segmentations():
    path = public_tokenizers.path("piece_bpe_32k.model")
    word = "▁internationalization"
    made, n = pieces.Segmenter(path, 3, 0.3), 4000
    seen = set()
    for document in range(4):
        ids = np.frombuffer(made.encode(" ".join(["internationalization"] * n), 1000 * document + 7), np.int32).tolist()
        text = [made.words.piece[i] for i in ids]
        starts = [k for k, p in enumerate(text) if p.startswith("▁")]
        seen |= {tuple(text[a:b]) for a, b in zip(starts, [*starts[1:], len(text)], strict=True)}
    assert all("".join(s) == word for s in seen) and len(seen) > 50


def test_skips_have_the_share_and_the_segmentations_of_a_plain_agenda():
    path = public_tokenizers.path("piece_bpe_32k.model")
    made = pieces.Segmenter(path, 3, 0.25)
    keys = np.arange(100_000).astype(np.uint64) * pieces.BASE
    for draw in (0, 1):
        taken = made.taken(keys, draw)
        assert all(abs((taken >= k).mean() - 0.75**k) < 0.01 for k in range(1, 8))
    text = " ".join(["segmentation", "everything", "unbelievable", "x" * 60] * 50)
    segments = made.words.segment.findall(pieces.SPACE + text.replace(" ", pieces.SPACE))
    want = []
    for place, segment in enumerate(segments):
        key, skips, at = np.array([(place + 99) * int(pieces.BASE) & pieces.FULL], np.uint64), set(), -1
        for draw in range(100):
            at += 1 + int(made.taken(key, draw)[0])
            skips.add(at)
        numbers = iter(range(10**6))
        want += made.words.ids(pieces.merge_long(segment, made.words.rank, lambda *_: next(numbers) in skips))
    for _ in range(2):  # the second time as remembered
        assert np.frombuffer(made.encode(text, 99), np.int32).tolist() == want
