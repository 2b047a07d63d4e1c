"""Pieces with seeded merge-dropout, and back.

Text becomes pieces by the vocabulary's merges: of all neighbouring parts whose union is a piece, the agenda
takes the best one, the leftmost of equals. Every candidate it takes is skipped with
probability ``dropout``, as a keyed hash decides, and the candidate is then gone unless a neighbour's merge
makes a new one. So one word gets several segmentations, all of them made by merges, and all decode to the
same text. The key is the seed, the hash of the document's text and the segment's place in it: its hashes draw how many
candidates are taken until the next one is skipped, so each occurrence of a word draws anew among all its
segmentations, and a repeated task gives the same pieces.

The agendas of all segments of a batch run at once, on matrices of part numbers: each different segment once without
skips, and each occurrence whose draw falls among its candidates once with them. Long segments have agendas of their own.

A text is cut into segments where no piece reaches across: before spaces, between letters and signs, at line ends and tabs.
Characters without a piece become byte pieces. The sign that stands for a space is written in bytes where
it occurs in the text itself, so decoding is exact for every string. Null and empty texts have no pieces.
"""

from __future__ import annotations

import heapq
import re
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tidewatch.llm.common import attach, flat_lists
from tidewatch.llm.words import BASE, mixed

DROPOUT = 0.1
SEED = 20
REMEMBERED = 300_000  # segments of the texts that are worked on together
MOST_TAKEN = 1 << 16  # of candidates that one draw speaks of
SHORT = 40
SPACE = "▁"
NONE = 1 << 40
FULL = (1 << 64) - 1


class Vocabulary:
    """Pieces with their ids and merge ranks, and the places where text may be cut."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        self.piece = [model.id_to_piece(i) for i in range(size)]
        self.id = {p: i for i, p in enumerate(self.piece) if not special[i]}
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.raw = {i: bytes([b]) for b, i in self.byte.items()} | {i: p.replace(SPACE, " ").encode() for p, i in self.id.items()}
        scores = sorted({model.get_score(i) for i in self.id.values()}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        self.rank = {p: order[model.get_score(i)] for p, i in self.id.items() if len(p) > 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece reaches across a space")
        alone = "".join(c for c in "\n\t" if not any(c in p for p in self.id))
        signs = re.escape("".join(sorted(self.never_after_letters())))
        word = f"{SPACE}*[^{SPACE}{alone}{signs}]*[^\\W\\d_](?=[{signs}])|" if signs else ""
        self.segment = re.compile(f"{word}{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))

    def never_after_letters(self) -> set[str]:
        """ASCII signs that follow a letter in no piece."""
        signs = {chr(c) for c in range(33, 127) if not chr(c).isalnum()}
        return signs - {b for p in self.id for a, b in zip(p, p[1:], strict=False) if re.match(r"[^\W\d_]", a)} - {"_"}

    def ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for part in parts:
            number = self.id.get(part)
            if number is None:
                out += [self.byte[b] for b in part.encode("utf-8", "surrogatepass")]
            else:
                out.append(number)
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def taken_bounds(dropout: float) -> np.ndarray:
    """Ascending bounds: of a uniform 64-bit draw, k candidates at least are taken before a skip if k bounds lie above it."""
    share, bounds = 1.0, []
    while (share := share * (1 - dropout)) * 2.0**64 >= 1 and len(bounds) < MOST_TAKEN:
        bounds.append(int(share * 2.0**64))
    return np.array([min(b, FULL) for b in reversed(bounds)], np.uint64)


class Skips:
    """Tells candidate after candidate whether it is skipped, and counts them; ``more()`` gives the number of the next skip."""

    def __init__(self, first: int, more):
        self.next, self.more, self.seen = first, more, 0

    def __call__(self, rank: int, at: int, parts: int) -> bool:
        self.seen += 1
        if self.seen <= self.next:
            return False
        self.next = self.more(self.next)
        return True


def merge_short(segment: str, rank: dict[str, int], skipped) -> list[str]:
    """The agenda over a short segment: the best of few candidates is found by looking at all."""
    parts = list(segment)
    agenda = [rank.get(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while agenda:
        best = min(agenda)
        if best == NONE:
            break
        i = agenda.index(best)
        if skipped(best, i, len(parts)):
            agenda[i] = NONE
            continue
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del agenda[i]
        if i:
            agenda[i - 1] = rank.get(parts[i - 1] + parts[i], NONE)
        if i < len(agenda):
            agenda[i] = rank.get(parts[i] + parts[i + 1], NONE)
    return parts


def merge_long(segment: str, rank: dict[str, int], skipped) -> list[str]:
    """The same with a heap and linked parts, for segments of any length."""
    parts: list[str | None] = list(segment)
    n = len(parts)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    agenda = [(r, i, 2) for i in range(n - 1) if (r := rank.get(segment[i : i + 2])) is not None]
    heapq.heapify(agenda)
    while agenda:
        best, i, size = heapq.heappop(agenda)
        j = after[i]
        if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size or rank.get(parts[i] + parts[j]) != best:
            continue
        if skipped(best, i, size):
            continue
        parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := rank.get(parts[a] + parts[b])) is not None:
                heapq.heappush(agenda, (r, a, len(parts[a]) + len(parts[b])))
    return [p for p in parts if p is not None]


class Agendas:
    """The agendas of many short segments at once.

    A part is a number: a piece's id, or ``OTHER`` and the code point of a character without a piece. Pairs of parts that
    make a piece are in a hash table with linear probing. Parts of a segment are linked, as merges leave gaps.
    """

    OTHER = 1 << 20
    BITS = 20
    WORST = np.int32(2**31 - 1)
    WIDTHS = (2, 4, 6, 8, 11, 15, 22, SHORT)

    def __init__(self, words: Vocabulary):
        self.words = words
        entries = {}
        for piece, rank in words.rank.items():
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if (len(a) == 1 or a in words.rank) and (len(b) == 1 or b in words.rank):
                    entries[self.part(a) << 32 | self.part(b)] = (rank, words.id[piece])
        size = 1 << self.BITS
        if 2 * len(entries) > size:
            raise ValueError("more pairs of parts than the table is made for")
        self.keys = np.full(size, FULL, np.uint64)
        self.ranks, self.made = np.full(size, self.WORST, np.int32), np.zeros(size, np.int32)
        slots = self.slots(np.fromiter(entries, np.uint64, len(entries))).tolist()
        for (key, (rank, made)), slot in zip(entries.items(), slots):
            while self.keys[slot] != FULL:
                slot = (slot + 1) % size
            self.keys[slot], self.ranks[slot], self.made[slot] = key, rank, made

    def part(self, text: str) -> int:
        number = self.words.id.get(text)
        return self.OTHER + ord(text) if number is None else number

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * BASE) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of each pair of parts; the worst rank where they make none."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = self.slots(keys)
        there = self.keys[slot]
        rest = np.flatnonzero((there != keys) & (there != FULL))
        while len(rest):
            slot[rest] = (slot[rest] + 1) % len(self.keys)
            there = self.keys[slot[rest]]
            rest = rest[(there != keys[rest]) & (there != FULL)]
        return self.ranks[slot], self.made[slot]  # an empty slot has the worst rank

    def characters(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The parts that segments begin with, one after the other, and each segment's length."""
        text = "".join(segments)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        different, at = np.unique(points, return_inverse=True)
        return np.array([self.part(chr(c)) for c in different.tolist()], np.int32)[at], np.fromiter(map(len, segments), np.int64, len(segments))

    def run(self, flat: np.ndarray, length: np.ndarray, which: np.ndarray, skips: np.ndarray, more) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(candidates seen, parts left, those parts) for the segments ``which`` of those whose characters are given.

        ``skips`` is the number of the first skipped candidate of each, ``more(rows, draw, last)`` that of the next.
        """
        start = (np.cumsum(length) - length)[which]
        length = length[which]
        seen, left = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        bounds = np.searchsorted(self.WIDTHS, length)
        for k, width in enumerate(self.WIDTHS):
            every = np.flatnonzero(bounds == k)
            for low in range(0, len(every), 1 << 15):
                rows = every[low : low + (1 << 15)]
                seen[rows], kept = self.bucket(flat, start[rows], length[rows], width, skips[rows], lambda r, d, at, rows=rows: more(rows[r], d, at))
                left[rows] = (kept >= 0).sum(1)
                parts.append((rows, kept[kept >= 0]))
        # back in the order of the segments asked for
        ends = np.cumsum(left)
        out = np.empty(ends[-1] if len(ends) else 0, np.int32)
        for rows, values in parts:
            out[runs(ends[rows] - left[rows], left[rows])] = values
        return seen, left, out

    def bucket(self, flat, start, length, width, skip, more) -> tuple[np.ndarray, np.ndarray]:
        n, column = len(start), np.arange(width)
        inside = column < length[:, None]
        parts = np.where(inside, flat[np.minimum(start[:, None] + column, max(len(flat) - 1, 0))] if len(flat) else -1, -1).astype(np.int32)
        # one column more on either side stands for the ends
        after, before = np.tile((column + 1).astype(np.int8), (n, 1)), np.tile((column - 1).astype(np.int8), (n, 1))
        rank, made = np.full((n, width), self.WORST, np.int32), np.zeros((n, width), np.int32)
        row, at = np.nonzero(inside[:, 1:])
        rank[row, at], made[row, at] = self.pairs(parts[row, at], parts[row, at + 1])
        seen, draw, skip = np.zeros(n, np.int64), np.zeros(n, np.int64), skip.copy()
        active = np.arange(n)
        while len(active):
            at = rank[active].argmin(1)
            going = rank[active, at] != self.WORST
            active, at = active[going], at[going]
            skipped = seen[active] == skip[active]
            seen[active] += 1
            row, i = active[skipped], at[skipped]
            if len(row):
                rank[row, i] = self.WORST
                draw[row] += 1
                skip[row] = more(row, draw[row], skip[row])
            row, i = active[~skipped], at[~skipped]
            if not len(row):
                continue
            j = after[row, i].astype(np.int64)
            parts[row, i], parts[row, j] = made[row, i], -1
            rank[row, j] = self.WORST
            end = after[row, j].astype(np.int64)
            after[row, i] = end
            inner = end < length[row]
            before[row[inner], end[inner]] = i[inner]
            rank[row[~inner], i[~inner]] = self.WORST
            rank[row[inner], i[inner]], made[row[inner], i[inner]] = self.pairs(parts[row[inner], i[inner]], parts[row[inner], end[inner]])
            first = before[row, i]
            inner = first >= 0
            row, first, i = row[inner], first[inner], i[inner]
            rank[row, first], made[row, first] = self.pairs(parts[row, first], parts[row, i])
        return seen, parts

    def ids(self, parts: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each segment) from parts; characters without a piece become bytes."""
        other = np.flatnonzero(parts >= self.OTHER)
        if not len(other):
            return parts.astype(np.int32), left
        spelled = [[self.words.byte[b] for b in chr(c - self.OTHER).encode("utf-8", "surrogatepass")] for c in parts[other].tolist()]
        times = np.ones(len(parts), np.int64)
        times[other] = [len(x) for x in spelled]
        out = np.repeat(parts, times)
        begin = np.cumsum(times) - times
        out[runs(begin[other], times[other])] = [b for x in spelled for b in x]
        owner = np.repeat(np.arange(len(left)), left)
        return out.astype(np.int32), np.bincount(owner, times, len(left)).astype(np.int64)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, … of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Segmenter:
    """Ids of whole texts for one vocabulary, seed and dropout."""

    def __init__(self, path: str, seed: int, dropout: float, remembered: int = REMEMBERED):
        self.words, self.seed, self.dropout, self.together = vocabulary(path), seed, dropout, remembered
        self.bounds, self.agendas = taken_bounds(dropout), agendas(path)
        self.space = np.array([self.words.byte[b] for b in SPACE.encode()], np.int32)

    def taken(self, keys: np.ndarray, draw) -> np.ndarray:
        """Candidates taken before the next skip, by the keys' draw of that number."""
        hashes = mixed(mixed(keys + np.uint64(0xC2B2AE3D27D4EB4F) * np.asarray(draw).astype(np.uint64)))
        return len(self.bounds) - np.searchsorted(self.bounds, hashes, side="right")

    def drawn(self, segment: str, key: np.uint64, first: int) -> list[int]:
        """The ids of one segment by an agenda of its own, with as many skips as the key draws, one after the other."""
        draw, keys = 0, np.array([key], np.uint64)

        def more(last: int) -> int:
            nonlocal draw
            at = last + 1
            while True:
                draw += 1
                n = int(self.taken(keys, draw)[0])
                at += n
                if n < MOST_TAKEN:
                    return at

        skipped = Skips((first if first < MOST_TAKEN else more(first - 1)) if self.dropout else NONE, more)
        return self.words.ids((merge_short if len(segment) <= SHORT else merge_long)(segment, self.words.rank, skipped))

    def segments(self, text: str):
        """Lists of a text's segments; None stands for the sign for a space that the text itself holds."""
        for k, part in enumerate(text.split(SPACE) if text else ()):
            if k:
                yield [None]
            yield self.words.segment.findall((SPACE if not k else "") + part.replace(" ", SPACE))

    def encode(self, text: str, document: int) -> bytes:
        """Ids of a whole text; ``document`` is the hash that keys its skips together with the place."""
        return self.encode_all([text], [document])[0].tobytes()

    def encode_all(self, texts: list[str], documents: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of whole texts, many segments at a time."""
        sizes, out = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)]
        waiting, n, place = [], 0, 0
        for t, (text, document) in enumerate(zip(texts, documents)):
            place = 0
            for found in self.segments(text):
                waiting.append((t, document, place, found))
                place += len(found) if found != [None] else 0
                n += len(found)
                if n >= self.together:
                    out.append(self.encode_segments(waiting, sizes))
                    waiting, n = [], 0
        if waiting:
            out.append(self.encode_segments(waiting, sizes))
        return np.concatenate(out), sizes

    def encode_segments(self, lists: list[tuple[int, int, int, list[str | None]]], sizes: np.ndarray) -> np.ndarray:
        """The ids of lists of segments, each (text, document, place of its first); adds to the texts' sizes."""
        length = np.array([len(x[3]) for x in lists])
        text, document, place = (np.repeat(np.array([x[i] for x in lists], kind), length) for i, kind in ((0, np.int64), (1, np.uint64), (2, np.int64)))
        place = place + runs(np.zeros(len(lists), np.int64), length)
        column = pa.array(chain.from_iterable(x[3] for x in lists), pa.string(), size=int(length.sum())).dictionary_encode(null_encoding="encode")
        different, code = column.dictionary.to_pylist(), column.indices.to_numpy()
        keys = (place.astype(np.uint64) + document) * BASE
        short = np.array([s is not None and len(s) <= SHORT for s in different], bool)
        never = np.full(len(different), NONE)
        plain = [s if k else "" for s, k in zip(different, short.tolist())]
        characters = self.agendas.characters(plain)
        seen, left, parts = self.agendas.run(*characters, np.arange(len(different)), never, None)
        flat, many = self.agendas.ids(parts, left)
        first = self.taken(keys, 0) if self.dropout else np.full(len(code), NONE)
        # where the sign for a space is met, or an agenda of its own is needed
        own = np.flatnonzero(~short[code] | ((first >= MOST_TAKEN) & (self.dropout > 0)))
        again = np.flatnonzero(short[code] & (first < seen[code]) & (first < MOST_TAKEN))

        def more(rows: np.ndarray, draw: np.ndarray, last: np.ndarray) -> np.ndarray:
            at, k = last + 1, keys[again[rows]]
            n = self.taken(k, draw)
            return at + n

        pools, starts, counts = [flat], (np.cumsum(many) - many)[code], many[code]
        if len(again):
            _, left, parts = self.agendas.run(*characters, code[again], first[again], more)
            ids, n = self.agendas.ids(parts, left)
            starts[again], counts[again] = len(flat) + np.cumsum(n) - n, n
            pools.append(ids)
        at = sum(map(len, pools))
        for i in own.tolist():
            segment = different[code[i]]
            ids = self.space if segment is None else np.array(self.drawn(segment, keys[i], int(first[i])), np.int32)
            starts[i], counts[i] = at, len(ids)
            pools.append(ids)
            at += len(ids)
        sizes += np.bincount(text, counts, len(sizes)).astype(np.int64)
        return np.concatenate(pools)[runs(starts, counts)]


@cache
def agendas(path: str) -> Agendas:
    return Agendas(vocabulary(path))


def decode_ids(ids, words: Vocabulary) -> str:
    """The text of a list of ids."""
    raw = b"".join(map(words.raw.__getitem__, ids))
    return raw[1:].decode("utf-8", "surrogatepass") if raw else ""


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    dropout: float = DROPOUT,
    seed: int = SEED,
    path: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The id (or ``keep``) with ``ids`` and ``n_pieces`` of every whole text.

    A document's skips are keyed by the hash of its text, so equal texts are segmented alike.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def make():
        segmenter = Segmenter(path, seed, dropout)

        def compute(texts):
            texts = [t or "" for t in texts.to_pylist()]
            ids, sizes = segmenter.encode_all(texts, [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), seed) for t in texts])
            return [flat_lists(sizes, pa.array(ids)), pa.array(sizes, pa.int32())]

        return compute

    return attach(docs, text_col, make, "ids array<int>, n_pieces int", keep=keep or [id_col])


def decode(pieces: DataFrame, ids_col: str = "ids", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The rows with the text of their ids in place of the ids; null ids give null."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def text_of(ids):
        words = vocabulary(path)
        return ids.map(lambda x: None if x is None else decode_ids(x.tolist(), words))

    return pieces.select(*[text_of(ids_col).alias(text_col) if c == ids_col else F.col(f"`{c}`") for c in pieces.columns if c == ids_col or c.lower() != text_col.lower()])
