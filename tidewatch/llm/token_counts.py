"""Token counts by the whole-token shortcut.

Which vocabulary strings encode alone as exactly their own token is proved once, on the driver, by
encoding every one of them with the tokenizer itself. Pre-tokens that match a proven string count as
one token without any merging; only the rest are merged, each distinct one once per batch of texts,
and remembered up to a fixed number of entries. Texts holding characters beyond the Latin blocks, or
special strings, go whole through the tokenizer.

Null and empty texts have no bytes and no tokens.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.common import attach

LIMIT = 2048
REMEMBERED = 150_000
#: Characters that the shortcut leaves to the tokenizer: beyond Latin, or whose lower case or class is special.
NOT_PLAIN = re.compile("[^\\x00-\\u024f]|İ|<\\|")
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
DIGITS = "0-9²³¹¼-¾"
SPACES = "\\t-\\r \u0085 "
#: The tokenizer's own split for plain text, on lower case.
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{SPACES}{LETTERS}{DIGITS}]+")


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@cache
def whole_tokens(path: str) -> frozenset[str]:
    """Pre-tokens proved to be one token: vocabulary strings that, encoded alone, give their own id."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end, letters = model["end_of_word_suffix"], byte_letters()
    strings = {}
    for piece, number in model["vocab"].items():
        if not piece.endswith(end) or not all(c in letters for c in piece[: -len(end)]):
            continue
        try:
            text = bytes(letters[c] for c in piece[: -len(end)]).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if PRE_TOKEN.fullmatch(text) and not NOT_PLAIN.search(text):
            strings[text] = number
    found = tokenizer(path).encode_batch(list(strings), add_special_tokens=False)
    return frozenset(text for (text, number), made in zip(strings.items(), found, strict=True) if made.ids == [number])


class Counter(dict):
    """Tokens of a pre-token or of text between spaces; what is neither proved nor remembered is merged."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.path, self.whole, self.merged = path, whole, {}
        self.model = tokenizer(path)
        self.merges = self.model.model
        self.letters = {b: letter for letter, b in byte_letters().items()}

    def __missing__(self, chunk: str) -> int:
        whole = self.whole
        n = sum(1 if part in whole else self.merge(part) for part in PRE_TOKEN.findall(chunk))
        if len(self) < REMEMBERED:
            self[chunk] = n
        return n

    def merge(self, pre_token: str) -> int:
        n = self.merged.get(pre_token)
        if n is None:
            n = len(self.merges.tokenize("".join(map(self.letters.__getitem__, pre_token.encode()))))
            if len(self.merged) >= REMEMBERED:
                self.merged.clear()
            self.merged[pre_token] = n
        return n

    def count(self, text: str) -> int:
        if NOT_PLAIN.search(text):
            return len(self.model.encode(text, add_special_tokens=False).ids)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return sum(map(self.__getitem__, text.lower().split(" ")))


_counters: dict[str, Counter] = {}


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, path: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """The id (or ``keep``) with n_bytes, n_tokens and over_limit of every whole text."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary

    def make():
        if path not in _counters:  # a worker's next task goes on with what it remembers
            _counters[path] = Counter(path, whole.value)
        counter = _counters[path]

        def compute(texts):
            texts = [t or "" for t in texts.to_pylist()]
            tokens = [counter.count(t) for t in texts]
            return [
                pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                pa.array(tokens, pa.int64()),
                pa.array([n > limit for n in tokens], pa.bool_()),
            ]

        return compute

    return attach(docs, text_col, make, "n_bytes bigint, n_tokens bigint, over_limit boolean", keep=keep or [id_col])
