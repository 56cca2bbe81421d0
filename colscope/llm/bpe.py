"""Byte-level BPE with a given vocabulary of ranks, encoded in linear time, and decoded again.

Bytes are mapped to Latin-1 characters, so that one automaton over all tokens finds the longest token
that starts at a place of a word. The encoder takes these longest tokens from left to right, falls back to the next shorter prefix where two neighbours are not *compatible*, and goes
back one token where none fits; places that were given up are never tried again. Two neighbours are
compatible if merging their joined bytes by rank gives just these two tokens. A row of tokens whose
neighbours are all compatible is unique, hence it is the one the merges would give. Compatibility is
found by undoing the merges on both sides of the seam, latest first, and is memoised.

Defined cases: null text is empty and has no tokens; bytes that are no UTF-8 are read as U+FFFD; texts
of any length are read in runs of words, never as prefixes; other columns are ignored; repeated rows
and null ids are returned as they come.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from colscope.llm.common import decoded, id_and_text, map_rows

#: Memoised words and neighbour pairs, at most; the tables start anew when they are full.
MEMO_WORDS, MEMO_PAIRS = 200_000, 200_000
#: Longer words are not memoised. Words are read in runs of so many.
MEMO_LENGTH, RUN = 40, 50_000


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks from a file with one base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Codec:
    """Encodes and decodes words by the ranks of their tokens. Every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.words = regex.compile(pattern)
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.reach = max(self.size.values())
        self.packed = {rank: rank.to_bytes(4, "little") for rank in self.token}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.memo_pairs: dict[tuple[int, int], bool] = {}
        self.shorter = {rank: self._shorter(token) for token, rank in ranks.items()}
        self.latin: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if len(token) == 1 or self._split(token, rank):
                self.latin[token.decode("latin-1")] = rank
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.memo = _Words(self)

    def _shorter(self, token: bytes) -> int | None:
        """The longest token that is a proper prefix."""
        return next((self.ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ranks), None)

    def _split(self, token: bytes, rank: int) -> bool:
        """Find the last merge that makes a token; false if merges never make it."""
        left = self.shorter[rank]
        while left is not None:
            right = self.ranks.get(token[len(self.token[left]) :])
            if right is not None and self._order(left) < rank and self._order(right) < rank and self.compatible(left, right):
                self.parts[rank] = left, right
                self.joined[left, right] = rank
                return True
            left = self.shorter[left]
        return False

    def _order(self, token: int) -> int:
        """When merges make a token: single bytes are there before all merges."""
        return -1 if len(self.token[token]) == 1 else token

    def compatible(self, left: int, right: int) -> bool:
        """Whether merges keep these neighbours apart."""
        before = None
        while True:
            merged = self.joined.get((left, right))
            if merged is not None and (before is None or merged < before):
                return False
            # Of equal merges the leftmost comes first, so the right one is the later one.
            if left in self.parts and (right not in self.parts or left > right):
                before, left = left, self.parts[left][1]
            elif right in self.parts:
                before, right = right + 1, self.parts[right][0]
            else:
                return True

    def _compatible(self, left: int, right: int) -> bool:
        known = self.memo_pairs.get((left, right))
        if known is None:
            if len(self.memo_pairs) >= MEMO_PAIRS:
                self.memo_pairs.clear()
            known = self.memo_pairs[left, right] = self.compatible(left, right)
        return known

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one word."""
        if not word.isascii():
            word = word.encode("utf-8").decode("latin-1")
        known, size, reach, prefix = self.latin, self.size, self.reach, self.automaton.longest_prefix
        if word in known:
            return [known[word]]
        given_up: set[int] = set()
        found: list[int] = []
        at, end = 0, len(word)
        while at < end:
            length = prefix(word[at : at + reach])
            while (candidate := known.get(word[at : at + length])) is None:
                length -= 1
            while True:
                if candidate is None:  # nothing fits here: shorten the token before
                    given_up.add(at)
                    candidate = found.pop()
                    at -= size[candidate]
                elif at + size[candidate] not in given_up and (not found or self._compatible(found[-1], candidate)):
                    found.append(candidate)
                    at += size[candidate]
                    break
                candidate = self.shorter[candidate]
        return found

    def encode_runs(self, text: str) -> Iterator[bytes]:
        """Packed tokens of a text, four little-endian bytes each, run by run."""
        words = (m[0] for m in self.words.finditer(text)) if len(text) > 20 * RUN else self.words.findall(text)
        words = iter(words)
        while run := list(itertools.islice(words, RUN)):
            yield b"".join(map(self.memo.__getitem__, run))

    def encode(self, text: str) -> bytes:
        return b"".join(self.encode_runs(text))

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed tokens."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(packed, "<u4").tolist()))


class _Words(dict):
    """Packed tokens by word, filled on demand and bounded."""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        packed = b"".join(map(self.codec.packed.__getitem__, self.codec.encode_word(word)))
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = packed
        return packed


_CODECS: dict[tuple[bytes, str], Codec] = {}


def codec_of(content: bytes, pattern: str) -> Codec:
    """The codec of a vocabulary file's content, built once in a process."""
    key = hashlib.sha256(content).digest(), pattern
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(read_ranks(content), pattern)
    return _CODECS[key]


def _rows(path: str, docs: DataFrame):
    with open(path, "rb") as file:  # a vocabulary file: a few MB at most
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded`` for each row: packed token ids, and the bytes they decode to.

    ``path`` names a file of base64 tokens with ranks, ``pattern`` cuts a text into words.
    """
    content = _rows(path, docs)

    def rows(batch: dict) -> Iterable[tuple]:
        codec = codec_of(content.value, pattern)
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            ids = codec.encode(decoded(text))
            yield doc_id, ids, codec.decode(ids)

    return map_rows(id_and_text(docs), "doc_id long, ids binary, decoded binary", rows)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id, decoded`` from packed ``ids``; null ids decode to no bytes."""
    content = _rows(path, tokens)

    def rows(batch: dict) -> Iterable[tuple]:
        token = _token_bytes(content.value)
        for doc_id, ids in zip(batch["doc_id"], batch["ids"]):
            yield doc_id, b"".join(map(token.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))

    return map_rows(tokens.selectExpr("CAST(doc_id AS LONG) AS doc_id", "ids"), "doc_id long, decoded binary", rows)


@functools.lru_cache(maxsize=1)
def _token_bytes(content: bytes) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(content).items()}
