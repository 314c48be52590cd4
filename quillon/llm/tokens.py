"""Byte-level BPE encoding of a corpus with a public vocabulary.

Texts are split into words by the vocabulary's pattern and every word is merged by rank: a priority queue holds the
ranks of adjacent symbol pairs over a doubly linked list of symbols, and entries whose symbols have since merged are
skipped when they surface. Words repeat, so each Python worker keeps the ids of words that it has met.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public vocabulary's word pattern: a fixed value, ids depend on it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept per worker and bytes of a word that is kept; the memory of a worker stays bounded.
CACHE_WORDS, CACHE_BYTES = 400_000, 64


def read_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word. Bytes missing from the vocabulary can't occur: it holds all 256."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    piece: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    queue = [(rank, i, 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, left, length = heapq.heappop(queue)
        right = after[left]
        # Stale: the left symbol was absorbed, or either symbol grew since the entry was made.
        if piece[left] is None or right >= n or len(piece[left]) + len(piece[right]) != length:
            continue
        piece[left] += piece[right]
        piece[right] = None
        after[left] = end = after[right]
        if end < n:
            before[end] = left
            pair = piece[left] + piece[end]
            if (rank := ranks.get(pair)) is not None:
                heapq.heappush(queue, (rank, left, len(pair)))
        if (start := before[left]) >= 0:
            pair = piece[start] + piece[left]
            if (rank := ranks.get(pair)) is not None:
                heapq.heappush(queue, (rank, start, len(pair)))
    return [ranks[p] for p in piece if p is not None]


class _Words(dict):
    """Word to ids, filled on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        ids = merge(raw, self.ranks)
        if len(raw) <= CACHE_BYTES and len(self) < CACHE_WORDS:
            self[word] = ids
        return ids


class Encoder:
    """Texts to ids and back for one vocabulary file."""

    def __init__(self, path: str = VOCABULARY):
        import regex

        self.ranks = read_vocabulary(path)
        self.words = _Words(self.ranks)
        self.split = regex.compile(PATTERN).findall

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or null one. Strings of special tokens are ordinary text."""
        return list(chain.from_iterable(map(self.words.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.words.__getitem__, self.split(text)))) if text else 0

    @property
    def pieces(self) -> dict[int, bytes]:
        return {rank: token for token, rank in self.ranks.items()}

    def decode(self, ids: list[int]) -> str:
        pieces = self.pieces
        return b"".join(pieces[i] for i in ids).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker; workers are reused between tasks."""
    return Encoder(path)


def encode(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row, in one narrow pass over Arrow batches.

    An empty or null text has the empty list, never null; repeated and null keys stay as they are; no text is cut.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 1000):
                lists = [enc.encode(t) for t in texts.slice(at, 1000).to_pylist()]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([keys.slice(at, 1000), ids], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str, path: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """``df`` without ``text``, with its number of tokens; 0 for an empty or null text."""
    keep = [c for c in df.columns if c != text]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{name}` int"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            counts = pa.array([enc.count(t) for t in batch.column(len(keep)).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], counts], [*keep, name])

    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, key: str, ids: str, path: str = VOCABULARY) -> DataFrame:
    """(key, text) by concatenating the vocabulary's strings; the empty list is the empty text, null stays null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pieces = encoder(path).pieces
        for batch in batches:
            texts = [None if x is None else b"".join(pieces[i] for i in x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def blank(c: Column) -> Column:
    """Whether a text has nothing to encode."""
    return c.isNull() | (c == F.lit(""))
