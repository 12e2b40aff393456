"""Byte-level BPE of a whole corpus with a public vocabulary.

A text is cut into pre-tokens by the vocabulary's pattern; each distinct pre-token is encoded once
per worker and kept. A pre-token that isn't a token itself is merged with a rank queue: the byte
positions form a linked list, each merge rank has a bucket of the positions whose pair has that
rank, and a hierarchical bitmap (three levels of 64-bit words over all ranks) gives the lowest rank
in use by find-first-set. A bucket is taken whole and from left to right; entries whose pair has
changed meanwhile are stale and skipped. Every pair is entered once when it arises, so a pre-token
of n bytes takes O(n log n) whatever its length.

Defined results
* null and empty texts: an empty list of ids; blank texts are encoded like any other
* strings that look like special tokens are ordinary text
* every row gives one row, repeated ids and texts included
"""

from __future__ import annotations

import array
import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sixline.llm.spread import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts a text into pre-tokens before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker keeps; beyond it, it starts anew.
KEPT = 400_000


def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to rank, of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Positions by merge rank: buckets, and a bitmap of three levels that tells which are filled."""

    __slots__ = ("buckets", "low", "middle", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.middle: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word, block = rank >> 6, rank >> 12
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.middle[block] = self.middle.get(block, 0) | 1 << (word & 63)
        self.top |= 1 << block

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank in use with all its positions from left to right; None when empty."""
        if not self.top:
            return None
        block = (self.top & -self.top).bit_length() - 1
        bits = self.middle[block]
        word = block << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        self.low[word] = bits & bits - 1
        if not self.low[word]:
            self.middle[block] &= ~(1 << (word & 63))
            if not self.middle[block]:
                self.top &= ~(1 << block)
        return rank, sorted(self.buckets.pop(rank))


class Encoder:
    """Encodes texts by one vocabulary, keeping the ids of pre-tokens seen."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN) -> None:
        import regex

        self.ranks = ranks(path)
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.kept: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        known = self.ranks
        whole = known.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        if n == 0:
            return ()
        end = list(range(1, n + 2))  # a node is named by the byte at which it begins
        before = list(range(-1, n))
        alive = bytearray(b"\1" * n)
        queue = RankQueue()
        for i in range(n - 1):
            rank = known.get(piece[i : i + 2])
            if rank is not None:
                queue.push(rank, i)
        while (taken := queue.pop()) is not None:
            rank, positions = taken
            for i in positions:
                if not alive[i]:
                    continue
                j = end[i]
                if j >= n or known.get(piece[i : end[j]]) != rank:
                    continue  # stale
                alive[j] = 0
                k = end[i] = end[j]
                if k < n:
                    before[k] = i
                    found = known.get(piece[i : end[k]])
                    if found is not None:
                        queue.push(found, i)
                h = before[i]
                if h >= 0:
                    found = known.get(piece[h:k])
                    if found is not None:
                        queue.push(found, h)
        out, i = [], 0
        while i < n:
            out.append(known[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without special tokens."""
        kept, out = self.kept, []
        for word in self.split(text):
            ids = kept.get(word)
            if ids is None:
                ids = self.merge(word.encode("utf-8"))
                if len(word) <= 64:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[word] = ids
            out += ids
        return out


def encode(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row of ``df``."""
    source = spread(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_key")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            values, offsets = array.array("i"), array.array("i", [0])
            for text in batch.column(1):
                s = text.as_py()
                if s:
                    values.extend(encoder.encode(s))
                offsets.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["_key", "ids"])

    return source.mapInArrow(run, f"_key {kind}, ids array<int>").select(F.col("_key").alias(key), "ids")
