"""Encoding of texts with a byte-level BPE vocabulary (problem 7).

Two tiers: a minimal perfect hash resolves a whole pre-token that is itself in the vocabulary; any other pre-token is
merged with a heap over linked bytes, whose many lookups of pairs go to a dict of the same ranks, which is faster in Python;
so the hash is the method's first tier, not a saving of memory. The vocabulary file must be at its path on every executor. Results are kept in a bounded table of the worker process, so a word costs its
merges once and a dictionary lookup after that.

Defined cases: null and empty texts give the empty list; strings that look like special tokens are ordinary text; a
pre-token of any length is merged in O(n log n). Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Words a worker keeps; beyond that the table starts anew, so its memory is bounded for any corpus.
MEMO_WORDS = 1_000_000


class PerfectHash:
    """Minimal perfect hash over byte strings: level after level, keys alone in their slot stay, the others go on.

    ``find(key)`` is the rank of the key's slot among all slots taken, or -1; the key stored at that rank is compared, so
    strings outside the set are always told apart.
    """

    def __init__(self, keys: list[bytes], gamma: float = 2.0):
        self.sizes: list[int] = []
        self.taken: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        placed: list[np.ndarray] = []
        left, total, level = np.arange(len(keys)), 0, 0
        while len(left):
            size = max(1, int(gamma * len(left)))
            slot = np.fromiter((xxhash.xxh3_64_intdigest(keys[i], level) % size for i in left), np.int64, len(left))
            taken = np.bincount(slot, minlength=size) == 1
            alone = taken[slot]
            self.sizes.append(size)
            self.taken.append(taken)
            self.before.append(np.cumsum(taken) - 1 + total)
            placed.append(left[alone][np.argsort(slot[alone])])
            total += int(taken.sum())
            left, level = left[~alone], level + 1
        self.order = np.concatenate(placed) if placed else np.zeros(0, np.int64)
        self.keys = [keys[i] for i in self.order]

    def find(self, key: bytes) -> int:
        for level, size in enumerate(self.sizes):
            slot = xxhash.xxh3_64_intdigest(key, level) % size
            if self.taken[level][slot]:
                at = int(self.before[level][slot])
                return at if self.keys[at] == key else -1
        return -1


class Encoder(dict):
    """Pre-token -> tuple of ids, filled on demand."""

    def __init__(self, vocabulary: str):
        super().__init__()
        import regex

        with open(vocabulary, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.split = regex.compile(PATTERN).findall
        self.hash = PerfectHash(list(self.ranks))
        self.ids = [self.ranks[k] for k in self.hash.keys]

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMO_WORDS:
            self.clear()
        raw = word.encode()
        at = self.hash.find(raw)
        found = (self.ids[at],) if at >= 0 else self.merge(raw)
        if len(raw) <= 256:
            self[word] = found
        return found

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """The merges of the rank file, lowest rank first and leftmost among equals, over doubly linked parts."""
        ranks, n = self.ranks, len(raw)
        end = list(range(1, n + 1))  # end of the part that begins at i; 0 once merged away
        back = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of its parts has been merged since
            end[i], end[middle] = stop, 0
            if stop < n:
                back[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (j := back[i]) >= 0 and (r := ranks.get(raw[j:stop])) is not None:
                heapq.heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text)))) if text else []


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of this process, built once for each vocabulary file."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def _encode_batches(vocabulary: str, lengths_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 512):  # bounded ids in memory at a time
                part = [own.encode(t) for t in texts.slice(lo, 512).to_pylist()]
                sizes = np.fromiter(map(len, part), np.int32, len(part))
                if lengths_only:
                    column = pa.array(sizes)
                else:
                    flat = np.fromiter(chain.from_iterable(part), np.int32, int(sizes.sum()))
                    column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([keys.slice(lo, 512), column], names=["key", "out"])

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>), one row for each row of ``docs``; no shuffle, only the two columns are read."""
    kind = docs.schema[key].dataType.simpleString()
    done = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_encode_batches(vocabulary, False), f"key {kind}, out array<int>")
    return done.select(F.col("key").alias(key), F.col("out").alias("ids"))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens int) without moving the ids out of the worker."""
    kind = docs.schema[key].dataType.simpleString()
    done = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_encode_batches(vocabulary, True), f"key {kind}, out int")
    return done.select(F.col("key").alias(key), F.col("out").alias("n_tokens"))
