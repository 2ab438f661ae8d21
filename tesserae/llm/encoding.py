"""Encoding of a corpus with a byte-level BPE vocabulary, in two tiers.

Whole pre-tokens that are in the vocabulary are found by a minimal perfect hash; every other one is merged with a
heap of candidate merges over a doubly linked list of bytes. A pre-token is encoded once a task and kept.

The hash holds only entries that merging would give back as one token, which is checked when it is built, so both
tiers agree. No special tokens: their strings are ordinary text.

Defined cases: null and empty texts have the empty list; blanks, emoji, invalid-looking and very long texts are
encoded whole; repeated rows and ids are encoded each; extra columns are not looked at.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import spread

VOCABULARY = "byte_bpe_50k.tiktoken"


def pattern() -> str:
    """The pattern that splits a text before the merges, as the vocabulary's package has it."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one pre-token, lowest rank first and then from the left."""
    n = len(word)
    if n == 1:
        return [ranks[word]]
    after = list(range(1, n + 1))  # the next part's beginning, n at the end
    before = list(range(-1, n - 1))
    end = list(range(1, n + 1))  # where the part that begins here ends; 0 when merged away
    heap = []
    for i in range(n - 1):
        if (r := ranks.get(word[i : i + 2])) is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, left, stop = heapq.heappop(heap)
        right = after[left]
        if not end[left] or right >= n or end[right] != stop or end[left] != right:
            continue
        end[left], end[right] = stop, 0
        after[left] = after[right]
        if after[left] < n:
            before[after[left]] = left
            nxt = after[left]
            if (r := ranks.get(word[left : end[nxt]])) is not None:
                heapq.heappush(heap, (r, left, end[nxt]))
        if before[left] >= 0:
            prev = before[left]
            if (r := ranks.get(word[prev:stop])) is not None:
                heapq.heappush(heap, (r, prev, stop))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : end[at]]])
        at = after[at]
    return ids


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys in n slots, one displacement a bucket; misses are told apart by the key itself."""

    def __init__(self, keys: list[bytes], values: list[int]) -> None:
        self.size = max(len(keys), 1)
        self.buckets = max(1, len(keys) // 3)
        self.shift = [0] * self.buckets
        self.keys: list[bytes] = [b""] * self.size
        self.values = [-1] * self.size
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, i))
        taken = np.zeros(self.size, bool)
        free = 0
        for bucket, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:  # the rest goes straight to free slots
                while taken[free]:
                    free += 1
                slots, d = [free], -free - 1
            else:
                d = 0
                while True:
                    d += 1
                    slots = [self._slot(h, d) for h, _ in members]
                    if len(set(slots)) == len(slots) and not taken[slots].any():
                        break
            self.shift[bucket] = d
            for slot, (_, i) in zip(slots, members, strict=True):
                taken[slot] = True
                self.keys[slot], self.values[slot] = keys[i], values[i]

    def _slot(self, h: int, d: int) -> int:
        return ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xC2B2AE3D27D4EB4F >> 17 & 0xFFFFFFFFFFFF) % self.size

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[slot] if self.keys[slot] == key else -1


class Encoder(dict):
    """Maps pre-tokens to their ids; what is missing is worked out and kept, up to a bound."""

    KEPT = 400_000

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks
        whole = [(k, r) for k, r in ranks.items() if merge(k, ranks) == [r]]
        self.table = PerfectHash([k for k, _ in whole], [r for _, r in whole])
        self.split = regex.compile(pattern()).findall

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "replace")
        known = self.table.get(raw)
        ids = (known,) if known >= 0 else tuple(merge(raw, self.ranks))
        if len(word) <= 24 and len(self) < self.KEPT:
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(read_ranks(path))
    return _ENCODERS[path]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids of every row. Narrow: no shuffle beyond spreading a small scan."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = own or encoder(path)
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), 1000):  # whole texts, a bounded number at a time
                ids = pa.array([own.encode(t) for t in texts[at : at + 1000]], pa.list_(pa.int32()))
                yield pa.record_batch([keys.slice(at, len(ids)), ids], ["doc_id", "ids"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, ids array<int>")
