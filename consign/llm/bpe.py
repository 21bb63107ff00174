"""Byte-level BPE encoding and decoding by rank files (operator 4).

Two tiers.  A minimal perfect hash over the vocabulary resolves a whole
pre-token that is itself a token: one hash, one displacement, one comparison.
Other pre-tokens are merged from their bytes: the bytes form a linked list, a
heap holds the adjacent pairs that are tokens by rank (leftmost first among
equals), and a merge relinks its neighbours and pushes their new pairs.

Defined cases: a null or empty text has no ids and decodes to no bytes;
repeated rows and ids stay as they are; texts of any length are whole, a few MB of them in
memory at a time beyond one text; ranks that no token has are allowed, two ranks
of one token are an error; an empty table gives an empty result.
``encode`` returns the id column and ``ids`` alone, so other columns of the
input cannot clash.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import LONGEST_KEPT, WordEncoder, slices, text_slices

KEPT = 500_000  # pre-tokens whose ids a task remembers


def read_ranks(spark: SparkSession, path: str) -> list[bytes]:
    """The tokens of a rank file in rank order.  A vocabulary is a few MB whatever the data."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """A minimal perfect hash from the tokens to 0..n-1 by hash and displace.

    Keys fall into buckets; the fullest bucket first, each takes the smallest
    displacement that sends all its keys to free slots.  Buckets of one key
    name their slot directly.  An empty key is a rank that no token has, and takes no slot.
    """

    def __init__(self, keys: list[bytes]) -> None:
        used = [i for i, k in enumerate(keys) if k]
        if len({keys[i] for i in used}) < len(used):
            raise ValueError("a token has two ranks")
        self.n, self.m = len(used), max(1, len(used) // 3)
        n, m = self.n, self.m
        buckets: dict[int, list[int]] = {}
        hashes = {i: xxhash.xxh3_128_intdigest(keys[i]) for i in used}
        for i, h in hashes.items():
            buckets.setdefault(h % m, []).append(i)
        slot_key = [-1] * n
        self.shift = [0] * m
        free = 0
        for b, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(members) > 1:
                d = 1
                while True:
                    at = {self._slot(hashes[i], d) for i in members}
                    if len(at) == len(members) and all(slot_key[s] < 0 for s in at):
                        break
                    d += 1
                self.shift[b] = d
                for i in members:
                    slot_key[self._slot(hashes[i], d)] = i
            else:
                while slot_key[free] >= 0:
                    free += 1
                self.shift[b] = -free - 1
                slot_key[free] = members[0]
        self.slot_key = slot_key
        self.keys = keys

    def _slot(self, h: int, d: int) -> int:
        x = ((h >> 64) ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF  # another hash for each d, whatever n divides by
        x = (x * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x ^ x >> 32) % self.n

    def rank(self, key: bytes) -> int:
        """The key's rank, or -1 if it is no token."""
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[h % self.m]
        if not d:
            return -1
        r = self.slot_key[-d - 1 if d < 0 else self._slot(h, d)]
        return r if self.keys[r] == key else -1


def pair_ranks(table: PerfectHash) -> dict[int, int]:
    """left id << 20 | right id -> id, for every way to put a token together from two.  Its size is
    bounded by the vocabulary's bytes."""
    known = {k: i for i, k in enumerate(table.keys) if k}
    out = {}
    for key, r in known.items():
        for c in range(1, len(key)):
            a = known.get(key[:c])
            if a is not None and (b := known.get(key[c:])) is not None:
                out[a << 20 | b] = r
    return out


def merge(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """The ids of one pre-token from those of its bytes: lowest rank first, leftmost among equals.

    The parts are a linked list over their first bytes; a heap entry is rank << 32 | place,
    and is stale if the pair at the place has another rank by now.
    """
    n = len(ids)
    get = pairs.get
    heap = [r << 32 | i for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
    heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while heap:
        e = heappop(heap)
        i = e & 0xFFFFFFFF
        a, j = ids[i], after[i]
        if a < 0 or j >= n or get(a << 20 | ids[j]) != e >> 32:
            continue
        ids[i] = a = e >> 32
        ids[j] = -1
        after[i] = j = after[j]
        if j < n:
            before[j] = i
            if (r := get(a << 20 | ids[j])) is not None:
                heappush(heap, r << 32 | i)
        h = before[i]
        if h >= 0 and (r := get(ids[h] << 20 | a)) is not None:
            heappush(heap, r << 32 | h)
    return [x for x in ids if x >= 0]


class Encoder:
    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.table = PerfectHash(tokens)
        self.pairs = pair_ranks(self.table)
        self.byte = [self.table.rank(bytes([b])) for b in range(256)]
        self.pattern = regex.compile(pattern)
        self.merged: dict[str, list[int]] = {}  # ids of recent pre-tokens that are no tokens

    def text(self, text: str) -> list[int]:
        out: list[int] = []
        merged, rank = self.merged, self.table.rank
        for piece in self.pattern.findall(text):
            ids = merged.get(piece)
            if ids is not None:
                out += ids
                continue
            b = piece.encode()
            r = rank(b)
            if r >= 0:
                out.append(r)
                continue
            byte = self.byte
            ids = merge([byte[x] for x in b], self.pairs)
            out += ids
            if len(piece) <= LONGEST_KEPT:
                if len(merged) >= KEPT:
                    merged.clear()
                merged[piece] = ids
        return out

    def texts(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.text(t)).tobytes() for t in texts]


_ENCODERS: dict[Encoder, WordEncoder] = {}  # one for each worker process


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((Encoder(read_ranks(spark, ranks_path), pattern)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value not in _ENCODERS:
            _ENCODERS[shared.value] = WordEncoder(shared.value.texts, kept=150_000)
        words = _ENCODERS[shared.value]
        for b in text_slices(batches):
            ids, n = words(b.column(1))
            offsets = np.zeros(len(n) + 1, dtype=np.int32)
            np.cumsum(n, out=offsets[1:])
            ids = pa.ListArray.from_arrays(offsets, ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded binary): the bytes that the ids stand for."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for b in slices(batches):
            ids = b.column(1)
            at = ids.offsets.to_numpy()
            flat = ids.values.to_numpy()
            texts = [b"".join(map(token, flat[x:y].tolist())) for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(texts, pa.binary())], [id_col, "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, F.col("ids")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")
