"""Token-ID files in Simple-8b coding (operator 8).

A file holds segments; a segment holds the ids of some consecutive documents:

    magic "S8B1" | n_docs, n_ids, n_blocks, n_words, n_escapes (5 x uint32)
    doc ids (int64) | doc id present (uint8) | ids of each document (int64)
    first word of each block and the end (uint32) | words (uint64) | escapes (uint64)

A word is 64-bit: the low four bits select how many ids the other sixty hold and
how many bits each has (``COUNTS``, ``BITS``).  Ids that need sixty bits or more
are written as the largest sixty-bit number and kept in order among the
escapes.  Packing starts anew every ``BLOCK`` ids, so a block decodes on its
own from its first word; decoding is vectorised, one pass for each selector.

Segments are binary values of Parquet files that Spark commits, so they can be
kept in any store Spark writes to and a lost task leaves nothing behind.  Files
follow ascending document ids: ``shard`` numbers them, ``segment`` numbers what
is inside, ``first`` counts the shard's ids before a segment.

Defined cases: a null or empty text holds the end id alone; null document ids
come first; rows that share an id keep one order (by text); an empty table gives
empty files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import by_row, library_encoder, slices, text_slices

# The selectors of Simple-8b.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024
ESCAPE = (1 << 60) - 1
MAGIC = b"S8B1"
SEGMENT_IDS = 1 << 18


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """uint64 values -> (first word of each block and the end, words, escapes)."""
    v = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(v)
    wide = v >= ESCAPE
    escapes = v[wide]
    v = np.where(wide, np.uint64(ESCAPE), v)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(1, dtype=np.uint32), v, escapes
    # Rows of one block each; past its end a block goes on with zeros, which always fit.
    widest, wide_row = int(v.max()), BLOCK + int(COUNTS[0])
    grid = np.zeros((blocks, wide_row), dtype=np.uint32 if widest < 1 << 32 else np.uint64)
    full = n // BLOCK
    grid[:full, :BLOCK] = v[:full * BLOCK].reshape(full, BLOCK)
    if full < blocks:
        grid[full, :n - full * BLOCK] = v[full * BLOCK:]
    # The bits of each value (of very large ones one too many, at most), and the most bits among the
    # next c values for one count c after the other, each from the one before.
    bits = np.minimum(np.frexp(grid.astype(np.float64))[1], 60).astype(np.uint8)
    selector, most, c = np.full((blocks, BLOCK), 15, dtype=np.int8), bits, 1
    for s in range(14, -1, -1):
        shift, c = int(COUNTS[s]) - c, int(COUNTS[s])
        most = np.maximum(most[:, :-shift], most[:, shift:])
        fits = most[:, :BLOCK] <= BITS[s].astype(np.uint8)
        if not fits.any():
            break
        np.copyto(selector, np.int8(s), where=fits)
    # All blocks advance together, a word each at a time.
    step = COUNTS[selector].astype(np.int32)
    size = np.full(blocks, BLOCK, dtype=np.int32)
    size[-1] = n - (blocks - 1) * BLOCK
    live, at = np.arange(blocks, dtype=np.int32), np.zeros(blocks, dtype=np.int32)
    of, starts = [], []
    while len(live):
        of.append(live)
        starts.append(at)
        at = at + step[live, at]
        on = at < size[live]
        live, at = live[on], at[on]
    of, at = np.concatenate(of), np.concatenate(starts)
    order = np.lexsort((at, of))
    of, at = of[order], at[order]
    first = np.zeros(blocks + 1, dtype=np.uint32)
    np.cumsum(np.bincount(of, minlength=blocks), out=first[1:])
    chosen = selector[of, at]
    words = chosen.astype(np.uint64)
    flat, place = grid.reshape(-1), of.astype(np.int64) * wide_row + at
    for s in np.unique(chosen):
        if BITS[s]:
            rows = np.flatnonzero(chosen == s)
            start, word = place[rows], np.full(len(rows), s, dtype=np.uint64)
            for k in range(COUNTS[s]):
                word |= flat[start + k].astype(np.uint64) << np.uint64(4 + k * BITS[s])
            words[rows] = word
    return first, words, escapes


def unpack(first: np.ndarray, words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of ``pack``."""
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    s = (words & np.uint64(15)).astype(np.int64)
    counts = COUNTS[s]
    block = np.repeat(np.arange(len(first) - 1), np.diff(first.astype(np.int64)))
    before = np.cumsum(counts) - counts
    at = before - before[first[:-1].astype(np.int64)][block] + block * BLOCK
    stop = np.minimum((block + 1) * BLOCK, n)
    for k in np.unique(s):
        rows = np.flatnonzero(s == k)
        if BITS[k]:
            mask = np.uint64((1 << int(BITS[k])) - 1)
            for j in range(COUNTS[k]):
                i = at[rows] + j
                ok = i < stop[rows]
                out[i[ok]] = (words[rows][ok] >> np.uint64(4 + j * BITS[k])) & mask
    if len(escapes):
        out[out == ESCAPE] = escapes
    return out


def segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    first, words, escapes = pack(ids)
    head = struct.pack("<5I", len(doc_ids), len(ids), len(first) - 1, len(words), len(escapes))
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    return b"".join([MAGIC, head, np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), known.tobytes(),
                     np.array(lengths, dtype="<i8").tobytes(), first.astype("<u4").tobytes(),
                     words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids of each document, all ids)."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    docs, n, blocks, n_words, n_escapes = struct.unpack_from("<5I", data, 4)
    at = 24

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        a = np.frombuffer(data, dtype=kind, count=count, offset=at)
        at += a.nbytes
        return a

    doc_ids, known, lengths = take("<i8", docs), take("u1", docs), take("<i8", docs)
    first, words, escapes = take("<u4", blocks + 1), take("<u8", n_words), take("<u8", n_escapes)
    return ([int(d) if k else None for d, k in zip(doc_ids, known)], lengths, unpack(first, words, escapes, n))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id",
                      text_col: str = "text") -> None:
    """Encode every text, append ``end_id``, and write the ids in ascending document order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = library_encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        doc_ids: list = []
        held: list[bytes] = []
        number = first = size = 0

        def out() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            row = {"shard": [shard], "segment": [number], "first": [first], "n_ids": [len(ids)],
                   "payload": [segment(doc_ids, [len(x) // 4 for x in held], ids)]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("segment", pa.int32()),
                                                              ("first", pa.int64()), ("n_ids", pa.int64()),
                                                              ("payload", pa.binary())]))

        for b in text_slices(batches):
            doc_ids += b.column(0).to_pylist()
            held += [x + end for x in by_row(*encoder(b.column(1)))]
            size = sum(map(len, held)) // 4
            if size >= SEGMENT_IDS:
                yield out()
                number, first = number + 1, first + size
                doc_ids, held = [], []
        if held:
            yield out()

    (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
     .repartitionByRange("id").sortWithinPartitions("id", "text")
     .mapInArrow(run, "shard int, segment int, first long, n_ids long, payload binary")
     .write.parquet(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) from the files; start counts all ids before."""
    stored = spark.read.schema("shard int, segment int, first long, n_ids long, payload binary").parquet(path)
    # One row for each file: as many as there were shuffle partitions, whatever the number of documents.
    shards = stored.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("ahead"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            doc_ids, lengths, ids = read_segment(b.column(1)[0].as_py())
            stop = np.cumsum(lengths)
            raw = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(b.column(0)[0].as_py() + stop - lengths, pa.int64()),
                 pa.array(lengths, pa.int64()),
                 pa.array([raw[e - n:e].tobytes() for n, e in zip(lengths, stop)], pa.binary())],
                ["doc_id", "start", "n_tokens", "ids"])

    return (stored.join(F.broadcast(shards), "shard").select((F.col("first") + F.col("ahead")).alias("start"), "payload")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary"))
