"""Order-preserving packing by dynamic programming (operator 5).

The documents of a partition, in their stored order, form one stream of ids, cut
into sequences of at most ``length`` ids.  A cut is allowed after every
document, after every sentence, and, where neither comes for ``length / 4`` ids,
inside a sentence.  The cuts minimise

    padding + SEQUENCE for each sequence + SENTENCE or INSIDE for a cut that
    splits a document after or inside a sentence,

all in ids.  A sequence of k ids is padded to ``length``, except where k is a power of
two.  With p the position of a cut, the best sequence that ends at p_j and is
padded costs min(cost_i + p_i) + length - p_j over p_j - length <= p_i < p_j: a
window minimum, kept in a monotone queue.  Powers of two add a transition for
each i with p_j - p_i a power of two.

The stream is solved in stretches of about ``STRETCH`` ids, so a task holds one
stretch and the document that crosses its end.  Order within a task is the
table's own; ``sequence_id`` is the partition number and a count, so that a task
that is run again gives the same rows.

Defined cases: a null or empty text is its end id alone; null ids and repeated
rows are packed like any other; an empty table gives no pieces; other columns
are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import by_row, library_encoder, text_slices

STRETCH = 1 << 20
SEQUENCE, SENTENCE, INSIDE = 4, 12, 64
_ENDS: dict[str, np.ndarray] = {}


def sentence_ends(tokenizer: str) -> np.ndarray:
    """For each id, whether a sentence may end with it: it ends in . ! ? or holds a line end."""
    if tokenizer not in _ENDS:
        from tokenizers import Tokenizer

        vocab = Tokenizer.from_file(tokenizer).get_vocab()
        out = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            out[i] = token[-1:] in (".", "!", "?") or "Ċ" in token  # the line end in byte-level tokens
        _ENDS[tokenizer] = out
    return _ENDS[tokenizer]


def best_cuts(at: np.ndarray, penalty: np.ndarray, length: int) -> np.ndarray:
    """Positions of the cheapest cuts, from at[0] = 0 to at[-1]; ``penalty`` is what a cut there costs.

    Neighbouring positions are at most ``length`` apart.
    """
    n = len(at)
    where = np.full(int(at[-1]) + 1, -1, dtype=np.int32)
    where[at] = np.arange(n)
    hits = []
    for k in (1 << t for t in range(length.bit_length())):
        i = where[np.maximum(at - k, 0)]
        j = np.flatnonzero((i >= 0) & (at >= k))
        hits.append((j, i[j]))
    exact: dict[int, list[int]] = {}
    for j, i in hits:
        for b, a in zip(j.tolist(), i.tolist()):
            exact.setdefault(b, []).append(a)
    none: list[int] = []
    p, pen = at.tolist(), penalty.tolist()
    cost, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        while p[j] - p[queue[0][1]] > length:
            queue.popleft()
        low, i = queue[0]
        best = low + length - p[j]
        for e in exact.get(j, none):
            if cost[e] < best:
                best, i = cost[e], e
        cost[j] = best = best + SEQUENCE + pen[j]
        back[j] = i
        key = best + p[j]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [p[-1]], n - 1
    while j:
        j = back[j]
        out.append(p[j])
    return np.array(out[::-1], dtype=np.int64)


def cut_points(ids: np.ndarray, stops: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut and what a cut there costs; ``stops``: where documents end."""
    kind = np.zeros(len(ids) + 1, dtype=np.int8)
    kind[np.flatnonzero(ends[ids]) + 1] = 1
    kind[stops] = 2
    kind[0] = 2
    at = np.flatnonzero(kind)
    step = max(1, length // 4)
    wide = np.flatnonzero(np.diff(at) > step)
    for i in wide.tolist():
        kind[np.arange(at[i] + step, at[i + 1], step)] = 3
    at = np.flatnonzero(kind)
    return at, np.array([0, SENTENCE, 0, INSIDE])[kind[at]]


def pieces(ids: np.ndarray, stops: np.ndarray, ends: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The pieces of one stretch: doc (its number), begin, stop, seq, offset."""
    cuts = best_cuts(*cut_points(ids, stops, ends, length), length)
    edges = np.union1d(cuts, stops)
    begin, stop = edges[:-1] if edges[0] == 0 else np.r_[0, edges[:-1]], edges[1:] if edges[0] == 0 else edges
    seq = np.searchsorted(cuts, begin, side="right") - 1
    return {"doc": np.searchsorted(stops, begin, side="right"), "begin": begin, "stop": stop, "seq": seq,
            "offset": begin - cuts[seq]}


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ends = library_encoder(tokenizer), sentence_ends(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        number = TaskContext.get().partitionId() << 32
        doc_ids: list = []
        held: list[bytes] = []
        size = 0

        def solved(id_type: pa.DataType) -> pa.RecordBatch:
            nonlocal number
            raw = b"".join(held)
            n = np.array([len(x) // 4 for x in held])
            stops = np.cumsum(n)
            x = pieces(np.frombuffer(raw, dtype="<u4"), stops, ends, length)
            row = pa.array([doc_ids[i] for i in x["doc"].tolist()], id_type)
            cols = [row, x["begin"] - (stops - n)[x["doc"]], x["stop"] - x["begin"], n[x["doc"]], x["seq"] + number,
                    x["offset"], pa.array([raw[4 * a:4 * b] for a, b in zip(x["begin"].tolist(), x["stop"].tolist())],
                                          pa.binary())]
            number += int(x["seq"][-1]) + 1
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols],
                                              [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        id_type = None
        for b in text_slices(batches):
            id_type = b.column(0).type
            for d, x in zip(b.column(0).to_pylist(), by_row(*encoder(b.column(1)))):
                doc_ids.append(d)
                held.append(x + end)
                size += len(x) // 4 + 1
                if size >= STRETCH:
                    yield solved(id_type)
                    doc_ids, held, size = [], [], 0
        if held:
            yield solved(id_type)

    return docs.select(id_col, F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
