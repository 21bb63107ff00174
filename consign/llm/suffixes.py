"""Suffix-array dedup with sparse suffix arrays (operator 7).

Finds every word that lies in a passage of at least ``size`` words which occurs
elsewhere too, in the same text or another.

Of all suffixes (of a text, at a word) only those at content-selected minimisers are
retained: the anchors of ``repeats``, one at least in every ``size`` words, at the same
place in every copy.  Suffixes that agree in all the words that their anchor's windows
cover are one entry with a count, so copies of one passage, however many, are one
entry; an entry that is there several times is repeated throughout.

The others are sorted by the words that follow their place and compared with their neighbours in
that order, ``NEAR`` before and after: the common beginning is measured word by word, then
the match is extended to the left by the words before, and every window of ``size`` words that lies
in the match is repeated.  Common beginnings never grow with the distance in the array, so an
entry is done when a neighbour's is too short for any window of it, or its first ``gram`` words end.

Only entries with the same first ``gram`` words can match; the array is dealt out by them,
``LARGE`` entries of one beginning at most.  Beginnings with more entries, and those of an entry that
was not done after ``NEAR`` neighbours, have their windows listed and grouped one by one
instead (each a key of its own), so a very common phrase is neither gathered in one task nor cut off.

Defined cases: as in ``doubling``; the result has the id and its own columns; a text of any length is
whole, with a few arrays of a number a word in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, scratch_table, ship_package
from .repeats import anchor_table, covered, enumerated, release, split_words, text_key, with_spans
from .tokens import slices

NEAR, LARGE = 16, 256
BUFFER = 16_384  # entries compared at a time
SUFFIX = "g long, right binary, left binary, single boolean, k long, len int, p int, i1 int, i2 int"


def suffixes(docs: DataFrame, each: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """The entries in ``each`` (k, len, anchors) with the words from their place on (``right``) and those before it,
    last word first (``left``), as far as their windows reach; eight bytes a word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            row, right, left, cols = [], [], [], {c: [] for c in ("g", "single", "p", "i1", "i2")}
            for r, (t, found) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                words = split_words(t)
                n, h = len(words), np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=">u8", count=len(words))
                ahead, back = h.tobytes(), h[::-1].tobytes()
                for a in found:
                    right.append(ahead[8 * a["p"]:8 * (a["i2"] + size)])
                    left.append(back[8 * (n - a["p"]):8 * (n - a["i1"])])
                    for c, values in cols.items():
                        values.append(a[c])
                row += [r] * len(found)
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols["g"], pa.int64()), pa.array(right, pa.binary()), pa.array(left, pa.binary()),
                 pa.array(cols["single"], pa.bool_()), b.column(0).take(at), b.column(1).take(at),
                 *[pa.array(cols[c], pa.int32()) for c in ("p", "i1", "i2")]],
                ["g", "right", "left", "single", "k", "len", "p", "i1", "i2"])

    texts = docs.filter(F.col(text_col).isNotNull()).select(*text_key(text_col), F.col(text_col).alias("text"))
    texts = texts.join(each, ["k", "len"]).dropDuplicates(["k", "len"])  # a copy of a text is the same entry
    return texts.select("k", "len", "text", "anchors").mapInArrow(run, SUFFIX)


def matrix(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(words as rows of ``width`` numbers, zeros after the last; how many each has)."""
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset:col.offset + len(col) + 1]
    n = np.diff(offsets) // 8
    out = np.zeros((len(col), width), dtype=np.uint64)
    if col.buffers()[2] is not None:
        out[np.arange(width) < n[:, None]] = np.frombuffer(col.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]].view(np.uint64)
    return out, n


def common(m: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words the rows i and j begin with alike."""
    if not m.shape[1]:
        return np.zeros(len(i), dtype=np.int64)
    differ = m[i] != m[j]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return np.minimum(first, np.minimum(n[i], n[j]))


def neighbours(t: pa.Table, size: int, gram: int, near: int = NEAR) -> Iterator[dict[str, np.ndarray]]:
    """Matches of the array's entries, whole beginnings of them in its order: g, k, len, i1, i2 (repeated windows'
    starts) of an entry, or open: its beginning's entries have to be compared window by window."""
    t = t.combine_chunks()
    col = {c: t.column(c).chunk(0).to_numpy(zero_copy_only=False) for c in ("g", "single", "k", "len", "p", "i1", "i2")}
    right, r = matrix(t.column("right").chunk(0), size)
    left, a = matrix(t.column("left").chunk(0), size - gram)
    g, p = col["g"], col["p"].astype(np.int64)
    whole = ~col["single"].astype(bool)
    is_open = np.zeros(len(g), dtype=bool)
    for d in range(1, near + 1):
        i = np.flatnonzero(g[:-d] == g[d:])
        if not len(i):
            break
        j = i + d
        after, before = common(right, r, i, j), common(left, a, i, j)
        for own in (i, j):
            # A window that begins o words before the place has size - o after it.
            i1, i2 = np.maximum(p[own] - before, col["i1"][own]), np.minimum(p[own] - (size - after), col["i2"][own])
            hit = (i1 <= i2) & col["single"][own]
            if hit.any():
                own_hit = own[hit]
                yield {"g": g[own_hit], "k": col["k"][own_hit], "len": col["len"][own_hit], "i1": i1[hit].astype(np.int32),
                       "i2": i2[hit].astype(np.int32), "open": np.zeros(len(own_hit), dtype=bool)}
                whole[own_hit[(i1[hit] == col["i1"][own_hit]) & (i2[hit] == col["i2"][own_hit])]] = True
            if d == near:
                is_open[own[after >= size - a[own]]] = True
    at = np.flatnonzero(is_open & ~whole)
    if len(at):
        yield {c: col[c][at] for c in ("g", "k", "len", "i1", "i2")} | {"open": np.ones(len(at), dtype=bool)}


def spans(docs: DataFrame, size: int = 50, text_col: str = "text", near: int = NEAR, large: int = LARGE) -> tuple[DataFrame, str]:
    """The written (k, len, spans array<struct<i1, i2>>): the starts of the repeated windows of each text."""
    spark, gram, paths = docs.sparkSession, max(1, -(-size // 4)), []

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = scratch_table(df, name)
        paths.append(path)
        return df

    rows, first = anchor_table(docs, size, gram, {}, text_col)
    paths.append(first)
    entries = kept(rows.groupBy("g", "f").agg(F.count("*").alias("n"), F.min(F.struct("k", "len", "p", "i1", "i2")).alias("one")),
                   "suffix-entries")
    # Beginnings with several entries, one of which is there once: all others are settled by their counts.
    shared = kept(entries.groupBy("g").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1 AND least = 1")
                  .select("g", "m"), "suffix-beginnings")

    def anchors_of(beginnings: DataFrame) -> DataFrame:
        return (entries.join(beginnings, "g").select("g", "one.*", (F.col("n") == 1).alias("single")).groupBy("k", "len")
                .agg(F.collect_list(F.struct("g", "p", "i1", "i2", "single")).alias("anchors")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def matches(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for x in neighbours(t, size, gram, near):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in x.values()], list(x))

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < BUFFER:
                continue
            t = pa.Table.from_batches(held)
            g = t.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last beginning may go on; numbers are sorted
            if cut:
                yield from matches(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held:
            yield from matches(pa.Table.from_batches(held))

    array = (suffixes(docs, kept(anchors_of(shared.filter(F.col("m") <= large)), "suffix-texts"), size, text_col)
             .repartition("g").sortWithinPartitions("g", "right", "left"))
    found = kept(array.mapInArrow(run, "g long, k long, len int, i1 int, i2 int, open boolean"), "suffix-matches")
    rest = kept(shared.filter(F.col("m") > large).select("g").union(found.filter("open").select("g")).distinct(), "suffix-rest")
    windows = kept(enumerated(docs, anchors_of(rest), size, text_col), "suffix-windows")
    again = windows.groupBy("g", "h").agg(F.count("*").alias("n"), F.max("single").alias("s")).filter("n > 1 AND s").select("g", "h")
    listed = windows.filter("single").join(again, ["g", "h"]).select("k", "len", F.col("i").alias("i1"), F.col("i").alias("i2"))
    several = entries.filter("n > 1").select("g", "f")
    whole = rows.select("g", "f", "k", "len", "i1", "i2").join(several, ["g", "f"]).select("k", "len", "i1", "i2")
    release(docs)
    out = scratch_table(whole.union(found.filter("NOT open").select("k", "len", "i1", "i2")).union(listed)
                        .groupBy("k", "len").agg(F.collect_set(F.struct("i1", "i2")).alias("spans")), "spans")
    drop_scratch(spark, *paths)
    release(docs)
    return out


def passages(n: int, found: list[dict] | None, size: int) -> list[dict]:
    """The covered words as maximal runs [from, to)."""
    if not found:
        return []
    c = np.diff(np.r_[0, covered(n, found, size).astype(np.int8), 0])
    return [{"from": int(a), "to": int(b)} for a, b in zip(np.flatnonzero(c == 1), np.flatnonzero(c == -1))]


def find(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR,
         large: int = LARGE) -> DataFrame:
    """(id, n_words, n_repeated, passages array<struct<from, to>>) for every row; word numbers from 0."""
    ship_package(docs.sparkSession)
    found, _ = spans(docs, size, text_col, near, large)
    kind = docs.schema[id_col].dataType.simpleString()
    spec = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n = [len(split_words(t)) for t in b.column(1).to_pylist()]
            p = [passages(m, f, size) for m, f in zip(n, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array([sum(x["to"] - x["from"] for x in y) for y in p], pa.int64()),
                 pa.array(p, spec)], [id_col, "n_words", "n_repeated", "passages"])

    rows = with_spans(docs.select(F.col(id_col), F.col(text_col)), found, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_repeated long, passages array<struct<from: int, to: int>>")
