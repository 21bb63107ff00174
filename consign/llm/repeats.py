"""Repeated word windows: what operators 6 and 7 share.

A window is ``size`` consecutive words of one text.  The question for each is
whether its word sequence starts anywhere else as well.  Shuffling every window
would cost several times the input, so windows are handled by *anchor*: the
smallest (leftmost among equals) hash of the ``gram``-word sequences inside a
window.  Equal windows have equal anchors at equal offsets, neighbouring windows
mostly share theirs, so about two words in ``size - gram`` are anchors.

An anchor row holds

    g       hash of the anchor's words
    f       hash of the words that the anchor's windows cover together, with its place there
    k, len  hash and length of the text (equal texts are one from here on)
    p       the anchor's word; i1..i2 its windows' starts

and whatever further hashes the search for candidates wants.  Anchors whose g
and f both occur again have only repeated windows.  The others (where copies
begin, end or differ) are enumerated window by window, from one representative
of each (g, f), and only where their g has several f.

Every table is written to the shared folder once, groups are counted after
partial aggregation, and joins are between written tables, so that adaptive
execution can split a hot key.  Window identity is the pair (g, hash of the
window), 128 bits in all.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, scratch_table
from .tokens import slices

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            a = np.full(2 * n, b, dtype=np.uint64)
            a[0] = 1
            _powers[i] = np.cumprod(a)
    return _powers[0][:n], _powers[1][:n]


def split_words(text: str | None) -> list[bytes]:
    """The words of a text: what lies between ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class Spans:
    """Hashes of any word ranges of one text."""

    def __init__(self, words: list[bytes]) -> None:
        self.n = n = len(words)
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n)
        power, self.back = _pow(n + 1)
        self.run = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(h * power[:n], out=self.run[1:])

    def hash(self, a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
        h = (self.run[b] - self.run[a]) * self.back[a] + (b - a).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32)) ^ np.uint64(salt)) * _MIX
        return h ^ (h >> np.uint64(29))


def smallest(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the index of the smallest, the leftmost among equals."""
    at, span = np.arange(len(g)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at = np.where(g[left] <= g[right], left, right)
        span += step
    return at


def anchors(words: list[bytes], size: int, gram: int) -> tuple[Spans, dict[str, np.ndarray]] | None:
    """The anchors of one text, or None if it has no window."""
    if len(words) < size:
        return None
    s = Spans(words)
    at = np.arange(s.n - gram + 1)
    g = s.hash(at, at + gram, 1)
    of = smallest(g, size - gram + 1)
    i1 = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    i2 = np.r_[i1[1:], len(of)] - 1
    p = of[i1]
    f = s.hash(i1, i2 + size, 2) + (p - i1).astype(np.uint64) * _MIX
    return s, {"g": g[p], "f": f, "p": p, "i1": i1, "i2": i2}


def text_key(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("k"), F.char_length(text).alias("len")]


def anchor_table(docs: DataFrame, size: int, gram: int, more: dict[str, Callable[[Spans, np.ndarray], np.ndarray]],
                 text_col: str = "text") -> tuple[DataFrame, str]:
    """The written anchor rows of every text; ``more`` gives further hashes from the anchors' places."""
    names = ["g", "f", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for i, t in enumerate(b.column(2).to_pylist()):
                if found := anchors(split_words(t), size, gram):
                    s, a = found
                    a |= {m: f(s, a["p"]) for m, f in more.items()}
                    out.append(a | {"row": np.full(len(a["p"]), i)})
            if out:
                a = {c: np.concatenate([x[c] for x in out]) for c in out[0]}
                cols = [pa.array(a[c].view(np.int64)) for c in names]
                cols += [b.column(0).take(pa.array(a["row"])), b.column(1).take(pa.array(a["row"]))]
                cols += [pa.array(a[c].astype(np.int32)) for c in ("p", "i1", "i2")]
                yield pa.RecordBatch.from_arrays(cols, [*names, "k", "len", "p", "i1", "i2"])

    rows = docs.filter(F.col(text_col).isNotNull()).select(*text_key(text_col), F.col(text_col))
    return scratch_table(rows.mapInArrow(run, ", ".join(f"{c} long" for c in names)
                                         + ", k long, len int, p int, i1 int, i2 int"), "anchors")


def release(docs: DataFrame) -> None:
    """Let go of the shuffle files of finished jobs; they stay until the driver collects its garbage."""
    gc.collect()
    docs.sparkSession._jvm.System.gc()


def repeated(rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, str]:
    """The written keys that occur more than once."""
    return scratch_table(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), name)


def enumerated(docs: DataFrame, each: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """(g, h, k, len, i, single): the windows, by their hash h, of the anchors in ``each`` (k, len, anchors)."""
    def enumerate_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            out = []
            for row, (t, found) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                s = Spans(split_words(t))
                n = np.array([a["i2"] - a["i1"] + 1 for a in found])
                i = np.concatenate([np.arange(a["i1"], a["i2"] + 1) for a in found])
                out.append((np.repeat(np.array([a["g"] for a in found], dtype=np.int64), n), s.hash(i, i + size, 3).view(np.int64),
                            np.full(len(i), row), i.astype(np.int32), np.repeat(np.array([a["single"] for a in found]), n)))
            if out:
                g, h, row, i, single = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g), pa.array(h), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)),
                     pa.array(i), pa.array(single)], ["g", "h", "k", "len", "i", "single"])

    texts = docs.filter(F.col(text_col).isNotNull()).select(*text_key(text_col), F.col(text_col).alias("text"))
    return (texts.join(each, ["k", "len"]).select("k", "len", "text", "anchors")
            .mapInArrow(enumerate_windows, "g long, h long, k long, len int, i int, single boolean"))


def repeated_spans(docs: DataFrame, rows: DataFrame, size: int, text_col: str = "text") -> tuple[DataFrame, str]:
    """(k, len, spans array<struct<i1, i2>>): the starts of the repeated windows of each text.

    ``rows``: the candidate anchor rows, a written table.
    """
    spark, paths = docs.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = scratch_table(df, name)
        paths.append(path)
        return df

    classes = kept(rows.groupBy("g", "f").agg(F.count("*").alias("n"), F.min(F.struct("k", "len", "i1", "i2")).alias("one")),
                   "classes")
    mixed = kept(classes.groupBy("g").agg(F.count("*").alias("n"), F.min("n").alias("least"))
                 .filter("n > 1 AND least = 1").select("g"), "mixed")
    each = kept(classes.join(mixed, "g").select("g", "one.*", (F.col("n") == 1).alias("single"))
                .groupBy("k", "len").agg(F.collect_list(F.struct("g", "i1", "i2", "single")).alias("anchors")), "each")

    # Copies of a text give the same windows again, which only a text with several copies has, and
    # all of its classes count as repeated anyway; so copies need not be told apart here.
    windows = kept(enumerated(docs, each, size, text_col), "windows")
    again = kept(windows.groupBy("g", "h").agg(F.count("*").alias("n"), F.max("single").alias("s"))
                 .filter("n > 1 AND s").select("g", "h"), "again")
    hits = windows.filter("single").join(again, ["g", "h"]).select("k", "len", F.col("i").alias("i1"), F.col("i").alias("i2"))
    several = classes.filter("n > 1").select("g", "f")
    whole = rows.select("g", "f", "k", "len", "i1", "i2").join(several, ["g", "f"]).select("k", "len", "i1", "i2")
    out = scratch_table(whole.union(hits).groupBy("k", "len").agg(F.collect_set(F.struct("i1", "i2")).alias("spans")), "spans")
    drop_scratch(spark, *paths)
    release(docs)
    return out


def covered(n: int, spans: list[dict], size: int) -> np.ndarray:
    """Which of n words lie in a window that starts in one of the spans."""
    step = np.zeros(n + 1, dtype=np.int64)
    for s in spans:
        step[s["i1"]] += 1
        step[s["i2"] + size] -= 1
    return np.cumsum(step[:n]) > 0


def with_spans(docs: DataFrame, spans: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``_spans`` (null where a text has no repeated window)."""
    k, n = text_key(text_col)
    spans = spans.withColumnsRenamed({"k": "_k", "len": "_len", "spans": "_spans"})
    return (docs.withColumns({"_tk": k, "_tlen": n})
            .join(spans, (F.col("_tk") == F.col("_k")) & (F.col("_tlen") == F.col("_len")), "left")
            .drop("_tk", "_tlen", "_k", "_len"))
