"""Substring dedup by level-wise doubling (operator 6).

Removes every word that lies in a window of ``size`` words whose word sequence also
starts anywhere else, in the same text or another; windows are judged on the input.

Levels: a window can only be repeated if the shorter sequences in it are.  The
first level takes a quarter of ``size`` (rounded up) at the windows' anchors
(``repeats``).  Only sequences that are repeated there are extended to twice that
length, to the right and to the left of the anchor (every window holds one of the
two), and only anchors where one of them is repeated go on to the full length.  The
last level extends to ``size``: by whole anchors where the words around are repeated
too, window by window where they are not.

Defined cases: a null text has no words and stays null; texts of fewer than
``size`` words have no window and stay as they are; copies of a text remove each
other's words entirely (from ``size`` words on); repeated rows count as copies; an
empty table gives an empty result.  ``find`` returns the id and its own
columns only; ``remove`` every column, with ``text`` cut and ``n_chars`` (where
there is one) counted anew in rows that lose words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import drop_scratch, scratch_table, ship_package
from .repeats import anchor_table, covered, release, repeated, repeated_spans, split_words, with_spans
from .tokens import slices


def _right(gram: int):
    return lambda s, p: s.hash(p, np.minimum(p + 2 * gram, s.n), 4)


def _left(gram: int):
    return lambda s, p: s.hash(np.maximum(p - gram, 0), p + gram, 5)


def spans(docs: DataFrame, size: int = 35, text_col: str = "text") -> tuple[DataFrame, str]:
    ship_package(docs.sparkSession)
    gram = max(1, -(-size // 4))
    rows, first = anchor_table(docs, size, gram, {"r": _right(gram), "l": _left(gram)}, text_col)
    again, again_path = repeated(rows, ["g"], "level-1")
    rows, second = scratch_table(rows.join(again, "g"), "level-1-anchors")
    drop_scratch(docs.sparkSession, first, again_path)
    release(docs)
    right, right_path = repeated(rows, ["g", "r"], "level-2-right")
    left, left_path = repeated(rows, ["g", "l"], "level-2-left")
    held = rows.join(right.withColumn("_r", F.lit(True)), ["g", "r"], "left").join(left.withColumn("_l", F.lit(True)), ["g", "l"], "left")
    rows, third = scratch_table(held.filter("_r OR _l").select("g", "f", "k", "len", "i1", "i2"), "level-2-anchors")
    drop_scratch(docs.sparkSession, second, right_path, left_path)
    out = repeated_spans(docs, rows, size, text_col)
    drop_scratch(docs.sparkSession, third)
    return out


def cut(text: str | None, found: list[dict] | None, size: int) -> tuple[int, int, str | None]:
    """(words, words removed, the kept words joined by one space)."""
    words = split_words(text)
    if not found:
        return len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass")
    gone = covered(len(words), found, size)
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone) if not g]).decode("utf-8", "surrogatepass")


def find(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept) for every row."""
    found, _ = spans(docs, size, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [cut(t, f, size) for t, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            n, gone, kept = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(kept, pa.string())], [id_col, "n_words", "n_removed", "kept"])

    rows = with_spans(docs.select(F.col(id_col), F.col(text_col)), found, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, kept string")


def remove(docs: DataFrame, size: int = 35, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` without the repeated words; rows that lose none are unchanged."""
    found, _ = spans(docs, size, text_col)
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            old, cols = b.column(at).to_pylist(), list(b.columns)
            new = [cut(t, f, size)[2] if f else t for t, f in zip(old, cols.pop().to_pylist())]
            cols[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    out = with_spans(docs, found, text_col).mapInArrow(run, schema)
    if chars_col in docs.columns and isinstance(schema[chars_col].dataType, LongType):
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col))
                             .otherwise(F.char_length(text_col).cast("long")))
    return out
