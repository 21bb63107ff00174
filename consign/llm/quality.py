"""Quality classifier with supervised subword embeddings (operator 3).

A document's features are its words, its pairs of neighbouring words, and the
character 3- to 5-grams inside words (a word's edges count as a character),
hashed into ``BUCKETS`` learned vectors.
The document vector is their average, the score a softmax over it; vectors and
softmax are trained together by stochastic gradient descent in numpy.

Training reads a bounded sample: the ``TRAIN_ROWS`` labelled documents that come
first by a hash of their id, among those of at most ``TRAIN_CHARS`` characters
(so at most about 80 MB of text reaches the driver).  Scoring reads every whole
text.  As softmax of an average is linear in the vectors, a bucket's part in the
score is one number; the tasks get a table of ``BUCKETS`` of them.

Defined cases: a null or empty text has no features and scores by the softmax's
bias alone; a text of any length is scored whole, in stretches of ``STRETCH`` characters (a
single word longer than that counts as several); labels that are null or neither 0 nor 1 are left out of training, as
are documents with a null id or text; with one class in the sample every text
scores that class's share, with no labels 0.5; repeated rows are scored each;
an empty table gives an empty result; ``score_rows`` returns the id and its
own columns only, ``keep_good`` every column unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package
from .tokens import text_slices

BUCKETS_BITS, DIM = 17, 8
STRETCH = 1 << 17  # characters whose features are in memory at once
SLICE = 1 << 20  # bytes of text
BUCKETS = 1 << BUCKETS_BITS
TRAIN_ROWS, TRAIN_CHARS = 4000, 20_000
TRAIN_PART = 16  # training documents whose features are looked for at a time
EPOCHS, RATE, SEED = 5, 0.5, 7
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32)) ^ np.uint64(kind)) * _MIX
    return (((h ^ (h >> np.uint64(32))) * _MIX) >> np.uint64(64 - BUCKETS_BITS)).astype(np.int32)


def feature_parts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every feature of the texts, in parts of bounded size.

    The texts are one array of code points, apart by a blank, that is worked on in stretches of
    at most ``STRETCH``.  A stretch ends at a blank, which begins the next one too, and the last
    word's hash is carried over for the pair across, so stretches change no feature.
    """
    parts = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    c = np.frombuffer(b" \0\0\0" + b" \0\0\0".join(parts) + b" \0\0\0", dtype="<u4")
    start = np.concatenate([[0], np.cumsum([len(p) // 4 + 1 for p in parts])])  # the blank before each text
    blank = (c == 32) | ((c >= 9) & (c <= 13)) | (c == 0xA0) | (c == 0x3000)
    edges = np.flatnonzero(blank)
    power = np.cumprod(np.full(STRETCH + 2, _BASE, dtype=np.uint64))
    back = np.cumprod(np.full(STRETCH + 2, _BACK, dtype=np.uint64))
    at, last = 0, None
    while at < len(c) - 1:
        end = int(edges[np.searchsorted(edges, at + STRETCH, side="right") - 1])
        if end <= at:  # a word longer than a stretch
            end = min(at + STRETCH, len(c) - 1)
        own = blank[at:end + 1]
        x = np.where(own, 32, c[at:end + 1]).astype(np.uint64) + np.uint64(1)
        stops = np.flatnonzero(own)
        if not own[0]:
            stops = np.r_[-1, stops]
        if not own[-1]:
            stops = np.r_[stops, len(own) - 1]  # the last character begins the next stretch
        a, b = stops[:-1] + 1, stops[1:]
        a, b = a[b > a], b[b > a]
        # Words: the polynomial hash between two positions, from running sums modulo 2**64.
        run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x * power[:len(x)])])
        word = (run[b] - run[a]) * back[a]
        row = np.searchsorted(start, a + at, side="right") - 1
        yield row, _bucket(word, 1)
        # Word pairs by the difference of their hashes, so that every repeated word is one feature.
        if last is not None:
            word, row = np.r_[last[0], word], np.r_[last[1], row]
        if len(word):
            last = word[-1], row[-1]
        pair = row[1:] == row[:-1]
        yield row[1:][pair], _bucket(word[1:][pair] - word[:-1][pair], 2)
        # n-grams: blanks may only stand at the ends, and not at both with nothing between.
        before = np.concatenate([[0], np.cumsum(own)])
        for k in (3, 4, 5):
            if len(x) < k:
                continue
            gram = np.flatnonzero(before[k - 1:-1] == before[1:len(before) - k + 1])
            h = np.zeros(len(gram), dtype=np.uint64)
            for i in range(k):
                h = h * _BASE + x[gram + i]
            yield np.searchsorted(start, gram + (at + 1), side="right") - 1, _bucket(h, k)
        at = end


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of the texts."""
    rows, buckets = zip(*feature_parts(texts))
    return np.concatenate(rows), np.concatenate(buckets)


@dataclass
class Model:
    part: np.ndarray  # each bucket's part in the score
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        total, count = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        for row, bucket in feature_parts(texts):
            total += np.bincount(row, weights=self.part[bucket], minlength=len(texts))
            count += np.bincount(row, minlength=len(texts))
        z = total / np.maximum(count, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(texts: list[str], labels: list[int]) -> Model:
    """Stochastic gradient descent over (text, 0 or 1), one document a step."""
    y = np.array(labels, dtype=np.int64)
    if len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    # Each document's distinct features and their shares, end to end in two arrays, which are held once: n
    # characters have fewer than 4 n + 16 features, and of the room for that only what is filled takes memory.
    room, sizes, end = sum(4 * len(t) + 16 for t in texts), [], 0
    ids, shares = np.empty(room, dtype=np.int32), np.empty(room, dtype=np.float32)
    for at in range(0, len(texts), TRAIN_PART):
        part = texts[at:at + TRAIN_PART]
        row, bucket = features(part)
        both, n = np.unique((row.astype(np.int64) << BUCKETS_BITS) | bucket, return_counts=True)
        of = both >> BUCKETS_BITS
        ids[end:end + len(both)] = both & (BUCKETS - 1)
        shares[end:end + len(both)] = n / np.bincount(row, minlength=len(part))[of]
        sizes.append(np.bincount(of, minlength=len(part)))
        end += len(both)
    sizes = np.concatenate(sizes)
    stop = np.cumsum(sizes)
    steps, done = EPOCHS * len(texts), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(texts)):
            own, w = ids[stop[i] - sizes[i]:stop[i]], shares[stop[i] - sizes[i]:stop[i]]
            rate = RATE * (1 - done / steps)
            done += 1
            rows = vectors[own]
            h = w @ rows
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= rate * np.outer(h, p)
            bias -= rate * p
            # The average spreads a step thinly over the features; scaled so that a feature
            # that makes up the whole document moves as far as the softmax does.
            vectors[own] = rows - (rate * len(own)) * np.outer(w, back)
    side = out[:, 1] - out[:, 0]
    return Model((vectors @ side).astype(np.float64), float(bias[1] - bias[0]))


def fold(id_col: Column) -> Column:
    """0 to 4 from crc32 of the id as text; fold 0 is never trained on."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Train on the bounded sample of labelled documents outside fold 0."""
    known = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y"))
             .filter("id IS NOT NULL AND y IN (0, 1)").filter(fold(F.col("id")) != 0))
    # Twice the rows, as some texts are too long; at most 8,000 ids and labels are sent to the tasks.
    known = known.orderBy(F.xxhash64("id"), "id", "y").limit(2 * rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter(
        F.col("text").isNotNull() & (F.length("text") <= TRAIN_CHARS))
    sample = (texts.join(F.broadcast(known), "id").orderBy(F.xxhash64("id"), "id", "y", "text").limit(rows)
              .select("text", "y").collect())
    return train([r.text for r in sample], [r.y for r in sample])


def score_rows(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1, SLICE):
            score = shared.value.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], [id_col, "score"])

    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows that score at least the threshold, all columns unchanged."""
    ship_package(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, at, SLICE):
            yield b.filter(pa.array(shared.value.score(b.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
