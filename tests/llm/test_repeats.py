"""Operators 6 and 7 against every window of every text."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from consign.llm import catalog, doubling, repeats, suffixes
from tests.conftest import SF001


def covered(texts, size):
    """For each text, whether each word is in a window that occurs again."""
    words = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        c = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                c[i:i + size] = True
        out.append((w, c))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab") * rng.randint(1, 3) + str(rng.randrange(40))
    shared = [[word() for _ in range(rng.randint(6, 60))] for _ in range(12)]
    texts = []
    for _ in range(120):
        t = []
        for _ in range(rng.randint(1, 4)):
            t += rng.choice(shared) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.3:
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += texts[:6] + [None, "", "  \n", "the " * 70, "x y " * 50, "the " * 70]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,size", [(1, 8), (2, 11)])
def test_doubling_equals_brute_force(spark, docs_of, seed, size):
    rows = corpus(seed)
    d = docs_of(rows).withColumnRenamed("source", "_spans")  # a clashing name
    got = {r.doc_id: r for r in doubling.find(d, size).collect()}
    assert len(got) == len(rows)
    for (i, _), (w, c) in zip(rows, covered([t for _, t in rows], size)):
        assert (got[i].n_words, got[i].n_removed) == (len(w), c.sum()), i
        assert got[i].kept == b" ".join([x for x, g in zip(w, c) if not g]).decode()


@pytest.mark.parametrize("seed,size,near,large", [(3, 8, 16, 256), (4, 12, 16, 256), (5, 9, 1, 256), (6, 8, 2, 3), (7, 10, 3, 1)])
def test_suffix_array_equals_brute_force(spark, docs_of, seed, size, near, large):
    """Also where few neighbours are compared, and beginnings of more than a few entries go window by window."""
    rows = corpus(seed)
    got = {r.doc_id: r for r in suffixes.find(docs_of(rows), size, near=near, large=large).collect()}
    assert len(got) == len(rows)
    for (i, _), (w, c) in zip(rows, covered([t for _, t in rows], size)):
        mine = np.zeros(len(w), dtype=bool)
        for p in got[i].passages:
            mine[p["from"]:p["to"]] = True
        assert np.array_equal(mine, c), i
        assert (got[i].n_words, got[i].n_repeated) == (len(w), c.sum())


def entry(words, p, i1, i2, size, g=7, single=True, k=0):
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=">u8")
    return {"g": g, "right": h[p:i2 + size].tobytes(), "left": h[i1:p][::-1].tobytes(), "single": single, "k": k, "len": 0,
            "p": p, "i1": i1, "i2": i2}


def test_neighbours_are_extended_left_and_right():
    """Two texts that share the words 3 to 14, the anchor at 6: with windows of 8 words those from 3 to 6 are repeated."""
    shared = [f"s{i}" for i in range(11)]
    a, b = ["a0", "a1", "a2", *shared, "a3", "a4"], ["b0", *shared, "b1", "b2", "b3", "b4"]
    rows = [entry(a, 6, 1, 6, 8, k=1), entry(b, 4, 0, 4, 8, k=2), entry(["x"] * 20, 6, 2, 6, 8, g=9, k=3)]
    types = pa.schema([("g", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("single", pa.bool_()), ("k", pa.int64()),
                       ("len", pa.int32()), ("p", pa.int32()), ("i1", pa.int32()), ("i2", pa.int32())])
    rows.sort(key=lambda r: (r["g"], r["right"]))
    got = {(int(k), int(i), int(j), bool(o)) for x in suffixes.neighbours(pa.Table.from_pylist(rows, types), 8, 2, 4)
           for k, i, j, o in zip(x["k"], x["i1"], x["i2"], x["open"])}
    assert got == {(1, 3, 6, False), (2, 1, 4, False)}


def test_remove_keeps_other_rows(spark, docs_of):
    rows = [(1, "a  b\nc " + "s t u v w x y z"), (2, "s t u v w x y z q"), (3, "quite  other\ntext"), (None, None)]
    d = docs_of(rows)
    out = {r.doc_id: r for r in doubling.remove(d, 8).collect()}
    assert doubling.remove(d, 8).columns == d.columns
    assert (out[1].text, out[1].n_chars, out[2].text) == ("a b c", 5, "q")
    assert out[3].text == "quite  other\ntext" and out[None].text is None
    assert doubling.remove(docs_of([]), 8).count() == 0 and suffixes.find(docs_of([]), 8).count() == 0


def test_queries_on_whole_tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    op6 = {r.doc_id: r for r in catalog.QUERIES["op6_doubling"](spark, SF001).collect()}
    for (i, _), (w, c) in zip(docs.items(), covered(docs.values(), 35)):
        kept = b" ".join([x for x, g in zip(w, c) if not g])
        assert (op6[i].n_words, op6[i].n_removed) == (len(w), c.sum())
        assert op6[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
    op7 = {r.doc_id: r for r in catalog.QUERIES["op7_suffix_array"](spark, SF001).collect()}
    for (i, _), (w, c) in zip(docs.items(), covered(docs.values(), 50)):
        assert (op7[i].n_words, op7[i].n_repeated) == (len(w), c.sum())
        runs = [p.split("-") for p in op7[i].passages.split()]
        assert sum(int(b) - int(a) for a, b in runs) == c.sum()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.integers(1, 12))
def test_smallest_is_leftmost_minimum(values, width):
    g = np.array(values, dtype=np.uint64)
    if width > len(g):
        return
    expect = [i + int(np.argmin(g[i:i + width])) for i in range(len(g) - width + 1)]
    assert repeats.smallest(g, width).tolist() == expect


def test_span_hash_is_of_content():
    a, b = repeats.Spans(b"x a b c d y".split()), repeats.Spans(b"a b c d".split())
    one = lambda s, i, j: int(s.hash(np.array([i]), np.array([j]))[0])
    assert one(a, 1, 5) == one(b, 0, 4) and one(a, 0, 4) != one(b, 0, 4) and one(a, 1, 4) != one(a, 2, 5)
