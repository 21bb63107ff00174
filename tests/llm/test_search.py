"""Operators 11 and 12 against brute force over all rows."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from consign.llm import lexical, negatives

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def rank_all(docs, items, k):
    """The definition: {item: [(doc_id, score), ...]}."""
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n_docs, n_terms = len(own), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = {}
    for item, text in items:
        found = []
        for i, t in own:
            m = 100 - 90 + 90 * len(t) * n_docs // n_terms
            score = 0
            for w in set(terms(text)):
                if w in t:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    score += weight * (1_000_000_000 * t.count(w) // (1000 * t.count(w) + 8 * m))
            if score > 0:
                found.append((i, score))
        out[item] = sorted(found, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:k]
    return out


def some_docs(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "Été", "straße", "x1", "I", "İstanbul"] + ["w%d" % i for i in range(60)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.3:
            out.append((i, rng.choice(out)[1]))  # copies: equal scores
        else:
            out.append((i, "".join(rng.choice(words) + rng.choice([" ", "  ", ", ", "\n", "-", "\x00", "_"])
                                   for _ in range(rng.choice([1, 3, 20, 90])))))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_search_equals_brute_force(docs_of, spark, parts):
    docs = some_docs(3, 400) + [(9001, None), (9002, ""), (9003, " .,\x7f"), (9004, "the " * 30_000), (None, "w1 w2 w3 zz9")]
    items = [(1, "the W1 w2, w3"), (2, "Été x1 of"), (3, "no such term"), (4, ""), (5, None), (6, "w5 w5 w5"), (7, "zz9 w1"),
             (8, " ".join("w%d" % i for i in range(60)))]
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("clash"))
    got = {}
    index = lexical.build(docs_of(docs, parts).withColumn("term", F.lit("clash")))
    for r in lexical.search(index, queries.union(queries), k=10).collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    want = rank_all(docs, [(i, t) for i, t in items if t], 10)
    assert {i: [(d, s) for _, d, s in sorted(v)] for i, v in got.items()} == {i: v for i, v in want.items() if v}
    assert all([r for r, _, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_repeated_rows_fill_ranks(docs_of, spark):
    docs = [(1, "alpha beta"), (1, "alpha beta"), (2, "gamma"), (3, "gamma"), (4, "gamma delta epsilon")]
    queries = spark.createDataFrame([("q", "alpha"), ("q", "delta")], "item_id string, text string")
    got = sorted(tuple(r) for r in lexical.search(lexical.build(docs_of(docs)), queries).collect())
    assert [g[:3] for g in got] == [("q", 1, 1), ("q", 1, 4), ("q", 2, 1)]


def test_search_of_empty_tables(docs_of, spark):
    queries = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert lexical.search(lexical.build(docs_of([])), queries).count() == 0
    index = lexical.build(docs_of([(1, "alpha"), (2, None)]))
    assert lexical.search(index, queries.limit(0)).count() == 0
    assert lexical.search(index, queries).collect()[0].doc_id == 1


def test_long_texts_are_cut_between_terms(monkeypatch):
    texts = ["ab cd ab", None, "x" * 50 + " y " * 40 + "É1 é1" * 9, "", "tail"]
    monkeypatch.setattr(lexical, "PIECE", 16)
    col = pa.array(texts)
    row, code, tf, words = lexical.term_counts(col)
    got = {(r, words[c].as_py()): n for r, c, n in zip(row.tolist(), code.tolist(), tf.tolist())}
    want = {}
    for i, t in enumerate(texts):
        for w in terms(t):
            want[i, w] = want.get((i, w), 0) + 1
    assert got == want
    assert lexical.count_terms(col).tolist() == [len(terms(t)) for t in texts]


def test_strata_below_the_bound_are_not_scored(monkeypatch):
    docs = [(i, "rare common") for i in range(12)] + [(100 + i, "common " * (i + 2)) for i in range(300)]
    shard = lexical._Shard()
    shard.add(np.array([i for i, _ in docs]), pa.array([t for _, t in docs]))
    n_terms = sum(len(terms(t)) for _, t in docs)
    rows = shard.rows_of(0, len(docs), n_terms).to_pylist()
    tno = {None: -1, "common": 0, "rare": 1}
    rows = [{"tno": tno[r["term"]]} | {c: np.array(r[c], dtype=np.int64) for c in ("docs", "group_m", "group_tf", "group_size")}
            for r in rows]
    scored = []
    ranges = lexical._ranges
    monkeypatch.setattr(lexical, "_ranges", lambda a, b: scored.append(int(b.sum())) or ranges(a, b))
    weights = np.array([lexical.weight(len(docs), 312), lexical.weight(len(docs), 12)])
    s = lexical._Searcher([np.array([0, 1])], weights, 10)
    s.shard(sorted(rows, key=lambda r: r["tno"]))
    assert s.ids[0].tolist() == list(range(10))
    assert max(scored[1:]) < 300  # of 312 documents with a term


# ------------------------------------------------------------------ operator 12

def mined(rows, k=5):
    """The definition, over (vec_id, vector, label) rows with Python's integers."""
    fine = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
            if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for a, va, ya in fine:
        if a % 100:
            continue
        s = sorted(((-sum(p * q for p, q in zip(va, v)), i, y) for i, v, y in fine if i != a and len(v) == len(va)))
        for ps, p, _ in [x for x in s if x[2] == ya][:k]:
            good = [(-ns, n) for ns, n, y in s if y != ya and 80 * -ps <= 100 * -ns <= 100 * -ps]
            out |= {(a, p, r + 1, n, -ps, ns) for r, (ns, n) in enumerate(good[:k])}
    return out


def vectors(seed, n, dim, hot=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (8, dim))
    out = []
    for i in range(n):
        v = centres[rng.integers(8)] + rng.normal(0, 0.3, dim) if i >= hot else centres[0] + rng.normal(0, 0.02, dim)
        out.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(rng.integers(3))))
    return out


EMBEDDINGS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("parts", [1, 6])
def test_negatives_equal_brute_force(spark, parts):
    rows = vectors(5, 1500, 12, hot=500)
    rows += [(5000 + i, rows[i % 3][1], i % 3) for i in range(300)]  # ties: three vectors, many times
    rows += [(6000, None, 1), (6100, rows[0][1], None), (None, rows[0][1], 1), (6200, [float("nan")] * 12, 1),
             (6300, [None] * 12, 0), (6400, [float("inf")] * 12, 0), (6500, [0.0] * 12, 1), (6501, [0.0] * 12, 1),
             (6600, [], 0), (6601, [], 0), (6602, [], 1), (6700, [0.5, 0.25], 0), (6701, [0.5, 0.3], 0), (6702, [0.4, 0.3], 1)]
    df = spark.createDataFrame(rows, EMBEDDINGS).repartition(parts).withColumn("dim", F.lit("clash")).withColumn("v", F.lit(1))
    got = [tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == mined(rows)


def test_repeated_ids_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (0, [2.0, 0.0], 0), (1, [1.0, 0.1], 0), (2, [0.9, 0.1], 1)]
    got = {tuple(r) for r in negatives.mine(spark.createDataFrame(rows, EMBEDDINGS), F.col("vec_id") % 100 == 0).collect()}
    assert got == mined([rows[0], *rows[3:]])
    none = spark.createDataFrame([], EMBEDDINGS)
    assert negatives.mine(none, F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(spark.createDataFrame(rows, EMBEDDINGS), F.col("vec_id") < 0).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [1e6, 3.0], 0), (1, [1e6, 1.0], 0), (2, [1e6, 0.5], 1), (3, [1e6 - 1, 9.0], 1), (4, [1e6, 1.0], 1)]
    got = {tuple(r) for r in negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"),
                                            F.col("vec_id") % 100 == 0).collect()}
    assert got == mined(rows) and got


def test_blocks_of_anchors_agree(spark, monkeypatch):
    rows = vectors(8, 700, 6)
    df = spark.createDataFrame(rows, EMBEDDINGS)
    monkeypatch.setattr(negatives, "BLOCK", 20)
    assert {tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0).collect()} == mined(rows)


def test_tree_eliminates_and_is_exact():
    rows = vectors(2, 4000, 4)
    x = np.floor(256 * np.array([v for _, v, _ in rows], dtype=np.float64))
    ids, labels = np.arange(len(x)), np.array([y for _, _, y in rows])
    anchors = np.arange(0, len(x), 100)
    args = (x[anchors], ids[anchors], labels[anchors], np.arange(len(anchors)))
    s = negatives.Searcher(*args, np.full(len(anchors), 60_000), np.full(len(anchors), 62_000), False, 5, np.zeros((0, 4)))
    s.shard(negatives.pack(ids, labels, x, np.zeros((0, 4))))
    assert 0 < s.seen < 0.6 * len(anchors) * len(x)
    for j, a in enumerate(anchors):
        score = (x @ x[a]).astype(int)
        ok = [(-score[i], i) for i in ids if labels[i] != labels[a] and 60_000 <= score[i] <= 62_000]
        want = sorted(ok)[:5]
        assert list(zip(-s.scores[j], s.found[j]))[:len(want)] == want


def test_equal_vectors_are_one_leaf():
    order, tree = negatives.grow(np.ones((1000, 3)), np.arange(1000)[::-1])
    assert len(tree.start) == 1 and order.tolist() == list(range(999, -1, -1))
