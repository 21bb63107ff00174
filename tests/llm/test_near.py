"""Operators 2 and 10 against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from consign.llm import rpforest, simhash
from consign.llm.common import components

LETTERS = "abcdefghijklmnopqrst"


def union(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simple_fingerprint(text):
    """The definition, bit by bit."""
    import re
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def documents(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 7)))
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            words = rng.choice(out)[1].split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word()
            out.append((i, " ".join(words)))
        else:
            out.append((i, " ".join(word() for _ in range(rng.randint(30, 200)))))
    return out


EDGES = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "One"), (9005, "one"), (9006, "a b c"), (9007, "x\x0by\x0cz w"),
         (9008, "É é É é ß"), (9009, "word " * 5000)]


def test_fingerprint_by_definition():
    for _, t in documents(1, 30) + EDGES:
        assert simhash.fingerprint(t) == simple_fingerprint(t)


@pytest.mark.parametrize("tree_size", [2048, 7])
def test_simhash_components(spark, docs_of, tree_size):
    rows = documents(2, 260) + EDGES
    fps = [simple_fingerprint(t) for _, t in rows]
    part = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    low = {}
    for (i, _), p in zip(rows, part):
        low[p] = min(low.get(p, i), i)
    d = docs_of(rows).withColumnRenamed("source", "fp")  # a clashing name
    got = {r.doc_id: r for r in simhash.near_duplicates(d, tree_size=tree_size).collect()}
    assert len(got) == len(rows)
    for (i, _), fp, p in zip(rows, fps, part):
        assert got[i].fingerprint == f"{fp:016x}" and got[i].component_id == low[p] and got[i].kept == (low[p] == i)


def test_simhash_edges(spark, docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    d = docs_of([(1, "same text here now"), (1, "same text here now"), (None, "same text here now"), (2, "Same Text here now"), (3, None)])
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(d).collect())
    assert [g[1] for g in got] == [None, 1, 1, 1, 3]
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3]
    assert simhash.drop_near_duplicates(docs_of([])).count() == 0


def test_bk_tree_finds_all():
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = list({centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 9))) for _ in range(400)})
    tree = simhash.BKTree(4)
    for f in fps:
        tree.add(f)
    for f in fps[:50]:
        assert sorted(tree.within(f)) == [i for i, x in enumerate(fps) if (x ^ f).bit_count() <= 4]


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    pairs += [(2000, i) for i in range(2001, 2200)]
    part = union(3000, pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: part[x] for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed, n, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, dim))
    v = np.concatenate([base] + [base + rng.normal(0, s, base.shape) for s in (0.05, 0.15, 0.25)])
    return [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)] + [(n + 1, [float(np.float32(x)) for x in v[0]])]


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("params", [rpforest.Params(), rpforest.Params(leaf=40, sample=96, chunk=60, trees=8, spill=0.12)])
def test_forest_against_brute_force(spark, params):
    rows = vectors(5, 800)
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = (v @ v.T) >= 0.95
    np.fill_diagonal(near, False)
    part = union(len(rows), list(zip(*np.nonzero(near))))
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA).withColumnRenamed("label", "cid").repartition(3)
    got = {r.vec_id: r for r in rpforest.near_duplicates(df, params).collect()}
    true, found = near.sum(), sum(r.n_links for r in got.values())
    assert len(got) == len(rows)
    assert all(got[i].n_links <= near[k].sum() for k, (i, _) in enumerate(rows))
    assert found >= 0.9 * true > 0
    wrong = sum(got[i].component_id != rows[part[k]][0] for k, (i, _) in enumerate(rows))
    assert wrong <= 0.05 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("noise", [0.02, 0.22])
def test_forest_counts_a_dense_group_in_full(spark, noise):
    """A group far over a leaf's size, of vectors that all link or about half do, and stragglers around it."""
    rng = np.random.default_rng(6)
    middle = rng.standard_normal(24)
    v = np.concatenate([middle + rng.normal(0, noise, (2200, 24)), middle + rng.normal(0, 0.35, (300, 24)),
                        rng.standard_normal((300, 24))])
    rows = [(i, [float(np.float32(x)) for x in r], 0) for i, r in enumerate(v)]
    rows += [(9000 + i, rows[i][1], 0) for i in range(20)]
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = (v @ v.T) >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in rpforest.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3),
                                                          rpforest.Params(leaf=64, sample=2048)).collect()}
    links = np.array([got[r[0]].n_links for r in rows])
    assert len(got) == len(rows) and (links <= near.sum(axis=1)).all()
    assert (links[:2200] == near.sum(axis=1)[:2200]).mean() > 0.999
    assert links.sum() >= 0.999 * near.sum() > 0
    low = np.arange(len(rows))
    while (nxt := np.minimum(low, np.where(near, low, len(rows)).min(axis=1))).tolist() != low.tolist():
        low = nxt
    wrong = np.array([got[r[0]].component_id != rows[k][0] for r, k in zip(rows, low)])
    assert not wrong[:2200].any() and wrong.sum() <= 0.01 * len(rows)


def test_forest_finds_groups_that_the_sample_does_not_show(spark):
    """800 of 8,000 vectors in one group, half of whose pairs link; six of them in a sample of 64 are below ``LEAST``."""
    rng = np.random.default_rng(9)
    middle = rng.standard_normal(16)
    v = np.concatenate([middle + rng.normal(0, 0.22, (800, 16)), rng.standard_normal((7200, 16))])
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(v.tolist())],
                               "vec_id long, embedding array<double>, label int").repartition(4)
    u = v[:800] / np.linalg.norm(v[:800], axis=1)[:, None]
    near = (u @ u.T >= 0.95).sum(axis=1) - 1
    o = rpforest.Params(leaf=128, sample=64, dense=100, trees=3)
    assert not len(rpforest.cover(u[rng.choice(800, 6, replace=False)], 8000, o)[0])
    got = rpforest.near_duplicates(df, o).filter("vec_id < 800").orderBy("vec_id").toPandas()["n_links"].to_numpy()
    assert 0.2 < near.mean() / 800 < 0.9
    assert (got <= near + 8).all() and got.sum() >= 0.99 * near.sum(), (got.sum(), near.sum())


def test_vectors_of_every_length_link(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(5)] + [(10 + i, [1.0, 0.0], 0) for i in range(3)] + [(20, [0.99, 0.01], 0), (21, [2.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in rpforest.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (4, 0) for i in range(5)} | {10 + i: (3, 10) for i in range(3)} | {20: (3, 10), 21: (0, 21)}


def test_forest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, []), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0]), (None, [1.0, 0.0]), (11, [3e38, 1e30]), (12, [0.0, 5.0])]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA)
    out = rpforest.near_duplicates(df).collect()
    assert len(out) == len(rows)
    linked = {r.vec_id: (r.n_links, r.component_id) for r in out}
    # 1, 2, 10 twice, the row without an id and 11 point the same way: five others each.
    assert {linked[i] for i in (1, 2, 10, None, 11)} == {(5, 1)}
    assert all(linked[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 12))
    assert rpforest.near_duplicates(df.limit(0)).count() == 0
    assert rpforest.near_duplicates(df.filter(F.col("vec_id") == 4)).collect()[0].n_links == 0


def test_repeated_ids_with_different_texts_stay(docs_of):
    """A clean text under another's id is kept, and does not tie the groups of its id's texts together."""
    (_, a), (_, b), (_, c) = [(i, " ".join(f"{w}{i}{n}" for n in range(60))) for i, w in enumerate(("ab", "cd", "ef"))]
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(5, a), (5, b), (5, b), (6, near), (7, c), (8, b), (None, a)]
    got = sorted(((r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs_of(rows)).collect()), key=str)
    near_a = (simhash.fingerprint(a) ^ simhash.fingerprint(near)).bit_count() <= 4
    assert got == sorted([(5, a), (5, b), (7, c), (None, a), *([] if near_a else [(6, near)])], key=str)


def test_components_of_a_hub(spark):
    """Half of all edges at one node, and a chain: the hub's edges go through joins that can be split."""
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(10_000, 10_040)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {i: 0 for i in range(3000)} | {i: 10_000 for i in range(10_000, 10_041)}
