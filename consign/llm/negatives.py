"""Hard-negative mining over a GNAT-style multiway hyperplane tree (operator 12).

Vectors are rounded down to integers, so every score is an exact integer inner
product.  The tree: a node has up to ``SPLITS`` split points far apart from each other,
every vector below it belongs to the nearest one (a hyperplane lies between any two),
and for each split point the least and greatest distance to the vectors of every
sibling's subtree is stored, and each subtree's least and greatest norm.  The root's
split points come from a bounded sample; its subtrees are cut into shards of at most
``SHARD`` vectors, and a task grows the rest of the tree for each shard.  Leaves are
compared exactly, by matrix product.

A query looks for the ``k`` highest scores in a window from ``low`` to ``high``.  As
|a - x|^2 = |a|^2 + |x|^2 - 2 a.x, a window of scores is an annulus of distances around the
anchor; a subtree goes if the ranges stored at any of its split points, shifted by the
anchor's own distance to it, cannot meet that annulus.  ``low`` rises to the
k-th score found so far.

``mine`` takes anchors in blocks of at most about ``BLOCK`` numbers against all shards: first
their positives (same label, no upper end), then for every positive the window of
its negatives.  A task keeps the best of each query over all its shards; the tasks' bests are merged.

Defined cases: rows with a null id, label or vector, or a component that is null or not
finite (also once scaled), take no part; of rows sharing an id the least by (label, vector)
does; vectors of different length are never compared, and empty ones all score 0;
equal scores go by ascending id; equal vectors stay in one leaf of at most a shard's size;
scores beyond 2**53 are computed with exact integers, without the tree, and held to 64 bits; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import drop_scratch, scratch_table, ship_package

SPLITS, LEAF = 16, 128
ROOT_SPLITS, SAMPLE, SAMPLE_WIDTH = 32, 2048, 1024
SHARD, SHARD_NUMBERS = 4096, 1 << 20
BLOCK = 1 << 19        # numbers of a block of anchors
CELLS = 1 << 20        # scores held at once
LEAST, MOST = -(1 << 63), (1 << 63) - 1
EXACT = float(1 << 53)


def far_points(x: np.ndarray, k: int) -> np.ndarray:
    """Places of up to ``k`` different vectors, each far from those before it."""
    chosen = [0]
    near = distances(x, x[:1])[:, 0]
    while len(chosen) < k:
        i = int(near.argmax())
        if near[i] <= 0:
            break
        chosen.append(i)
        near = np.minimum(near, distances(x, x[i:i + 1])[:, 0])
    return np.array(chosen)


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Euclidean, from every row of ``x`` to every row of ``p``."""
    d = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * (x @ p.T)
    return np.sqrt(np.maximum(d, 0))


def is_small(x: np.ndarray) -> bool:
    """Whether all squared distances and inner products are exact in doubles."""
    top = np.abs(x).max() if x.size else 0.0
    return 4 * top * top * max(1, x.shape[1]) < EXACT


@dataclass
class Tree:
    """Nodes in preorder: a node's vectors are the rows from ``start`` to ``stop``, its children ``kids`` nodes
    that ``first`` lists; ``lo`` and ``hi`` are kids x kids ranges, end to end."""

    start: np.ndarray
    stop: np.ndarray
    kids: np.ndarray
    child: np.ndarray   # nodes' children, end to end
    split: np.ndarray   # the children's split points, as rows
    lo: np.ndarray
    hi: np.ndarray
    least: np.ndarray   # squared norms of a node's vectors
    most: np.ndarray


def grow(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, Tree]:
    """(order of the rows, tree over the rows in that order)."""
    start, stop, kids, child, split, lo, hi = [], [], [], [], [], [], []
    order, norm = [], (x * x).sum(axis=1)
    split_of: dict[int, np.ndarray] = {}  # by node, as rows of ``x``
    children_of: dict[int, list[int]] = {}
    ranges_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def node(rows: np.ndarray) -> int:
        me = len(start)
        start.append(len(order))
        stop.append(0)
        parts = None
        if len(rows) > LEAF and is_small(x):
            step = max(1, len(rows) // (4 * SPLITS))
            some = rows[::step]
            points = some[far_points(x[some], SPLITS)]
            if len(points) > 1:
                d = distances(x[rows], x[points])
                home = d.argmin(axis=1)
                members = [home == i for i in range(len(points))]
                used = [i for i, m in enumerate(members) if m.any()]
                if len(used) > 1:
                    parts = [rows[members[i]] for i in used]
                    split_of[me] = points[used]
                    d = d[:, used]
                    ranges_of[me] = (np.array([d[members[i]].min(axis=0) for i in used]).T,
                                     np.array([d[members[i]].max(axis=0) for i in used]).T)
        if parts is None:
            order.extend(rows[np.argsort(ids[rows], kind="stable")].tolist())
        else:
            children_of[me] = [node(p) for p in parts]
        stop[me] = len(order)
        return me

    node(np.arange(len(x)))
    order = np.array(order, dtype=np.int64)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    for me in range(len(start)):
        own = children_of.get(me, [])
        kids.append(len(own))
        child += own
        if own:
            split += place[split_of[me]].tolist()
            lo.append(ranges_of[me][0].ravel())
            hi.append(ranges_of[me][1].ravel())
    norm = norm[order]
    none = np.zeros(0)
    return order, Tree(np.array(start), np.array(stop), np.array(kids), np.array(child, dtype=np.int64),
                       np.array(split, dtype=np.int64), np.concatenate(lo or [none]), np.concatenate(hi or [none]),
                       np.array([norm[a:b].min() for a, b in zip(start, stop)]),
                       np.array([norm[a:b].max() for a, b in zip(start, stop)]))


def pack(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, root: np.ndarray) -> bytes:
    """A shard as bytes: its vectors in the tree's order, the tree, and its ranges to the root's split points."""
    order, tree = grow(x, ids)
    ids, labels, x = ids[order], labels[order], x[order]
    if len(root) and is_small(np.concatenate([x, root])):
        d = distances(x, root)
        ranges = np.array([d.min(axis=0), d.max(axis=0)])
    else:
        ranges = np.zeros((2, 0))
    out = io.BytesIO()
    narrow = x.astype(np.float32)
    np.savez(out, ids=ids, labels=labels, x=narrow if np.array_equal(narrow, x) else x, ranges=ranges, **vars(tree))
    return out.getvalue()


class Searcher:
    """Queries of one length against shard after shard.

    ``vectors``, ``ids`` and ``labels`` are the anchors'; a query has its anchor's place ``of``, a window
    from ``low`` to ``high``, and wants rows of the same or of another label.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, of: np.ndarray, low: np.ndarray,
                 high: np.ndarray, same: bool, k: int, root: np.ndarray) -> None:
        self.v, self.ids, self.labels, self.of, self.high, self.same, self.k = vectors, ids, labels, of, high, same, k
        self.low, self.root, self.small = low.copy(), root, is_small(vectors)
        self.norm = (vectors * vectors).sum(axis=1)
        self.scores = np.full((len(of), k), LEAST)
        self.found = np.full((len(of), k), MOST)
        self.root_d = distances(vectors, root) if len(root) and self.small and is_small(root) else None
        self.seen = 0  # scores computed

    def shard(self, blob: bytes) -> None:
        z = np.load(io.BytesIO(blob))
        self.x, self.x_ids, self.x_labels = z["x"].astype(np.float64), z["ids"], z["labels"]
        self.tree = t = Tree(**{f: z[f] for f in Tree.__dataclass_fields__})
        self.exact = not (self.small and is_small(self.x))
        self.kids_at = np.concatenate([[0], np.cumsum(t.kids)])
        self.range_at = np.concatenate([[0], np.cumsum(t.kids * t.kids)])
        active = np.arange(len(self.of))
        ranges = z["ranges"]
        if self.root_d is not None and ranges.shape[1] == len(self.root) and not self.exact:
            keep = self.meets(self.root_d[self.of], ranges[0][:, None], ranges[1][:, None], t.least[:1], t.most[:1], active)
            active = active[keep[:, 0]]
        if len(active):
            self.node(0, active)

    def meets(self, d: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray,
              active: np.ndarray) -> np.ndarray:
        """Whether each query's window can meet each subtree, by the query's distances ``d`` to the split points
        and the split points' ranges to the subtrees (split points x subtrees)."""
        near = np.zeros((len(d), lo.shape[1]))
        far = np.full((len(d), lo.shape[1]), np.inf)
        for i in range(len(lo)):
            own = d[:, i:i + 1]
            near = np.maximum(near, np.maximum(lo[i] - own, own - hi[i]))
            far = np.minimum(far, own + hi[i])
        norm = self.norm[self.of[active]][:, None]
        slack = 1e-9 * (norm + most) + 1e-6
        top, bottom = (norm + most - near * near) / 2 + slack, (norm + least - far * far) / 2 - slack
        return (top >= self.low[active][:, None]) & (bottom <= self.high[active][:, None])

    def node(self, n: int, active: np.ndarray) -> None:
        t = self.tree
        if not t.kids[n] or self.exact:
            self.leaf(int(t.start[n]), int(t.stop[n]), active)
            return
        k, at = int(t.kids[n]), int(self.kids_at[n])
        of, inverse = np.unique(self.of[active], return_inverse=True)
        d = distances(self.v[of], self.x[t.split[at:at + k]])[inverse]
        r = slice(int(self.range_at[n]), int(self.range_at[n + 1]))
        lo, hi = t.lo[r].reshape(k, k), t.hi[r].reshape(k, k)
        child = t.child[at:at + k]
        for j in np.argsort(d.mean(axis=0)).tolist():
            c = child[j:j + 1]
            # Asked again for each child, as the children before it have raised ``low``.
            keep = self.meets(d, lo[:, j:j + 1], hi[:, j:j + 1], t.least[c], t.most[c], active)[:, 0]
            if keep.any():
                self.node(int(c[0]), active[keep])

    def leaf(self, a: int, b: int, active: np.ndarray) -> None:
        step = max(1, CELLS // (b - a))
        for i in range(0, len(active), step):
            self.compare(a, b, active[i:i + step])

    def products(self, of: np.ndarray, a: int, b: int) -> np.ndarray:
        if not self.exact:
            return (self.v[of] @ self.x[a:b].T).astype(np.int64)
        whole = [[int(y) for y in row] for row in self.x[a:b].tolist()]
        return np.array([[min(max(sum(p * q for p, q in zip(anchor, row)), LEAST + 1), MOST) for row in whole]
                         for anchor in ([int(y) for y in r] for r in self.v[of].tolist())], dtype=np.int64)

    def compare(self, a: int, b: int, q: np.ndarray) -> None:
        of, inverse = np.unique(self.of[q], return_inverse=True)
        s = self.products(of, a, b)[inverse]
        self.seen += len(of) * (b - a)
        equal = self.labels[self.of[q]][:, None] == self.x_labels[None, a:b]
        good = (equal if self.same else ~equal) & (s >= self.low[q][:, None]) & (s <= self.high[q][:, None])
        good &= self.ids[self.of[q]][:, None] != self.x_ids[None, a:b]
        hit = good.any(axis=1)
        if not hit.any():
            return
        q, s, good = q[hit], s[hit], good[hit]
        s = np.concatenate([self.scores[q], np.where(good, s, LEAST)], axis=1)
        ids = np.concatenate([self.found[q], np.where(good, self.x_ids[a:b], MOST)], axis=1)
        top = np.lexsort((ids, ~s), axis=1)[:, :self.k]  # ~s falls as s rises, and no value overflows
        self.scores[q], self.found[q] = np.take_along_axis(s, top, 1), np.take_along_axis(ids, top, 1)
        self.low[q] = np.maximum(self.low[q], self.scores[q, -1])


def prepared(rows: DataFrame, scale: int, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(vec_id, label, v, dim) of the rows that take part, one a vec_id; ``v`` is scaled and not yet rounded."""
    scaled = F.transform(F.col(vector_col), lambda x: x.cast("double") * F.lit(float(scale)))  # floored where it is read
    fine = F.forall(scaled, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                       F.when(fine, scaled).alias("v")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row"))
    return rows.select("vec_id", "row.label", "row.v", F.size("row.v").alias("dim"))


def _arrays(b: pa.RecordBatch, at: int) -> np.ndarray:
    return np.floor(b.column(at).flatten().to_numpy())


@dataclass
class Index:
    path: str
    root: dict[int, np.ndarray]  # by length, the root's split points


def build(rows: DataFrame, path: str | None = None) -> Index:
    """The tree over prepared rows, as a table (dim, shard, n, data) in ``path`` (a fresh scratch folder if not given)."""
    spark = rows.sparkSession
    path = path or scratch_path(spark, "gnat-index")
    sample = (rows.filter(F.col("dim") <= SAMPLE_WIDTH).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
              .select("dim", "v").collect())
    root: dict[int, np.ndarray] = {}
    for dim in {r.dim for r in sample} - {0}:
        x = np.floor(np.array([r.v for r in sample if r.dim == dim], dtype=np.float64))
        root[dim] = x[far_points(x, ROOT_SPLITS)] if is_small(x) else np.zeros((0, dim))
    shared = spark.sparkContext.broadcast(root)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim = b.column(3).to_numpy()
            cell, at, values = np.zeros(len(dim), dtype=np.int32), np.concatenate([[0], np.cumsum(dim)]), _arrays(b, 2)
            for d in np.unique(dim).tolist():
                own = np.flatnonzero(dim == d)
                points = shared.value.get(d)
                if points is None or len(points) < 2 or not d:
                    continue
                for i in range(0, len(own), step := max(1, CELLS // (d + len(points)))):
                    part = own[i:i + step]
                    x = values[at[part][:, None] + np.arange(d)]
                    if is_small(x):
                        cell[part] = distances(x, points).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], ["vec_id", "label", "v", "dim", "cell"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now, held, size = TaskContext.get().partitionId() << 32, None, [], 0

        def shard() -> pa.RecordBatch:
            ids, labels, x = (np.concatenate(c) for c in zip(*held))
            data = pack(ids, labels, x, shared.value.get(now[0], np.zeros((0, now[0]))))
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([number]), pa.array([len(ids)]),
                                               pa.array([data], pa.binary())], ["dim", "shard", "n", "data"])

        for b in batches:
            dim, cell, values = b.column(3).to_numpy(), b.column(4).to_numpy(), _arrays(b, 2)
            at = np.concatenate([[0], np.cumsum(dim)])
            i = 0
            while i < len(dim):
                key = int(dim[i]), int(cell[i])
                most = max(1, min(SHARD, SHARD_NUMBERS // max(1, key[0])))
                if held and (key != now or size >= most):
                    yield shard()
                    number, held, size = number + 1, [], 0
                now = key
                other = np.flatnonzero((dim[i:] != key[0]) | (cell[i:] != key[1]))
                j = min(i + (int(other[0]) if len(other) else len(dim) - i), i + most - size)
                held.append((b.column(0).to_numpy()[i:j], b.column(1).to_numpy()[i:j],
                             values[at[i]:at[j]].reshape(j - i, key[0])))
                i, size = j, size + j - i
        if held:
            yield shard()

    order = ["dim", "cell", "h"]
    (rows.mapInArrow(home, "vec_id long, label long, v array<double>, dim int, cell int")
     .withColumn("h", F.xxhash64("vec_id")).repartitionByRange(*order).sortWithinPartitions(*order)
     .mapInArrow(shards, "dim int, shard long, n long, data binary").write.parquet(path))
    return Index(path, root)


def search(table: DataFrame, root: dict[int, np.ndarray], queries: dict[int, dict], k: int) -> DataFrame:
    """(dim, q, score, vec_id): every task's ``k`` best of each query over its shards; ``queries``: by length, the
    ``Searcher``'s arguments."""
    shared = table.sparkSession.sparkContext.broadcast({d: (q, root.get(d, np.zeros((0, d)))) for d, q in queries.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers: dict[int, Searcher] = {}
        for b in batches:
            for i in range(b.num_rows):
                d = b.column(0)[i].as_py()
                if d not in shared.value:
                    continue
                if d not in searchers:
                    q, points = shared.value[d]
                    searchers[d] = Searcher(**q, k=k, root=points)
                searchers[d].shard(b.column(1)[i].as_py())
        for d, s in searchers.items():
            q, at = np.nonzero(s.scores != LEAST)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), d, dtype=np.int32)), pa.array(q),
                                              pa.array(s.scores[q, at]), pa.array(s.found[q, at])], ["dim", "q", "score", "vec_id"])

    found = table.select("dim", "data").mapInArrow(run, "dim int, q long, score long, vec_id long")
    order = Window.partitionBy("dim", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, of: int = 100,
         scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor (a condition on ``vec_id``) the ``positives`` highest-scoring other rows of its label, and for each of
    these the ``negatives`` highest-scoring rows of other labels with low * positive <= of * negative <= of * positive.
    """
    spark = rows.sparkSession
    ship_package(spark)
    rows, rows_path = scratch_table(prepared(rows, scale, id_col, vector_col, F.col("label") if label is None else label), "gnat-rows")
    index = build(rows)
    table = spark.read.schema("dim int, shard long, n long, data binary").parquet(index.path)
    asked = rows.filter(anchors)
    numbers = asked.agg(F.sum(F.col("dim") + 1)).first()[0] or 0
    blocks = -(-numbers // BLOCK)
    out, out_path = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
                     scratch_path(spark, "negatives"))
    spark.createDataFrame([], out).write.parquet(out_path)
    for i in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id").collect()
        by_dim: dict[int, dict] = {}
        for d in sorted({r.dim for r in block}):
            own = [r for r in block if r.dim == d]
            n = len(own)
            by_dim[d] = {"vectors": np.floor(np.array([r.v for r in own], dtype=np.float64).reshape(n, d)),
                         "ids": np.array([r.vec_id for r in own]), "labels": np.array([r.label for r in own]),
                         "of": np.arange(n), "low": np.full(n, LEAST + 1), "high": np.full(n, MOST), "same": True}
        found = search(table, index.root, by_dim, positives).collect()  # a few rows for each anchor of the block
        windows, pairs = {}, []
        for d, q in by_dim.items():
            own = [(r.q, r.vec_id, r.score) for r in found if r.dim == d and r.score >= 0]
            if own:
                score = [s for _, _, s in own]
                windows[d] = q | {"of": np.array([a for a, _, _ in own]), "same": False, "high": np.array(score),
                                  "low": np.array([-(-low * s // of) for s in score])}
                pairs += [(d, j, int(q["ids"][a]), p, s) for j, (a, p, s) in enumerate(own)]
        if windows:
            names = spark.createDataFrame(pairs, "dim int, q long, anchor_id long, positive_id long, positive_score long")
            (search(table, index.root, windows, negatives).join(F.broadcast(names), ["dim", "q"])
             .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                     F.col("score").alias("negative_score"))
             .write.mode("append").parquet(out_path))
    drop_scratch(spark, rows_path, index.path)
    return spark.read.schema(out).parquet(out_path)
