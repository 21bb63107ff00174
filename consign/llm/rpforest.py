"""Embedding near-duplicates with a forest of random projections (operator 2).

Vectors link when their cosine, in double precision, is at least ``threshold``.

Equal vectors collapse to one class first.  Each tree splits the classes again and
again by a random projection, at the middle of a bounded sample's values; the
vectors within ``spill`` of the middle (as a share of the sample, on either side) go
to both sides.  A part stops splitting at ``leaf`` classes.  A sample is too
coarse for a deep tree, so parts that are still too large are split further
in rounds, each with a sample of its own and in chunks of bounded size.

Inside a leaf all pairs are compared by blocks of a matrix product.  No pair is
emitted: a leaf gives, for each member, its number of links and the smallest member it
is tied to.  A pair that shares several leaves is counted in the smallest of them
only; for that, every member carries the (few) numbers of its leaves.

Splits near the median cut a dense group, however large, so dense groups do not go through
the trees.  In a bounded sample, a vector stands in a dense place if its links there
stand for more than ``dense`` classes (and are ``LEAST`` at least).  The table's sample shows the largest
groups; the others come to rule the parts they fall in, and every part that is too large is
searched by a sample of its own before it is split further.  Such vectors are covered by
pivots: the ones with most links first, until each links with a pivot.  A class that links
with a pivot is in the cell of its nearest one; everything it links with is within twice the
threshold's angle of that pivot, by the triangle inequality.  So every cell is compared with all
classes that near, in blocks that hold ``block`` of the cell's members; blocks whose angles
to the pivot settle that all pairs link, or none, are counted without a product.  This finds all
links of the cells' members.  The trees hold the other classes only.

Recall: links of a cell's members are exact.  Two other vectors are missed if every tree parts them;
where the data spread far beyond the threshold's angle, a split does that to about 1 in 100 at the
threshold, beyond the spill band.  The tests measure recall against brute force, also of a group that the
table's sample does not show.

Defined cases: a vector that is null, zero, or holds null or non-finite numbers
links with nothing and is its own component; vectors link with others of their length only, each length
with a forest of its own, or, if it has few classes, by all pairs; repeated rows link with each other;
a null id is never a component's smallest and is not kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_scratch, forest, group_runs, is_empty, scratch_table, ship_package


@dataclass(frozen=True)
class Params:
    threshold: float = 0.95
    trees: int = 6
    leaf: int = 1024
    spill: float = 0.08
    sample: int = 16_384  # vectors that a round's splits are fitted on, for a node, and at most
    numbers: int = 1 << 22  # numbers in them, so that a sample is 32 MB whatever the vectors' length
    chunk: int = 65_536  # rows of one node that a task routes at a time
    dense: int = 512  # links (of classes) from which a vector is compared by cells
    block: int = 4096  # members of a cell that a task compares at a time
    seed: int = 11


LEAST = 8
FEW, FEW_NUMBERS = 1024, 1 << 22  # classes of one length, and numbers in them, that are compared without a forest
SLACK = 1e-6  # of an angle in radians; far above rounding


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision and without overflow."""
    v = np.asarray(vectors, dtype=np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def matrix(col: pa.Array) -> np.ndarray:
    return unit(col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1))


def grow(v: np.ndarray, rows: float, leaf: int, spill: float, rng: np.random.Generator) -> tuple | None:
    """A tree over the sample ``v`` that stands for ``rows`` rows: None for a leaf, or
    (direction, lower bound of the right side, upper bound of the left, left, right)."""
    if rows <= leaf or len(v) < 32:
        return None
    d = rng.standard_normal(v.shape[1])
    x = v @ d
    low, high = np.quantile(x, [0.5 - spill, 0.5 + spill])
    left, right = v[x <= high], v[x >= low]
    if len(left) == len(v) or len(right) == len(v):
        return None
    return (d, low, high, grow(left, rows * len(left) / len(v), leaf, spill, rng),
            grow(right, rows * len(right) / len(v), leaf, spill, rng))


def route(tree: tuple | None, v: np.ndarray, at: np.ndarray, path: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf's path, its rows) for the rows ``at`` of ``v``; a row may be in several leaves."""
    if tree is None:
        yield path, at
        return
    d, low, high, left, right = tree
    x = v[at] @ d
    yield from route(left, v, at[x <= high], 2 * path)
    yield from route(right, v, at[x >= low], 2 * path + 1)


def _leaf_ids(node: int, paths: np.ndarray) -> np.ndarray:
    """Numbers for the leaves below a node; 63 bits of a hash."""
    h = (paths.astype(np.uint64) + np.uint64(node & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


def _routed(tree, node: int, cid: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [(p, at) for p, at in route(tree, v, np.arange(len(v))) if len(at)]
    paths = np.repeat(np.array([p for p, _ in found], dtype=np.uint64), [len(at) for _, at in found])
    return cid[np.concatenate([at for _, at in found])], _leaf_ids(node, paths)


def first_round(classes: DataFrame, rows: int, o: Params) -> DataFrame:
    """(cid, leaf): every class in the leaves of all trees, as far as one bounded sample can split."""
    sample = classes.orderBy(F.xxhash64("cid"), "cid").limit(o.sample).select("vec").toPandas()["vec"]
    v = unit(np.array(sample.tolist())) if len(sample) else np.zeros((0, 1))
    trees = [grow(v, rows, o.leaf, o.spill, np.random.default_rng([o.seed, t])) for t in range(o.trees)]
    shared = classes.sparkSession.sparkContext.broadcast(trees)  # at most sample / 16 directions a tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cid, v = b.column(0).to_numpy(), matrix(b.column(1))
                for t, tree in enumerate(shared.value):
                    c, leaf = _routed(tree, t + 1, cid, v)
                    yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(leaf)], ["cid", "leaf"])

    return classes.select("cid", "vec").mapInArrow(run, "cid long, leaf long")


def next_round(classes: DataFrame, placed: DataFrame, large: DataFrame, o: Params) -> DataFrame:
    """(cid, leaf) with the members of the ``large`` leaves (leaf, n) split further."""
    members = placed.join(large, "leaf").join(classes.select("cid", "vec"), "cid").select("leaf", "n", "cid", "vec")
    share = F.pmod(F.xxhash64("cid", "leaf"), F.lit(1 << 20)) < F.col("n").cast("double") ** -1 * (o.sample << 20)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, n = int(pdf["leaf"].iloc[0]), int(pdf["n"].iloc[0])
        v = unit(np.array(pdf.sort_values("cid")["vec"].tolist()))
        tree = grow(v, n, o.leaf, o.spill, np.random.default_rng([o.seed, leaf]))
        return pd.DataFrame({"leaf": [leaf], "n": [n], "tree": [pickle.dumps(tree)]})

    fitted = members.filter(share).groupBy("leaf").applyInPandas(fit, "leaf long, n long, tree binary")
    chunks = F.ceil(F.col("n") / F.lit(o.chunk))
    fitted = fitted.select("leaf", "tree", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))
    members = members.select("leaf", "cid", "vec", F.pmod(F.xxhash64("cid"), chunks).alias("chunk"))

    def split(key, rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"cid": [], "leaf": []}, dtype=np.int64)
        tree = pickle.loads(trees["tree"].iloc[0]) if len(trees) else None
        cid, leaf = _routed(tree, int(key[0]), rows["cid"].to_numpy(), unit(np.array(rows["vec"].tolist())))
        return pd.DataFrame({"cid": cid, "leaf": leaf})

    done = members.groupBy("leaf", "chunk").cogroup(fitted.groupBy("leaf", "chunk")).applyInPandas(split, "cid long, leaf long")
    return placed.join(large, "leaf", "left_anti").select("cid", "leaf").union(done)


def place(classes: DataFrame, o: Params) -> tuple[DataFrame | None, str | None, tuple[np.ndarray, np.ndarray] | None]:
    """The written (cid, leaf) with no leaf over twice ``leaf``, unless it can't be split, and its path.

    Before a large leaf is split further it is searched for dense places; if it has any, their pivots are returned
    alone: their cells have to be taken out first.
    """
    spark = classes.sparkSession
    placed, path = scratch_table(first_round(classes, classes.count(), o), "forest-0")
    most = None
    while True:
        sizes = placed.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * o.leaf)
        large, large_path = scratch_table(sizes, "forest-large")
        now = large.agg(F.count("*"), F.max("n")).first()
        if is_empty(large) or tuple(now) == most:
            drop_scratch(spark, large_path)
            return placed, path, None
        found = node_pivots(classes, placed, large, o)
        if len(found[0]):
            drop_scratch(spark, path, large_path)
            return None, None, found
        most = tuple(now)
        nxt, nxt_path = scratch_table(next_round(classes, placed, large, o), "forest")
        drop_scratch(spark, path, large_path)
        placed, path = nxt, nxt_path


def compare(leaf: int, v: np.ndarray, n: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links that are counted here, smallest member tied to) for each member of a leaf."""
    m = len(v)
    links, low = np.zeros(m, dtype=np.int64), np.arange(m)
    step = max(1, (1 << 20) // m)
    for a in range(0, m, step):
        i, j = np.nonzero(v[a:a + step] @ v[a:].T >= threshold)
        i, j = i + a, j + a
        i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        low = forest(m, np.r_[i, np.arange(m)], np.r_[j, low])
        for b in range(0, len(i), 1 << 15):
            x, y = i[b:b + (1 << 15)], j[b:b + (1 << 15)]
            shared = (sig[x][:, :, None] == sig[y][:, None, :]) & (sig[x] < leaf)[:, :, None]
            first = ~shared.any(axis=(1, 2))
            np.add.at(links, x[first], n[y[first]])
            np.add.at(links, y[first], n[x[first]])
    return links, low


def leaf_links(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in group_runs(batches, ["leaf"]):
            if len(g["cid"]) < 2:
                continue
            width = max(map(len, g["sig"]))
            sig = np.full((len(g["cid"]), width), -1, dtype=np.int64)
            for r, s in enumerate(g["sig"]):
                sig[r, :len(s)] = s
            sig[sig < 0] = (1 << 62) * 2 - 1  # no leaf is that large, so it is never below the leaf
            links, low = compare(int(g["leaf"][0]), unit(np.array(g["vec"].tolist())), g["n"], sig, threshold)
            tied = (links > 0) | (low != np.arange(len(low)))
            yield pd.DataFrame({"cid": g["cid"][tied], "links": links[tied], "root": g["cid"][low[tied]]})
    return run


def cover(v: np.ndarray, rows: int, o: Params) -> tuple[np.ndarray, np.ndarray]:
    """(places, links) of vectors of the sample ``v`` that cover its dense places; it stands for ``rows`` classes."""
    if not len(v):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    step = max(1, (1 << 20) // len(v))
    links = np.concatenate([(v[a:a + step] @ v.T >= o.threshold).sum(axis=1) for a in range(0, len(v), step)]) - 1
    order = np.argsort(-links, kind="stable")
    order = order[links[order] >= max(LEAST, o.dense * len(v) / rows)]
    covered, chosen = np.zeros(len(v), dtype=bool), []
    for i in order.tolist():
        if not covered[i]:
            chosen.append(i)
            covered |= v @ v[i] >= o.threshold
            covered[i] = True
    return np.array(chosen, dtype=np.int64), links[chosen]


def pivots(classes: DataFrame, rows: int, o: Params) -> tuple[np.ndarray, np.ndarray]:
    """(cid, unit vector) of classes that cover the dense places of one bounded sample."""
    pdf = classes.orderBy(F.xxhash64("cid"), "cid").limit(o.sample).select("cid", "vec").toPandas()
    if not len(pdf):
        return np.zeros(0, dtype=np.int64), np.zeros((0, 1))
    cid, v = pdf["cid"].to_numpy(), unit(np.array(pdf["vec"].tolist()))
    chosen, _ = cover(v, rows, o)
    return cid[chosen], v[chosen]


def node_pivots(classes: DataFrame, placed: DataFrame, large: DataFrame, o: Params) -> tuple[np.ndarray, np.ndarray]:
    """(cid, unit vector) of classes that cover the dense places of the ``large`` leaves, each by a sample of its own.

    At most ``o.sample`` of them, those with most links first; what they leave is looked at again after
    their cells are done.  Leaves of several trees show a place several times; one pivot stays.
    """
    members = placed.join(large, "leaf").join(classes.select("cid", "vec"), "cid").select("leaf", "n", "cid", "vec")
    share = F.pmod(F.xxhash64("cid", "leaf"), F.lit(1 << 20)) < F.col("n").cast("double") ** -1 * (o.sample << 20)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        n = int(pdf["n"].iloc[0])
        chosen, links = cover(unit(np.array(pdf["vec"].tolist())), n, o)
        own = pdf.iloc[chosen]
        return pd.DataFrame({"cid": own["cid"], "vec": own["vec"], "links": links * n // len(pdf)})

    kind = classes.schema["vec"].dataType.simpleString()
    found = members.filter(share).groupBy("leaf").applyInPandas(find, f"cid long, vec {kind}, links long")
    top = found.orderBy(F.desc("links"), "cid").limit(o.sample).toPandas()
    if not len(top):
        return np.zeros(0, dtype=np.int64), np.zeros((0, 1))
    cid, v = top["cid"].to_numpy(), unit(np.array(top["vec"].tolist()))
    covered, chosen = np.zeros(len(v), dtype=bool), []
    for i in range(len(v)):
        if not covered[i]:
            chosen.append(i)
            covered |= v @ v[i] >= o.threshold
            covered[i] = True
    return cid[chosen], v[chosen]


def cells(classes: DataFrame, cid: np.ndarray, v: np.ndarray, o: Params) -> DataFrame:
    """(cell, core, hot, cid, n, vec): every class with each pivot that one of its links may be in the cell of.

    ``core``: it is in that cell; ``hot``: it is in a cell.
    """
    shared = classes.sparkSession.sparkContext.broadcast((cid, v))
    reach = np.cos(min(2 * np.arccos(np.clip(o.threshold, -1, 1)) + SLACK, np.pi)) - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid, v = shared.value
        for b in batches:
            for at in range(0, b.num_rows, step := max(1, (1 << 22) // v.size)):
                part = b.slice(at, step)
                x = matrix(part.column(2)) @ v.T
                home = x.argmax(axis=1)
                hot = x[np.arange(len(x)), home] >= o.threshold
                row, cell = np.nonzero(x >= reach)
                if len(row):
                    cols = [pa.array(cid[cell]), pa.array(hot[row] & (home[row] == cell)), pa.array(hot[row])]
                    yield pa.RecordBatch.from_arrays(cols + part.take(pa.array(row)).columns,
                                                     ["cell", "core", "hot", "cid", "n", "vec"])

    kind = classes.schema["vec"].dataType.simpleString()
    return classes.select("cid", "n", "vec").mapInArrow(
        run, f"cell long, core boolean, hot boolean, cid long, n long, vec {kind}")


def count_links(core: np.ndarray, angle: np.ndarray, n: np.ndarray, v: np.ndarray, near: np.ndarray, m: np.ndarray,
                threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (sums of ``m`` and of ``n``) between the members ``core`` of a cell, in ascending order of their ``angle``
    to the pivot, and the vectors ``v``, at the angle ``near`` to it."""
    most = np.arccos(np.clip(threshold, -1, 1))
    mine, other = np.zeros(len(core)), np.zeros(len(v))
    order = np.argsort(near)
    step = max(1, (1 << 20) // len(core))
    for a in range(0, len(v), step):
        at = order[a:a + step]
        all_link = np.searchsorted(angle, most - SLACK - near[at[-1]])
        first = max(all_link, np.searchsorted(angle, near[at[0]] - most - SLACK))
        mine[:all_link] += m[at].sum()
        other[at] += n[:all_link].sum()
        if first < len(core):
            x = core[first:] @ v[at].T
            np.greater_equal(x, threshold, out=x)
            mine[first:] += x @ m[at]
            other[at] += n[first:] @ x
    return mine, other


def cell_links(pivot: dict[int, np.ndarray], threshold: float):
    """Links of the rows (cell, chunk, near, cid, hot, n, vec) in that order; a chunk's members come first (near = 0)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, core = None, [], None

        def ended() -> Iterator[pd.DataFrame]:
            if core is not None:
                cid, _, _, n, links = core  # a member met itself among the near ones
                yield pd.DataFrame({"cid": cid, "links": (links - n).astype(np.int64), "root": np.full(len(cid), key[0])})

        for pdf in batches:
            for k, g in pdf.groupby(["cell", "chunk", "near"], sort=False):
                if k[:2] != key:
                    yield from ended()
                    key, held, core = k[:2], [], None
                if k[2] == 0:
                    held.append(g)
                    continue
                if core is None:
                    if not held:
                        continue
                    c = pd.concat(held, ignore_index=True)
                    v = unit(np.array(c["vec"].tolist()))
                    angle = np.arccos(np.clip(v @ pivot.value[key[0]], -1, 1))
                    at = np.argsort(angle)
                    core = (c["cid"].to_numpy()[at], v[at], angle[at], c["n"].to_numpy(dtype=np.float64)[at], np.zeros(len(c)))
                    held = []
                v = unit(np.array(g["vec"].tolist()))
                near = np.arccos(np.clip(v @ pivot.value[key[0]], -1, 1))
                mine, other = count_links(core[1], core[2], core[3], v, near, g["n"].to_numpy(dtype=np.float64), threshold)
                core[4][:] += mine
                cold = (other > 0) & ~g["hot"].to_numpy(dtype=bool)
                if cold.any():
                    yield pd.DataFrame({"cid": g["cid"].to_numpy()[cold], "links": other[cold].astype(np.int64),
                                        "root": np.full(int(cold.sum()), key[0])})
        yield from ended()
    return run


def dense_links(near: DataFrame, cid: np.ndarray, v: np.ndarray, o: Params) -> DataFrame:
    """(cid, links, root) for all links that a member of a cell has part in; ``near`` as from ``cells``."""
    chunks = near.groupBy("cell").agg(F.ceil(F.sum(F.col("core").cast("long")) / F.lit(o.block)).alias("chunks"))
    near = near.join(F.broadcast(chunks), "cell").filter("chunks > 0")  # a row for each pivot
    rest = ("cid", "hot", "n", "vec")
    members = near.filter("core").select("cell", F.pmod(F.xxhash64("cid"), "chunks").alias("chunk"), F.lit(0).alias("near"), *rest)
    others = near.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"),
                         F.lit(1).alias("near"), *rest)
    pivot = near.sparkSession.sparkContext.broadcast(dict(zip(cid.tolist(), v)))
    return (members.union(others).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "near", "cid")
            .mapInPandas(cell_links(pivot, o.threshold), "cid long, links long, root long"))


def forest_links(classes: DataFrame, o: Params) -> DataFrame:
    """(cid, links, root) of the links between ``classes`` (a written table, vectors of one length)."""
    spark = classes.sparkSession
    pivot, at = pivots(classes, classes.count(), o)
    cold, done = classes, []
    while True:
        if len(pivot):
            near, near_path = scratch_table(cells(cold, pivot, at, o), "forest-cells")
            done.append(scratch_table(dense_links(near, pivot, at, o), "cell-links")[0])
            cold, _ = scratch_table(cold.join(near.filter("core").select("cid"), "cid", "left_anti"), "forest-cold")
            drop_scratch(spark, near_path)
        placed, path, found = place(cold, o)
        if found is None:
            break
        pivot, at = found
    sigs = placed.groupBy("cid").agg(F.array_sort(F.collect_set("leaf")).alias("sig"))
    leaves = (cold.join(sigs, "cid").select(F.explode("sig").alias("leaf"), "cid", "n", "vec", "sig")
              .repartition("leaf").sortWithinPartitions("leaf", "cid"))
    parts, _ = scratch_table(leaves.mapInPandas(leaf_links(o.threshold), "cid long, links long, root long"), "leaf-links")
    drop_scratch(spark, path)
    for d in done:
        parts = parts.union(d)
    return parts


def few_links(classes: DataFrame, o: Params) -> DataFrame:
    """The same for classes of lengths that are rare (``FEW``), whose forest would be one leaf: all pairs of a length."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = unit(np.array(pdf["vec"].tolist()))
        links, low = compare(0, v, pdf["n"].to_numpy(), np.zeros((len(pdf), 1), dtype=np.int64), o.threshold)
        cid = pdf["cid"].to_numpy()
        return pd.DataFrame({"cid": cid, "links": links, "root": cid[low]})

    return classes.groupBy(F.size("vec")).applyInPandas(run, "cid long, links long, root long")


def near_duplicates(vectors: DataFrame, o: Params = Params(), id_col: str = "vec_id",
                    vec_col: str = "embedding") -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.col("vec").isNotNull() & (F.size("vec") > 0) & ~bad & F.exists("vec", lambda x: x != 0)
    good = rows.filter(F.coalesce(whole, F.lit(False)))
    classes = good.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes, _ = scratch_table(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    lengths = classes.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("m"))
    # The commonest length, and at most one more for each FEW classes or FEW_NUMBERS numbers of the table.
    common = lengths.agg(F.max(F.struct("m", "dim")).alias("c")).first()["c"]
    many = lengths.filter((F.col("m") > FEW) | (F.col("m") * F.col("dim") > FEW_NUMBERS)).select("dim").collect()
    many = sorted({r.dim for r in many} | ({common["dim"]} if common else set()))
    rare = classes.filter(~F.size("vec").isin(many)) if many else classes
    parts, _ = scratch_table(few_links(rare, o), "few-links")
    for dim in many:
        own, _ = scratch_table(classes.filter(F.size("vec") == dim), "vectors-of-length")
        parts = parts.union(forest_links(own, replace(o, sample=min(o.sample, max(256, o.numbers // dim)))))
    comp = components(parts.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = parts.groupBy("cid").agg(F.sum("links").alias("links"))
    tied = (classes.select("cid", "rep").join(comp, F.col("cid") == F.col("node")).select("cid", "rep", "component")
            .join(links, "cid", "left"))
    tied, _ = scratch_table(tied, "vector-links")
    least = tied.groupBy("component").agg(F.min("rep").alias("least"))
    tied = tied.join(least, "component").select("cid", "links", "least")
    classes = classes.join(tied, "cid", "left").select(
        F.col("vec").alias("_vec"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
        F.coalesce("least", "rep").alias("least"))
    classes, _ = scratch_table(classes, "vector-classes")
    out = rows.join(classes, F.col("vec") == F.col("_vec"), "left")
    component = F.coalesce("least", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
                      component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
