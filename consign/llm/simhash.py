"""SimHash near-duplicates with BK-trees (operator 10).

A fingerprint is 64 bits: bit b is set when it is set in more than half of the
XXH64 hashes (seed 42) of the text's word shingles, repeats included.  Two
texts link when their fingerprints differ in at most ``radius`` bits; the
links' connected components are the near-duplicate groups.

Finding the links without comparing everything:

* equal fingerprints collapse to one representative (the smallest id) first,
  so a group of exact copies of any size is one row from there on;
* the 64 bits are cut into ``radius + 2`` blocks.  Two fingerprints within the
  radius agree on at least two blocks, so every pair of blocks names a shard
  and a linked pair meets in one of them (pigeonhole, nothing is lost);
* each shard's fingerprints form BK-trees whose children are keyed by their
  Hamming distance to the parent.  A query follows only the edges whose key is
  within the radius of its own distance to the node;
* a shard larger than ``tree_size`` is cut into several trees.  Each tree is
  first searched for its own members; then every tree is sent to the tasks
  that hold the other members of its shard.  Subtrees that already lie in the
  query's component are not entered, so a dense ball of near copies costs a
  few steps a member instead of one for each pair.

The trees travel to their queries through a shuffle on the shard, not through
a driver broadcast: a tree is bounded by ``tree_size``, the number of trees is
not, and collecting them would bring every fingerprint to the driver.

Defined cases: a null or empty text has the zero fingerprint and links like any
other; repeated rows and equal ids share a component; a null id is kept in the
output with its fingerprint and a null component, and does not bridge groups; texts of any
length are whole, a few MB of them in memory at a time beyond one text; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, group_runs, is_empty, scratch_table, ship_package
from .tokens import text_slices

SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # long texts: bounded unpacking
        part = h[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, h long) for every row; fp holds the 64 bits as a signed long, h a hash of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2)], ["id", "fp", "h"])

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
            .mapInArrow(run, "id long, fp long, h long"))


def block_masks(radius: int) -> list[int]:
    """A mask for each pair of the ``radius + 2`` blocks that the 64 bits are cut into."""
    edges = np.linspace(0, 64, radius + 3).round().astype(int)
    blocks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(blocks, 2)]


class BKTree:
    """Fingerprints as a BK-tree; a node's children are keyed by their distance to it.

    ``comp`` is a union-find over the members.  ``one[i]`` says that the whole
    subtree of node i was in one component when last looked at; components
    only grow, so it stays true.
    """

    def __init__(self, radius: int) -> None:
        self.radius = radius
        self.fp: list[int] = []
        self.kids: list[dict[int, int]] = []

    def add(self, fp: int) -> int:
        at = len(self.fp)
        self.fp.append(fp)
        self.kids.append({})
        if at:
            i = 0
            while True:
                d = (self.fp[i] ^ fp).bit_count()
                nxt = self.kids[i].get(d)
                if nxt is None:
                    self.kids[i][d] = at
                    break
                i = nxt
        return at

    def uniform(self, root_of) -> list[int]:
        """For each node, the component of its whole subtree, or -1 if it holds several."""
        out = [root_of(i) for i in range(len(self.fp))]
        for i in range(len(self.fp) - 1, -1, -1):  # children come after their parent
            for k in self.kids[i].values():
                if out[k] != out[i]:
                    out[i] = -1
                    break
        return out

    def within(self, fp: int, skip=None) -> Iterator[int]:
        """Members within the radius; ``skip(i)`` true leaves out i's subtree."""
        if not self.fp:
            return
        r, todo = self.radius, [0]
        while todo:
            i = todo.pop()
            if skip is not None and skip(i):
                continue
            d = (self.fp[i] ^ fp).bit_count()
            if d <= r:
                yield i
            kids = self.kids[i]
            if len(kids) <= 2 * r + 1:
                todo += [k for e, k in kids.items() if d - r <= e <= d + r]
            else:
                for e in range(d - r, d + r + 1):
                    k = kids.get(e)
                    if k is not None:
                        todo.append(k)


class Unions:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _tree_links(radius: int):
    """Per (shard, tree) of a sorted partition: each member tied to its part's smallest id."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a: list[int] = []
        b: list[int] = []
        for g in group_runs(batches, ["shard", "tree"]):
            fps, ids = g["fp"].view(np.uint64).tolist(), g["id"]
            if len(fps) < 2:
                continue
            tree, sets = BKTree(radius), Unions(len(fps))
            for i, fp in enumerate(fps):
                for k in tree.within(fp):
                    sets.join(i, k)
                tree.add(fp)
            for i in range(len(fps)):
                r = sets.find(i)
                if r != i:
                    a.append(int(ids[i]))
                    b.append(int(ids[r]))
            if len(a) >= 50_000:
                yield pd.DataFrame({"a": a, "b": b}, dtype=np.int64)
                a, b = [], []
        yield pd.DataFrame({"a": a, "b": b}, dtype=np.int64)
    return run


def _cross_links(radius: int):
    """Per pair of trees of one shard: the first tree's members are the tree, the others
    query it; a subtree wholly in the query's component is not entered."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in group_runs(batches, ["shard", "low", "high"]):
            own = np.flatnonzero(g["tree"] == g["low"])
            far = np.flatnonzero(g["tree"] == g["high"])
            fps, ids = g["fp"].view(np.uint64).tolist(), g["id"]
            names, comp = np.unique(g["comp"], return_inverse=True)
            sets, tree = Unions(len(names)), BKTree(radius)
            comp = comp.tolist()
            for i in own:
                tree.add(fps[i])
            whole = tree.uniform(lambda i: comp[own[i]])
            a: list[int] = []
            b: list[int] = []
            for q in far.tolist():
                c = comp[q]

                def same(i, c=c):
                    return whole[i] >= 0 and sets.find(whole[i]) == sets.find(c)

                for i in tree.within(fps[q], same):
                    if sets.join(comp[own[i]], c):
                        a.append(int(ids[q]))
                        b.append(int(ids[own[i]]))
            yield pd.DataFrame({"a": a, "b": b}, dtype=np.int64)
    return run


def link_components(reps: DataFrame, radius: int = 4, tree_size: int = 2048) -> DataFrame:
    """(node, component) over representatives (id, fp) with a link; ids without one are absent."""
    masks = block_masks(radius)
    key = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >= 1 << 63 else m)))
                    for k, m in enumerate(masks)])
    members = reps.select("id", "fp", F.explode(key).alias("shard"))
    sizes = members.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    trees = F.ceil(F.col("n") / F.lit(tree_size))
    members = (members.join(sizes, "shard")
               .select("shard", "id", "fp", trees.alias("trees"),
                       F.pmod(F.xxhash64("fp"), trees).alias("tree")))
    members, path = scratch_table(members, "simhash-shards")
    within = (members.select("shard", "tree", "id", "fp").repartition("shard", "tree")
              .sortWithinPartitions("shard", "tree", "fp").mapInPandas(_tree_links(radius), "a long, b long"))
    comp = components(within)
    large = members.filter("trees > 1")
    if is_empty(large):
        return comp
    first, first_path = scratch_table(comp, "simhash-parts")
    pair = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1), lambda t: t != F.col("tree")))
    across = (large.join(first, large["id"] == first["node"], "left")
              .select("shard", "tree", "id", "fp", F.coalesce("component", "id").alias("comp"), pair.alias("other"))
              .select("shard", "tree", "id", "fp", "comp", F.least("tree", "other").alias("low"),
                      F.greatest("tree", "other").alias("high"))
              .repartition("shard", "low", "high").sortWithinPartitions("shard", "low", "high", "fp")
              .mapInPandas(_cross_links(radius), "a long, b long"))
    return components(across.union(first.select("node", "component")))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, tree_size: int = 2048,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``
    (smallest id reachable over links, its own included), ``kept`` (its own component)."""
    ship_package(docs.sparkSession)
    fps, _ = scratch_table(fingerprints(docs, shingle, id_col, text_col), "simhash")
    reps = fps.groupBy("fp").agg(F.min("id").alias("id")).filter("id IS NOT NULL")
    comp = link_components(reps, radius, tree_size)
    classes = (reps.withColumnRenamed("id", "rep").join(comp, F.col("rep") == comp["node"], "left")
               .select("fp", F.coalesce("component", "rep").alias("component_id")))
    out = fps.join(classes, "fp", "left")
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
                      F.coalesce(F.col("component_id") == F.col("id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, tree_size: int = 2048) -> DataFrame:
    """``docs`` with one document of each group kept (the smallest id); columns unchanged.

    Groups are of texts: rows that repeat an id with different texts are judged each by its own
    text, and none stands in for another.  Of a group's rows with the smallest id one
    text stays, chosen by its fingerprint and hash; equal rows of it collapse to one.  Rows with a null
    id belong to no group and stay.
    """
    ship_package(docs.sparkSession)
    fps, _ = scratch_table(fingerprints(docs, shingle).filter("id IS NOT NULL"), "simhash")
    classes = fps.groupBy("fp").agg(F.min(F.struct("id", "h")).alias("first"), F.count("*").alias("n"))
    comp = link_components(classes.select(F.col("fp").alias("id"), "fp"), radius, tree_size)
    kept = (classes.join(comp, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("component", "fp").alias("group"))
            .agg(F.min(F.struct("first.id", "fp", "first.h")).alias("kept")).select("kept.*"))
    rows = kept.join(fps, ["id", "fp", "h"]).groupBy("id", "h").agg(F.count("*").alias("n"))
    rows, _ = scratch_table(rows.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "n"), "simhash-kept")
    mine = (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64("text") == F.col("_h"))
    once = docs.join(rows.filter("n = 1"), mine, "left_semi")
    # Equal rows: few, as a rule, so the other texts are not grouped.
    again = docs.join(rows.filter("n > 1"), mine).groupBy("_id", "_h").agg(
        F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    return once.unionByName(again).unionByName(docs.filter("doc_id IS NULL"))
