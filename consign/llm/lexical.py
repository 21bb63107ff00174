"""Ranked lexical search over a length-stratified index (operator 11).

A term is a maximal run of letters and digits, other bytes than ASCII's counting as
letters, and only A-Z lower-cased.  A document of n terms has the normaliser
m = 10 + (90 * n * N) div L, of N documents that have a term and L terms in all.
Documents of equal m are a stratum.

``build`` writes the index as one table.  Documents are taken in shards of at most
``SHARD_DOCS`` documents and about ``SHARD_POSTINGS`` postings, each by one task and without a
shuffle.  In a shard documents are numbered by m, so a stratum is a range of
numbers.  A row is a term of a shard: its documents by stratum and, in a stratum, by
tf from high to low, with (m, tf, size) of each such group.  A row without a term
holds the shard's document ids and their m.

``search`` takes queries in blocks of bounded size against every shard.  The impact
of a term on a document depends on (m, tf) alone and is computed once a group; a
stratum's bound for a query is the sum of its terms' first, highest, impacts.
Strata are visited by falling bound until the bound is below the tenth score found
so far by the task, over all its shards.  Every task gives its ``k`` best of each
query; these are merged.  Scores are sums of 64-bit integers.

Defined cases: a null or empty text has no terms and is never found, nor does a
query without terms find anything; texts of any length are taken whole, in pieces
of a few MB; a repeated row is a document of its own and may fill several
ranks; documents of a null id are found too, after others of equal score; equal
rows of queries are one query, and two texts under one id two queries; an empty table
finds nothing; other columns than the id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import drop_scratch, scratch_table, ship_package
from .tokens import text_slices

SHARD_DOCS, SHARD_POSTINGS = 16_384, 1 << 20
BLOCK_ITEMS, BLOCK_BYTES = 4096, 4 << 20  # of queries that are searched for together
PIECE = 4 << 20  # bytes of a text that are cut into terms at a time
NONE = -(1 << 63)  # a null document id inside a task
INDEX_TYPE = ("shard long, term string, n_docs long, docs array<long>, group_m array<long>, group_tf array<long>, "
              "group_size array<long>")

# Each byte as a term has it: A-Z in lower case, and all that parts terms as a blank.
_PARTS = {*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
_FOLD = bytes(0x20 if b in _PARTS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


@dataclass
class Index:
    path: str
    n_docs: int   # documents with at least one term
    n_terms: int  # terms in them, with repeats


def _spans(at: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, first byte of each term, byte after its last) of texts that begin at ``at``."""
    low = np.frombuffer(c.tobytes().translate(_FOLD), dtype=np.uint8)
    term = low != 0x20
    first, last = term.copy(), term.copy()
    first[1:] &= ~term[:-1]
    last[:-1] &= ~term[1:]
    edge = at[(at > 0) & (at < len(c))]  # a text ends where the next begins
    first[edge] = term[edge]
    last[edge - 1] = term[edge - 1]
    return low, np.flatnonzero(first), np.flatnonzero(last) + 1


def _texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins (and the end) in the texts' bytes, and the bytes."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    data = col.buffers()
    at = np.frombuffer(data[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    c = np.frombuffer(data[2], dtype=np.uint8)[at[0]:at[-1]] if data[2] is not None else np.zeros(0, dtype=np.uint8)
    return at - at[0], c


def _pieces(at: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, begins, bytes) of pieces of a few MB; a longer text is cut between terms."""
    if len(c) <= PIECE:
        yield 0, at, c
        return
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, side="right")) - 1)
        if at[j] - at[i] <= PIECE:
            yield i, at[i:j + 1] - at[i], c[at[i]:at[j]]
        else:
            a, end = int(at[i]), int(at[j])
            while a < end:
                b = min(a + PIECE, end)
                while b < end and _FOLD[c[b]] != 0x20:
                    b += 1
                yield i, np.array([0, b - a]), c[a:b]
                a = b
        i = j


def count_terms(col: pa.Array) -> np.ndarray:
    """How many terms each text has."""
    at, c = _texts(col)
    n = np.zeros(len(col), dtype=np.int64)
    for i, own, part in _pieces(at, c):
        _, first, _ = _spans(own, part)
        n[i:i + len(own) - 1] += np.diff(np.searchsorted(first, own))
    return n


def term_counts(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text, term's place in the last, tf) of the texts' distinct terms, and those terms."""
    at, c = _texts(col)
    rows, codes, terms, base = [], [], [], 0
    for i, own, part in _pieces(at, c):
        low, first, stop = _spans(own, part)
        if not len(first):
            continue
        # The terms end to end, as one array of strings over their bytes.
        keep = low != 0x20
        offsets = np.concatenate([[0], np.cumsum(stop - first)]).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(low[keep])).dictionary_encode()
        rows.append(i + np.searchsorted(own, first, side="right") - 1)
        codes.append(coded.indices.to_numpy().astype(np.int64) + base)
        terms.append(coded.dictionary)
        base += len(coded.dictionary)
    if not rows:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, pa.array([], pa.string())
    row, code = np.concatenate(rows), np.concatenate(codes)
    if len(terms) > 1:
        coded = pa.concat_arrays(terms).dictionary_encode()
        code, words = coded.indices.to_numpy().astype(np.int64)[code], coded.dictionary
    else:
        words = terms[0]
    both, tf = np.unique(row * len(words) + code, return_counts=True)
    return both // len(words), both % len(words), tf.astype(np.int64), words


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int64()))


class _Shard:
    """The postings of some documents, gathered slice by slice."""

    def __init__(self) -> None:
        self.ids, self.lengths, self.rows, self.codes, self.tfs, self.words = [], [], [], [], [], []
        self.docs = self.postings = self.base = 0

    def add(self, ids: np.ndarray, col: pa.Array) -> None:
        row, code, tf, words = term_counts(col)
        n = np.bincount(row, weights=tf, minlength=len(ids)).astype(np.int64)
        self.ids.append(ids)
        self.lengths.append(n)
        self.rows.append(row + self.docs)
        self.codes.append(code + self.base)
        self.tfs.append(tf)
        self.words.append(words)
        self.docs, self.postings, self.base = self.docs + len(ids), self.postings + len(row), self.base + len(words)

    def rows_of(self, number: int, n_docs: int, n_terms: int) -> pa.RecordBatch:
        n = np.concatenate(self.lengths)
        sizes, which = np.unique(n, return_inverse=True)
        m = np.array([10 + 90 * int(x) * n_docs // n_terms if n_terms else 10 for x in sizes], dtype=np.int64)[which]
        order = np.argsort(m, kind="stable")
        place = np.empty(len(n), dtype=np.int64)
        place[order] = np.arange(len(n))
        coded = pa.concat_arrays(self.words).dictionary_encode()
        rank = np.empty(len(coded.dictionary), dtype=np.int64)
        by_term = pc.sort_indices(coded.dictionary).to_numpy()
        rank[by_term] = np.arange(len(rank))
        code = rank[coded.indices.to_numpy()][np.concatenate(self.codes)] if len(rank) else np.zeros(0, dtype=np.int64)
        row, tf = place[np.concatenate(self.rows)], np.concatenate(self.tfs)
        m = m[order]
        post = np.lexsort((row, -tf, m[row], code))
        row, tf, code = row[post], tf[post], code[post]
        own = m[row]
        new = np.ones(len(row), dtype=bool)  # where a group of equal term, m and tf begins
        new[1:] = (code[1:] != code[:-1]) | (own[1:] != own[:-1]) | (tf[1:] != tf[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(row)))
        docs_of, groups_of = np.bincount(code, minlength=len(rank)), np.bincount(code[begin], minlength=len(rank))
        ids = np.concatenate(self.ids)[order]
        head = [np.array([len(ids)]), np.array([len(ids)]), np.array([0]), np.array([0])]
        columns = [(np.concatenate([ids, row]), np.concatenate([head[0], docs_of])),
                   (np.concatenate([m, own[begin]]), np.concatenate([head[1], groups_of])),
                   (tf[begin], np.concatenate([head[2], groups_of])), (size, np.concatenate([head[3], groups_of]))]
        terms = pa.concat_arrays([pa.array([None], pa.string()), coded.dictionary.take(pa.array(by_term))])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(terms), number, dtype=np.int64)), terms, pa.array(columns[0][1], pa.int64()),
             *[_lists(*c) for c in columns]],
            ["shard", "term", "n_docs", "docs", "group_m", "group_tf", "group_size"])


def build(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index every document; the table goes to ``path`` (a fresh scratch folder if not given)."""
    spark = docs.sparkSession
    ship_package(spark)
    path = path or scratch_path(spark, "lexical-index")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for b in text_slices(batches, 0):
            n = count_terms(b.column(0))
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
        yield pa.RecordBatch.from_pydict({"docs": [docs], "terms": [terms]})

    total = docs.select("text").mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, shard = TaskContext.get().partitionId() << 32, 0, _Shard()
        for b in text_slices(batches):
            shard.add(pc.fill_null(b.column(0), NONE).to_numpy(zero_copy_only=False), b.column(1))
            if shard.docs > SHARD_DOCS - 4096 or shard.postings > SHARD_POSTINGS:
                yield shard.rows_of(part + done, n_docs, n_terms)
                done, shard = done + 1, _Shard()
        if shard.docs:
            yield shard.rows_of(part + done, n_docs, n_terms)

    docs.mapInArrow(index, INDEX_TYPE).write.parquet(path)
    return Index(path, n_docs, n_terms)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of the ranges, one range after the other."""
    stop = np.cumsum(size)
    return np.repeat(start - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, equal ones by ascending id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return at[np.lexsort((ids[at], ids[at] == NONE, -scores[at]))[:k]]


class _Searcher:
    """One task's queries and their best documents so far.

    ``terms_of``: each query's term numbers; ``weights``: by term number.
    """

    def __init__(self, terms_of: list[np.ndarray], weights: np.ndarray, k: int) -> None:
        self.terms_of, self.weights, self.k = terms_of, weights, k
        self.scores = [np.zeros(0, dtype=np.int64) for _ in terms_of]
        self.ids = [np.zeros(0, dtype=np.int64) for _ in terms_of]

    def shard(self, rows: list[dict]) -> None:
        """``rows``: the shard's row without a term first, then its terms' by ascending number."""
        if len(rows) < 2 or rows[0]["tno"] != -1:
            return
        ids, m = rows[0]["docs"], rows[0]["group_m"]
        strata = np.unique(m)
        tno = np.array([r["tno"] for r in rows[1:]])
        groups = np.array([len(r["group_m"]) for r in rows[1:]])
        docs = np.concatenate([r["docs"] for r in rows[1:]])
        gm, tf, size = (np.concatenate([r[c] for r in rows[1:]]) for c in ("group_m", "group_tf", "group_size"))
        of = np.repeat(np.arange(len(tno)), groups)
        begin = np.cumsum(size) - size
        impact = self.weights[tno][of] * ((1_000_000_000 * tf) // (1000 * tf + 8 * gm))
        stratum = np.searchsorted(strata, gm)
        new = np.ones(len(gm), dtype=bool)  # where a term's stratum begins: its highest tf
        new[1:] = (of[1:] != of[:-1]) | (stratum[1:] != stratum[:-1])
        seg = np.flatnonzero(new)
        seg_groups = np.diff(np.append(seg, len(gm)))
        seg_stratum, seg_bound = stratum[seg], impact[seg].astype(np.float64)
        seg_from = np.searchsorted(of[seg], np.arange(len(tno) + 1))
        slot = np.full(len(self.weights), -1)
        slot[tno] = np.arange(len(tno))
        for q, terms in enumerate(self.terms_of):
            own = slot[terms]
            own = own[own >= 0]
            if not len(own):
                continue
            segs = _ranges(seg_from[own], seg_from[own + 1] - seg_from[own])
            bound = np.bincount(seg_stratum[segs], weights=seg_bound[segs], minlength=len(strata))
            order = np.argsort(-bound, kind="stable")
            order = order[:np.searchsorted(-bound[order], 0)]
            at, step = 0, 8
            while at < len(order) and (len(self.scores[q]) < self.k or bound[order[at]] >= self.scores[q][-1]):
                chosen = np.zeros(len(strata), dtype=bool)
                chosen[order[at:at + step]] = True
                at, step = at + step, step * 4
                mine = segs[chosen[seg_stratum[segs]]]
                g = _ranges(seg[mine], seg_groups[mine])
                found = docs[_ranges(begin[g], size[g])]
                score = np.zeros(len(ids), dtype=np.int64)
                np.add.at(score, found, np.repeat(impact[g], size[g]))
                hit = np.flatnonzero(score >= (self.scores[q][-1] if len(self.scores[q]) == self.k else 1))
                s, d = np.concatenate([self.scores[q], score[hit]]), np.concatenate([self.ids[q], ids[hit]])
                top = best(s, d, self.k)
                self.scores[q], self.ids[q] = s[top], d[top]


def _query_blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The distinct queries in blocks of bounded size: lists of (id, text)."""
    rows, path = scratch_table(queries.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))
                               .filter("text IS NOT NULL").distinct(), "lexical-queries")
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-(size or 0) // BLOCK_BYTES))
    for i in range(blocks):
        yield [(r.item, r.text) for r in rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i).collect()]
    drop_scratch(queries.sparkSession, path)


def _search_block(spark: SparkSession, index: Index, items: list[tuple], item_type: str, k: int) -> DataFrame:
    row, code, _, words = term_counts(pa.array([t for _, t in items], pa.string()))
    terms = spark.createDataFrame([(i, t) for i, t in enumerate(words.to_pylist())], "tno long, term string")
    table = spark.read.schema(INDEX_TYPE).parquet(index.path)
    df = {r.tno: r.df for r in table.select("term", "n_docs").join(F.broadcast(terms), "term").groupBy("tno")
          .agg(F.sum("n_docs").alias("df")).collect()}  # a row a term of the block
    weights = np.array([weight(index.n_docs, df.get(i, 0)) for i in range(len(words))], dtype=np.int64)
    terms_of = np.split(code, np.searchsorted(row, np.arange(1, len(items))))
    shared = spark.sparkContext.broadcast((terms_of, weights))
    lists = ["docs", "group_m", "group_tf", "group_size"]
    rows = (table.filter("term IS NOT NULL").join(F.broadcast(terms), "term").select("shard", "tno", *lists)
            .union(table.filter("term IS NULL").select("shard", F.lit(-1).cast("long"), *lists)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher, held, now = _Searcher(*shared.value, k), [], None
        for b in batches:
            shard, tno = b.column(0).to_numpy(), b.column(1).to_numpy()
            cols = [(c, b.column(i + 2)) for i, c in enumerate(lists)]
            cols = [(c, x.flatten().to_numpy(), np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())])) for c, x in cols]
            for r in range(b.num_rows):
                if shard[r] != now:
                    if held:
                        searcher.shard(held)
                    held, now = [], shard[r]
                held.append({"tno": int(tno[r])} | {c: x[at[r]:at[r + 1]] for c, x, at in cols})
        if held:
            searcher.shard(held)
        n = [len(s) for s in searcher.scores]
        d = np.concatenate(searcher.ids)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n)), n)), pa.array(d, mask=d == NONE),
                                          pa.array(np.concatenate(searcher.scores))], ["q", "doc_id", "score"])

    found = (rows.repartition("shard").sortWithinPartitions("shard", "tno")
             .mapInArrow(run, "q long, doc_id long, score long"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], f"q long, item_id {item_type}")
    return found.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of every query."""
    spark, kind = queries.sparkSession, queries.schema[id_col].dataType.simpleString()
    ship_package(spark)
    path, out = scratch_path(spark, "lexical-found"), f"item_id {kind}, rank int, doc_id long, score long"
    spark.createDataFrame([], out).write.parquet(path)
    for items in _query_blocks(queries, id_col, text_col):
        if items:
            _search_block(spark, index, items, kind, k).write.mode("append").parquet(path)
    return spark.read.schema(out).parquet(path)
