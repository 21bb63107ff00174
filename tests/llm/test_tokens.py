"""Operators 4, 5 and 8 against the public tokenizer libraries."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from consign.llm import bpe, catalog, packing, tokenfile, tokens
from consign.session import scratch_path
from tests.conftest import SF001

TEXTS = [(5, "Hello world, it's fine.\nNext line  two spaces"), (3, None), (4, ""), (9, " lead and trail \n"),
         (7, "naïve Straße 12345 — “quotes” x y \x1c z"), (1, "a <|endoftext|> b"), (2, "x" * 5000),
         (8, "日本語のテキスト 😀😀 done\r\n\r\n\tTab"), (6, "Hello world, it's fine.\nNext line  two spaces"),
         (None, "no id"), (10, "we'll I'm they've 've don't ''s 's")]


@pytest.fixture(scope="module")
def tk():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        tokens = [b for _, b in sorted((int(r), base64.b64decode(t)) for t, r in (x.split() for x in f))]
    return bpe.Encoder(tokens, P.PATTERN)


def test_perfect_hash_is_minimal(own):
    t = own.table
    assert sorted(t.slot_key) == list(range(t.n))
    assert all(t.rank(k) == i for i, k in enumerate(t.keys))
    assert t.rank(b"surely not a token") == -1


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_own_bpe_equals_library(own, tik, text):
    assert own.text(text) == tik.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abe .,\n\t 'st1éßñÏªµ×ʼ<|>"), max_size=40))
def test_wordwise_equals_whole(tk, text):
    from consign.llm.tokens import library_encoder
    values, counts = library_encoder(P.path("byte_bpe_50k.json"))(pa.array([text, None, "plain words", text + "\u2003x"]))
    expect = [tk.encode(t, add_special_tokens=False).ids for t in (text, "", "plain words", text + "\u2003x")]
    assert values.tolist() == sum(expect, []) and counts.tolist() == [len(x) for x in expect]


def test_encode_decode(spark, docs_of, tik):
    d = docs_of(TEXTS).withColumnRenamed("source", "ids")  # a clashing name
    enc = bpe.encode(d, catalog.RANKS, P.PATTERN)
    got = {r.doc_id: (r.ids, bytes(r.decoded)) for r in bpe.decode(enc, catalog.RANKS).collect()}
    assert len(got) == len(TEXTS)
    for i, t in TEXTS:
        assert got[i] == (tik.encode_ordinary(t or ""), (t or "").encode())
    assert bpe.decode(bpe.encode(docs_of([]), catalog.RANKS, P.PATTERN), catalog.RANKS).count() == 0


def test_op4_digests(spark, tik):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = catalog.QUERIES["op4_bpe"](spark, SF001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = tik.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_simple8b_round_trip(values):
    v = np.array(values, dtype=np.uint64)
    assert np.array_equal(tokenfile.unpack(*tokenfile.pack(v), len(v)), v)


def test_simple8b_runs_and_edges():
    for v in (np.zeros(5000, "u8"), np.ones(3000, "u8"), np.arange(2049, dtype="u8"),
              np.array([tokenfile.ESCAPE, tokenfile.ESCAPE - 1, 2**64 - 1, 0], dtype="u8")):
        first, words, esc = tokenfile.pack(v)
        assert np.array_equal(tokenfile.unpack(first, words, esc, len(v)), v)
        assert len(first) == -(-len(v) // tokenfile.BLOCK) + 1 and first[-1] == len(words)


def test_token_files(spark, docs_of, tk):
    path = scratch_path(spark, "token-test")
    tokenfile.write_token_files(docs_of(TEXTS + [(5, "same id")]), path, catalog.TOKENIZER)
    rows = tokenfile.read_token_files(spark, path).orderBy("start").collect()
    expect, at = sorted(TEXTS + [(5, "same id")], key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), 0
    assert len(rows) == len(expect)
    for r, (i, t) in zip(rows, expect):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids))
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == ids
        at += len(ids)
    empty = scratch_path(spark, "token-empty")
    tokenfile.write_token_files(docs_of([]), empty, catalog.TOKENIZER)
    assert tokenfile.read_token_files(spark, empty).count() == 0


def test_op8_digests(spark, tk):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    at = 0
    for r in catalog.QUERIES["op8_token_files"](spark, SF001).orderBy("doc_id").collect():
        ids = tk.encode(docs[r.doc_id], add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)


def _check_packing(rows, docs, tk, length):
    ids = {i: tk.encode(t or "", add_special_tokens=False).ids + [1] for i, t in docs.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans, total in [(sorted(v), len(ids[i])) for i, v in by_doc.items()] + [(sorted(v), None) for v in by_seq.values()]:
        at = 0
        for a, n in spans:
            assert a == at
            at += n
        assert at == total if total is not None else at <= length
    assert set(by_doc) == set(ids)
    used = sum(sum(n for _, n in v) for v in by_seq.values())
    padded = sum(k if (k := sum(n for _, n in v)) & (k - 1) == 0 else length for v in by_seq.values())
    return used, padded


def test_op5_packing(spark, tk):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    used, padded = _check_packing(catalog.QUERIES["op5_packing"](spark, SF001).collect(), docs, tk, 2048)
    assert used >= 0.98 * padded


def test_packing_edges(spark, docs_of, tk):
    from pyspark.sql import functions as F
    docs = {i: t for i, t in TEXTS if i is not None}
    docs[11] = "word " * 9000  # no sentence end for longer than a sequence
    p = packing.pack(docs_of(list(docs.items())).withColumnRenamed("lang", "length"), catalog.TOKENIZER, 64)
    rows = p.withColumn("ids_crc32", F.crc32("ids")).collect()
    _check_packing(rows, docs, tk, 64)
    assert packing.pack(docs_of([]), catalog.TOKENIZER).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=14), st.lists(st.sampled_from([0, 12, 64]), min_size=14, max_size=14))
def test_cuts_are_cheapest(steps, pens):
    """Against every possible set of cuts."""
    length = 16
    at = np.cumsum([0, *steps])
    pen = np.array([0, *pens])[:len(at)]

    def cost(cuts):
        out = 0
        for a, b in zip(cuts, cuts[1:]):
            k = at[b] - at[a]
            if k > length:
                return None
            out += (0 if k & (k - 1) == 0 else length - k) + packing.SEQUENCE + pen[b]
        return out

    n = len(at) - 1
    best = min(c for m in range(1 << (n - 1))
               if (c := cost([0, *[i for i in range(1, n) if m >> (i - 1) & 1], n])) is not None)
    got = packing.best_cuts(at, pen, length)
    assert cost([int(np.flatnonzero(at == x)[0]) for x in got]) == best


@given(st.lists(st.tuples(st.booleans(), st.booleans()), min_size=1, max_size=120))
@settings(max_examples=200, deadline=None)
def test_every_sentence_end_is_a_choice(marks):
    """cut_points and best_cuts together, against a plain table over all positions; ids are 1 at a sentence's end, else 0."""
    length, n = 32, len(marks)
    ids = np.array([int(sentence) for sentence, _ in marks])
    stops = np.array([i + 1 for i, (_, doc) in enumerate(marks) if doc and i % 5 == 0 or i == n - 1])
    at, pen = packing.cut_points(ids, stops, np.array([False, True]), length)
    price = dict(zip(at.tolist(), pen.tolist()))
    allowed = {i + 1: packing.SENTENCE for i in np.flatnonzero(ids).tolist()} | {int(i): 0 for i in stops} | {0: 0}
    assert {i: price.get(i) for i in allowed} == allowed
    assert all(price[i] == packing.INSIDE for i in price if i not in allowed)

    def one(k):
        return (0 if k & (k - 1) == 0 else length - k) + packing.SEQUENCE

    best = {0: 0}
    for j in sorted(price)[1:]:
        best[j] = min(best[i] + one(j - i) for i in best if j - i <= length) + price[j]
    cuts = packing.best_cuts(at, pen, length).tolist()
    assert sum(one(b - a) + price[b] for a, b in zip(cuts, cuts[1:])) == best[n]


def test_ranks_that_no_token_has():
    keys = [b"a", b"", b"bc", b"", b"", b"d"] + [str(i).encode() for i in range(200)] + [b""]
    table = bpe.PerfectHash(keys)
    assert [table.rank(k) for k in keys if k] == [i for i, k in enumerate(keys) if k]
    assert table.rank(b"zz") == -1 and table.rank(b"") == -1
    with pytest.raises(ValueError):
        bpe.PerfectHash([b"a", b"a"])


def test_slices_are_bounded_by_bytes():
    b = pa.RecordBatch.from_pydict({"x": ["y" * 1000] * 300 + ["z" * 100_000, None]})
    got = list(tokens.slices([b], rows=256, size=50_000))
    assert pa.Table.from_batches(got).column(0).to_pylist() == b.column(0).to_pylist()
    assert all(x.num_rows == 1 or x.nbytes <= 50_000 for x in got)
