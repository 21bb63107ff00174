"""Operators 1, 3 and 9, and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from consign.llm import catalog, minhash, quality, secrets
from tests.conftest import SF01, SF001

# ---- operator 3


def test_quality_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = catalog.QUERIES["op3_quality"](spark, SF01).collect()
    assert len(rows) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.95


def test_stretches_change_no_feature(monkeypatch):
    texts = ["ab  cd\tefgh ab", None, "", " lead", "trail ", "x" * 30 + " long word", "é ß " * 40, "one"]
    want = sorted(zip(*(x.tolist() for x in quality.features(texts))))
    for stretch in (40, 64, 101):
        monkeypatch.setattr(quality, "STRETCH", stretch)
        assert sorted(zip(*(x.tolist() for x in quality.features(texts)))) == want


def test_a_very_long_text_is_scored_in_bounded_memory():
    import tracemalloc
    model = quality.Model(quality.np.ones(quality.BUCKETS), 0.0)
    tracemalloc.start()
    model.score(["lorem ipsum dolor " * 200_000])  # 3.6 MB
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_features_against_definition():
    """Buckets of a text are those of its words, word pairs and character n-grams, one by one."""
    texts = ["ab cde\tab", None, "", "  x  ", "Größe größe"]
    row, bucket = quality.features(texts)
    for i, t in enumerate(texts):
        words = (t or "").split()
        grams = [(f" {w} ")[a:a + n] for w in words for n in (3, 4, 5) for a in range(len(w) + 3 - n)]
        assert (row == i).sum() == len(words) + max(0, len(words) - 1) + len(grams)
    same, other = quality.features(["ab q ab"])[1], quality.features(["ab", "q"])[1]
    assert set(other) <= set(same)


def test_quality_edges(spark, docs_of):
    d = docs_of([(1, "good text here"), (2, None), (3, ""), (None, "x"), (1, "good text here")]).withColumnRenamed("source", "score")
    none = quality.fit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in quality.score_rows(d, none).collect()} == {0.5}
    one = quality.fit(d, spark.createDataFrame([(i, 1, 0) for i in range(1, 9)] + [(4, None, None), (None, 0, 0), (2, 7, 0)],
                                               "doc_id long, quality int, toxic int"))
    assert all(r.score > 0.99 for r in quality.score_rows(d, one).collect())
    kept = quality.keep_good(d, one)
    assert kept.columns == d.columns and kept.count() == 5
    assert quality.score_rows(docs_of([]), one).count() == 0 and quality.keep_good(docs_of([]), one).count() == 0


def test_training_takes_4000_documents(spark, docs_of, monkeypatch):
    monkeypatch.setattr(quality, "train", lambda texts, labels: (len(texts), len(labels)))
    docs = docs_of([(i, f"text {i}") for i in range(6000)])
    labels = spark.range(6000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality", "0 AS toxic")
    assert quality.fit(docs, labels) == (4000, 4000)


def test_training_leaves_fold_zero_out(spark):
    """Changing the labels of fold 0 changes no score."""
    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert np.array_equal(a.part, b.part) and a.bias == b.bias


# ---- operator 1


def test_secrets_of_known_kinds(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    planted = {(i, m.start(), len(m[0])) for i, t in docs.items()
               for m in re.finditer(r'AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}', t)}
    rows = catalog.QUERIES["op1_secret_forest"](spark, SF01).collect()
    found = {(r.doc_id, r.start, r.length) for r in rows if r.is_secret}
    assert planted and planted <= found
    assert len(found - planted) <= 0.1 * len(planted)
    assert sum(not r.is_secret for r in rows) > len(found)  # candidates that the forest took out


def test_candidates_and_positions(spark, docs_of):
    rng = random.Random(1)
    texts = []
    for _ in range(40):
        words = ["".join(rng.choice("abcdefghij0189é/_-=") for _ in range(rng.randint(1, 24))) for _ in range(30)]
        texts.append(" ".join(w + rng.choice(["", ":", "=", ' = "', "= '", ","]) for w in words))
    texts += [None, "", "x" * 40, "a" * 16 + "é" + "b" * 16]
    mine = re.compile(r"""(?:(?<=[=:])|(?<=[=:][ "'])|(?<=[=:] ["']))[A-Za-z0-9+/_-]{6,}={0,2}|[A-Za-z0-9+/_-]{16,}={0,2}""")
    expect = sorted((i, m.start(), m[0]) for i, t in enumerate(texts) for m in mine.finditer(t or ""))
    got = secrets.candidates(docs_of(list(enumerate(texts)))).collect()
    assert sorted((r.id, r.start, r.value) for r in got) == expect
    for r in got:
        t, end = texts[r.id], r.start + len(r.value)
        assert t[:r.start].endswith(r.before) and t[end:].startswith(r.after)


def test_secret_features(spark, docs_of):
    d = docs_of([(1, 'password = "aB3dE6gH9jK2mN5p"'), (2, "see /usr/lib/thesethingsarelong.txt and example thesethingsarelong")])
    mask = [-1] * (26 ** 3 // 64 + 1)
    got = {(r.id, r.value): r for r in secrets.features(secrets.candidates(d), mask).collect()}
    a = got[(1, "aB3dE6gH9jK2mN5p")]
    assert (a.length, a.credential, a.assigned, a.quoted, a.label) == (16.0, 1.0, 1.0, 1.0, 1.0)
    assert a.digits == pytest.approx(5 / 16) and a.uppers == pytest.approx(5 / 16) and a.coverage == 0
    w = got[(2, "thesethingsarelong")]
    assert w.coverage == 1 and w.placeholder == 1 and w.label == 0


def test_secrets_after_long_names_and_marks(spark, docs_of):
    """Long names, arrows, blanks and punctuation; the neighbourhood is the text's own."""
    cases = [("AWS_SECRET_ACCESS_KEY=", "wJalrXUtnFEMIK7MDENGbPxRfiCYzq1"), ("GITHUB_ACCESS_TOKEN=", "q1w2e3r4t5y6u7"),
             ("database_password: ", "ab12cd34ef56"), ("the_database_password => '", "ab12cd34ef57"),
             ("password:  ", "ab12cd34ef58"), ('password = "', "p@ss!w0rd#9x"), ("password=", "p@ss!w0rd#9xy"),
             ('"auth_token"  =>  "', "!ab12cd34ef59!"), ("first_long_candidate_name and api_key=", "ab12cd34ef60")]
    texts = [f"x {name}{value}{name[-1] if name[-1] in chr(34) + chr(39) else ''} then" for name, value in cases]
    texts.append("alpha " + " ".join(f"longcandidate{i:04d}" for i in range(40)) + " omega" + " " * 60 + "password=ab12cd34")
    rows = secrets.features(secrets.candidates(docs_of(list(enumerate(texts)))), [0] * 275).collect()
    got = {(r.id, r.value): r for r in rows}
    for i, (_, value) in enumerate(cases):
        r = got[(i, value)]
        assert (r.credential, r.assigned, r.label) == (1.0, 1.0, 1.0), value
    assert got[(5, "p@ss!w0rd#9x")].quoted == 1 and got[(5, "p@ss!w0rd#9x")].change_kinds > 1
    for r in rows:
        t, end = texts[r.id], r.start + len(r.value)
        assert t[r.start:end] == r.value
        assert r.before == t[max(0, r.start - secrets.NEAR):r.start] and r.after == t[end:end + secrets.NEAR]


def test_copies_take_one_place_in_the_sample(spark, docs_of):
    """Copies of a text count once, so findings of other texts still come into a small sample."""
    texts = [f"note password=ab12cd34ef{i:02d}" for i in range(6)]
    d = docs_of([(100 * j + i, t) for i, t in enumerate(texts) for j in range(20)])
    rows = secrets.features(secrets.candidates(d), [0] * 275)
    assert rows.filter("label = 1").count() == 120
    assert secrets.sample(rows, 6).filter("label = 1").select("k").distinct().count() == 6


def test_labelled_findings_and_redaction(spark, docs_of):
    key = "AKIA" + "ABCDEFGH12345678"
    rows = [(i, f"text {key} and password=ab12cd34ef56ab78 and internationalization {i}") for i in range(30)]
    d = docs_of(rows + [(99, None), (100, ""), (None, f"no id {key}")]).withColumnRenamed("source", "k")
    found = secrets.scan(d)
    out = {r.doc_id: r for r in secrets.redact(d, found).collect()}
    assert secrets.redact(d, found).columns == d.columns
    assert out[3].text == "text [SECRET] and password=[SECRET] and internationalization 3"
    assert out[3].n_chars == len(out[3].text) and out[99].text is None and out[100].text == ""
    assert out[None].text == "no id [SECRET]"
    # findings that call everything harmless but keys of one kind
    labelled = secrets.features(secrets.candidates(d), [0] * 275).withColumn("label", (F.col("value") == key).cast("double"))
    mine = secrets.scan(d, labelled.select(*secrets.FEATURES, "label"))
    assert {r.kind for r in mine.filter("is_secret").collect()} == {"provider key"}
    assert secrets.scan(docs_of([])).count() == 0 and secrets.redact(docs_of([]), secrets.scan(docs_of([]))).count() == 0


# ---- operator 9


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def check_fingerprints(rows, texts):
    """texts in descending order of ids; rows alike."""
    errors = []
    for i, (r, t) in enumerate(zip(rows, texts)):
        after = texts[(i + 1) % len(texts)]
        k = len(t) // 3
        edited = t[:len(t) - k] + after[:k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r.fingerprint) == minhash.BINS * minhash.BITS // 4
        assert r.fingerprint == rows[(i + 1) % len(texts)].fingerprint or t != after
        errors += [r.near_edited - jaccard(t, edited), r.near_next - jaccard(t, after)]
        for near, a, b in ((r.near_edited, t, edited), (r.near_next, t, after)):
            assert 0 <= near <= 1 and (near == 1 or a != b)
    return np.array(errors)


def test_fingerprints_against_exact_similarity(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = sorted(catalog.QUERIES["op9_minhash"](spark, SF01).collect(), key=lambda r: -r.doc_id)
    assert [r.doc_id for r in rows] == sorted(docs, reverse=True)
    e = check_fingerprints(rows, [docs[r.doc_id] for r in rows])
    assert np.abs(e).max() < 0.16 and abs(e.mean()) < 0.01


def test_fingerprint_edges(spark, docs_of):
    texts = {7: None, 6: "", 5: "one two", 4: "one two", 3: "a é 😀 b c d e f g", -2: " \n ", 0: "word " * 3000}
    d = docs_of(list(texts.items())).withColumnRenamed("source", "fp")
    out = minhash.fingerprints(d).withColumn("edited_sha256", F.sha2("edited", 256)).collect()
    rows = sorted(out, key=lambda r: -r.doc_id)
    check_fingerprints(rows, [texts[r.doc_id] or "" for r in rows])
    by = {r.doc_id: r for r in rows}
    assert by[7].fingerprint == by[6].fingerprint == by[-2].fingerprint == "0" * 256 and by[5].near_next == 1
    assert minhash.fingerprints(docs_of([])).count() == 0
    one = minhash.fingerprints(docs_of([(1, "abcdef ghi jkl")])).collect()
    assert one[0].edited == "abcdef ghiabcd" and one[0].near_next == 1
    twice = minhash.fingerprints(docs_of([(1, "b"), (1, "b"), (None, "zzz"), (None, None)])).collect()
    assert len(twice) == 4 and {r.doc_id for r in twice} == {1, None}
    assert minhash.fingerprints(docs_of([(None, "abc"), (None, "abcdef")])).count() == 2


def test_every_bin_is_the_smallest_hash(spark):
    """Long text, no borrowed bin: the digits against the definition, from Spark's own hashes."""
    words = [f"w{i}" for i in range(6000)]
    df = spark.createDataFrame([(" ".join(words),)], "t string")
    got = df.select(minhash.as_text(minhash.packed("t")).alias("f")).first().f
    h = [r.h for r in df.select(F.explode(F.split("t", " ")).alias("w")).select(F.xxhash64("w").alias("h")).collect()]
    grams = spark.createDataFrame([(h[i:i + 5],) for i in range(len(h) - 4)], "a array<bigint>").select(F.xxhash64("a").alias("h"))
    low = {}
    for r in grams.collect():
        b = (r.h % 2 ** 64) >> 56
        low[b] = min(low.get(b, r.h), r.h)
    order = sorted(range(256), key=lambda b: (b < 128, b))  # signed order: the top bit set comes first
    values = spark.createDataFrame([(low[b], j) for j, b in enumerate(order)], "v bigint, j int")
    digits = {r.j: r.x & 15 for r in values.select("j", F.xxhash64("v", "j").alias("x")).collect()}
    assert got == "".join(f"{digits[j]:x}" for j in range(256))


def test_no_python_in_native_plans(spark):
    for name in ("op1_secret_forest", "op9_minhash"):
        plan = catalog.QUERIES[name](spark, SF001)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ---- the pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    seen = [{r.doc_id: r for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF001)
        if name != "packing":
            assert out.schema == docs.schema
            docs = corpus_pipeline.scratch_table(out, "test-pipeline")[0]
            seen.append({r.doc_id: r for r in docs.collect()})
    first, good, single, cut, clean = seen
    assert sum(labels[i] == 1 for i in good if i in labels) == sum(q == 1 for q in labels.values())
    assert set(single) < set(good) < set(first) and set(cut) == set(clean) == set(single)
    assert all(good[i].text == first[i].text for i in good)
    for i, r in clean.items():
        assert r.n_chars == len(r.text)
    pieces = out.collect()
    assert {r.doc_id for r in pieces} == set(clean)
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_pipeline_on_edges(spark, docs_of, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    for rows in ([], [(1, None), (1, None), (2, ""), (None, "x"), (3, "a b " * 400), (4, "a b " * 400)]):
        docs = docs_of(rows)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.scratch_table(stage(spark, docs, f"file://{tmp_path}"), "test-edges")[0]
        # null and empty texts share the zero fingerprint: one of them stays
        assert {r.doc_id for r in docs.collect()} == ({1, 3, None} if rows else set())


def test_training_holds_its_features_once():
    """Features take 8 bytes each, at most 4 a character: 77 MB here, and what is worked on."""
    import tracemalloc
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.choice([32, *range(97, 123)], 3000))) for _ in range(800)]
    tracemalloc.start()
    try:
        quality.train(texts, [i % 2 for i in range(800)])
        assert tracemalloc.get_traced_memory()[1] < 105e6
    finally:
        tracemalloc.stop()
