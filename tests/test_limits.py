"""What keeps memory, shuffles and scratch files of large ledgers bounded."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from consign import schemas
from consign.functions import middle
from consign.plans import catalog_files
from consign.sources import ledger as L
from tests.conftest import SF001


@pytest.mark.parametrize("bits", [2, 12])
def test_median_is_the_percentile(spark, monkeypatch, bits):
    monkeypatch.setattr(middle, "BITS", bits)
    rnd = random.Random(5)
    columns = [[3], [None, 7, 7], [1, 2], [-5, -5, 8, 9, None], [-(2 ** 63), 2 ** 63 - 1, 0],
               [rnd.randrange(-300, 300) for _ in range(501)], [rnd.randrange(4) for _ in range(200)]]
    for values in columns:
        df = spark.createDataFrame([(v,) for v in values], "k long")
        assert middle.median(df, "k") == df.agg(F.percentile("k", 0.5)).first()[0], values
    assert middle.median(spark.createDataFrame([(None,)], "k long"), "k") is None


def test_relinking_holds_no_counts_of_all_numbers(spark, monkeypatch):
    """The middle order number is found in bounded memory (the oracle test has the result)."""
    def refuse(*_):
        raise AssertionError("percentile holds every distinct value in one task")

    monkeypatch.setattr(F, "percentile", refuse)
    root = catalog_files._relinked(spark, SF001)
    assert len(L.state(spark, root).batches[L.LINK_LOG]) == 2


def test_the_link_log_is_grouped_once_by_hash(spark, tmp_path):
    root = f"file://{tmp_path}/ledger"
    rows = lambda schema, *r: spark.createDataFrame(list(r), schema)
    L.append_rows(rows(schemas.INVENTORY_LOTS, ("i1", "L1"), ("i1", "L1"), ("i2", "L1"), ("i2", "L1"), (None, "L1")), root, "inventory_lots")
    L.log_links(rows(schemas.LINK_LOG, ("i2", "L1", "link"), ("i3", "L1", "link"), (None, "L1", "link"), ("i4", "L1", "unlink")), root)
    L.log_links(rows(schemas.LINK_LOG, ("i3", "L1", "unlink"), ("i4", "L1", "link"), ("i5", "L1", "unlink")), root)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = L.read_bridge(spark, root)
        got = sorted((r.inventory_id or "", r.lot_id) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Stored rows that no batch names stay as they are, repeats too; of a NULL key nothing is the same key.
    assert got == [("", "L1"), ("", "L1"), ("i1", "L1"), ("i1", "L1"), ("i2", "L1"), ("i4", "L1")]
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 2 and final.count("ReusedExchange") == 1 and "SortAggregate" not in final


def _sales(spark, rows):
    df = spark.createDataFrame(rows, "id string, date string, qty long")
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in L.SCHEMAS["sales"].fields if f.name not in df.columns])


@pytest.mark.parametrize("threshold", ["10485760", "-1"])  # the odd keys broadcast, or shuffled
def test_whole_rows_of_an_append_are_shuffled_once(spark, tmp_path, monkeypatch, threshold):
    root, layouts, laid_out = f"file://{tmp_path}/ledger", [], L._laid_out
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

    def seen(df, name, once=False):
        out = laid_out(df, name, once)
        layouts.append((name, out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(L, "_laid_out", seen)
    try:
        L.append_new_rows(_sales(spark, [("a", "2024-01-05", 2), ("a", "2024-01-05", 1), ("b", "2024-02-05", 1), ("b", None, 7),
                                         (None, "2024-01-01", 5), (None, "2024-03-01", 4), ("c", "2024-03-09", 3)]), root, "sales")
        L.append_new_rows(_sales(spark, [("a", "2024-01-31", 9), ("c", "2024-04-01", 2), ("c", "2024-04-01", 1), ("c", "2024-05-01", 1),
                                         ("d", "2024-03-01", 1), ("d", "2024-03-01", 1)]), root, "sales")
        got = sorted((r.id or "", r.date or "", r.qty) for r in L.read_table(spark, root, "sales").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Of a key the least row (no date before all, then the least quantity); stored in its month, none of its rows.
    assert got == [("", "2024-01-01", 5), ("a", "2024-01-05", 1), ("b", "", 7), ("c", "2024-03-09", 3), ("c", "2024-04-01", 1),
                   ("d", "2024-03-01", 1)]
    plans = [p for name, p in layouts if name == "sales"]
    assert all(p.count("Exchange rangepartitioning") == 1 for p in plans)
    assert all(p.count("Exchange hashpartitioning") == (0 if threshold != "-1" else 2) for p in plans)


def test_a_write_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    key, seen, write = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], L._write
    monkeypatch.setattr(L, "_write", lambda *a: (seen.append(spark.conf.get(key)), write(*a)))
    before = spark.conf.get(key)
    L.append_new_rows(_sales(spark, [(f"s{i}", f"2024-0{i % 9 + 1}-01", i) for i in range(90)]), f"file://{tmp_path}/ledger", "sales")
    L.write_snapshot(L.ledger_from_testdata(spark, SF001), f"file://{tmp_path}/ledger")
    assert set(seen) == {"true"} and spark.conf.get(key) == before
    files = [p.name for p in tmp_path.rglob("*.parquet") if "/sales/" in str(p)]
    assert files and all(".zstd." in n for n in files)
