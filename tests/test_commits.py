"""Committed appends (S8, S11), changes on the stored tables (D5-D9, J8) and lookups that skip row groups."""

import pytest
from pyspark.sql import functions as F

from consign.operators import changes, views
from consign.session import scratch_path
from consign.sources import commits
from consign.sources import ledger as L
from tests.conftest import SF001, envelopes
from tests.test_ingest_changes import _inventory


def _stored(spark, name):
    lg, root = L.ledger_from_testdata(spark, SF001), scratch_path(spark, name)
    L.write_snapshot(lg, root)
    return lg, root


def test_an_append_at_the_root_is_read(spark):
    lg, root = _stored(spark, "root-append")
    n = lg.sales.count()
    fresh = lg.sales.limit(3).withColumn("id", F.concat(F.lit("n-"), "id"))
    twice = fresh.unionByName(fresh.withColumn("note", F.lit("zz")))  # one id, two rows
    L.append_new_rows(twice, root, "sales")
    L.append_new_rows(fresh, root, "sales")
    sales = L.read_snapshot(spark, root).sales
    assert sales.count() == n + 3 and sales.where("note = 'zz'").count() == 0
    assert views.list_sales(sales, None, None, None).count() == n + 3


def test_a_killed_append_leaves_nothing(spark):
    lg, root = _stored(spark, "killed-append")
    before = L.state(spark, root)
    bad = lg.lots.withColumn("note", F.when(F.col("id") == "lot-7", F.raise_error(F.lit("killed"))).otherwise(F.col("note")))
    with pytest.raises(Exception):
        L.append_rows(bad, root, "lots")
    # A batch that was written in full, but never committed.
    L._write(lg.lots, f"{root}/{before.snapshot}/lots/batch=zz", "lots")
    assert L.state(spark, root) == before and L.read_snapshot(spark, root).lots.count() == lg.lots.count()


def test_a_number_is_taken_once(spark):
    lg, root = _stored(spark, "conflict")
    seen = L.state(spark, root)
    L.append_rows(lg.lots.limit(2), root, "lots")
    with pytest.raises(commits.Conflict):
        commits.commit(spark, root, seen, [(commits.APPEND, seen.snapshot, "lots", "mine")])
    with pytest.raises(commits.Conflict):
        L.write_snapshot(lg, root, seen)
    # Two writers that both came through: the least id counts.
    spark.createDataFrame([("0", commits.APPEND, seen.snapshot, "lots", "first")], commits.ROW).write.parquet(f"{root}/commits/n=3")
    spark.createDataFrame([("1", commits.APPEND, seen.snapshot, "lots", "second")], commits.ROW).write.mode("append").parquet(
        f"{root}/commits/n=3")
    now = L.state(spark, root)
    assert now.n == 3 and now.batches["lots"][-1] == "first"


def test_an_append_beside_another_writer(spark, monkeypatch):
    """What was committed meanwhile on the same table is looked at again; on another table, only the commit is repeated."""
    lg, root = _stored(spark, "beside")
    rows = lg.lots.limit(4).withColumn("id", F.concat(F.lit("n-"), "id"))
    real, calls = L.commit, []

    def beside(*args):
        calls.append(1)
        if len(calls) == 1:
            L.append_new_rows(rows, root, "lots")  # the same rows, by another writer
        return real(*args)

    monkeypatch.setattr(L, "commit", beside)
    L.append_new_rows(rows, root, "lots")
    assert L.read_table(spark, root, "lots").count() == lg.lots.count() + 4


def test_patch_rewrites_the_files_of_its_targets_only(spark):
    items = [(f"i{n:04d}", f"S{n}") for n in range(400)]
    inv, lg = _inventory(spark, items), L.ledger_from_testdata(spark, SF001)
    root = scratch_path(spark, "patched")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # eight files of so small a table
    try:
        L.write_snapshot(L.Ledger(inv, lg.sales, lg.expenses, lg.lots, lg.inventory_lots, lg.photos), root)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = len(L.read_table(spark, root, "inventory").inputFiles())
    patches = envelopes(spark, [(n, "inventory_patch", f"i{n:04d}", {"quantity": 77}) for n in range(10)])
    done = L.rewrite(spark, root, "inventory", patches.select(F.col("target_id").alias("id")),
                     lambda t: changes.patch_inventory(t, patches).table)
    after = L.read_table(spark, root, "inventory")
    assert files == 8 and done == 1
    assert after.count() == 400 and after.where("quantity = 77").count() == 10
    want = changes.patch_inventory(inv, patches).table
    assert after.select(want.columns).exceptAll(want).count() == 0
    assert L.rewrite(spark, root, "inventory", spark.createDataFrame([("zz",)], "id string"), lambda t: t) == 0
    deletes = envelopes(spark, [(1, "item_delete", "i0003", None), (2, "item_delete", "i0399", None)])
    assert L.rewrite(spark, root, "inventory", deletes.select(F.col("target_id").alias("id")),
                     lambda t: changes.edit_delete_items(t, deletes).table) == 2
    assert L.read_table(spark, root, "inventory").count() == 398
    scan = L.read_table(spark, root, "inventory").inputFiles()
    L.compact(spark, root, "inventory")
    assert L.read_table(spark, root, "inventory").count() == 398 and L.state(spark, root).removed["inventory"] == []
    assert scan  # files of the removed list are still on disk for readers of the old state


def test_links_merge_on_read_and_compact(spark):
    lg = L.ledger_from_testdata(spark, SF001)
    inv = _inventory(spark, [("i1", "A"), ("i2", "B"), ("i3", "C")])
    bridge = spark.createDataFrame([("i1", "L1"), ("i2", "L1")], "inventory_id string, lot_id string")
    root = scratch_path(spark, "links")
    L.write_snapshot(L.Ledger(inv, lg.sales, lg.expenses, lg.lots, bridge, lg.photos), root)
    parts = [[(1, "unlink", "L1", {"inventory_id": "i1"}), (2, "link", "L2", {"sku": "C"}), (3, "link", "L1", {"sku": "B"})],
             [(4, "link", "L1", {"sku": "A"}), (5, "unlink", "L2", {"inventory_id": "i3"}), (6, "link", "L2", {"sku": "ZZ"})],
             [(7, "unlink", "L1", {"inventory_id": "i2"})]]
    for p in parts:
        L.log_links(changes.last_links(envelopes(spark, p), inv), root)
        upto = [r for q in parts[:parts.index(p) + 1] for r in q]
        want = {tuple(r) for r in changes.apply_link_unlink(bridge, envelopes(spark, upto), inv).table.collect()}
        assert {tuple(r) for r in L.read_snapshot(spark, root).inventory_lots.collect()} == want
    L.compact(spark, root, "inventory_lots")
    at = L.state(spark, root)
    assert at.batches[L.LINK_LOG] == [] and {tuple(r) for r in L.read_table(spark, root, "inventory_lots").collect()} == {("i1", "L1")}
    L.log_links(changes.last_links(envelopes(spark, [(8, "link", "L9", {"sku": "C"})]), inv), root)
    assert {tuple(r) for r in L.read_bridge(spark, root).collect()} == {("i1", "L1"), ("i3", "L9")}


def scanned_rows(df):
    """Rows that the scans of a finished query put out, after row groups were skipped."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(p.plan())
        elif "Scan parquet" in name:
            total += p.metrics().apply("numOutputRows").value()
        for i in range(p.children().size()):
            todo.append(p.children().apply(i))
    return total


def test_lookups_skip_row_groups(spark):
    """Ids and SKUs in no order and row groups of a few hundred rows: only Bloom filters can tell where a value is not."""
    rows = spark.range(20_000).selectExpr(
        "sha2(concat('i', id), 256) AS id", "sha2(concat('s', id), 256) AS sku", "'t' AS title", "'c' AS category", "'staged' AS status",
        "1L AS cost_cents", "1L AS quantity", "string(NULL) AS listed_date", "string(NULL) AS draft_created_at", "'x' AS created_at")
    lg, root = L.ledger_from_testdata(spark, SF001), scratch_path(spark, "bloom")
    hadoop = spark._jsc.hadoopConfiguration()
    spark.conf.set("parquet.block.size", "65536")
    hadoop.set("parquet.block.size", "65536")
    try:
        L.write_snapshot(L.Ledger(rows, lg.sales, lg.expenses, lg.lots, lg.inventory_lots, lg.photos), root)
    finally:
        hadoop.unset("parquet.block.size")
        spark.conf.unset("parquet.block.size")
    items = L.read_table(spark, root, "inventory")
    sku = rows.where("id = sha2('i123', 256)").first()["sku"]
    one = items.where(F.col("sku") == sku)
    assert scanned_rows(one) < 0.4 * 20_000 and one.count() == 1
    assert scanned_rows(items.where(F.col("sku") == "no such sku")) < 0.2 * 20_000
    keys = spark.createDataFrame([(sku,), ("zz",), (None,), (sku,)], "sku string")
    assert views.lookup_by_keys(items, keys, "sku").count() == 1
    few = views.lookup_values(items, "sku", [sku, None, *[f"no-{i}" for i in range(15)]])
    assert few.count() == 1 and scanned_rows(few) < 0.6 * 20_000
    assert views.lookup_values(items, "sku", []).count() == 0


def test_the_report_reads_whole_months_from_their_sums(spark):
    from consign.operators import report
    lg, root = _stored(spark, "rolled")
    fresh = lg.sales.limit(50).withColumns({"id": F.concat(F.lit("n-"), "id"), "promo_fee_cents": F.lit(None).cast("long"),
                                            "date": F.when(F.col("qty") > 25, "1996-02-29x").otherwise("19")})
    for _ in range(2):
        L.append_new_rows(fresh, root, "sales")
    at = L.state(spark, root)
    st = L.read_snapshot(spark, root, at)
    months = [L.read_months(spark, root, t, at) for t in ("sales", "expenses")]

    def rolled(frm, to):
        return report.report_summary_rolled(st.inventory, st.sales, months[0], st.expenses, months[1], frm, to)

    for frm, to in ((None, None), ("1996-02-10", "1997-03-09"), ("1996-02", "1996-02-29x"), ("1996-02", "1996-03"), ("19", "1996"),
                    ("1996-05-03", "1996-05-20"), ("1997-01-01", "1996-01-01"), ("", "1996-02-29"), ("1996-02-29y", "2024-01-15")):
        assert rolled(frm, to).collect() == report.report_summary(st.inventory, st.sales, st.expenses, frm, to).collect(), (frm, to)
    plan = rolled("1995-02-10", "1997-03-09")._jdf.queryExecution().executedPlan().toString()
    assert "month#" in plan and "IN (1995-02,1997-03)" in plan
    L.compact(spark, root, "sales")
    at = L.state(spark, root)
    assert len(at.batches["sales_months"]) == 1
    assert L.read_months(spark, root, "sales", at).agg(F.sum("gross")).first()[0] == st.sales.agg(F.sum("sold_price_cents")).first()[0]
    with pytest.raises(ValueError):
        L.rewrite(spark, root, "sales", fresh, lambda t: t)
