"""Stored layout (S1-S8, S11), photo objects (S9), log source (S12), report identities."""

import os

from pyspark.sql import functions as F

from consign.operators import report, views
from consign.session import scratch_path
from consign.sources import ledger as L
from consign.sources import objects
from tests.conftest import SF001


def test_snapshot_roundtrip_and_month_pruning(spark):
    lg = L.ledger_from_testdata(spark, SF001)
    root = scratch_path(spark, "test-ledger")
    at = L.write_snapshot(lg, root)
    st = L.read_snapshot(spark, root)
    folder = f"{root}/{at.snapshot}/sales/batch={L.BASE}".removeprefix("file://")
    assert st.sales.count() == lg.sales.count()
    assert any(d.startswith("month=") for d in os.listdir(folder))
    df = views.list_sales(st.sales, "1996-03-01", "1996-04-30")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "1996-03" in plan
    a = report.report_summary(st.inventory, st.sales, st.expenses, "1990-01-01", "2030-01-01").first()
    b = report.report_summary(lg.inventory, lg.sales, lg.expenses, "1990-01-01", "2030-01-01").first()
    assert a == b


def test_append_rows(spark):
    lg = L.ledger_from_testdata(spark, SF001)
    root = scratch_path(spark, "test-append")
    L.write_snapshot(lg, root)
    L.append_rows(lg.lots.limit(3), root, "lots")
    assert L.read_table(spark, root, "lots").count() == lg.lots.count() + 3


def test_status_map_and_counts(spark):
    lg = L.ledger_from_testdata(spark, SF001)
    m = report.inventory_status_map(lg.inventory).first().inventory_by_status
    counts = {r.status: r.cnt for r in report.inventory_by_status(lg.inventory).collect()}
    assert dict(m) == counts
    assert sum(counts.values()) == lg.inventory.count()


def test_photo_catalogue_from_objects(spark, tmp_path):
    for key, body in (("inventory/i1/p1_a.JPG", "abc"), ("inventory/inv-2/ph-9_b_c.tar.gz", "hello"), ("inventory/i1/nounderscore", "x"),
                      ("other/i1/p1_a.JPG", "x"), ("inventory/i1/deep/p1_a.JPG", "x")):
        path = tmp_path / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    cat = objects.photo_catalogue(objects.list_objects(spark, f"file://{tmp_path}"))
    assert [(r.id, r.inventory_id, r.r2_key, r.content_type, r.size_bytes) for r in cat.photos.orderBy("id").collect()] == \
        [("p1", "i1", "inventory/i1/p1_a.JPG", "image/jpeg", 3),
         ("ph-9", "inv-2", "inventory/inv-2/ph-9_b_c.tar.gz", "application/octet-stream", 5)]
    assert cat.photos.columns == [f.name for f in L.SCHEMAS["photos"].fields]
    assert cat.misfits.count() == 3


def test_a_snapshot_counts_once_it_is_committed(spark):
    import pytest
    lg = L.ledger_from_testdata(spark, SF001)
    root = scratch_path(spark, "test-commit")
    first = L.write_snapshot(lg, root)
    half = L.Ledger(lg.inventory, lg.sales, lg.expenses, lg.lots.limit(1), lg.inventory_lots, lg.photos)
    broken = L.Ledger(half.inventory, half.sales, half.expenses, half.lots, half.inventory_lots, lg.photos.drop("id"))
    with pytest.raises(Exception):
        L.write_snapshot(broken, root)
    assert L.state(spark, root) == first and L.read_snapshot(spark, root).lots.count() == lg.lots.count()
    second = L.write_snapshot(half, root)
    assert L.state(spark, root) == second and second.snapshot != first.snapshot
    assert L.read_snapshot(spark, root).lots.count() == 1
    assert L.read_table(spark, root, "lots", first).count() == lg.lots.count()  # the old one is still whole


def test_append_writes_few_files(spark):
    lg = L.ledger_from_testdata(spark, SF001)
    root = scratch_path(spark, "test-files")
    L.append_new_rows(lg.sales.repartition(16), root, "sales")
    months = lg.sales.select(F.substring("date", 1, 7)).distinct().count()
    assert len(L.read_table(spark, root, "sales").inputFiles()) <= months + 2 * 8


def test_registered_views(spark):
    lg = L.ledger_from_testdata(spark, SF001).register("t_")
    assert spark.sql("SELECT * FROM t_SalesReport").count() == spark.sql("SELECT * FROM t_sales_profit_v").count() >= lg.sales.count()


def test_log_source_scan(spark):
    root = scratch_path(spark, "test-logs")
    spark.createDataFrame([("x ERROR y",), ("ok 200",), ("got 404 from api",)], "value string") \
        .write.text(root)
    got = {r.line for r in objects.error_lines(objects.read_log_lines(spark, root)).collect()}
    assert got == {"x ERROR y", "got 404 from api"}


def test_report_text_money(spark):
    s = spark.createDataFrame([("active=2,sold=1", -150, 5, 123456)],
                              "inventory_by_status string, revenue_cents long, total_expenses_cents long, net_cents long")
    r = report.report_summary_text(s).first()
    assert r.status_text == "Inventory by status: active=2,sold=1"
    assert (r.revenue_text, r.expenses_text, r.net_text) == ("$-1.50", "$0.05", "$1234.56")


def test_empty_period_is_zero(spark):
    lg = L.ledger_from_testdata(spark, SF001)
    r = report.report_summary(lg.inventory, lg.sales, lg.expenses, "1900-01-01", "1900-12-31").first()
    assert (r.revenue_cents, r.total_expenses_cents, r.net_cents) == (0, 0, 0)
    assert F is not None


def test_report_nulls_and_range(spark):
    """A2-A4 on hand rows: NULL shipping or mileage adds nothing, bounds are inclusive,
    and rows outside the range are ignored in both tables."""
    from consign.schemas import EXPENSES, SALES
    sale = lambda i, d, price, ship: (i, d, None, "S", 1, price, ship, 10, 20, 30, 40, "o", None,
                                      "2024-01-01 00:00:00")
    sales = spark.createDataFrame([sale("s1", "2024-01-01", 1000, None), sale("s2", "2024-01-31", 500, 7),
                                   sale("s3", "2024-02-01", 9999, 9)], SALES)
    exp = lambda i, d, amt, calc: (i, d, "c", amt, "", "", None, "standard", None, None, calc, 1,
                                   "2024-01-01 00:00:00")
    expenses = spark.createDataFrame([exp("e1", "2024-01-15", 300, None), exp("e2", "2024-01-20", 0, 55),
                                      exp("e3", "2023-12-31", 777, 777)], EXPENSES)
    inventory = spark.createDataFrame([("active",), ("sold",), ("active",), ("lost",), (None,)], "status string")
    r = report.report_summary(inventory, sales, expenses, "2024-01-01", "2024-01-31").first()
    assert r.inventory_by_status == "active=2,other=2,sold=1"
    assert report.inventory_status_map(inventory).first()[0] == {"active": 2, "other": 2, "sold": 1}
    revenue, costs = 1000 + 500 + 7, 2 * (10 + 20 + 30 + 40)
    assert (r.revenue_cents, r.total_expenses_cents, r.net_cents) == \
        (revenue, costs + 300 + 55, revenue - (costs + 300 + 55))


def test_shuffle_partition_sizing():
    from consign.session import shuffle_partitions_for
    assert shuffle_partitions_for(0) == 200
    assert shuffle_partitions_for(10 << 40) == 40960
    assert shuffle_partitions_for((256 << 20) * 1000 + 1) == 1001


def test_cluster_without_shared_folder_is_an_error():
    """A non-local master with no spark.checkpoint.dir must not fall back to a
    machine-local temporary folder."""
    import pytest
    from consign.session import shared_dir

    class _Conf:
        def __init__(self, vals):
            self.vals = vals

        def get(self, k, default=None):
            return self.vals.get(k, default)

        def set(self, k, v):
            self.vals[k] = v

    class _Ctx:
        def getCheckpointDir(self):
            return None

    class _Session:
        def __init__(self, master):
            self.conf = _Conf({"spark.master": master})
            self.sparkContext = _Ctx()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Session("spark://cluster:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Session("local-cluster[2,1,1024]"))
    shared = _Session("yarn")
    shared.conf.set("spark.checkpoint.dir", "hdfs://nn/shared/ckpt/")
    assert shared_dir(shared) == "hdfs://nn/shared/ckpt"
    ctx = _Session("yarn")
    ctx.sparkContext.getCheckpointDir = lambda: "file:/shared/ckpt"
    assert shared_dir(ctx) == "file:/shared/ckpt"
    local = _Session("local[4]")
    first = shared_dir(local)
    assert first.startswith("file://") and shared_dir(local) == first


def test_append_new_rows_is_safe_to_rerun(spark):
    lg = L.ledger_from_testdata(spark, SF001)
    root = scratch_path(spark, "test-append-new")
    L.write_snapshot(lg, root)
    n = lg.sales.count()
    fresh = lg.sales.limit(5).withColumn("id", F.concat(F.lit("new-"), F.col("id")))
    for _ in range(2):  # the second run is a re-run of the same job
        L.append_new_rows(fresh.unionByName(lg.sales.limit(3)), root, "sales")
    assert L.read_table(spark, root, "sales").count() == n + 5
    L.append_new_rows(lg.inventory_lots.limit(4), root, "inventory_lots")
    assert L.read_table(spark, root, "inventory_lots").count() == lg.inventory_lots.count()
    first = scratch_path(spark, "test-append-first")
    L.append_new_rows(lg.lots, first, "lots")
    assert L.read_table(spark, first, "lots").count() == lg.lots.count()


def test_append_new_rows_reads_only_touched_months(spark):
    """The stored-key lookup is month-bounded at run time: a corrupt file in a month
    the new rows do not touch is never opened (a full scan of the table fails on it)."""
    import pytest
    lg = L.ledger_from_testdata(spark, SF001)
    root = scratch_path(spark, "test-append-prune")
    folder = f"{root}/{L.write_snapshot(lg, root).snapshot}/sales/batch={L.BASE}".removeprefix("file://")
    months = sorted(d for d in os.listdir(folder) if d.startswith("month="))
    with open(f"{folder}/{months[0]}/part-corrupt.parquet", "wb") as fh:
        fh.write(b"not parquet")
    last = months[-1].split("=", 1)[1]
    before = L.read_table(spark, root, "sales").where(F.col("month") == last).count()
    fresh = (lg.sales.where(F.substring("date", 1, 7) == last).limit(3)
             .withColumn("id", F.concat(F.lit("n-"), F.col("id"))))
    L.append_new_rows(fresh, root, "sales")
    assert L.read_table(spark, root, "sales").where(F.col("month") == last).count() == before + 3
    with pytest.raises(Exception):
        L.read_table(spark, root, "sales").count()


def test_broadcast_threshold_and_fit(spark):
    from consign.session import broadcast_threshold, fits_broadcast
    assert broadcast_threshold(spark) == 10 << 20
    small = spark.range(1000).selectExpr("id", "cast(id AS string) AS s")
    assert fits_broadcast(small)
    wide = spark.range(200_000).selectExpr("id", "repeat('x', 100) AS s")  # ~23 MB
    assert not fits_broadcast(wide)


def test_spread_only_for_real_gains(spark):
    """A leaf is reshuffled only when that at least doubles its parallelism (target 4 here)."""
    from consign.session import spread
    one = spark.range(0, 100, 1, numPartitions=1)
    two = spark.range(0, 100, 1, numPartitions=2)
    three = spark.range(0, 100, 1, numPartitions=3)
    assert spread(one, 4).rdd.getNumPartitions() == 4
    assert spread(two, 4).rdd.getNumPartitions() == 4
    assert spread(three, 4).rdd.getNumPartitions() == 3
    assert sorted(r.id for r in spread(one, 4).collect()) == list(range(100))
