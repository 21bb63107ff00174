"""What keeps the work per row of ingestion and appends small: figures that grow no faster than the input."""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from consign.functions import js
from consign.operators import ingest
from consign.operators.profit import sales_profit
from consign.session import scratch_path
from consign.sources import ledger as L
from consign.sources import payloads as PL
from tests.conftest import SF001

ENVELOPE = "source string, seq long, entity string, target_id string, arrived_at string, body string"


def _requests(spark, bodies):
    return spark.createDataFrame([("d", i, "sale", None, "2024-02-01 00:00:00", b) for i, b in enumerate(bodies)], ENVELOPE)


def test_fields_are_read_without_copies_of_their_variants(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    body = '{"a":"1.50","b":0.1,"c":123456789012345678901234567890,"d":1e400,"e":null,"f":true,"g":[1],"h":4503599627370497.5,"i":12.50}'
    df, f = js.expand(ingest.parsed(_requests(spark, [body]), "sale"), "v", list("abcdefghij"))
    assert [c for c, t in df.dtypes if t == "variant"] == ["v"]
    # A stage that is longer than what the JVM compiles runs operator by operator instead.
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    r = df.select(*[F.expr(f[n].k).alias(f"{n}k") for n in f], *[F.expr(f[n].d).alias(f"{n}d") for n in f],
                  F.expr(f["a"].s).alias("as"), F.expr(f["f"].b).alias("fb"), F.expr(f["a"].t).alias("at")).first()
    kinds = [js.STRING, js.NUMBER, js.NUMBER, js.NUMBER, js.JNULL, js.BOOLEAN, js.OTHER, js.NUMBER, js.NUMBER, js.MISSING]
    assert [r[f"{n}k"] for n in f] == kinds
    numbers = {"b": 0.1, "c": 123456789012345678901234567890.0, "d": float("inf"), "h": 4503599627370497.5, "i": 12.5}
    assert {n: r[f"{n}d"] for n in f if r[f"{n}d"] is not None} == numbers
    assert (r["as"], r["fb"], r["at"]) == ("1.50", True, "1.50")


def test_written_requests_are_compressed_and_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(PL, "FILE_ROWS", 3)
    bodies = [f'{{"date":"2024-01-0{i}"}}' for i in range(1, 8)]
    path = PL.write_payloads(_requests(spark, bodies).coalesce(1), f"file://{tmp_path}/requests")
    assert len(list(tmp_path.glob("requests/*.json.gz"))) == 3
    assert sorted(r.body for r in PL.read_payloads(spark, path).collect()) == bodies


def _sales(spark, rows):
    df = spark.createDataFrame(rows, "id string, date string")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in L.SCHEMAS["sales"].fields if f.name not in df.columns]
    return df.select("*", *rest)


def test_an_append_deals_its_rows_by_key_once(spark, tmp_path, monkeypatch):
    root, plans, write = f"file://{tmp_path}/ledger", [], L._write_batch
    L.append_new_rows(_sales(spark, [("a", "2024-01-05"), ("b", "2024-02-05"), ("n", None)]), root, "sales")

    def seen(spark, df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(spark, df, *rest)

    monkeypatch.setattr(L, "_write_batch", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        L.append_new_rows(_sales(spark, [("a", "2024-01-09"), ("a", "2024-01-09"), ("b", "2024-01-05"), ("c", "2024-02-01"),
                                         ("n", None)]), root, "sales")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans[0].count("Exchange hashpartitioning") == 2  # the new rows, and the keys that are stored
    got = sorted((r.id, r.date or "") for r in L.read_table(spark, root, "sales").collect())
    # A key counts in its month; a row without a date is in none.
    assert got == [("a", "2024-01-05"), ("b", "2024-01-05"), ("b", "2024-02-05"), ("c", "2024-02-01"), ("n", ""), ("n", "")]


def test_partitions_of_the_profit_join_follow_its_size(spark):
    """More partitions than ``spark.sql.shuffle.partitions`` where the rows are many; the pairs hashed, the sales not sorted."""
    sales = spark.range(40_000).select(
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), F.lit("2024-01-02").alias("date"),
        F.concat(F.lit("i"), (F.col("id") % 9000).cast("string")).alias("inventory_id"),
        F.concat(F.lit("k"), (F.col("id") % 9001).cast("string")).alias("sku"),
        *[F.col("id").alias(c) for c in ("qty", "sold_price_cents", "buyer_shipping_cents", "platform_fees_cents",
                                         "promo_fee_cents", "shipping_label_cost_cents", "other_costs_cents")])
    items = spark.range(9000).select(
        F.concat(F.lit("i"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("sku"),
        F.lit("t").alias("title"), F.lit(5).cast("bigint").alias("cost_cents"))
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
           "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df = sales_profit(sales, items)
        assert df.rdd.getNumPartitions() > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert df.count() == 40_000 + sum(i % 9000 != i % 9001 and i % 9001 < 9000 for i in range(40_000))
        df.collect()
        assert "ShuffledHashJoin" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tables_of_a_snapshot_are_written_side_by_side(spark, monkeypatch):
    together = threading.Barrier(len(L.TABLES), timeout=30)
    write = L._write_batch
    monkeypatch.setattr(L, "_write_batch", lambda *a: (together.wait(), write(*a))[1])
    lg = L.ledger_from_testdata(spark, SF001)
    root = scratch_path(spark, "side-by-side")
    L.write_snapshot(lg, root)
    st = L.read_snapshot(spark, root)
    assert all(getattr(st, t).count() == getattr(lg, t).count() for t in L.TABLES)


def test_bridge_keys_are_shuffled_as_numbers(spark):
    rows = spark.createDataFrame([(1, 2), (1, 2), (12, 3), (1, 23), (None, 2), (None, 2), (1, None)], "l_partkey long, l_suppkey long")
    bridge = L.inventory_lots_from(rows)
    assert sorted(map(str, bridge.collect())) == sorted(map(str, rows.select(
        F.concat(F.lit("inv-"), F.col("l_partkey").cast("string")).alias("inventory_id"),
        F.concat(F.lit("lot-"), F.col("l_suppkey").cast("string")).alias("lot_id")).distinct().collect()))
    plan = bridge._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [l_partkey" in plan
