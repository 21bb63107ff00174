"""Ingestion, patches, links and the OR-join on hand-made edge rows (FIXTURES B),
plus a sequential model check of batch change application."""

import random

from pyspark.sql import functions as F

from consign.operators import changes, ingest, profit
from tests.conftest import envelopes

INV_SCHEMA = ("id string, sku string, title string, category string, status string, "
              "cost_cents long, quantity long, listed_date string, draft_created_at string, "
              "created_at string")


def _inventory(spark, items):
    return spark.createDataFrame([(i, s, "t", "c", "active", 100, 1, None, None, "2024-01-01 00:00:00")
                                  for i, s in items], INV_SCHEMA)


def test_ingest_inventory_rules(spark):
    demo = {"sku": "SKU-TEST", "title": "Demo", "category": "Shoes", "cost_usd": 12.50, "quantity": 1}
    rows = [(1, "inventory", None, demo), (2, "inventory", None, demo),
            (3, "inventory", None, "{bad"), (4, "inventory", None, {}),
            (5, "inventory", None, {"sku": " \t", "title": "a", "category": "b"}),
            (6, "inventory", None, {"sku": "OLD", "title": "a", "category": "b"}),
            (7, "inventory", None, "null")]
    r = ingest.ingest_inventory(envelopes(spark, rows), _inventory(spark, [("i0", "OLD")]))
    acc = r.accepted.collect()
    assert [(a.seq, a.sku, a.status, a.cost_cents, a.quantity) for a in acc] == \
        [(1, "SKU-TEST", "staged", 1250, 1)]
    rej = {x.seq: x.reason for x in r.rejected.collect()}
    assert rej == {2: "insert_failed", 3: "sku/title/category required",
                   4: "sku/title/category required", 5: "sku/title/category required",
                   6: "insert_failed", 7: "invalid_body"}


def test_ingest_sales_and_lots(spark):
    rows = [(1, "sale", None, {"date": "2024-01-01", "sku": "NOPE", "order_ref": "o1"}),
            (2, "sale", None, {"date": "2024-01-01", "sku": "A"}),
            (3, "lot", None, {"title": "L"}), (4, "lot", None, {"title": "L", "status": "closed"}),
            (5, "lot", None, {"title": "L", "status": "x"})]
    env = envelopes(spark, rows)
    s = ingest.ingest_sales(env)
    assert [x.seq for x in s.accepted.collect()] == [1]
    assert [(x.seq, x.reason) for x in s.rejected.collect()] == [(2, "date/sku/order_ref required")]
    lots = ingest.ingest_lots(env)
    assert sorted((x.seq, x.status) for x in lots.accepted.collect()) == [(3, "open"), (4, "closed")]
    assert [(x.seq, x.reason) for x in lots.rejected.collect()] == [(5, "bad status")]


def test_patch_inventory_rules(spark):
    inv = _inventory(spark, [("i1", "A"), ("i2", "B"), ("i3", "C"), ("i4", "D")])
    rows = [(1, "inventory_patch", "i1", {"quantity": "5"}), (2, "inventory_patch", "i1", {}),
            (3, "inventory_patch", "i2", {"quantity": 4.9}), (4, "inventory_patch", "i3", {"quantity": -1}),
            (5, "inventory_patch", "i4", {"status": "bogus", "quantity": 9}),
            (6, "inventory_patch", "zz", {"status": "bogus", "quantity": 9})]
    a = changes.patch_inventory(inv, envelopes(spark, rows))
    got = {r.id: (r.status, r.quantity) for r in a.table.collect()}
    assert got == {"i1": ("active", 1), "i2": ("active", 4), "i3": ("active", 0), "i4": ("active", 1)}
    outc = {(r.outcome): r.n for r in a.outcomes.collect()}
    assert outc == {"no_fields": 2, "ok": 2, "update_failed": 1, "not_found": 1}


def test_patch_lots_rules(spark):
    lots = spark.createDataFrame([("l1", "T", "n", "open", "x")],
                                 "id string, title string, note string, status string, created_at string")
    rows = [(1, "lot_patch", "l1", {"status": "x"}), (2, "lot_patch", "l1", {"note": ""}),
            (3, "lot_patch", "l1", {"title": ""})]
    a = changes.patch_lots(lots, envelopes(spark, rows))
    r = a.table.first()
    assert (r.title, r.note, r.status) == ("T", "", "open")
    assert {x.outcome: x.n for x in a.outcomes.collect()} == {"no_fields": 2, "ok": 1}


def test_links_and_unlinks(spark):
    inv = _inventory(spark, [("i1", "A"), ("i2", "B")])
    bridge = spark.createDataFrame([("i2", "L1")], "inventory_id string, lot_id string")
    rows = [(1, "link", "L1", {"sku": "A"}), (2, "link", "L1", {"sku": "A"}),
            (3, "link", "L1", {"sku": "ZZ"}), (4, "unlink", "L1", {"inventory_id": "i2"}),
            (5, "unlink", "L1", {"inventory_id": "i2"})]
    env = envelopes(spark, rows)
    a = changes.link_items(bridge, env, inv)
    assert sorted(tuple(r) for r in a.table.collect()) == [("i1", "L1"), ("i2", "L1")]
    b = changes.apply_link_unlink(bridge, env, inv, n_buckets=2)
    assert sorted(tuple(r) for r in b.table.collect()) == [("i1", "L1")]
    outc = {(r.entity, r.outcome): r.n for r in b.outcomes.collect()}
    assert outc == {("link", "ok"): 2, ("link", "inventory_not_found"): 1,
                    ("unlink", "ok"): 1, ("unlink", "not_found"): 1}


def test_link_unlink_matches_sequential_model(spark):
    """Random mixed batch: set-wise result == applying requests one by one."""
    rnd = random.Random(7)
    items = [(f"i{k}", f"S{k}") for k in range(6)]
    inv = _inventory(spark, items)
    base = {(f"i{k}", f"L{k % 2}") for k in range(0, 6, 2)}
    bridge = spark.createDataFrame(sorted(base), "inventory_id string, lot_id string")
    rows, state, outcomes = [], set(base), {}
    for seq in range(1, 400):
        k, lot = rnd.randrange(6), f"L{rnd.randrange(2)}"
        if rnd.random() < 0.5:
            rows.append((seq, "link", lot, {"sku": f"S{k}"}))
            state.add((f"i{k}", lot))
            key = ("link", "ok")
        else:
            rows.append((seq, "unlink", lot, {"inventory_id": f"i{k}"}))
            key = ("unlink", "ok" if (f"i{k}", lot) in state else "not_found")
            state.discard((f"i{k}", lot))
        outcomes[key] = outcomes.get(key, 0) + 1
    b = changes.apply_link_unlink(bridge, envelopes(spark, rows), inv, n_buckets=8)
    assert {tuple(r) for r in b.table.collect()} == state
    assert {(r.entity, r.outcome): r.n for r in b.outcomes.collect()} == outcomes


def test_patch_matches_sequential_model(spark):
    rnd = random.Random(11)
    inv = _inventory(spark, [(f"i{k}", f"S{k}") for k in range(4)])
    state = {f"i{k}": ["active", 1] for k in range(4)}
    rows = []
    for seq in range(1, 300):
        tgt = f"i{rnd.randrange(5)}"
        body = {}
        if rnd.random() < 0.6:
            body["status"] = rnd.choice(["staged", "draft", "sold", "bogus", ""])
        if rnd.random() < 0.6:
            body["quantity"] = rnd.choice([3, 4.7, -2, "5"])
        rows.append((seq, "inventory_patch", tgt, body))
        st = body.get("status") if isinstance(body.get("status"), str) and body.get("status") else None
        q = body.get("quantity") if isinstance(body.get("quantity"), (int, float)) else None
        if st is None and q is None or tgt not in state or (st and st == "bogus"):
            continue
        if st:
            state[tgt][0] = st
        if q is not None:
            state[tgt][1] = max(0, int(q // 1))
    a = changes.patch_inventory(inv, envelopes(spark, rows))
    assert {r.id: [r.status, r.quantity] for r in a.table.collect()} == state


def test_or_join_fixture(spark):
    inv = _inventory(spark, [("i1", "A"), ("i2", "B"), ("i3", "C")])
    sales = spark.createDataFrame(
        [(f"s{n}", "2024-01-01", iid, sku, 1, 100, 0, 0, 0, 0, 0, "o", "", "x")
         for n, (iid, sku) in enumerate([("i1", "A"), (None, "B"), ("i1", "B"), ("zz", "Z"),
                                          ("i2", "B"), (None, "A")])],
        "id string, date string, inventory_id string, sku string, qty long, sold_price_cents long, "
        "buyer_shipping_cents long, platform_fees_cents long, promo_fee_cents long, "
        "shipping_label_cost_cents long, other_costs_cents long, order_ref string, note string, "
        "created_at string")
    m = profit.matched_sales(sales, inv).select("id", F.col("m.item_id").alias("item"))
    got = sorted((r.id, r.item or "-") for r in m.collect())
    assert got == [("s0", "i1"), ("s1", "i2"), ("s2", "i1"), ("s2", "i2"), ("s3", "-"),
                   ("s4", "i2"), ("s5", "i1")]


def test_hot_key_spreads_over_buckets(spark):
    """D6 scale property: a key holding most ops is cut into several order-preserving
    buckets, and the outcomes still equal one-at-a-time application."""
    rnd = random.Random(3)
    rows, keyed = [], []
    for seq in range(1, 1201):
        hot = rnd.random() < 0.8
        item, lot = ("i0", "L0") if hot else (f"i{rnd.randrange(1, 5)}", f"L{rnd.randrange(2)}")
        op = "link" if rnd.random() < 0.5 else "unlink"
        keyed.append((seq * 7, lot, item, op))
        rows.append((seq * 7, op, lot, {"sku": f"S{item[1:]}"} if op == "link" else {"inventory_id": item}))
    ops = spark.createDataFrame(keyed, "seq long, lot_id string, inventory_id string, op string").withColumn("source", F.lit("test"))
    b = changes._bucketed(ops, ["lot_id", "inventory_id"], 8)
    spans = (b.where((F.col("lot_id") == "L0") & (F.col("inventory_id") == "i0"))
             .groupBy("_bucket").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
             .orderBy("_bucket").collect())
    assert len(spans) >= 4
    assert all(a.hi < c.lo for a, c in zip(spans, spans[1:]))

    inv = _inventory(spark, [(f"i{k}", f"S{k}") for k in range(5)])
    bridge = spark.createDataFrame([("i0", "L0"), ("i3", "L1")], "inventory_id string, lot_id string")
    state, outcomes = {("i0", "L0"), ("i3", "L1")}, {}
    for seq, lot, item, op in keyed:
        if op == "link":
            state.add((item, lot))
            key = ("link", "ok")
        else:
            key = ("unlink", "ok" if (item, lot) in state else "not_found")
            state.discard((item, lot))
        outcomes[key] = outcomes.get(key, 0) + 1
    a = changes.apply_link_unlink(bridge, envelopes(spark, rows), inv, n_buckets=8)
    assert {tuple(r) for r in a.table.collect()} == state
    assert {(r.entity, r.outcome): r.n for r in a.outcomes.collect()} == outcomes


def test_profit_pairs_equal_the_or_join(spark):
    """The rewrite gives the rows of the literal OR-join."""
    from bench import or_join
    from consign.sources import ledger as L
    from tests.conftest import SF001
    lg = L.ledger_from_testdata(spark, SF001)
    a = profit.sales_profit(lg.sales, lg.inventory).select("id", "sku", "qty", "cogs_cents")
    b = or_join(lg.sales, lg.inventory)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
