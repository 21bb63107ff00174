"""Requests that must not be lost, poison a job, or be read unlike a JavaScript server reads them."""

import json

from pyspark.sql import functions as F

from consign.operators import changes, ingest, profit
from consign.session import scratch_path
from consign.sources import ledger as L
from consign.sources.payloads import read_payloads
from tests.conftest import envelopes
from tests.test_ingest_changes import _inventory

SALE = {"date": "2024-01-01", "sku": "A", "order_ref": "o"}


def test_equal_numbers_of_two_sources_are_two_requests(spark):
    root = scratch_path(spark, "two-sources")
    batches = [ingest.ingest_sales(envelopes(spark, [(1, "sale", None, SALE), (2, "sale", None, SALE)], source=s)).accepted
               for s in ("phone", "import")]
    for b in batches + batches:  # a rerun appends nothing
        L.append_new_rows(b, root, "sales")
    assert L.read_table(spark, root, "sales").count() == 4
    demo = {"sku": "S", "title": "t", "category": "c"}
    both = envelopes(spark, [(1, "inventory", None, demo)], "b").union(envelopes(spark, [(1, "inventory", None, demo)], "a"))
    r = ingest.ingest_inventory(both, _inventory(spark, []))
    assert (r.accepted.count(), [x.source for x in r.rejected.collect()]) == (1, ["b"])


def _results(r):
    return (sorted((x.seq, x.sku) for x in r.accepted.collect()), sorted((x.source, x.seq, x.reason) for x in r.rejected.collect()))


def test_each_line_has_one_result(spark):
    """A number given twice to different items, and a line delivered again, in one partition and in two."""
    item = lambda sku: {"sku": sku, "title": "t", "category": "c"}
    for parts in (1, 3):
        lines = envelopes(spark, [(1, "inventory", None, item("A")), (1, "inventory", None, item("B")),
                                  (2, "inventory", None, item("B"))], "d").repartition(parts)
        r = ingest.ingest_inventory(lines, _inventory(spark, []))
        assert _results(r) == ([(1, "A"), (2, "B")], [("d", 1, "insert_failed")])
        again = envelopes(spark, [(1, "inventory", None, item("A"))] * 3 + [(2, "inventory", None, "{cut")] * 2
                          + [(3, "inventory", None, "{cut"), (3, "inventory", None, item("C"))], "d").repartition(parts)
        required = ingest.REQUIRED["inventory"]
        r = ingest.ingest_inventory(again, _inventory(spark, []))
        assert _results(r) == ([(1, "A"), (3, "C")], [("d", 1, "insert_failed")] * 2 + [("d", 2, required)] * 2 + [("d", 3, required)])


def test_the_first_arrival_of_a_number_counts(spark):
    rows = [("d", 1, at, json.dumps({"sku": sku, "title": "t", "category": "c"})) for at, sku in
            (("2024-01-02", "LATE"), ("2024-01-01", "EARLY"), (None, "NEVER"))]
    lines = spark.createDataFrame(rows[:2], "source string, seq long, arrived_at string, body string").selectExpr(
        "*", "'inventory' AS entity", "NULL AS target_id")
    r = ingest.ingest_inventory(lines, _inventory(spark, []))
    assert _results(r) == ([(1, "EARLY")], [("d", 1, "insert_failed")])


def test_random_deliveries_as_one_at_a_time(spark):
    """Against a model that takes lines one by one: a (source, seq) and a SKU are unique in the database."""
    import random
    rng = random.Random(5)
    for trial in range(3):
        lines = [(rng.choice("ab"), rng.randint(1, 12), f"2024-01-0{rng.randint(1, 3)}", rng.choice(["A", "B", "C", "D", ""]))
                 for _ in range(80)]
        ids, skus, want = set(), {"C"}, []
        first = {}
        for s, n, at, sku in sorted(lines, key=lambda x: (x[1], x[0], x[2], x[3])):
            if sku and (s, n) not in first:
                first[s, n] = sku
        for (s, n), sku in sorted(first.items(), key=lambda x: (x[0][1], x[0][0])):
            if sku not in skus:
                skus.add(sku)
                ids.add((s, n))
                want.append((n, sku))
        df = spark.createDataFrame([(s, n, at, json.dumps({"sku": sku, "title": "t", "category": "c"})) for s, n, at, sku in lines],
                                   "source string, seq long, arrived_at string, body string").repartition(4).selectExpr(
            "*", "'inventory' AS entity", "NULL AS target_id")
        r = ingest.ingest_inventory(df, _inventory(spark, [("i0", "C")]))
        accepted, rejected = _results(r)
        assert accepted == sorted(want) and len(accepted) + len(rejected) == len(lines)


def test_every_line_is_accepted_or_rejected(spark):
    path = scratch_path(spark, "lines")
    env = lambda **k: json.dumps({"source": "s", "arrived_at": "2024-01-01 00:00:00"} | k)
    lines = ["{broken", "", "[1, 2]", env(seq=1, entity="sale", body=json.dumps(SALE)), env(seq=2, entity="refund", body="{}"),
             env(seq="x", entity="sale", body="{}"), env(entity="sale", body="{}"), env(seq=4, body="{}"),
             env(seq=5, entity="lot", body='{"title": "L"}'), env(seq=6, entity="link", body="{}")]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    p = read_payloads(spark, path)
    out = {x.seq: x.reason for x in ingest.misfits(p).collect() if x.seq is not None}
    assert out == {2: "unknown_entity", 4: "bad_envelope"}
    rejected = ingest.all_rejects(p, _inventory(spark, []))
    accepted = ingest.ingest_sales(p).accepted.count() + ingest.ingest_lots(p).accepted.count()
    assert accepted == 2
    # the blank line is no line; the link is a change, which the change jobs answer
    assert accepted + rejected.count() + 1 == len(lines) - 1


def test_a_number_out_of_range_fails_its_patch_alone(spark):
    inv = _inventory(spark, [("i1", "A")])
    a = changes.patch_inventory(inv, envelopes(spark, [(1, "inventory_patch", "i1", {"quantity": 5}),
                                                       (2, "inventory_patch", "i1", {"quantity": 1e300, "status": "sold"})]))
    assert [(r.quantity, r.status) for r in a.table.collect()] == [(5, "active")]
    assert {r.outcome: r.n for r in a.outcomes.collect()} == {"ok": 1, "update_failed": 1}
    e = changes.edit_delete_items(inv, envelopes(spark, [(1, "item_edit", "i1", {"cost_cents": 7}),
                                                         (2, "item_edit", "i1", {"cost_cents": -1e300})]))
    assert [r.cost_cents for r in e.table.collect()] == [7]


def test_one_huge_request_harms_no_other(spark):
    good = {"date": "2024-01-01", "category": "c", "type": "mileage", "miles": 10, "rate_usd_per_mile": 0.5}
    huge = good | {"miles": 9e15, "rate_usd_per_mile": 1e12}
    r = ingest.ingest_expenses(envelopes(spark, [(1, "expense", None, good), (2, "expense", None, huge)]))
    assert [(x.seq, x.calc_amount_cents) for x in r.accepted.collect()] == [(1, 500)]
    assert [(x.seq, x.reason) for x in r.rejected.collect()] == [(2, "amount_out_of_range")]


def test_profit_marks_an_overflow(spark):
    from consign.schemas import SALES
    inv = _inventory(spark, [("i1", "A")]).withColumn("cost_cents", F.lit(9 * 10 ** 15))
    sale = lambda i, qty: (i, "2024-01-01", "i1", "A", qty, 100, 0, 0, 0, 0, 0, "o", None, "x")
    out = {r.id: r for r in profit.sales_profit(spark.createDataFrame([sale("s1", 1), sale("s2", 9 * 10 ** 15)], SALES), inv).collect()}
    assert out["s1"].cogs_cents == 9 * 10 ** 15 and out["s2"].cogs_cents is None and out["s2"].gross_profit_cents is None
    assert out["s2"].revenue_cents == 100


def test_json_as_javascript_reads_it(spark):
    body = json.dumps(SALE)
    rows = [(1, "sale", None, body + " junk"), (2, "sale", None, body + body), (3, "sale", None, body + ",{}"),
            (4, "sale", None, "\ufeff" + body), (5, "sale", None, '{"sku": "X", ' + body[1:]), (6, "sale", None, " " + body + "\n"),
            (7, "sale", None, ""), (8, "sale", None, None), (9, "sale", None, body + "]"), (10, "sale", None, body + "] junk"),
            (11, "sale", None, body + "],[1"), (12, "sale", None, body + "}"), (13, "sale", None, body + ',"v":1'),
            (14, "sale", None, body + "},{"), (15, "sale", None, body + ",")]
    for n, note in enumerate(["1e-7", "1.5e21", "12.50", "0.00001", "1e22", "123456789.125", "-2.5e-9", "1e3"], 20):
        rows.append((n, "sale", None, body[:-1] + f', "note": {note}}}'))
    r = ingest.ingest_sales(envelopes(spark, rows))
    got = {x.seq: x for x in r.accepted.collect()}
    assert set(got) == {4, 5, 6, *range(20, 28)} and got[5].sku == "A"
    assert [got[n].note for n in range(20, 28)] == ["1e-7", "1.5e+21", "12.5", "0.00001", "1e+22", "123456789.125", "-2.5e-9", "1000"]


def test_an_edit_without_fields_is_that_first(spark):
    inv = _inventory(spark, [("i1", "A")])
    rows = [(1, "item_delete", "i1", None), (2, "item_edit", "i1", {}), (3, "item_edit", "zz", {}), (4, "item_edit", "i1", {"title": "T"})]
    a = changes.edit_delete_items(inv, envelopes(spark, rows))
    got = {(r.entity, r.outcome): r.n for r in a.outcomes.collect()}
    assert got == {("item_edit", "no_fields"): 2, ("item_edit", "not_found"): 1, ("item_delete", "ok"): 1}


def test_requests_without_a_sku_spread_over_the_join(spark):
    inv = _inventory(spark, [("i1", "A"), ("i2", "")])
    r = changes.resolve_links(envelopes(spark, [(i, "link", "l", "{bad") for i in range(50)] + [(99, "link", "l", {"sku": "A"})]), inv)
    assert {x.reason for x in r.collect() if x.seq < 50} == {"sku required"} and r.filter("inventory_id = 'i1'").count() == 1


def test_lists_without_a_limit(spark):
    from consign.operators import views
    inv = _inventory(spark, [(f"i{n}", f"S{n}") for n in range(300)])
    assert views.list_inventory(inv, None).count() == 300 and views.list_inventory(inv).count() == 200
