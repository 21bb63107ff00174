"""Registered queries over change-request batches derived from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, ingest
from ..operators.views import INVENTORY_COLS
from ..sources import ledger as L
from ..sources import payloads as PL


def _raw(spark, sf_dir, name):
    return L.load_raw(spark, sf_dir, name)


def q_ingest_inventory(spark, sf_dir):
    existing = L.inventory_from(_raw(spark, sf_dir, "part"))
    requests = PL.delivered_again(PL.inventory_payloads(_raw(spark, sf_dir, "part")))
    return ingest.ingest_inventory(requests, existing).accepted


def q_ingest_sales(spark, sf_dir):
    return ingest.ingest_sales(PL.sale_payloads(_raw(spark, sf_dir, "lineitem"))).accepted


def q_ingest_expenses(spark, sf_dir):
    return ingest.ingest_expenses(PL.expense_payloads(_raw(spark, sf_dir, "events"))).accepted


def q_ingest_lots(spark, sf_dir):
    return ingest.ingest_lots(PL.lot_payloads(_raw(spark, sf_dir, "supplier"))).accepted


def q_ingest_rejects(spark, sf_dir):
    existing = L.inventory_from(_raw(spark, sf_dir, "part"))
    return ingest.all_rejects(PL.ingest_payloads(spark, sf_dir), existing)


def q_ingest_parse_errors(spark, sf_dir):
    return ingest.parse_errors(PL.ingest_payloads(spark, sf_dir))


def q_ingest_numbers(spark, sf_dir):
    return ingest.number_fields(PL.sale_payloads(_raw(spark, sf_dir, "lineitem")), "sale", "qty")


def q_cost_precedence(spark, sf_dir):
    return ingest.cost_fields(PL.inventory_payloads(_raw(spark, sf_dir, "part")))


def q_patch_inventory(spark, sf_dir):
    inv = L.inventory_from(_raw(spark, sf_dir, "part"))
    a = changes.patch_inventory(inv, PL.inventory_patch_payloads(_raw(spark, sf_dir, "lineitem")))
    return a.table.select(*INVENTORY_COLS)


def q_patch_lots(spark, sf_dir):
    lots = L.lots_from(_raw(spark, sf_dir, "supplier"))
    return changes.patch_lots(lots, PL.lot_patch_payloads(_raw(spark, sf_dir, "lineitem"))).table


def q_link_items(spark, sf_dir):
    li = _raw(spark, sf_dir, "lineitem")
    inv = L.inventory_from(_raw(spark, sf_dir, "part"))
    return changes.link_items(L.inventory_lots_from(li), PL.link_payloads(_raw(spark, sf_dir, "orders")),
                              inv).table


def q_link_unresolved(spark, sf_dir):
    inv = L.inventory_from(_raw(spark, sf_dir, "part"))
    return changes.unresolved_links(PL.link_payloads(_raw(spark, sf_dir, "orders")), inv)


def q_unlink_items(spark, sf_dir):
    li = _raw(spark, sf_dir, "lineitem")
    inv = L.inventory_from(_raw(spark, sf_dir, "part"))
    return changes.apply_link_unlink(L.inventory_lots_from(li), PL.link_unlink_payloads(li), inv).table


def q_change_outcomes(spark, sf_dir):
    li = _raw(spark, sf_dir, "lineitem")
    inv = L.inventory_from(_raw(spark, sf_dir, "part"))
    lots = L.lots_from(_raw(spark, sf_dir, "supplier"))
    a = changes.patch_inventory(inv, PL.inventory_patch_payloads(li)).outcomes
    b = changes.patch_lots(lots, PL.lot_patch_payloads(li)).outcomes
    c = changes.apply_link_unlink(L.inventory_lots_from(li), PL.link_unlink_payloads(li), inv).outcomes
    return a.unionByName(b).unionByName(c).select("entity", "outcome", F.col("n").cast("bigint").alias("n"))


def q_edit_delete_items(spark, sf_dir):
    inv = L.inventory_from(_raw(spark, sf_dir, "part"))
    a = changes.edit_delete_items(inv, PL.item_edit_payloads(_raw(spark, sf_dir, "orders")))
    return a.table.select(*INVENTORY_COLS, "listed_date")


def q_edit_delete_outcomes(spark, sf_dir):
    inv = L.inventory_from(_raw(spark, sf_dir, "part"))
    a = changes.edit_delete_items(inv, PL.item_edit_payloads(_raw(spark, sf_dir, "orders")))
    return a.outcomes.select("entity", "outcome", F.col("n").cast("bigint").alias("n"))


CHANGES = {
    "ingest_inventory": q_ingest_inventory,
    "ingest_sales": q_ingest_sales,
    "ingest_expenses": q_ingest_expenses,
    "ingest_lots": q_ingest_lots,
    "ingest_rejects": q_ingest_rejects,
    "ingest_parse_errors": q_ingest_parse_errors,
    "ingest_numbers": q_ingest_numbers,
    "cost_precedence": q_cost_precedence,
    "patch_inventory": q_patch_inventory,
    "patch_lots": q_patch_lots,
    "link_items": q_link_items,
    "link_unresolved": q_link_unresolved,
    "unlink_items": q_unlink_items,
    "change_outcomes": q_change_outcomes,
    "edit_delete_items": q_edit_delete_items,
    "edit_delete_outcomes": q_edit_delete_outcomes,
}
