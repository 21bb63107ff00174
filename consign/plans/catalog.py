"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query derives the ledger tables from the test tables in ``sf_dir`` and
runs one library operator over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import js, text
from ..operators import profit, report, views
from ..operators.legacy import unify_sales
from ..sources import ledger as L
from . import params as P

Query = Callable[[SparkSession, str], DataFrame]


def _ledger(spark: SparkSession, sf_dir: str) -> L.Ledger:
    return L.ledger_from_testdata(spark, sf_dir)


def q_report_summary(spark, sf_dir):
    lg = _ledger(spark, sf_dir)
    return report.report_summary(lg.inventory, lg.sales, lg.expenses, P.REPORT_FROM, P.REPORT_TO)


def q_report_summary_text(spark, sf_dir):
    return report.report_summary_text(q_report_summary(spark, sf_dir))


def q_sales_totals(spark, sf_dir):
    return report.sales_totals(_ledger(spark, sf_dir).sales, P.REPORT_FROM, P.REPORT_TO)


def q_expense_totals(spark, sf_dir):
    return report.expense_totals(_ledger(spark, sf_dir).expenses, P.REPORT_FROM, P.REPORT_TO)


def q_inventory_by_status(spark, sf_dir):
    return report.inventory_by_status(_ledger(spark, sf_dir).inventory)


def q_inventory_status_map(spark, sf_dir):
    by_status = report.inventory_status_map(_ledger(spark, sf_dir).inventory)
    return by_status.select(F.explode("inventory_by_status").alias("status", "cnt"))  # a row an entry


def q_list_inventory(spark, sf_dir):
    return views.list_inventory(_ledger(spark, sf_dir).inventory, P.LIST_CAP)


def q_list_inventory_100(spark, sf_dir):
    return views.list_inventory(_ledger(spark, sf_dir).inventory, P.LIST_CAP_OLD)


def q_list_sales(spark, sf_dir):
    return views.list_sales(_ledger(spark, sf_dir).sales, P.SALES_FROM, P.SALES_TO, P.LIST_CAP)


def q_list_expenses(spark, sf_dir):
    return views.list_expenses(_ledger(spark, sf_dir).expenses, P.EXPENSES_FROM, P.EXPENSES_TO,
                               P.LIST_CAP)


def q_list_lots(spark, sf_dir):
    return views.list_lots(_ledger(spark, sf_dir).lots, P.LIST_CAP)


def q_sales_in_range(spark, sf_dir):
    return views.sales_in_range(_ledger(spark, sf_dir).sales, P.SALES_FROM, P.SALES_TO)


def q_expenses_in_range(spark, sf_dir):
    return views.expenses_in_range(_ledger(spark, sf_dir).expenses, P.EXPENSES_FROM, P.EXPENSES_TO)


def q_lot_items(spark, sf_dir):
    lg = _ledger(spark, sf_dir)
    return views.lot_items(lg.inventory_lots, lg.inventory, P.LOT_ID, P.LOT_ITEMS_CAP)


def q_photos_for_item(spark, sf_dir):
    return views.photos_for_item(_ledger(spark, sf_dir).photos, P.PHOTO_ITEM)


def q_photo_by_id(spark, sf_dir):
    return views.photo_by_id(_ledger(spark, sf_dir).photos, P.PHOTO_ID)


def q_sales_fees_total(spark, sf_dir):
    return views.sales_fees_total(_ledger(spark, sf_dir).sales)


def q_sku_match_ci(spark, sf_dir):
    lg = _ledger(spark, sf_dir)
    # Requests: every sale's SKU, half of them lower-cased and padded.
    mangled = F.when(F.col("qty") % 2 == 0,
                     F.concat(F.lit("  "), F.lower(F.col("sku")), F.lit("\t"))).otherwise(F.col("sku"))
    req = lg.sales.select("id", mangled.alias("request_sku"))
    return views.sku_match_ci(req, lg.inventory)


def q_sales_unified(spark, sf_dir):
    lg = _ledger(spark, sf_dir)
    legacy = L.sales_legacy_from(L.load_raw(spark, sf_dir, "orders"))
    return unify_sales(lg.sales, legacy)


def q_sales_profit(spark, sf_dir):
    lg = _ledger(spark, sf_dir)
    return profit.sales_profit(lg.sales, lg.inventory)


def q_sales_profit_titled(spark, sf_dir):
    lg = _ledger(spark, sf_dir)
    return profit.sales_profit_titled(lg.sales, lg.inventory)


def q_usd_to_cents(spark, sf_dir):
    ev = L.load_raw(spark, sf_dir, "events")
    v = F.col("value")
    return ev.select("event_id", js.round_half_up_cents(v).alias("value_cents"),
                     js.round_half_up_cents(-v).alias("neg_value_cents"),
                     js.round_half_up_cents(v / 3).alias("third_cents"))


def q_mileage_amount(spark, sf_dir):
    e = _ledger(spark, sf_dir).expenses
    return e.select("id", "type", js.mileage_amount(F.col("type"), F.col("miles"),
                                                    F.col("rate_cents_per_mile")).alias("mileage_cents"))


def q_normalize_status(spark, sf_dir):
    inv = _ledger(spark, sf_dir).inventory
    raw = (F.when(F.col("cost_cents") % 3 == 0, F.upper("status"))
           .when(F.col("cost_cents") % 3 == 1, F.col("status")).otherwise(F.col("title")))
    return (inv.select("id", raw.alias("raw_status"))
            .withColumn("status_norm", js.normalize_status(F.col("raw_status"))))


def q_sku_upper(spark, sf_dir):
    inv = _ledger(spark, sf_dir).inventory
    raw_sku = F.concat(F.lit(" "), F.lower("sku"), F.lit("\t"))
    cat = F.when(F.col("quantity") % 5 == 0, F.lit("")).otherwise(F.col("category"))
    return inv.select("id", js.sku_upper(raw_sku).alias("sku_norm"),
                      js.default_if_empty(cat, "Misc").alias("category_norm"))


def q_photo_key_parts(spark, sf_dir):
    ph = _ledger(spark, sf_dir).photos
    item, fname = text.key_parts(F.col("r2_key"))
    return ph.select("id", item.alias("key_item"), fname.alias("key_file"))


def q_normalize_text_eol(spark, sf_dir):
    docs = L.load_raw(spark, sf_dir, "documents")
    d = F.col("doc_id")
    t1 = F.when(d % 2 == 0, F.regexp_replace("text", "\n", "\r\n")).otherwise(F.col("text"))
    t2 = F.concat(F.when(d % 3 == 0, F.lit("\ufeff")).otherwise(F.lit("")), t1)
    return docs.select("doc_id", text.strip_cr_bom(t2).alias("text_clean"))


BASE: dict[str, Query] = {
    "report_summary": q_report_summary,
    "report_summary_text": q_report_summary_text,
    "sales_totals": q_sales_totals,
    "expense_totals": q_expense_totals,
    "inventory_by_status": q_inventory_by_status,
    "inventory_status_map": q_inventory_status_map,
    "list_inventory": q_list_inventory,
    "list_inventory_100": q_list_inventory_100,
    "list_sales": q_list_sales,
    "list_expenses": q_list_expenses,
    "list_lots": q_list_lots,
    "sales_in_range": q_sales_in_range,
    "expenses_in_range": q_expenses_in_range,
    "lot_items": q_lot_items,
    "photos_for_item": q_photos_for_item,
    "photo_by_id": q_photo_by_id,
    "sales_fees_total": q_sales_fees_total,
    "sku_match_ci": q_sku_match_ci,
    "sales_unified": q_sales_unified,
    "sales_profit": q_sales_profit,
    "sales_profit_titled": q_sales_profit_titled,
    "usd_to_cents": q_usd_to_cents,
    "mileage_amount": q_mileage_amount,
    "normalize_status": q_normalize_status,
    "sku_upper": q_sku_upper,
    "photo_key_parts": q_photo_key_parts,
    "normalize_text_eol": q_normalize_text_eol,
}


def all_queries() -> dict[str, Query]:
    from .catalog_changes import CHANGES
    from .catalog_files import FILES
    out = dict(BASE)
    out.update(CHANGES)
    out.update(FILES)
    return out
