"""List and lookup views.

Top-N views plan as ``TakeOrderedAndProject``: each task keeps its own N best
rows and only N rows per task reach the final merge, so no full sort or
shuffle of the input happens.  ``id`` is the last sort key everywhere, so the
limited set is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.js import js_trim
from ..session import fits_broadcast
from .filters import in_optional_range


def _top(df: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of a sorted list; ``None`` for all of them."""
    return df if limit is None else df.limit(limit)


INVENTORY_COLS = ("id", "sku", "title", "category", "status", "cost_cents", "quantity", "created_at")
SALES_COLS = ("id", "date", "inventory_id", "sku", "qty", "sold_price_cents",
              "buyer_shipping_cents", "platform_fees_cents", "promo_fee_cents",
              "shipping_label_cost_cents", "other_costs_cents", "order_ref", "note", "created_at")
EXPENSE_COLS = ("id", "date", "category", "amount_cents", "vendor", "note", "sku", "type", "miles",
                "rate_cents_per_mile", "calc_amount_cents", "deductible", "created_at")
LOT_COLS = ("id", "title", "note", "status", "created_at")
LOT_ITEM_COLS = ("id", "sku", "title", "category", "status", "quantity", "cost_cents", "created_at")
PHOTO_COLS = ("id", "r2_key", "content_type", "size_bytes", "created_at")


def list_inventory(inventory: DataFrame, limit: int | None = 200) -> DataFrame:
    """Newest items first."""
    return _top(inventory.select(*INVENTORY_COLS).orderBy(F.col("created_at").desc(), F.col("id").asc()), limit)


def list_sales(sales: DataFrame, frm: str | None = None, to: str | None = None,
               limit: int | None = 200) -> DataFrame:
    """T3 after P2."""
    s = in_optional_range(sales, frm, to).select(*SALES_COLS)
    return _top(s.orderBy(F.col("date").desc(), F.col("created_at").desc(), F.col("id").asc()), limit)


def list_expenses(expenses: DataFrame, frm: str | None = None, to: str | None = None,
                  limit: int | None = 200) -> DataFrame:
    """T4 after P2."""
    e = in_optional_range(expenses, frm, to).select(*EXPENSE_COLS)
    return _top(e.orderBy(F.col("date").desc(), F.col("created_at").desc(), F.col("id").asc()), limit)


def list_lots(lots: DataFrame, limit: int | None = 200) -> DataFrame:
    """T5."""
    return _top(lots.select(*LOT_COLS).orderBy(F.col("created_at").desc(), F.col("id").asc()), limit)


def sales_in_range(sales: DataFrame, frm: str | None = None, to: str | None = None) -> DataFrame:
    """P2 without a cap: every sale in the range."""
    return in_optional_range(sales, frm, to).select(*SALES_COLS)


def expenses_in_range(expenses: DataFrame, frm: str | None = None, to: str | None = None) -> DataFrame:
    return in_optional_range(expenses, frm, to).select(*EXPENSE_COLS)


def lot_items(inventory_lots: DataFrame, inventory: DataFrame, lot_id: str,
              limit: int | None = 500) -> DataFrame:
    """J1 + T6: items of one lot, newest first.

    The lot filter is pushed into the bridge scan.  One lot's items are few beside
    the inventory, so they are broadcast where their counted size is within the
    session's threshold (the count reads the filtered bridge alone), and the inventory
    is then not shuffled; a larger lot is a shuffle join.
    """
    il = inventory_lots.where(F.col("lot_id") == F.lit(lot_id)).select("inventory_id")
    if fits_broadcast(il):
        il = F.broadcast(il)
    j = il.join(inventory.select(*LOT_ITEM_COLS), il["inventory_id"] == inventory["id"], "inner")
    return _top(j.select(*[inventory[c] for c in LOT_ITEM_COLS])
                .orderBy(F.col("created_at").desc(), F.col("id").asc()), limit)


def photos_for_item(photos: DataFrame, inventory_id: str) -> DataFrame:
    """P4 + T7: photos of one item, newest first, no cap."""
    return (photos.where(F.col("inventory_id") == F.lit(inventory_id)).select(*PHOTO_COLS)
            .orderBy(F.col("created_at").desc(), F.col("id").asc()))


def photo_by_id(photos: DataFrame, photo_id: str) -> DataFrame:
    """Point lookup ``WHERE id = ? LIMIT 1``."""
    return (photos.where(F.col("id") == F.lit(photo_id))
            .select("id", "r2_key", "content_type").orderBy("id").limit(1))


IN_LIST = 10  # values of one IN that Parquet's row-group filters still look at one by one


def lookup_values(table: DataFrame, key: str, values: list) -> DataFrame:
    """P4 and J4 for values at hand: the rows whose ``key`` is one of them.

    The values reach the scan as INs short enough to be looked up in each row group's statistics
    and Bloom filter (``sources.ledger.BLOOM``), so row groups without any are skipped.
    """
    wanted = sorted({v for v in values if v is not None})
    found = F.lit(False)
    for i in range(0, len(wanted), IN_LIST):
        found = found | F.col(key).isin(wanted[i:i + IN_LIST])
    return table.where(found)


def lookup_by_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """P4 in bulk: a semi-join against a key table instead of N point queries."""
    return table.join(keys.select(key).dropDuplicates(), key, "left_semi")


def sku_match_ci(requests: DataFrame, inventory: DataFrame, sku_col: str = "request_sku") -> DataFrame:
    """P5: resolve request SKUs case-insensitively and trimmed.

    The reference takes the first match in list order (newest first); with a
    unique normalised key that is the only match.  Several items sharing a
    normalised SKU are reduced to the newest (then lowest id) before the
    request join: the lowest id for each key and time, then the id at the latest
    time of each key, from one scan of the inventory.  Both aggregates combine map-side, so
    the request join sees one row per key and a hot request key is left to AQE's
    skew-join split of the request side.
    """
    norm = lambda c: F.lower(js_trim(c))
    keyed = inventory.select(norm(F.col("sku")).alias("k"), "id", "created_at")
    lowest = keyed.groupBy("k", "created_at").agg(F.min("id").alias("id"))
    ranked = lowest.groupBy("k").agg(F.max_by("id", "created_at").alias("inventory_id"))
    req = requests.withColumn("k", norm(F.col(sku_col)))
    return req.join(ranked, "k", "left").drop("k")


def sales_fees_total(sales: DataFrame) -> DataFrame:
    """The list's "Fees+" column, per sale."""
    return sales.select("id", (F.col("platform_fees_cents") + F.col("promo_fee_cents")
                               + F.col("shipping_label_cost_cents") + F.col("other_costs_cents"))
                        .alias("fees_total_cents"))
