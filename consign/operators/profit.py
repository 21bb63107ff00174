"""Per-sale profit views (J2 ``SalesReport``, J3 ``sales_profit_v``).

The reference joins ``ON s.inventory_id = i.id OR s.sku = i.sku``.  An OR of
two equalities has no equi-key, so Spark would plan a BroadcastNestedLoopJoin:
quadratic, and it must broadcast the inventory.  Because ``id`` is a key and
``sku`` is unique, the same rows come from two left equi-joins, each adding
at most one item, followed by ``explode_outer`` over the distinct matches:

* a sale hitting one item by id and another by sku yields two rows,
* a sale hitting the same item both ways yields one row,
* a sale hitting nothing yields one row with NULL item columns.

Matches depend only on a sale's (inventory_id, sku) pair, so the distinct pairs
are resolved first and the sales meet the result in one equi-join: the big table
is shuffled once instead of twice, and not at all where the resolved pairs are small
enough for adaptive execution to broadcast them.  Nothing runs while the query is built.
NULL join keys never match, so they are replaced by a distinct non-matching
value: otherwise every NULL ``inventory_id`` would hash to the same shuffle
partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scaled_shuffles

# A key prefix no real id or sku starts with (a NUL character).
_NOMATCH = "\u0000"


def _spread_nulls(key: Column, other: Column) -> Column:
    """A NULL key never matches; give it a distinct non-matching value so NULL
    keys spread over the shuffle partitions instead of landing on one."""
    return F.coalesce(key, F.concat(F.lit(_NOMATCH), F.coalesce(other, F.lit(""))))


def _item(prefix: str) -> Column:
    return F.struct(F.col("id").alias("item_id"), F.col("sku").alias("item_sku"),
                    F.col("title").alias("item_title"),
                    F.col("cost_cents").alias("item_cost_cents")).alias(prefix)


def _matches() -> Column:
    return F.array_distinct(F.filter(F.array(F.col("_a"), F.col("_b")), lambda x: x.isNotNull()))


def matched_sales(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Sales exploded to one row per distinct matching item (item NULL if none).

    The distinct pairs are combined map-side; their number grows with the
    catalogue, not with the sales.  A hot pair is a skewed left side of a left
    outer join, which AQE splits.
    """
    scaled_shuffles(sales.sparkSession)
    by_id = inventory.select(F.col("id").alias("_aid"), _item("_a"))
    by_sku = inventory.select(F.col("sku").alias("_bsku"), _item("_b"))
    pairs = sales.select(F.col("inventory_id").alias("_pid"), F.col("sku").alias("_psku")).dropDuplicates()
    resolved = (pairs.join(by_id, _spread_nulls(F.col("_pid"), F.col("_psku")) == F.col("_aid"), "left")
                .join(by_sku, _spread_nulls(F.col("_psku"), F.col("_pid")) == F.col("_bsku"), "left")
                .select("_pid", "_psku", _matches().alias("_m")))
    on = sales["inventory_id"].eqNullSafe(resolved["_pid"]) & sales["sku"].eqNullSafe(resolved["_psku"])
    out = sales.join(resolved, on, "left").withColumn("m", F.explode_outer("_m"))
    return out.drop("_pid", "_psku", "_m")


def _money(m: DataFrame) -> dict[str, Column]:
    revenue = F.col("sold_price_cents") + F.coalesce(F.col("buyer_shipping_cents"), F.lit(0))
    # NULL marks a product that no integer holds (and a profit that rests on it): never a silent 0.
    cogs = F.try_multiply(F.coalesce(F.col("m.item_cost_cents"), F.lit(0)), F.col("qty"))
    fees = F.coalesce(F.col("platform_fees_cents"), F.lit(0))
    promo = F.coalesce(F.col("promo_fee_cents"), F.lit(0))
    label = F.coalesce(F.col("shipping_label_cost_cents"), F.lit(0))
    other = F.coalesce(F.col("other_costs_cents"), F.lit(0))
    return {
        "revenue_cents": revenue, "cogs_cents": cogs, "fees_cents": fees,
        "promo_fee_cents": promo, "ship_label_cents": label, "other_costs_cents": other,
        "gross_profit_cents": F.try_subtract(revenue - fees - promo - label - other, cogs),
    }


def sales_profit(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """``SalesReport`` (older layout name ``sold_date`` for the date)."""
    m = matched_sales(sales, inventory)
    money = _money(m)
    return m.select(F.col("id"), F.col("sku"), F.col("qty"), F.col("date").alias("sold_date"),
                    *[c.cast("bigint").alias(n) for n, c in money.items()])


def sales_profit_titled(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """``sales_profit_v``: adds the item title and ``COALESCE(s.sku, i.sku)``."""
    m = matched_sales(sales, inventory)
    money = _money(m)
    return m.select(F.col("id"), F.col("date"),
                    F.coalesce(F.col("sku"), F.col("m.item_sku")).alias("sku"),
                    F.col("m.item_title").alias("title"), F.col("qty"),
                    *[c.cast("bigint").alias(n) for n, c in money.items()])
