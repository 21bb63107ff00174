"""Explicit schemas of the ledger tables and the change envelope.

Money is integer cents (LongType), dates are text compared as text, flags are
0/1 longs.  Never infer schemas.
"""

from pyspark.sql.types import LongType, StringType, StructField, StructType


def _s(*names_types):
    return StructType([StructField(n, t, True) for n, t in names_types])


S, L = StringType(), LongType()

INVENTORY = _s(("id", S), ("sku", S), ("title", S), ("category", S), ("status", S),
               ("cost_cents", L), ("quantity", L), ("listed_date", S),
               ("draft_created_at", S), ("created_at", S))

SALES = _s(("id", S), ("date", S), ("inventory_id", S), ("sku", S), ("qty", L),
           ("sold_price_cents", L), ("buyer_shipping_cents", L), ("platform_fees_cents", L),
           ("promo_fee_cents", L), ("shipping_label_cost_cents", L), ("other_costs_cents", L),
           ("order_ref", S), ("note", S), ("created_at", S))

# Older Sales layout: ``sold_date`` instead of ``date``, no order_ref / note.
SALES_LEGACY = _s(("id", S), ("inventory_id", S), ("sku", S), ("qty", L),
                  ("sold_price_cents", L), ("buyer_shipping_cents", L),
                  ("platform_fees_cents", L), ("promo_fee_cents", L),
                  ("shipping_label_cost_cents", L), ("other_costs_cents", L),
                  ("sold_date", S), ("created_at", S))

EXPENSES = _s(("id", S), ("date", S), ("category", S), ("amount_cents", L), ("vendor", S),
              ("note", S), ("sku", S), ("type", S), ("miles", L), ("rate_cents_per_mile", L),
              ("calc_amount_cents", L), ("deductible", L), ("created_at", S))

LOTS = _s(("id", S), ("title", S), ("note", S), ("status", S), ("created_at", S))

INVENTORY_LOTS = _s(("inventory_id", S), ("lot_id", S))

# The last link or unlink of each (item, lot) of a batch.
LINK_LOG = _s(("inventory_id", S), ("lot_id", S), ("last_op", S))

# Roll-ups: the sums of a month's rows of a batch (``operators.report``).
SALES_MONTHS = _s(("month", S), ("gross", L), ("ship", L), ("costs", L), ("qty", L))
EXPENSES_MONTHS = _s(("month", S), ("amount", L), ("mileage", L))

PHOTOS = _s(("id", S), ("inventory_id", S), ("r2_key", S), ("content_type", S),
            ("size_bytes", L), ("created_at", S))

# One change request per JSON line; ``body`` is the raw request text.  ``seq`` orders
# the requests and is unique within a ``source`` (a device, an import).
ENVELOPE = _s(("source", S), ("seq", L), ("entity", S), ("target_id", S), ("arrived_at", S), ("body", S))
# As read: a line that is no envelope is kept as text.
CORRUPT = "_corrupt_record"
ENVELOPE_READ = StructType([*ENVELOPE.fields, StructField(CORRUPT, S, True)])
INSERTS = ("inventory", "sale", "expense", "lot")
ENTITIES = INSERTS + ("inventory_patch", "lot_patch", "link", "unlink", "item_edit", "item_delete")

# Fixed values of the reference's data model.
INVENTORY_STATUSES = ("staged", "draft", "active", "sold")
LOT_STATUSES = ("open", "closed")
DEFAULT_FROM = "0000-01-01"
DEFAULT_TO = "9999-12-31"
