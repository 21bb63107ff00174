"""Insert requests -> accepted rows + quarantine.

Each ``ingest_*`` takes an envelope DataFrame (see ``sources.payloads``) and
returns ``Ingested(accepted, rejected)``: accepted rows in the table's shape,
rejected rows as ``(source, seq, entity, reason)``.  A line that is no envelope,
or names no known entity, is rejected by ``misfits``; so every input line is
accepted or rejected once.

Parsing and coercion are per-row projections (no shuffle).  Only inventory
shuffles, for the unique SKU (J6).  A request is a (source, seq); the first valid
line that delivers it counts, in the order of arrival time and content, and a line
delivered again is refused as the database would refuse its id.  Of the requests the first
per SKU by (seq, source) wins, unless the SKU is stored.  Equal lines of an input
partition are counted, first lines and first requests are minima: partial aggregates, so a
line, a number or a SKU sent a million times costs a row a task in the shuffle.  The
lines then look themselves up among the winners, in a join that adaptive execution can split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import js
from ..schemas import CORRUPT, ENTITIES, INSERTS, LOT_STATUSES
from ..session import scratch_path

# The reference's messages (the last four reasons are this library's own).
REQUIRED = {
    "inventory": "sku/title/category required",
    "sale": "date/sku/order_ref required",
    "expense": "date/category required",
    "lot": "title required",
}
INSERT_FAILED = "insert_failed"
BAD_STATUS = "bad status"
INVALID_BODY = "invalid_body"
OUT_OF_RANGE = "amount_out_of_range"
BAD_ENVELOPE = "bad_envelope"
UNKNOWN_ENTITY = "unknown_entity"


@dataclass
class Ingested:
    """``checked`` has every request once, with the columns of the accepted rows and ``reason``
    (NULL: accepted); the other two are views of it."""

    checked: DataFrame

    @property
    def accepted(self) -> DataFrame:
        return self.checked.where(F.col("reason").isNull()).drop("_source", "_entity", "reason")

    @property
    def rejected(self) -> DataFrame:
        return self.checked.where(F.col("reason").isNotNull()).select(
            F.col("_source").alias("source"), "seq", F.col("_entity").alias("entity"), "reason")


def _optional(payloads: DataFrame, name: str) -> Column:
    return F.col(name) if name in payloads.columns else F.lit(None).cast("string").alias(name)


def _is_envelope(payloads: DataFrame) -> Column:
    whole = F.col("seq").isNotNull() & F.col("entity").isNotNull()
    return whole & F.col(CORRUPT).isNull() if CORRUPT in payloads.columns else whole


def parsed(payloads: DataFrame, entity: str) -> DataFrame:
    """Keep one entity's envelopes and parse their bodies into VARIANT ``v``."""
    mine = payloads.where(_is_envelope(payloads) & (F.col("entity") == F.lit(entity)))
    return js.with_body(mine.select(_optional(payloads, "source"), "seq", "entity", "target_id", "arrived_at", "body")
                        ).drop("body")


def misfits(payloads: DataFrame) -> DataFrame:
    """S7 quarantine: lines that are no envelope, and envelopes of an unknown entity."""
    known = F.col("entity").isin(*ENTITIES)
    rows = payloads.where(~F.coalesce(_is_envelope(payloads) & known, F.lit(False)))
    reason = F.when(_is_envelope(payloads), F.lit(UNKNOWN_ENTITY)).otherwise(F.lit(BAD_ENVELOPE))
    return rows.select(_optional(payloads, "source"), "seq", "entity", reason.alias("reason"))


def row_id(source: Column, entity: Column, seq: Column) -> Column:
    """A deterministic id from (source, entity, seq); ``uuid()`` would change under task retry."""
    return F.sha2(F.concat_ws("|", F.coalesce(source, F.lit("")), entity, seq.cast("string")), 256)


def _id() -> Column:
    return row_id(F.col("source"), F.col("entity"), F.col("seq")).alias("id")


ORDER = ("seq", "source")  # requests apply by number, then by source


def created_at(arrived_at: Column) -> Column:
    """The payload's arrival time; server time only when it is missing."""
    return F.coalesce(arrived_at, F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))


def fence(df: DataFrame) -> DataFrame:
    """A plan barrier that keeps later filters above the parsing projections.

    Catalyst pushes a filter through projections by inlining their aliases.
    For ``reason IS NULL`` that would copy the JSON parse and every field
    rule into the filter condition many times over.  Filters are never
    pushed below a Generate, and ``inline`` of a one-element array emits
    exactly the input row, so this costs no shuffle and no extra pass.
    """
    cols = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return df.selectExpr(f"inline(array(named_struct({cols})))")


def _split(df: DataFrame, reason: Column, cols: list[Column]) -> Ingested:
    """Accepted rows (``cols``) and rejects (source, seq, entity, reason) from one pass.

    Only the output columns and the reason go through the fence.  Column
    pruning does not reach into the generator's struct, so whatever enters the
    fence is computed for every row; passing ``df`` whole would evaluate every
    reading of every body field (and copy the VARIANT body) even where no rule
    uses it.
    """
    return Ingested(fence(df.select(*cols, F.col("entity").alias("_entity"), F.col("source").alias("_source"),
                                    reason.alias("reason"))))


def _body_reason(v: Column) -> Column:
    # JSON ``null`` as the whole body made the reference throw; reject it.
    return F.when(js.is_json_null_value(v), F.lit(INVALID_BODY))


def _first(*conds: tuple[Column, str]) -> Column:
    out = None
    for c, r in conds:
        out = F.when(c, F.lit(r)) if out is None else out.when(c, F.lit(r))
    return out


def _with(df: DataFrame, **cols: Column) -> DataFrame:
    """One projection stage; later stages reference these as plain columns."""
    return df.select("*", *[c.alias(n) for n, c in cols.items()])


def inventory_fields(p: DataFrame) -> DataFrame:
    df, f = js.expand(p, "v", ["sku", "title", "category", "quantity", "cost_usd"])
    df = _with(df, sku=js.js_text(f["sku"], "", trim=True),
               title=js.js_text(f["title"], "", trim=True),
               category=js.js_text(f["category"], "", trim=True),
               _n_quantity=js.num(f["quantity"], 1), _n_cost=js.num(f["cost_usd"], 0))
    df = _with(df, quantity=js.floor_clamp(F.col("_n_quantity"), 0),
               cost_cents=js.round_half_up_cents(F.col("_n_cost")))
    return df.select("source", "seq", "entity", "arrived_at", "v", "sku", "title", "category", "quantity",
                     "cost_cents")


CONTENT = ("arrived_at", "sku", "title", "category", "quantity", "cost_cents")


def inventory_lines(payloads: DataFrame) -> DataFrame:
    """D1 without J6: the distinct lines of each input partition, how many there are of each (``_n``), and the reason
    of those that are refused whatever is stored."""
    p = inventory_fields(parsed(payloads, "inventory"))
    reason = F.coalesce(_body_reason(F.col("v")), _first(
        ((F.col("sku") == "") | (F.col("title") == "") | (F.col("category") == ""), REQUIRED["inventory"]),
        (F.col("quantity").isNull() | F.col("cost_cents").isNull(), OUT_OF_RANGE)))
    checked = fence(p.withColumn("reason", reason).withColumn("_part", F.spark_partition_id()).drop("v"))
    return checked.groupBy(*checked.columns).agg(F.count(F.lit(1)).alias("_n"))


def first_claims(lines: DataFrame) -> DataFrame:
    """The batch's claim to each SKU: (sku, seq, source, _line) of the first request, and the line that counts for it."""
    line = F.struct(*CONTENT, "_part")
    requests = lines.where(F.col("reason").isNull()).groupBy("seq", "source").agg(F.min(line).alias("_line"))
    first = requests.groupBy(F.col("_line.sku").alias("sku")).agg(F.min(F.struct(*ORDER, "_line")).alias("_first"))
    return first.select("sku", "_first.*")


def decided(lines: DataFrame, granted: DataFrame) -> Ingested:
    """Every line accepted or refused; ``granted``: the claims whose SKU was not taken."""
    won = granted.select(F.col("seq").alias("_wseq"), F.col("source").alias("_wsource"), F.col("_line").alias("_won"))
    same = ((F.col("seq") == F.col("_wseq")) & F.col("source").eqNullSafe(F.col("_wsource"))
            & F.struct(*CONTENT, "_part").eqNullSafe(F.col("_won")))
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy")
    each = lines.join(won, same, "left").select("*", one)
    lost = F.when(F.col("_won").isNull() | (F.col("_copy") > 1), F.lit(INSERT_FAILED))
    return Ingested(each.select(
        _id(), "sku", "title", "category", F.lit("staged").alias("status"), "cost_cents", "quantity",
        created_at(F.col("arrived_at")).alias("created_at"), "seq", F.col("entity").alias("_entity"),
        F.col("source").alias("_source"), F.coalesce("reason", lost).alias("reason")))


def ingest_inventory(payloads: DataFrame, existing: DataFrame) -> Ingested:
    """Validate, coerce, then enforce the unique SKU."""
    lines = inventory_lines(payloads)
    return decided(lines, first_claims(lines).join(existing.select("sku"), "sku", "left_anti"))


SALE_MONEY = ("sold_price", "buyer_shipping", "platform_fees", "promo_fee",
              "shipping_label_cost", "other_costs")


def ingest_sales(payloads: DataFrame) -> Ingested:
    """No inventory lookup, no stock change, no duplicate check."""
    p = parsed(payloads, "sale")
    names = ["date", "inventory_id", "sku", "qty", "order_ref", "note"] + [f"{m}_usd" for m in SALE_MONEY]
    df, f = js.expand(p, "v", names)
    df = _with(df, date=js.js_text(f["date"], "", trim=True),
               inventory_id=js.js_or_null(f["inventory_id"]),
               sku=js.js_text(f["sku"], "", trim=True),
               _n_qty=js.num(f["qty"], 1),
               order_ref=js.js_text(f["order_ref"], "", trim=True),
               note=js.js_text(f["note"], "", trim=False),
               **{f"_n_{m}": js.num(f[f"{m}_usd"], 0) for m in SALE_MONEY})
    df = _with(df, qty=js.floor_clamp(F.col("_n_qty"), 1),
               **{f"{m}_cents": js.round_half_up_cents(F.col(f"_n_{m}")) for m in SALE_MONEY})
    money_null = F.lit(False)
    for m in SALE_MONEY:
        money_null = money_null | F.col(f"{m}_cents").isNull()
    reason = F.coalesce(_body_reason(F.col("v")), _first(
        ((F.col("date") == "") | (F.col("sku") == "") | (F.col("order_ref") == ""), REQUIRED["sale"]),
        (money_null | F.col("qty").isNull(), OUT_OF_RANGE)))
    cols = [_id(), "date", "inventory_id", "sku", "qty",
            *[f"{m}_cents" for m in SALE_MONEY], "order_ref", "note",
            created_at(F.col("arrived_at")).alias("created_at"), "seq"]
    return _split(df, reason, cols)


def ingest_expenses(payloads: DataFrame) -> Ingested:
    """D3: X2, X3, X5, X6, X7 and the date/category check."""
    p = parsed(payloads, "expense")
    names = ["date", "category", "amount_usd", "vendor", "note", "sku", "type", "miles",
             "rate_usd_per_mile", "deductible"]
    df, f = js.expand(p, "v", names)
    df = _with(df, date=js.js_text(f["date"], "", trim=True),
               category=js.js_text(f["category"], "", trim=True),
               _n_amount=js.num(f["amount_usd"], 0),
               vendor=js.js_text(f["vendor"], ""), note=js.js_text(f["note"], ""),
               sku=js.js_or_null(f["sku"]), type=js.js_text(f["type"], "standard"),
               _n_miles=js.num(f["miles"], 0), _n_rate=js.num(f["rate_usd_per_mile"], 0),
               deductible=js.deductible_flag(f["deductible"]))
    df = _with(df, amount_cents=js.round_half_up_cents(F.col("_n_amount")),
               miles=js.floor_clamp(F.col("_n_miles"), 0),
               rate_cents_per_mile=js.round_half_up_cents(F.col("_n_rate")))
    df = _with(df, calc_amount_cents=js.mileage_amount(F.col("type"), F.col("miles"),
                                                        F.col("rate_cents_per_mile")))
    reason = F.coalesce(_body_reason(F.col("v")), _first(
        ((F.col("date") == "") | (F.col("category") == ""), REQUIRED["expense"]),
        (F.col("amount_cents").isNull() | F.col("miles").isNull()
         | F.col("rate_cents_per_mile").isNull()
         | ((F.col("type") == "mileage") & F.col("calc_amount_cents").isNull()), OUT_OF_RANGE)))
    cols = [_id(), "date", "category", "amount_cents",
            "vendor", "note", "sku", "type", "miles", "rate_cents_per_mile", "calc_amount_cents",
            "deductible", created_at(F.col("arrived_at")).alias("created_at"), "seq"]
    return _split(df, reason, cols)


def ingest_lots(payloads: DataFrame) -> Ingested:
    """Title required, then status in open/closed (missing -> open)."""
    p = parsed(payloads, "lot")
    df, f = js.expand(p, "v", ["title", "note", "status"])
    df = _with(df, title=js.js_text(f["title"], "", trim=True), note=js.js_text(f["note"], ""),
               status=js.js_text(f["status"], "open"))
    reason = F.coalesce(_body_reason(F.col("v")), _first(
        (F.col("title") == "", REQUIRED["lot"]),
        (~F.col("status").isin(*LOT_STATUSES), BAD_STATUS)))
    cols = [_id(), "title", "note", "status",
            created_at(F.col("arrived_at")).alias("created_at"), "seq"]
    return _split(df, reason, cols)


def route(payloads: DataFrame) -> DataFrame:
    """The requests written once to the shared folder, by entity, so that each ``ingest_*``
    reads its own part of a mixed folder and the folder's JSON is read once."""
    spark, path = payloads.sparkSession, scratch_path(payloads.sparkSession, "routed")
    known = F.when(_is_envelope(payloads) & F.col("entity").isin(*ENTITIES), F.col("entity")).otherwise(F.lit("misfit"))
    schema = payloads.schema
    payloads.withColumn("_route", known).write.partitionBy("_route").parquet(path)
    return spark.read.schema(StructType([*schema.fields, StructField("_route", StringType())])).parquet(path)


def all_rejects(payloads: DataFrame, existing_inventory: DataFrame) -> DataFrame:
    """P6 quarantine over every insert entity and every line that belongs to none; one read of the requests."""
    routed = route(payloads)
    part = lambda r: routed.where(F.col("_route") == r).drop("_route")
    return (misfits(part("misfit"))
            .unionByName(ingest_inventory(part("inventory"), existing_inventory).rejected)
            .unionByName(ingest_sales(part("sale")).rejected)
            .unionByName(ingest_expenses(part("expense")).rejected)
            .unionByName(ingest_lots(part("lot")).rejected))


def parse_errors(payloads: DataFrame) -> DataFrame:
    """S7 report: per entity, how many bodies did not parse or were not objects."""
    v = F.col("v")
    t = F.schema_of_variant(v)
    known = payloads.where(_is_envelope(payloads) & F.col("entity").isin(*INSERTS))
    return (js.with_body(known.select("entity", "body"))
            .select("entity", v.isNull().alias("bad"),
                    (v.isNotNull() & ~F.coalesce(t.startswith("OBJECT"), F.lit(False))).alias("nonobj"))
            .groupBy("entity")
            .agg(F.count(F.lit(1)).alias("n_payloads"),
                 F.sum(F.col("bad").cast("bigint")).alias("n_unparsable"),
                 F.sum(F.col("nonobj").cast("bigint")).alias("n_not_object")))


def number_fields(payloads: DataFrame, entity: str, name: str) -> DataFrame:
    """X1 + X3 on one body field: the sale rule and the item rule side by side."""
    df, f = js.expand(parsed(payloads, entity), "v", [name])
    df = _with(df, _n=js.num(f[name], 1))
    return df.select("seq", js.floor_clamp(F.col("_n"), 1).alias("sale_qty"),
                     js.floor_clamp(F.col("_n"), 0).alias("item_quantity"))


def cost_fields(payloads: DataFrame) -> DataFrame:
    """X11 + X12 (the older API's cost and quantity rules) on inventory bodies."""
    df, f = js.expand(parsed(payloads, "inventory"), "v", ["cost_cents", "cost_usd", "quantity"])
    df = _with(df, cost_cents=js.cost_precedence(f["cost_cents"], f["cost_usd"]),
               _q=js.quantity_or_one(f["quantity"]))
    return df.select("seq", "cost_cents", F.floor(F.col("_q")).cast("bigint").alias("quantity"))
