"""Ordered change batches applied as snapshot jobs.

Input: an envelope DataFrame (``seq`` orders requests).  Output equals
applying the requests one at a time, computed set-wise:

* per field, the value of the last *applied* request that sets it
  (``max_by(value, when(sets_field, seq))``; NULL order keys are skipped),
  grouped by target id -- a partial aggregate, so a hot id is combined
  map-side before the shuffle;
* joins against the base table happen after aggregation, one row per key on
  both sides, so no key can skew them;
* per-request outcomes are counted per (key, provisional outcome) before the
  existence join.

A new snapshot is returned; writing it to a new path (S11) is the caller's
choice -- Parquet has no in-place MERGE, and a path being read is never
overwritten.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import js
from ..schemas import INVENTORY_STATUSES, LOT_STATUSES
from ..session import checkpointed
from .ingest import fence, parsed

# The reference's outcomes.
OK, NOT_FOUND, NO_FIELDS, UPDATE_FAILED = "ok", "not_found", "no_fields", "update_failed"
SKU_REQUIRED, INVENTORY_NOT_FOUND = "sku required", "inventory_not_found"


class Applied:
    """A change job's result: ``table`` is the new snapshot, ``outcomes`` the
    per-request outcome counts (entity, outcome, n).  ``outcomes`` may be given
    as a function, so jobs that need work of their own for it (D6 checkpoints
    its bucketed ops) do that work only when the outcomes are asked for."""

    def __init__(self, table: DataFrame, outcomes):
        self.table = table
        self._outcomes = outcomes

    @property
    def outcomes(self) -> DataFrame:
        if callable(self._outcomes):
            self._outcomes = self._outcomes()
        return self._outcomes


# ------------------------------------------------------------------ patches

@dataclass
class FieldRule:
    name: str
    sets: Column       # does this request set the field?
    value: Column      # the value it sets


def _patch(base: DataFrame, requests: DataFrame, entity: str, rules: list[FieldRule],
           check: Column | None, key: str = "id", dead: Column | None = None) -> Applied:
    """Generic J7 update join with per-field last-write-wins.

    ``check`` is a per-request constraint (P8); a request violating it, or setting
    a field to a number that no column holds (its value is NULL), changes nothing at
    all, like a failed UPDATE statement, and what earlier requests set stands.
    ``dead``: the target no longer exists when the request arrives.
    """
    dead = dead if dead is not None else F.lit(False)
    cols = [F.col("target_id"), F.struct("seq", "source").alias("_at"), dead.alias("_dead"),
            (check if check is not None else F.lit(True)).alias("_holds")]
    for r in rules:
        cols += [r.sets.alias(f"_s_{r.name}"), r.value.alias(f"_v_{r.name}")]
    req = requests.select(*cols)
    # From here on the readings are plain columns, so their rules are not generated twice.
    sets_any, holds = F.lit(False), F.col("_holds")
    for r in rules:
        sets_any = sets_any | F.col(f"_s_{r.name}")
        holds = holds & ~(F.col(f"_s_{r.name}") & F.col(f"_v_{r.name}").isNull())
    req = fence(req.select("*", sets_any.alias("_usable"), (sets_any & holds).alias("_ok")).drop("_holds"))

    agg = (req.where(F.col("_ok") & ~F.col("_dead")).groupBy("target_id")
           .agg(*[F.max_by(F.col(f"_v_{r.name}"), F.when(F.col(f"_s_{r.name}"), F.col("_at")))
                  .alias(f"_new_{r.name}") for r in rules]))
    joined = base.join(agg, base[key] == agg["target_id"], "left")
    out_cols = []
    for c in base.columns:
        if any(r.name == c for r in rules):
            out_cols.append(F.coalesce(F.col(f"_new_{c}"), base[c]).alias(c))
        else:
            out_cols.append(base[c])
    table = joined.select(*out_cols)

    pre = (F.when(~F.col("_usable"), F.lit(NO_FIELDS)).when(F.col("_dead"), F.lit(NOT_FOUND))
           .when(~F.col("_ok"), F.lit(UPDATE_FAILED)).otherwise(F.lit(OK)))
    counts = req.groupBy("target_id", pre.alias("pre")).agg(F.count(F.lit(1)).alias("n"))
    keys = base.select(F.col(key).alias("target_id"), F.lit(True).alias("_exists"))
    outcome = (F.when(F.col("pre") == NO_FIELDS, F.lit(NO_FIELDS))
               .when(F.col("_exists").isNull(), F.lit(NOT_FOUND)).otherwise(F.col("pre")))
    outcomes = (counts.join(keys, "target_id", "left")
                .groupBy(outcome.alias("outcome")).agg(F.sum("n").alias("n"))
                .select(F.lit(entity).alias("entity"), "outcome", "n"))
    return Applied(table, outcomes)


def patch_inventory(inventory: DataFrame, payloads: DataFrame) -> Applied:
    """Status (non-empty string) and/or quantity (JSON number -> max(0, floor))."""
    p, f = js.expand(parsed(payloads, "inventory_patch"), "v", ["status", "quantity"])
    st, qt = f["status"], f["quantity"]
    has_status = js.is_string(st) & (js.as_string(st) != "")
    rules = [FieldRule("status", has_status, js.as_string(st)),
             FieldRule("quantity", js.is_number(qt), js.floor_clamp(js.as_double(qt), 0))]
    check = ~has_status | js.as_string(st).isin(*INVENTORY_STATUSES)
    return _patch(inventory, p, "inventory_patch", rules, check)


def patch_lots(lots: DataFrame, payloads: DataFrame) -> Applied:
    """Title (non-empty string), note (any string), status (valid, else ignored)."""
    p, f = js.expand(parsed(payloads, "lot_patch"), "v", ["title", "note", "status"])
    t, n, s = f["title"], f["note"], f["status"]
    rules = [FieldRule("title", js.is_string(t) & (js.as_string(t) != ""), js.as_string(t)),
             FieldRule("note", js.is_string(n), js.as_string(n)),
             FieldRule("status", js.is_string(s) & js.as_string(s).isin(*LOT_STATUSES), js.as_string(s))]
    return _patch(lots, p, "lot_patch", rules, None)


EDIT_TEXT = ("title", "category")


def edit_delete_items(inventory: DataFrame, payloads: DataFrame) -> Applied:
    """Full-row edits and deletes of items (client-only in the reference).

    Edits follow D7 with more fields: title/category (non-empty strings),
    status (non-empty string, CHECKed), cost_cents/quantity (numbers ->
    max(0, floor)), listed_date (any string).  A delete removes the row; any
    later request for that id is ``not_found``.
    """
    edits, f = js.expand(parsed(payloads, "item_edit"), "v",
                         list(EDIT_TEXT) + ["status", "cost_cents", "quantity", "listed_date"])
    deletes = parsed(payloads, "item_delete").select("target_id", "seq", "source")
    first_delete = deletes.groupBy("target_id").agg(F.min(F.struct("seq", "source")).alias("_del"))
    st = f["status"]
    has_status = js.is_string(st) & (js.as_string(st) != "")
    rules = [FieldRule(c, js.is_string(f[c]) & (js.as_string(f[c]) != ""), js.as_string(f[c]))
             for c in EDIT_TEXT]
    rules += [FieldRule("status", has_status, js.as_string(st))]
    rules += [FieldRule(c, js.is_number(f[c]), js.floor_clamp(js.as_double(f[c]), 0))
              for c in ("cost_cents", "quantity")]
    rules += [FieldRule("listed_date", js.is_string(f["listed_date"]), js.as_string(f["listed_date"]))]
    check = ~has_status | js.as_string(st).isin(*INVENTORY_STATUSES)
    # Edits that arrive after the row was deleted find nothing; one join flags them for table and outcomes.
    edits = edits.join(first_delete, "target_id", "left")
    dead = F.coalesce(F.struct("seq", "source") > F.col("_del"), F.lit(False))
    edited = _patch(inventory, edits, "item_edit", rules, check, dead=dead)
    table = edited.table.join(first_delete, edited.table["id"] == first_delete["target_id"], "left_anti")
    # Deletes: the first one on an existing id succeeds; the rest find nothing.
    keys = inventory.select(F.col("id").alias("target_id"), F.lit(True).alias("_exists"))
    del_counts = (deletes.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))
                  .join(keys, "target_id", "left")
                  .select(F.when(F.col("_exists"), 1).otherwise(0).alias("ok_n"), "n"))
    del_out = (del_counts.select(F.explode(F.array(
        F.struct(F.lit(OK).alias("outcome"), F.col("ok_n").cast("bigint").alias("n")),
        F.struct(F.lit(NOT_FOUND).alias("outcome"), (F.col("n") - F.col("ok_n")).cast("bigint").alias("n"))
    )).alias("o")).groupBy(F.col("o.outcome").alias("outcome")).agg(F.sum("o.n").alias("n"))
        .where(F.col("n") > 0).select(F.lit("item_delete").alias("entity"), "outcome", "n"))
    outcomes = edited.outcomes.unionByName(del_out)
    return Applied(table, outcomes)


# -------------------------------------------------------------------- links

def resolve_links(payloads: DataFrame, inventory: DataFrame, entity: str = "link") -> DataFrame:
    """SKU (trimmed, exact) -> item id.  Columns: seq, lot_id, sku, inventory_id, reason.

    The request side may be skewed on one SKU; the inventory side is unique per
    SKU, so AQE either broadcasts it (size checked at runtime) or splits the
    skewed request partitions of the outer join.  Requests without a SKU (every
    malformed body) match nothing; their join keys are made distinct, so they
    spread over the partitions.
    """
    p, f = js.expand(parsed(payloads, entity), "v", ["sku"])
    req = fence(p.select("seq", "source", F.col("target_id").alias("lot_id"),
                         js.js_text(f["sku"], "", trim=True).alias("sku")))
    inv = inventory.where(F.col("sku") != "").select(F.col("sku").alias("_isku"), F.col("id").alias("inventory_id"))
    none = F.concat(F.lit("\u0000"), F.col("seq").cast("string"))
    j = req.join(inv, F.when(F.col("sku") == "", none).otherwise(F.col("sku")) == inv["_isku"], "left").drop("_isku")
    reason = (F.when(F.col("sku") == "", F.lit(SKU_REQUIRED))
              .when(F.col("inventory_id").isNull(), F.lit(INVENTORY_NOT_FOUND)))
    return j.withColumn("reason", reason)


def link_items(bridge: DataFrame, payloads: DataFrame, inventory: DataFrame) -> Applied:
    """D5 = J4 + J5: insert-or-ignore on (inventory_id, lot_id); lots are not checked."""
    r = resolve_links(payloads, inventory)
    new = (r.where(F.col("reason").isNull()).select("inventory_id", "lot_id").dropDuplicates()
           .join(bridge, ["inventory_id", "lot_id"], "left_anti"))
    table = bridge.select("inventory_id", "lot_id").unionByName(new)
    outcomes = (r.groupBy(F.coalesce(F.col("reason"), F.lit(OK)).alias("outcome"))
                .agg(F.count(F.lit(1)).alias("n")).select(F.lit("link").alias("entity"), "outcome", "n"))
    return Applied(table, outcomes)


def unresolved_links(payloads: DataFrame, inventory: DataFrame) -> DataFrame:
    """J4 rejects: requests whose SKU is empty or matches no item."""
    return resolve_links(payloads, inventory).where(F.col("reason").isNotNull()) \
        .select("seq", "lot_id", "sku", "reason")


def _bucketed(ops: DataFrame, keys: list[str], n_buckets: int | None) -> DataFrame:
    """Order-preserving buckets per key: ``_bucket`` = range partition of (keys, seq).

    ``repartitionByRange`` samples (keys, seq) tuples for its bounds, so a key
    holding a third of all ops spans about a third of the partitions, and
    within a key a higher bucket always holds later ops.  No bucket holds more
    than one partition's rows, and the partition count (default: the session's
    shuffle partitions, sized to the data by whoever runs the cluster) grows
    with the input, so no (key, bucket) group outgrows one task.

    The result is checkpointed to the shared folder: the bucket numbers come
    from sampled bounds and are read by two branches (the in-bucket ``lag`` and
    the per-bucket carry), which must agree; it also cuts the lineage of the
    parse and resolution joins before the windows.
    """
    spark = ops.sparkSession
    if not n_buckets:
        conf = spark.conf.get("spark.sql.shuffle.partitions", "200") or "200"
        n_buckets = int(conf) if conf.strip().isdigit() else 200  # e.g. "auto": Spark's default
    n = n_buckets
    return checkpointed(ops.repartitionByRange(n, *keys, "seq", "source")
                        .withColumn("_bucket", F.spark_partition_id()))


def state_before(ops: DataFrame, keys: list[str], base_keys: DataFrame,
                 n_buckets: int | None = None) -> DataFrame:
    """For each op row (keys, seq, source, op in link/unlink): was the key present just before it?

    A plain ``lag`` over ``partition by keys`` would put every op of a hot key
    into one task.  Instead ops are cut into order-preserving buckets
    (``_bucketed``): ``lag`` runs within (keys, bucket); the last op of each
    earlier bucket comes from a grouped ``max_by`` (one row per key and
    bucket), carried forward by a window over those grouped rows only, and
    base membership from a join on them.
    """
    b = _bucketed(ops, keys, n_buckets)
    w = Window.partitionBy(*keys, "_bucket").orderBy("seq", "source")
    b = b.withColumn("_prev", F.lag("op").over(w))
    g = b.groupBy(*keys, "_bucket").agg(F.max_by("op", F.struct("seq", "source")).alias("_last"))
    wk = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    g = (g.withColumn("_carry", F.last("_last", ignorenulls=True).over(wk))
         .join(base_keys.select(*keys).withColumn("_base", F.lit(True)), keys, "left")
         .drop("_last"))
    prev = F.coalesce(F.col("_prev"), F.col("_carry"))
    present = (F.when(prev == "link", F.lit(True)).when(prev == "unlink", F.lit(False))
               .otherwise(F.coalesce(F.col("_base"), F.lit(False))))
    return (b.join(g, keys + ["_bucket"], "left")
            .withColumn("present_before", present)
            .drop("_prev", "_carry", "_base", "_bucket"))


LINK_KEYS = ["lot_id", "inventory_id"]


def _link_ops(payloads: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the link requests resolved, every link and unlink as seq, source, lot_id, inventory_id, op)."""
    links = resolve_links(payloads, inventory, "link")
    unl, f = js.expand(parsed(payloads, "unlink"), "v", ["inventory_id"])
    # Fenced: the joins infer that the key is not NULL, and that filter would repeat the parse.
    unl = fence(unl.select("seq", "source", F.col("target_id").alias("lot_id"),
                           js.js_text(f["inventory_id"], "", trim=False).alias("inventory_id")))
    return links, (links.where(F.col("reason").isNull()).select("seq", "source", *LINK_KEYS, F.lit("link").alias("op"))
                   .unionByName(unl.select("seq", "source", *LINK_KEYS, F.lit("unlink").alias("op"))))


def _last(ops: DataFrame) -> DataFrame:
    return ops.groupBy(*LINK_KEYS).agg(F.max_by("op", F.struct("seq", "source")).alias("last_op"))


def last_links(payloads: DataFrame, inventory: DataFrame) -> DataFrame:
    """The batch's last operation on each (lot, item), as ``sources.ledger.log_links`` stores it."""
    return _last(_link_ops(payloads, inventory)[1])


def apply_link_unlink(bridge: DataFrame, payloads: DataFrame, inventory: DataFrame,
                      n_buckets: int | None = None) -> Applied:
    """A mixed link/unlink batch; the last operation per (lot, item) decides."""
    keys = LINK_KEYS
    links, ops = _link_ops(payloads, inventory)
    last = _last(ops)
    table = (bridge.select(*keys).join(last, keys, "left_anti")
             .unionByName(last.where(F.col("last_op") == "link").select(*keys))
             .select("inventory_id", "lot_id"))

    def outcomes() -> DataFrame:
        before = state_before(ops, keys, bridge, n_buckets)
        unlink_out = (before.where(F.col("op") == "unlink")
                      .groupBy(F.when(F.col("present_before"), F.lit(OK)).otherwise(F.lit(NOT_FOUND))
                               .alias("outcome"))
                      .agg(F.count(F.lit(1)).alias("n"))
                      .select(F.lit("unlink").alias("entity"), "outcome", "n"))
        link_out = (links.groupBy(F.coalesce(F.col("reason"), F.lit(OK)).alias("outcome"))
                    .agg(F.count(F.lit(1)).alias("n")).select(F.lit("link").alias("entity"), "outcome", "n"))
        return link_out.unionByName(unlink_out)

    return Applied(table, outcomes)
