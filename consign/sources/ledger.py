"""Ledger tables: scans of the stored layout (S1-S6), sinks (S8, S11), and the
deterministic derivation of the six tables from the shared test tables.

Stored layout (the production path): ``<root>/<snapshot>/<table>/batch=<name>``, Parquet,
where ``commits`` says which snapshot and batches count.  Sales and Expenses are
partitioned by ``month = left(date, 7)`` and sorted by date inside files, so a date range
prunes directories and row groups.  The other tables are range-partitioned and sorted by
the key they are looked up by (``CLUSTER``), so a lookup skips row groups.  Every batch of Sales and
Expenses has its sums by month beside it (``<table>_months``), committed with it.  Columns in
``BLOOM`` have a Bloom filter in every row group, so a lookup by one that the files are
not sorted by skips row groups as well.  ``month`` is declared a string so partition values
are never inferred as dates.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas
from ..functions.js import round_half_up_cents
from ..operators.ingest import fence
from ..operators.report import by_month, expense_measures, sales_measures
from ..session import drop_scratch, dropped_shuffles, fits_broadcast, scaled_shuffles, scratch_path
from .commits import APPEND, REMOVE, REPLACE, SNAPSHOT, Conflict, State, commit, state

TABLES = ("inventory", "sales", "expenses", "lots", "inventory_lots", "photos")
LINK_LOG = "inventory_lots_log"  # links and unlinks since the bridge was last compacted
SCHEMAS = {
    "inventory": schemas.INVENTORY, "sales": schemas.SALES, "expenses": schemas.EXPENSES,
    "lots": schemas.LOTS, "inventory_lots": schemas.INVENTORY_LOTS, "photos": schemas.PHOTOS,
    LINK_LOG: schemas.LINK_LOG, "sales_months": schemas.SALES_MONTHS, "expenses_months": schemas.EXPENSES_MONTHS,
}
PARTITIONED = {"sales": sales_measures, "expenses": expense_measures}  # by month, with roll-ups of these measures
CLUSTER = {"inventory": ["id"], "lots": ["id"], "inventory_lots": ["lot_id", "inventory_id"],
           "photos": ["inventory_id", "id"], "sales": ["month", "date", "id"], "expenses": ["month", "date", "id"],
           LINK_LOG: ["lot_id", "inventory_id"], "sales_months": ["month"], "expenses_months": ["month"]}
BLOOM = {"inventory": ["id", "sku"], "photos": ["id"], "inventory_lots": ["inventory_id"], "lots": ["id"]}
COMPRESSION = "zstd"  # ids are hashes in hexadecimal, which it halves and snappy does not
BASE = "base"


@dataclass
class Ledger:
    inventory: DataFrame
    sales: DataFrame
    expenses: DataFrame
    lots: DataFrame
    inventory_lots: DataFrame
    photos: DataFrame

    def register(self, prefix: str = "") -> "Ledger":
        """Expose every table, and both profit views, as temp views for ad-hoc SQL."""
        from ..operators.profit import sales_profit, sales_profit_titled
        for t in TABLES:
            getattr(self, t).createOrReplaceTempView(prefix + t)
        sales_profit(self.sales, self.inventory).createOrReplaceTempView(prefix + "SalesReport")
        sales_profit_titled(self.sales, self.inventory).createOrReplaceTempView(prefix + "sales_profit_v")
        return self


# ---------------------------------------------------------------- stored layout

def month_of(date: Column) -> Column:
    return F.substring(date, 1, 7)


def _laid_out(df: DataFrame, name: str, once: bool = False) -> DataFrame:
    """A table's columns in its stored layout; ``once``: of rows of a partitioned table with one date and id, the least.

    Range partitioning on (date, id), which is the order of (month, date, id), splits a big month over many tasks
    (hash partitioning on month would give each month one task), and each task writes few
    months; the bounds come from a bounded sample.  Equal dates and ids meet in one task, so they are
    found without another shuffle, and in the order that the files have anyway.
    """
    fields = [f.name for f in SCHEMAS[name].fields]
    df = df.select(*fields)
    if name not in PARTITIONED:
        return df.repartitionByRange(*CLUSTER[name]).sortWithinPartitions(*CLUSTER[name])
    df = df.repartitionByRange("date", "id").withColumn("month", month_of(F.col("date")))
    if once:
        rest = [c for c in fields if c not in CLUSTER[name]]
        df = (df.groupBy(*CLUSTER[name]).agg(F.min(F.struct(*rest)).alias("_r"))
              .select(*[f"_r.{c}" if c in rest else c for c in fields], "month"))
    return df.sortWithinPartitions(*CLUSTER[name])


def _folder(root: str, snapshot: str, name: str, batch: str) -> str:
    return f"{root}/{snapshot}/{name}/batch={batch}"


def _write(df: DataFrame, path: str, name: str, once: bool = False) -> None:
    w = _laid_out(df, name, once).write.mode("errorifexists").option("compression", COMPRESSION)
    for c in BLOOM.get(name, []):
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{c}", "true")
    (w.partitionBy("month") if name in PARTITIONED else w).parquet(path)


def _write_batch(spark: SparkSession, df: DataFrame, root: str, snapshot: str, name: str, batch: str,
                 once: bool = False) -> list[str]:
    """Write a batch, and its roll-up from what was written; the tables that now have the batch."""
    path = _folder(root, snapshot, name, batch)
    scaled_shuffles(spark)
    _write(df, path, name, once)
    if name not in PARTITIONED:
        return [name]
    months = f"{name}_months"
    written = spark.read.schema(StructType([*SCHEMAS[name].fields, StructField("month", StringType())])).parquet(path)
    _write(by_month(written, PARTITIONED[name]()), _folder(root, snapshot, months, batch), months)
    return [name, months]


def write_snapshot(ledger: Ledger, root: str, seen: State | None = None) -> State:
    """Write every table as a new snapshot and switch to it in one commit; returns the new state.

    A job that fails halfway leaves every reader where it was, and a snapshot that is being read is
    never overwritten.  The tables are written side by side, so that one table's last tasks do not hold
    up the next table.  A ledger that was made from the stored one passes the state it read
    (``seen``); ``Conflict`` is raised if something was committed since.
    """
    spark = ledger.sales.sparkSession
    seen, name = seen or state(spark, root), f"snapshot-{uuid.uuid4().hex}"
    with dropped_shuffles(spark), ThreadPoolExecutor(len(TABLES)) as pool:
        parts = pool.map(lambda t: _write_batch(spark, getattr(ledger, t), root, name, t, BASE), TABLES)
        written = [w for part in parts for w in part]
    commit(spark, root, seen, [(SNAPSHOT, name, t, BASE) for t in written])
    return State(seen.n + 1, name, {t: [BASE] for t in written})


def _stored_type(name: str) -> StructType:
    # A new StructType: ``StructType.add`` would change the shared schema in place.
    extra = ["batch", "month"] if name in PARTITIONED else ["batch"]
    return StructType([*SCHEMAS[name].fields, *[StructField(c, StringType()) for c in extra]])


def _scan(spark: SparkSession, root: str, name: str, at: State) -> DataFrame:
    """The table's rows with their batch and month; files that were taken out are pruned when the scan is planned."""
    batches, removed = at.batches.get(name, []), at.removed.get(name, [])
    if not batches:
        return spark.createDataFrame([], _stored_type(name))
    df = (spark.read.schema(_stored_type(name)).option("basePath", f"{root}/{at.snapshot}/{name}")
          .parquet(*[_folder(root, at.snapshot, name, b) for b in batches]))
    return df.where(~F.col("_metadata.file_path").isin(removed)) if removed else df


def read_table(spark: SparkSession, root: str, name: str, at: State | None = None) -> DataFrame:
    """Typed scan, never schema inference; every committed batch of the current snapshot."""
    return _scan(spark, root, name, at or state(spark, root)).drop("batch")


def read_months(spark: SparkSession, root: str, name: str, at: State | None = None) -> DataFrame:
    """The roll-up of Sales or Expenses: a row for each batch and month."""
    return read_table(spark, root, f"{name}_months", at)


def read_snapshot(spark: SparkSession, root: str, at: State | None = None) -> Ledger:
    """The ledger as of one commit, the last if none is given: all tables at the same state."""
    at = at or state(spark, root)
    return Ledger(**{t: read_bridge(spark, root, at) if t == "inventory_lots" else read_table(spark, root, t, at)
                     for t in TABLES})


KEYS = {"inventory_lots": ["inventory_id", "lot_id"]}  # every other table: ["id"]


def _add(spark: SparkSession, root: str, name: str, rows: Callable[[State], DataFrame | None],
         more: Callable[[State], list[tuple]] = lambda _: [], action: str = APPEND, once: bool = False) -> None:
    """Write ``rows`` of the state as a batch and commit it, with ``more`` rows; nothing where it gives None.
    ``once``: see ``_laid_out``.

    What the rows were made from has to stand when they are committed: if another writer has changed the table
    meanwhile, they are made again; if it changed others only, the commit alone is tried again.
    """
    seen = state(spark, root)
    while True:
        snapshot = seen.snapshot or f"snapshot-{uuid.uuid4().hex}"
        # Batches sort by name in the order of their commits.
        batch = f"{seen.n + 1:012d}-{uuid.uuid4().hex}"
        df = rows(seen)
        if df is None:
            return
        with dropped_shuffles(spark):
            written = _write_batch(spark, df, root, snapshot, name, batch, once)
        entry = [*[(action, snapshot, t, batch) for t in written], *[(a, snapshot, t, i) for a, t, i in more(seen)]]
        if not seen.snapshot:
            entry.append((SNAPSHOT, snapshot, None, None))
        while True:
            try:
                return commit(spark, root, seen, entry)
            except Conflict:
                before, seen = seen, state(spark, root)
                if seen.of(name) != before.of(name):
                    break


def append_rows(df: DataFrame, root: str, name: str) -> None:
    """Append accepted rows to a stored table, as given; see ``append_new_rows``."""
    _add(df.sparkSession, root, name, lambda _: df)


def append_new_rows(df: DataFrame, root: str, name: str) -> None:
    """S8, safe to re-run: append rows whose key is not stored yet, one row a key.

    Ingested ids are ``sha2(source | entity | seq)``, so a job run again after it
    already committed (driver restart, orchestrator retry) finds its rows stored and
    appends nothing.  Of rows of one key in ``df`` the least counts.  The key lookup reads
    only the key columns.  For Sales and Expenses it reads only the months the new rows
    span: the month bounds are a scalar subquery in the scan's partition filter, evaluated
    at run time (Spark's dynamic partition pruning does not apply to anti joins).  There only ids and dates are
    shuffled by key, which shows the keys that not all rows count of (``_odd_keys``).  Whole rows meet these,
    broadcast where they are few, and are shuffled once, into the layout, where rows of one date and id become one.
    """
    spark = df.sparkSession
    keys = KEYS.get(name, ["id"])
    fields = [f.name for f in SCHEMAS[name].fields]
    if name in PARTITIONED:
        made: list[str] = []
        _add(spark, root, name, lambda at: _new_rows(df.select(*fields), root, name, at, made), once=True)
        return drop_scratch(spark, *made)
    rest = [c for c in fields if c not in keys]
    new = df.select(*fields)
    new = (new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest
           else new.dropDuplicates()).select(*fields)

    def rows(at: State) -> DataFrame:
        if not at.batches.get(name):
            return new
        return new.join(read_table(spark, root, name, at).select(*keys), keys, "left_anti")

    _add(spark, root, name, rows)


def _new_rows(df: DataFrame, root: str, name: str, at: State, made: list[str]) -> DataFrame:
    """The rows of a batch of Sales or Expenses that count, repeats of one date and id included."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, f"{name}-odd")
    made.append(path)
    scaled_shuffles(spark)
    with dropped_shuffles(spark):
        _odd_keys(df, root, name, at).write.option("compression", COMPRESSION).parquet(path)
    odd = spark.read.schema("_id string, _stored boolean, _least string").parquet(path)
    met = df.join(F.broadcast(odd) if fits_broadcast(odd) else odd, F.col("id").eqNullSafe(F.col("_id")), "left")
    counts = F.col("_stored").isNull() | (~F.col("_stored") & F.col("date").eqNullSafe(F.col("_least")))
    return met.where(counts).select(*df.columns)


def _odd_keys(df: DataFrame, root: str, name: str, at: State) -> DataFrame:
    """The ids of a batch that are stored in the month of their least row, and those that come with several dates,
    of which the least (NULL before all) counts.

    The date is the first column after the key, so the least row has the least date.  The month is no
    join key but a condition (neither less nor greater), so that the stored keys meet the ids as their grouping left them.
    """
    spark = df.sparkSession
    dates = F.struct("date")
    each = (df.select("id", "date").repartition("id").groupBy("id")
            .agg(F.min(dates).getField("date").alias("_least"), F.max(dates).getField("date").alias("_most"))
            .withColumnRenamed("id", "_id"))
    several = ~F.col("_least").eqNullSafe(F.col("_most"))
    if not at.batches.get(name):
        return each.where(several).select("_id", F.lit(False).alias("_stored"), "_least")
    b = df.select(month_of(F.col("date")).alias("month")).agg(
        F.struct(F.min("month").alias("lo"), F.max("month").alias("hi"))).scalar()
    held = read_table(spark, root, name, at).where(F.col("month").between(b.getField("lo"), b.getField("hi"))).select(
        "id", F.col("month").alias("_month"))
    month = month_of(F.col("_least"))
    met = each.join(held, [F.col("_id") == F.col("id"), month <= F.col("_month"), month >= F.col("_month")], "left")
    return met.where(F.col("_month").isNotNull() | several).select("_id", F.col("_month").isNotNull().alias("_stored"), "_least")


def rewrite(spark: SparkSession, root: str, name: str, targets: DataFrame,
            change: Callable[[DataFrame], DataFrame], key: str = "id") -> int:
    """D7-D9 on a stored table, copy on write by file; returns how many files were rewritten.

    Only files that hold one of ``targets``' keys are read whole, changed and written
    anew; the commit takes the old files out and puts the new batch in.  The key scan reads
    the key column, and the files' names, as many as there are files, reach the driver.
    """
    if name in PARTITIONED:
        raise ValueError(f"rows of {name} are added, not changed: their roll-up holds their sums")
    touched: list[str] = []

    def rows(at: State) -> DataFrame | None:
        if not at.batches.get(name):
            return None
        wanted = targets.select(F.col(key)).where(F.col(key).isNotNull()).dropDuplicates()
        files = (_scan(spark, root, name, at).select(key, F.col("_metadata.file_path").alias("_file"))
                 .join(wanted, key, "left_semi").select("_file").distinct())
        touched[:] = sorted(r[0] for r in files.collect())
        if not touched:
            return None
        return change(_scan(spark, root, name, at).where(F.col("_metadata.file_path").isin(touched)).drop("batch"))

    _add(spark, root, name, rows, lambda _: [(REMOVE, name, f) for f in touched])
    return len(touched)


def compact(spark: SparkSession, root: str, name: str) -> None:
    """Write a stored table anew as one batch, laid out as a snapshot is; of the bridge, with its log merged in."""
    if name == "inventory_lots":
        _add(spark, root, name, lambda at: read_bridge(spark, root, at), lambda _: [(REPLACE, LINK_LOG, None)], REPLACE)
    else:
        _add(spark, root, name, lambda at: read_table(spark, root, name, at), action=REPLACE)


def log_links(ops: DataFrame, root: str) -> None:
    """D5/D6/J8 on the stored bridge, merge on read: one row for each (lot, item) of the batch with its last operation
    (columns lot_id, inventory_id, last_op) goes to the log; the bridge itself is not read."""
    _add(ops.sparkSession, root, LINK_LOG, lambda _: ops)


def read_bridge(spark: SparkSession, root: str, at: State | None = None) -> DataFrame:
    """The bridge with its log merged in; the last batch that names a (lot, item) decides.

    What decides is one number, the batch's place in their order and the operation, so that the log is grouped by
    hash, not sorted by its texts.  Both uses read the same grouping, so that the log is read once: the bridge is
    joined with all of it, and the fence keeps each use's filters above it.
    """
    at = at or state(spark, root)
    base = read_table(spark, root, "inventory_lots", at)
    if not at.batches.get(LINK_LOG):
        return base
    keys = ["inventory_id", "lot_id"]
    place = F.array_position(F.array(*map(F.lit, sorted(at.batches[LINK_LOG]))), F.col("batch"))
    last = fence(_scan(spark, root, LINK_LOG, at).groupBy(*keys)
                 .agg(F.max(place * 2 + F.when(F.col("last_op") == "link", 1).otherwise(0)).alias("_last")))
    kept = base.join(last, keys, "left").where(F.col("_last").isNull())
    return kept.select(*keys).unionByName(last.where(F.col("_last") % 2 == 1).select(*keys))


# ------------------------------------------------------ derivation from test data

def _cents(c: Column) -> Column:
    return round_half_up_cents(c)


def _day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def made(k: Column, hh: str) -> Column:
    """Deterministic creation time; ties on purpose."""
    return F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"),
                    F.lit(f" {hh}:00:00"))


def _pfx(p: str, c: Column) -> Column:
    return F.concat(F.lit(p), c.cast("string"))


def load_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inventory_from(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    status = (F.when(k % 4 == 0, "staged").when(k % 4 == 1, "draft")
              .when(k % 4 == 2, "active").otherwise("sold"))
    return part.select(
        _pfx("inv-", k).alias("id"), _pfx("SKU-", k).alias("sku"),
        F.col("p_name").alias("title"), F.col("p_type").alias("category"),
        status.alias("status"), _cents(F.col("p_retailprice")).alias("cost_cents"),
        F.col("p_size").cast("bigint").alias("quantity"),
        F.lit(None).cast("string").alias("listed_date"),
        F.lit(None).cast("string").alias("draft_created_at"),
        made(k, "08").alias("created_at"))


def sales_from(lineitem: DataFrame) -> DataFrame:
    ln, pk, sk, ok = (F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_orderkey"))
    sale_id = F.concat_ws("-", F.lit("sale"), ok.cast("string"), ln.cast("string"),
                          pk.cast("string"), sk.cast("string"))
    inv_id = (F.when(ln % 3 == 0, F.lit(None).cast("string"))
              .when(ln == 7, _pfx("inv-", sk)).otherwise(_pfx("inv-", pk)))
    sku = (F.when(ln == 5, _pfx("OLD-", pk)).when(ln == 6, _pfx("GONE-", pk))
           .otherwise(_pfx("SKU-", pk)))
    return lineitem.select(
        sale_id.alias("id"), _day(F.col("l_shipdate")).alias("date"), inv_id.alias("inventory_id"),
        sku.alias("sku"), F.col("l_quantity").cast("bigint").alias("qty"),
        _cents(F.col("l_extendedprice")).alias("sold_price_cents"),
        (ln * 100).cast("bigint").alias("buyer_shipping_cents"),
        _cents(F.col("l_extendedprice") * F.col("l_discount")).alias("platform_fees_cents"),
        _cents(F.col("l_extendedprice") * F.col("l_tax")).alias("promo_fee_cents"),
        (F.col("l_quantity") * 10).cast("bigint").alias("shipping_label_cost_cents"),
        (sk % 50).cast("bigint").alias("other_costs_cents"),
        _pfx("ord-", ok).alias("order_ref"),
        F.when(ln == 1, F.lit(None).cast("string")).otherwise(F.lit("")).alias("note"),
        made(ok, "09").alias("created_at"))


def sales_legacy_from(orders: DataFrame) -> DataFrame:
    """The older Sales layout (``sold_date``; no order_ref, no note)."""
    k = F.col("o_orderkey")
    zero = F.lit(0).cast("bigint")
    return orders.select(
        _pfx("osale-", k).alias("id"), F.lit(None).cast("string").alias("inventory_id"),
        _pfx("CUST-", F.col("o_custkey")).alias("sku"), F.lit(1).cast("bigint").alias("qty"),
        _cents(F.col("o_totalprice")).alias("sold_price_cents"),
        zero.alias("buyer_shipping_cents"), zero.alias("platform_fees_cents"),
        zero.alias("promo_fee_cents"), zero.alias("shipping_label_cost_cents"),
        zero.alias("other_costs_cents"), _day(F.col("o_orderdate")).alias("sold_date"),
        made(k, "13").alias("created_at"))


def expenses_from(events: DataFrame) -> DataFrame:
    e, u, t = F.col("event_id"), F.col("user_id"), F.col("event_type")
    mileage = t == "view"
    return events.select(
        _pfx("exp-", e).alias("id"), _day(F.col("ts")).alias("date"), t.alias("category"),
        _cents(F.col("value")).alias("amount_cents"), F.lit("").alias("vendor"),
        F.lit("").alias("note"),
        F.when(e % 5 == 0, _pfx("SKU-", u)).alias("sku"),
        F.when(mileage, "mileage").otherwise("standard").alias("type"),
        u.cast("bigint").alias("miles"), (e % 100).cast("bigint").alias("rate_cents_per_mile"),
        F.when(mileage, u * (e % 100)).cast("bigint").alias("calc_amount_cents"),
        F.when(t == "error", 0).otherwise(1).cast("bigint").alias("deductible"),
        made(e, "10").alias("created_at"))


def lots_from(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    return supplier.select(
        _pfx("lot-", k).alias("id"), F.col("s_name").alias("title"), F.lit("").alias("note"),
        F.when(F.col("s_nationkey") % 2 == 0, "open").otherwise("closed").alias("status"),
        made(k, "11").alias("created_at"))


def inventory_lots_from(lineitem: DataFrame) -> DataFrame:
    # The keys are shuffled as numbers; their texts are made of the distinct ones.
    return lineitem.select("l_partkey", "l_suppkey").dropDuplicates().select(
        _pfx("inv-", F.col("l_partkey")).alias("inventory_id"), _pfx("lot-", F.col("l_suppkey")).alias("lot_id"))


def photos_from(pages: DataFrame) -> DataFrame:
    p = F.col("page_id")
    inv = _pfx("inv-", p % 50)
    return pages.select(
        _pfx("ph-", p).alias("id"), inv.alias("inventory_id"),
        F.concat(F.lit("inventory/"), inv, F.lit("/ph-"), p.cast("string"),
                 F.lit("_page.html")).alias("r2_key"),
        F.lit("text/html").alias("content_type"),
        F.octet_length(F.col("html")).cast("bigint").alias("size_bytes"),
        made(p, "12").alias("created_at"))


def ledger_from_testdata(spark: SparkSession, sf_dir: str) -> Ledger:
    """Derive all six tables lazily; nothing is read until an action runs."""
    raw = lambda n: load_raw(spark, sf_dir, n)
    return Ledger(
        inventory=inventory_from(raw("part")),
        sales=sales_from(raw("lineitem")),
        expenses=expenses_from(raw("events")),
        lots=lots_from(raw("supplier")),
        inventory_lots=inventory_lots_from(raw("lineitem")),
        photos=photos_from(raw("pages")),
    )
