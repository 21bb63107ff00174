"""Registered queries that go through files: stream ingestion, stored objects, logs.

Inputs are derived from the test tables by Spark and written once to a fresh
folder under the session's shared checkpoint folder, then read back through
the real sources.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.middle import median
from ..operators import changes, ingest, report, views
from ..session import drop_scratch, scratch_path
from ..sources import ledger as L
from ..sources import objects
from ..sources import payloads as PL
from ..streaming.ingest_stream import read_stream_output, start_ingest_stream
from . import params as P


def _streamed(spark, entity, payloads, existing=None):
    """The requests written as files, taken in by a stream that also feeds a ledger folder."""
    src, out = scratch_path(spark, f"{entity}-requests"), scratch_path(spark, f"{entity}-ingest")
    PL.write_payloads(payloads, src)
    q = start_ingest_stream(spark, src, out, scratch_path(spark, f"{entity}-ingest-ckpt"), entity, existing=existing,
                            ledger_root=scratch_path(spark, f"{entity}-ledger"))
    q.awaitTermination()
    drop_scratch(spark, src)
    return read_stream_output(spark, out, "accepted", entity)


def q_stream_ingest_sales(spark, sf_dir):
    return _streamed(spark, "sale", PL.sale_payloads(L.load_raw(spark, sf_dir, "lineitem")))


def q_stream_ingest_expenses(spark, sf_dir):
    return _streamed(spark, "expense", PL.expense_payloads(L.load_raw(spark, sf_dir, "events")))


def q_stream_ingest_lots(spark, sf_dir):
    return _streamed(spark, "lot", PL.lot_payloads(L.load_raw(spark, sf_dir, "supplier")))


def q_stream_ingest_inventory(spark, sf_dir):
    part = L.load_raw(spark, sf_dir, "part")
    return _streamed(spark, "inventory", PL.delivered_again(PL.inventory_payloads(part)), L.inventory_from(part))


# ------------------------------------------------------------ the stored layout

def _stored(spark, sf_dir) -> L.Ledger:
    """The derived ledger, written as a snapshot and read back through its pointer."""
    root = scratch_path(spark, "ledger")
    L.write_snapshot(L.ledger_from_testdata(spark, sf_dir), root)
    return L.read_snapshot(spark, root)


def q_stored_list_sales(spark, sf_dir):
    return views.list_sales(_stored(spark, sf_dir).sales, P.SALES_FROM, P.SALES_TO, P.LIST_CAP)


def q_stored_list_expenses(spark, sf_dir):
    return views.list_expenses(_stored(spark, sf_dir).expenses, P.EXPENSES_FROM, P.EXPENSES_TO, P.LIST_CAP)


def q_stored_lot_items(spark, sf_dir):
    lg = _stored(spark, sf_dir)
    return views.lot_items(lg.inventory_lots, lg.inventory, P.LOT_ID, P.LOT_ITEMS_CAP)


def q_stored_photos_for_item(spark, sf_dir):
    return views.photos_for_item(_stored(spark, sf_dir).photos, P.PHOTO_ITEM)


def q_stored_list_lots(spark, sf_dir):
    return views.list_lots(_stored(spark, sf_dir).lots, P.LIST_CAP)


def q_stored_report_summary(spark, sf_dir):
    lg = _stored(spark, sf_dir)
    return report.report_summary(lg.inventory, lg.sales, lg.expenses, P.REPORT_FROM, P.REPORT_TO)


def q_stored_report_rolled(spark, sf_dir):
    """The report from the roll-ups of a ledger whose Sales came in two appends after the snapshot."""
    root, lg = scratch_path(spark, "rolled-ledger"), L.ledger_from_testdata(spark, sf_dir)
    L.write_snapshot(L.Ledger(lg.inventory, lg.sales.limit(0), lg.expenses, lg.lots, lg.inventory_lots, lg.photos), root)
    for part in ("qty % 2 = 0", "qty % 2 = 1", "qty % 2 = 0"):
        L.append_new_rows(lg.sales.where(part), root, "sales")
    at = L.state(spark, root)
    st = L.read_snapshot(spark, root, at)
    return report.report_summary_rolled(st.inventory, st.sales, L.read_months(spark, root, "sales", at), st.expenses,
                                        L.read_months(spark, root, "expenses", at), P.REPORT_FROM, P.REPORT_TO)


def q_stored_sales_profit(spark, sf_dir):
    _stored(spark, sf_dir).register("stored_")
    return spark.sql("SELECT * FROM stored_SalesReport")


def q_stored_sales_profit_titled(spark, sf_dir):
    _stored(spark, sf_dir).register("stored_")
    return spark.sql("SELECT * FROM stored_sales_profit_v")


def q_stored_append_sales(spark, sf_dir):
    """Two sources' requests appended to a ledger, the first of them twice, and read back from its root."""
    root = scratch_path(spark, "append-ledger")
    L.write_snapshot(L.ledger_from_testdata(spark, sf_dir), root)
    staged = scratch_path(spark, "accepted-sales")  # an append reads its rows several times
    ingest.ingest_sales(PL.sale_payloads(L.load_raw(spark, sf_dir, "lineitem"))).accepted.write.option("compression", L.COMPRESSION).parquet(staged)
    accepted = spark.read.parquet(staged)
    for batch in (accepted.where("seq % 2 = 0"), accepted.where("seq % 2 = 1"), accepted.where("seq % 2 = 0")):
        L.append_new_rows(batch.unionByName(batch.where("seq % 5 = 0")), root, "sales")
    drop_scratch(spark, staged)
    return L.read_snapshot(spark, root).sales.select(*views.SALES_COLS)


def q_stored_patch_inventory(spark, sf_dir):
    """D7 on the stored ledger: the files that hold a patched item written anew."""
    root = scratch_path(spark, "patched-ledger")
    L.write_snapshot(L.ledger_from_testdata(spark, sf_dir), root)
    patches = PL.inventory_patch_payloads(L.load_raw(spark, sf_dir, "lineitem"))
    L.rewrite(spark, root, "inventory", patches.select(F.col("target_id").alias("id")),
              lambda items: changes.patch_inventory(items, patches).table)
    return L.read_snapshot(spark, root).inventory.select(*views.INVENTORY_COLS)


def q_stored_edit_delete_items(spark, sf_dir):
    root = scratch_path(spark, "edited-ledger")
    L.write_snapshot(L.ledger_from_testdata(spark, sf_dir), root)
    edits = PL.item_edit_payloads(L.load_raw(spark, sf_dir, "orders"))
    L.rewrite(spark, root, "inventory", edits.select(F.col("target_id").alias("id")),
              lambda items: changes.edit_delete_items(items, edits).table)
    return L.read_snapshot(spark, root).inventory.select(*views.INVENTORY_COLS, "listed_date")


def _relinked(spark, sf_dir):
    """The stored ledger after a mixed batch of links and unlinks, in two parts by number."""
    root = scratch_path(spark, "linked-ledger")
    L.write_snapshot(L.ledger_from_testdata(spark, sf_dir), root)
    li = L.load_raw(spark, sf_dir, "lineitem")
    cut = int(median(li, "l_orderkey")) * 8 * PL.SEQ_SCALE
    for part in (li.where(f"{PL.LSEQ} < {cut}"), li.where(f"{PL.LSEQ} >= {cut}")):  # before any request is built
        L.log_links(changes.last_links(PL.link_unlink_payloads(part), L.read_table(spark, root, "inventory")), root)
    return root


def q_stored_unlink_items(spark, sf_dir):
    """D5, D6 and J8 merged on read."""
    return L.read_snapshot(spark, _relinked(spark, sf_dir)).inventory_lots


def q_stored_unlink_compacted(spark, sf_dir):
    root = _relinked(spark, sf_dir)
    L.compact(spark, root, "inventory_lots")
    return L.read_table(spark, root, "inventory_lots")


def q_lookup_by_keys(spark, sf_dir):
    """P4 in bulk and J4: the stored items of the SKUs of one day's requests."""
    root = scratch_path(spark, "lookup-ledger")
    L.write_snapshot(L.ledger_from_testdata(spark, sf_dir), root)
    wanted = L.load_raw(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(
        F.concat(F.lit("SKU-"), F.col("o_custkey").cast("string")).alias("sku"))
    return views.lookup_by_keys(L.read_snapshot(spark, root).inventory, wanted, "sku").select(*views.INVENTORY_COLS)


def log_lines_from(events):
    """Log lines rendered from events (hits and misses of the error scan)."""
    e = F.col("event_id")
    tail = (F.when(e % 6 == 0, F.lit("ok 200")).when(e % 6 == 1, F.lit("got 404 from api"))
            .when(e % 6 == 2, F.lit("GET -> 503 retry")).when(e % 6 == 3, F.lit("id 4040"))
            .when(e % 6 == 4, F.lit("-> 500"))
            .otherwise(F.when(e % 4 == 0, F.lit("✗ create")).otherwise(F.lit("Failure noted"))))
    return events.select(F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                                     F.col("event_type"), tail).alias("value"))


def q_log_error_lines(spark, sf_dir):
    root = scratch_path(spark, "logs")
    log_lines_from(L.load_raw(spark, sf_dir, "events")).write.text(root)
    return objects.error_lines(objects.read_log_lines(spark, root))


def _manifest(spark, sf_dir):
    """An inventory report of the photo store: uploads, and every tenth object no upload."""
    root, p = scratch_path(spark, "photo-manifest"), F.col("page_id")
    key = F.when(p % 10 == 3, F.concat(F.lit("s3://photos/tmp/ph-"), p.cast("string"), F.lit(".html"))).otherwise(
        F.concat(F.lit("s3://photos/inventory/inv-"), (p % 50).cast("string"), F.lit("/ph-"), p.cast("string"),
                 F.lit("_page_"), p.cast("string"), F.lit(".HTML")))
    L.load_raw(spark, sf_dir, "pages").select(
        key.alias("path"), F.octet_length("html").cast("bigint").alias("length"),
        F.to_timestamp(L.made(p, "12")).alias("modificationTime")).write.parquet(root)
    return objects.read_manifest(spark, root)


def q_photo_catalogue(spark, sf_dir):
    return objects.photo_catalogue(_manifest(spark, sf_dir)).photos


def q_photo_misfits(spark, sf_dir):
    return objects.photo_catalogue(_manifest(spark, sf_dir)).misfits


def q_photo_append(spark, sf_dir):
    """Photo rows appended to a stored table; a second append adds nothing."""
    root = scratch_path(spark, "photo-ledger")
    photos = objects.photo_catalogue(_manifest(spark, sf_dir)).photos
    for _ in range(2):
        L.append_new_rows(photos, root, "photos")
    return L.read_table(spark, root, "photos")


def q_photo_upload_names(spark, sf_dir):
    """X14-X16 over upload names made of part names."""
    raw = F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")."),
                   F.when(F.col("p_partkey") % 3 == 0, "JPG").when(F.col("p_partkey") % 3 == 1, "png").otherwise("tar.Gz"))
    name = F.when(F.col("p_partkey") % 7 == 0, F.lit("")).otherwise(raw)
    part = L.load_raw(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    k = F.col("p_partkey").cast("string")
    return part.select("p_partkey", text.file_extension(F.col("name")).alias("ext"), text.safe_file_name(F.col("name")).alias("safe"),
                       text.photo_key(F.concat(F.lit("inv-"), k), F.concat(F.lit("ph-"), k), F.col("name")).alias("r2_key"))


FILES = {
    "stream_ingest_sales": q_stream_ingest_sales,
    "stream_ingest_expenses": q_stream_ingest_expenses,
    "stream_ingest_lots": q_stream_ingest_lots,
    "stream_ingest_inventory": q_stream_ingest_inventory,
    "stored_list_sales": q_stored_list_sales,
    "stored_list_expenses": q_stored_list_expenses,
    "stored_list_lots": q_stored_list_lots,
    "stored_lot_items": q_stored_lot_items,
    "stored_photos_for_item": q_stored_photos_for_item,
    "stored_report_summary": q_stored_report_summary,
    "stored_report_rolled": q_stored_report_rolled,
    "stored_sales_profit": q_stored_sales_profit,
    "stored_sales_profit_titled": q_stored_sales_profit_titled,
    "stored_append_sales": q_stored_append_sales,
    "stored_patch_inventory": q_stored_patch_inventory,
    "stored_edit_delete_items": q_stored_edit_delete_items,
    "stored_unlink_items": q_stored_unlink_items,
    "stored_unlink_compacted": q_stored_unlink_compacted,
    "lookup_by_keys": q_lookup_by_keys,
    "log_error_lines": q_log_error_lines,
    "photo_catalogue": q_photo_catalogue,
    "photo_misfits": q_photo_misfits,
    "photo_append": q_photo_append,
    "photo_upload_names": q_photo_upload_names,
}
