"""Change-request source (S7): JSON-lines envelopes with a raw JSON ``body``.

Production path: ``read_payloads`` / ``read_payload_stream`` over a directory of
JSON-lines files (``source, seq, entity, target_id, arrived_at, body``).  A line
that is no envelope is kept in ``_corrupt_record`` and goes to the quarantine.
The body stays text until ``try_parse_json`` turns it into VARIANT, so malformed
JSON is a NULL value (it acts like ``{}``), never a failed task.

The ``*_payloads`` builders derive deterministic request batches from the
shared test tables (amounts in USD, damaged by ``seq``: ``% 11`` cuts the body
short, ``% 13`` drops a required field, ``% 17`` sends a quantity as text,
``% 19`` sends it as null; sales also have text after the body, repeated keys,
byte-order marks and numbers for text, ``% 29``; items are also delivered again, ``% 37``).  They are plain projections (no shuffle), written
as SQL text so each stage is one JVM call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.js import sql_lit
from ..schemas import ENVELOPE, ENVELOPE_READ
from ..session import spread
from .ledger import load_raw

SEQ_SCALE = 1_000_000_000  # lineitem seq = (orderkey*8 + line) * 1e9 + partkey * 1e4 + suppkey

FILE_ROWS = 200_000


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Batch read of a change-request folder, spread over the cluster when narrow."""
    return spread(spark.read.schema(ENVELOPE_READ).json(path))


def read_payload_stream(spark: SparkSession, path: str, max_files: int | None = None):
    r = spark.readStream.schema(ENVELOPE_READ)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.json(path)


def write_payloads(df: DataFrame, path: str, files: int | None = None) -> str:
    """Requests as JSON lines, compressed (a tenth of the bytes); files of at most ``FILE_ROWS`` lines, since one
    compressed file is read by one task."""
    out = df.select(*[f.name for f in ENVELOPE.fields])
    if files:
        out = out.repartition(files)
    out.write.mode("errorifexists").option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).json(path)
    return path


# ----------------------------------------------------------- JSON text builders
# All builders return Spark SQL text.

def jstr(e: str) -> str:
    """A JSON string literal for ``e``: backslash, quote, tab, CR and LF escaped."""
    t = f"CAST({e} AS STRING)"
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        t = f"replace({t}, {sql_lit(a)}, {sql_lit(b)})"
    return f"concat('\"', {t}, '\"')"


def jnum(e: str) -> str:
    return f"CAST({e} AS STRING)"


def txt(prefix: str, e: str) -> str:
    return f"concat({sql_lit(prefix)}, CAST({e} AS STRING))"


def frag(name: str, value_json: str) -> str:
    """``"name":value``; a NULL value drops the key (``concat_ws`` skips NULLs)."""
    return f"concat('\"{name}\":', {value_json})"


def opt(cond: str, e: str) -> str:
    return f"CASE WHEN {cond} THEN {e} END"


def obj(*frags: str) -> str:
    return "concat('{', concat_ws(',', " + ", ".join(frags) + "), '}')"


def arrived(seq: str) -> str:
    return (f"concat('2024-02-', lpad(CAST({seq} % 28 + 1 AS STRING), 2, '0'), ' ', "
            f"lpad(CAST({seq} % 24 AS STRING), 2, '0'), ':00:00')")


def cut(seq: str, body: str) -> str:
    """``seq % 11 == 0``: keep only the first half of the text, so it no longer parses."""
    return f"CASE WHEN {seq} % 11 = 0 THEN substring({body}, 1, CAST(length({body}) / 2 AS INT)) ELSE {body} END"


def fenced(df: DataFrame) -> DataFrame:
    """Materialise generated envelopes row by row before they are parsed.

    Without it Catalyst inlines the body-building expression into every
    consumer that reads ``body``; a Generate node is never collapsed into the
    projections above it.
    """
    cols = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return df.selectExpr(f"inline(array(named_struct({cols})))")


def noisy(seq: str, body: str) -> str:
    """``seq % 29``: 1, 7, 8 and 9 append text after the body, 3 puts a byte-order mark before it."""
    return (f"CASE {seq} % 29 WHEN 1 THEN concat({body}, ' junk') WHEN 7 THEN concat({body}, ']') "
            f"WHEN 8 THEN concat({body}, '] junk') WHEN 9 THEN concat({body}, '],[1') "
            f"WHEN 3 THEN concat('\ufeff', {body}) ELSE {body} END")


def envelopes(raw: DataFrame, seq: str, entity: str, target: str, body: str,
              damage: bool = True, noise: bool = False) -> DataFrame:
    """Two projections (build the body, then damage and wrap it) and a fence."""
    b = raw.selectExpr(f"{seq} AS seq", f"{entity} AS entity", f"CAST({target} AS STRING) AS target_id",
                       f"{body} AS _body")
    b = b.selectExpr("seq", "entity", "target_id", f"{cut('seq', '_body') if damage else '_body'} AS _body")
    out = b.selectExpr("concat('dev-', CAST(seq % 4 AS STRING)) AS source", "seq", "entity", "target_id",
                       f"{arrived('seq')} AS arrived_at", f"{noisy('seq', '_body') if noise else '_body'} AS body")
    return fenced(out)


LSEQ = "((l_orderkey * 8 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey)"


def _qty_frag(seq: str, name: str, q: str) -> str:
    return frag(name, f"CASE WHEN {seq} % 19 = 0 THEN 'null' WHEN {seq} % 17 = 0 THEN {jstr(q)} "
                      f"ELSE {jnum(q)} END")


def _pad(seq: str, e: str) -> str:
    return f"CASE WHEN {seq} % 3 = 0 THEN concat(' ', {e}, {sql_lit(chr(9))}) ELSE {e} END"


def _status_of(k: str) -> str:
    return f"CASE ({k}) % 4 WHEN 0 THEN 'staged' WHEN 1 THEN 'draft' WHEN 2 THEN 'active' ELSE 'sold' END"


# --------------------------------------------------------------- entity batches

def inventory_payloads(part: DataFrame) -> DataFrame:
    k = "p_partkey"
    sku = f"CASE WHEN {k} % 10 = 0 THEN {txt('SKU-', k)} ELSE {txt('NEW-', f'floor({k} / 2)')} END"
    body = obj(frag("sku", jstr(_pad(k, sku))),
               opt(f"{k} % 13 <> 0", frag("title", jstr("p_name"))),
               frag("category", jstr("p_type")),
               frag("cost_usd", jnum("p_retailprice")),
               _qty_frag(k, "quantity", "CAST(p_size AS BIGINT)"),
               opt(f"{k} % 4 = 0", frag("cost_cents", jnum("CAST(p_size AS BIGINT) * 100"))))
    return envelopes(spread(part), k, "'inventory'", "NULL", body)


def delivered_again(requests: DataFrame) -> DataFrame:
    """The requests with lines delivered twice.  ``seq % 37``: 5 the same line again; 6 the number again, later, for
    another SKU; 7 first cut short, so that the second line is the request."""
    again = requests.where("seq % 37 IN (5, 6, 7)").selectExpr(
        "source", "seq", "entity", "target_id",
        "CASE WHEN seq % 37 = 5 THEN arrived_at ELSE concat('2024-03', substring(arrived_at, 8)) END AS arrived_at",
        "CASE WHEN seq % 37 = 6 THEN regexp_replace(body, '(SKU|NEW)-', 'AGAIN-') ELSE body END AS body")
    first = requests.selectExpr("source", "seq", "entity", "target_id", "arrived_at",
                                "CASE WHEN seq % 37 = 7 THEN substring(body, 1, 9) ELSE body END AS body")
    return fenced(first.unionByName(again))


def sale_payloads(lineitem: DataFrame) -> DataFrame:
    s = LSEQ
    note = (f"CASE WHEN {s} % 29 = 4 THEN '1e-7' WHEN {s} % 29 = 5 THEN '1e21' WHEN {s} % 29 = 6 THEN '12.50' "
            f"WHEN l_linenumber <> 1 THEN {jstr(txt('n', 'l_linenumber'))} END")
    body = obj(opt(f"{s} % 29 = 2", frag("sku", "'\"DUP\"'")),
               frag("date", jstr("date_format(l_shipdate, 'yyyy-MM-dd')")),
               frag("sku", jstr(_pad(s, txt("SKU-", "l_partkey")))),
               _qty_frag(s, "qty", "CAST(l_quantity AS BIGINT)"),
               frag("sold_price_usd", jnum("l_extendedprice")),
               frag("buyer_shipping_usd", jnum("CAST(l_linenumber AS BIGINT)")),
               frag("platform_fees_usd", jnum("l_extendedprice * l_discount")),
               frag("promo_fee_usd", jnum("l_extendedprice * l_tax")),
               frag("shipping_label_cost_usd", jnum("l_quantity / 10")),
               opt("l_suppkey % 2 <> 0",
                   frag("other_costs_usd", jnum("CAST(l_suppkey % 50 AS DOUBLE) / 100.0D"))),
               opt(f"{s} % 13 <> 0", frag("order_ref", jstr(txt("ord-", "l_orderkey")))),
               frag("note", note),
               opt("l_linenumber % 3 <> 0", frag("inventory_id", jstr(txt("inv-", "l_partkey")))))
    return envelopes(spread(lineitem), s, "'sale'", "NULL", body, noise=True)


def expense_payloads(events: DataFrame) -> DataFrame:
    e, u, t = "event_id", "user_id", "event_type"
    huge = f"{e} % 23 = 0"  # miles times rate is more than an integer holds
    miles = f"CASE WHEN {huge} THEN '9000000000000000' WHEN {e} % 19 = 0 THEN 'null' WHEN {e} % 17 = 0 THEN {jstr(u)} ELSE {jnum(u)} END"
    deductible = (f"CASE WHEN {t} = 'error' THEN '0' WHEN {e} % 6 = 1 THEN 'false' "
                  f"WHEN {e} % 6 = 2 THEN '\"0\"' WHEN {e} % 6 = 3 THEN '0.0' END")
    view = f"{t} = 'view'"
    body = obj(frag("date", jstr("date_format(ts, 'yyyy-MM-dd')")),
               opt(f"{e} % 13 <> 0", frag("category", jstr(t))),
               frag("amount_usd", jnum("value")),
               f"CASE WHEN {view} THEN {frag('type', jstr(sql_lit('mileage')))} "
               f"WHEN {e} % 7 = 0 THEN {frag('type', jstr(sql_lit('standard')))} END",
               opt(view, frag("miles", miles)),
               opt(view, frag("rate_usd_per_mile",
                              f"CASE WHEN {huge} THEN '1e12' ELSE {jnum(f'CAST({e} % 100 AS DOUBLE) / 100.0D')} END")),
               frag("deductible", deductible),
               opt(f"{e} % 2 = 0", frag("vendor", jstr(txt("v", u)))),
               opt(f"{e} % 5 = 0", frag("sku", jstr(txt("SKU-", u)))))
    return envelopes(spread(events), e, "'expense'", "NULL", body)


def lot_payloads(supplier: DataFrame) -> DataFrame:
    k, n = "s_suppkey", "s_nationkey"
    status = (f"CASE WHEN {n} % 3 = 1 THEN {jstr(sql_lit('closed'))} WHEN {n} % 3 = 2 THEN "
              f"(CASE WHEN {k} % 2 = 0 THEN {jstr(sql_lit('open'))} ELSE {jstr(sql_lit('x'))} END) END")
    body = obj(opt(f"{k} % 13 <> 0", frag("title", jstr("s_name"))),
               opt(f"{k} % 2 = 0", frag("note", jstr(txt("note ", k)))),
               frag("status", status))
    return envelopes(spread(supplier), k, "'lot'", "NULL", body)


def inventory_patch_payloads(lineitem: DataFrame) -> DataFrame:
    """Many patches per item; line 7 targets an unknown id."""
    status = (f"CASE WHEN l_linenumber % 4 = 1 THEN {jstr(_status_of('l_suppkey'))} "
              f"WHEN l_linenumber % 4 = 2 THEN {jstr(sql_lit(''))} "
              f"WHEN l_linenumber % 4 = 3 THEN (CASE WHEN l_suppkey % 10 = 0 THEN {jstr(sql_lit('bogus'))} "
              f"ELSE {jstr(_status_of('l_suppkey + 1'))} END) END")
    qty = (f"CASE WHEN l_linenumber % 3 = 1 THEN (CASE WHEN l_orderkey % 10 = 0 THEN {jnum('-l_quantity')} "
           f"WHEN l_orderkey % 10 = 5 THEN '1e300' "
           f"ELSE {jnum('l_quantity + 0.5D')} END) "
           f"WHEN l_linenumber % 3 = 2 THEN {jstr('CAST(l_quantity AS BIGINT)')} END")
    body = obj(frag("status", status), frag("quantity", qty))
    target = (f"CASE WHEN l_linenumber = 7 THEN {txt('inv-x', 'l_partkey')} "
              f"ELSE {txt('inv-', 'l_partkey')} END")
    return envelopes(spread(lineitem), LSEQ, "'inventory_patch'", target, body)


def lot_patch_payloads(lineitem: DataFrame) -> DataFrame:
    title = (f"CASE WHEN l_linenumber % 4 = 0 THEN {jstr(txt('T', 'l_orderkey'))} "
             f"WHEN l_linenumber % 4 = 1 THEN {jstr(sql_lit(''))} END")
    note = (f"CASE WHEN l_linenumber % 3 = 0 THEN {jstr(sql_lit(''))} "
            f"WHEN l_linenumber % 3 = 1 THEN {jstr(txt('N', 'l_orderkey'))} END")
    status = (f"CASE WHEN l_linenumber % 5 = 0 THEN {jstr(sql_lit('closed'))} "
              f"WHEN l_linenumber % 5 = 1 THEN {jstr(sql_lit('open'))} "
              f"WHEN l_linenumber % 5 = 2 THEN {jstr(sql_lit('x'))} END")
    body = obj(frag("title", title), frag("note", note), frag("status", status))
    target = (f"CASE WHEN l_linenumber = 7 THEN {txt('lot-x', 'l_suppkey')} "
              f"ELSE {txt('lot-', 'l_suppkey')} END")
    return envelopes(spread(lineitem), LSEQ, "'lot_patch'", target, body)


def link_payloads(orders: DataFrame) -> DataFrame:
    """Link requests by SKU into lots (lot existence is not checked)."""
    o, c = "o_orderkey", "o_custkey"
    sku = (f"CASE WHEN {o} % 8 = 0 THEN NULL WHEN {o} % 9 = 0 THEN {txt('NOSKU-', c)} "
           f"WHEN {o} % 10 = 0 THEN {txt('sku-', c)} ELSE {_pad(o, txt('SKU-', c))} END")
    body = obj(frag("sku", jstr(sku)))
    return envelopes(spread(orders), o, "'link'", txt("lot-", f"{o} % 97 + 1"), body)


def link_unlink_payloads(lineitem: DataFrame) -> DataFrame:
    """A mixed batch on existing (lot, item) keys: odd lines link, even lines unlink."""
    is_link = "l_linenumber % 2 = 1"
    link_body = cut(LSEQ, obj(frag("sku", jstr(txt("SKU-", "l_partkey")))))
    item = (f"CASE WHEN l_linenumber = 6 THEN {txt('inv-x', 'l_partkey')} "
            f"ELSE {txt('inv-', 'l_partkey')} END")
    unlink_body = obj(frag("inventory_id", jstr(item)))
    return envelopes(spread(lineitem), LSEQ, f"CASE WHEN {is_link} THEN 'link' ELSE 'unlink' END",
                     txt("lot-", "l_suppkey"),
                     f"CASE WHEN {is_link} THEN {link_body} ELSE {unlink_body} END", damage=False)


def item_edit_payloads(orders: DataFrame) -> DataFrame:
    """D9 batch: full-row edits and deletes of items (one in 25 is a delete)."""
    o, c = "o_orderkey", "o_custkey"
    status = (f"CASE WHEN {o} % 50 = 1 THEN 'bogus' WHEN o_orderstatus = 'F' THEN 'sold' "
              f"WHEN o_orderstatus = 'O' THEN 'active' ELSE 'draft' END")
    body = obj(frag("title", jstr(txt("T", o))),
               opt(f"{o} % 3 = 0", frag("category", jstr(txt("Cat", f"{o} % 7")))),
               frag("status", jstr(status)),
               frag("cost_cents", jnum(f"({o} % 1000) * 10")),
               frag("quantity", jnum(f"{o} % 9")),
               frag("listed_date", jstr("date_format(o_orderdate, 'yyyy-MM-dd')")))
    is_delete = f"{o} % 25 = 0"
    body = f"CASE WHEN {o} % 31 = 7 THEN '{{}}' ELSE {body} END"
    return envelopes(spread(orders), o, f"CASE WHEN {is_delete} THEN 'item_delete' ELSE 'item_edit' END",
                     txt("inv-", c), f"CASE WHEN {is_delete} THEN NULL ELSE {body} END", damage=False)


def misfit_payloads(nation: DataFrame) -> DataFrame:
    """Lines that are no envelope, and envelopes of no known entity or without a number."""
    k = "n_nationkey"
    out = nation.selectExpr(
        f"CASE WHEN {k} % 4 <> 0 THEN 'dev-9' END AS source",
        f"CASE WHEN {k} % 4 IN (1, 2) THEN CAST({k} AS BIGINT) END AS seq",
        f"CASE {k} % 4 WHEN 1 THEN 'refund' WHEN 3 THEN 'sale' END AS entity",
        "CAST(NULL AS STRING) AS target_id", f"CASE WHEN {k} % 4 <> 0 THEN {arrived(k)} END AS arrived_at",
        f"CASE WHEN {k} % 4 <> 0 THEN '{{}}' END AS body",
        f"CASE WHEN {k} % 4 = 0 THEN concat('no envelope ', CAST({k} AS STRING)) END AS _corrupt_record")
    return fenced(out)


def ingest_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All insert requests (inventory, sale, expense, lot) as one envelope table."""
    raw = lambda n: load_raw(spark, sf_dir, n)
    return (delivered_again(inventory_payloads(raw("part")))
            .unionByName(sale_payloads(raw("lineitem")))
            .unionByName(expense_payloads(raw("events")))
            .unionByName(lot_payloads(raw("supplier")))
            .unionByName(misfit_payloads(raw("nation")), allowMissingColumns=True))
