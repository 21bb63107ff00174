"""Oracles for change batches, computed from the generating columns of the
payloads (the oracle never parses JSON)."""

from __future__ import annotations

from .oracle_sql import SALES_COLS, cents, day, with_ledger

LSEQ = "((l_orderkey * 8 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey)"


def arrived(s: str) -> str:
    return (f"('2024-02-' || lpad(CAST(({s}) % 28 + 1 AS VARCHAR), 2, '0') || ' ' || "
            f"lpad(CAST(({s}) % 24 AS VARCHAR), 2, '0') || ':00:00')")


def source(s: str) -> str:
    return f"('dev-' || ({s}) % 4)"


def rid(entity: str, s: str) -> str:
    return f"sha256({source(s)} || '|{entity}|' || {s})"


def st(k: str) -> str:
    return (f"CASE ({k}) % 4 WHEN 0 THEN 'staged' WHEN 1 THEN 'draft' WHEN 2 THEN 'active' "
            "ELSE 'sold' END")


INV_PAY = f"""ip0 AS (
  SELECT p_partkey AS seq,
         CASE WHEN p_partkey % 10 = 0 THEN 'SKU-' || p_partkey ELSE 'NEW-' || (p_partkey // 2) END AS sku,
         p_name AS title, p_type AS category, {cents('p_retailprice')} AS cost_cents,
         CASE WHEN p_partkey % 19 = 0 THEN 0 ELSE CAST(p_size AS BIGINT) END AS quantity,
         p_size,
         (p_partkey % 11 <> 0 AND p_partkey % 13 <> 0) AS valid
  FROM part),
ip AS (
  SELECT seq, sku, title, category, cost_cents, quantity, valid AND seq % 37 <> 7 AS valid, 1 AS delivery,
         {arrived('seq')} AS arrived FROM ip0
  UNION ALL
  SELECT seq, CASE WHEN seq % 37 = 6 THEN regexp_replace(sku, '^(SKU|NEW)-', 'AGAIN-') ELSE sku END, title, category,
         cost_cents, quantity, valid, 2,
         CASE WHEN seq % 37 = 5 THEN {arrived('seq')} ELSE replace({arrived('seq')}, '2024-02', '2024-03') END
  FROM ip0 WHERE seq % 37 IN (5, 6, 7)),
req AS (SELECT * FROM ip WHERE valid QUALIFY row_number() OVER (PARTITION BY seq ORDER BY delivery) = 1),
win AS (SELECT sku, min(seq) AS seq FROM req GROUP BY sku),
fresh AS (SELECT seq, delivery FROM win JOIN req USING (sku, seq) WHERE sku NOT IN (SELECT sku FROM inventory))"""

SALE_PAY = f"""sp AS (SELECT *, {LSEQ} AS seq FROM lineitem),
sale_ok AS (
  SELECT {rid('sale', 'seq')} AS id, {day('l_shipdate')} AS date,
         CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'inv-' || l_partkey END AS inventory_id,
         'SKU-' || l_partkey AS sku,
         CASE WHEN seq % 19 = 0 THEN 1 ELSE CAST(l_quantity AS BIGINT) END AS qty,
         {cents('l_extendedprice')} AS sold_price_cents,
         CAST(l_linenumber * 100 AS BIGINT) AS buyer_shipping_cents,
         {cents('l_extendedprice * l_discount')} AS platform_fees_cents,
         {cents('l_extendedprice * l_tax')} AS promo_fee_cents,
         {cents('l_quantity / 10')} AS shipping_label_cost_cents,
         CASE WHEN l_suppkey % 2 = 0 THEN 0
              ELSE {cents('CAST(l_suppkey % 50 AS DOUBLE) / 100.0')} END AS other_costs_cents,
         'ord-' || l_orderkey AS order_ref,
         CASE seq % 29 WHEN 4 THEN '1e-7' WHEN 5 THEN '1e+21' WHEN 6 THEN '12.5'
              ELSE CASE WHEN l_linenumber = 1 THEN '' ELSE 'n' || l_linenumber END END AS note,
         {arrived('seq')} AS created_at, seq
  FROM sp WHERE seq % 11 <> 0 AND seq % 13 <> 0 AND seq % 29 NOT IN (1, 7, 8, 9))"""

EXP_PAY = f"""exp_ok AS (
  SELECT {rid('expense', 'event_id')} AS id, {day('ts')} AS date, event_type AS category,
         {cents('value')} AS amount_cents,
         CASE WHEN event_id % 2 = 0 THEN 'v' || user_id ELSE '' END AS vendor, '' AS note,
         CASE WHEN event_id % 5 = 0 THEN 'SKU-' || user_id END AS sku,
         CASE WHEN event_type = 'view' THEN 'mileage' ELSE 'standard' END AS type,
         CAST(CASE WHEN event_type = 'view' AND event_id % 19 <> 0 THEN greatest(user_id, 0) ELSE 0 END
              AS BIGINT) AS miles,
         CASE WHEN event_type = 'view' THEN {cents('CAST(event_id % 100 AS DOUBLE) / 100.0')} ELSE 0 END
           AS rate_cents_per_mile,
         CAST(CASE WHEN event_type = 'error' OR event_id % 6 IN (2, 3) THEN 0 ELSE 1 END AS BIGINT)
           AS deductible,
         {arrived('event_id')} AS created_at, event_id AS seq
  FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0
    AND NOT (event_type = 'view' AND event_id % 23 = 0))"""

LOT_PAY = f"""lp0 AS (
  SELECT s_suppkey AS seq, s_name AS title,
         CASE WHEN s_suppkey % 2 = 0 THEN 'note ' || s_suppkey ELSE '' END AS note,
         CASE s_nationkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'closed'
              ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'open' ELSE 'x' END END AS status,
         (s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0) AS has_title
  FROM supplier)"""

PATCH = f"""pr AS (
  SELECT {LSEQ} AS seq, l_linenumber AS ln, l_suppkey AS sk, l_orderkey AS ok, l_quantity AS q,
         CASE WHEN l_linenumber = 7 THEN 'inv-x' || l_partkey ELSE 'inv-' || l_partkey END AS target_id
  FROM lineitem),
pf AS (
  SELECT target_id, seq,
         (seq % 11 <> 0 AND ln % 4 IN (1, 3)) AS has_status,
         CASE WHEN ln % 4 = 1 THEN {st('sk')}
              WHEN ln % 4 = 3 THEN CASE WHEN sk % 10 = 0 THEN 'bogus' ELSE {st('sk + 1')} END END
           AS status_val,
         (seq % 11 <> 0 AND ln % 3 = 1) AS has_qty,
         CAST(CASE WHEN ok % 10 = 0 THEN 0 ELSE q END AS BIGINT) AS qty_val,
         (seq % 11 <> 0 AND ln % 3 = 1 AND ok % 10 = 5) AS qty_bad
  FROM pr),
pagg AS (
  SELECT target_id, arg_max(status_val, seq) FILTER (WHERE has_status) AS new_status,
         arg_max(qty_val, seq) FILTER (WHERE has_qty) AS new_qty
  FROM pf WHERE (has_status OR has_qty) AND NOT (has_status AND status_val = 'bogus') AND NOT qty_bad
  GROUP BY target_id),
pout AS (
  SELECT 'inventory_patch' AS entity,
         CASE WHEN NOT (has_status OR has_qty) THEN 'no_fields'
              WHEN target_id NOT IN (SELECT id FROM inventory) THEN 'not_found'
              WHEN qty_bad OR (has_status AND status_val = 'bogus') THEN 'update_failed' ELSE 'ok' END AS outcome
  FROM pf)"""

LOT_PATCH = f"""lr AS (
  SELECT {LSEQ} AS seq, l_linenumber AS ln, l_orderkey AS ok,
         CASE WHEN l_linenumber = 7 THEN 'lot-x' || l_suppkey ELSE 'lot-' || l_suppkey END AS target_id
  FROM lineitem),
lf AS (
  SELECT target_id, seq,
         (seq % 11 <> 0 AND ln % 4 = 0) AS has_title, 'T' || ok AS title_val,
         (seq % 11 <> 0 AND ln % 3 IN (0, 1)) AS has_note,
         CASE WHEN ln % 3 = 0 THEN '' ELSE 'N' || ok END AS note_val,
         (seq % 11 <> 0 AND ln % 5 IN (0, 1)) AS has_status,
         CASE WHEN ln % 5 = 0 THEN 'closed' ELSE 'open' END AS status_val
  FROM lr),
lagg AS (
  SELECT target_id, arg_max(title_val, seq) FILTER (WHERE has_title) AS new_title,
         arg_max(note_val, seq) FILTER (WHERE has_note) AS new_note,
         arg_max(status_val, seq) FILTER (WHERE has_status) AS new_status
  FROM lf WHERE has_title OR has_note OR has_status GROUP BY target_id),
lout AS (
  SELECT 'lot_patch' AS entity,
         CASE WHEN NOT (has_title OR has_note OR has_status) THEN 'no_fields'
              WHEN target_id NOT IN (SELECT id FROM lots) THEN 'not_found' ELSE 'ok' END AS outcome
  FROM lf)"""

LINKS = """lreq AS (
  SELECT o_orderkey AS seq, 'lot-' || (o_orderkey % 97 + 1) AS lot_id,
         CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 8 = 0 THEN ''
              WHEN o_orderkey % 9 = 0 THEN 'NOSKU-' || o_custkey
              WHEN o_orderkey % 10 = 0 THEN 'sku-' || o_custkey
              ELSE 'SKU-' || o_custkey END AS sku
  FROM orders),
lres AS (SELECT lreq.*, i.id AS inventory_id FROM lreq LEFT JOIN inventory i ON i.sku = lreq.sku)"""

MIXED = f"""mx AS (SELECT {LSEQ} AS seq, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk FROM lineitem),
ops AS (
  SELECT seq, 'lot-' || sk AS lot_id, 'inv-' || pk AS inventory_id, 'link' AS op
  FROM mx WHERE ln % 2 = 1 AND seq % 11 <> 0
  UNION ALL
  SELECT seq, 'lot-' || sk AS lot_id,
         CASE WHEN ln = 6 THEN 'inv-x' || pk ELSE 'inv-' || pk END AS inventory_id, 'unlink' AS op
  FROM mx WHERE ln % 2 = 0),
last_op AS (SELECT lot_id, inventory_id, arg_max(op, seq) AS last_op FROM ops GROUP BY lot_id, inventory_id),
prev AS (
  SELECT o.*, lag(op) OVER (PARTITION BY lot_id, inventory_id ORDER BY seq) AS prev_op,
         EXISTS (SELECT 1 FROM inventory_lots b WHERE b.lot_id = o.lot_id
                 AND b.inventory_id = o.inventory_id) AS base_has
  FROM ops o),
mout AS (
  SELECT 'link' AS entity, CASE WHEN seq % 11 = 0 THEN 'sku required' ELSE 'ok' END AS outcome
  FROM mx WHERE ln % 2 = 1
  UNION ALL
  SELECT 'unlink' AS entity,
         CASE WHEN (CASE WHEN prev_op = 'link' THEN TRUE WHEN prev_op = 'unlink' THEN FALSE
                         ELSE base_has END) THEN 'ok' ELSE 'not_found' END AS outcome
  FROM prev WHERE op = 'unlink')"""

EDITS = f"""ed AS (
  SELECT o_orderkey AS seq, 'inv-' || o_custkey AS target_id, (o_orderkey % 25 = 0) AS is_delete,
         (o_orderkey % 31 = 7) AS is_empty,
         'T' || o_orderkey AS title_val, (o_orderkey % 3 = 0) AS has_category,
         'Cat' || (o_orderkey % 7) AS category_val,
         CASE WHEN o_orderkey % 50 = 1 THEN 'bogus' WHEN o_orderstatus = 'F' THEN 'sold'
              WHEN o_orderstatus = 'O' THEN 'active' ELSE 'draft' END AS status_val,
         CAST((o_orderkey % 1000) * 10 AS BIGINT) AS cost_val, CAST(o_orderkey % 9 AS BIGINT) AS qty_val,
         {day('o_orderdate')} AS listed_val
  FROM orders),
first_del AS (SELECT target_id, min(seq) AS d FROM ed WHERE is_delete GROUP BY target_id),
live AS (
  SELECT ed.* FROM ed LEFT JOIN first_del f USING (target_id)
  WHERE NOT is_delete AND (f.d IS NULL OR ed.seq < f.d)),
eagg AS (
  SELECT target_id, arg_max(title_val, seq) AS new_title,
         arg_max(category_val, seq) FILTER (WHERE has_category) AS new_category,
         arg_max(status_val, seq) AS new_status, arg_max(cost_val, seq) AS new_cost,
         arg_max(qty_val, seq) AS new_qty, arg_max(listed_val, seq) AS new_listed
  FROM live WHERE status_val <> 'bogus' AND NOT is_empty GROUP BY target_id),
eout AS (
  SELECT 'item_edit' AS entity,
         CASE WHEN is_empty THEN 'no_fields'
              WHEN ed.target_id NOT IN (SELECT id FROM inventory) OR (f.d IS NOT NULL AND ed.seq > f.d)
              THEN 'not_found' WHEN status_val = 'bogus' THEN 'update_failed' ELSE 'ok' END AS outcome
  FROM ed LEFT JOIN first_del f USING (target_id) WHERE NOT is_delete
  UNION ALL
  SELECT 'item_delete' AS entity,
         CASE WHEN ed.seq = f.d AND ed.target_id IN (SELECT id FROM inventory) THEN 'ok'
              ELSE 'not_found' END AS outcome
  FROM ed JOIN first_del f USING (target_id) WHERE is_delete)"""


def change_oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["ingest_inventory"] = with_ledger(f"""
SELECT {rid('inventory', 'ip.seq')} AS id, ip.sku, title, category, 'staged' AS status,
       cost_cents, quantity, arrived AS created_at, ip.seq
FROM ip JOIN fresh USING (seq, delivery)""", INV_PAY)
    q["ingest_sales"] = with_ledger("SELECT * FROM sale_ok", SALE_PAY)
    q["stored_append_sales"] = with_ledger(f"SELECT {SALES_COLS} FROM sales UNION ALL SELECT {SALES_COLS} FROM sale_ok", SALE_PAY)
    q["log_error_lines"] = """
SELECT line FROM (
  SELECT concat_ws(' ', strftime(ts, '%Y-%m-%d %H:%M:%S'), event_type,
         CASE event_id % 6 WHEN 0 THEN 'ok 200' WHEN 1 THEN 'got 404 from api'
              WHEN 2 THEN 'GET -> 503 retry' WHEN 3 THEN 'id 4040' WHEN 4 THEN '-> 500'
              ELSE CASE WHEN event_id % 4 = 0 THEN '✗ create' ELSE 'Failure noted' END END) AS line
  FROM events)
WHERE regexp_matches(line, '(?i)✗|error|failed|failure| 4[0-9]{2} | 5[0-9]{2} ')"""
    q["ingest_expenses"] = with_ledger("""
SELECT id, date, category, amount_cents, vendor, note, sku, type, miles, rate_cents_per_mile,
       CAST(CASE WHEN type = 'mileage' THEN miles * rate_cents_per_mile END AS BIGINT) AS calc_amount_cents,
       deductible, created_at, seq FROM exp_ok""", EXP_PAY)
    q["ingest_lots"] = with_ledger(f"""
SELECT {rid('lot', 'seq')} AS id, title, note, status, {arrived('seq')} AS created_at, seq
FROM lp0 WHERE has_title AND status <> 'x'""", LOT_PAY)
    q["ingest_rejects"] = with_ledger(f"""
SELECT {source('seq')} AS source, * FROM (
  SELECT seq, 'inventory' AS entity, 'sku/title/category required' AS reason FROM ip WHERE NOT valid
  UNION ALL
  SELECT seq, 'inventory', 'insert_failed' FROM ip WHERE valid AND (seq, delivery) NOT IN (SELECT (seq, delivery) FROM fresh)
  UNION ALL
  SELECT {LSEQ}, 'sale', 'date/sku/order_ref required' FROM lineitem
  WHERE {LSEQ} % 11 = 0 OR {LSEQ} % 13 = 0 OR {LSEQ} % 29 IN (1, 7, 8, 9)
  UNION ALL
  SELECT event_id, 'expense', CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 'date/category required'
                                   ELSE 'amount_out_of_range' END FROM events
  WHERE event_id % 11 = 0 OR event_id % 13 = 0 OR (event_type = 'view' AND event_id % 23 = 0)
  UNION ALL
  SELECT seq, 'lot', CASE WHEN NOT has_title THEN 'title required' ELSE 'bad status' END
  FROM lp0 WHERE NOT has_title OR status = 'x')
UNION ALL
SELECT CASE WHEN n_nationkey % 4 <> 0 THEN 'dev-9' END,
       CASE WHEN n_nationkey % 4 IN (1, 2) THEN CAST(n_nationkey AS BIGINT) END,
       CASE n_nationkey % 4 WHEN 1 THEN 'refund' WHEN 3 THEN 'sale' END,
       CASE n_nationkey % 4 WHEN 1 THEN 'unknown_entity' ELSE 'bad_envelope' END
FROM nation""", INV_PAY + "," + LOT_PAY)
    q["ingest_parse_errors"] = f"""
SELECT 'inventory' AS entity, CAST(sum(CASE WHEN p_partkey % 37 IN (5, 6, 7) THEN 2 ELSE 1 END) AS BIGINT) AS n_payloads,
       CAST(sum(CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_partkey % 37 = 7 THEN 1 ELSE 0 END
                     WHEN p_partkey % 37 IN (5, 6, 7) THEN 2 ELSE 1 END) AS BIGINT) AS n_unparsable,
       CAST(0 AS BIGINT) AS n_not_object FROM part
UNION ALL
SELECT 'sale', count(*), sum(CASE WHEN {LSEQ} % 11 = 0 OR {LSEQ} % 29 IN (1, 7, 8, 9) THEN 1 ELSE 0 END), 0 FROM lineitem
UNION ALL
SELECT 'expense', count(*), sum(CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END), 0 FROM events
UNION ALL
SELECT 'lot', count(*), sum(CASE WHEN s_suppkey % 11 = 0 THEN 1 ELSE 0 END), 0 FROM supplier"""
    for entity in ("sales", "expenses", "lots", "inventory"):
        q[f"stream_ingest_{entity}"] = q[f"ingest_{entity}"]
    q["ingest_numbers"] = f"""
SELECT seq,
       CAST(CASE WHEN seq % 11 = 0 OR seq % 29 IN (1, 7, 8, 9) OR seq % 19 = 0 THEN 1 ELSE l_quantity END AS BIGINT) AS sale_qty,
       CAST(CASE WHEN seq % 11 = 0 OR seq % 29 IN (1, 7, 8, 9) THEN 1 WHEN seq % 19 = 0 THEN 0 ELSE l_quantity END AS BIGINT)
         AS item_quantity
FROM (SELECT *, {LSEQ} AS seq FROM lineitem)"""
    q["cost_precedence"] = f"""
SELECT p_partkey AS seq,
       CASE WHEN p_partkey % 11 = 0 THEN CAST(0 AS BIGINT)
            WHEN p_partkey % 4 = 0 THEN CAST(p_size * 100 AS BIGINT)
            ELSE {cents('p_retailprice')} END AS cost_cents,
       CAST(CASE WHEN p_partkey % 11 = 0 OR p_partkey % 19 = 0 THEN 1 ELSE p_size END AS BIGINT)
         AS quantity
FROM part"""
    q["patch_inventory"] = with_ledger("""
SELECT i.id, i.sku, i.title, i.category, COALESCE(a.new_status, i.status) AS status, i.cost_cents,
       COALESCE(a.new_qty, i.quantity) AS quantity, i.created_at
FROM inventory i LEFT JOIN pagg a ON a.target_id = i.id""", PATCH)
    q["patch_lots"] = with_ledger("""
SELECT l.id, COALESCE(a.new_title, l.title) AS title, COALESCE(a.new_note, l.note) AS note,
       COALESCE(a.new_status, l.status) AS status, l.created_at
FROM lots l LEFT JOIN lagg a ON a.target_id = l.id""", LOT_PATCH)
    q["link_items"] = with_ledger("""
SELECT inventory_id, lot_id FROM inventory_lots
UNION
SELECT inventory_id, lot_id FROM lres WHERE sku <> '' AND inventory_id IS NOT NULL""", LINKS)
    q["link_unresolved"] = with_ledger("""
SELECT seq, lot_id, sku,
       CASE WHEN sku = '' THEN 'sku required' ELSE 'inventory_not_found' END AS reason
FROM lres WHERE sku = '' OR inventory_id IS NULL""", LINKS)
    q["unlink_items"] = with_ledger("""
SELECT inventory_id, lot_id FROM inventory_lots b
WHERE NOT EXISTS (SELECT 1 FROM last_op l WHERE l.lot_id = b.lot_id AND l.inventory_id = b.inventory_id)
UNION ALL
SELECT inventory_id, lot_id FROM last_op WHERE last_op = 'link'""", MIXED)
    q["change_outcomes"] = with_ledger("""
SELECT entity, outcome, CAST(count(*) AS BIGINT) AS n
FROM (SELECT * FROM pout UNION ALL SELECT * FROM lout UNION ALL SELECT * FROM mout)
GROUP BY entity, outcome""", PATCH + "," + LOT_PATCH + "," + MIXED)
    q["stored_patch_inventory"] = q["patch_inventory"]
    q["stored_unlink_items"] = q["stored_unlink_compacted"] = q["unlink_items"]
    q["lookup_by_keys"] = with_ledger("""
SELECT id, sku, title, category, status, cost_cents, quantity, created_at FROM inventory
WHERE sku IN (SELECT 'SKU-' || o_custkey FROM orders WHERE o_orderkey % 3 = 0)""")
    q["edit_delete_items"] = with_ledger("""
SELECT i.id, i.sku, COALESCE(a.new_title, i.title) AS title,
       COALESCE(a.new_category, i.category) AS category, COALESCE(a.new_status, i.status) AS status,
       COALESCE(a.new_cost, i.cost_cents) AS cost_cents, COALESCE(a.new_qty, i.quantity) AS quantity,
       i.created_at, a.new_listed AS listed_date
FROM inventory i LEFT JOIN eagg a ON a.target_id = i.id
WHERE i.id NOT IN (SELECT target_id FROM first_del)""", EDITS)
    q["stored_edit_delete_items"] = q["edit_delete_items"]
    q["edit_delete_outcomes"] = with_ledger("""
SELECT entity, outcome, CAST(count(*) AS BIGINT) AS n FROM eout GROUP BY entity, outcome""", EDITS)
    return q
