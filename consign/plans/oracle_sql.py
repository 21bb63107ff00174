"""Equivalent SQL for each registered query, runnable by DuckDB on the raw
test tables (region nation customer supplier part orders lineitem events
documents embeddings pages benchmark labels conversations as views).

Each text starts with the ledger derivations as CTEs; DuckDB inlines only the
ones a query references.  Every integer result is cast to BIGINT (DuckDB sums
are HUGEINT) and every computed column carries the Spark alias.
"""

from __future__ import annotations

from . import params as P


def cents(e: str) -> str:
    return (f"(CAST(floor(({e})*100) AS BIGINT) + "
            f"CASE WHEN ({e})*100 - floor(({e})*100) >= 0.5 THEN 1 ELSE 0 END)")


def made(k: str, hh: str) -> str:
    return f"('2024-01-' || lpad(CAST(({k}) % 28 + 1 AS VARCHAR), 2, '0') || ' {hh}:00:00')"


def day(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d')"


def money(n: str) -> str:
    return (f"('$' || CASE WHEN {n} < 0 THEN '-' ELSE '' END || CAST(abs({n}) // 100 AS VARCHAR)"
            f" || '.' || lpad(CAST(abs({n}) % 100 AS VARCHAR), 2, '0'))")


LEDGER_CTES = f"""
inventory AS (
  SELECT 'inv-' || p_partkey AS id, 'SKU-' || p_partkey AS sku, p_name AS title,
         p_type AS category,
         CASE p_partkey % 4 WHEN 0 THEN 'staged' WHEN 1 THEN 'draft' WHEN 2 THEN 'active'
              ELSE 'sold' END AS status,
         {cents('p_retailprice')} AS cost_cents, CAST(p_size AS BIGINT) AS quantity,
         {made('p_partkey', '08')} AS created_at
  FROM part),
sales AS (
  SELECT 'sale-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
         {day('l_shipdate')} AS date,
         CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber = 7 THEN 'inv-' || l_suppkey
              ELSE 'inv-' || l_partkey END AS inventory_id,
         CASE WHEN l_linenumber = 5 THEN 'OLD-' || l_partkey
              WHEN l_linenumber = 6 THEN 'GONE-' || l_partkey ELSE 'SKU-' || l_partkey END AS sku,
         CAST(l_quantity AS BIGINT) AS qty,
         {cents('l_extendedprice')} AS sold_price_cents,
         CAST(l_linenumber * 100 AS BIGINT) AS buyer_shipping_cents,
         {cents('l_extendedprice * l_discount')} AS platform_fees_cents,
         {cents('l_extendedprice * l_tax')} AS promo_fee_cents,
         CAST(l_quantity * 10 AS BIGINT) AS shipping_label_cost_cents,
         CAST(l_suppkey % 50 AS BIGINT) AS other_costs_cents,
         'ord-' || l_orderkey AS order_ref,
         CASE WHEN l_linenumber = 1 THEN NULL ELSE '' END AS note,
         {made('l_orderkey', '09')} AS created_at
  FROM lineitem),
sales_legacy AS (
  SELECT 'osale-' || o_orderkey AS id, CAST(NULL AS VARCHAR) AS inventory_id,
         'CUST-' || o_custkey AS sku, CAST(1 AS BIGINT) AS qty,
         {cents('o_totalprice')} AS sold_price_cents, CAST(0 AS BIGINT) AS buyer_shipping_cents,
         CAST(0 AS BIGINT) AS platform_fees_cents, CAST(0 AS BIGINT) AS promo_fee_cents,
         CAST(0 AS BIGINT) AS shipping_label_cost_cents, CAST(0 AS BIGINT) AS other_costs_cents,
         {day('o_orderdate')} AS sold_date, {made('o_orderkey', '13')} AS created_at
  FROM orders),
expenses AS (
  SELECT 'exp-' || event_id AS id, {day('ts')} AS date, event_type AS category,
         {cents('value')} AS amount_cents, '' AS vendor, '' AS note,
         CASE WHEN event_id % 5 = 0 THEN 'SKU-' || user_id END AS sku,
         CASE WHEN event_type = 'view' THEN 'mileage' ELSE 'standard' END AS type,
         CAST(user_id AS BIGINT) AS miles, CAST(event_id % 100 AS BIGINT) AS rate_cents_per_mile,
         CAST(CASE WHEN event_type = 'view' THEN user_id * (event_id % 100) END AS BIGINT)
           AS calc_amount_cents,
         CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS BIGINT) AS deductible,
         {made('event_id', '10')} AS created_at
  FROM events),
lots AS (
  SELECT 'lot-' || s_suppkey AS id, s_name AS title, '' AS note,
         CASE WHEN s_nationkey % 2 = 0 THEN 'open' ELSE 'closed' END AS status,
         {made('s_suppkey', '11')} AS created_at
  FROM supplier),
inventory_lots AS (
  SELECT DISTINCT 'inv-' || l_partkey AS inventory_id, 'lot-' || l_suppkey AS lot_id FROM lineitem),
photos AS (
  SELECT 'ph-' || page_id AS id, 'inv-' || (page_id % 50) AS inventory_id,
         'inventory/inv-' || (page_id % 50) || '/ph-' || page_id || '_page.html' AS r2_key,
         'text/html' AS content_type, CAST(strlen(html) AS BIGINT) AS size_bytes,
         {made('page_id', '12')} AS created_at
  FROM pages)"""


def with_ledger(body: str, extra_ctes: str = "") -> str:
    ctes = LEDGER_CTES + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{body}"


INV_COLS = "id, sku, title, category, status, cost_cents, quantity, created_at"
SALES_COLS = ("id, date, inventory_id, sku, qty, sold_price_cents, buyer_shipping_cents, "
              "platform_fees_cents, promo_fee_cents, shipping_label_cost_cents, "
              "other_costs_cents, order_ref, note, created_at")
EXP_COLS = ("id, date, category, amount_cents, vendor, note, sku, type, miles, "
            "rate_cents_per_mile, calc_amount_cents, deductible, created_at")

_SALES_AGG = f"""sa AS (
  SELECT CAST(COALESCE(SUM(sold_price_cents), 0) AS BIGINT) AS gross_cents,
         CAST(COALESCE(SUM(buyer_shipping_cents), 0) AS BIGINT) AS buyer_ship_cents,
         CAST(COALESCE(SUM(platform_fees_cents + promo_fee_cents + shipping_label_cost_cents
                           + other_costs_cents), 0) AS BIGINT) AS costs_cents,
         CAST(COALESCE(SUM(qty), 0) AS BIGINT) AS total_qty
  FROM sales WHERE date BETWEEN '{P.REPORT_FROM}' AND '{P.REPORT_TO}'),
ea AS (
  SELECT CAST(COALESCE(SUM(amount_cents), 0) AS BIGINT) AS expenses_cents,
         CAST(COALESCE(SUM(calc_amount_cents), 0) AS BIGINT) AS mileage_cents
  FROM expenses WHERE date BETWEEN '{P.REPORT_FROM}' AND '{P.REPORT_TO}'),
summary AS (
  SELECT gross_cents + buyer_ship_cents AS revenue_cents,
         costs_cents + expenses_cents + mileage_cents AS total_expenses_cents,
         (gross_cents + buyer_ship_cents) - (costs_cents + expenses_cents + mileage_cents) AS net_cents,
         (SELECT string_agg(status || '=' || cnt, ',' ORDER BY status)
          FROM (SELECT status, count(*) AS cnt FROM inventory GROUP BY status)) AS inventory_by_status
  FROM sa CROSS JOIN ea)"""


def _profit(titled: bool) -> str:
    rev = "(s.sold_price_cents + COALESCE(s.buyer_shipping_cents, 0))"
    cogs = "(COALESCE(i.cost_cents, 0) * s.qty)"
    money_cols = f"""CAST({rev} AS BIGINT) AS revenue_cents,
       CAST({cogs} AS BIGINT) AS cogs_cents,
       CAST(COALESCE(s.platform_fees_cents, 0) AS BIGINT) AS fees_cents,
       CAST(COALESCE(s.promo_fee_cents, 0) AS BIGINT) AS promo_fee_cents,
       CAST(COALESCE(s.shipping_label_cost_cents, 0) AS BIGINT) AS ship_label_cents,
       CAST(COALESCE(s.other_costs_cents, 0) AS BIGINT) AS other_costs_cents,
       CAST({rev} - COALESCE(s.platform_fees_cents, 0) - COALESCE(s.promo_fee_cents, 0)
            - COALESCE(s.shipping_label_cost_cents, 0) - COALESCE(s.other_costs_cents, 0)
            - {cogs} AS BIGINT) AS gross_profit_cents"""
    head = ("s.id, s.date, COALESCE(s.sku, i.sku) AS sku, i.title, s.qty," if titled
            else "s.id, s.sku, s.qty, s.date AS sold_date,")
    return with_ledger(f"""SELECT {head}
       {money_cols}
FROM sales s LEFT JOIN inventory i ON (s.inventory_id = i.id) OR (s.sku = i.sku)""")


def base_oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["report_summary"] = with_ledger("SELECT * FROM summary", _SALES_AGG)
    q["report_summary_text"] = with_ledger(
        f"SELECT 'Inventory by status: ' || inventory_by_status AS status_text, "
        f"{money('revenue_cents')} AS revenue_text, "
        f"{money('total_expenses_cents')} AS expenses_text, {money('net_cents')} AS net_text "
        "FROM summary", _SALES_AGG)
    q["sales_totals"] = with_ledger("SELECT * FROM sa", _SALES_AGG)
    q["expense_totals"] = with_ledger("SELECT * FROM ea", _SALES_AGG)
    q["inventory_by_status"] = with_ledger(
        "SELECT status, CAST(count(*) AS BIGINT) AS cnt FROM inventory GROUP BY status")
    q["inventory_status_map"] = q["inventory_by_status"]
    q["list_inventory"] = with_ledger(
        f"SELECT {INV_COLS} FROM inventory ORDER BY created_at DESC, id ASC LIMIT {P.LIST_CAP}")
    q["list_inventory_100"] = with_ledger(
        f"SELECT {INV_COLS} FROM inventory ORDER BY created_at DESC, id ASC LIMIT {P.LIST_CAP_OLD}")
    q["list_sales"] = with_ledger(
        f"SELECT {SALES_COLS} FROM sales WHERE date >= '{P.SALES_FROM}' AND date <= '{P.SALES_TO}' "
        f"ORDER BY date DESC, created_at DESC, id ASC LIMIT {P.LIST_CAP}")
    exp_where = f"date >= '{P.EXPENSES_FROM}'" + (f" AND date <= '{P.EXPENSES_TO}'" if P.EXPENSES_TO else "")
    q["list_expenses"] = with_ledger(
        f"SELECT {EXP_COLS} FROM expenses WHERE {exp_where} "
        f"ORDER BY date DESC, created_at DESC, id ASC LIMIT {P.LIST_CAP}")
    q["list_lots"] = with_ledger(
        f"SELECT id, title, note, status, created_at FROM lots "
        f"ORDER BY created_at DESC, id ASC LIMIT {P.LIST_CAP}")
    q["sales_in_range"] = with_ledger(
        f"SELECT {SALES_COLS} FROM sales WHERE date >= '{P.SALES_FROM}' AND date <= '{P.SALES_TO}'")
    q["expenses_in_range"] = with_ledger(f"SELECT {EXP_COLS} FROM expenses WHERE {exp_where}")
    q["lot_items"] = with_ledger(
        "SELECT i.id, i.sku, i.title, i.category, i.status, i.quantity, i.cost_cents, i.created_at "
        "FROM inventory_lots il JOIN inventory i ON i.id = il.inventory_id "
        f"WHERE il.lot_id = '{P.LOT_ID}' ORDER BY i.created_at DESC, i.id ASC LIMIT {P.LOT_ITEMS_CAP}")
    q["photos_for_item"] = with_ledger(
        "SELECT id, r2_key, content_type, size_bytes, created_at FROM photos "
        f"WHERE inventory_id = '{P.PHOTO_ITEM}' ORDER BY created_at DESC, id ASC")
    q["photo_by_id"] = with_ledger(
        f"SELECT id, r2_key, content_type FROM photos WHERE id = '{P.PHOTO_ID}' LIMIT 1")
    q["sales_fees_total"] = with_ledger(
        "SELECT id, CAST(platform_fees_cents + promo_fee_cents + shipping_label_cost_cents "
        "+ other_costs_cents AS BIGINT) AS fees_total_cents FROM sales")
    q["sku_match_ci"] = with_ledger("""
SELECT r.id, r.request_sku, m.inventory_id
FROM (SELECT id, sku,
             CASE WHEN qty % 2 = 0 THEN '  ' || lower(sku) || chr(9) ELSE sku END AS request_sku
      FROM sales) r
LEFT JOIN (
  SELECT lower(sku) AS k, min(id) AS inventory_id
  FROM (SELECT sku, id, created_at,
               max(created_at) OVER (PARTITION BY lower(sku)) AS newest FROM inventory)
  WHERE created_at = newest GROUP BY lower(sku)) m
ON lower(r.sku) = m.k""")
    q["sales_unified"] = with_ledger(f"""
SELECT {SALES_COLS} FROM sales
UNION ALL
SELECT id, sold_date AS date, inventory_id, sku, qty, sold_price_cents, buyer_shipping_cents,
       platform_fees_cents, promo_fee_cents, shipping_label_cost_cents, other_costs_cents,
       CAST(NULL AS VARCHAR) AS order_ref, CAST(NULL AS VARCHAR) AS note, created_at
FROM sales_legacy""")
    q["sales_profit"] = _profit(titled=False)
    q["sales_profit_titled"] = _profit(titled=True)
    q["usd_to_cents"] = with_ledger(
        f"SELECT event_id, {cents('value')} AS value_cents, {cents('-value')} AS neg_value_cents, "
        f"{cents('value / 3')} AS third_cents FROM events")
    q["mileage_amount"] = with_ledger(
        "SELECT id, type, CAST(CASE WHEN type = 'mileage' THEN miles * rate_cents_per_mile END "
        "AS BIGINT) AS mileage_cents FROM expenses")
    q["normalize_status"] = with_ledger("""
SELECT id, raw_status,
       CASE WHEN lower(raw_status) IN ('staged', 'draft', 'active', 'sold') THEN lower(raw_status)
            ELSE 'active' END AS status_norm
FROM (SELECT id, CASE cost_cents % 3 WHEN 0 THEN upper(status) WHEN 1 THEN status ELSE title END
             AS raw_status FROM inventory)""")
    q["sku_upper"] = with_ledger("""
SELECT id, upper(trim(raw_sku, ' ' || chr(9))) AS sku_norm,
       CASE WHEN category_in = '' THEN 'Misc' ELSE category_in END AS category_norm
FROM (SELECT id, ' ' || lower(sku) || chr(9) AS raw_sku,
             CASE WHEN quantity % 5 = 0 THEN '' ELSE category END AS category_in FROM inventory)""")
    q["photo_key_parts"] = with_ledger(
        "SELECT id, string_split(r2_key, '/')[2] AS key_item, string_split(r2_key, '/')[3] AS key_file "
        "FROM photos")
    manifest = f"""WITH m AS (
  SELECT page_id, page_id % 10 = 3 AS misfit, CAST(strlen(html) AS BIGINT) AS size_bytes,
         {made('page_id', '12')} AS created_at,
         'inventory/inv-' || (page_id % 50) || '/ph-' || page_id || '_page_' || page_id || '.HTML' AS r2_key
  FROM pages)"""
    q["photo_catalogue"] = f"""{manifest}
SELECT 'ph-' || page_id AS id, 'inv-' || (page_id % 50) AS inventory_id, r2_key, 'text/html' AS content_type,
       size_bytes, created_at FROM m WHERE NOT misfit"""
    q["photo_append"] = q["photo_catalogue"]
    q["photo_misfits"] = f"""{manifest}
SELECT 's3://photos/tmp/ph-' || page_id || '.html' AS path, 'bad_key' AS reason FROM m WHERE misfit"""
    q["photo_upload_names"] = """
SELECT p_partkey, lower(list_last(string_split(name, '.'))) AS ext, safe,
       'inventory/inv-' || p_partkey || '/ph-' || p_partkey || '_' || safe AS r2_key
FROM (SELECT p_partkey, name, regexp_replace(CASE WHEN name = '' THEN 'upload' ELSE name END,
                                             '[^a-zA-Z0-9._-]', '_', 'g') AS safe
      FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name || ' (' || p_size || ').' ||
                   CASE p_partkey % 3 WHEN 0 THEN 'JPG' WHEN 1 THEN 'png' ELSE 'tar.Gz' END END AS name FROM part))"""
    for key in ("list_sales", "list_expenses", "list_lots", "lot_items", "photos_for_item", "report_summary",
                "sales_profit", "sales_profit_titled"):
        q[f"stored_{key}"] = q[key]
    q["stored_report_rolled"] = q["report_summary"]
    q["normalize_text_eol"] = """
WITH m AS (
  SELECT doc_id,
         CASE WHEN doc_id % 3 = 0 THEN chr(65279) ELSE '' END ||
         CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END AS t
  FROM documents),
c AS (SELECT doc_id, regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '\\r$', '') AS t FROM m)
SELECT doc_id, CASE WHEN starts_with(t, chr(65279)) THEN substr(t, 2) ELSE t END AS text_clean FROM c"""
    return q


def all_oracles() -> dict[str, str]:
    from .oracle_changes import change_oracles
    out = base_oracles()
    out.update(change_oracles())
    return out
