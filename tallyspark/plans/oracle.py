"""The catalogue in DuckDB SQL, over the same star schema."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

Z = "America/New_York"


def _local(ts: str) -> str:
    return f"timezone('{Z}', timezone('UTC', {ts}))"


_CASE = "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'completed' ELSE 'canceled' END"
_CHANNEL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'in_store' WHEN '2-HIGH' THEN 'online' WHEN '3-MEDIUM' THEN 'event' ELSE 'other' END"
VIEWS = f"""o AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS placed_at, {_CASE} AS status, c_nationkey AS location_id, {_CHANNEL} AS channel,
  'reg' || (o_orderkey % 2) AS source, CAST(o_totalprice AS DECIMAL(14,4)) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
v AS (SELECT p_partkey AS variant_id, p_name AS name, 'SKU-' || p_partkey AS sku, p_brand AS product_id, p_type AS category_id, CAST(p_retailprice AS DECIMAL(14,4)) AS price,
  CASE WHEN p_partkey % 10 <> 0 THEN CAST(CAST(0.6 AS DOUBLE) * p_retailprice AS DECIMAL(14,4)) END AS cost FROM part),
l AS (SELECT l_orderkey AS order_id, CASE WHEN l_suppkey % 25 <> 0 THEN l_partkey END AS variant_id, CAST(l_quantity AS DECIMAL(14,4)) AS quantity, CAST(l_extendedprice AS DECIMAL(14,4)) AS gross,
  CAST(l_extendedprice * l_discount AS DECIMAL(14,4)) AS discount, CASE WHEN l_partkey % 10 <> 0 THEN CAST(CAST(0.6 AS DOUBLE) * p_retailprice AS DECIMAL(14,4)) END AS unit_cost,
  CAST(l_extendedprice * (1 - l_discount) * l_tax AS DECIMAL(14,4)) AS tax FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
r AS (SELECT l_orderkey AS order_id, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(14,4)) AS amount, l_shipdate AS occurred_at FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1),
lv AS (SELECT p_partkey AS variant_id, location_id, CAST((p_partkey * 37 + location_id * 11) % 53 - 2 AS DECIMAL(14,4)) AS on_hand FROM part, (VALUES (0), (1), (2)) AS t(location_id)),
sl AS (SELECT l.*, o.placed_at, o.location_id, o.channel, o.source, o.customer_id, v.product_id, v.category_id, v.price FROM l JOIN o USING (order_id) LEFT JOIN v USING (variant_id) WHERE status <> 'canceled'),
ro AS (SELECT r.*, o.location_id, o.channel, o.source FROM r JOIN o USING (order_id)),
pay AS (SELECT order_id, source, total AS amount, CASE customer_id % 3 WHEN 0 THEN 'card' WHEN 1 THEN 'cash' ELSE 'other' END AS tender, CAST(order_id % 5 AS DECIMAL(14,4)) AS tip, placed_at AS occurred_at FROM o WHERE status <> 'canceled'),
mv AS (SELECT event_id, user_id AS variant_id, user_id % 3 AS location_id, CASE event_type WHEN 'purchase' THEN 'sold' WHEN 'signup' THEN 'received' WHEN 'click' THEN 'returned' WHEN 'error' THEN 'damaged' ELSE 'adjusted' END AS kind,
  CAST(floor(value / 50) + 1 AS DECIMAL(14,4)) AS quantity, ts AS occurred_at FROM events),
sp AS (SELECT DISTINCT l_partkey AS variant_id, l_suppkey AS vendor_id FROM lineitem),
tm AS (SELECT variant_id, vendor_id, vendor_id = min(vendor_id) OVER (PARTITION BY variant_id) AS is_primary, CAST(7 + vendor_id % 21 AS INT) AS lead_time_days, CAST(1 + vendor_id % 6 AS DOUBLE) AS pack_size, CAST(vendor_id % 4 * 5 AS DOUBLE) AS min_order_qty FROM sp)"""

# periods as half-open UTC instants
DEC = ("2000-12-01 05:00:00", "2001-01-01 05:00:00")
Q4 = ("2000-10-01 04:00:00", "2001-01-01 05:00:00")
Y2000 = ("2000-01-01 05:00:00", "2001-01-01 05:00:00")
PREV = ("2000-10-31 05:00:00", "2000-12-01 05:00:00")
END = "2001-08-02 04:00:00"


def _in(c: str, p: tuple[str, str]) -> str:
    return f"{c} >= TIMESTAMP '{p[0]}' AND {c} < TIMESTAMP '{p[1]}'"


def _m(x: str) -> str:
    return f"CAST(round({x}, 2) AS DOUBLE)"


def _z(x: str) -> str:
    return f"coalesce({x}, 0)"


def _q(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([VIEWS, *ctes]) + "\n" + body


def _summary(p: tuple[str, str], where: str = "true", refunds: str = "true", extra: str = "") -> str:
    return f"""SELECT {extra}{_m('g')} AS gross_sales, {_m('d')} AS discounts, {_m('b')} AS refunds, {_m('g - d - b')} AS net_sales, CAST(u AS DOUBLE) AS units_sold, n AS orders,
  CASE WHEN n > 0 THEN round(CAST(g - d AS DOUBLE) / n, 2) END AS average_order_value, {_m('c')} AS custom_amounts
  FROM (SELECT {_z('sum(gross)')} AS g, {_z('sum(discount)')} AS d, {_z('sum(quantity)')} AS u, count(DISTINCT order_id) AS n, {_z('sum(gross - discount) FILTER (WHERE variant_id IS NULL)')} AS c FROM sl WHERE {_in('placed_at', p)} AND {where}),
       (SELECT {_z('sum(amount)')} AS b FROM ro WHERE {_in('occurred_at', p)} AND {refunds})"""


def _series(p: tuple[str, str], grain: str, days: tuple[str, str]) -> str:
    cut = lambda c: f"CAST(date_trunc('{grain}', {_local(c)}) AS DATE)"
    return _q(
        f"""SELECT c.bucket, {_m(_z('g'))} AS gross_sales, {_m(_z('d'))} AS discounts, {_m(_z('b'))} AS refunds, {_m(f"{_z('g')} - {_z('d')} - {_z('b')}")} AS net_sales, CAST({_z('u')} AS DOUBLE) AS units_sold, {_z('n')} AS orders
        FROM c LEFT JOIN s USING (bucket) LEFT JOIN b USING (bucket)""",
        f"c AS (SELECT DISTINCT CAST(date_trunc('{grain}', d) AS DATE) AS bucket FROM generate_series(DATE '{days[0]}', DATE '{days[1]}', INTERVAL 1 DAY) AS t(d))",
        f"s AS (SELECT {cut('placed_at')} AS bucket, sum(gross) AS g, sum(discount) AS d, sum(quantity) AS u, count(DISTINCT order_id) AS n FROM sl WHERE {_in('placed_at', p)} GROUP BY 1)",
        f"b AS (SELECT {cut('occurred_at')} AS bucket, sum(amount) AS b FROM ro WHERE {_in('occurred_at', p)} GROUP BY 1)",
    )


def _breakdown(column: str, refunds: bool, worst: bool = False) -> str:
    product = "variant_id IS NOT NULL" if column in ("product_id", "variant_id") else "true"
    back = f"SELECT CAST({column} AS VARCHAR) AS key, sum(amount) AS b FROM ro WHERE {_in('occurred_at', Q4)} GROUP BY 1" if refunds else "SELECT NULL::VARCHAR AS key, CAST(0 AS DECIMAL(24,4)) AS b WHERE false"
    return _q(
        f"""SELECT key, {_m('g')} AS gross_sales, {_m('d')} AS discounts, {_m('b')} AS refunds, {_m('g - d - b')} AS net_sales, CAST(u AS DOUBLE) AS units_sold, n AS orders, round(CAST(g - d - b AS DOUBLE) / CAST(whole AS DOUBLE), 4) AS share
        FROM x, (SELECT sum(g - d - b) AS whole FROM x) ORDER BY g - d {'ASC' if worst else 'DESC'}, key ASC NULLS LAST LIMIT 10""",
        f"s AS (SELECT CAST({column} AS VARCHAR) AS key, sum(gross) AS g, sum(discount) AS d, sum(quantity) AS u, count(DISTINCT order_id) AS n FROM sl WHERE {_in('placed_at', Q4)} AND {product} GROUP BY 1)",
        f"b AS ({back})", "x AS (SELECT s.*, coalesce(b, 0) AS b FROM s LEFT JOIN b ON s.key IS NOT DISTINCT FROM b.key)",
    )


_STOCK = (
    "h AS (SELECT variant_id, sku, price, category_id, cost, name, sum(on_hand) AS on_hand FROM lv JOIN v USING (variant_id) GROUP BY ALL)",
    f"w AS (SELECT variant_id, sum(quantity) AS sold FROM sl WHERE variant_id IS NOT NULL AND {_in('placed_at', ('2001-07-05 04:00:00', END))} GROUP BY 1)",
    f"ls AS (SELECT variant_id, max(placed_at) AS last_sale FROM sl WHERE variant_id IS NOT NULL AND placed_at < TIMESTAMP '{END}' GROUP BY 1)",
    f"""sr AS (SELECT h.*, coalesce(sold, 0) AS sold, round(CAST(coalesce(sold, 0) AS DOUBLE) / 28, 3) AS daily, CASE WHEN sold > 0 THEN round(CAST(on_hand AS DOUBLE) / (CAST(sold AS DOUBLE) / 28), 1) END AS cover,
      CAST({_local('last_sale')} AS DATE) AS last_day, last_sale FROM h LEFT JOIN w USING (variant_id) LEFT JOIN ls USING (variant_id))""",
)
_LISTED = "SELECT variant_id, sku, CAST(on_hand AS DOUBLE) AS on_hand, CAST(sold AS DOUBLE) AS units_sold, daily, cover, last_day FROM sr"
_PAIRED = (
    f"k AS (SELECT DISTINCT order_id, variant_id FROM sl WHERE variant_id IS NOT NULL AND {_in('placed_at', ('2000-08-02 04:00:00', END))})",
    f"u AS (SELECT variant_id, sum(quantity) AS units FROM sl WHERE variant_id IS NOT NULL AND {_in('placed_at', ('2001-07-02 04:00:00', END))} GROUP BY 1)",
)
_STALE = (
    "h AS (SELECT variant_id, sku, category_id, price, cost, sum(on_hand) AS on_hand FROM lv JOIN v USING (variant_id) GROUP BY ALL HAVING sum(on_hand) > 0)",
    f"""x AS (SELECT variant_id, max(placed_at) AS last_sale, coalesce(sum(quantity) FILTER (WHERE placed_at >= TIMESTAMP '2001-07-03 04:00:00'), 0) AS recent, coalesce(sum(quantity) FILTER (WHERE placed_at >= TIMESTAMP '2001-05-04 04:00:00'), 0) AS trailed
      FROM sl WHERE variant_id IS NOT NULL AND placed_at < TIMESTAMP '{END}' GROUP BY 1)""",
    f"""y AS (SELECT h.*, DATE '2001-08-01' - CAST({_local('last_sale')} AS DATE) AS days_since, round_even(CAST(coalesce(recent, 0) AS DOUBLE) / 30, 4) AS recent_daily, round_even(CAST(coalesce(trailed, 0) AS DOUBLE) / 90, 4) AS trailing_daily,
      CAST(on_hand * coalesce(cost, price) AS DECIMAL(24,4)) AS cash FROM h LEFT JOIN x USING (variant_id))""",
    """st AS (SELECT * FROM (SELECT *, CASE WHEN days_since IS NULL OR days_since >= 120 THEN 'dead' WHEN days_since >= 60 THEN 'stale' WHEN trailing_daily > 0 AND recent_daily < trailing_daily * CAST(0.5 AS DOUBLE) THEN 'slowing' END AS kind FROM y) WHERE kind IS NOT NULL)""",
)
_OBS = lambda p: (
    f"os AS (SELECT CAST({_local('placed_at')} AS DATE) AS day, location_id, sum(gross - discount) AS net, sum(discount) AS disc, count(DISTINCT order_id) AS orders, sum(quantity) AS units, bool_or(channel = 'event') AS is_event FROM sl WHERE {_in('placed_at', p)} GROUP BY 1, 2)",
    f"ob AS (SELECT CAST({_local('occurred_at')} AS DATE) AS day, location_id, sum(amount) AS b FROM ro WHERE {_in('occurred_at', p)} GROUP BY 1, 2)",
    f"obs AS (SELECT os.day, os.location_id, {_m('net')} AS net_sales, {_m('disc')} AS discounts, orders, CAST(units AS DOUBLE) AS units, {_m(_z('b'))} AS refunds, is_event FROM os LEFT JOIN ob ON os.day = ob.day AND os.location_id IS NOT DISTINCT FROM ob.location_id)",
)


def _shares(p: tuple[str, str], name: str) -> str:
    return f"""{name} AS (SELECT s.location_id, {_m('net')} AS net_sales, {_m(_z('b'))} AS refunds, {_m('disc')} AS discounts, CASE WHEN net <> 0 THEN round(CAST({_z('b')} AS DOUBLE) / CAST(net AS DOUBLE), 4) END AS refund_share, CASE WHEN net <> 0 THEN round(CAST(disc AS DOUBLE) / CAST(net AS DOUBLE), 4) END AS discount_share
      FROM (SELECT location_id, sum(gross - discount) AS net, sum(discount) AS disc FROM sl WHERE {_in('placed_at', p)} GROUP BY 1) s LEFT JOIN (SELECT location_id, sum(amount) AS b FROM ro WHERE {_in('occurred_at', p)} GROUP BY 1) b ON s.location_id IS NOT DISTINCT FROM b.location_id)"""


_PO = ("po AS (SELECT t.variant_id, t.vendor_id, CASE t.variant_id % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'sent' WHEN 2 THEN 'received' ELSE 'canceled' END AS status, CAST(t.variant_id % 30 + 1 AS DOUBLE) AS quantity, 'PO-2001-07-' || lpad(CAST(t.vendor_id AS VARCHAR), 4, '0') AS reference, CAST(t.variant_id % 5 AS DOUBLE) AS on_hand_at_draft, CAST(v.price AS DOUBLE) AS price FROM tm t JOIN v USING (variant_id) WHERE is_primary)",
       "pl AS (SELECT *, CASE status WHEN 'received' THEN quantity WHEN 'sent' THEN floor(quantity / 2) ELSE 0 END AS received FROM po)")
_VS = lambda p, name: f"{name} AS (SELECT variant_id, CAST(sum(quantity) AS DOUBLE) AS units_sold, {_m('sum(gross) - sum(discount)')} AS net_sales, count(DISTINCT order_id) AS orders FROM sl WHERE variant_id IS NOT NULL AND {_in('placed_at', p)} GROUP BY 1)"
_INSIGHTS = """i AS (SELECT 'k' || event_id AS dedupe_key, event_type AS kind, CASE WHEN event_id % 7 = 0 THEN 'urgent' WHEN event_id % 3 = 0 THEN 'warn' ELSE 'info' END AS severity, CASE WHEN event_id % 5 <> 0 THEN round(value, 2) END AS dollar_impact,
  CASE WHEN event_id % 6 = 0 THEN 'acted' WHEN event_id % 11 = 0 THEN 'dismissed' ELSE 'new' END AS status, ts AS created_at, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 20 DAY END AS expires_at, CASE WHEN event_id % 13 = 0 THEN TIMESTAMP '2024-02-10' END AS snoozed_until, CASE WHEN event_id % 9 = 0 THEN event_id % 2 END AS rating FROM events)"""
_SHEET = r"""sh AS (SELECT event_id AS row, CASE WHEN event_id % 17 <> 0 THEN '  R' || (event_id % 400) || CASE WHEN event_id % 2 = 0 THEN ' a ' ELSE ' A' END END AS receipt,
  CASE WHEN event_id % 4 IN (0, 1, 2) THEN CAST(ts AS DATE) END AS day, CASE WHEN event_id % 9 <> 0 THEN event_type ELSE ' ' END AS category, CASE WHEN event_id % 3 = 0 THEN 'Last' || event_id || ', First  X' WHEN event_id % 3 = 1 THEN 'First Last' || event_id ELSE 'Single' END AS who,
  CASE WHEN event_id % 3 = 0 THEN round(value, 2) WHEN event_id % 3 = 1 THEN -round(value, 2) WHEN event_id % 5 = 0 THEN NULL ELSE round(value, 2) END AS amount, CAST(event_id % 4 + 1 AS DECIMAL(14,4)) AS quantity, CAST(round(value, 2) AS DECIMAL(14,4)) AS price FROM events),
sk AS (SELECT *, lower(trim(regexp_replace(receipt, '\s+', ' ', 'g'))) AS folded FROM sh),
sg AS (SELECT *, coalesce(folded, 'Sales:' || row) AS group_key FROM sk)"""

ORACLE: dict[str, str] = {
    "sales_summary": _q(_summary(DEC)),
    "sales_summary_filtered": _q(_summary(Q4, "channel IN ('online', 'event') AND source = 'reg1'", "channel IN ('online', 'event') AND source = 'reg1'")),
    "sales_summary_category": _q(_summary(Q4, "category_id = 'PROMO' AND variant_id IS NOT NULL", "false")),
    "sales_series_day": _series(DEC, "day", ("2000-12-01", "2000-12-31")),
    "sales_series_week": _series(Q4, "week", ("2000-10-01", "2000-12-31")),
    "sales_series_month": _series(Y2000, "month", ("2000-01-01", "2000-12-31")),
    "breakdown_product": _breakdown("product_id", False), "breakdown_variant": _breakdown("variant_id", False), "breakdown_category": _breakdown("category_id", False),
    "breakdown_channel": _breakdown("channel", True), "breakdown_location": _breakdown("location_id", True), "breakdown_source": _breakdown("source", True), "worst_sellers": _breakdown("product_id", False, True),
    "sales_filtered_category_tree": _q(f"SELECT location_id, {_m('sum(gross)')} AS gross_sales, count(DISTINCT order_id) AS orders FROM sl WHERE {_in('placed_at', DEC)} AND location_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1 OR n_nationkey = 3) GROUP BY 1"),
    "sales_previous_period": _q(_summary(DEC, extra="'current' AS period, ") + " UNION ALL " + _summary(PREV, extra="'previous' AS period, ")),
    "data_window": _q(f"SELECT CAST({_local('min(placed_at)')} AS DATE) AS first_day, CAST({_local('max(placed_at)')} AS DATE) AS last_day FROM o WHERE status <> 'canceled'"),
    "channel_counts": _q("SELECT channel, count(*) AS orders FROM o WHERE status <> 'canceled' GROUP BY 1"),
    "margin_report": _q(f"""SELECT {_m('net')} AS net_sales, {_m('cov')} AS covered_sales, {_m('cogs')} AS cogs, {_m('cov - cogs')} AS gross_profit, round(CAST(cov - cogs AS DOUBLE) / CAST(cov AS DOUBLE), 4) AS margin, round(CAST(cov AS DOUBLE) / CAST(net AS DOUBLE), 4) AS cost_coverage
      FROM (SELECT sum(gross - discount) AS net, sum(gross - discount) FILTER (WHERE unit_cost IS NOT NULL) AS cov, sum(quantity * unit_cost) AS cogs FROM sl WHERE {_in('placed_at', Q4)})"""),
    "customer_stats": _q(f"""SELECT b AS buyers, t AS returning, b - t AS new, round(CAST(t AS DOUBLE) / b, 4) AS repeat_rate, round(CAST(i AS DOUBLE) / n, 4) AS identified_share FROM
      (SELECT count(*) AS n, count(customer_id) AS i, count(DISTINCT customer_id) AS b, count(DISTINCT customer_id) FILTER (WHERE customer_id IN (SELECT customer_id FROM o WHERE status <> 'canceled' AND placed_at < TIMESTAMP '{Q4[0]}')) AS t FROM o WHERE status <> 'canceled' AND {_in('placed_at', Q4)})"""),
    "returning_customers_semi": _q(f"SELECT DISTINCT customer_id FROM o WHERE status <> 'canceled' AND {_in('placed_at', DEC)} AND customer_id IN (SELECT customer_id FROM o WHERE status <> 'canceled' AND placed_at < TIMESTAMP '{DEC[0]}')"),
    "variant_sales": _q("SELECT * FROM vs", _VS(DEC, "vs")),
    "inventory_value": _q(f"""SELECT n AS variants, CAST(u AS DOUBLE) AS units, {_m('r')} AS retail_value, {_m('c')} AS cost_value, round(CAST(k AS DOUBLE) / CAST(u AS DOUBLE), 4) AS cost_coverage, CAST(0 AS DOUBLE) AS unpriced_units FROM
      (SELECT count(DISTINCT variant_id) AS n, sum(on_hand) AS u, sum(on_hand * price) AS r, sum(on_hand * cost) AS c, sum(on_hand) FILTER (WHERE cost IS NOT NULL) AS k FROM lv JOIN v USING (variant_id) WHERE on_hand > 0)"""),
    "sell_through": _q("""SELECT variant_id, CAST(coalesce(sold, 0) AS DOUBLE) AS units_sold, CAST(coalesce(held, 0) AS DOUBLE) AS on_hand, round(CAST(coalesce(sold, 0) AS DOUBLE) / nullif(CAST(coalesce(sold, 0) + coalesce(held, 0) AS DOUBLE), 0), 4) AS sell_through
      FROM s FULL JOIN h USING (variant_id) WHERE sold > 0 OR held > 0 ORDER BY coalesce(sold, 0) DESC, variant_id LIMIT 20""", f"s AS (SELECT variant_id, sum(quantity) AS sold FROM sl WHERE variant_id IS NOT NULL AND {_in('placed_at', Q4)} GROUP BY 1)", "h AS (SELECT variant_id, sum(on_hand) AS held FROM lv GROUP BY 1)"),
    "days_of_cover": _q(f"{_LISTED} WHERE sold > 0 AND on_hand > 0 ORDER BY cover, variant_id LIMIT 25", *_STOCK),
    "low_stock": _q(f"{_LISTED} WHERE sold > 0 AND (on_hand <= 3 OR cover < 14) ORDER BY cover NULLS LAST, variant_id LIMIT 50", *_STOCK),
    "dead_stock": _q(f"SELECT variant_id, sku, CAST(on_hand AS DOUBLE) AS on_hand, {_m('CAST(on_hand * price AS DECIMAL(24,4))')} AS retail_value, last_day FROM sr WHERE on_hand > 0 AND (last_day IS NULL OR last_day < DATE '2001-05-03') ORDER BY on_hand * price DESC NULLS LAST, variant_id LIMIT 50", *_STOCK),
    "negative_stock": _q("SELECT variant_id, CAST(sum(on_hand - 30) AS DOUBLE) AS on_hand FROM lv GROUP BY 1 HAVING sum(on_hand - 30) < 0 ORDER BY 2, 1 LIMIT 50"),
    "inventory_snapshot": _q(f"SELECT count(*) AS shelves, CAST(sum(on_hand) AS DOUBLE) AS units, {_m('sum(on_hand * cost)')} AS cost_value, round(CAST(count(cost) AS DOUBLE) / count(*), 4) AS cost_coverage FROM lv JOIN v USING (variant_id) WHERE on_hand > 0"),
    "inventory_at": _q(f"SELECT CAST(sum(held) AS DOUBLE) AS units, {_m('sum(held * cost)')} AS cost_value, coalesce(bool_or(unclear), false) AS approximate FROM (SELECT lv.variant_id, cost, CAST(greatest(on_hand - coalesce(since, 0), 0) AS DECIMAL(20,4)) AS held, unclear FROM lv JOIN v USING (variant_id) LEFT JOIN m ON lv.variant_id = m.variant_id AND lv.location_id = m.location_id)",
      "m AS (SELECT variant_id, location_id, sum(quantity * CASE WHEN kind IN ('received', 'returned') THEN 1 WHEN kind IN ('sold', 'damaged') THEN -1 ELSE 0 END) AS since, bool_or(kind = 'adjusted') AS unclear FROM mv WHERE occurred_at >= TIMESTAMP '2024-01-16 05:00:00' GROUP BY 1, 2)"),
    "catalog_page": _q(f"""SELECT v.variant_id, name, sku, CAST(price AS DOUBLE) AS price, round(CAST(price - cost AS DOUBLE) / CAST(price AS DOUBLE), 4) AS margin, CAST(on_hand AS DOUBLE) AS on_hand, stock, CAST({_local('last_sale')} AS DATE) AS last_day FROM v LEFT JOIN k USING (variant_id) LEFT JOIN ls USING (variant_id) ORDER BY price DESC NULLS LAST, name, variant_id LIMIT 50""",
      "k AS (SELECT variant_id, sum(on_hand) AS on_hand, string_agg(location_id || '=' || CAST(on_hand AS INT), ';' ORDER BY location_id) AS stock FROM lv GROUP BY 1)", _STOCK[2]),
    "catalog_search": _q(f"""SELECT v.variant_id, name, sku, CAST(price AS DOUBLE) AS price, round(CAST(price - cost AS DOUBLE) / CAST(price AS DOUBLE), 4) AS margin, CAST(on_hand AS DOUBLE) AS on_hand, stock, CAST({_local('last_sale')} AS DATE) AS last_day FROM v LEFT JOIN k USING (variant_id) LEFT JOIN ls USING (variant_id) WHERE sku ILIKE '%sku-1%' ORDER BY sku, name, variant_id LIMIT 30 OFFSET 10""",
      "k AS (SELECT variant_id, sum(on_hand) AS on_hand, string_agg(location_id || '=' || CAST(on_hand AS INT), ';' ORDER BY location_id) AS stock FROM lv GROUP BY 1)", _STOCK[2]),
    "keyset_page": _q("SELECT order_id, status FROM o WHERE (placed_at, order_id) > (TIMESTAMP '1998-01-01', 100) ORDER BY placed_at, order_id LIMIT 21"),
    "weekly_units": _q("SELECT variant_id, location_id, " + ", ".join(f"CAST(coalesce(sum(quantity) FILTER (WHERE week = {i}), 0) AS DOUBLE) AS w{i}" for i in range(4)) + f" FROM (SELECT *, CAST(floor((epoch(TIMESTAMP '{END}') - epoch(placed_at)) / 604800) AS INT) AS week FROM sl WHERE variant_id IS NOT NULL AND {_in('placed_at', ('2001-07-05 04:00:00', END))}) GROUP BY 1, 2"),
    "vendor_terms_primary": _q("SELECT variant_id, vendor_id, lead_time_days, pack_size, min_order_qty FROM tm WHERE is_primary"),
    "outstanding_quantities": _q("SELECT variant_id, sum(quantity - received) AS on_order FROM pl WHERE status IN ('draft', 'sent') GROUP BY 1", *_PO),
    "purchase_orders": _q("SELECT reference, s_name AS vendor, count(*) AS n_lines, sum(quantity) AS units, round(sum(quantity * price), 2) AS value, count(*) FILTER (WHERE price IS NULL) AS unpriced, string_agg(variant_id || ':' || status || ':' || CAST(quantity AS INT), ';' ORDER BY variant_id) AS lines FROM pl LEFT JOIN supplier ON vendor_id = s_suppkey WHERE status <> 'canceled' GROUP BY 1, 2", *_PO),
    "reorder_outcome": _q("SELECT reference, round(sum(s), 2) AS units_saved, round(sum(s * price), 2) AS sales_saved FROM (SELECT *, greatest(least(coalesce(units_sold, 0), received) - on_hand_at_draft, 0) AS s FROM pl LEFT JOIN vs USING (variant_id) WHERE status = 'received') GROUP BY 1", *_PO, _VS(Q4, "vs")),
    "stale_inventory": _q(f"SELECT variant_id, kind, CAST(on_hand AS DOUBLE) AS on_hand, days_since, recent_daily, trailing_daily, {_m('cash')} AS cash FROM st ORDER BY st.cash DESC NULLS LAST, variant_id LIMIT 500", *_STALE),
    "co_purchases": _q("SELECT target_id, partner_id, baskets, CAST(units AS DOUBLE) AS units FROM (SELECT a.variant_id AS target_id, b.variant_id AS partner_id, count(*) AS baskets, any_value(units) AS units, row_number() OVER (PARTITION BY a.variant_id ORDER BY count(*) DESC, any_value(units) DESC, b.variant_id) AS n FROM k a JOIN k b ON a.order_id = b.order_id AND a.variant_id <> b.variant_id JOIN u ON u.variant_id = b.variant_id GROUP BY 1, 2) WHERE n <= 3",
      *_PAIRED),
    "category_by_location": _q(f"SELECT category_id, location_id, CAST(u AS DOUBLE) AS units, round(CAST(u AS DOUBLE) / CAST(sum(u) OVER (PARTITION BY category_id) AS DOUBLE), 4) AS share FROM (SELECT category_id, location_id, sum(quantity) AS u FROM sl WHERE variant_id IS NOT NULL AND {_in('placed_at', ('2001-05-04 04:00:00', END))} GROUP BY 1, 2)"),
    "markdown_ladder": _q("SELECT variant_id, CAST(d AS DOUBLE) AS discount, CAST(p AS DOUBLE) AS price, CAST(round(p - cost, 2) AS DOUBLE) AS margin, coalesce(p >= cost, true) AS clears_cost FROM (SELECT variant_id, cost, d, round(price * (1 - d), 2) AS p FROM st, (VALUES (0.15), (0.30), (0.50)) AS t(d))", *_STALE),
    "rescue_choice": _q("""SELECT variant_id, kind, play, CAST(CASE play WHEN 'bundle' THEN round(round((price + partner_price) * 0.9, 0) - 0.01, 2) WHEN 'markdown' THEN round(price * 0.85, 2) END AS DOUBLE) AS new_price, CASE WHEN play = 'bundle' THEN partner_id END AS partner_id, CASE WHEN play = 'move' THEN location_id END AS move_to
      FROM (SELECT st.variant_id, st.kind, st.price, st.cash, b.partner_id, b.partner_price, g.location_id, CASE WHEN st.kind = 'dead' AND coalesce(t.vendor_id % 7 = 0, false) THEN 'return_to_vendor' WHEN b.partner_id IS NOT NULL THEN 'bundle' WHEN g.location_id IS NOT NULL THEN 'move' ELSE 'markdown' END AS play
        FROM st LEFT JOIN (SELECT variant_id, vendor_id FROM tm WHERE is_primary) t ON t.variant_id = st.variant_id LEFT JOIN (SELECT bp.*, v.price AS partner_price FROM bp LEFT JOIN v ON v.variant_id = bp.partner_id WHERE n = 1 AND baskets >= 3) b ON b.target_id = st.variant_id LEFT JOIN go g ON g.variant_id = st.variant_id AND g.n = 1)
      ORDER BY cash DESC NULLS LAST, variant_id LIMIT 200""", *_STALE, *_PAIRED,
      "bp AS (SELECT a.variant_id AS target_id, b.variant_id AS partner_id, count(*) AS baskets, row_number() OVER (PARTITION BY a.variant_id ORDER BY count(*) DESC, any_value(units) DESC, b.variant_id) AS n FROM k a JOIN k b ON a.order_id = b.order_id AND a.variant_id <> b.variant_id JOIN u ON u.variant_id = b.variant_id WHERE a.variant_id IN (SELECT variant_id FROM st) GROUP BY 1, 2)",
      f"cl AS (SELECT category_id, location_id, round(CAST(u AS DOUBLE) / CAST(sum(u) OVER (PARTITION BY category_id) AS DOUBLE), 4) AS share FROM (SELECT category_id, location_id, sum(quantity) AS u FROM sl WHERE variant_id IS NOT NULL AND {_in('placed_at', ('2001-05-04 04:00:00', END))} GROUP BY 1, 2))",
      "si AS (SELECT variant_id, location_id AS sits_at FROM (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY on_hand DESC, location_id) AS n FROM lv) WHERE n = 1)",
      "go AS (SELECT st.variant_id, cl.location_id, row_number() OVER (PARTITION BY st.variant_id ORDER BY share DESC, cl.location_id) AS n FROM st JOIN si USING (variant_id) JOIN cl ON cl.category_id = st.category_id AND cl.location_id <> sits_at WHERE share >= 0.25)"),
    "rescue_outcome": _q("SELECT v.variant_id, 'markdown' AS kind, coalesce(b.units_sold, 0) AS units_before, coalesce(a.units_sold, 0) AS units_after, round(least(coalesce(a.units_sold, 0), CAST(v.variant_id % 20 AS DOUBLE)) * CAST(cost AS DOUBLE), 2) AS recovered FROM v LEFT JOIN b USING (variant_id) LEFT JOIN a USING (variant_id) WHERE v.variant_id % 9 = 0", _VS(("2001-06-01 04:00:00", "2001-07-01 04:00:00"), "b"), _VS(("2001-07-01 04:00:00", "2001-07-31 04:00:00"), "a")),
    "financial_summary": _q(f"SELECT {_m('t')} AS tax, {_m('p')} AS tips, {_m('a')} AS payments_amount, n AS payments FROM (SELECT sum(tax) AS t FROM sl WHERE {_in('placed_at', DEC)}), (SELECT sum(amount) AS a, sum(tip) AS p, count(*) AS n FROM pay WHERE {_in('occurred_at', DEC)})"),
    "tender_split": _q(f"SELECT tender, {_m('sum(amount)')} AS amount, {_m('sum(tip)')} AS tips, count(*) AS payments FROM pay WHERE {_in('occurred_at', DEC)} GROUP BY 1"),
    "reconciliation_net": _q(f"SELECT round(gross_sales - discounts - refunds - net_sales, 2) AS gap, abs(round(gross_sales - discounts - refunds - net_sales, 2)) <= 0.01 AS ok FROM ({_summary(DEC)})"),
    "reconciliation_takings": _q(f"SELECT {_m('a + p')} AS taken, {_m('n + t + p')} AS expected, {_m('a - n - t')} AS gap, abs(a - n - t) <= 5 AS ok FROM (SELECT sum(gross - discount) AS n, sum(tax) AS t FROM sl WHERE {_in('placed_at', DEC)}), (SELECT sum(amount) AS a, sum(tip) AS p FROM pay WHERE {_in('occurred_at', DEC)})"),
    "digest_comparison": _q(_summary(("2001-07-23 04:00:00", "2001-07-30 04:00:00"), extra="'current' AS period, ") + " UNION ALL " + _summary(("2001-07-16 04:00:00", "2001-07-23 04:00:00"), extra="'previous' AS period, ") + " UNION ALL " + _summary(("2000-07-24 04:00:00", "2000-07-31 04:00:00"), extra="'year_before' AS period, ")),
    "daily_observations": _q("SELECT * FROM obs", *_OBS(Q4)),
    "sync_gap_p90": _q("""SELECT round((epoch(TIMESTAMP '2001-08-03') - epoch(l)) / 3600, 1) AS hours_since, round(t, 1) AS typical_gap_hours, (epoch(TIMESTAMP '2001-08-03') - epoch(l)) / 3600 > greatest(t * 3, 30) AS stale FROM
      (SELECT max(placed_at) AS l, quantile_cont(h, 0.9) AS t FROM (SELECT placed_at, (epoch(placed_at) - epoch(lag(placed_at) OVER (ORDER BY placed_at, order_id))) / 3600 AS h FROM (SELECT placed_at, order_id FROM o WHERE status <> 'canceled' ORDER BY placed_at DESC, order_id DESC LIMIT 400)))"""),
    "shrink": _q("""SELECT variant_id, round(missing, 2) AS missing, explained, value FROM (SELECT m.variant_id, CAST(moved AS DOUBLE) - coalesce(CAST(u AS DOUBLE), 0) AS missing, CAST(explained AS DOUBLE) AS explained, round((CAST(moved AS DOUBLE) - coalesce(CAST(u AS DOUBLE), 0)) * CAST(coalesce(cost, price) AS DOUBLE), 2) AS value FROM m LEFT JOIN g USING (variant_id) LEFT JOIN v USING (variant_id)) WHERE missing > 0 AND (value >= 40 OR missing >= 5)""",
      f"m AS (SELECT variant_id, coalesce(sum(quantity) FILTER (WHERE kind = 'sold'), 0) AS moved, coalesce(sum(quantity) FILTER (WHERE kind = 'damaged'), 0) AS explained FROM mv WHERE {_in('occurred_at', ('2024-01-17 05:00:00', '2024-01-31 05:00:00'))} GROUP BY 1)", f"g AS (SELECT variant_id, sum(quantity) AS u FROM sl WHERE variant_id IS NOT NULL AND {_in('placed_at', ('2001-07-19 04:00:00', END))} GROUP BY 1)"),
    "refund_shares": _q("SELECT * FROM rs", _shares(Q4, "rs")),
    "heatmap": _q("""SELECT location_id, weekday, hour, sum(n)::BIGINT AS orders, CAST(round(sum(net), 2) AS DOUBLE) AS net_sales, count(DISTINCT day) AS observations, round(CAST(sum(n) AS DOUBLE) / count(DISTINCT day), 2) AS orders_per_observation, round(CAST(sum(n) AS DOUBLE) / 8, 2) AS orders_per_week FROM c WHERE NOT event GROUP BY 1, 2, 3""",
      f"c AS (SELECT location_id, CAST({_local('placed_at')} AS DATE) AS day, isodow({_local('placed_at')}) - 1 AS weekday, hour({_local('placed_at')}) AS hour, count(DISTINCT order_id) AS n, sum(gross - discount) AS net, bool_or(channel = 'event') AS event FROM sl WHERE {_in('placed_at', ('2001-06-07 04:00:00', END))} GROUP BY ALL)"),
    "busiest_hours": _q("""SELECT location_id, weekday, hour, sum(n)::BIGINT AS orders, CAST(round(sum(net), 2) AS DOUBLE) AS net_sales, count(DISTINCT day) AS observations, round(CAST(sum(n) AS DOUBLE) / count(DISTINCT day), 2) AS orders_per_observation, round(CAST(sum(n) AS DOUBLE) / 8, 2) AS orders_per_week FROM c WHERE NOT event GROUP BY 1, 2, 3 ORDER BY 7 DESC, 4 DESC, 1, 2, 3 LIMIT 8""",
      f"c AS (SELECT location_id, CAST({_local('placed_at')} AS DATE) AS day, isodow({_local('placed_at')}) - 1 AS weekday, hour({_local('placed_at')}) AS hour, count(DISTINCT order_id) AS n, sum(gross - discount) AS net, bool_or(channel = 'event') AS event FROM sl WHERE {_in('placed_at', ('2001-06-07 04:00:00', END))} GROUP BY ALL)"),
    "dq_reconciliation": _q("SELECT abs(g) > 0.01 AS drifts, count(*) AS orders, round(sum(CAST(round(g, 2) AS DOUBLE)), 2) AS gap FROM (SELECT o.order_id, total - coalesce(t, 0) AS g FROM o LEFT JOIN (SELECT order_id, sum(gross - discount + tax) AS t FROM l GROUP BY 1) x USING (order_id)) GROUP BY 1"),
    "upsert_last_wins": "SELECT o_orderkey AS id, o_totalprice + CASE WHEN o_orderkey % 10 >= 7 THEN 2 ELSE 0 END AS total, CASE WHEN o_orderkey % 10 >= 7 THEN 'second' ELSE o_orderpriority END AS note FROM orders",
    "sweep_anti_join": "SELECT o_orderkey % 6 = 0 AS deleted, count(*) AS n, min(o_orderkey) AS first_id FROM orders GROUP BY 1",
    "watermark_max": "SELECT max(ts) AS watermark FROM events WHERE ts >= TIMESTAMP '2024-01-10'",
    "raw_latest": "SELECT o_orderkey % 500 AS external_id, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey % 500 ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "map_trim_fold": f"WITH {_SHEET} SELECT row, trim(regexp_replace(receipt, '\\s+', ' ', 'g')) AS trimmed, folded, upper(folded) AS uppered FROM sk",
    "map_parse_money": f"WITH {_SHEET} SELECT row, amount, false AS bad FROM sk",
    "map_parse_date": f"WITH {_SHEET} SELECT row, day FROM sk",
    "map_hash_id": f"WITH {_SHEET} SELECT row, 'r-' || substr(sha1(folded), 1, 16) AS id FROM sk",
    "map_split_name": f"WITH {_SHEET} SELECT row, CASE WHEN who = 'Single' THEN 'Single' WHEN who LIKE '%,%' THEN 'First X' ELSE 'First' END AS first_name, CASE WHEN who LIKE '%,%' THEN split_part(who, ',', 1) WHEN who <> 'Single' THEN split_part(who, ' ', 2) END AS last_name FROM sk",
    "map_at_time": f"WITH {_SHEET} SELECT row, timezone('UTC', timezone('{Z}', CAST(day AS TIMESTAMP) + INTERVAL '18:30' HOUR_MINUTE)) AS at FROM sk".replace("INTERVAL '18:30' HOUR_MINUTE", "INTERVAL 1110 MINUTE"),
    "map_modal_row": f"""WITH {_SHEET}, c AS (SELECT group_key, category, row_number() OVER (PARTITION BY group_key ORDER BY count(*) DESC, min(row)) AS n FROM sg WHERE trim(category) <> '' GROUP BY 1, 2), w AS (SELECT group_key, who, row_number() OVER (PARTITION BY group_key ORDER BY count(*) DESC, min(row)) AS n FROM sg GROUP BY 1, 2)
      SELECT g.group_key, category, who FROM (SELECT DISTINCT group_key FROM sg) g LEFT JOIN (SELECT * FROM c WHERE n = 1) c USING (group_key) LEFT JOIN (SELECT * FROM w WHERE n = 1) w USING (group_key)""",
    "map_lookup": f"WITH {_SHEET}, t AS (SELECT folded, arg_min(category, row) AS found FROM sk WHERE row % 5 = 0 AND folded IS NOT NULL GROUP BY 1) SELECT row, found FROM sk LEFT JOIN t USING (folded)",
    "map_orders_from_lines": f"WITH {_SHEET} SELECT group_key, {_m('sum(CAST(quantity * price AS DECIMAL(24,4)))')} AS subtotal, 0.5 * count(*)::DOUBLE AS discount, CAST(round(sum(CAST(quantity * price AS DECIMAL(24,4))) - 0.5 * count(*), 2) AS DOUBLE) AS total, count(*) AS n_lines, string_agg(group_key || ':' || n, ',' ORDER BY n) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY row) - 1 AS n FROM sg) GROUP BY 1",
    "vector_topk": "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) AS score FROM embeddings, q WHERE vec_id <> 7 ORDER BY 2 DESC, 1 LIMIT 10",
    "ingest_diff": "SELECT action, count(*) AS n FROM (SELECT CASE doc_id % 10 WHEN 1 THEN 'new' WHEN 2 THEN 'changed' WHEN 3 THEN 'orphan' ELSE 'unchanged' END AS action FROM documents) GROUP BY 1",
    "insights_ranked": f"WITH {_INSIGHTS} SELECT dedupe_key, kind, severity, dollar_impact FROM i WHERE status = 'new' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-30') AND (snoozed_until IS NULL OR snoozed_until <= TIMESTAMP '2024-01-30') ORDER BY CASE severity WHEN 'urgent' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, dollar_impact DESC NULLS LAST, created_at DESC, dedupe_key LIMIT 50",
    "insights_expired": f"WITH {_INSIGHTS} SELECT CASE WHEN status = 'new' AND expires_at < TIMESTAMP '2024-01-30' THEN 'expired' ELSE status END AS status, count(*) AS n FROM i GROUP BY 1",
    "value_ledger": f"WITH {_INSIGHTS} SELECT count(*) AS created, count(*) FILTER (WHERE status = 'acted') AS acted, round(coalesce(sum(a), 0), 2) AS attributed, round(coalesce(sum(a) FILTER (WHERE a > 0), 0), 2) AS recovered, round(coalesce(sum(dollar_impact), 0), 2) AS flagged FROM (SELECT *, CASE WHEN status = 'acted' THEN dollar_impact / 2 END AS a FROM i WHERE created_at >= TIMESTAMP '2024-01-08' AND created_at < TIMESTAMP '2024-01-22')",
    "detector_precision": f"WITH {_INSIGHTS} SELECT kind, count(*) AS raised, count(rating) AS rated, count(*) FILTER (WHERE rating > 0) AS useful, CASE WHEN count(rating) > 0 THEN round(CAST(count(*) FILTER (WHERE rating > 0) AS DOUBLE) / count(rating), 4) END AS precision FROM i GROUP BY 1",
    "stockout_days": _q(f"""SELECT variant_id, location_id, least(count(DISTINCT day), 27) AS stockout_days FROM (SELECT m.*, on_hand - coalesce(since, 0) AS held FROM m JOIN lv USING (variant_id, location_id) WHERE coalesce(unclear, 0) = 0) WHERE held <= 0 GROUP BY 1, 2""",
      f"""m AS (SELECT variant_id, location_id, CAST({_local('occurred_at')} AS DATE) AS day, sum(quantity * s) OVER w AS since, max(CASE WHEN s = 0 THEN 1 ELSE 0 END) OVER w AS unclear
      FROM (SELECT *, CASE WHEN kind IN ('received', 'returned') THEN 1 WHEN kind IN ('sold', 'damaged') THEN -1 ELSE 0 END AS s FROM mv WHERE {_in('occurred_at', ('2024-01-03 05:00:00', '2024-01-31 05:00:00'))})
      WINDOW w AS (PARTITION BY variant_id, location_id ORDER BY occurred_at DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""),
    "customer_dedupe": """WITH RECURSIVE c AS (SELECT c_custkey AS id, 'e' || (c_custkey % 1000) AS e, CASE WHEN length('555' || (c_custkey % 700)) >= 7 THEN 'p' || (c_custkey % 700) END AS p, DATE '1994-01-01' + CAST(c_custkey * 7 % 900 AS INT) AS day FROM customer),
      k AS (SELECT id, e AS key FROM c UNION ALL SELECT id, p FROM c WHERE p IS NOT NULL), x AS (SELECT DISTINCT a.id AS u, b.id AS w FROM k a JOIN k b USING (key)),
      t AS (SELECT u, w FROM x UNION SELECT t.u, x.w FROM t JOIN x ON t.w = x.u), g AS (SELECT u, arg_min(w, (day, w)) AS s FROM t JOIN c ON c.id = t.w GROUP BY 1) SELECT u AS customer_id, s AS merged_into FROM g WHERE u <> s""",
    "text_and_or": """WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS t FROM documents), h AS (SELECT doc_id, len(t) AS n, len(list_intersect(t, ['and', 'est', 'the'])) AS hits FROM d)
      SELECT doc_id, round(hits / (1 + ln(CAST(n AS DOUBLE))), 6) AS score FROM h WHERE hits > 0 AND (hits = 3 OR NOT (SELECT coalesce(bool_or(hits = 3), false) FROM h)) ORDER BY 2 DESC, 1 LIMIT 30""",
    "text_or_fallback": """WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS t FROM documents), h AS (SELECT doc_id, len(t) AS n, len(list_intersect(t, ['the', 'zzzqqq'])) AS hits FROM d)
      SELECT doc_id, round(hits / (1 + ln(CAST(n AS DOUBLE))), 6) AS score FROM h WHERE hits > 0 AND (hits = 2 OR NOT (SELECT coalesce(bool_or(hits = 2), false) FROM h)) ORDER BY 2 DESC, 1 LIMIT 30""",
    "hybrid_rrf": """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7), a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY s DESC, vec_id) AS vector_rank FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) AS s FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 30)),
      d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS t FROM documents), h AS (SELECT doc_id, len(t) AS n, len(list_intersect(t, ['and', 'est', 'the'])) AS hits FROM d),
      b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY s DESC, doc_id) AS text_rank FROM (SELECT doc_id, round(hits / (1 + ln(CAST(n AS DOUBLE))), 6) AS s FROM h WHERE hits > 0 AND (hits = 3 OR NOT (SELECT coalesce(bool_or(hits = 3), false) FROM h)) ORDER BY 2 DESC, 1 LIMIT 30))
      SELECT id, vector_rank, text_rank, round(coalesce(CAST(1 AS DOUBLE) / (60 + vector_rank), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + text_rank), 0), 8) AS score FROM a FULL JOIN b USING (id) ORDER BY 4 DESC, 1 LIMIT 10""",
    "month_end_packet": _q(f"""SELECT 'sales' AS section, item, value FROM (UNPIVOT (SELECT gross_sales, discounts, refunds, net_sales, units_sold, CAST(orders AS DOUBLE) AS orders, average_order_value, custom_amounts FROM ({_summary(DEC)})) ON COLUMNS(*) INTO NAME item VALUE value)
      UNION ALL SELECT 'money', item, value FROM (UNPIVOT (SELECT {_m('t')} AS tax, {_m('p')} AS tips, {_m('a')} AS payments_amount, CAST(n AS DOUBLE) AS payments FROM (SELECT sum(tax) AS t FROM sl WHERE {_in('placed_at', DEC)}), (SELECT sum(amount) AS a, sum(tip) AS p, count(*) AS n FROM pay WHERE {_in('occurred_at', DEC)})) ON COLUMNS(*) INTO NAME item VALUE value)
      UNION ALL SELECT 'margin', item, value FROM (UNPIVOT (SELECT {_m('net')} AS net_sales, {_m('cov')} AS covered_sales, {_m('cogs')} AS cogs, {_m('cov - cogs')} AS gross_profit, round(CAST(cov - cogs AS DOUBLE) / CAST(cov AS DOUBLE), 4) AS margin, round(CAST(cov AS DOUBLE) / CAST(net AS DOUBLE), 4) AS cost_coverage FROM (SELECT sum(gross - discount) AS net, sum(gross - discount) FILTER (WHERE unit_cost IS NOT NULL) AS cov, sum(quantity * unit_cost) AS cogs FROM sl WHERE {_in('placed_at', DEC)})) ON COLUMNS(*) INTO NAME item VALUE value)
      UNION ALL SELECT 'stock', item, value FROM (UNPIVOT (SELECT CAST(count(*) AS DOUBLE) AS shelves, CAST(sum(on_hand) AS DOUBLE) AS units, {_m('sum(on_hand * cost)')} AS cost_value, round(CAST(count(cost) AS DOUBLE) / count(*), 4) AS cost_coverage FROM lv JOIN v USING (variant_id) WHERE on_hand > 0) ON COLUMNS(*) INTO NAME item VALUE value)
      UNION ALL SELECT 'worst', key, x FROM (SELECT product_id AS key, {_m('sum(gross) - sum(discount)')} AS x FROM sl WHERE variant_id IS NOT NULL AND {_in('placed_at', DEC)} GROUP BY 1 ORDER BY sum(gross) - sum(discount), key LIMIT 10)"""),
    "staffing_observations": _q("""SELECT location_id, weekday, hour, round(o / staff, 2) AS orders_per_staff_hour, kind FROM (SELECT *, CASE WHEN (hour IN (17, 20)) AND o <= 0.5 THEN 'dead_edge' WHEN round(o / staff, 2) <= 1 THEN 'quiet' WHEN round(o / staff, 2) >= 6 THEN 'busy' END AS kind FROM
      (SELECT n.location_id, n.weekday, n.hour, n.staff, coalesce(round(CAST(sum(c.n) AS DOUBLE) / count(DISTINCT c.day), 2), 0) AS o FROM rota n LEFT JOIN (SELECT * FROM c WHERE NOT event) c USING (location_id, weekday, hour) GROUP BY ALL)) WHERE kind IS NOT NULL""",
      f"c AS (SELECT location_id, CAST({_local('placed_at')} AS DATE) AS day, isodow({_local('placed_at')}) - 1 AS weekday, hour({_local('placed_at')}) AS hour, count(DISTINCT order_id) AS n, bool_or(channel = 'event') AS event FROM sl WHERE {_in('placed_at', ('2001-06-07 04:00:00', END))} GROUP BY ALL)",
      "rota AS (SELECT n_nationkey AS location_id, weekday, hour, n_nationkey % 3 + 1 AS staff FROM nation, range(7) AS d(weekday), range(17, 21) AS h(hour))"),
}


def _base(weeks: int, first: str, until: str, prefix: str = "") -> tuple[str, ...]:
    """Weekday baselines of the observations of some weeks before a day."""
    return (
        f"bd AS (SELECT *, isodow(day) - 1 AS weekday FROM obs WHERE NOT is_event AND day >= DATE '{first}' AND day < DATE '{until}')",
        "bm AS (SELECT location_id, weekday, floor(quantile_cont(net_sales, 0.5) * 100 + 0.500001) / 100 AS median, count(*) AS observations, quantile_cont(CAST(orders AS DOUBLE), 0.5) AS median_orders FROM bd GROUP BY 1, 2)",
        "bs AS (SELECT bm.*, net_sales, abs(net_sales - median) AS off FROM bm JOIN bd ON bm.location_id IS NOT DISTINCT FROM bd.location_id AND bm.weekday = bd.weekday)",
        """wb AS (SELECT location_id, weekday, median, observations, median_orders, floor(floor(quantile_cont(off, 0.5) * 100 + 0.500001) / 100 * CAST(1.4826 AS DOUBLE) * 100 + 0.500001) / 100 AS s,
          CASE WHEN count(*) FILTER (WHERE net_sales < median) >= 2 THEN floor(floor(quantile_cont(off, 0.5) FILTER (WHERE net_sales < median) * 100 + 0.500001) / 100 * CAST(1.4826 AS DOUBLE) * 100 + 0.500001) / 100 ELSE floor(floor(quantile_cont(off, 0.5) * 100 + 0.500001) / 100 * CAST(1.4826 AS DOUBLE) * 100 + 0.500001) / 100 END AS spread_below,
          CASE WHEN count(*) FILTER (WHERE net_sales > median) >= 2 THEN floor(floor(quantile_cont(off, 0.5) FILTER (WHERE net_sales > median) * 100 + 0.500001) / 100 * CAST(1.4826 AS DOUBLE) * 100 + 0.500001) / 100 ELSE floor(floor(quantile_cont(off, 0.5) * 100 + 0.500001) / 100 * CAST(1.4826 AS DOUBLE) * 100 + 0.500001) / 100 END AS spread_above FROM bs GROUP BY ALL)""".replace("bs GROUP BY ALL", "bs GROUP BY location_id, weekday, median, observations, median_orders"),
    )


def _bounds(first: dt.date, last: dt.date) -> tuple[str, str]:
    """Days as half-open UTC instants."""
    at = lambda d: dt.datetime.combine(d, dt.time(), ZoneInfo(Z)).astimezone(dt.UTC).strftime("%Y-%m-%d %H:%M:%S")
    return at(first), at(last + dt.timedelta(days=1))


def _anomalies(day: dt.date) -> tuple[str, ...]:
    first, scan = day - dt.timedelta(weeks=9), day - dt.timedelta(days=7)
    found = f"""sa AS (SELECT day, location_id, net_sales, median, z, difference, CASE WHEN difference < 0 THEN 'warn' ELSE 'info' END AS severity FROM (SELECT obs.day, obs.location_id, obs.net_sales, median, round(obs.net_sales - median, 2) AS difference, round((obs.net_sales - median) / greatest(CASE WHEN obs.net_sales < median THEN spread_below ELSE spread_above END, 25), 2) AS z
      FROM obs JOIN wb ON obs.location_id IS NOT DISTINCT FROM wb.location_id AND isodow(obs.day) - 1 = wb.weekday WHERE NOT is_event AND day >= DATE '{scan}' AND day < DATE '{day}' AND observations >= 4))"""
    return (*_OBS(_bounds(first, day)), *_base(9, str(first), str(scan)), found)


ANOMALY_DAY = dt.date(1999, 10, 8)


def _weeks(last: dt.date = dt.date(2001, 7, 31)) -> str:
    parts = []
    for k in range(6):
        end = last - dt.timedelta(days=7 * k)
        bounds = _bounds(end - dt.timedelta(days=6), end)
        parts.append(f"SELECT DATE '{end}' AS week_end, * FROM (WITH {_shares(bounds, 'x')} SELECT * FROM x)")
    return "wk AS (" + " UNION ALL ".join(parts) + ")"


def _spike(day: dt.date) -> str:
    last = day - dt.timedelta(days=1)
    return _q("""SELECT week_end, location_id, what, share, usual FROM (SELECT week_end, wk.location_id, 'refund' AS what, wk.refund_share AS share, us.refund_share AS usual FROM wk JOIN us ON wk.location_id IS NOT DISTINCT FROM us.location_id WHERE wk.net_sales > 0 UNION ALL SELECT week_end, wk.location_id, 'discount', wk.discount_share, us.discount_share FROM wk JOIN us ON wk.location_id IS NOT DISTINCT FROM us.location_id WHERE wk.net_sales > 0)
      WHERE share >= 0.05 AND CASE WHEN usual > 0 THEN share >= usual * 2.5 ELSE share >= 0.1 END""", _shares(_bounds(day - dt.timedelta(days=91), last), "us"), _weeks(last))


def _two_places(sql: str) -> str:
    return sql.replace("c_nationkey AS location_id", "c_nationkey % 2 AS location_id")


_RECON = "rc AS (SELECT count(*) FILTER (WHERE abs(total - coalesce(t, 0)) > 0.01) AS n FROM o LEFT JOIN (SELECT order_id, sum(gross - discount + tax) AS t FROM l GROUP BY 1) x USING (order_id))"
_METRICS = f"""dm AS (SELECT (SELECT count(*) FROM v) AS variants, (SELECT count(*) FROM v WHERE cost IS NULL) AS variants_missing_cost, (SELECT count(*) FROM v WHERE category_id IS NULL) AS products_uncategorised, (SELECT count(*) FROM lv WHERE on_hand < 0) AS negative_stock_levels,
  (SELECT n FROM rc) AS orders_not_reconciling, (SELECT count(*) FROM l WHERE variant_id IS NULL) AS custom_lines, (SELECT count(*) FROM l) AS lines, (SELECT DATE '2001-08-01' - CAST({_local('max(placed_at)')} AS DATE) FROM o WHERE status <> 'canceled') AS days_since_last_order)"""
_DEMAND = (
    "wu AS (SELECT variant_id, location_id, " + ", ".join(f"CAST(coalesce(sum(quantity) FILTER (WHERE week = {i}), 0) AS DOUBLE) AS w{i}" for i in range(4)) + f" FROM (SELECT *, CAST(floor((epoch(TIMESTAMP '{END}') - epoch(placed_at)) / 604800) AS INT) AS week FROM sl WHERE variant_id IS NOT NULL AND {_in('placed_at', ('2001-07-05 04:00:00', END))}) GROUP BY 1, 2)",
    f"yu AS (SELECT variant_id, location_id, CAST(coalesce(sum(quantity) FILTER (WHERE {_in('placed_at', ('2000-07-06 04:00:00', '2000-08-03 04:00:00'))}), 0) AS DOUBLE) AS last_year, CAST(coalesce(sum(quantity) FILTER (WHERE {_in('placed_at', ('2000-08-02 04:00:00', END))}), 0) AS DOUBLE) AS trailing_year FROM sl WHERE variant_id IS NOT NULL AND {_in('placed_at', ('2000-07-06 04:00:00', END))} GROUP BY 1, 2)",
    """di AS (SELECT lv.variant_id, lv.location_id, CAST(v.price AS DOUBLE) AS price, CAST(v.cost AS DOUBLE) AS cost, CAST(lv.on_hand AS DOUBLE) AS on_hand, coalesce(w0, 0) AS w0, coalesce(w1, 0) AS w1, coalesce(w2, 0) AS w2, coalesce(w3, 0) AS w3, coalesce(last_year, 0) AS last_year, coalesce(trailing_year, 0) AS trailing_year, vendor_id, lead_time_days, pack_size, min_order_qty
      FROM lv JOIN v USING (variant_id) LEFT JOIN wu ON lv.variant_id = wu.variant_id AND lv.location_id = wu.location_id LEFT JOIN yu ON lv.variant_id = yu.variant_id AND lv.location_id = yu.location_id LEFT JOIN (SELECT * FROM tm WHERE is_primary) t ON lv.variant_id = t.variant_id)""",
    "ra AS (SELECT *, round_even((w0 * 4 + w1 * 3 + w2 * 2 + w3) / 10 / 7, 3) AS velocity, CASE WHEN trailing_year > 0 AND last_year > 0 THEN round_even(least(greatest(last_year / (trailing_year * 28 / 365), CAST(0.5 AS DOUBLE)), CAST(2.5 AS DOUBLE)), 2) ELSE CAST(1 AS DOUBLE) END AS season, coalesce(lead_time_days, 14) AS lead FROM di WHERE w0 + w1 + w2 + w3 > 0)",
    "rb AS (SELECT *, round_even(velocity * season * (lead + 7), 3) AS demand, round_even(velocity * season * 7 * CASE WHEN velocity * 7 >= 3 THEN CAST(1 AS DOUBLE) ELSE CAST(0.33 AS DOUBLE) END, 3) AS safety FROM ra WHERE velocity > 0)",
    "rd AS (SELECT *, round_even(demand + safety - on_hand, 3) AS raw_qty, coalesce(pack_size, 1) AS pk, coalesce(min_order_qty, 0) AS lo FROM rb)",
    "rf AS (SELECT *, CASE WHEN ceil(raw_qty / pk) * pk < lo THEN ceil(lo / pk) * pk ELSE ceil(raw_qty / pk) * pk END AS suggested_qty, CASE WHEN on_hand > 0 THEN round_even(on_hand / velocity, 1) END AS cover FROM rd WHERE raw_qty > 0)",
    "rg AS (SELECT *, coalesce(cover < lead, false) AS stocks_out FROM rf WHERE suggested_qty > 0)",
)
_STOCKOUT = ORACLE["stockout_days"]
ORACLE |= {
    "weekday_baselines": _q("SELECT location_id, weekday, median, observations, median_orders, spread_below, spread_above FROM wb", *_OBS(("2001-01-03 05:00:00", END)), *_base(30, "2001-01-03", "2001-08-01")),
    "sales_anomalies": _two_places(_q("SELECT * FROM sa WHERE abs(z) >= 2 AND abs(difference) >= 75", *_anomalies(ANOMALY_DAY))),
    "refund_spike": _spike(dt.date(2001, 8, 1)),
    "dq_catalog": _q("SELECT metric, value FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM dm) ON COLUMNS(*) INTO NAME metric VALUE value)", _RECON, _METRICS),
    "dq_findings": _q("""SELECT 'missing_costs' AS code, CASE WHEN 1 - variants_missing_cost / variants > 0.7 THEN 'warning' ELSE 'error' END AS severity, CAST(variants_missing_cost AS DOUBLE) AS count, round(CAST(variants_missing_cost AS DOUBLE) / variants, 4) AS share FROM dm WHERE variants_missing_cost > 0
      UNION ALL SELECT 'custom_amount_sales', 'info', 0, round(CAST(custom_lines AS DOUBLE) / lines, 4) FROM dm WHERE CAST(custom_lines AS DOUBLE) / lines > 0.01 UNION ALL SELECT 'orders_not_reconciling', 'error', orders_not_reconciling, NULL FROM dm WHERE orders_not_reconciling > 0
      UNION ALL SELECT 'negative_stock', 'warning', negative_stock_levels, NULL FROM dm WHERE negative_stock_levels > 0 UNION ALL SELECT 'stale_data', 'error', days_since_last_order, NULL FROM dm WHERE days_since_last_order > 3""", _RECON, _METRICS),
    "demand_inputs": _q("SELECT variant_id, location_id, on_hand, w0, w1, w2, w3, last_year, trailing_year, coalesce(stockout_days, 0) AS stockout_days, lead_time_days FROM di LEFT JOIN sd USING (variant_id, location_id)", *_DEMAND[:3], f"sd AS ({_STOCKOUT})"),
    "reorder_suggestions": _q("SELECT variant_id, location_id, velocity, season, lead, demand, safety, raw_qty, suggested_qty, cover, stocks_out, vendor_id FROM rg ORDER BY stocks_out DESC, coalesce(cover, -1), variant_id, location_id LIMIT 200", *_DEMAND),
    "vendor_groups": _q("SELECT vendor_id, count(*) AS lines, round(sum(suggested_qty), 2) AS units, round(sum(suggested_qty * cost), 2) AS cost FROM rg GROUP BY 1", *_DEMAND),
    "shortfall": _q("SELECT count(*) AS lines, round(sum(m), 2) AS units_missed, round(sum(m * price), 2) AS lost_sales, round(sum(m * (price - cost)), 2) AS lost_margin, CASE WHEN coalesce(round(sum(m * price), 2), 0) >= 250 THEN 'urgent' ELSE 'warn' END AS severity FROM (SELECT *, round_even(velocity * (lead - cover), 2) AS m FROM rg WHERE cover IS NOT NULL AND stocks_out AND lead - cover > 0)", *_DEMAND),
}

_SPIKE = _spike(ANOMALY_DAY)
_RUNS = "ru AS (SELECT event_type AS job, ts AS started_at, date_trunc('day', ts) AS due_at, CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'succeeded' ELSE 'failed' END AS status FROM events)"
_DRAFTS = "pd AS (SELECT reference, vendor_id, min(status) AS status FROM pl GROUP BY 1, 2)"
_RECORDED = """st AS (SELECT * FROM i WHERE CAST(substr(dedupe_key, 2) AS BIGINT) % 3 <> 0), dr AS (SELECT * FROM i WHERE CAST(substr(dedupe_key, 2) AS BIGINT) % 2 = 0),
rr AS (SELECT CASE WHEN dr.dedupe_key IS NOT NULL THEN 'urgent' ELSE st.severity END AS severity, CASE WHEN st.dedupe_key IS NULL THEN 'new' ELSE st.status END AS status, CASE WHEN dr.dedupe_key IS NOT NULL THEN 1.5 ELSE st.dollar_impact END AS impact, st.rating FROM st FULL JOIN dr ON st.dedupe_key = dr.dedupe_key)"""
_ASKED_HITS = """WITH q AS (SELECT vec_id AS question_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (7, 107, 207)),
s AS (SELECT question_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) AS score FROM embeddings JOIN q ON vec_id <> question_id),
t AS (SELECT question_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM s) JOIN documents ON doc_id = vec_id WHERE rank <= 5)"""


def _rule(name: str, broken: str, rows: str) -> str:
    return f"SELECT '{name}' AS name, count(*) AS checked, count(*) FILTER (WHERE {broken}) AS broken FROM ({rows})"


ORACLE |= {
    "hit_at_k": _ASKED_HITS + " SELECT count(*) AS questions, count(*) FILTER (WHERE hit) AS hits, round(avg(hit::INT), 4) AS hit_rate FROM (SELECT d.doc_id, coalesce(bool_or(contains(lower(t.lang), lower(d.lang))), false) AS hit FROM documents d LEFT JOIN t ON t.question_id = d.doc_id WHERE d.doc_id IN (7, 107, 207) GROUP BY 1)",
    "eval_summary": """SELECT tenant, round(avg(passed), 4) AS passed, CAST(round(avg(cost), 4) AS DECIMAL(16,7))::DOUBLE AS mean_cost, min(seconds) FILTER (WHERE n >= 0.95 * m) AS p95_seconds FROM
      (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY seconds) AS n, count(*) OVER (PARTITION BY tenant) AS m FROM (SELECT event_type AS tenant, CAST(event_id % 5 <> 0 AS INT) AS passed, CAST(round(value / 1000, 3) AS DECIMAL(12,3)) AS cost, round(value, 2) AS seconds FROM events)) GROUP BY 1""",
    "source_invariants": _q(" UNION ALL ".join((
        _rule("counts_are_history", "on_hand <> coalesce(moved, 0)", "SELECT on_hand, moved FROM lv LEFT JOIN (SELECT variant_id, location_id, sum(quantity * CASE WHEN kind IN ('received', 'returned') THEN 1 WHEN kind IN ('sold', 'damaged') THEN -1 ELSE 0 END) AS moved FROM mv GROUP BY 1, 2) m USING (variant_id, location_id)"),
        _rule("orders_are_lines", "abs(total - coalesce(t, 0)) > 0.01", "SELECT total, t FROM o LEFT JOIN (SELECT order_id, sum(gross - discount + tax) AS t FROM l GROUP BY 1) x USING (order_id)"),
        _rule("refunds_within_payment", "b > p", "SELECT b, p FROM (SELECT order_id, sum(amount) AS b FROM r GROUP BY 1) x JOIN (SELECT order_id, sum(gross - discount) AS p FROM l GROUP BY 1) y USING (order_id)"),
        _rule("no_negative_stock", "on_hand < 0", "SELECT on_hand FROM lv"),
    ))),
    "source_quirks": _q("""SELECT 'anonymous_orders' AS quirk, round(avg(CAST(customer_id IS NULL AS INT)), 4) AS share FROM o UNION ALL SELECT 'custom_lines', round(avg(CAST(variant_id IS NULL AS INT)), 4) FROM l UNION ALL SELECT 'variants_without_cost', round(avg(CAST(cost IS NULL AS INT)), 4) FROM v
      UNION ALL SELECT 'shared_emails', round(CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS DOUBLE) / sum(n), 4) FROM (SELECT c_custkey % 1000, count(*) AS n FROM customer GROUP BY 1)"""),
    "detectors": _two_places(_q(f"""SELECT 'sales_anomaly' AS kind, day || ':' || location_id AS subject, severity, difference AS impact FROM sa WHERE abs(z) >= 2.5 AND abs(difference) >= 75
      UNION ALL SELECT 'refund_spike', week_end || ':' || location_id || ':' || what, 'warn', NULL FROM ({_SPIKE})
      UNION ALL SELECT 'impossible_stock', CAST(variant_id AS VARCHAR), 'warn', NULL FROM (SELECT variant_id FROM lv GROUP BY 1 HAVING sum(on_hand) < 0)""", *_anomalies(ANOMALY_DAY))),
    "breakdown_totals": "SELECT *, (" + _q("SELECT count(*) FROM (SELECT category_id FROM sl WHERE " + _in("placed_at", Q4) + " GROUP BY 1)") + ") AS total_rows, (" + _q("SELECT count(*) FROM (SELECT category_id FROM sl WHERE " + _in("placed_at", Q4) + " GROUP BY 1)") + ") > 10 AS truncated FROM (" + ORACLE["breakdown_category"] + ")",
    "catalog_totals": _q("SELECT variant_id, sku, n AS total_rows, n > 30 AS truncated FROM v, (SELECT count(*) AS n FROM v WHERE sku ILIKE '%sku-1%') WHERE sku ILIKE '%sku-1%' ORDER BY sku, name, variant_id LIMIT 30"),
    "where_it_sits": _q("SELECT variant_id, location_id AS sits_at FROM (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY on_hand DESC, location_id) AS n FROM lv) WHERE n = 1"),
    "vendor_returns": _q("SELECT variant_id, vendor_id, vendor_id % 7 = 0 AS takes_returns FROM tm WHERE is_primary"),
    "briefing": _q(f"""SELECT 'location' AS section, CAST(n_nationkey AS VARCHAR) AS item, n_name AS value FROM nation UNION ALL SELECT 'channel', channel, CAST(count(*) AS VARCHAR) FROM o WHERE status <> 'canceled' GROUP BY channel
      UNION ALL SELECT 'sales', 'first_day', CAST(CAST({_local('min(placed_at)')} AS DATE) AS VARCHAR) FROM o WHERE status <> 'canceled' UNION ALL SELECT 'sales', 'last_day', CAST(CAST({_local('max(placed_at)')} AS DATE) AS VARCHAR) FROM o WHERE status <> 'canceled'
      UNION ALL SELECT 'finding', dedupe_key, kind FROM (SELECT * FROM i WHERE status IN ('new', 'seen', 'snoozed') AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-30') AND (snoozed_until IS NULL OR snoozed_until <= TIMESTAMP '2024-01-30')
        ORDER BY CASE severity WHEN 'urgent' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, dollar_impact DESC NULLS LAST, created_at DESC, dedupe_key LIMIT 5) WHERE severity <> 'info'""", _INSIGHTS),
    "drafts_replaced": _q("SELECT reference, vendor_id, CASE WHEN vendor_id % 3 = 0 AND status = 'draft' THEN 'canceled' ELSE status END AS status FROM pd UNION ALL SELECT reference || '-new', vendor_id, 'draft' FROM pd WHERE vendor_id % 3 = 0", *_PO, _DRAFTS),
    "runs_swept": f"WITH {_RUNS} SELECT CASE WHEN status = 'running' AND started_at < TIMESTAMP '2024-01-15' THEN 'failed' ELSE status END AS status, count(*) AS n FROM ru GROUP BY 1",
    "runs_last_succeeded": f"WITH {_RUNS} SELECT job, arg_max(due_at, started_at) AS due_at FROM ru WHERE status = 'succeeded' GROUP BY 1",
    "runs_claimed": f"WITH {_RUNS} SELECT job, CAST(d AS DATE) AS due_on FROM (SELECT DISTINCT job FROM ru), generate_series(DATE '2023-12-20', DATE '2023-12-20' + 59, INTERVAL 1 DAY) AS t(d) WHERE NOT EXISTS (SELECT 1 FROM ru WHERE ru.job = job AND ru.due_at = d)".replace("ru.job = job", "ru.job = w.job").replace("(SELECT DISTINCT job FROM ru),", "(SELECT DISTINCT job FROM ru) w,").replace("SELECT job, CAST", "SELECT w.job, CAST"),
    "messages_sent": f"SELECT user_id AS recipient, count(*) AS sent FROM events WHERE CAST({_local('ts')} AS DATE) = DATE '2024-01-15' GROUP BY 1",
    "messages_delivery": "SELECT event_id AS message_id, CASE WHEN event_id % 8 = 0 THEN 'channel_off' WHEN event_id % 7 <> 0 AND (event_id * 37 % 1440 >= 1320 OR event_id * 37 % 1440 < 420) THEN 'quiet_hours' WHEN event_id % 7 <> 0 AND event_id % 5 >= 3 THEN 'daily_cap' END AS suppressed FROM events",
    "insights_recorded": f"WITH {_INSIGHTS}, {_RECORDED} SELECT severity, status, count(*) AS n, CAST(round(sum(CAST(impact AS DECIMAL(14,2))), 2) AS DOUBLE) AS impact, count(rating) AS rated FROM rr GROUP BY 1, 2",
    "map_scalars": "SELECT event_id AS row, CAST(event_id AS DOUBLE) / 100 AS dollars, CASE WHEN event_id % 4 = 0 THEN round(value, 2) WHEN event_id % 4 = 3 THEN CAST(event_id AS DOUBLE) END AS decimal, CASE WHEN event_id % 4 = 0 THEN CAST(trunc(round(value, 2)) AS BIGINT) WHEN event_id % 4 = 3 THEN event_id END AS whole, CASE event_id % 4 WHEN 0 THEN CAST(CAST(round(value, 2) AS DECIMAL(12,2)) AS VARCHAR) WHEN 1 THEN 'NONE' WHEN 2 THEN 'JUNK' ELSE CAST(event_id AS VARCHAR) END AS named FROM events",
    "raw_landing": """SELECT 'order' AS entity, o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}' AS payload FROM orders""",
    "fk_required": "SELECT c_custkey AS customer_id, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3 GROUP BY 1",
    "fk_optional": "SELECT c_custkey AS customer_id, count(*) AS orders FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 3) c ON o_custkey = c_custkey GROUP BY 1",
}
