"""Independent DuckDB SQL for every oracle-checked query.

DuckDB sees only the driver's raw tables, so each statement inlines the
adapter and the dataset definitions it depends on as CTEs. The fragments
below are written directly in SQL from the dataset semantics; ``sql(name)``
resolves the dependencies of a final SELECT and prepends the CTEs it needs.
"""

from __future__ import annotations

import re

from .. import config as C


def rr(num: str, den: str, places: int) -> str:
    """HALF_UP round of num/den (integers) to ``places`` decimals, as DOUBLE."""
    s = 10 ** places
    return (f"(CASE WHEN ({den}) <> 0 THEN CAST((({num}) * {2 * s} + ({den})) // (({den}) * 2) "
            f"AS DOUBLE) / {s} END)")


def rr_long(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) <> 0 THEN CAST((({num}) * 2 + ({den})) // (({den}) * 2) AS BIGINT) END)"


def micros(x: str) -> str:
    return f"CAST(round(({x}) * 1000000) AS BIGINT)"


def _sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _case_index(expr: str, values: list[str], base: int = 0) -> str:
    whens = " ".join(f"WHEN {i + base} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


CTE: dict[str, str] = {}

# ---------------------------------------------------------------- bronze
CTE["b_stores"] = """
SELECT CAST(n_nationkey AS BIGINT) AS store_id, n_name AS store_name, r_name AS region, n_name AS state
FROM nation JOIN region ON n_regionkey = r_regionkey"""

CTE["b_skus"] = f"""
SELECT sku_id, printf('SKU_%04d', sku_id) AS sku_name,
       {_case_index('(sku_id + 9) % 10', C.SKU_CATEGORIES)} AS category,
       CASE {' '.join(f"WHEN (sku_id + 9) % 10 = {i} THEN CAST({C.SKU_CATEGORY_PRICE[c]} AS DOUBLE)" for i, c in enumerate(C.SKU_CATEGORIES))} END AS avg_unit_price
FROM (SELECT DISTINCT CAST(p_partkey AS BIGINT) AS sku_id FROM part)"""

CTE["b_customers_raw"] = f"""
SELECT c_custkey AS customer_id, c_name AS customer_name, CAST(c_nationkey AS BIGINT) AS store_id,
       22 + c_custkey % 50 AS age, c_mktsegment AS segment,
       {_case_index('c_custkey % 3', C.CUSTOMER_CHANNELS)} AS preferred_channel,
       c_custkey % 365 AS days_since_join
FROM customer"""

CTE["b_orders_raw"] = """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(c_nationkey AS BIGINT) AS store_id,
       CAST(o_orderdate AS DATE) AS order_date, o_totalprice AS order_value,
       o_orderkey % 8 = 0 AS is_returned
FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""

_crm_type = ("CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.CRM_EVENT_TYPES.items())
             + f" ELSE '{C.CRM_DEFAULT_EVENT_TYPE}' END")
CTE["b_crm_events_raw"] = f"""
SELECT event_id, customer_id, event_type, event_date,
       'Customer ' || CAST(customer_id AS VARCHAR) || ' contacted regarding ' || event_type || '.' AS notes
FROM (SELECT event_id, user_id AS customer_id, {_crm_type} AS event_type, CAST(ts AS DATE) AS event_date
      FROM events)"""

CTE["b_inventory_raw"] = """
SELECT store_id, sku_id, txn_date, CAST(SUM(qty) AS BIGINT) AS qty_sold, MAX(price) AS unit_price,
       MAX(on_hand) AS inventory_on_hand
FROM (SELECT CAST(s_nationkey AS BIGINT) AS store_id, CAST(l_partkey AS BIGINT) AS sku_id, d AS txn_date,
             CAST(l_quantity AS BIGINT) AS qty, p_retailprice AS price,
             CAST(CASE WHEN (date_diff('day', DATE '1995-01-01', d) + l_partkey) % 10 = 0 THEN 0
                       ELSE 10 + (date_diff('day', DATE '1995-01-01', d) * 7 + l_partkey * 3) % 80 END AS INTEGER)
               AS on_hand
      FROM (SELECT *, CAST(l_shipdate AS DATE) AS d FROM lineitem)
      LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey)
GROUP BY store_id, sku_id, txn_date"""

CTE["b_staffing_raw"] = f"""
SELECT CAST(s_nationkey AS BIGINT) AS store_id,
       {_case_index('s_suppkey % 4', C.STAFF_ROLES)} AS role,
       COUNT(*) AS current_headcount, COUNT(*) + s_nationkey % 2 AS budgeted_headcount,
       CAST(COUNT(*) * (35000 + (s_suppkey % 4) * 5000) AS DOUBLE) AS annual_labor_cost
FROM supplier GROUP BY s_nationkey, s_suppkey % 4"""

# ---------------------------------------------------------------- silver
CTE["s_customers"] = """
SELECT customer_id, customer_name, store_id, age, segment, preferred_channel, days_since_join
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY customer_name NULLS FIRST,
             store_id NULLS FIRST, age NULLS FIRST, segment NULLS FIRST, preferred_channel NULLS FIRST,
             days_since_join NULLS FIRST) AS rn
      FROM (SELECT customer_id, customer_name, store_id, TRY_CAST(age AS INTEGER) AS age, segment,
                   preferred_channel, TRY_CAST(days_since_join AS INTEGER) AS days_since_join
            FROM b_customers_raw))
WHERE rn = 1"""

CTE["s_orders"] = """
SELECT order_id, customer_id, store_id, order_date, order_value, is_returned
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY order_date DESC NULLS LAST,
             customer_id NULLS FIRST, store_id NULLS FIRST, order_value NULLS FIRST,
             is_returned NULLS FIRST) AS rn
      FROM b_orders_raw)
WHERE rn = 1"""

CTE["s_inventory_rolled"] = f"""
SELECT store_id, sku_id, txn_date, qty_sold, unit_price, inventory_on_hand,
       SUM(CAST(qty_sold AS BIGINT)) OVER w AS _qty_sum, COUNT(qty_sold) OVER w AS _qty_n,
       CAST(SUM(CAST(qty_sold AS BIGINT)) OVER w AS DOUBLE) / COUNT(qty_sold) OVER w AS avg_daily_demand_7d
FROM (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY store_id, sku_id, txn_date
             ORDER BY qty_sold DESC NULLS LAST, unit_price DESC NULLS LAST,
                      inventory_on_hand DESC NULLS LAST) AS rn
      FROM b_inventory_raw) WHERE rn = 1)
WINDOW w AS (PARTITION BY store_id, sku_id ORDER BY txn_date
             ROWS BETWEEN {C.ROLLING_SHORT_ROWS - 1} PRECEDING AND CURRENT ROW)"""

CTE["s_inventory"] = """
SELECT store_id, sku_id, txn_date, qty_sold, unit_price, inventory_on_hand, avg_daily_demand_7d
FROM s_inventory_rolled"""

CTE["s_crm_summary"] = """
SELECT customer_id, COUNT(*) AS total_events,
       COUNT(*) FILTER (WHERE event_type = 'complaint') AS complaints,
       COUNT(*) FILTER (WHERE event_type = 'return_request') AS return_requests,
       MAX(event_date) AS last_contact_date,
       CAST(date_diff('day', MAX(event_date), (SELECT MAX(event_date) FROM b_crm_events_raw)) AS INTEGER)
         AS days_since_last_contact
FROM b_crm_events_raw GROUP BY customer_id"""

# ---------------------------------------------------------------- gold
CTE["g_order_features"] = f"""
SELECT customer_id, COUNT(*) AS order_count_90d,
       CAST(SUM(c) AS DOUBLE) / 1000000 AS total_spend_90d,
       {rr('SUM(c)', 'COUNT(*) * 1000000', 2)} AS avg_order_value,
       MAX(order_date) AS last_order_date,
       CAST(date_diff('day', MAX(order_date), (SELECT MAX(order_date) FROM s_orders)) AS INTEGER) AS recency_days,
       {rr('COUNT(*) FILTER (WHERE is_returned)', 'COUNT(*)', 3)} AS return_rate
FROM (SELECT *, {micros('order_value')} AS c FROM s_orders)
WHERE order_date >= (SELECT MAX(order_date) FROM s_orders) - {C.CHURN_LOOKBACK_DAYS}
GROUP BY customer_id"""

CTE["g_customer_360"] = f"""
SELECT c.customer_id, c.customer_name, c.store_id, s.region, s.state, c.segment, c.preferred_channel, c.age,
       COALESCE(o.order_count_90d, 0) AS order_count_90d,
       COALESCE(o.total_spend_90d, CAST(0 AS DOUBLE)) AS total_spend_90d,
       COALESCE(o.avg_order_value, CAST(0 AS DOUBLE)) AS avg_order_value,
       o.last_order_date,
       COALESCE(o.recency_days, {C.MISSING_RECENCY}) AS recency_days,
       COALESCE(o.return_rate, CAST(0 AS DOUBLE)) AS return_rate,
       COALESCE(m.total_events, 0) AS crm_events,
       COALESCE(m.complaints, 0) AS complaints,
       COALESCE(m.return_requests, 0) AS crm_return_requests,
       COALESCE(m.days_since_last_contact, {C.MISSING_RECENCY}) AS days_since_last_contact,
       CASE WHEN COALESCE(o.recency_days, {C.MISSING_RECENCY}) > {C.CHURN_TARGET_DAYS} THEN 1 ELSE 0 END
         AS is_churned
FROM s_customers c
LEFT JOIN b_stores s ON c.store_id = s.store_id
LEFT JOIN g_order_features o ON c.customer_id = o.customer_id
LEFT JOIN s_crm_summary m ON c.customer_id = m.customer_id"""

CTE["g_inventory_health"] = f"""
SELECT store_id, sku_id, inventory_on_hand,
       {rr('_qty_sum', '_qty_n', 1)} AS avg_daily_demand_7d,
       CASE WHEN _qty_sum > 0 THEN {rr('CAST(inventory_on_hand AS BIGINT) * _qty_n', '_qty_sum', 1)} END
         AS days_of_supply,
       CASE WHEN _qty_sum > 0 AND inventory_on_hand * _qty_n < _qty_sum * {C.REORDER_DAYS} THEN 'REORDER NOW'
            WHEN _qty_sum > 0 AND inventory_on_hand * _qty_n < _qty_sum * {C.WATCH_DAYS} THEN 'WATCH'
            ELSE 'OK' END AS inventory_status,
       txn_date AS signal_date
FROM s_inventory_rolled
WHERE txn_date = (SELECT MAX(txn_date) FROM s_inventory_rolled)"""

CTE["g_staffing"] = """
SELECT st.store_id, s.region, st.role, st.current_headcount, st.budgeted_headcount,
       st.budgeted_headcount - st.current_headcount AS headcount_gap, st.annual_labor_cost,
       CASE WHEN st.current_headcount < st.budgeted_headcount THEN 'UNDERSTAFFED' ELSE 'OK' END
         AS staffing_status
FROM b_staffing_raw st JOIN b_stores s ON st.store_id = s.store_id"""


# ---------------------------------------------------------------- forecast
_fcat = _case_index("sku_id % 5", C.FORECAST_CATEGORIES)
CTE["f_signals_exact"] = f"""
SELECT sku_id, '{C.FORECAST_SKU_PREFIX}' || CAST(sku_id AS VARCHAR) AS sku_name, {_fcat} AS category, txn_date,
       total_qty_sold, CAST(_inv_sum AS DOUBLE) / _inv_n AS avg_inventory,
       CAST(_price_sum AS DOUBLE) / 1000000 / _price_n AS avg_unit_price,
       {rr('_s_sum', '_s_n', 1)} AS demand_7d_avg, {rr('_l_sum', '_l_n', 1)} AS demand_14d_avg,
       {rr_long('_s_sum * 10', '_s_n')} AS _t7, {rr_long('_l_sum * 10', '_l_n')} AS _t14,
       _price_sum, _price_n
FROM (SELECT *, SUM(total_qty_sold) OVER ws AS _s_sum, COUNT(total_qty_sold) OVER ws AS _s_n,
             SUM(total_qty_sold) OVER wl AS _l_sum, COUNT(total_qty_sold) OVER wl AS _l_n
      FROM (SELECT sku_id, txn_date, CAST(SUM(CAST(qty_sold AS BIGINT)) AS BIGINT) AS total_qty_sold,
                   SUM(CAST(inventory_on_hand AS BIGINT)) AS _inv_sum, COUNT(inventory_on_hand) AS _inv_n,
                   SUM({micros('unit_price')}) AS _price_sum, COUNT(unit_price) AS _price_n
            FROM s_inventory GROUP BY sku_id, txn_date)
      WINDOW ws AS (PARTITION BY sku_id ORDER BY txn_date ROWS BETWEEN {C.ROLLING_SHORT_ROWS - 1} PRECEDING AND CURRENT ROW),
             wl AS (PARTITION BY sku_id ORDER BY txn_date ROWS BETWEEN {C.ROLLING_LONG_ROWS - 1} PRECEDING AND CURRENT ROW))"""

CTE["f_signals"] = """
SELECT sku_id, sku_name, category, txn_date, total_qty_sold, avg_inventory, avg_unit_price,
       demand_7d_avg, demand_14d_avg FROM f_signals_exact"""

_band = round(C.TREND_BAND * 100)
CTE["f_forecast"] = f"""
SELECT sku_id, sku_name, category, demand_7d_avg, demand_14d_avg, trend, predicted_units_7d,
       CASE WHEN trend = 'DOWN' THEN 'Medium' ELSE 'High' END AS confidence, signal_date, avg_unit_price
FROM (SELECT sku_id, sku_name, category, demand_7d_avg, demand_14d_avg,
             CASE WHEN _t7 * 100 > _t14 * {100 + _band} THEN 'UP'
                  WHEN _t7 * 100 < _t14 * {100 - _band} THEN 'DOWN' ELSE 'FLAT' END AS trend,
             CAST({rr_long(f'_t7 * {C.FORECAST_HORIZON_DAYS}', '10')} AS INTEGER) AS predicted_units_7d,
             txn_date AS signal_date, {rr('_price_sum', '_price_n * 1000000', 2)} AS avg_unit_price
      FROM f_signals_exact WHERE txn_date = (SELECT MAX(txn_date) FROM f_signals_exact))"""

CTE["f_spine"] = f"""
SELECT store_id, sku_id, MIN(txn_date) AS first_day, MAX(txn_date) AS last_day, COUNT(*) AS days,
       COUNT(*) FILTER (WHERE is_observed) AS observed_days, COUNT(*) FILTER (WHERE is_stockout) AS stockout_days,
       CAST(SUM(qty_sold) AS BIGINT) AS units, MAX(_avg) AS peak_demand_7d
FROM (SELECT *, CAST(SUM(qty_sold) OVER w AS DOUBLE) / COUNT(*) OVER w AS _avg
      FROM (SELECT sp.store_id, sp.sku_id, sp.txn_date,
                   (i.qty_sold IS NOT NULL OR i.inventory_on_hand IS NOT NULL) AS is_observed,
                   COALESCE(i.inventory_on_hand, 0) = 0 AS is_stockout, COALESCE(i.qty_sold, 0) AS qty_sold
            FROM (SELECT store_id, sku_id, CAST(unnest(generate_series(MIN(txn_date), MAX(txn_date), INTERVAL 1 DAY)) AS DATE)
                           AS txn_date
                  FROM s_inventory GROUP BY store_id, sku_id) sp
            LEFT JOIN s_inventory i ON sp.store_id = i.store_id AND sp.sku_id = i.sku_id AND sp.txn_date = i.txn_date)
      WINDOW w AS (PARTITION BY store_id, sku_id ORDER BY txn_date
                   ROWS BETWEEN {C.ROLLING_SHORT_ROWS - 1} PRECEDING AND CURRENT ROW))
GROUP BY store_id, sku_id"""

# ---------------------------------------------------------------- churn
CTE["c_labels"] = f"""
SELECT customer_id, recency_days,
       CASE WHEN ROW_NUMBER() OVER (ORDER BY recency_days DESC, customer_id ASC)
                 <= GREATEST({C.CHURN_LABEL_MINIMUM},
                             CAST(floor(CAST({C.CHURN_LABEL_SHARE} AS DOUBLE) * COUNT(*) OVER ()) AS BIGINT))
            THEN 1 ELSE 0 END AS churn_label
FROM g_customer_360"""

_lo, _mid = C.TIER_CUTS
def _scores(prob: str) -> str:
    return f"""
SELECT customer_id, customer_name, store_id, region, segment, recency_days, order_count_90d,
       total_spend_90d, churn_prob,
       CASE WHEN churn_prob <= CAST({_lo} AS DOUBLE) THEN '{C.TIER_LABELS[0]}'
            WHEN churn_prob <= CAST({_mid} AS DOUBLE) THEN '{C.TIER_LABELS[1]}'
            ELSE '{C.TIER_LABELS[2]}' END AS risk_tier
FROM (SELECT *, {prob} AS churn_prob FROM g_customer_360)"""


_rule = ("CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + exp(CAST(-(recency_days - 60) AS DOUBLE) / CAST(20 AS DOUBLE)"
         " + CAST(0.3 AS DOUBLE) * order_count_90d))")
CTE["c_scores"] = _scores(f"round({_rule}, 6)")
CTE["c_scores_raw"] = _scores(_rule)

# ---------------------------------------------------------------- KPIs
_HIGH = C.TIER_LABELS[2]
_prob = "CAST(round(churn_prob * 1000000000000) AS BIGINT)"
CTE["k_tiers"] = f"""
SELECT risk_tier, customers, {rr('customers * 100', 'SUM(customers) OVER ()', 1)} AS pct
FROM (SELECT risk_tier, COUNT(*) AS customers FROM c_scores GROUP BY risk_tier)"""

CTE["k_revenue"] = f"""
SELECT {rr(f"SUM({micros('c.total_spend_90d')})", '3000000', 0)} AS monthly_revenue_at_risk,
       COUNT(*) AS high_risk_customers
FROM c_scores cs JOIN g_customer_360 c USING (customer_id) WHERE cs.risk_tier = '{_HIGH}'"""

CTE["k_totals"] = """
SELECT COUNT(DISTINCT customer_id) AS total_customers, COUNT(DISTINCT store_id) AS total_stores
FROM g_customer_360"""

CTE["k_reorder"] = """
SELECT COUNT(*) FILTER (WHERE inventory_status = 'REORDER NOW') AS reorder_count FROM g_inventory_health"""

def risk_list(scores: str) -> str:
    return f"""
SELECT customer_id, customer_name, region, segment, recency_days, order_count_90d,
       {rr(micros('total_spend_90d'), '1000000', 2)} AS total_spend_90d,
       {rr(_prob, '1000000000000', 3)} AS churn_prob, risk_tier
FROM {scores} WHERE risk_tier = '{_HIGH}' ORDER BY {scores}.churn_prob DESC, customer_id LIMIT 25"""


CTE["k_risk_list"] = risk_list("c_scores")

CTE["k_layer_counts"] = "\nUNION ALL\n".join(
    f"SELECT '{label}' AS tbl, COUNT(*) AS \"rows\" FROM {cte}" for label, cte in [
        ("bronze.customers_raw", "b_customers_raw"), ("bronze.orders_raw", "b_orders_raw"),
        ("bronze.inventory_raw", "b_inventory_raw"), ("bronze.crm_events_raw", "b_crm_events_raw"),
        ("bronze.staffing_raw", "b_staffing_raw"), ("silver.customers", "s_customers"),
        ("silver.orders", "s_orders"), ("silver.inventory", "s_inventory"),
        ("silver.crm_summary", "s_crm_summary"), ("gold.customer_360", "g_customer_360"),
        ("gold.churn_scores", "c_scores"), ("gold.inventory_health", "g_inventory_health"),
        ("gold.demand_forecast", "f_forecast"), ("gold.store_staffing_summary", "g_staffing")])

CTE["k_platform"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{l}', '{s}')" for t, l, s in C.LAYER_TABLES) + ") AS v(tbl, layer, source)"


# ---------------------------------------------------------------- text
NOTE_ROWS = 4096
CTE["t_notes"] = f"""
SELECT customer_id, chunk_no, COALESCE(string_agg(part, '; ' ORDER BY event_date, blk), '') AS all_notes
FROM (SELECT *, COALESCE(SUM(n) OVER (PARTITION BY customer_id ORDER BY event_date, blk
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {NOTE_ROWS} AS chunk_no
      FROM (SELECT customer_id, event_date, event_id // {NOTE_ROWS} AS blk, COUNT(*) AS n,
                   string_agg(notes, '; ' ORDER BY event_id) AS part
            FROM b_crm_events_raw GROUP BY customer_id, event_date, event_id // {NOTE_ROWS}))
GROUP BY customer_id, chunk_no"""

CTE["t_rag_documents"] = """
SELECT CAST(c.customer_id AS VARCHAR) || CASE WHEN n.chunk_no > 0 THEN '-' || CAST(n.chunk_no AS VARCHAR) ELSE '' END AS doc_id,
       concat_ws(' | ', 'Customer: ' || c.customer_name, 'Segment: ' || c.segment, 'Region: ' || c.region,
                 'Orders 90d: ' || CAST(c.order_count_90d AS VARCHAR),
                 'Spend 90d: $' || CAST(CAST(c.total_spend_90d AS DECIMAL(18,2)) AS VARCHAR),
                 'Recency days: ' || CAST(c.recency_days AS VARCHAR),
                 'Churn risk: ' || CASE WHEN c.is_churned = 1 THEN 'High' ELSE 'Low' END,
                 'CRM notes: ' || n.all_notes) AS document,
       c.customer_id, c.customer_name, c.segment, c.region
FROM g_customer_360 c LEFT JOIN t_notes n ON c.customer_id = n.customer_id"""

SNAPSHOT_LAG_DAYS = 7
CTE["b_orders_raw_prev"] = f"""
SELECT * FROM b_orders_raw WHERE order_date <= (SELECT MAX(order_date) FROM b_orders_raw) - {SNAPSHOT_LAG_DAYS}"""
CTE["b_crm_events_raw_prev"] = f"""
SELECT * FROM b_crm_events_raw
WHERE event_date <= (SELECT MAX(event_date) FROM b_crm_events_raw) - {SNAPSHOT_LAG_DAYS}"""
_PREV_CHAIN = ["s_orders", "s_crm_summary", "g_order_features", "g_customer_360", "t_notes",
               "t_rag_documents"]
_PREV_NAMES = ["b_orders_raw", "b_crm_events_raw"] + _PREV_CHAIN
for _n in _PREV_CHAIN:
    _body = CTE[_n]
    for _m in _PREV_NAMES:
        _body = re.sub(rf"\b{_m}\b", f"{_m}_prev", _body)
    CTE[f"{_n}_prev"] = _body

_DOC_COLS = ["document", "customer_id", "customer_name", "segment", "region"]
CTE["t_rag_changes"] = f"""
SELECT doc_id, _change_type, {', '.join(_DOC_COLS)}
FROM (SELECT COALESCE(n.doc_id, o.doc_id) AS doc_id,
             CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete'
                  WHEN {' OR '.join(f'o.{c} IS DISTINCT FROM n.{c}' for c in _DOC_COLS)} THEN 'update' END
               AS _change_type,
             {', '.join(f'CASE WHEN n.doc_id IS NULL THEN o.{c} ELSE n.{c} END AS {c}' for c in _DOC_COLS)}
      FROM t_rag_documents_prev o FULL OUTER JOIN t_rag_documents n ON o.doc_id = n.doc_id)
WHERE _change_type IS NOT NULL"""

CTE["t_questions"] = ("SELECT * FROM (VALUES " + ", ".join(
    "('suggested-%d', '%s')" % (i, q.replace("'", "''")) for i, q in enumerate(C.SUGGESTED_QUESTIONS))
    + """) AS v(question_id, question)
UNION ALL
SELECT 'conv-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text FROM conversations
WHERE role = 'user'""")

_ws = "[ \\t\\n\\r\\f\\x0B]"
_nq = f"lower(regexp_replace(question, '^{_ws}+|{_ws}+$', '', 'g'))"
CTE["a_texts"] = f"""
SELECT
  (SELECT printf('{C.KPI_TEXT}', COUNT(*), COUNT(*) FILTER (WHERE risk_tier = 'High'),
          {rr(f'SUM({_prob})', 'COUNT(*) * 10000000000', 1)}) FROM c_scores) AS kpi,
  (SELECT CASE WHEN avg_dos IS NOT NULL THEN printf('{C.INVENTORY_TEXT}', cnt, avg_dos) END
     FROM (SELECT COUNT(*) AS cnt,
                  {rr('SUM(CAST(round(days_of_supply * 10) AS BIGINT))', 'COUNT(days_of_supply) * 10', 1)} AS avg_dos
           FROM g_inventory_health WHERE inventory_status = 'REORDER NOW')) AS inventory,
  (SELECT printf('{C.REGION_TEXT}', COALESCE(string_agg(printf('{C.REGION_ITEM}', region, high_risk), ', '
                 ORDER BY high_risk DESC, region), ''))
     FROM (SELECT region, COUNT(*) FILTER (WHERE risk_tier = 'High') AS high_risk FROM c_scores
           GROUP BY region ORDER BY high_risk DESC, region LIMIT {C.ASSISTANT_TOP_REGIONS})) AS region,
  (SELECT printf('{C.DEMAND_TEXT}', COALESCE(string_agg(printf('{C.DEMAND_ITEM}', sku_name, category), ', '
                 ORDER BY demand_7d_avg DESC, sku_id), ''))
     FROM (SELECT * FROM f_forecast WHERE trend = 'UP' ORDER BY demand_7d_avg DESC, sku_id
           LIMIT {C.ASSISTANT_TOP_SKUS})) AS demand,
  (SELECT printf('{C.STAFFING_TEXT}', COUNT(*) FILTER (WHERE staffing_status = 'UNDERSTAFFED'))
     FROM g_staffing) AS staffing"""


def _flag_any(words) -> str:
    return "(" + " OR ".join(f"contains(nq, '{w}')" for w in words) + ")"


def _flag_word(words) -> str:
    return "(" + " OR ".join(f"contains(' ' || nq || ' ', ' {w} ')" for w in words) + ")"


CTE["a_grounded"] = f"""
SELECT question_id, question, wants_kpi, wants_inventory, wants_region, wants_demand, wants_staffing,
       CASE WHEN len(parts) > 0 THEN array_to_string(parts, ' ') ELSE '{C.NO_DATA_TEXT}' END AS context,
       CAST(len(parts) AS INTEGER) AS context_used,
       'Here''s what the live data shows:' || chr(10) || chr(10)
         || array_to_string(list_transform(parts, lambda x: '{C.FALLBACK_BULLET}' || x), chr(10)) AS answer
FROM (SELECT *, list_filter([CASE WHEN wants_kpi THEN kpi END, CASE WHEN wants_inventory THEN inventory END,
                             CASE WHEN wants_region THEN region END, CASE WHEN wants_demand THEN demand END,
                             CASE WHEN wants_staffing THEN staffing END], lambda x: x IS NOT NULL) AS parts
      FROM (SELECT question_id, question, true AS wants_kpi,
                   {_flag_any(C.INTENT_INVENTORY)} AS wants_inventory,
                   {_flag_word(C.INTENT_REGION_WORDS)} AS wants_region,
                   {_flag_any(C.INTENT_DEMAND)} AS wants_demand,
                   {_flag_any(C.INTENT_STAFFING)} AS wants_staffing
            FROM (SELECT *, {_nq} AS nq FROM t_questions)), a_texts)"""

CTE["r_centroid_neighbors"] = f"""
SELECT label, vec_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score
FROM (SELECT c.label, e.vec_id, list_cosine_similarity(c.v, CAST(e.embedding AS DOUBLE[])) AS s,
             ROW_NUMBER() OVER (PARTITION BY c.label
                                ORDER BY list_cosine_similarity(c.v, CAST(e.embedding AS DOUBLE[])) DESC,
                                         e.vec_id) AS rank
      FROM (SELECT label, list(m ORDER BY pos) AS v
            FROM (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m
                  FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos
                        FROM embeddings)
                  GROUP BY label, pos)
            GROUP BY label) c, embeddings e)
WHERE rank <= {C.RETRIEVAL_TOP_K}"""


# ---------------------------------------------------------------- quality
_exp_parts = []
for _ds, _cte in [("customers", "s_customers"), ("orders", "s_orders"), ("inventory", "s_inventory")]:
    for _rule, _pred in C.EXPECTATIONS[_ds].items():
        _exp_parts.append(f"SELECT '{_ds}' AS dataset, '{_rule}' AS rule, COUNT(*) AS \"rows\", "
                          f"COUNT(*) FILTER (WHERE NOT COALESCE({_pred}, false)) AS failed FROM {_cte}")
CTE["q_expectations"] = "\nUNION ALL\n".join(_exp_parts)

_latest_inv = "(SELECT * FROM s_inventory WHERE txn_date = (SELECT MAX(txn_date) FROM s_inventory))"
_checks = [
    ("silver.customers one row per customer_id", "SELECT COUNT(DISTINCT customer_id) FROM b_customers_raw",
     "SELECT COUNT(*) FROM s_customers"),
    ("silver.orders one row per order_id", "SELECT COUNT(DISTINCT order_id) FROM b_orders_raw",
     "SELECT COUNT(*) FROM s_orders"),
    ("silver.inventory one row per store, sku, day",
     "SELECT COUNT(*) FROM (SELECT DISTINCT store_id, sku_id, txn_date FROM b_inventory_raw)",
     "SELECT COUNT(*) FROM s_inventory"),
    ("units in silver.inventory = units in lineitem",
     "SELECT SUM(CAST(l_quantity AS BIGINT)) FROM lineitem", "SELECT SUM(qty_sold) FROM s_inventory"),
    ("silver.crm_summary one row per customer with events",
     "SELECT COUNT(DISTINCT customer_id) FROM b_crm_events_raw", "SELECT COUNT(*) FROM s_crm_summary"),
    ("gold.customer_360 one row per customer", "SELECT COUNT(*) FROM s_customers",
     "SELECT COUNT(*) FROM g_customer_360"),
    ("gold.churn_scores one row per customer", "SELECT COUNT(*) FROM g_customer_360",
     "SELECT COUNT(*) FROM c_scores"),
    ("churn labels = max(2, floor(0.3 n))",
     f"SELECT GREATEST({C.CHURN_LABEL_MINIMUM}, CAST(floor(CAST({C.CHURN_LABEL_SHARE} AS DOUBLE) * COUNT(*)) AS BIGINT)) FROM g_customer_360",
     "SELECT SUM(churn_label) FROM c_labels"),
    ("gold.inventory_health one row per series on the latest day",
     f"SELECT COUNT(*) FROM (SELECT DISTINCT store_id, sku_id FROM {_latest_inv})",
     "SELECT COUNT(*) FROM g_inventory_health"),
    ("gold.demand_forecast one row per sku on the latest day",
     f"SELECT COUNT(DISTINCT sku_id) FROM {_latest_inv}", "SELECT COUNT(*) FROM f_forecast"),
    ("gold.store_staffing_summary one row per known store role",
     "SELECT COUNT(*) FROM b_staffing_raw WHERE store_id IN (SELECT store_id FROM b_stores)",
     "SELECT COUNT(*) FROM g_staffing"),
]
CTE["q_checks"] = "SELECT *, expected = actual AS ok FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{n}' AS \"check\", CAST(({e}) AS BIGINT) AS expected, CAST(({a}) AS BIGINT) AS actual"
    for n, e, a in _checks) + ")"


def _deps(body: str) -> list[str]:
    return [n for n in CTE if re.search(rf"\b{n}\b", body)]


def sql(final: str) -> str:
    """``final`` prefixed with every CTE it (transitively) references, in
    dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _deps(CTE[name]):
            if dep != name:
                visit(dep)
        order.append(name)

    for n in _deps(final):
        visit(n)
    if not order:
        return final.strip()
    body = ",\n".join(f"{n} AS ({CTE[n].strip()})" for n in order)
    return f"WITH {body}\n{final.strip()}"


def select_all(cte: str) -> str:
    return sql(f"SELECT * FROM {cte}")
