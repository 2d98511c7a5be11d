"""Thresholds and fixed values.

Everything in the block marked FIXED VALUES must equal the source system's
constants, word lists and labels for results to match; it is stated once
here and read everywhere else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference's constants for right results)
# ---------------------------------------------------------------------------
CHURN_LOOKBACK_DAYS = 90          # order-feature window, inclusive
CHURN_TARGET_DAYS = 30            # recency above this is churned
REORDER_DAYS = 3                  # days of supply below this: REORDER NOW
WATCH_DAYS = 7                    # days of supply below this: WATCH
MISSING_RECENCY = 999             # recency / contact default when no rows

ROLLING_SHORT_ROWS = 7            # trailing rows of the short demand average
ROLLING_LONG_ROWS = 14            # trailing rows of the long demand average
TREND_BAND = 0.05                 # +/- 5 % band for UP / DOWN
FORECAST_HORIZON_DAYS = 7

FORECAST_CATEGORIES = ["Produce", "Dairy", "Bakery", "Meat", "Beverages"]
FORECAST_SKU_PREFIX = "SKU-"

SKU_CATEGORIES = ["beverages", "snacks", "dairy", "produce", "frozen",
                  "personal_care", "household", "bakery", "electronics", "apparel"]
SKU_CATEGORY_PRICE = {
    "beverages": 4.99, "snacks": 2.49, "dairy": 3.99, "produce": 2.99,
    "frozen": 5.99, "personal_care": 6.99, "household": 7.49,
    "bakery": 3.49, "electronics": 49.99, "apparel": 29.99,
}

CHURN_LABEL_SHARE = 0.30          # top share by recency labelled churned
CHURN_LABEL_MINIMUM = 2
CHURN_FEATURES = [
    "order_count_90d", "total_spend_90d", "avg_order_value", "recency_days",
    "return_rate", "crm_events", "complaints", "days_since_last_contact", "age",
]
GBT_TREES = 100
GBT_DEPTH = 4
GBT_STEP = 0.1
GBT_SEED = 42
TEST_SHARE_BUCKETS = 5            # 1 of 5 hash buckets is the 20 % test split
TIER_CUTS = (0.33, 0.66)          # right-closed: <=0.33 Low, <=0.66 Medium, else High
TIER_TOP = 1.001                  # upper end of the last tier
TIER_LABELS = ("Low", "Medium", "High")
DISPLAY_RECENCY_ALERT = 60        # at-risk list: recency badge turns red above this
DISPLAY_PROB_BANDS = (0.5, 0.7)   # at-risk list: amber above 0.5, red above 0.7

CUSTOMER_CHANNELS = ["Online", "In-Store", "Mobile"]          # by id % 3
STAFF_ROLES = ["Store Manager", "Floor Associate", "Cashier", "Inventory Clerk"]
CRM_EVENT_TYPES = {               # source event type -> CRM event type
    "error": "complaint", "click": "inquiry", "signup": "return_request",
    "purchase": "loyalty_redemption",
}
CRM_DEFAULT_EVENT_TYPE = "feedback"
EVENT_COMPLAINT = "complaint"
EVENT_RETURN_REQUEST = "return_request"
NOTE_PARTS = ("Customer ", " contacted regarding ", ".")   # note = parts around id and type
SKU_NAME_FORMAT = "SKU_%04d"

STATUS_REORDER = "REORDER NOW"
STATUS_WATCH = "WATCH"
STATUS_OK = "OK"
STAFF_UNDERSTAFFED = "UNDERSTAFFED"
STAFF_OK = "OK"
TREND_UP = "UP"
TREND_DOWN = "DOWN"
TREND_FLAT = "FLAT"
CONFIDENCE_DOWN = "Medium"        # confidence of a DOWN trend
CONFIDENCE_OTHER = "High"         # confidence of UP and FLAT
DOC_SEP = " | "                   # between corpus document segments
NOTES_SEP = "; "                  # between CRM notes of one customer
DOC_LABELS = ("Customer: ", "Segment: ", "Region: ", "Orders 90d: ", "Spend 90d: $",
              "Recency days: ", "Churn risk: ", "CRM notes: ")
DOC_RISK_TEXT = ("Low", "High")   # printed for is_churned 0 / 1
CONTEXT_SEP = "\n\n"              # between retrieved documents in a prompt context

EXPECTATIONS = {                  # dataset -> rule name -> SQL predicate (warn only)
    "customers": {"valid_customer_id": "customer_id IS NOT NULL",
                  "valid_store_id": "store_id IS NOT NULL"},
    "orders": {"valid_order_value": "order_value > 0",
               "valid_order_date": "order_date IS NOT NULL"},
    "inventory": {"valid_qty": "qty_sold >= 0",
                  "valid_inventory": "inventory_on_hand >= 0"},
}

SUGGESTED_QUESTIONS = [
    "Which customers are at highest churn risk this month?",
    "How many inventory items need immediate reorder?",
    "Which region has the most at-risk customers?",
    "What are the top trending SKUs in demand?",
    "Are any stores understaffed right now?",
    "How much revenue is at risk from churning customers?",
]
INTENT_INVENTORY = ["inventory", "stock", "reorder", "supply", "sku"]
INTENT_REGION_WORDS = ["region", "store", "stores", "location", "northeast", "west", "south", "midwest"]
INTENT_DEMAND = ["demand", "forecast", "trending", "sales", "category"]
INTENT_STAFFING = ["staff", "headcount", "labor", "understaffed", "employee"]
ASSISTANT_TOP_REGIONS = 5
ASSISTANT_TOP_SKUS = 5
RETRIEVAL_TOP_K = 5
NO_CONTEXT_TEXT = "No relevant customer data found."
NO_DATA_TEXT = "No specific data available for this query."
FALLBACK_HEADER = "Here's what the live data shows:\n\n"
FALLBACK_BULLET = "• "

RAG_PROMPT_TEMPLATE = (
    "You are RetailAdvisor, an AI assistant for retail store managers.\n"
    "Answer using only the customer data provided below. Be concise and actionable.\n\n"
    "CUSTOMER DATA:\n%s\n\nQUESTION: %s\n\nANSWER:")
ASSISTANT_SYSTEM_TEMPLATE = (
    "You are RetailAdvisor, an AI assistant for retail executives at a %d-customer retail chain. "
    "Answer using ONLY the data provided. Be concise — 2-3 sentences max — and give a "
    "concrete recommendation.")
ASSISTANT_USER_TEMPLATE = "LIVE RETAIL DATA:\n%s\n\nQUESTION: %s"
KPI_TEXT = "KPIs: %d total customers, %d at high churn risk (%.1f%% avg churn probability)."
INVENTORY_TEXT = ("Inventory: %d SKU/store combos need immediate reorder. "
                  "Average days of supply remaining: %.1f days.")
REGION_TEXT = "Churn by region: %s."
REGION_ITEM = "%s: %d at-risk"
DEMAND_TEXT = "Top trending SKUs (demand UP): %s."
DEMAND_ITEM = "%s (%s)"
STAFFING_TEXT = "Staffing: %d role/store combinations are understaffed."

LAYER_TABLES = [                  # (table label, layer, source label)
    ("bronze.customers_raw", "Bronze", "Postgres (mock)"),
    ("bronze.orders_raw", "Bronze", "Postgres (mock)"),
    ("bronze.inventory_raw", "Bronze", "MySQL (mock)"),
    ("bronze.crm_events_raw", "Bronze", "Salesforce CSV (mock)"),
    ("bronze.staffing_raw", "Bronze", "HR CSV (mock)"),
    ("silver.customers", "Silver", "DLT cleaned"),
    ("silver.orders", "Silver", "DLT cleaned"),
    ("silver.inventory", "Silver", "DLT + rolling demand"),
    ("silver.crm_summary", "Silver", "DLT aggregated"),
    ("gold.customer_360", "Gold", "Core entity (DLT)"),
    ("gold.churn_scores", "Gold", "XGBoost ML output"),
    ("gold.inventory_health", "Gold", "Reorder signals (DLT)"),
    ("gold.demand_forecast", "Gold", "Rolling forecast"),
    ("gold.store_staffing_summary", "Gold", "Labor gaps (DLT)"),
]
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Thresholds:
    """Business thresholds, overridable per run."""

    lookback_days: int = CHURN_LOOKBACK_DAYS
    churn_days: int = CHURN_TARGET_DAYS
    reorder_days: int = REORDER_DAYS
    watch_days: int = WATCH_DAYS
    short_rows: int = ROLLING_SHORT_ROWS
    long_rows: int = ROLLING_LONG_ROWS
    band: float = TREND_BAND
    horizon_days: int = FORECAST_HORIZON_DAYS
    tier_cuts: tuple = field(default=TIER_CUTS)


DEFAULT = Thresholds()
