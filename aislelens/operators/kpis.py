"""KPI queries over the gold tables (Q14-Q31, Q33-Q36).

One-row summaries combine aggregates through scalar subqueries (each runs
once and ships a single value), never through cross joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.exact import MONEY_SCALE, PROB_SCALE, micros, round_ratio, scaled

HIGH = C.TIER_LABELS[2]


def _prob_exact(col: str = "churn_prob"):
    """The raw churn_prob as an exact integer (10^-12 units)."""
    return scaled(col, PROB_SCALE)


def _prob_round3():
    """The raw churn_prob rounded HALF_UP to 3 places, once."""
    return round_ratio(_prob_exact(), F.lit(PROB_SCALE), 3)


def risk_tier_distribution(scores: DataFrame) -> DataFrame:
    """Customers and percent of all customers per tier."""
    counts = scores.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("customers"))
    total = F.sum("customers").over(Window.partitionBy())   # over the <= 3 tier rows
    return counts.withColumn("pct", round_ratio(F.col("customers") * 100, total, 1))


def ranked(rows: DataFrame, *order) -> DataFrame:
    """L1: the order in which a short list is served, as a ``rank`` column
    (for lists of one row per tier, region, segment or table)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order)))


def served_tiers(scores: DataFrame) -> DataFrame:
    """Q14/Q19 as served: the tier list, largest tier first."""
    return ranked(risk_tier_distribution(scores), F.col("customers").desc(), F.col("risk_tier").asc_nulls_last())


def served_regions(scores: DataFrame) -> DataFrame:
    """Q20 as served: one row per region, by name."""
    return ranked(regional_churn_pivot(scores), F.col("region").asc_nulls_last())


def served_segments(scores: DataFrame) -> DataFrame:
    """Q21 as served: segments by their High share."""
    return ranked(churn_by_segment(scores), F.col("high_risk_pct").desc(), F.col("segment").asc_nulls_last())


def served_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Q25 as served: row counts by table name."""
    return ranked(layer_row_counts(tables), "tbl")


def top_churn_risk(scores: DataFrame, k: int = 10) -> DataFrame:
    """Q15 (validation form): High tier by probability, top ``k``."""
    return (scores.filter(F.col("risk_tier") == HIGH)
            .orderBy(F.col("churn_prob").desc(), F.col("customer_id").asc()).limit(k)
            .select("customer_id", "customer_name", "region", "segment", "recency_days",
                    "order_count_90d", _prob_round3().alias("churn_prob"), "risk_tier"))


def churn_risk_list(scores: DataFrame, k: int = 25) -> DataFrame:
    """Q15 (serving form): adds rounded spend, top ``k``."""
    return (scores.filter(F.col("risk_tier") == HIGH)
            .orderBy(F.col("churn_prob").desc(), F.col("customer_id").asc()).limit(k)
            .select("customer_id", "customer_name", "region", "segment", "recency_days",
                    "order_count_90d", round_ratio(micros("total_spend_90d"), F.lit(MONEY_SCALE), 2).alias("total_spend_90d"),
                    _prob_round3().alias("churn_prob"), "risk_tier"))


def revenue_at_risk(scores: DataFrame, c360: DataFrame) -> DataFrame:
    """Q16: monthly revenue at risk (90-day spend / 90 * 30, summed,
    rounded) and the number of High-tier customers."""
    high = scores.filter(F.col("risk_tier") == HIGH).select("customer_id")
    joined = high.join(c360.select("customer_id", "total_spend_90d"), "customer_id")
    return joined.agg(round_ratio(F.sum(micros("total_spend_90d")), F.lit(3 * MONEY_SCALE), 0)
                      .alias("monthly_revenue_at_risk"),
                      F.count(F.lit(1)).alias("high_risk_customers"))


def customer_store_totals(c360: DataFrame) -> DataFrame:
    """Q17/A2: distinct customers and stores in one pass."""
    return c360.agg(F.count_distinct("customer_id").alias("total_customers"),
                    F.count_distinct("store_id").alias("total_stores"))


def reorder_count(health: DataFrame) -> DataFrame:
    """Q18: store/SKU combinations to reorder now."""
    return health.agg(F.count_if(F.col("inventory_status") == C.STATUS_REORDER).alias("reorder_count"))


def executive_summary(scores: DataFrame, c360: DataFrame, health: DataFrame,
                      with_tiers: bool = False) -> DataFrame:
    """Q19: the one-row executive summary.

    churn_rate_pct is the High tier's share (0 without High rows); revenue
    and High count default to 0. ``with_tiers`` adds the tier list
    (tier, count, pct), largest tier first, as the dashboard shows it.
    """
    tiers = risk_tier_distribution(scores)
    rev = revenue_at_risk(scores, c360)
    totals = customer_store_totals(c360)
    high_pct = tiers.filter(F.col("risk_tier") == HIGH).select("pct").scalar()
    cols = [] if not with_tiers else [tiers.agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("customers")).alias("o"), F.col("risk_tier").alias("tier"),
                                             F.col("customers").alias("count"), F.col("pct").alias("pct")))),
        lambda t: F.struct(t["tier"].alias("tier"), t["count"].alias("count"), t["pct"].alias("pct"))))
        .scalar().alias("risk_tiers")]
    return rev.select(
        *cols,
        F.coalesce(high_pct, F.lit(0.0)).alias("churn_rate_pct"),
        F.coalesce(F.col("monthly_revenue_at_risk"), F.lit(0.0)).cast("long").alias("revenue_at_risk"),
        F.coalesce(F.col("high_risk_customers"), F.lit(0)).cast("long").alias("high_risk_customers"),
        totals.select("total_customers").scalar().alias("total_customers"),
        totals.select("total_stores").scalar().alias("total_stores"),
        reorder_count(health).scalar().alias("inventory_alerts"))


def regional_churn(scores: DataFrame) -> DataFrame:
    """Q20 (long form): customers per region and tier."""
    return scores.groupBy("region", "risk_tier").agg(F.count(F.lit(1)).alias("cnt"))


def regional_churn_pivot(scores: DataFrame) -> DataFrame:
    """Q20 (pivoted, A11): one row per region with High/Medium/Low counts."""
    tiers = [C.TIER_LABELS[2], C.TIER_LABELS[1], C.TIER_LABELS[0]]
    return (scores.groupBy("region").pivot("risk_tier", tiers).agg(F.count(F.lit(1)))
            .na.fill(0, tiers))


def churn_by_segment(scores: DataFrame) -> DataFrame:
    """Q21: customers, High count and High percent per segment."""
    high = F.count_if(F.col("risk_tier") == HIGH)
    return (scores.groupBy("segment")
            .agg(F.count(F.lit(1)).alias("total"), high.alias("high_risk"))
            .withColumn("high_risk_pct", round_ratio(F.col("high_risk") * 100, F.col("total"), 1)))


def inventory_alerts(health: DataFrame, k: int = 20) -> DataFrame:
    """Q23 (validation form): REORDER NOW rows, least supply first."""
    return (health.filter(F.col("inventory_status") == C.STATUS_REORDER)
            .orderBy(F.col("days_of_supply").asc(), "store_id", "sku_id").limit(k)
            .select("store_id", "sku_id", "inventory_on_hand", "days_of_supply", "inventory_status"))


def inventory_alerts_served(health: DataFrame, stores: DataFrame, k: int = 25) -> DataFrame:
    """Q23 (serving form): with the store's region."""
    return (health.filter(F.col("inventory_status") == C.STATUS_REORDER)
            .join(stores.select("store_id", "region"), "store_id")
            .orderBy(F.col("days_of_supply").asc(), "store_id", "sku_id").limit(k)
            .select("store_id", "region", "sku_id", "inventory_on_hand", "days_of_supply",
                    "avg_daily_demand_7d", "inventory_status"))


def staffing_gaps(summary: DataFrame) -> DataFrame:
    """Q24: understaffed roles, largest gap first."""
    return (summary.filter(F.col("staffing_status") == C.STAFF_UNDERSTAFFED)
            .orderBy(F.col("headcount_gap").desc(), "store_id", "role")
            .select("store_id", "region", "role", "current_headcount", "budgeted_headcount",
                    "headcount_gap", "staffing_status"))


def layer_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, rows) for each named table, one union of counts."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("tbl"), "rows")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def platform_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Q26: layer and source label per table with its row count; a missing
    table counts 0."""
    return platform_stats_from(layer_row_counts(tables))


def platform_stats_from(counts: DataFrame) -> DataFrame:
    """Q26 from (tbl, rows) counts, live or recorded at write time."""
    labels = counts.sparkSession.createDataFrame(C.LAYER_TABLES, "tbl string, layer string, source string")
    return (labels.join(counts, "tbl", "left")
            .select(F.col("tbl").alias("table"), "layer", "source",
                    F.coalesce(F.col("rows"), F.lit(0)).cast("long").alias("rows")))


def platform_total_rows(stats: DataFrame) -> DataFrame:
    """Total rows processed across the platform tables."""
    return stats.agg(F.sum("rows").alias("total_rows"))


# --- assistant context queries (Q27-Q31) ---------------------------------

def assistant_kpis(scores: DataFrame) -> DataFrame:
    """Q27: total customers, High count, mean churn probability in %."""
    n = F.count(F.lit(1))
    return scores.agg(n.alias("total_customers"),
                      F.count_if(F.col("risk_tier") == HIGH).alias("high_risk"),
                      round_ratio(F.sum(_prob_exact().cast("decimal(20,0)")), n * (PROB_SCALE // 100), 1).alias("avg_churn_pct"))


def assistant_inventory(health: DataFrame) -> DataFrame:
    """Q28: REORDER NOW count and their mean days of supply."""
    reorder = health.filter(F.col("inventory_status") == C.STATUS_REORDER)
    tenths = F.round(F.col("days_of_supply") * 10).cast("long")
    return reorder.agg(F.count(F.lit(1)).alias("cnt"),
                       round_ratio(F.sum(tenths), F.count(tenths) * 10, 1).alias("avg_dos"))


def assistant_regions(scores: DataFrame, k: int = C.ASSISTANT_TOP_REGIONS) -> DataFrame:
    """Q29: regions with the most High-tier customers."""
    return (scores.groupBy("region").agg(F.count_if(F.col("risk_tier") == HIGH).alias("high_risk"))
            .orderBy(F.col("high_risk").desc(), F.col("region").asc()).limit(k))


def assistant_demand(forecast: DataFrame, k: int = C.ASSISTANT_TOP_SKUS) -> DataFrame:
    """Q30: top rising SKUs."""
    return (forecast.filter(F.col("trend") == C.TREND_UP)
            .orderBy(F.col("demand_7d_avg").desc(), F.col("sku_id").asc()).limit(k)
            .select("sku_id", "sku_name", "category", "trend", "demand_7d_avg"))


def assistant_staffing(summary: DataFrame) -> DataFrame:
    """Q31: understaffed role/store combinations."""
    return summary.agg(F.count_if(F.col("staffing_status") == C.STAFF_UNDERSTAFFED).alias("gaps"))


# --- dashboard bands and prose-only metrics (Q33-Q36) --------------------

def display_bands(scores: DataFrame, k: int = 25) -> DataFrame:
    """Q33: badges of the at-risk list - recency alert above 60 days, and a
    red/amber/green band on the rounded probability (> 0.7, > 0.5)."""
    amber, red = C.DISPLAY_PROB_BANDS
    listed = churn_risk_list(scores, k)
    return listed.select(
        "customer_id", "recency_days", "churn_prob",
        (F.col("recency_days") > C.DISPLAY_RECENCY_ALERT).alias("recency_alert"),
        F.when(F.col("churn_prob") > red, "red").when(F.col("churn_prob") > amber, "amber")
         .otherwise("green").alias("prob_band"))


def stockout_rate(health: DataFrame) -> DataFrame:
    """Q34: percent of store/SKU combinations at REORDER NOW."""
    n = F.count(F.lit(1))
    reorder = F.count_if(F.col("inventory_status") == C.STATUS_REORDER)
    return health.agg(n.alias("combos"), reorder.alias("reorder_now"),
                      round_ratio(reorder * 100, n, 1).alias("stockout_rate_pct"))


def weekly_revenue_at_risk(health: DataFrame, inventory: DataFrame, horizon: int = 7) -> DataFrame:
    """Q35: for REORDER NOW combinations, ``horizon`` days of their rounded
    daily demand at that day's unit price, summed (exact, in millionths)."""
    prices = inventory.select("store_id", "sku_id", F.col("txn_date").alias("signal_date"), "unit_price")
    rows = (health.filter(F.col("inventory_status") == C.STATUS_REORDER)
            .join(prices, ["store_id", "sku_id", "signal_date"]))
    tenths = F.round(F.col("avg_daily_demand_7d") * 10).cast("decimal(12,0)") * micros("unit_price") * F.lit(horizon)
    return rows.agg(round_ratio(F.sum(tenths), F.lit(10 * MONEY_SCALE), 2).alias("weekly_revenue_at_risk"),
                    F.count(F.lit(1)).alias("reorder_combos"))


def regional_stockouts(health: DataFrame, stores: DataFrame) -> DataFrame:
    """Q36: REORDER NOW count and share per region."""
    reorder = F.count_if(F.col("inventory_status") == C.STATUS_REORDER)
    return (health.join(stores.select("store_id", "region"), "store_id")
            .groupBy("region")
            .agg(F.count(F.lit(1)).alias("combos"), reorder.alias("reorder_now"))
            .withColumn("reorder_pct", round_ratio(F.col("reorder_now") * 100, F.col("combos"), 1)))


# 2 ** SKETCH_BITS registers: a relative standard error of 0.8 %, four of which are the stated bound
SKETCH_BITS = 14
SKETCH_ERROR = 0.04


def daily_sketches(rows: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """A2: a mergeable sketch of the distinct values of each group and day (about 16 KB at most); store it and merge
    any days and groups later without their rows."""
    return rows.groupBy(*keys, day).agg(F.hll_sketch_agg(value, F.lit(SKETCH_BITS)).alias("sketch"))


def merged_sketches(daily: DataFrame, keys: list[str]) -> DataFrame:
    """The estimated distinct values of each group over all its stored sketches."""
    return daily.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
