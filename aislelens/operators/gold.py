"""Gold layer (Q5-Q8): customer features and profile, inventory health,
staffing summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.exact import MONEY_SCALE, micros, money, round_ratio
from .dedup import as_of_date


def order_features(orders: DataFrame, as_of=None,
                   lookback_days: int = C.CHURN_LOOKBACK_DAYS) -> DataFrame:
    """Q5: per customer over the last ``lookback_days`` (inclusive, no upper
    bound): count, spend, average value, last date, recency, return rate.

    Aggregated per customer before any join; money is summed in millionths so
    the rounded average is exact.
    """
    day = as_of_date(as_of, orders, "order_date")
    recent = orders.filter(F.col("order_date") >= F.date_sub(day, lookback_days))
    agg = (recent.groupBy("customer_id")
           .agg(F.count(F.lit(1)).alias("order_count_90d"),
                F.sum(micros("order_value")).alias("_spend"),
                F.max("order_date").alias("last_order_date"),
                F.count_if(F.col("is_returned")).alias("_returned")))
    n = F.col("order_count_90d")
    return agg.select(
        "customer_id", "order_count_90d",
        money(F.col("_spend")).alias("total_spend_90d"),
        round_ratio(F.col("_spend"), n * MONEY_SCALE, 2).alias("avg_order_value"),
        "last_order_date",
        F.datediff(day, F.col("last_order_date")).alias("recency_days"),
        round_ratio(F.col("_returned"), n, 3).alias("return_rate"))


def customer_360(customers: DataFrame, stores: DataFrame, features: DataFrame,
                 crm: DataFrame, churn_days: int = C.CHURN_TARGET_DAYS,
                 audit: bool = True) -> DataFrame:
    """Q6: the one-row-per-customer profile.

    Stores is a broadcast dimension; features and CRM summary are already
    aggregated per customer_id, so the two left joins share one hash
    partitioning on customer_id.
    """
    c, s, o, m = customers.alias("c"), stores.alias("s"), features.alias("o"), crm.alias("m")
    recency = F.coalesce(F.col("o.recency_days"), F.lit(C.MISSING_RECENCY))
    out = (c.join(s, F.col("c.store_id") == F.col("s.store_id"), "left")
           .join(o, F.col("c.customer_id") == F.col("o.customer_id"), "left")
           .join(m, F.col("c.customer_id") == F.col("m.customer_id"), "left")
           .select(F.col("c.customer_id"), F.col("c.customer_name"), F.col("c.store_id"),
                   F.col("s.region"), F.col("s.state"), F.col("c.segment"),
                   F.col("c.preferred_channel"), F.col("c.age"),
                   F.coalesce(F.col("o.order_count_90d"), F.lit(0)).alias("order_count_90d"),
                   F.coalesce(F.col("o.total_spend_90d"), F.lit(0.0)).alias("total_spend_90d"),
                   F.coalesce(F.col("o.avg_order_value"), F.lit(0.0)).alias("avg_order_value"),
                   F.col("o.last_order_date"),
                   recency.alias("recency_days"),
                   F.coalesce(F.col("o.return_rate"), F.lit(0.0)).alias("return_rate"),
                   F.coalesce(F.col("m.total_events"), F.lit(0)).alias("crm_events"),
                   F.coalesce(F.col("m.complaints"), F.lit(0)).alias("complaints"),
                   F.coalesce(F.col("m.return_requests"), F.lit(0)).alias("crm_return_requests"),
                   F.coalesce(F.col("m.days_since_last_contact"),
                              F.lit(C.MISSING_RECENCY)).alias("days_since_last_contact"),
                   F.when(recency > churn_days, 1).otherwise(0).alias("is_churned")))
    return out.withColumn("updated_at", F.current_timestamp()) if audit else out


def inventory_health(inventory: DataFrame, reorder_days: int = C.REORDER_DAYS,
                     watch_days: int = C.WATCH_DAYS, latest=None,
                     window_rows: int = C.ROLLING_SHORT_ROWS, parts: int | None = None) -> DataFrame:
    """Q7: reorder status per (store, sku) on the single latest date.

    ``inventory`` is the de-duplicated silver inventory (one row per store,
    sku and day). Only the last ``window_rows`` rows of each series matter:
    ``row_number() <= window_rows`` keeps them with a partial top-n before
    the shuffle, and one aggregate per series gives the trailing sum and
    count and the latest on-hand - the whole history is never windowed.
    Series whose last day is the single latest day (``latest``, default the
    table's own) are kept. Days of supply = on_hand * n / sum is compared
    exactly against the thresholds; zero or missing demand gives NULL
    supply and status OK. With ``parts``, whole series are dealt into that
    many tasks instead, which pays where a map task holds few rows of each
    series, as of movements dealt by SKU and day.
    """
    latest = as_of_date(latest, inventory, "txn_date")
    if parts:
        inventory = inventory.repartition(parts, "store_id", "sku_id")
    w = Window.partitionBy("store_id", "sku_id").orderBy(F.col("txn_date").desc())
    tail = (inventory.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= window_rows))
    per_series = (tail.groupBy("store_id", "sku_id")
                  .agg(F.sum(F.col("qty_sold").cast("long")).alias("_qty_sum"),
                       F.count("qty_sold").alias("_qty_n"),
                       F.max("txn_date").alias("txn_date"),
                       F.max_by("inventory_on_hand", "txn_date").alias("inventory_on_hand")))
    today = per_series.filter(F.col("txn_date") == latest)
    on_hand, n, total = (F.col("inventory_on_hand").cast("long"), F.col("_qty_n"),
                         F.col("_qty_sum"))
    has_demand = total > 0
    return today.select(
        "store_id", "sku_id", "inventory_on_hand",
        round_ratio(total, n, 1).alias("avg_daily_demand_7d"),
        F.when(has_demand, round_ratio(on_hand * n, total, 1)).alias("days_of_supply"),
        F.when(has_demand & (on_hand * n < total * reorder_days), C.STATUS_REORDER)
         .when(has_demand & (on_hand * n < total * watch_days), C.STATUS_WATCH)
         .otherwise(C.STATUS_OK).alias("inventory_status"),
        F.col("txn_date").alias("signal_date"))


def staffing_summary(staffing: DataFrame, stores: DataFrame) -> DataFrame:
    """Q8: headcount gap per store and role; roles of unknown stores drop."""
    st, s = staffing.alias("st"), stores.alias("s")
    return (st.join(s, F.col("st.store_id") == F.col("s.store_id"))
            .select(F.col("st.store_id"), F.col("s.region"), F.col("st.role"),
                    F.col("st.current_headcount"), F.col("st.budgeted_headcount"),
                    (F.col("st.budgeted_headcount") - F.col("st.current_headcount"))
                    .alias("headcount_gap"),
                    F.col("st.annual_labor_cost"),
                    F.when(F.col("st.current_headcount") < F.col("st.budgeted_headcount"),
                           C.STAFF_UNDERSTAFFED).otherwise(C.STAFF_OK).alias("staffing_status")))
