"""Silver layer (Q1-Q4): typed, de-duplicated tables and the CRM summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from .dedup import as_of_date, keep_first


def silver_customers(raw: DataFrame) -> DataFrame:
    """Q1: ints cast, one row per customer_id."""
    typed = raw.withColumns({"age": F.col("age").try_cast("int"),
                             "days_since_join": F.col("days_since_join").try_cast("int")})
    order = [F.col(c).asc_nulls_first() for c in
             ["customer_name", "store_id", "age", "segment", "preferred_channel", "days_since_join"]]
    return keep_first(typed, ["customer_id"], order)


# which of several rows of an order stays: the latest, then a total order on the rest
def order_survivor() -> list[Column]:
    return [F.col("order_date").desc_nulls_last()] + [
        F.col(c).asc_nulls_first() for c in ["customer_id", "store_id", "order_value", "is_returned"]]


def silver_orders(raw: DataFrame) -> DataFrame:
    """Q2: date parsed, value/flag typed, one row per order_id (``order_survivor``)."""
    return keep_first(typed_orders(raw), ["order_id"], order_survivor())


def typed_orders(raw: DataFrame) -> DataFrame:
    """Orders with date, value and flag typed; what does not parse is NULL."""
    date = F.col("order_date")
    if isinstance(raw.schema["order_date"].dataType, T.StringType):
        date = F.try_to_date(date)
    return raw.withColumns({"order_date": date,
                            "order_value": F.col("order_value").try_cast("double"),
                            "is_returned": F.col("is_returned").try_cast("boolean")})


def recent_orders(raw: DataFrame, since: Column) -> DataFrame:
    """``silver_orders(raw)`` from the day ``since`` on, read no further back.

    The latest date is the first survivor key, so an order whose survivor is
    recent has all its recent rows here, and one whose survivor is older has
    none: filtering before the dedup gives the same rows, and the filter
    reaches the scan instead of shuffling the whole history.
    """
    recent = typed_orders(raw).filter(F.col("order_date") >= since)
    return keep_first(recent, ["order_id"], order_survivor())


def inventory_rolled(raw: DataFrame, window_rows: int = C.ROLLING_SHORT_ROWS) -> DataFrame:
    """Q3 with the exact window sum/count kept (``_qty_sum``, ``_qty_n``).

    One survivor per (store, sku, date): highest qty, then price, then
    on-hand. The trailing average is over ROWS, not days (a gap in the
    calendar widens it), and short at the start of a series.
    """
    survivors = keep_first(raw, ["store_id", "sku_id", "txn_date"],
                           [F.col("qty_sold").desc_nulls_last(), F.col("unit_price").desc_nulls_last(),
                            F.col("inventory_on_hand").desc_nulls_last()])
    return with_window_sums(survivors, window_rows).withColumn(
        "avg_daily_demand_7d", F.col("_qty_sum") / F.col("_qty_n"))


def with_window_sums(inventory: DataFrame, window_rows: int = C.ROLLING_SHORT_ROWS) -> DataFrame:
    """Exact trailing-``window_rows`` sum and count of qty_sold per
    (store, sku) series, ordered by day."""
    w = (Window.partitionBy("store_id", "sku_id").orderBy("txn_date")
         .rowsBetween(-(window_rows - 1), Window.currentRow))
    return inventory.withColumns({"_qty_sum": F.sum(F.col("qty_sold").cast("long")).over(w),
                                  "_qty_n": F.count("qty_sold").over(w)})


def silver_inventory(raw: DataFrame, window_rows: int = C.ROLLING_SHORT_ROWS,
                     audit: bool = True) -> DataFrame:
    """Q3: deduplicated inventory with the trailing 7-row demand average."""
    cols = ["store_id", "sku_id", "txn_date", "qty_sold", "unit_price", "inventory_on_hand",
            "avg_daily_demand_7d"]
    out = inventory_rolled(raw, window_rows).select(*cols)
    return out.withColumn("load_ts", F.current_timestamp()) if audit else out


def _as_date(df: DataFrame, column: str) -> Column:
    """A date column; strings that are no date become NULL instead of ending the job."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.try_to_date(F.col(column))
    return F.col(column).try_cast("date")


def crm_summary(events: DataFrame, as_of=None) -> DataFrame:
    """Q4: per-customer event counts, last contact and days since it."""
    day = as_of_date(as_of, events, "event_date")
    return (events.groupBy("customer_id")
            .agg(F.count(F.lit(1)).alias("total_events"),
                 F.count_if(F.col("event_type") == C.EVENT_COMPLAINT).alias("complaints"),
                 F.count_if(F.col("event_type") == C.EVENT_RETURN_REQUEST).alias("return_requests"),
                 F.max(_as_date(events, "event_date")).alias("last_contact_date"))
            .withColumn("days_since_last_contact", F.datediff(day, F.col("last_contact_date"))))
