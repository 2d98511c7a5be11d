"""Demand signals and forecast (Q9-Q11, Q22) and the dense daily spine
(D-SPINE)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT, Thresholds
from ..functions.exact import MONEY_SCALE, micros, money, round_ratio, round_ratio_long
from .dedup import as_of_date


def demand_signals_exact(inventory: DataFrame, t: Thresholds = DEFAULT, parts: int | None = None) -> DataFrame:
    """Per SKU and day, totals over stores plus trailing short/long ROWS
    averages; keeps the exact sums (``_*``) the forecast rounds from.

    The (sku, day) aggregation comes first, so at any input size the windowed
    series hold one row per SKU and day; they are dealt into ``parts`` tasks
    (default: as the session's shuffles are).
    """
    daily = (inventory.groupBy("sku_id", "txn_date")
             .agg(F.sum(F.col("qty_sold").cast("long")).alias("total_qty_sold"),
                  F.sum(F.col("inventory_on_hand").cast("long")).alias("_inv_sum"),
                  F.count("inventory_on_hand").alias("_inv_n"),
                  F.sum(micros("unit_price")).alias("_price_sum"),
                  F.count("unit_price").alias("_price_n")))
    if parts:
        daily = daily.repartition(parts, "sku_id")
    base = Window.partitionBy("sku_id").orderBy("txn_date")
    w_s = base.rowsBetween(-(t.short_rows - 1), Window.currentRow)
    w_l = base.rowsBetween(-(t.long_rows - 1), Window.currentRow)
    rolled = daily.withColumns({
        "_s_sum": F.sum("total_qty_sold").over(w_s), "_s_n": F.count("total_qty_sold").over(w_s),
        "_l_sum": F.sum("total_qty_sold").over(w_l), "_l_n": F.count("total_qty_sold").over(w_l)})
    cats = F.array(*[F.lit(c) for c in C.FORECAST_CATEGORIES])
    return rolled.withColumns({
        "avg_inventory": F.col("_inv_sum") / F.col("_inv_n"),
        "avg_unit_price": money(F.col("_price_sum")) / F.col("_price_n"),
        "demand_7d_avg": round_ratio(F.col("_s_sum"), F.col("_s_n"), 1),
        "demand_14d_avg": round_ratio(F.col("_l_sum"), F.col("_l_n"), 1),
        "_t7": round_ratio_long(F.col("_s_sum") * 10, F.col("_s_n")),
        "_t14": round_ratio_long(F.col("_l_sum") * 10, F.col("_l_n")),
        "sku_name": F.concat(F.lit(C.FORECAST_SKU_PREFIX), F.col("sku_id").cast("string")),
        "category": F.element_at(cats, (F.col("sku_id") % len(C.FORECAST_CATEGORIES) + 1).cast("int"))})


SIGNAL_COLUMNS = ["sku_id", "sku_name", "category", "txn_date", "total_qty_sold", "avg_inventory",
                  "avg_unit_price", "demand_7d_avg", "demand_14d_avg"]


def demand_signals(inventory: DataFrame, t: Thresholds = DEFAULT, parts: int | None = None) -> DataFrame:
    """Q9: the per-SKU daily demand series with rolling averages."""
    return demand_signals_exact(inventory, t, parts).select(*SIGNAL_COLUMNS)


def demand_forecast(signals_exact: DataFrame, t: Thresholds = DEFAULT, latest=None) -> DataFrame:
    """Q10: latest day per SKU -> trend (rounded averages, +/- band),
    ``horizon`` day projection and confidence. SKUs without a row on the
    single latest day drop, as in the source job. ``latest`` (date or
    Column) defaults to the latest day of the signals."""
    latest = as_of_date(latest, signals_exact, "txn_date")
    band = round(t.band * 100)
    t7, t14 = F.col("_t7"), F.col("_t14")
    trend = (F.when(t7 * 100 > t14 * (100 + band), C.TREND_UP)
             .when(t7 * 100 < t14 * (100 - band), C.TREND_DOWN).otherwise(C.TREND_FLAT))
    return (signals_exact.filter(F.col("txn_date") == latest)
            .select("sku_id", "sku_name", "category", "demand_7d_avg", "demand_14d_avg", trend.alias("trend"),
                    round_ratio_long(t7 * t.horizon_days, F.lit(10)).cast("int").alias("predicted_units_7d"),
                    F.when(trend == C.TREND_DOWN, C.CONFIDENCE_DOWN).otherwise(C.CONFIDENCE_OTHER).alias("confidence"),
                    F.col("txn_date").alias("signal_date"),
                    round_ratio(F.col("_price_sum"), F.col("_price_n") * MONEY_SCALE, 2).alias("avg_unit_price")))


def top_demand(forecast: DataFrame, k: int) -> DataFrame:
    """Q11 (k=10): top SKUs by 7-day demand; sku_id breaks ties."""
    return (forecast.orderBy(F.col("demand_7d_avg").desc(), F.col("sku_id").asc()).limit(k)
            .select("sku_id", "sku_name", "category", "demand_7d_avg", "trend", "predicted_units_7d"))


def demand_serving(forecast: DataFrame, k: int = 20) -> DataFrame:
    """Q22: the forecast list served to the dashboard."""
    return (forecast.orderBy(F.col("demand_7d_avg").desc(), F.col("sku_id").asc()).limit(k)
            .select("sku_id", "sku_name", "category", "trend", "demand_7d_avg", "predicted_units_7d",
                    "confidence", "avg_unit_price"))


def daily_spine(inventory: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """D-SPINE: every observed (store, sku) series densified to one row per
    calendar day between its own first and last day.

    Days without a row are stock-outs (qty and on-hand 0). Adds a
    calendar-true trailing average over ``short_rows`` days. The calendar
    comes from ``explode(sequence)`` per series, never from a cross join,
    and the series' bounds are one map-side combined aggregate.
    """
    series = inventory.groupBy("store_id", "sku_id").agg(F.min("txn_date").alias("_first"),
                                                         F.max("txn_date").alias("_last"))
    spine = series.select("store_id", "sku_id",
                          F.explode(F.sequence("_first", "_last", F.expr("INTERVAL 1 DAY"))).alias("txn_date"))
    facts = inventory.select("store_id", "sku_id", "txn_date", "qty_sold", "unit_price",
                             "inventory_on_hand")
    w = (Window.partitionBy("store_id", "sku_id").orderBy("txn_date")
         .rowsBetween(-(t.short_rows - 1), Window.currentRow))
    on_hand = F.coalesce(F.col("inventory_on_hand"), F.lit(0))
    qty = F.coalesce(F.col("qty_sold"), F.lit(0))
    dense = (spine.join(facts, ["store_id", "sku_id", "txn_date"], "left")
             .withColumns({
                 "is_observed": F.col("qty_sold").isNotNull() | F.col("inventory_on_hand").isNotNull(),
                 "is_stockout": on_hand == 0,
                 "_sum": F.sum(qty.cast("long")).over(w),
                 "_n": F.count(F.lit(1)).over(w)})
             .withColumns({"qty_sold": qty, "inventory_on_hand": on_hand}))
    return dense.select("store_id", "sku_id", "txn_date", "is_observed", "is_stockout", "qty_sold", "unit_price",
                        "inventory_on_hand", (F.col("_sum") / F.col("_n")).alias("demand_7d_calendar_avg"))


def spine_summary_direct(inventory: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """``spine_summary(daily_spine(inventory))`` without the days between rows.

    Counts of days follow from a series' first and last day by arithmetic. A
    trailing calendar average can only peak on a day with a row, on the day
    before one, on the day a row has left the window, or on the first day
    whose window is whole; these few days per row stand in for the calendar,
    and a range window over them adds up the rows of each one's last days.
    """
    n = t.short_rows
    key = ["store_id", "sku_id"]
    rows = inventory.filter("txn_date IS NOT NULL").select(*key, F.unix_date("txn_date").alias("_day"),
                                                           "qty_sold", "inventory_on_hand")

    def day(shift: int, real: bool):
        return F.struct((F.col("_day") + shift).alias("_day"), F.lit(real).alias("_real"),
                        (F.coalesce(F.col("qty_sold"), F.lit(0)) if real else F.lit(0)).cast("long").alias("_qty"))

    days = rows.select(*key, "qty_sold", "inventory_on_hand", F.explode(F.array(
        day(0, True), day(-1, False), day(n - 1, False), day(n, False))).alias("_at"))
    days = days.select(*key, "_at.*", "qty_sold", "inventory_on_hand")
    series = Window.partitionBy(*key)
    real_day = F.when(F.col("_real"), F.col("_day"))
    held = days.withColumns({"_first": F.min(real_day).over(series), "_last": F.max(real_day).over(series)})
    trailing = series.orderBy("_day").rangeBetween(-(n - 1), Window.currentRow)
    held = (held.withColumn("_sum", F.sum("_qty").over(trailing))
            .withColumn("_n", F.least(F.lit(n), F.col("_day") - F.col("_first") + 1)))
    inside = F.col("_day").between(F.col("_first"), F.col("_last"))
    seen = F.col("_real") & (F.col("qty_sold").isNotNull() | F.col("inventory_on_hand").isNotNull())
    total = (F.max("_last") - F.min("_first") + 1).cast("long")
    return held.groupBy(*key).agg(
        F.date_from_unix_date(F.min("_first")).alias("first_day"), F.date_from_unix_date(F.max("_last")).alias("last_day"),
        total.alias("days"), F.count_if(seen).alias("observed_days"),
        (total - F.count_if(F.col("_real") & (F.coalesce("inventory_on_hand", F.lit(0)) != 0))).alias("stockout_days"),
        F.sum("_qty").alias("units"), F.max(F.when(inside, F.col("_sum") / F.col("_n"))).alias("peak_demand_7d"))


def spine_summary(spine: DataFrame) -> DataFrame:
    """Per series of the dense spine: its days, observed and stock-out days,
    units and highest calendar-true average."""
    return spine.groupBy("store_id", "sku_id").agg(
        F.min("txn_date").alias("first_day"), F.max("txn_date").alias("last_day"),
        F.count(F.lit(1)).alias("days"), F.count_if("is_observed").alias("observed_days"),
        F.count_if("is_stockout").alias("stockout_days"), F.sum("qty_sold").alias("units"),
        F.max("demand_7d_calendar_avg").alias("peak_demand_7d"))
