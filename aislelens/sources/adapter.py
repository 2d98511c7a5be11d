"""Raw (bronze) retail tables derived from the driver's parquet tables.

The pipeline expects five operational tables (customers, orders, inventory,
CRM events, staffing) plus store and SKU dimensions. Here they are views over
the TPC-H-like test tables: nations are stores, suppliers staff them, line
items are inventory movements and the event log is the CRM feed. Every view
is a plain projection/join so Catalyst prunes columns and pushes filters into
the parquet scans.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]

EPOCH = "1995-01-01"   # day zero of the synthetic on-hand rule
PART_LINES = 250_000   # line items that a task groups, sorts and windows, on average


def _case(key: Column, mapping: dict, default=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v)))
    return out.otherwise(F.lit(default)) if default is not None else out


def crm_from_events(events: DataFrame) -> DataFrame:
    """CRM events (bronze) from the raw event log; batch or stream."""
    etype = _case(F.col("event_type"), C.CRM_EVENT_TYPES, C.CRM_DEFAULT_EVENT_TYPE)
    return (events.select(F.col("event_id"),
                          F.col("user_id").alias("customer_id"),
                          etype.alias("event_type"),
                          F.col("ts").cast("date").alias("event_date"))
            .withColumn("notes", F.concat(F.lit(C.NOTE_PARTS[0]), F.col("customer_id").cast("string"),
                                          F.lit(C.NOTE_PARTS[1]), F.col("event_type"),
                                          F.lit(C.NOTE_PARTS[2]))))


def orders_view(o: DataFrame, c: DataFrame) -> DataFrame:
    """Orders (bronze) from the raw orders, batch or stream; an order of an
    unknown customer stays, without a store."""
    return (o.join(c.select("c_custkey", "c_nationkey"), o.o_custkey == c.c_custkey, "left")
            .select(F.col("o_orderkey").alias("order_id"),
                    F.col("o_custkey").alias("customer_id"),
                    F.col("c_nationkey").cast("long").alias("store_id"),
                    F.col("o_orderdate").cast("date").alias("order_date"),
                    F.col("o_totalprice").alias("order_value"),
                    (F.col("o_orderkey") % 8 == 0).alias("is_returned")))


class Source:
    """Lazily read driver tables and the bronze views built over them."""

    def __init__(self, spark: SparkSession, sf_dir: str, lag_days: int = 0):
        """``lag_days`` > 0 gives the sources as they stood that many days
        before their latest order / event (for snapshot comparisons)."""
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.lag_days = lag_days

    def _lagged(self, df: DataFrame, column: str) -> DataFrame:
        if not self.lag_days:
            return df
        cutoff = F.date_sub(df.agg(F.max(column)).scalar(), self.lag_days)
        return df.filter(F.col(column) <= cutoff)

    def table(self, name: str) -> DataFrame:
        """Read a table by name."""
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _dimension(self, name: str, *columns: str) -> DataFrame:
        """A dimension to join facts with by its key. One of more rows than a task's share is dealt by the key and
        held as a map by each task: it is not broadcast, and the facts stream past it instead of being sorted."""
        df = self.table(name).select(*columns)
        return df.hint("shuffle_hash") if self.table(name).count() > PART_LINES else df

    # -- dimensions --------------------------------------------------------
    @cached_property
    def stores(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return (nation.join(region, nation.n_regionkey == region.r_regionkey)
                .select(F.col("n_nationkey").cast("long").alias("store_id"),
                        F.col("n_name").alias("store_name"),
                        F.col("r_name").alias("region"),
                        F.col("n_name").alias("state")))

    @cached_property
    def skus(self) -> DataFrame:
        cats = F.array(*[F.lit(c) for c in C.SKU_CATEGORIES])
        prices = F.array(*[F.lit(C.SKU_CATEGORY_PRICE[c]) for c in C.SKU_CATEGORIES])
        pos = (F.pmod(F.col("sku_id") - 1, F.lit(len(C.SKU_CATEGORIES))) + 1).cast("int")
        return (self.table("part").select(F.col("p_partkey").cast("long").alias("sku_id")).distinct()
                .select("sku_id",
                        F.format_string(C.SKU_NAME_FORMAT, F.col("sku_id")).alias("sku_name"),
                        F.element_at(cats, pos).alias("category"),
                        F.element_at(prices, pos).alias("avg_unit_price")))

    # -- bronze facts ------------------------------------------------------
    @cached_property
    def customers_raw(self) -> DataFrame:
        c = self.table("customer")
        channel = F.element_at(F.array(*[F.lit(x) for x in C.CUSTOMER_CHANNELS]),
                               (F.col("c_custkey") % 3 + 1).cast("int"))
        return c.select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.col("c_nationkey").cast("long").alias("store_id"),
            (F.col("c_custkey") % 50 + 22).alias("age"),
            F.col("c_mktsegment").alias("segment"),
            channel.alias("preferred_channel"),
            (F.col("c_custkey") % 365).alias("days_since_join"))

    @cached_property
    def orders_raw(self) -> DataFrame:
        return self._lagged(orders_view(self.table("orders"), self.table("customer")), "order_date")

    @cached_property
    def crm_events_raw(self) -> DataFrame:
        return self._lagged(crm_from_events(self.table("events")), "event_date")

    @cached_property
    def inventory_parts(self) -> int:
        """Into how many parts the movements are dealt: by the counted lines, so a task's share stays the same."""
        lines = self.table("lineitem").count()  # from the files' footers
        return max(self.spark.sparkContext.defaultParallelism, math.ceil(lines / PART_LINES))

    @cached_property
    def inventory_raw(self) -> DataFrame:
        li = self.table("lineitem")
        s = self._dimension("supplier", "s_suppkey", "s_nationkey")
        p = self._dimension("part", "p_partkey", "p_retailprice")
        day = F.col("l_shipdate").cast("date")
        dn = F.datediff(day, F.lit(EPOCH).cast("date"))
        on_hand = (F.when((dn + F.col("l_partkey")) % 10 == 0, F.lit(0))
                   .otherwise(10 + (dn * 7 + F.col("l_partkey") * 3) % 80)).cast("int")
        # a line whose supplier or part is unknown stays (store or price null): bronze loses no units
        lines = (li.select("l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
                 .join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left")
                 .join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
                 .select(F.col("s_nationkey").cast("long").alias("store_id"),
                         F.col("l_partkey").cast("long").alias("sku_id"),
                         day.alias("txn_date"),
                         F.col("l_quantity").cast("long").alias("qty_sold"),
                         F.col("p_retailprice").alias("unit_price"),
                         on_hand.alias("inventory_on_hand")))
        # one movement per store, SKU and day: units add up; price and on-hand are functions
        # of the part and the day, so all lines of a movement agree on them. The lines are dealt
        # out before they are grouped (nearly each is a movement of its own, and a map over a
        # file split would hold them all); groups by SKU and day need no other exchange
        return (lines.repartition(self.inventory_parts, "sku_id", "txn_date")
                .groupBy("store_id", "sku_id", "txn_date")
                .agg(F.sum("qty_sold").alias("qty_sold"), F.max("unit_price").alias("unit_price"),
                     F.max("inventory_on_hand").alias("inventory_on_hand")))

    @cached_property
    def staffing_raw(self) -> DataFrame:
        s = self.table("supplier")
        role_i = (F.col("s_suppkey") % 4).cast("int")
        return (s.groupBy(F.col("s_nationkey").alias("nk"), role_i.alias("role_i"))
                .agg(F.count(F.lit(1)).alias("n"))
                .select(F.col("nk").cast("long").alias("store_id"),
                        F.element_at(F.array(*[F.lit(r) for r in C.STAFF_ROLES]),
                                     F.col("role_i") + 1).alias("role"),
                        F.col("n").alias("current_headcount"),
                        (F.col("n") + F.col("nk") % 2).alias("budgeted_headcount"),
                        (F.col("n") * (35000 + F.col("role_i") * 5000)).cast("double")
                        .alias("annual_labor_cost")))

    def bronze(self) -> dict[str, DataFrame]:
        """The five bronze datasets plus the two dimensions."""
        return {"customers_raw": self.customers_raw, "orders_raw": self.orders_raw,
                "inventory_raw": self.inventory_raw, "crm_events_raw": self.crm_events_raw,
                "staffing_raw": self.staffing_raw, "stores": self.stores, "skus": self.skus}

    # -- text inputs -------------------------------------------------------
    @cached_property
    def questions(self) -> DataFrame:
        """Assistant questions: the suggested six plus every user turn."""
        suggested = self.spark.createDataFrame(
            [(f"suggested-{i}", q) for i, q in enumerate(C.SUGGESTED_QUESTIONS)],
            "question_id string, question string")
        turns = (self.table("conversations").filter(F.col("role") == "user")
                 .select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit("-"),
                                  F.col("turn").cast("string")).alias("question_id"),
                         F.col("text").alias("question")))
        return suggested.unionByName(turns)
