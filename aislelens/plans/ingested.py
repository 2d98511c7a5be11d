"""S10/F1 as registered queries: the raw tables exported as drops of files, ingested, and read as bronze."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import silver
from ..session import scratch_path
from ..sources.adapter import Source
from ..sources.ingest import Bronze

#: Columns of the export in which order dates are text.
ORDER_COLUMNS = ["order_id", "customer_id", "store_id", "order_date", "order_value", "is_returned"]
BROKEN_EACH = 97                  # a customer export has a broken record after each so many customers


def _drop(df: DataFrame, folder: str, fmt: str) -> None:
    writer = df.write.mode("append")
    (writer.option("header", "true") if fmt == "csv" else writer).format(fmt).save(folder)


def orders_bronze(spark: SparkSession, sf_dir: str) -> Bronze:
    """Orders from CSV files in three drops: half of them; the other half and the first ones again under other
    names; and nothing new."""
    orders = Source(spark, sf_dir).orders_raw.select(*ORDER_COLUMNS)
    text = orders.withColumn("order_date", F.col("order_date").cast("string"))
    folder, root = scratch_path(spark, "orders-drop"), scratch_path(spark, "orders-bronze")
    even = F.col("order_id") % 2 == 0
    bronze = Bronze(spark, root, "orders_raw", "csv")
    _drop(text.filter(even), folder, "csv")
    bronze.ingest(folder)
    _drop(text.filter(~even), folder, "csv")
    _drop(text.filter(even), folder, "csv")
    bronze.ingest(folder)
    bronze.ingest(folder)
    return bronze


def orders_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_bronze(spark, sf_dir).current()


def silver_orders_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2 over the ingested orders, whose dates are strings (F1)."""
    return silver.silver_orders(orders_ingested(spark, sf_dir))


def customers_bronze(spark: SparkSession, sf_dir: str) -> Bronze:
    """Customers from JSON files whose layout drifts: the first drop has no channel, the second one has a column
    that is not declared, and some records are broken."""
    customers = Source(spark, sf_dir).customers_raw
    folder, root = scratch_path(spark, "customers-drop"), scratch_path(spark, "customers-bronze")
    even = F.col("customer_id") % 2 == 0
    bronze = Bronze(spark, root, "customers_raw", "json")
    _drop(customers.filter(even).drop("preferred_channel"), os.path.join(folder, "old"), "json")
    bronze.ingest(folder)
    loyal = (F.col("customer_id") % 5).cast("string").alias("loyalty")
    _drop(customers.filter(~even).select("*", loyal), os.path.join(folder, "new"), "json")
    broken = customers.filter(F.col("customer_id") % BROKEN_EACH == 0)
    _drop(broken.select(F.concat(F.lit('{"customer_id": '), F.col("customer_id").cast("string"), F.lit(', "cut').alias("value"))),
          os.path.join(folder, "broken"), "text")
    bronze.ingest(folder)
    return bronze


def customers_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers_bronze(spark, sf_dir).current(extra=True)
    return rows.withColumn("loyalty", F.col("_extra")["loyalty"]).drop("_extra")


def customers_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers_bronze(spark, sf_dir).unreadable().select("record")


def ingest_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger by commit: records read, of which unreadable; copies count where they were delivered."""
    ledger = customers_bronze(spark, sf_dir).ledger()
    return ledger.groupBy("commit").agg(F.sum("rows").alias("rows"), F.sum("unreadable").alias("unreadable"))
