"""Raw operational exports (CSV / JSON / parquet drops) read with
declared schemas, as batch or as an incremental file stream.

Declared schemas avoid a schema-inference pass over the whole drop. Quality
is warn-only: a malformed CSV or JSON record stays, with what could be read
and its text in ``_corrupt_record``, and is counted by ``EXPORT_RULES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_SCHEMAS = {
    "stores": "store_id long, store_name string, region string, state string",
    "skus": "sku_id long, sku_name string, category string, avg_unit_price double",
    "customers_raw": ("customer_id long, customer_name string, store_id long, age long, segment string, "
                      "preferred_channel string, days_since_join long"),
    "orders_raw": ("order_id long, customer_id long, store_id long, order_date string, order_value double, "
                   "is_returned boolean"),
    "inventory_raw": ("store_id long, sku_id long, txn_date date, qty_sold int, unit_price double, "
                      "inventory_on_hand int"),
    "crm_events_raw": "event_id long, customer_id long, event_type string, event_date string, notes string",
    "staffing_raw": ("store_id long, role string, current_headcount long, budgeted_headcount long, "
                     "annual_labor_cost double"),
}


CORRUPT = "_corrupt_record"
EXPORT_RULES = {"readable": f"{CORRUPT} IS NULL"}     # for quality.expect


def _options(fmt: str) -> dict:
    if fmt not in ("csv", "json"):
        return {}
    return {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT} | ({"header": "true"} if fmt == "csv" else {})


def _schema(table: str, fmt: str) -> str:
    return RAW_SCHEMAS[table] + (f", {CORRUPT} string" if fmt in ("csv", "json") else "")


def read_export(spark: SparkSession, table: str, path: str, fmt: str = "csv") -> DataFrame:
    """A raw table from an export folder, typed by its declared schema."""
    return spark.read.schema(_schema(table, fmt)).format(fmt).options(**_options(fmt)).load(path)


def stream_export(spark: SparkSession, table: str, path: str, fmt: str = "csv",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """The same export as a file stream: each trigger reads only new files."""
    reader = spark.readStream.schema(_schema(table, fmt)).format(fmt).options(**_options(fmt))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)
