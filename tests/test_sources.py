"""Export readers (S10) and catalog registration."""

import os

from aislelens.operators import silver
from aislelens.plans import warehouse as W
from aislelens.session import scratch_path
from aislelens.sources.adapter import Source
from aislelens.sources.exports import CORRUPT, EXPORT_RULES, read_export, stream_export
from tests.conftest import SMOKE
from tests.helpers import table


def test_csv_export_round_trip_feeds_silver(spark):
    src = Source(spark, SMOKE)
    root = scratch_path(spark, "exports")
    orders = src.orders_raw.selectExpr("order_id", "customer_id", "store_id",
                                       "cast(order_date as string) as order_date", "order_value", "is_returned")
    orders.write.option("header", "true").csv(os.path.join(root, "orders"))
    back = read_export(spark, "orders_raw", os.path.join(root, "orders"))
    assert dict(back.dtypes)["order_date"] == "string"
    a, b = silver.silver_orders(back.drop(CORRUPT)), silver.silver_orders(src.orders_raw)
    assert table(a.columns, [tuple(r) for r in a.collect()]) == table(b.columns, [tuple(r) for r in b.collect()])
    stream = stream_export(spark, "orders_raw", os.path.join(root, "orders"))
    assert stream.isStreaming and stream.schema == back.schema


def test_malformed_export_rows_stay_and_are_counted(spark):
    from aislelens.operators.quality import expect

    root = scratch_path(spark, "bad-export")
    lines = ["order_id,customer_id,store_id,order_date,order_value,is_returned", "1,2,3,2024-01-01,4.5,false",
             "x,2,3,not a date,many,false"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(root)
    rows, seen = expect(read_export(spark, "orders_raw", root).cache(), EXPORT_RULES)
    got = silver.silver_orders(rows).collect()
    assert sorted((r["order_id"], r["order_date"] is None) for r in got if r["order_id"]) == [(1, False)] and len(got) == 2
    assert seen.get["rows"] == 2 and seen.get["readable"] == 1


def test_register_tables_by_name(spark):
    wh = W.Warehouse(spark, scratch_path(spark, "catalog-wh"))
    W.refresh_bronze(wh, SMOKE)
    wh.register("aisle_test", ["stores", "customers_raw"])
    n = spark.sql("SELECT COUNT(*) AS n FROM aisle_test.customers_raw").first()["n"]
    assert n == wh.table("customers_raw").count()
    assert spark.table("aisle_test.stores").count() == 25
    desc = {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE TABLE EXTENDED aisle_test.stores").collect()}
    assert desc.get("Comment") == W.TABLE_COMMENTS["stores"]


def test_cluster_conf_scales_with_input():
    from aislelens.session import cluster_conf

    small, big = cluster_conf(10 << 20), cluster_conf(100 << 40)
    assert int(small["spark.sql.shuffle.partitions"]) == 200
    assert int(big["spark.sql.shuffle.partitions"]) == 409_600
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
