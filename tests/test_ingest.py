"""Drops of export files into bronze, with a ledger, drift, repeats, replaced files and unreadable records."""

import json
import os
import shutil

import pytest

from aislelens.plans import warehouse as W
from aislelens.session import scratch_path
from aislelens.sources.adapter import Source
from aislelens.sources.ingest import Bronze
from tests.conftest import SMOKE

HEAD = "order_id,customer_id,store_id,order_date,order_value,is_returned"


def put(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write("".join(x + "\n" for x in lines))


def ids(df):
    return sorted(r[0] for r in df.select(df.columns[0]).collect())


@pytest.fixture
def drop(tmp_path):
    return str(tmp_path / "drop here")


@pytest.fixture
def orders(spark):
    return Bronze(spark, scratch_path(spark, "bronze"), "orders_raw")


def test_two_drops_and_a_repeat(spark, orders, drop):
    put(drop, "a.csv", HEAD, "1,10,2,2024-01-01,4.5,false", "2,10,2,2024-01-02,5.5,true")
    assert orders.ingest(drop) == 1 and orders.ingest(drop) is None
    put(drop, "b.csv", HEAD, "3,11,2,2024-01-03,6.5,false")
    put(drop, "copy of a.csv", HEAD, "1,10,2,2024-01-01,4.5,false", "2,10,2,2024-01-02,5.5,true")
    assert orders.ingest(drop) == 2
    assert ids(orders.current()) == [1, 2, 3]
    assert orders.current().filter("order_id = 2").first().asDict() == {
        "order_id": 2, "customer_id": 10, "store_id": 2, "order_date": "2024-01-02", "order_value": 5.5, "is_returned": True}
    ledger = {os.path.basename(r.path): (r.rows, r.unreadable, r.commit) for r in orders.ledger().collect()}
    assert ledger == {"a.csv": (2, 0, 1), "b.csv": (1, 0, 2), "copy%20of%20a.csv": (2, 0, 2)}
    assert ids(orders.feed(1)) == [3]


def test_a_file_replaced(spark, orders, drop):
    put(drop, "a.csv", HEAD, "1,10,2,2024-01-01,4.5,false", "2,10,2,2024-01-02,5.5,true")
    put(drop, "b.csv", HEAD, "3,11,2,2024-01-03,6.5,false")
    orders.ingest(drop)
    put(drop, "a.csv", HEAD, "1,10,2,2024-01-01,4.5,false", "4,10,2,2024-01-02,5.5,true", "5,1,1,2024-01-02,5.5,true")
    orders.ingest(drop)
    assert ids(orders.current()) == [1, 3, 4, 5] and ids(orders.current(until=1)) == [1, 2, 3]
    assert sorted((r.order_id, r._sign) for r in orders.feed(1).collect()) == [(1, -1), (1, 1), (2, -1), (4, 1), (5, 1)]
    put(drop, "c.csv", HEAD, "3,11,2,2024-01-03,6.5,false")  # a copy of b, then b changes: its rows stand through c
    orders.ingest(drop)
    put(drop, "b.csv", HEAD, "9,11,2,2024-01-03,6.5,false")
    orders.ingest(drop)
    assert ids(orders.current()) == [1, 3, 4, 5, 9]


def test_columns_drift_and_records_break(spark, orders, drop):
    put(drop, "a.csv", HEAD, "1,10,2,2024-01-01,4.5,false", "x,1,2,2024-01-01,4.5,false", "2,1", '3,1,1,"2024, May",1,true')
    put(drop, "b.csv", "is_returned,note,order_id,customer_id", "true,late,7,5", "false,,8,6")
    put(drop, "c.csv", "order_id,order_id", "1,2")
    put(drop, "d.csv")
    put(drop, "e.csv", HEAD)
    orders.ingest(drop)
    rows = {r.order_id: r for r in orders.current(extra=True).collect()}
    assert sorted(rows) == [1, 3, 7, 8] and rows[3].order_date == "2024, May"
    assert rows[7]._extra == {"note": "late"} and rows[8]._extra is None and rows[7].order_value is None and rows[7].is_returned
    bad = sorted((os.path.basename(r.file), r.record) for r in orders.unreadable().collect())
    assert bad == [("a.csv", "2,1"), ("a.csv", "x,1,2,2024-01-01,4.5,false"), ("c.csv", "1,2"), ("c.csv", "order_id,order_id")]
    assert sum(r.unreadable for r in orders.ledger().collect()) == 4 and orders.ledger().count() == 5


def test_json_and_parquet(spark, drop):
    said = Bronze(spark, scratch_path(spark, "bronze"), "crm_events_raw", "json")
    put(drop, "a.json", json.dumps({"event_id": 1, "customer_id": 2, "notes": "Hi", "agent": "Eve"}), "{broken", "",
        json.dumps({"event_id": "many", "customer_id": 2}))
    said.ingest(drop)
    row = said.current(extra=True).collect()
    assert [(r.event_id, r.customer_id, r.event_type, r.notes, r._extra) for r in row] == [(1, 2, None, "Hi", {"agent": "Eve"})]
    assert said.unreadable().count() == 2
    table = Bronze(spark, scratch_path(spark, "bronze"), "stores", "parquet")
    folder = scratch_path(spark, "drop")
    spark.createDataFrame([(1, "a", "r")], "store_id int, store_name string, region string").write.parquet(folder)
    spark.createDataFrame([("2", "b", "r", "s", 7), ("two", "b", "r", "s", 8)],
                          "store_id string, store_name string, region string, state string, size int").write.mode("append").parquet(folder)
    table.ingest(folder)
    rows = {r.store_id: r for r in table.current(extra=True).collect()}
    assert sorted(rows) == [1, 2] and rows[1].state is None and rows[2]._extra == {"size": "7"}
    assert json.loads(table.unreadable().first().record)["store_id"] == "two"


def test_a_commit_cut_short_is_not_seen_and_written_anew(spark, orders, drop):
    put(drop, "a.csv", HEAD, "1,10,2,2024-01-01,4.5,false")
    orders.ingest(drop)
    put(drop, "b.csv", HEAD, "2,10,2,2024-01-01,4.5,false")
    orders.ingest(drop)
    root = orders.root.removeprefix("file:")
    shutil.copytree(f"{root}/commit=2", f"{root}/commit=3", ignore=shutil.ignore_patterns("_COMMITTED*", "._COMMITTED*"))
    assert orders.commits() == [1, 2] and ids(orders.current()) == [1, 2]
    put(drop, "c.csv", HEAD, "3,10,2,2024-01-01,4.5,false")
    assert orders.ingest(drop) == 3 and ids(orders.current()) == [1, 2, 3]


def test_refresh_from_drops(spark):
    """The warehouse over ingested drops equals the one over the source tables."""
    drops, wh = scratch_path(spark, "drops"), W.Warehouse(spark, scratch_path(spark, "wh"))
    bronze = Source(spark, SMOKE).bronze()
    for part in (0, 1):
        for name, df in bronze.items():
            key = df.columns[0]
            half = df.filter(f"pmod(hash({key}), 2) = {part}")
            (half.write.mode("append").option("header", "true").csv(f"{drops}/{name}"))
        W.ingest_bronze(wh, drops)
    for name, df in bronze.items():
        got = wh.table(name)
        assert got.columns == df.columns and got.count() == df.count(), name
    W.refresh_silver(wh)
    other = W.Warehouse(spark, scratch_path(spark, "wh"))
    W.refresh_bronze(other, SMOKE)
    W.refresh_silver(other)
    for name in ("customers", "orders", "crm_summary"):
        assert sorted(map(str, wh.table(name).collect())) == sorted(map(str, other.table(name).collect())), name
    assert W.ingest_bronze(wh, drops) == {}
