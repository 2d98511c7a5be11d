"""ST1: the profile after change feeds equals the batch profile, and only changed buckets are read and written."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from aislelens.operators import gold, silver
from aislelens.plans.versions import Versions
from aislelens.session import scratch_path
from aislelens.streaming import profile as P
from tests.helpers import canon

STORES = [(1, "S1", "East", "E1"), (2, "S2", "West", "W1")]
DAY = dt.date(2024, 6, 1)


def batch(spark, state):
    customers, orders, events = frames(spark, state)
    stores = spark.createDataFrame(STORES, "store_id long, store_name string, region string, state string")
    features = gold.order_features(orders)
    return stores, gold.customer_360(customers, stores, features, silver.crm_summary(events), audit=False)


def frames(spark, state):
    return [spark.createDataFrame(sorted(state[t], key=str), P.SCHEMAS[t]) for t in ("customers", "orders", "events")]


def rows(df):
    return sorted(canon(tuple(r)) for r in df.collect())


def random_state(rng, state=None):
    """A new state, or the given one after inserts, updates and deletes."""
    old = state or {"customers": [], "orders": [], "events": []}
    keep = {t: [r for r in old[t] if rng.random() > 0.25] for t in old}
    ids = {t: {r[0] for r in keep[t]} for t in keep}
    new = {
        "customers": [(i, rng.choice("abc"), rng.choice([1, 2, 9, None]), 30, "seg", "web", 5) for i in range(40)],
        "orders": [(i, rng.choice([*range(45), None]), None if rng.random() < 0.1 else DAY + dt.timedelta(rng.randint(-150, 10)),
                    rng.choice([1.5, 20.25, None]), rng.choice([True, False, None])) for i in range(120)],
        "events": [(i % 70, rng.choice([*range(45), None]), rng.choice(["complaint", "return_request", "call", None]),
                    rng.choice([None, DAY - dt.timedelta(rng.randint(0, 50))])) for i in range(80)],
    }
    return {t: keep[t] + [r for r in new[t] if (t == "events" or r[0] not in ids[t]) and rng.random() < 0.8] for t in keep}


@pytest.mark.parametrize("seed", range(3))
def test_feeds_equal_the_batch(spark, seed):
    rng = random.Random(seed)
    store = P.ProfileStore(spark, scratch_path(spark, "profile"), buckets=5)
    before = {"customers": [], "orders": [], "events": []}
    for _ in range(4):
        after = random_state(rng, before)
        feeds = [P.signed_changes(a, b) for a, b in zip(frames(spark, before), frames(spark, after), strict=True)]
        store.refresh(*feeds)
        stores, want = batch(spark, after)
        assert rows(store.profile(stores)) == rows(want)
        before = after


def test_only_changed_buckets_and_the_window_moves(spark):
    store = P.ProfileStore(spark, scratch_path(spark, "profile"), buckets=16)
    days = {c: DAY - dt.timedelta(80 if c < 5 else 10) for c in range(200)}
    state = {"customers": [(c, "n", 1, 30, "s", "web", 1) for c in range(200)],
             "orders": [(c, c, days[c], 10.0, False) for c in range(200)] + [(900, 7, DAY, 1.0, False)], "events": []}
    store.refresh(*[f.withColumn("_sign", F.lit(1)) for f in frames(spark, state)])
    first = Versions(spark, store.root).read()
    order = spark.createDataFrame([(901, 8, DAY, 5.0, True, 1)], P.ORDERS + ", _sign int")
    store.refresh(orders=order)
    second = Versions(spark, store.root).read()
    moved = {b for t in ("orders", "features") for b in first["tables"][t] if first["tables"][t][b] != second["tables"][t][b]}
    assert len(moved) == 1 and all(v == {int(b) for b in moved} for v in store.touched.values())
    assert first["tables"]["customers"] == second["tables"]["customers"]
    late = spark.createDataFrame([(902, 9, DAY + dt.timedelta(20), 5.0, True, 1)], P.ORDERS + ", _sign int")
    store.refresh(orders=late)  # customers 0 to 4 leave the window without a row of their own
    state["orders"] += [(901, 8, DAY, 5.0, True), (902, 9, DAY + dt.timedelta(20), 5.0, True)]
    stores, want = batch(spark, state)
    assert rows(store.profile(stores)) == rows(want)
    assert store.profile(stores).filter("customer_id < 5 AND order_count_90d = 0").count() == 5
    assert len(store.touched["features"]) <= 6
    assert rows(store.profile(stores, version=1)) != rows(want)  # older versions stay readable
    store.versions.retire(keep=1)
    assert rows(store.profile(stores)) == rows(want)
    gone = spark.createDataFrame([(902, 9, DAY + dt.timedelta(20), 5.0, True, -1)], P.ORDERS + ", _sign int")
    store.refresh(orders=gone)  # the window moves back
    state["orders"].pop()
    assert rows(store.profile(stores)) == rows(batch(spark, state)[1])


def test_a_refresh_that_dies_leaves_the_last_version(spark, monkeypatch):
    store = P.ProfileStore(spark, scratch_path(spark, "profile"), buckets=4)
    state = random_state(random.Random(9))
    store.refresh(*[f.withColumn("_sign", F.lit(1)) for f in frames(spark, state)])
    stores, want = batch(spark, state)
    extra = spark.createDataFrame([(500, 3, DAY, 5.0, True, 1)], P.ORDERS + ", _sign int")
    with monkeypatch.context() as m:
        m.setattr(Versions, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.refresh(orders=extra)
    assert rows(store.profile(stores)) == rows(want)
    store.refresh(orders=extra)
    state["orders"].append((500, 3, DAY, 5.0, True))
    assert rows(store.profile(stores)) == rows(batch(spark, state)[1])


def test_from_drops(spark, tmp_path):
    """Export files, repeats and a replaced file, refreshed step by step, equal the batch over what stands."""
    drops, root = str(tmp_path / "drops"), scratch_path(spark, "drops-refresh")

    def put(table, name, header, *lines):
        os.makedirs(f"{drops}/{table}", exist_ok=True)
        with open(f"{drops}/{table}/{name}", "w") as f:
            f.write("\n".join([header, *lines]) + "\n")

    oh, ch = "order_id,customer_id,store_id,order_date,order_value,is_returned", "customer_id,customer_name,store_id,age,segment,preferred_channel,days_since_join"
    eh = "event_id,customer_id,event_type,event_date,notes"
    put("customers_raw", "a.csv", ch, *[f"{c},n{c},1,{20 + c},s,web,{c}" for c in range(30)])
    put("orders_raw", "a.csv", oh, *[f"{o},{o % 30},1,2024-0{1 + o % 6}-10,{o}.5,{'true' if o % 7 == 0 else 'false'}" for o in range(100)])
    put("crm_events_raw", "a.csv", eh, *[f"{e},{e % 30},complaint,2024-05-0{1 + e % 9},x" for e in range(50)])
    store = P.refresh_from_drops(spark, drops, root, buckets=4)
    assert store.versions.numbers() == [1]
    P.refresh_from_drops(spark, drops, root)
    assert store.versions.numbers() == [1]  # no news
    put("orders_raw", "b.csv", oh, "3,4,1,2024-06-30,99.5,true", "200,5,1,2024-09-01,1.25,false", "201,6,1,not a day,2,true")
    put("orders_raw", "copy.csv", oh, "3,4,1,2024-06-30,99.5,true", "200,5,1,2024-09-01,1.25,false", "201,6,1,not a day,2,true")
    put("customers_raw", "a.csv", ch, *[f"{c},n{c},2,{20 + c},t,web,{c}" for c in range(2, 35)])
    put("crm_events_raw", "b.csv", eh, "7,3,return_request,2024-06-01,y", "7,3,return_request,2024-06-01,y")
    store = P.refresh_from_drops(spark, drops, root)
    from aislelens.sources.ingest import Bronze

    raw = {t: Bronze(spark, f"{root}/{t}", t).current() for t in ("customers_raw", "orders_raw", "crm_events_raw")}
    stores = spark.createDataFrame(STORES, "store_id long, store_name string, region string, state string")
    want = gold.customer_360(silver.silver_customers(raw["customers_raw"]), stores,
                             gold.order_features(silver.silver_orders(raw["orders_raw"])),
                             silver.crm_summary(P._events(raw["crm_events_raw"])), audit=False)
    got = rows(store.profile(stores))
    assert got == rows(want) and len(got) == 33 and store.buckets == 4
