"""Hot keys: one key holding most rows must give the same result as brute force."""

import datetime as dt
import random


from aislelens import config as C
from aislelens.operators import corpus, gold, silver
from tests.conftest import SMOKE


def test_hot_customer_notes_merge_in_order(spark):
    rnd = random.Random(7)
    rows = []
    for eid in rnd.sample(range(100_000), 3000):
        cust = 1 if rnd.random() < 0.7 else rnd.randint(2, 20)          # customer 1 holds ~70 %
        rows.append((eid, cust, dt.date(2024, 1, 1 + rnd.randint(0, 9)), f"n{eid}"))
    ev = spark.createDataFrame(rows, "event_id long, customer_id long, event_date date, notes string")
    got = {r["customer_id"]: r["all_notes"] for r in corpus.customer_notes(ev, block_rows=64, chunk_rows=10 ** 6).collect()}
    parts = corpus.customer_notes(ev, block_rows=64, chunk_rows=200).orderBy("customer_id", "chunk_no").collect()
    again = {}
    for r in parts:                                   # nothing is lost, and every chunk is bounded
        assert r["all_notes"].count(C.NOTES_SEP) + 1 < 200 + 64
        again[r["customer_id"]] = C.NOTES_SEP.join(filter(None, [again.get(r["customer_id"]), r["all_notes"]]))
    assert again == got and len(parts) > len(got)
    want = {}
    for eid, cust, day, note in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        want.setdefault(cust, []).append(note)
    assert got == {c: "; ".join(v) for c, v in want.items()}


def test_hot_customer_features_and_crm(spark):
    rnd = random.Random(3)
    day = dt.date(2024, 3, 31)
    orders = [(i, 1 if i % 3 else rnd.randint(2, 50), 1, day - dt.timedelta(days=rnd.randint(0, 120)),
               round(rnd.uniform(1, 500), 2), i % 8 == 0) for i in range(5000)]
    df = spark.createDataFrame(orders, "order_id long, customer_id long, store_id long, order_date date, "
                                       "order_value double, is_returned boolean")
    got = {r["customer_id"]: (r["order_count_90d"], r["total_spend_90d"]) for r in
           gold.order_features(df, day).collect()}
    want = {}
    for _, c, _, d, v, _ in orders:
        if d >= day - dt.timedelta(days=90):
            n, s = want.get(c, (0, 0))
            want[c] = (n + 1, s + round(v * 100))
    assert got == {c: (n, s / 100.0) for c, (n, s) in want.items()}
    ev = spark.createDataFrame([(i, 7 if i % 2 else i % 11, "complaint" if i % 5 == 0 else "inquiry", day)
                                for i in range(4000)],
                               "event_id long, customer_id long, event_type string, event_date date")
    crm = {r["customer_id"]: (r["total_events"], r["complaints"]) for r in silver.crm_summary(ev, day).collect()}
    assert crm[7] == (2000 + sum(1 for i in range(0, 4000, 2) if i % 11 == 7),
                      sum(1 for i in range(4000) if (i % 2 or i % 11 == 7) and i % 5 == 0 and
                          (7 if i % 2 else i % 11) == 7))


def test_inventory_is_dealt_by_its_lines(spark, monkeypatch):
    from aislelens.plans.datasets import Datasets
    from aislelens.sources import adapter

    want = {tuple(r) for r in Datasets(spark, SMOKE).demand_signals.collect()}
    monkeypatch.setattr(adapter, "PART_LINES", 200)
    p = Datasets(spark, SMOKE)
    parts = -(-p.src.table("lineitem").count() // 200)
    assert parts > 20 and p.src.inventory_parts == parts
    assert p.src.inventory_raw.rdd.getNumPartitions() == p.demand_signals.rdd.getNumPartitions() == parts
    assert {tuple(r) for r in p.demand_signals.collect()} == want
    plan = p.src.inventory_raw._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("HashAggregate") == plan[:plan.index("REPARTITION_BY_NUM")].count("HashAggregate") > 0  # no map over a file split


def test_large_dimensions_are_joined_without_sorting_the_lines(spark, monkeypatch):
    from aislelens.plans.datasets import Datasets
    from aislelens.sources import adapter

    def joins():
        plan = Datasets(spark, SMOKE).src.inventory_raw._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        return {j: plan.count(j) for j in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin")}

    assert joins() == {"BroadcastHashJoin": 2, "SortMergeJoin": 0, "ShuffledHashJoin": 0}
    want = {tuple(r) for r in Datasets(spark, SMOKE).src.inventory_raw.collect()}
    monkeypatch.setattr(adapter, "PART_LINES", 100)  # parts: 200, suppliers: 10
    assert joins() == {"BroadcastHashJoin": 1, "SortMergeJoin": 0, "ShuffledHashJoin": 1}
    assert {tuple(r) for r in Datasets(spark, SMOKE).src.inventory_raw.collect()} == want


def test_demand_queries_join_large_parts_by_hash(spark, monkeypatch):
    import __spark_entry__ as E
    from aislelens.sources import adapter

    want = [tuple(r) for r in E.queries()["assistant_demand"](spark, SMOKE).collect()]
    monkeypatch.setattr(adapter, "PART_LINES", 100)
    df = E.queries()["assistant_demand"](spark, SMOKE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert [tuple(r) for r in df.collect()] == want


def test_inventory_health_is_dealt_by_its_lines(spark, monkeypatch):
    from aislelens.plans.datasets import Datasets
    from aislelens.sources import adapter

    want = {tuple(r) for r in Datasets(spark, SMOKE).inventory_health.collect()}
    monkeypatch.setattr(adapter, "PART_LINES", 200)
    p = Datasets(spark, SMOKE)
    assert p.src.inventory_parts > 20 and p.inventory_health.rdd.getNumPartitions() == p.src.inventory_parts
    assert {tuple(r) for r in p.inventory_health.collect()} == want and want


def test_assistant_messages_read_series_dealt_by_count(spark):
    import re

    import __spark_entry__ as E

    plan = E.queries()["assistant_messages"](spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"RepartitionByExpression \[store_id#\w+, sku_id#\w+\]", plan)
