"""Unit frames for the semantic traps of the pipeline."""

import datetime as dt

from pyspark.sql import functions as F

from aislelens.operators import assistant, churn, corpus, forecast, gold, kpis, quality, silver

D = dt.date


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*cols).collect()]


INV = "store_id long, sku_id long, txn_date date, qty_sold int, unit_price double, inventory_on_hand int"


def test_inventory_dedup_keeps_highest_qty_and_rows_not_days(spark):
    raw = spark.createDataFrame([
        (1, 1, D(2024, 1, 1), 4, 1.0, 10), (1, 1, D(2024, 1, 1), 9, 1.0, 5),   # duplicate day
        (1, 1, D(2024, 1, 5), 2, 1.0, 10),                                       # gap of 3 days
    ], INV)
    out = rows(silver.silver_inventory(raw, audit=False), "txn_date", "qty_sold", "avg_daily_demand_7d")
    assert out == [(D(2024, 1, 1), 9, 9.0), (D(2024, 1, 5), 2, 5.5)]   # short frame, ROWS not days


def test_inventory_health_zero_demand_is_ok_and_thresholds_unrounded(spark):
    day = D(2024, 1, 7)
    raw = spark.createDataFrame(
        [(1, 1, D(2024, 1, d), 10, 1.0, 20) for d in range(1, 7)] + [(1, 1, day, 10, 1.0, 29)]   # 2.9 days
        + [(1, 2, D(2024, 1, d), 10, 1.0, 30) for d in range(1, 8)]                            # exactly 3.0
        + [(1, 3, day, 0, 1.0, 0)]                                                            # no demand
        + [(1, 4, D(2024, 1, d), 3, 1.0, 99) for d in range(1, 8)], INV)                       # 33 days
    health = gold.inventory_health(silver.silver_inventory(raw, audit=False))
    got = {r["sku_id"]: (r["days_of_supply"], r["inventory_status"]) for r in health.collect()}
    assert got[1] == (2.9, "REORDER NOW")
    assert got[2] == (3.0, "WATCH")
    assert got[3] == (None, "OK")
    assert got[4] == (33.0, "OK")


def test_order_window_inclusive_and_recency_boundaries(spark):
    as_of = D(2024, 4, 30)
    orders = spark.createDataFrame([
        (1, 1, 1, as_of - dt.timedelta(days=90), 10.005, False),   # day 90: counts
        (2, 2, 1, as_of - dt.timedelta(days=91), 10.0, False),     # day 91: out
        (3, 3, 1, as_of - dt.timedelta(days=30), 10.0, True),
        (4, 4, 1, as_of - dt.timedelta(days=31), 10.0, False),
        (5, 1, 1, as_of + dt.timedelta(days=5), 20.0, False),      # future: counts
    ], "order_id long, customer_id long, store_id long, order_date date, order_value double, is_returned boolean")
    feats = {r["customer_id"]: r for r in gold.order_features(orders, as_of).collect()}
    assert set(feats) == {1, 3, 4}
    assert feats[1]["order_count_90d"] == 2 and feats[1]["recency_days"] == -5
    assert feats[3]["return_rate"] == 1.0
    customers = spark.createDataFrame([(i, f"c{i}", 1, 30, "S", "Online", 1) for i in range(1, 6)],
                                      "customer_id long, customer_name string, store_id long, age int, "
                                      "segment string, preferred_channel string, days_since_join int")
    stores = spark.createDataFrame([(1, "s", "R", "st")], "store_id long, store_name string, region string, state string")
    crm = silver.crm_summary(spark.createDataFrame([], "customer_id long, event_type string, event_date date"), as_of)
    c360 = {r["customer_id"]: r for r in gold.customer_360(customers, stores, gold.order_features(orders, as_of),
                                                            crm, audit=False).collect()}
    assert c360[3]["is_churned"] == 0 and c360[4]["is_churned"] == 1
    assert c360[2]["recency_days"] == 999 and c360[2]["is_churned"] == 1 and c360[2]["last_order_date"] is None
    assert c360[5]["crm_events"] == 0 and c360[5]["days_since_last_contact"] == 999


def test_money_average_rounds_half_up_exactly(spark):
    orders = spark.createDataFrame([(1, 1, 1, D(2024, 1, 1), 0.01, False), (2, 1, 1, D(2024, 1, 1), 0.02, False)],
                                   "order_id long, customer_id long, store_id long, order_date date, "
                                   "order_value double, is_returned boolean")
    r = gold.order_features(orders, D(2024, 1, 1)).collect()[0]
    assert r["avg_order_value"] == 0.02      # 0.015 -> 0.02 (half up)
    assert r["total_spend_90d"] == 0.03


def test_tiers_are_right_closed(spark):
    df = spark.createDataFrame([(0.33,), (0.330001,), (0.66,), (0.660001,)], "p double")
    got = [r[0] for r in df.select(churn.risk_tier(F.col("p"))).collect()]
    assert got == ["Low", "Medium", "Medium", "High"]


def test_staffing_unknown_store_drops(spark):
    staffing = spark.createDataFrame([(1, "Cashier", 2, 3, 1.0), (99, "Cashier", 2, 2, 1.0)],
                                     "store_id long, role string, current_headcount long, "
                                     "budgeted_headcount long, annual_labor_cost double")
    stores = spark.createDataFrame([(1, "s", "R", "st")], "store_id long, store_name string, region string, state string")
    out = rows(gold.staffing_summary(staffing, stores), "store_id", "headcount_gap", "staffing_status")
    assert out == [(1, 1, "UNDERSTAFFED")]


def test_corpus_null_notes_and_no_events(spark):
    c360 = spark.createDataFrame([(1, "A", "Seg", "R", 2, 1234.5, 3, 0), (2, "B", "Seg", None, 0, 0.0, 999, 1)],
                                 "customer_id long, customer_name string, segment string, region string, "
                                 "order_count_90d long, total_spend_90d double, recency_days int, is_churned int")
    ev = spark.createDataFrame([(10, 1, D(2024, 1, 2), "late"), (11, 1, D(2024, 1, 1), "early"),
                                (12, 1, D(2024, 1, 3), None)],
                               "event_id long, customer_id long, event_date date, notes string")
    docs = {r["doc_id"]: r["document"] for r in corpus.rag_documents(c360, ev).collect()}
    assert docs["1"].endswith("CRM notes: early; late")
    assert "Spend 90d: $1234.50" in docs["1"]
    assert "CRM notes" not in docs["2"] and "Region" not in docs["2"]


def test_change_feed(spark):
    old = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "doc_id string, document string")
    new = spark.createDataFrame([("1", "a"), ("2", "B"), ("4", "d")], "doc_id string, document string")
    out = rows(corpus.changes(old, new, "doc_id", ["document"]), "doc_id", "_change_type", "document")
    assert out == [("2", "update", "B"), ("3", "delete", "c"), ("4", "insert", "d")]


def test_intents_word_boundaries(spark):
    q = spark.createDataFrame([("a", "  Which REGION? "), ("b", "stores understaffed"), ("c", "understaffed"),
                               ("d", "SKU trends")], "question_id string, question string")
    got = {r["question_id"]: (r["wants_inventory"], r["wants_region"], r["wants_demand"], r["wants_staffing"])
           for r in assistant.route_intents(q).collect()}
    assert got["a"] == (False, False, False, False)   # punctuation is not a boundary
    assert got["b"] == (False, True, False, True)
    assert got["c"] == (False, False, False, True)
    assert got["d"] == (True, False, False, False)


def test_expectations_count_null_as_failed(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, -1.0)], "order_id long, order_value double")
    observed, obs = quality.expect(df, {"valid_order_value": "order_value > 0"})
    assert observed.count() == 3                       # rows are kept
    assert obs.get == {"rows": 3, "valid_order_value": 2}


def test_forecast_trend_band_is_exact(spark):
    # 7 rows of 10.5 then ... build a series where short avg = 10.5 and long avg = 10.0
    base = [(1, 1, D(2024, 1, d), 10, 1.0, 5) for d in range(1, 15)]
    raw = spark.createDataFrame(base, INV)
    sig = forecast.demand_signals_exact(silver.silver_inventory(raw, audit=False))
    fc = forecast.demand_forecast(sig).collect()[0]
    assert fc["trend"] == "FLAT" and fc["confidence"] == "High" and fc["predicted_units_7d"] == 70


def test_tier_pct_and_revenue(spark):
    scores = spark.createDataFrame([(1, "High"), (2, "High"), (3, "Low")], "customer_id long, risk_tier string")
    pct = {r["risk_tier"]: r["pct"] for r in kpis.risk_tier_distribution(scores).collect()}
    assert pct == {"High": 66.7, "Low": 33.3}
    c360 = spark.createDataFrame([(1, 90.0), (2, 45.0), (3, 1.0)], "customer_id long, total_spend_90d double")
    r = kpis.revenue_at_risk(scores, c360).collect()[0]
    assert r["monthly_revenue_at_risk"] == 45.0 and r["high_risk_customers"] == 2


def test_churn_prob_display_rounding_and_bands(spark):
    scores = spark.createDataFrame(
        [(1, "a", "R", "S", 70, 1, 10.0, 0.1235, "High"), (2, "b", "R", "S", 40, 1, 10.0, 0.712349, "High"),
         (3, "c", "R", "S", 20, 1, 10.0, 0.5005, "High")],
        "customer_id long, customer_name string, region string, segment string, recency_days int, "
        "order_count_90d long, total_spend_90d double, churn_prob double, risk_tier string")
    got = {r["customer_id"]: r["churn_prob"] for r in kpis.top_churn_risk(scores, 10).collect()}
    assert got == {1: 0.124, 2: 0.712, 3: 0.501}                  # HALF_UP at 3 places
    bands = {r["customer_id"]: (r["recency_alert"], r["prob_band"]) for r in kpis.display_bands(scores).collect()}
    assert bands == {1: (True, "green"), 2: (False, "red"), 3: (False, "amber")}
