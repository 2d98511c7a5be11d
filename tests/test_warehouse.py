"""The materialised refresh + serving path equals the lazy, oracle-checked queries."""

import pytest

import __spark_entry__ as E
from aislelens.plans import warehouse as W
from aislelens.session import scratch_path
from tests.conftest import SMOKE
from tests.helpers import table


@pytest.fixture(scope="module")
def wh(spark):
    w = W.Warehouse(spark, scratch_path(spark, "test-warehouse"))
    W.refresh_bronze(w, SMOKE)
    W.refresh_silver(w)
    W.refresh_gold(w)
    W.refresh_forecast(w)
    W.refresh_churn(w, model=False)
    W.refresh_corpus(w)
    w.save_counts()
    return w


def same(a, b):
    return table(a.columns, [tuple(r) for r in a.collect()]) == table(b.columns, [tuple(r) for r in b.collect()])


@pytest.mark.parametrize("name,query", [
    ("customer_360", "customer_360"), ("inventory_health", "inventory_health"),
    ("store_staffing_summary", "store_staffing_summary"), ("demand_forecast", "demand_forecast"),
    ("churn_labels", "churn_label"), ("churn_scores_rule", "churn_scores_rule"),
    ("rag_documents", "rag_documents"), ("crm_summary", "crm_summary"),
])
def test_written_tables_equal_queries(spark, wh, name, query):
    written = wh.table(name).drop("updated_at", "load_ts")
    assert same(written, E.queries()[query](spark, SMOKE))


def test_serving_equals_queries(spark, wh):
    assert same(W.serve_summary(wh, with_tiers=False), E.queries()["executive_summary"](spark, SMOKE))
    assert same(W.serve_inventory_alerts(wh), E.queries()["inventory_alerts_served"](spark, SMOKE))
    assert same(W.serve_platform_stats(wh), E.queries()["platform_stats"](spark, SMOKE))
    assert same(W.serve_platform_stats_live(wh), E.queries()["platform_stats"](spark, SMOKE))


def test_expectations_written(wh):
    rows = {(r["dataset"], r["rule"]): (r["rows"], r["failed"]) for r in wh.table("expectations").collect()}
    assert len(rows) == 6 and all(f == 0 for _, f in rows.values())


def test_summary_tier_list_and_retrieval(spark, wh):
    row = W.serve_summary(wh).collect()[0]
    tiers = row["risk_tiers"]
    assert sum(t["count"] for t in tiers) == wh.table("customer_360").count()
    assert [t["count"] for t in tiers] == sorted((t["count"] for t in tiers), reverse=True)
    W.refresh_vectors(wh)
    from aislelens.sources.adapter import Source
    qs = Source(spark, SMOKE).questions
    out = W.serve_retrieval(wh, qs)
    assert out.count() == qs.count()
    assert out.filter(out.prompt.contains("CUSTOMER DATA:")).count() == qs.count()


def test_validation_equals_dataframe_kpis(spark, wh):
    from aislelens.operators import forecast, kpis
    from aislelens.plans import validation

    names = [n for n in validation.TABLES.values() if n != "churn_scores"] + ["churn_scores_rule"]
    wh.register("aisle_kpi", names)
    got = validation.run(spark, "aisle_kpi", scores="churn_scores_rule")
    scores = wh.table("churn_scores_rule")
    want = {
        "risk_tier_distribution": kpis.risk_tier_distribution(scores),
        "top_churn_risk": kpis.top_churn_risk(scores, 10),
        "revenue_at_risk": kpis.revenue_at_risk(scores, wh.table("customer_360")),
        "inventory_alerts": kpis.inventory_alerts(wh.table("inventory_health"), 20),
        "demand_top10": forecast.top_demand(wh.table("demand_forecast"), 10),
        "staffing_gaps": kpis.staffing_gaps(wh.table("store_staffing_summary")),
    }
    for name, df in want.items():
        assert dict(got[name].dtypes) == dict(df.dtypes), name
        assert same(got[name], df), name
    counts = {r["tbl"]: r["rows"] for r in got["layer_row_counts"].collect()}
    assert counts["gold.customer_360"] == wh.table("customer_360").count()


def test_chat_from_refreshed_context_equals_query(spark, wh):
    from aislelens.sources.adapter import Source

    W.refresh_assistant_context(wh)
    qs = Source(spark, SMOKE).questions
    got = W.serve_chat(wh, qs).select("question_id", "context", "context_used", "answer")
    want = E.queries()["assistant_grounded"](spark, SMOKE).select("question_id", "context", "context_used",
                                                                   "answer")
    assert same(got, want)


def test_bucketed_warehouse_joins_without_customer_shuffle(spark):
    import contextlib
    import io

    from aislelens.operators import gold

    w = W.Warehouse(spark, scratch_path(spark, "bucketed-wh"), database="aisle_bucketed", buckets=8)
    W.refresh_bronze(w, SMOKE)
    W.refresh_silver(w)
    W.refresh_gold(w)
    assert same(w.table("customer_360").drop("updated_at"), E.queries()["customer_360"](spark, SMOKE))
    orders = w.table("orders")
    feats = gold.order_features(orders, W._max_date(orders, "order_date"))
    plan = gold.customer_360(w.table("customers"), w.table("stores"), feats, w.table("crm_summary"),
                             audit=False)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        plan.explain()
    assert "hashpartitioning(customer_id" not in buf.getvalue()
    assert "Bucketed: true" in buf.getvalue()
