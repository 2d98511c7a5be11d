"""Name -> query callable and name -> DuckDB oracle SQL.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole input tables. Audit timestamps are left out of the registered forms
so results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import churn as CH
from ..operators import forecast as FC
from ..operators import kpis as K
from ..operators import quality as Q
from ..operators import retrieval as R
from ..operators import vector_index as VI
from ..operators.select import rank_sum
from ..session import materialise, scratch_path
from ..streaming import profile as PF
from ..streaming.incremental import expectations_so_far, refresh_crm_summary, refresh_silver_orders
from . import ingested as I
from . import oracle as O
from .datasets import Datasets, WrittenDatasets

Query = Callable[[SparkSession, str], DataFrame]


def _p(spark: SparkSession, sf_dir: str) -> Datasets:
    return Datasets(spark, sf_dir)


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        # S2 bronze views
        "stores": lambda s, d: _p(s, d).src.stores,
        "skus": lambda s, d: _p(s, d).src.skus,
        "customers_raw": lambda s, d: _p(s, d).src.customers_raw,
        "orders_raw": lambda s, d: _p(s, d).src.orders_raw,
        "inventory_raw": lambda s, d: _p(s, d).src.inventory_raw,
        "crm_events_raw": lambda s, d: _p(s, d).src.crm_events_raw,
        "staffing_raw": lambda s, d: _p(s, d).src.staffing_raw,
        # Q1-Q4 silver
        "silver_customers": lambda s, d: _p(s, d).customers,
        "silver_orders": lambda s, d: _p(s, d).orders,
        "silver_inventory": lambda s, d: _p(s, d).inventory(audit=False),
        "crm_summary": lambda s, d: _p(s, d).crm_summary,
        # Q5-Q8 gold
        "order_features_90d": lambda s, d: _p(s, d).order_features,
        "customer_360": lambda s, d: _p(s, d).customer_360(audit=False),
        "inventory_health": lambda s, d: _p(s, d).inventory_health,
        "store_staffing_summary": lambda s, d: _p(s, d).staffing_summary,
        # Q9-Q11, Q22, D-SPINE forecast
        "demand_signals": lambda s, d: _p(s, d).demand_signals,
        "demand_forecast": lambda s, d: _p(s, d).demand_forecast,
        "demand_top10": lambda s, d: FC.top_demand(_p(s, d).demand_forecast, 10),
        "demand_top20": lambda s, d: FC.demand_serving(_p(s, d).demand_forecast, 20),
        "inventory_daily_spine": lambda s, d: FC.spine_summary_direct(_p(s, d).inventory()),
        # M1/Q12 label, rule-score twin of Q13, Q13 model scores (rows-only)
        "churn_label": lambda s, d: _p(s, d).churn_labels,
        "high_value_label": lambda s, d: CH.high_value_label(_p(s, d).customer_360()),
        "churn_scores_rule": lambda s, d: _p(s, d).rule_scores,
        "churn_auc_rule": _auc_rule,
        "churn_scores": lambda s, d: _p(s, d).model_scores,
        "churn_model_metrics": lambda s, d: _p(s, d).fitted[1],
        "churn_feature_importances": lambda s, d: CH.feature_importances(_p(s, d).fitted[1]),
        # Q14-Q31, Q33-Q36 KPIs (over the rule-score twin, so SQL can check them)
        "risk_tier_distribution": lambda s, d: K.risk_tier_distribution(_p(s, d).rule_scores),
        "top_churn_risk": lambda s, d: K.top_churn_risk(_p(s, d).rule_scores, 10),
        "churn_risk_list": lambda s, d: K.churn_risk_list(_p(s, d).rule_scores, 25),
        "revenue_at_risk": _revenue_at_risk,
        "customer_store_totals": lambda s, d: K.customer_store_totals(_p(s, d).customer_360()),
        "distinct_sketches": _distinct_sketches,
        "last_updated_today": _last_updated,
        "reorder_count": lambda s, d: K.reorder_count(_p(s, d).inventory_health),
        "executive_summary": _executive_summary,
        "regional_churn": lambda s, d: K.regional_churn(_p(s, d).rule_scores),
        "regional_churn_pivot": lambda s, d: K.regional_churn_pivot(_p(s, d).rule_scores),
        "churn_by_segment": lambda s, d: K.churn_by_segment(_p(s, d).rule_scores),
        "inventory_alerts": lambda s, d: K.inventory_alerts(_p(s, d).inventory_health, 20),
        "inventory_alerts_served": _alerts_served,
        "staffing_gaps": lambda s, d: K.staffing_gaps(_p(s, d).staffing_summary),
        "layer_row_counts": lambda s, d: K.layer_row_counts(WrittenDatasets(s, d).layer_tables()),
        "platform_stats": lambda s, d: K.platform_stats(WrittenDatasets(s, d).layer_tables()),
        "platform_total_rows": lambda s, d: K.platform_total_rows(K.platform_stats(WrittenDatasets(s, d).layer_tables())),
        "assistant_kpis": lambda s, d: K.assistant_kpis(_p(s, d).rule_scores),
        "assistant_inventory": lambda s, d: K.assistant_inventory(_p(s, d).inventory_health),
        "assistant_regions": lambda s, d: K.assistant_regions(_p(s, d).rule_scores),
        "assistant_demand": lambda s, d: K.assistant_demand(_p(s, d).demand_forecast),
        "assistant_staffing": lambda s, d: K.assistant_staffing(_p(s, d).staffing_summary),
        "display_bands": lambda s, d: K.display_bands(_p(s, d).rule_scores),
        "stockout_rate": lambda s, d: K.stockout_rate(_p(s, d).inventory_health),
        "weekly_revenue_at_risk": _weekly_revenue,
        "regional_stockouts": _regional_stockouts,
        # Q32/G1 corpus, S11 change feed, G6-G8 assistant, G2-G5 retrieval
        "rag_documents": lambda s, d: _p(s, d).rag_documents,
        "rag_document_changes": lambda s, d: _p(s, d).rag_changes(O.SNAPSHOT_LAG_DAYS),
        "assistant_grounded": _grounded,
        "embedding_centroid_neighbors": lambda s, d: _p(s, d).centroid_neighbors(C.RETRIEVAL_TOP_K),
        "embedding_index_neighbors": lambda s, d: _index_neighbors(s, d),
        "vector_index_recall": lambda s, d: _index_recall(s, d),
        "retrieval_hits": lambda s, d: _p(s, d).retrieval_hits,
        "retrieval_prompts": lambda s, d: _p(s, d).retrieval_prompts,
        "rag_vectors_synced": lambda s, d: _p(s, d).synced_vectors(O.SNAPSHOT_LAG_DAYS),
        "assistant_messages": _messages,
        # D1-D3 quality, ST1 incremental refresh
        "expectation_report": _expectation_report,
        "validation_checks": lambda s, d: Q.validation_checks(_p(s, d)),
        # the KPIs over raw (unrounded) probabilities, as over a model's
        "risk_tiers_raw_scores": lambda s, d: K.served_tiers(_p(s, d).raw_rule_scores),
        "churn_risk_list_raw_scores": lambda s, d: K.churn_risk_list(_p(s, d).raw_rule_scores, 25),
        "assistant_kpis_raw_scores": lambda s, d: K.assistant_kpis(_p(s, d).raw_rule_scores),
        "served_risk_tiers": lambda s, d: K.served_tiers(_p(s, d).rule_scores),
        "served_regions": lambda s, d: K.served_regions(_p(s, d).rule_scores),
        "served_segments": lambda s, d: K.served_segments(_p(s, d).rule_scores),
        "served_row_counts": lambda s, d: K.served_row_counts(WrittenDatasets(s, d).layer_tables()),
        "churn_model_checks": _model_checks,
        "retrieval_checks": _retrieval_checks,
        "crm_summary_incremental": lambda s, d: refresh_crm_summary(s, f"{d}/events.parquet"),
        "silver_orders_incremental": lambda s, d: refresh_silver_orders(
            s, f"{d}/orders.parquet", _p(s, d).src.table("customer")),
        "orders_expectations_streamed": _streamed_expectations,
        "customer_360_incremental": _customer_360_incremental,
        # Drops of export files
        "orders_ingested": I.orders_ingested,
        "silver_orders_ingested": I.silver_orders_ingested,
        "customers_ingested": I.customers_ingested,
        "customers_unreadable": I.customers_unreadable,
        "ingest_commits": I.ingest_commits,
    }
    return q


def _expectation_report(spark, sf_dir):
    p = _p(spark, sf_dir)
    return Q.expectation_report({"customers": p.customers, "orders": p.orders, "inventory": p.inventory()})


def _grounded(spark, sf_dir):
    g = _p(spark, sf_dir).grounded_questions
    return g.select("question_id", "question", "wants_kpi", "wants_inventory", "wants_region",
                    "wants_demand", "wants_staffing", "context", "context_used", "answer")


def _messages(spark, sf_dir):
    from ..operators import assistant as A
    p = _p(spark, sf_dir)
    return A.chat_messages(p.grounded_questions, p.assistant_texts["total_customers"]).select(
        "question_id", "system_message", "user_message")


def _revenue_at_risk(spark, sf_dir):
    p = _p(spark, sf_dir)
    return K.revenue_at_risk(p.rule_scores, p.customer_360())


def _model_checks(spark, sf_dir):
    p = _p(spark, sf_dir)
    c360 = p.written_profile
    return CH.model_checks(p.fitted[1], p.model_scores, c360, CH.decided_metrics(c360))


def _streamed_expectations(spark, sf_dir):
    """D1 on a stream: the rules counted epoch by epoch while the orders arrive, summed."""
    folder = scratch_path(spark, "orders-expectations")
    refresh_silver_orders(spark, f"{sf_dir}/orders.parquet", _p(spark, sf_dir).src.table("customer"), expectations=folder)
    return expectations_so_far(spark, folder)


def _distinct_sketches(spark, sf_dir):
    """A2 at scale: the distinct customers of each store from sketches per store and day, stored and merged, beside
    the exact count; ``near`` if the two are at most SKETCH_ERROR apart."""
    orders = _p(spark, sf_dir).src.orders_raw
    daily = materialise(K.daily_sketches(orders, ["store_id"], "order_date", "customer_id"), "daily-sketches")
    merged = K.merged_sketches(daily, ["store_id"])
    exact = orders.groupBy("store_id").agg(F.count_distinct("customer_id").alias("customers"))
    near = F.abs(F.col("estimate") - F.col("customers")) <= F.greatest(F.lit(1.0), F.col("customers") * K.SKETCH_ERROR)
    return exact.join(merged, exact["store_id"].eqNullSafe(merged["store_id"])).select(exact["store_id"], "customers", near.alias("near"))


def _last_updated(spark, sf_dir):
    """Q26: the profile was last rebuilt now (its time itself is the clock's)."""
    updated = _p(spark, sf_dir).customer_360(audit=True).agg(F.max("updated_at").alias("t"), F.count("updated_at").alias("rows"))
    return updated.select("rows", (F.abs(F.unix_seconds("t") - F.unix_seconds(F.current_timestamp())) < 3600).alias("fresh"))


def _auc_rule(spark, sf_dir):
    """M5: the exact AUC of the rule's scores against the churn label."""
    p = _p(spark, sf_dir)
    both = p.rule_scores.select("customer_id", "churn_prob").join(p.churn_labels.select("customer_id", "churn_label"), "customer_id")
    return rank_sum(both, "churn_prob", "churn_label").withColumn("twice_u", F.col("twice_u").cast("long"))


def _customer_360_incremental(spark, sf_dir):
    """ST1: the profile of an altered earlier state, brought up to date by signed changes.

    Before, the last weeks' orders and events were missing, some rows had other values or another customer, and
    there were customers and orders (the latest ones of all, so the window moves back as they go) that exist no more.
    """
    p, lag = _p(spark, sf_dir), Datasets(spark, sf_dir, lag_days=O.SNAPSHOT_LAG_DAYS * 5)
    customers = p.customers.select(*PF.names("customers"))
    orders, events = p.orders.select(*PF.names("orders")), p.src.crm_events_raw.select(*PF.names("events"))
    cid, oid, last = F.col("customer_id"), F.col("order_id"), p.orders.agg(F.max("order_date")).scalar()
    was = customers.filter(cid % 40 != 0).withColumn("segment", F.when(cid % 41 == 0, "OLD").otherwise(F.col("segment")))
    was = was.unionByName(customers.filter(cid % 43 == 0).withColumn("customer_id", -cid))
    before = lag.orders.select(*PF.names("orders")).withColumns({
        "order_value": F.when(oid % 50 == 1, F.col("order_value") + 1).otherwise(F.col("order_value")),
        "customer_id": F.when(oid % 50 == 2, cid + 1).otherwise(cid)})
    before = before.unionByName(orders.filter(oid % 47 == 0).withColumns({"order_id": -oid, "order_date": F.date_add(last, 3)}))
    said = lag.src.crm_events_raw.select(*PF.names("events"))
    said = said.unionByName(events.filter(F.col("event_id") % 53 == 0))
    store = PF.ProfileStore(spark, scratch_path(spark, "profile"))
    store.refresh(*[df.withColumn("_sign", F.lit(1)) for df in (was, before, said)])
    store.refresh(PF.signed_changes(was, customers), PF.signed_changes(before, orders), PF.signed_changes(said, events))
    return store.profile(p.stores)


def _indexed(spark, sf_dir):
    """The index over all embeddings, those rows, and the query rows (every id divisible by 100)."""
    rows = _p(spark, sf_dir).src.table("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    queries = rows.filter(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id")
    return VI.build(spark, rows, "vec_id"), rows, queries


def _index_neighbors(spark, sf_dir):
    """G3 the exact way: every list is probed."""
    index, _, queries = _indexed(spark, sf_dir)
    hits = VI.search(index, queries, C.RETRIEVAL_TOP_K, "query_id", "vec_id", index.lists)
    return hits.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def _index_recall(spark, sf_dir):
    """The calibrated index against brute force: recall of at least 0.9."""
    index, rows, queries = _indexed(spark, sf_dir)
    seen = VI.measured_recall(index, queries, rows, C.RETRIEVAL_TOP_K, "query_id", "vec_id")
    return seen.select("queries", "hits", (F.col("found") >= 0.9 * F.col("hits")).alias("enough"))


def _retrieval_checks(spark, sf_dir):
    p = _p(spark, sf_dir)
    return R.retrieval_checks(p.src.questions, p.written_documents, p.retrieval_hits, p.retrieval_prompts, p.synced_vectors())


def _executive_summary(spark, sf_dir):
    p = _p(spark, sf_dir)
    return K.executive_summary(p.rule_scores, p.customer_360(), p.inventory_health)


def _alerts_served(spark, sf_dir):
    p = _p(spark, sf_dir)
    return K.inventory_alerts_served(p.inventory_health, p.stores, 25)


def _weekly_revenue(spark, sf_dir):
    p = _p(spark, sf_dir)
    return K.weekly_revenue_at_risk(p.inventory_health, p.inventory())


def _regional_stockouts(spark, sf_dir):
    p = _p(spark, sf_dir)
    return K.regional_stockouts(p.inventory_health, p.stores)


def oracle_sql() -> dict[str, str]:
    s = O.select_all
    return {
        "stores": s("b_stores"),
        "skus": s("b_skus"),
        "customers_raw": s("b_customers_raw"),
        "orders_raw": s("b_orders_raw"),
        "inventory_raw": s("b_inventory_raw"),
        "crm_events_raw": s("b_crm_events_raw"),
        "staffing_raw": s("b_staffing_raw"),
        "silver_customers": s("s_customers"),
        "silver_orders": s("s_orders"),
        "silver_inventory": s("s_inventory"),
        "crm_summary": s("s_crm_summary"),
        "order_features_90d": s("g_order_features"),
        "customer_360": s("g_customer_360"),
        "inventory_health": s("g_inventory_health"),
        "store_staffing_summary": s("g_staffing"),
        "demand_signals": s("f_signals"),
        "demand_forecast": s("f_forecast"),
        "demand_top10": O.sql("""SELECT sku_id, sku_name, category, demand_7d_avg, trend, predicted_units_7d
            FROM f_forecast ORDER BY demand_7d_avg DESC, sku_id LIMIT 10"""),
        "demand_top20": O.sql("""SELECT sku_id, sku_name, category, trend, demand_7d_avg, predicted_units_7d,
            confidence, avg_unit_price FROM f_forecast ORDER BY demand_7d_avg DESC, sku_id LIMIT 20"""),
        "inventory_daily_spine": s("f_spine"),
        "churn_label": s("c_labels"),
        "high_value_label": O.sql(f"""SELECT customer_id, total_spend_90d,
            CASE WHEN ROW_NUMBER() OVER (ORDER BY total_spend_90d DESC, customer_id)
                      <= (SELECT CAST(floor({C.CHURN_LABEL_SHARE} * COUNT(*)) AS BIGINT) FROM g_customer_360)
                 THEN 1 ELSE 0 END AS high_value FROM g_customer_360"""),
        "churn_scores_rule": s("c_scores"),
        "churn_auc_rule": O.sql(f"""SELECT p AS positives, q AS negatives, CAST(u AS BIGINT) AS twice_u, {O.rr('u', '2 * p * q', 6)} AS auc
            FROM (SELECT COUNT(*) FILTER (WHERE churn_label = 1) AS p, COUNT(*) FILTER (WHERE churn_label = 0) AS q,
                         CAST(SUM(CASE WHEN churn_label = 1 THEN 2 * below + tied END) AS HUGEINT) AS u
                  FROM (SELECT churn_label,
                               COUNT(*) FILTER (WHERE churn_label = 0) OVER (PARTITION BY churn_prob) AS tied,
                               COUNT(*) FILTER (WHERE churn_label = 0) OVER (ORDER BY churn_prob RANGE BETWEEN
                                   UNBOUNDED PRECEDING AND CURRENT ROW)
                                 - COUNT(*) FILTER (WHERE churn_label = 0) OVER (PARTITION BY churn_prob) AS below
                        FROM c_scores JOIN c_labels USING (customer_id)))"""),
        "risk_tier_distribution": s("k_tiers"),
        "top_churn_risk": O.sql(f"""SELECT customer_id, customer_name, region, segment, recency_days,
            order_count_90d, churn_prob, risk_tier FROM k_risk_list
            ORDER BY churn_prob DESC, customer_id LIMIT 10"""),
        "churn_risk_list": s("k_risk_list"),
        "revenue_at_risk": s("k_revenue"),
        "customer_store_totals": s("k_totals"),
        "distinct_sketches": O.sql("""SELECT store_id, COUNT(DISTINCT customer_id) AS customers, true AS near
            FROM b_orders_raw GROUP BY store_id"""),
        "last_updated_today": O.sql("SELECT COUNT(*) AS rows, true AS fresh FROM g_customer_360"),
        "reorder_count": s("k_reorder"),
        "executive_summary": O.sql("""SELECT
            COALESCE((SELECT pct FROM k_tiers WHERE risk_tier = 'High'), CAST(0 AS DOUBLE)) AS churn_rate_pct,
            CAST(COALESCE(monthly_revenue_at_risk, 0) AS BIGINT) AS revenue_at_risk,
            CAST(COALESCE(high_risk_customers, 0) AS BIGINT) AS high_risk_customers,
            (SELECT total_customers FROM k_totals) AS total_customers,
            (SELECT total_stores FROM k_totals) AS total_stores,
            (SELECT reorder_count FROM k_reorder) AS inventory_alerts
            FROM k_revenue"""),
        "regional_churn": O.sql("SELECT region, risk_tier, COUNT(*) AS cnt FROM c_scores GROUP BY region, risk_tier"),
        "regional_churn_pivot": O.sql("""SELECT region,
            COUNT(*) FILTER (WHERE risk_tier = 'High') AS "High",
            COUNT(*) FILTER (WHERE risk_tier = 'Medium') AS "Medium",
            COUNT(*) FILTER (WHERE risk_tier = 'Low') AS "Low"
            FROM c_scores GROUP BY region"""),
        "churn_by_segment": O.sql(f"""SELECT segment, total, high_risk, {O.rr('high_risk * 100', 'total', 1)} AS high_risk_pct
            FROM (SELECT segment, COUNT(*) AS total, COUNT(*) FILTER (WHERE risk_tier = 'High') AS high_risk
                  FROM c_scores GROUP BY segment)"""),
        "inventory_alerts": O.sql("""SELECT store_id, sku_id, inventory_on_hand, days_of_supply, inventory_status
            FROM g_inventory_health WHERE inventory_status = 'REORDER NOW'
            ORDER BY days_of_supply ASC, store_id, sku_id LIMIT 20"""),
        "inventory_alerts_served": O.sql("""SELECT ih.store_id, s.region, ih.sku_id, ih.inventory_on_hand,
            ih.days_of_supply, ih.avg_daily_demand_7d, ih.inventory_status
            FROM g_inventory_health ih JOIN b_stores s USING (store_id)
            WHERE ih.inventory_status = 'REORDER NOW'
            ORDER BY ih.days_of_supply ASC, ih.store_id, ih.sku_id LIMIT 25"""),
        "staffing_gaps": O.sql("""SELECT store_id, region, role, current_headcount, budgeted_headcount,
            headcount_gap, staffing_status FROM g_staffing WHERE staffing_status = 'UNDERSTAFFED'"""),
        "layer_row_counts": s("k_layer_counts"),
        "platform_stats": O.sql("""SELECT p.tbl AS "table", p.layer, p.source, CAST(COALESCE(c."rows", 0) AS BIGINT) AS "rows"
            FROM k_platform p LEFT JOIN k_layer_counts c ON p.tbl = c.tbl"""),
        "platform_total_rows": O.sql('SELECT CAST(SUM("rows") AS BIGINT) AS total_rows FROM k_layer_counts'),
        "assistant_kpis": O.sql(f"""SELECT COUNT(*) AS total_customers,
            COUNT(*) FILTER (WHERE risk_tier = 'High') AS high_risk,
            {O.rr('SUM(CAST(round(churn_prob * 1000000) AS BIGINT))', 'COUNT(*) * 10000', 1)} AS avg_churn_pct
            FROM c_scores"""),
        "assistant_inventory": O.sql(f"""SELECT COUNT(*) AS cnt,
            {O.rr('SUM(CAST(round(days_of_supply * 10) AS BIGINT))', 'COUNT(days_of_supply) * 10', 1)} AS avg_dos
            FROM g_inventory_health WHERE inventory_status = 'REORDER NOW'"""),
        "assistant_regions": O.sql("""SELECT region, COUNT(*) FILTER (WHERE risk_tier = 'High') AS high_risk
            FROM c_scores GROUP BY region ORDER BY high_risk DESC, region LIMIT 5"""),
        "assistant_demand": O.sql("""SELECT sku_id, sku_name, category, trend, demand_7d_avg FROM f_forecast
            WHERE trend = 'UP' ORDER BY demand_7d_avg DESC, sku_id LIMIT 5"""),
        "assistant_staffing": O.sql("""SELECT COUNT(*) FILTER (WHERE staffing_status = 'UNDERSTAFFED') AS gaps
            FROM g_staffing"""),
        "display_bands": O.sql(f"""SELECT customer_id, recency_days, churn_prob,
            recency_days > {C.DISPLAY_RECENCY_ALERT} AS recency_alert,
            CASE WHEN churn_prob > CAST({C.DISPLAY_PROB_BANDS[1]} AS DOUBLE) THEN 'red'
                 WHEN churn_prob > CAST({C.DISPLAY_PROB_BANDS[0]} AS DOUBLE) THEN 'amber' ELSE 'green' END AS prob_band
            FROM k_risk_list"""),
        "stockout_rate": O.sql(f"""SELECT COUNT(*) AS combos,
            COUNT(*) FILTER (WHERE inventory_status = 'REORDER NOW') AS reorder_now,
            {O.rr("COUNT(*) FILTER (WHERE inventory_status = 'REORDER NOW') * 100", 'COUNT(*)', 1)} AS stockout_rate_pct
            FROM g_inventory_health"""),
        "weekly_revenue_at_risk": O.sql(f"""SELECT
            {O.rr(f"SUM(CAST(round(h.avg_daily_demand_7d * 10) AS BIGINT) * {O.micros('i.unit_price')} * 7)", '10000000', 2)}
              AS weekly_revenue_at_risk,
            COUNT(*) AS reorder_combos
            FROM g_inventory_health h JOIN s_inventory i
              ON h.store_id = i.store_id AND h.sku_id = i.sku_id AND h.signal_date = i.txn_date
            WHERE h.inventory_status = 'REORDER NOW'"""),
        "regional_stockouts": O.sql(f"""SELECT region, combos, reorder_now,
            {O.rr('reorder_now * 100', 'combos', 1)} AS reorder_pct
            FROM (SELECT s.region, COUNT(*) AS combos,
                         COUNT(*) FILTER (WHERE h.inventory_status = 'REORDER NOW') AS reorder_now
                  FROM g_inventory_health h JOIN b_stores s USING (store_id) GROUP BY s.region)"""),
        "rag_documents": s("t_rag_documents"),
        "rag_document_changes": s("t_rag_changes"),
        "assistant_grounded": s("a_grounded"),
        "embedding_centroid_neighbors": s("r_centroid_neighbors"),
        "embedding_index_neighbors": f"""SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score
            FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
                  FROM (SELECT q.vec_id AS query_id, c.vec_id,
                               list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score
                        FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0))
            WHERE rank <= {C.RETRIEVAL_TOP_K}""",
        "vector_index_recall": f"""SELECT COUNT(*) AS queries, COUNT(*) * {C.RETRIEVAL_TOP_K} AS hits, true AS enough
            FROM embeddings WHERE vec_id % 100 = 0""",
        "expectation_report": s("q_expectations"),
        "validation_checks": s("q_checks"),
        "risk_tiers_raw_scores": O.sql(f"""SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY customers DESC, risk_tier) AS INTEGER) AS rank
            FROM (SELECT risk_tier, customers, {O.rr('customers * 100', 'SUM(customers) OVER ()', 1)} AS pct
                  FROM (SELECT risk_tier, COUNT(*) AS customers FROM c_scores_raw GROUP BY risk_tier))"""),
        "churn_risk_list_raw_scores": O.sql(O.risk_list("c_scores_raw")),
        "assistant_kpis_raw_scores": O.sql(f"""SELECT COUNT(*) AS total_customers,
            COUNT(*) FILTER (WHERE risk_tier = 'High') AS high_risk,
            {O.rr(f'SUM({O._prob})', 'COUNT(*) * 10000000000', 1)} AS avg_churn_pct FROM c_scores_raw"""),
        "served_risk_tiers": O.sql("""SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY customers DESC, risk_tier) AS INTEGER) AS rank
            FROM k_tiers"""),
        "served_regions": O.sql("""SELECT region, COUNT(*) FILTER (WHERE risk_tier = 'High') AS "High",
            COUNT(*) FILTER (WHERE risk_tier = 'Medium') AS "Medium", COUNT(*) FILTER (WHERE risk_tier = 'Low') AS "Low",
            CAST(ROW_NUMBER() OVER (ORDER BY region NULLS LAST) AS INTEGER) AS rank
            FROM c_scores GROUP BY region"""),
        "served_segments": O.sql(f"""SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY high_risk_pct DESC, segment NULLS LAST) AS INTEGER) AS rank
            FROM (SELECT segment, total, high_risk, {O.rr('high_risk * 100', 'total', 1)} AS high_risk_pct
                  FROM (SELECT segment, COUNT(*) AS total, COUNT(*) FILTER (WHERE risk_tier = 'High') AS high_risk
                        FROM c_scores GROUP BY segment))"""),
        "served_row_counts": O.sql("""SELECT tbl, "rows", CAST(ROW_NUMBER() OVER (ORDER BY tbl) AS INTEGER) AS rank
            FROM k_layer_counts"""),
        "churn_model_checks": """SELECT * FROM (VALUES ('one score per customer', true), ('probabilities in 0..1', true),
            ('tiers follow the probabilities', true), ('importances sum to 1', true), ('held-out AUC', true),
            ('held-out AUC of a decided label', true)) AS v("check", ok)""",
        "retrieval_checks": O.sql(f"""SELECT "check", CAST(e AS BIGINT) AS expected, CAST(e AS BIGINT) AS actual
            FROM (SELECT unnest(['hits per question', 'ranks 1..k', 'cosines in -1..1', 'one prompt per question',
                                 'one vector per document after the sync']) AS "check",
                         unnest([q * k, q * k * (k + 1) // 2, q * k, q, d]) AS e
                  FROM (SELECT q, d, LEAST({C.RETRIEVAL_TOP_K}, d) AS k
                        FROM (SELECT (SELECT COUNT(*) FROM t_questions) AS q, (SELECT COUNT(*) FROM t_rag_documents) AS d)))"""),
        "crm_summary_incremental": s("s_crm_summary"),
        "silver_orders_incremental": s("s_orders"),
        "orders_expectations_streamed": O.sql("SELECT * FROM q_expectations WHERE dataset = 'orders'"),
        "customer_360_incremental": s("g_customer_360"),
        "orders_ingested": O.sql("""SELECT order_id, customer_id, store_id, CAST(order_date AS VARCHAR) AS order_date,
            order_value, is_returned FROM b_orders_raw"""),
        "silver_orders_ingested": s("s_orders"),
        "customers_ingested": O.sql("""SELECT customer_id, customer_name, store_id, age, segment,
            CASE WHEN customer_id % 2 <> 0 THEN preferred_channel END AS preferred_channel, days_since_join,
            CASE WHEN customer_id % 2 <> 0 THEN CAST(customer_id % 5 AS VARCHAR) END AS loyalty FROM b_customers_raw"""),
        "customers_unreadable": O.sql(f"""SELECT '{{"customer_id": ' || customer_id || ', "cut' AS record
            FROM b_customers_raw WHERE customer_id % {I.BROKEN_EACH} = 0"""),
        "ingest_commits": O.sql(f"""SELECT CAST("commit" AS BIGINT) AS "commit", CAST(COUNT(*) AS BIGINT) AS "rows",
            CAST(SUM(bad) AS BIGINT) AS unreadable
            FROM (SELECT CASE WHEN customer_id % 2 = 0 THEN 1 ELSE 2 END AS "commit", 0 AS bad FROM b_customers_raw
                  UNION ALL SELECT 2, 1 FROM b_customers_raw WHERE customer_id % {I.BROKEN_EACH} = 0)
            GROUP BY 1"""),
        "assistant_messages": O.sql(f"""SELECT question_id,
            printf('{C.ASSISTANT_SYSTEM_TEMPLATE}', (SELECT COUNT(*) FROM c_scores)) AS system_message,
            'LIVE RETAIL DATA:' || chr(10) || context || chr(10) || chr(10) || 'QUESTION: ' || question
              AS user_message
            FROM a_grounded"""),
    }
