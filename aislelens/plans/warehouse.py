"""Materialised pipeline: refresh writes every dataset once, serving reads
the written tables.

``Warehouse`` is a folder of named parquet tables (S1 read by name, S4/S5
overwrite sink). ``refresh_*`` functions run the pipeline stages in
dependency order, each stage reading the tables the previous one wrote, so
lineage stays one stage deep and filters reach parquet scans. The run date
of each source is resolved once to a literal, which lets the 90-day order
filter prune row groups. ``serving`` functions are the dashboard and
assistant queries over the gold tables.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT, Thresholds
from ..operators import assistant, churn, corpus, forecast, gold, kpis, quality, retrieval, silver
from ..session import folder_names, scratch_scope
from ..sources.adapter import Source
from ..sources.exports import RAW_SCHEMAS
from ..sources.ingest import Bronze
from .versions import Versions


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, scores: str = "churn_scores",
                 database: str | None = None, buckets: int | None = None):
        """``database`` turns on bucketed catalog tables: the customer-keyed
        silver tables are written ``bucketBy(buckets, customer_id)``, so the
        customer_360 aggregation and joins read co-partitioned files with no
        shuffle. ``buckets`` defaults to the session's shuffle partitions."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.scores = scores          # which churn score table serving reads
        self.counts: dict[str, int] = {}   # rows of each table, observed while writing
        self.database = database
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.catalog_tables: set[str] = set()
        self.bronze: dict[str, Bronze] = {}        # tables that are read as ingested
        if database:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{self.path('_catalog')}'")

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def write(self, name: str, df: DataFrame, sort_by: list[str] | None = None,
              bucket_by: str | None = None) -> DataFrame:
        """Overwrite table ``name``; ``sort_by`` clusters rows inside each
        file so min/max statistics can skip row groups on that column.
        ``bucket_by`` (with a database) writes a bucketed catalog table."""
        obs = Observation(f"rows-{name}-{uuid.uuid4().hex[:8]}")
        observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
        if bucket_by and self.database:
            w = observed.write.mode("overwrite").bucketBy(self.buckets, bucket_by)
            w = w.sortBy(*sort_by) if sort_by else w.sortBy(bucket_by)
            w.option("path", self.path(name)).saveAsTable(f"{self.database}.{name}")
            self.catalog_tables.add(name)
        else:
            if sort_by:
                observed = observed.sortWithinPartitions(*sort_by)
            observed.write.mode("overwrite").parquet(self.path(name))
        self.counts[name] = int(obs.get["rows"])
        return self.table(name)

    def save_counts(self) -> None:
        """Write the row counts observed during this refresh (one small table)."""
        rows = [(n, c) for n, c in self.counts.items() if n != "table_counts"]
        self.write("table_counts", self.spark.createDataFrame(rows, "name string, rows long").coalesce(1))

    def table(self, name: str) -> DataFrame:
        if name in self.bronze:
            return self.bronze[name].current()
        if name in self.catalog_tables:           # keeps the bucketing information
            return self.spark.table(f"{self.database}.{name}")
        return self.spark.read.parquet(self.path(name))

    def tables(self, names) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in names}

    def register(self, database: str, names) -> None:
        """Name the written tables in the session catalog as
        ``database.name`` (external parquet tables at their folders, with a
        description), so SQL text can read them by name."""
        sql = self.spark.sql
        sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{self.path('_catalog')}'")
        for n in names:
            note = TABLE_COMMENTS.get(n, "").replace("'", "")
            sql(f"CREATE TABLE IF NOT EXISTS {database}.{n} USING parquet LOCATION '{self.path(n)}'"
                + (f" COMMENT '{note}'" if note else ""))


TABLE_COMMENTS = {
    "customers_raw": "Bronze customer rows as received",
    "orders_raw": "Bronze order rows as received",
    "inventory_raw": "Bronze daily inventory movements as received",
    "crm_events_raw": "Bronze CRM events with generated notes",
    "staffing_raw": "Bronze headcount per store and role",
    "stores": "Store dimension with region", "skus": "SKU dimension with category and list price",
    "customers": "Typed customers, one row per customer_id",
    "orders": "Typed orders, one row per order_id, sorted by date within files",
    "inventory": "One row per store, SKU and day with the trailing 7-row demand average",
    "crm_summary": "Per-customer CRM event counts and last contact",
    "customer_360": "One row per customer: 90-day order features, CRM counts, churn flag",
    "inventory_health": "Latest-day days of supply and reorder status per store and SKU",
    "store_staffing_summary": "Headcount gap and status per store and role",
    "demand_forecast": "Latest-day 7/14-row demand, trend and 7-day projection per SKU",
    "churn_scores": "Model churn probability and risk tier per customer",
    "churn_scores_rule": "Rule-based churn probability and risk tier per customer",
    "rag_documents": "One labelled text document per customer",
}


def _max_date(df: DataFrame, column: str) -> dt.date | None:
    """One scalar: the latest date of a source (its run date)."""
    return df.agg(F.max(column)).first()[0]


# ---------------------------------------------------------------- refresh

def refresh_bronze(wh: Warehouse, sf_dir: str) -> None:
    """Bronze passthrough datasets and the dimensions."""
    for name, df in Source(wh.spark, sf_dir).bronze().items():
        wh.write(name, df)


def ingest_bronze(wh: Warehouse, drops: str, fmt: str = "csv") -> dict[str, int]:
    """Takes in the new export files below ``drops``/<table>; the tables are then read as ingested.

    Returns the new commit of each table that had news.
    """
    found = {}
    for name in RAW_SCHEMAS:
        bronze = Bronze(wh.spark, wh.path(f"ingest_{name}"), name, fmt)
        commit = bronze.ingest(os.path.join(drops, name))
        if commit is not None:
            found[name] = commit
        wh.bronze[name] = bronze
    return found


def refresh_silver(wh: Warehouse, t: Thresholds = DEFAULT) -> None:
    """Q1-Q4 from the bronze tables, with warn-only expectations observed
    while writing (D1) and written to ``expectations``."""
    results = []
    for name, df, rules_key, sort, bucket in [
            ("customers", silver.silver_customers(wh.table("customers_raw")), "customers", None,
             "customer_id"),
            ("orders", silver.silver_orders(wh.table("orders_raw")), "orders", ["order_date"], "customer_id"),
            ("inventory", silver.silver_inventory(wh.table("inventory_raw"), t.short_rows), "inventory", None,
             None)]:
        observed, obs = quality.expect(df, C.EXPECTATIONS[rules_key], name)
        wh.write(name, observed, sort, bucket_by=bucket)
        m = obs.get
        results += [(rules_key, rule, int(m["rows"]), int(m[rule])) for rule in C.EXPECTATIONS[rules_key]]
    wh.write("expectations", wh.spark.createDataFrame(
        results, "dataset string, rule string, rows long, failed long").coalesce(1))
    events = wh.table("crm_events_raw")
    wh.write("crm_summary", silver.crm_summary(events, _max_date(events, "event_date")),
             bucket_by="customer_id")


def refresh_gold(wh: Warehouse, t: Thresholds = DEFAULT) -> None:
    """Q5-Q8."""
    orders = wh.table("orders")
    as_of = _max_date(orders, "order_date")
    features = gold.order_features(orders, as_of, t.lookback_days)
    stores = wh.table("stores")
    wh.write("customer_360", gold.customer_360(wh.table("customers"), stores, features,
                                               wh.table("crm_summary"), t.churn_days, audit=True))
    wh.write("inventory_health", gold.inventory_health(wh.table("inventory"), t.reorder_days,
                                                       t.watch_days, window_rows=t.short_rows))
    wh.write("store_staffing_summary", gold.staffing_summary(wh.table("staffing_raw"), stores))


def refresh_forecast(wh: Warehouse, t: Thresholds = DEFAULT) -> None:
    """Q9/Q10 from the silver inventory."""
    signals = wh.write("demand_signals_exact", forecast.demand_signals_exact(wh.table("inventory"), t))
    wh.write("demand_forecast", forecast.demand_forecast(signals, t))


def refresh_churn(wh: Warehouse, model: bool = True) -> None:
    """M1 labels, rule-score twin and (optionally) the GBT model scores."""
    c360 = wh.table("customer_360")
    wh.scores = "churn_scores" if model else "churn_scores_rule"
    with scratch_scope(wh.spark):
        labels = wh.write("churn_labels", churn.churn_label(c360))
        wh.write("churn_scores_rule", churn.rule_scores(c360))
        if model:
            fitted, metrics, path = churn.fit_churn(c360, labels, model_path=wh.path("churn_model"))
            wh.write("churn_model_metrics", metrics.coalesce(1))
            wh.write("churn_scores", churn.score_churn(fitted, c360))


def refresh_corpus(wh: Warehouse) -> None:
    """Q32 text corpus."""
    wh.write("rag_documents", corpus.rag_documents(wh.table("customer_360"), wh.table("crm_events_raw")))


def refresh_vectors(wh: Warehouse) -> None:
    """Fit the text embedding on the corpus, save it, write the vectors."""
    docs = wh.table("rag_documents")
    model = retrieval.embed(docs, "document")
    model.write().overwrite().save(wh.path("embedding_model"))
    wh.write("rag_vectors", retrieval.vectors(model, docs.select("doc_id", "document"), "document")
             .select("doc_id", "vector"))


CONTEXT_NAMES = ["kpi", "inventory", "region", "demand", "staffing", "total_customers"]


def refresh_assistant_context(wh: Warehouse) -> None:
    """G7 inputs, computed once per refresh: the five context sentences and
    the customer count as a one-row table (the live numbers every question
    is grounded in until the next refresh)."""
    texts = assistant.context_texts(wh.table(scores_table(wh)), wh.table("inventory_health"),
                                    wh.table("demand_forecast"), wh.table("store_staffing_summary"))
    one = wh.table("stores").agg(F.count(F.lit(1)).alias("_n"))     # any one-row frame
    wh.write("assistant_context", one.select(*[texts[n].alias(n) for n in CONTEXT_NAMES]).coalesce(1))


def refresh_all(spark: SparkSession, sf_dir: str, root: str, t: Thresholds = DEFAULT,
                model: bool = True) -> Warehouse:
    wh = Warehouse(spark, root)
    refresh_bronze(wh, sf_dir)
    refresh_silver(wh, t)
    refresh_gold(wh, t)
    refresh_forecast(wh, t)
    refresh_churn(wh, model)
    refresh_corpus(wh)
    refresh_vectors(wh)
    refresh_assistant_context(wh)
    wh.save_counts()
    return wh


def refresh_atomic(spark: SparkSession, sf_dir: str, root: str, t: Thresholds = DEFAULT, model: bool = True,
                   keep: int = 2) -> Warehouse:
    """A refresh whose tables become visible together. Each refresh writes a folder of its own; the manifest
    that names it is the last thing written. Readers that hold an older version keep it until ``keep`` newer ones exist."""
    versions = Versions(spark, root)
    n = versions.next_number()
    folder = f"refresh-{n}-{uuid.uuid4().hex[:8]}"
    wh = refresh_all(spark, sf_dir, os.path.join(versions.root, folder), t, model)
    versions.publish(n, {"folders": [folder], "scores": wh.scores, "tables": wh.counts})
    versions.retire(keep)
    return open_version(spark, root, n)


def open_version(spark: SparkSession, root: str, n: int | None = None) -> Warehouse:
    """The tables of a published refresh, the latest one by default."""
    held = Versions(spark, root).read(n)
    if held is None:
        raise FileNotFoundError(f"no refresh has been published at {root}")
    wh = Warehouse(spark, os.path.join(root, held["folders"][0]), scores=held["scores"])
    wh.counts = dict(held["tables"])
    return wh


# ---------------------------------------------------------------- serving

def scores_table(wh: Warehouse) -> str:
    return wh.scores


def serve_summary(wh: Warehouse, with_tiers: bool = True) -> DataFrame:
    return kpis.executive_summary(wh.table(scores_table(wh)), wh.table("customer_360"),
                                  wh.table("inventory_health"), with_tiers=with_tiers)


def serve_churn_list(wh: Warehouse) -> DataFrame:
    return kpis.churn_risk_list(wh.table(scores_table(wh)), 25)


def serve_regional_churn(wh: Warehouse) -> DataFrame:
    return kpis.regional_churn_pivot(wh.table(scores_table(wh)))


def serve_churn_by_segment(wh: Warehouse) -> DataFrame:
    return kpis.churn_by_segment(wh.table(scores_table(wh)))


def serve_demand(wh: Warehouse) -> DataFrame:
    return forecast.demand_serving(wh.table("demand_forecast"), 20)


def serve_inventory_alerts(wh: Warehouse) -> DataFrame:
    return kpis.inventory_alerts_served(wh.table("inventory_health"), wh.table("stores"), 25)


def _layer_names(wh: Warehouse) -> dict[str, str]:
    names = {label: label.split(".", 1)[1] for label, _, _ in C.LAYER_TABLES}
    return {label: (n if n != "churn_scores" else scores_table(wh)) for label, n in names.items()}


def serve_platform_stats(wh: Warehouse) -> DataFrame:
    """Q26 from the row counts the refresh recorded while writing."""
    labels = wh.spark.createDataFrame(list(_layer_names(wh).items()), "tbl string, name string")
    counts = labels.join(wh.table("table_counts"), "name").select("tbl", "rows")
    return kpis.platform_stats_from(counts)


def serve_platform_stats_live(wh: Warehouse) -> DataFrame:
    """Q26 by counting every table now; a table that is not there counts 0."""
    there = {label: wh.table(n) for label, n in _layer_names(wh).items() if folder_names(wh.spark, wh.path(n))}
    if not there:
        return kpis.platform_stats_from(wh.spark.createDataFrame([], "tbl string, rows long"))
    return kpis.platform_stats(there)


def serve_last_updated(wh: Warehouse) -> DataFrame:
    """Q26: when the customer profile was last rebuilt."""
    return wh.table("customer_360").agg(F.max("updated_at").alias("last_updated"))


def serve_retrieval(wh: Warehouse, questions: DataFrame, k: int = C.RETRIEVAL_TOP_K) -> DataFrame:
    """Top-k corpus documents per question and the filled prompt."""
    from pyspark.ml import PipelineModel

    model = PipelineModel.load(wh.path("embedding_model"))
    qv = retrieval.vectors(model, questions, "question").select("question_id", "vector")
    hits = retrieval.top_k(qv, wh.table("rag_vectors"), k, q_id="question_id", c_id="doc_id")
    return retrieval.rag_prompts(retrieval.assemble_context(questions, hits, wh.table("rag_documents")))


def serve_chat(wh: Warehouse, questions: DataFrame) -> DataFrame:
    """G6-G8 over the context table written by the refresh."""
    ctx = wh.table("assistant_context")
    return assistant.ground(questions, {n: ctx.select(n).scalar() for n in CONTEXT_NAMES})


SERVING = {
    "summary": serve_summary, "churn_scores": serve_churn_list, "regional_churn": serve_regional_churn,
    "churn_by_segment": serve_churn_by_segment, "demand_forecast": serve_demand,
    "inventory_alerts": serve_inventory_alerts, "platform_stats": serve_platform_stats,
    "last_updated": serve_last_updated,
}
