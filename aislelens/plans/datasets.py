"""The dataset graph: bronze -> silver -> gold, as composed DataFrames.

``Datasets`` exposes every dataset lazily; nothing runs until an action.
Each registered query is one self-contained plan from the raw tables to its
result. ``plans.warehouse`` is the materialised counterpart: it writes the
datasets stage by stage and serves queries from the written tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..operators import assistant, churn, corpus, forecast, gold, retrieval, silver
from ..operators.dedup import as_of_date
from ..session import file_state, materialise
from ..sources.adapter import Source


# fitted churn models of this process, by application, thresholds and the state of the input files
_FITTED: dict = {}


class Datasets:
    def __init__(self, spark: SparkSession, sf_dir: str, thresholds: Thresholds = DEFAULT,
                 orders_as_of=None, events_as_of=None, lag_days: int = 0):
        self.spark = spark
        self.src = Source(spark, sf_dir, lag_days)
        self.t = thresholds
        # two clocks: each source is dated by its own latest day unless given
        self.orders_as_of = orders_as_of
        self.events_as_of = events_as_of

    # -- bronze (S2) -------------------------------------------------------
    @property
    def stores(self) -> DataFrame:
        return self.src.stores

    # -- silver ------------------------------------------------------------
    @cached_property
    def customers(self) -> DataFrame:
        return silver.silver_customers(self.src.customers_raw)

    @cached_property
    def orders(self) -> DataFrame:
        return silver.silver_orders(self.src.orders_raw)

    def inventory(self, audit: bool = False) -> DataFrame:
        return silver.silver_inventory(self.src.inventory_raw, self.t.short_rows, audit=audit)

    @cached_property
    def crm_summary(self) -> DataFrame:
        return silver.crm_summary(self.src.crm_events_raw, self.events_as_of)

    # -- gold --------------------------------------------------------------
    @cached_property
    def order_features(self) -> DataFrame:
        """Over the recent orders alone: the run date comes from the raw scan,
        and the date filter reaches it."""
        raw = self.src.orders_raw
        day = as_of_date(self.orders_as_of, silver.typed_orders(raw), "order_date")
        recent = silver.recent_orders(raw, F.date_sub(day, self.t.lookback_days))
        return gold.order_features(recent, day, self.t.lookback_days)

    def customer_360(self, audit: bool = False) -> DataFrame:
        return gold.customer_360(self.customers, self.stores, self.order_features,
                                 self.crm_summary, self.t.churn_days, audit=audit)

    @cached_property
    def inventory_health(self) -> DataFrame:
        return gold.inventory_health(self.inventory(), self.t.reorder_days, self.t.watch_days,
                                     self.latest_inventory_day, self.t.short_rows, self.src.inventory_parts)

    @cached_property
    def latest_inventory_day(self):
        """Latest inventory day from the raw rows: dedup keeps every
        (store, sku, day) key, so this equals the silver table's latest day
        without the dedup and window shuffles."""
        return self.src.inventory_raw.agg(F.max("txn_date")).scalar()

    @cached_property
    def staffing_summary(self) -> DataFrame:
        return gold.staffing_summary(self.src.staffing_raw, self.stores)

    # -- forecast ----------------------------------------------------------
    @cached_property
    def signals_exact(self) -> DataFrame:
        return forecast.demand_signals_exact(self.inventory(), self.t, self.src.inventory_parts)

    @cached_property
    def demand_signals(self) -> DataFrame:
        return forecast.demand_signals(self.inventory(), self.t, self.src.inventory_parts)

    @cached_property
    def demand_forecast(self) -> DataFrame:
        return forecast.demand_forecast(self.signals_exact, self.t, self.latest_inventory_day)

    @cached_property
    def daily_spine(self) -> DataFrame:
        return forecast.daily_spine(self.inventory(), self.t)

    # -- churn -------------------------------------------------------------
    @cached_property
    def churn_labels(self) -> DataFrame:
        return churn.churn_label(self.customer_360())

    @cached_property
    def rule_scores(self) -> DataFrame:
        """Deterministic scores (same schema as the model's) for the KPIs."""
        return churn.rule_scores(self.customer_360())

    @cached_property
    def raw_rule_scores(self) -> DataFrame:
        """The rule's unrounded probabilities, as a model gives them."""
        return churn.rule_scores(self.customer_360(), places=None)

    @cached_property
    def written_profile(self) -> DataFrame:
        """The profile written once: the labels, the fit and the scores read it."""
        return materialise(self.customer_360(), "customer-360")

    @property
    def fitted(self):
        """(model, metrics, path) of the GBT churn model, fitted once per
        state of the input files; new data in the same folder is fitted anew."""
        state = tuple(file_state(self.spark, f"{self.src.sf_dir}/{t}.parquet")
                      for t in ("customer", "orders", "events", "nation", "region"))
        key = (self.spark.sparkContext.applicationId, self.src.sf_dir, self.t, state)
        if key not in _FITTED:
            _FITTED[key] = churn.fit_churn(self.written_profile, churn.churn_label(self.written_profile))
        return _FITTED[key]

    @cached_property
    def model_scores(self) -> DataFrame:
        return churn.score_churn(self.fitted[0], self.written_profile)

    # -- text ----------------------------------------------------------------
    @cached_property
    def rag_documents(self) -> DataFrame:
        return corpus.rag_documents(self.customer_360(), self.src.crm_events_raw)

    def rag_changes(self, lag_days: int = 7) -> DataFrame:
        """Corpus rows changed since the snapshot ``lag_days`` earlier."""
        before = Datasets(self.spark, self.src.sf_dir, self.t, lag_days=lag_days).rag_documents
        cols = ["document", "customer_id", "customer_name", "segment", "region"]
        return corpus.changes(before, self.rag_documents, "doc_id", cols)

    def synced_vectors(self, lag_days: int = 7) -> DataFrame:
        """G2 sync: vectors of the corpus ``lag_days`` ago brought up to date
        through the change feed (same embedding model)."""
        before_docs = Datasets(self.spark, self.src.sf_dir, self.t, lag_days=lag_days).rag_documents
        before = retrieval.vectors(self.embedder, before_docs.select("doc_id", "document"), "document")
        return retrieval.sync_vectors(self.embedder, before.select("doc_id", "vector"),
                                      self.rag_changes(lag_days))

    @cached_property
    def assistant_texts(self):
        return assistant.context_texts(self.rule_scores, self.inventory_health, self.demand_forecast,
                                       self.staffing_summary)

    @cached_property
    def grounded_questions(self) -> DataFrame:
        return assistant.ground(self.src.questions, self.assistant_texts)

    @cached_property
    def written_documents(self) -> DataFrame:
        """The corpus written once: the embedding is fitted on it, and it is searched, counted and joined."""
        return materialise(self.rag_documents, "rag-documents")

    @cached_property
    def embedder(self):
        return retrieval.embed(self.written_documents, "document")

    @cached_property
    def retrieval_hits(self) -> DataFrame:
        docs = retrieval.vectors(self.embedder, self.written_documents.select("doc_id", "document"), "document")
        qs = retrieval.vectors(self.embedder, self.src.questions, "question")
        hits = retrieval.top_k(qs.select("question_id", "vector"), docs.select("doc_id", "vector"),
                               q_id="question_id", c_id="doc_id")
        return materialise(hits, "retrieval-hits")  # prompts and checks read them again

    @cached_property
    def retrieval_prompts(self) -> DataFrame:
        ctx = retrieval.assemble_context(self.src.questions, self.retrieval_hits, self.written_documents)
        return retrieval.rag_prompts(ctx)

    def centroid_neighbors(self, k: int = 5) -> DataFrame:
        """G3 on the given vectors: the k nearest embeddings to each
        label's mean vector."""
        emb = self.src.table("embeddings")
        cents = retrieval.label_centroids(emb)
        hits = retrieval.top_k(cents.select("label", "vector"),
                               emb.select("vec_id", F.col("embedding").alias("vector")), k,
                               q_id="label", c_id="vec_id")
        return hits.select("label", "vec_id", "rank", F.round("score", 6).alias("score"))

    # -- KPI inputs ----------------------------------------------------------
    def layer_tables(self, scores: DataFrame | None = None) -> dict[str, DataFrame]:
        """The 14 platform tables by their display names."""
        b = self.src
        return {
            "bronze.customers_raw": b.customers_raw, "bronze.orders_raw": b.orders_raw,
            "bronze.inventory_raw": b.inventory_raw, "bronze.crm_events_raw": b.crm_events_raw,
            "bronze.staffing_raw": b.staffing_raw,
            "silver.customers": self.customers, "silver.orders": self.orders,
            "silver.inventory": self.inventory(), "silver.crm_summary": self.crm_summary,
            "gold.customer_360": self.customer_360(),
            "gold.churn_scores": scores if scores is not None else self.rule_scores,
            "gold.inventory_health": self.inventory_health,
            "gold.demand_forecast": self.demand_forecast,
            "gold.store_staffing_summary": self.staffing_summary,
        }


class WrittenDatasets(Datasets):
    """The same datasets for queries that count or check many layers: what
    several of them read is written once to the shared folder, so each layer
    is computed in one pass instead of once per count."""

    def __init__(self, *args, **kwargs):
        super().__init__(*args, **kwargs)
        # the cached property of the source, replaced by its written form
        self.src.inventory_raw = materialise(self.src.inventory_raw, "inventory-raw")

    @cached_property
    def customers(self) -> DataFrame:
        return materialise(Datasets.customers.func(self), "customers")

    @cached_property
    def orders(self) -> DataFrame:
        return materialise(Datasets.orders.func(self), "orders")

    @cached_property
    def crm_summary(self) -> DataFrame:
        return materialise(Datasets.crm_summary.func(self), "crm-summary")

    @cached_property
    def _inventory(self) -> DataFrame:
        return materialise(Datasets.inventory(self), "inventory")

    def inventory(self, audit: bool = False) -> DataFrame:
        return self._inventory

    @cached_property
    def _customer_360(self) -> DataFrame:
        return materialise(Datasets.customer_360(self), "customer-360")

    def customer_360(self, audit: bool = False) -> DataFrame:
        return self._customer_360
