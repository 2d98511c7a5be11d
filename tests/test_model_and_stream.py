"""ML properties (not values) and the incremental refresh equal to batch."""

import os
import tempfile

from pyspark.sql import functions as F

from aislelens.operators import churn, silver
from aislelens.plans.datasets import Datasets
from aislelens.sources.adapter import crm_from_events
from aislelens.streaming.incremental import refresh_crm_summary
from tests.conftest import SMOKE


def test_gbt_properties(spark):
    p = Datasets(spark, SMOKE)
    c360 = p.customer_360()
    model, metrics, path = churn.fit_churn(c360, p.churn_labels, max_iter=5)
    scores = churn.score_churn(model, c360)
    assert scores.count() == c360.count()
    bad = scores.filter((F.col("churn_prob") < 0) | (F.col("churn_prob") > 1)).count()
    assert bad == 0
    tiers = scores.select(churn.risk_tier(F.col("churn_prob")).alias("t"), "risk_tier")
    assert tiers.filter(F.col("t") != F.col("risk_tier")).count() == 0
    m = {r["key"]: r["value"] for r in metrics.collect()}
    assert 0.0 <= m["roc_auc"] <= 1.0
    assert abs(sum(v for k, v in m.items() if k.startswith("feat_")) - 1.0) < 1e-3
    assert os.path.isdir(path)


def test_stream_refresh_equals_batch(spark):
    events = spark.read.parquet(f"{SMOKE}/events.parquet")
    d = tempfile.mkdtemp(prefix="events-split-")
    # three files -> three micro-batches with maxFilesPerTrigger=1
    events.repartition(3, "event_id").write.mode("overwrite").parquet(os.path.join(d, "in"))
    got = refresh_crm_summary(spark, os.path.join(d, "in"), max_files_per_trigger=1)
    want = silver.crm_summary(crm_from_events(events))
    cols = ["customer_id", "total_events", "complaints", "return_requests", "last_contact_date",
            "days_since_last_contact"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_vector_sync_equals_full_embedding(spark):
    from aislelens.operators import retrieval

    p = Datasets(spark, SMOKE)
    synced = p.synced_vectors(7)
    full = retrieval.vectors(p.embedder, p.rag_documents.select("doc_id", "document"), "document")
    a = sorted((r["doc_id"], tuple(r["vector"])) for r in synced.collect())
    b = sorted((r["doc_id"], tuple(r["vector"])) for r in full.select("doc_id", "vector").collect())
    assert a == b
    assert p.rag_changes(7).count() > 0          # the sync really had work to do


def test_stream_from_a_file_and_an_idle_trigger(spark):
    from aislelens.session import scratch_path

    out, ckpt = scratch_path(spark, "crm-out"), scratch_path(spark, "crm-ckpt")
    first = refresh_crm_summary(spark, f"{SMOKE}/events.parquet", out, ckpt)
    rows = sorted(map(tuple, first.collect()))
    assert rows
    again = refresh_crm_summary(spark, f"{SMOKE}/events.parquet", out, ckpt)   # no new file
    assert sorted(map(tuple, again.collect())) == rows


def test_stream_silver_orders_loses_no_order(spark):
    import datetime as dt

    from aislelens.session import scratch_path
    from aislelens.streaming.incremental import Epochs, refresh_silver_orders

    orders = spark.read.parquet(f"{SMOKE}/orders.parquet")
    customers = spark.read.parquet(f"{SMOKE}/customer.parquet")
    root = scratch_path(spark, "orders-stream")
    src, out, ckpt = (os.path.join(root, x) for x in ("in", "out", "ckpt"))

    def day(d):
        return F.lit(dt.datetime(2024, *d)).cast(orders.schema["o_orderdate"].dataType)

    orders.limit(300).write.parquet(src)
    refresh_silver_orders(spark, src, customers, out, ckpt)
    one = orders.limit(1)
    new = [one.withColumn("o_orderkey", F.lit(10 ** 9 + k).cast("long")).withColumn("o_orderdate", day(d))
           for k, d in enumerate([(3, 1), (2, 1), (3, 2)])]
    new[0].write.mode("append").parquet(src)
    refresh_silver_orders(spark, src, customers, out, ckpt)              # restarted from the checkpoint
    new[1].unionByName(new[2]).unionByName(one.withColumn("o_totalprice", F.lit(1.0))).write.mode("append").parquet(src)
    got = refresh_silver_orders(spark, src, customers, out, ckpt)        # a late new order, and a repeat
    from aislelens.sources.adapter import orders_view

    want = silver.silver_orders(orders_view(spark.read.parquet(src), customers))
    assert {10 ** 9, 10 ** 9 + 1, 10 ** 9 + 2} <= {r["order_id"] for r in got.collect()}
    rows = sorted(map(str, want.collect()))
    assert sorted(map(str, got.collect())) == rows
    assert sorted(map(str, refresh_silver_orders(spark, src, customers, out, ckpt).collect())) == rows
    store = Epochs(spark, out, want.schema, ["order_id"], silver.order_survivor())
    store.compact(at_least=2)
    assert sorted(map(str, store.current().collect())) == rows


def test_stream_answers_equal_batch_grounding(spark):
    from aislelens.operators import assistant
    from aislelens.session import scratch_path
    from aislelens.streaming.incremental import stream_answers

    p = Datasets(spark, SMOKE)
    qs = p.src.questions
    root = scratch_path(spark, "answers-stream")
    qs.repartition(3, "question_id").write.parquet(os.path.join(root, "in"))
    got = stream_answers(spark, os.path.join(root, "in"), os.path.join(root, "out"),
                         os.path.join(root, "ckpt"), p.assistant_texts, max_files_per_trigger=1)
    want = assistant.ground(qs, p.assistant_texts)
    cols = ["question_id", "context", "context_used", "answer"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_stream_expectations_per_epoch(spark):
    """Counts of every epoch are written with it; a restart adds its own; they sum to those of all rows."""
    from aislelens.session import folder_names, scratch_path
    from aislelens.streaming import incremental as I

    orders = spark.read.parquet(f"{SMOKE}/orders.parquet")
    customers = spark.read.parquet(f"{SMOKE}/customer.parquet")
    root = scratch_path(spark, "orders-expected")
    src, out, ckpt, said = (os.path.join(root, x) for x in ("in", "out", "ckpt", "said"))
    bad = orders.limit(7).withColumn("o_totalprice", F.lit(-1.0))
    for part in (orders.limit(200).repartition(4), bad):
        part.write.mode("append").parquet(src)
        I.refresh_silver_orders(spark, src, customers, out, ckpt, max_files_per_trigger=2, expectations=said)
    got = {r.rule: (r.rows, r.failed) for r in I.expectations_so_far(spark, said).collect()}
    assert got == {"valid_order_value": (207, 7), "valid_order_date": (207, 0)}
    assert len(folder_names(spark, said)) >= 3


def test_boosting_runs_over_as_few_parts_as_its_rows_need(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    c360 = Datasets(spark, SMOKE).customer_360().repartition(40)
    seen, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, data: seen.append((data.rdd.getNumPartitions(), data.count())) or fit(self, data))
    monkeypatch.setattr(churn, "FIT_PART_ROWS", 50)
    n = c360.count()
    churn.fit_churn(c360, churn.churn_label(c360), max_iter=1)
    (parts, rows), = seen
    assert parts <= -(-n // 50) < 8 and 0.6 * n < rows < n


def test_the_profile_is_computed_once_for_labels_fit_and_scores(spark, monkeypatch):
    from aislelens.plans import datasets

    calls, profile = [], Datasets.customer_360
    monkeypatch.setattr(datasets, "_FITTED", {})
    monkeypatch.setattr(Datasets, "customer_360", lambda self, audit=False: calls.append(1) or profile(self, audit))
    monkeypatch.setattr(churn, "fit_churn", lambda c360, labels: (labels.count(), None, None))
    monkeypatch.setattr(churn, "score_churn", lambda model, c360: c360.limit(model))
    assert Datasets(spark, SMOKE).model_scores.count() == Datasets(spark, SMOKE).customers.count()
    assert len(calls) == 1


def test_all_training_customers_and_rare_values_shape_the_model(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    from aislelens import config as C

    ids = spark.range(260_000).withColumnRenamed("id", "customer_id")  # a cap was at 200,000
    rare = F.col("customer_id") % 20_000 == 7
    age = F.when(rare, 99).otherwise(F.col("customer_id") % 20 + 20)
    c360 = ids.select("customer_id", *[(age if f == "age" else F.lit(0)).alias(f) for f in C.CHURN_FEATURES])
    seen, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, data: seen.append((data.count(), self.getMaxBins() ** 2)) or fit(self, data))
    model, metrics, _ = churn.fit_churn(c360, ids.select("customer_id", rare.cast("int").alias("churn_label")), max_iter=2)
    is_test = F.pmod(F.xxhash64(F.col("customer_id"), F.lit(C.GBT_SEED)), F.lit(C.TEST_SHARE_BUCKETS)) == 0
    (rows, sampled), = seen
    assert rows == ids.filter(~is_test).count() <= sampled  # MLlib takes thresholds from so many rows at most
    scored = model.transform(c360.withColumn("age", F.col("age").cast("double"))).groupBy("age").agg(F.max("prediction").alias("p"))
    assert {r.age: r.p for r in scored.collect()} == {99.0: 1.0} | {float(20 + i): 0.0 for i in range(20)}
    assert {r.key: r.value for r in metrics.collect()}["feat_age"] == 1.0


def test_bins_hold_every_value_where_few_and_quantiles_where_many(spark):
    from aislelens import config as C

    n = 20_000
    rows = spark.range(n).select(*[F.when(F.col("id") == 5, 9.0).otherwise(F.col("id") % 4).alias(f) if f == "age" else
                                   F.col("id").cast("double").alias(f) for f in C.CHURN_FEATURES])
    edges = dict(zip(C.CHURN_FEATURES, churn.bin_edges(rows)))
    assert [round(v, 9) for v in edges["age"][1:-1]] == [0, 1, 2, 3]  # one row holds the 9
    many = edges["recency_days"]
    assert len(many) == churn.BINS + 1 and all(abs(v - i * n / churn.BINS) <= 5 for i, v in enumerate(many) if 0 < i < churn.BINS)
