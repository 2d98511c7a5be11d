"""Churn labels, model and scores (M1-M9, Q12, Q13)."""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import materialise, shared_dir
from .select import rank_sum, top_rows

FIT_PART_ROWS = 25_000            # training customers in a task of a boosting pass, on average; more, as long as
FIT_PART_MOST = 250_000           # each core has a task
BINS = 32                         # of a feature
RANKS = 10_000                    # the share of the rows by which a bin's rank may be off is one in so many
LEAST_AUC = 0.9                   # on a label that the features decide
PLAIN_AUC = 0.6                   # on churn_label, whose ties are cut by customer_id, which no feature holds
CHECK_TREES = 10
SCORE_COLUMNS = ["customer_id", "customer_name", "store_id", "region", "segment", "recency_days",
                 "order_count_90d", "total_spend_90d", "churn_prob", "risk_tier"]


def top_share_flag(df: DataFrame, score: str, key: str, share: float = C.CHURN_LABEL_SHARE,
                   minimum: int = C.CHURN_LABEL_MINIMUM, out: str = "churn_label") -> DataFrame:
    """Flag the first ``max(minimum, floor(share * n))`` rows by ``score``
    descending, ties broken by ``key`` ascending (unique, integral).

    The cut is found by radix selection (``select.top_rows``): counts by
    digit, for scores of any type and any number of distinct values, and no
    window over all rows or over a histogram of them.
    """
    df = materialise(df, "top-share-input")
    k = max(minimum, math.floor(share * df.count()))
    return df.withColumn(out, top_rows(df, score, key, k).cast("int"))


def churn_label(c360: DataFrame, share: float = C.CHURN_LABEL_SHARE,
                minimum: int = C.CHURN_LABEL_MINIMUM) -> DataFrame:
    """Q12/M1: top ``share`` of customers by recency_days are churners."""
    return top_share_flag(c360.select("customer_id", "recency_days"), "recency_days",
                          "customer_id", share, minimum)


def risk_tier(prob: Column, cuts=C.TIER_CUTS) -> Column:
    """M7: right-closed bins up to 0.33 Low, 0.66 Medium, 1.001 High; no tier
    beyond or without a probability."""
    low, mid = cuts
    return (F.when(prob <= low, C.TIER_LABELS[0]).when(prob <= mid, C.TIER_LABELS[1])
            .when(prob <= C.TIER_TOP, C.TIER_LABELS[2]))


def rule_scores(c360: DataFrame, cuts=C.TIER_CUTS, places: int | None = 6) -> DataFrame:
    """Deterministic twin of the model scores: a logistic rule on recency
    and recent order count, rounded to ``places`` (None: raw, as a model's
    probabilities are). Same schema as ``score_churn`` so every KPI can be
    checked against SQL."""
    z = -(F.col("recency_days") - 60) / 20.0 + 0.3 * F.col("order_count_90d")
    prob = 1.0 / (1.0 + F.exp(z))
    prob = prob if places is None else F.round(prob, places)
    return (c360.withColumn("churn_prob", prob)
            .select(*SCORE_COLUMNS[:-1], risk_tier(F.col("churn_prob"), cuts).alias("risk_tier")))


def _features(c360: DataFrame, labels: DataFrame | None):
    data = c360.na.fill(0, C.CHURN_FEATURES)
    if labels is not None:
        data = data.join(labels.select("customer_id", "churn_label"), "customer_id")
    return data.withColumns({f: F.col(f).cast("double") for f in C.CHURN_FEATURES})


def bin_edges(train: DataFrame) -> list[list[float]]:
    """Per feature the ends of at most BINS bins, from all rows: every value where there are that few, else quantiles
    (a sketch of all rows, off by one in RANKS of them). A value on an end belongs to the bin below."""
    ranks = [i / BINS for i in range(1, BINS)]
    seen = train.agg(*[F.approx_count_distinct(f).alias(f"n_{f}") for f in C.CHURN_FEATURES],
                     *[F.percentile_approx(f, ranks, RANKS).alias(f"q_{f}") for f in C.CHURN_FEATURES]).first()
    few = [f for f in C.CHURN_FEATURES if (seen[f"n_{f}"] or 0) <= 2 * BINS]  # the count is a sketch
    values = train.agg(F.count(F.lit(1)), *[F.collect_set(f).alias(f) for f in few]).first()
    cuts = {f: sorted(values[f])[:-1] if f in few and len(values[f]) <= BINS else sorted(set(seen[f"q_{f}"]))
            for f in C.CHURN_FEATURES}
    inner = ([math.nextafter(v, math.inf) for v in cuts[f]] or [0.0] for f in C.CHURN_FEATURES)
    return [[-math.inf, *ends, math.inf] for ends in inner]


def fit_churn(c360: DataFrame, labels: DataFrame, model_path: str | None = None,
              seed: int = C.GBT_SEED, max_iter: int = C.GBT_TREES):
    """M2-M5, M8, M9: gradient-boosted trees on the nine features.

    Split: 1 in 5 customers by a hash of customer_id is test data (stable
    under repartitioning, unlike ``randomSplit``). All others are used to
    fit: the ends of the features' bins come from all of them, and so do the
    trees. The boosting passes (several hundred) run over parts dealt by
    customer_id, as many as these rows need, however many files the features
    lie in. Returns (model, metrics DataFrame[run_id, key, value], model path).
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Bucketizer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    spark = c360.sparkSession
    # features + label written once to the shared folder: the boosting passes
    # re-read a short lineage, and GBT caches its own training instances
    data = materialise(_features(c360, labels).select(
        "customer_id", *C.CHURN_FEATURES, F.col("churn_label").cast("double").alias("label")), "churn-features")
    is_test = F.pmod(F.xxhash64(F.col("customer_id"), F.lit(seed)), F.lit(C.TEST_SHARE_BUCKETS)) == 0
    test, fitted = data.filter(is_test), data.filter(~is_test)
    rows = fitted.count()
    parts = min(math.ceil(rows / FIT_PART_ROWS), max(spark.sparkContext.defaultParallelism, math.ceil(rows / FIT_PART_MOST)))
    train = materialise(fitted.repartition(max(1, parts), "customer_id").sortWithinPartitions("customer_id"), "churn-train")
    names = [f"{f}_bin" for f in C.CHURN_FEATURES]
    binned = PipelineModel([Bucketizer(splitsArray=bin_edges(train), inputCols=C.CHURN_FEATURES, outputCols=names),
                            VectorAssembler(inputCols=names, outputCol="features")])
    # MLlib looks for thresholds in a sample of maxBins ** 2 rows: here that is all of them, and as no feature has
    # more than BINS values, it is these that it tells apart
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=max_iter, maxBins=max(BINS, math.isqrt(rows) + 1),
                        maxDepth=C.GBT_DEPTH, stepSize=C.GBT_STEP, seed=seed, checkpointInterval=10)
    plain = F.col("features").alias("features", metadata={})  # bins are in order, no categories
    trees = gbt.fit(binned.transform(train).select(plain, "label"))
    model = PipelineModel([*binned.stages, trees])
    scored = model.transform(test).select("label", vector_to_array("probability").getItem(1).alias("churn_prob"))
    auc = rank_sum(scored, "churn_prob", "label").first()["auc"]
    auc = float("nan") if auc is None else auc  # one class alone has no curve
    run_id = uuid.uuid4().hex
    model_path = model_path or os.path.join(shared_dir(spark), "models", f"churn-gbt-{run_id}")
    model.write().overwrite().save(model_path)
    imp = trees.featureImportances.toArray().tolist()
    facts = ([(run_id, "roc_auc", round(float(auc), 4))]
             + [(run_id, f"feat_{f}", round(float(v), 4)) for f, v in zip(C.CHURN_FEATURES, imp)]
             + [(run_id, "param_n_estimators", float(max_iter)), (run_id, "param_max_depth", float(C.GBT_DEPTH)),
                (run_id, "param_learning_rate", float(C.GBT_STEP)), (run_id, "param_random_state", float(seed))])
    metrics = spark.createDataFrame(facts, "run_id string, key string, value double")
    return model, metrics, model_path


def score_churn(model, c360: DataFrame, cuts=C.TIER_CUTS) -> DataFrame:
    """M6/M7/Q13: probability of churn for every customer plus its tier."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(_features(c360, None))
    return (scored.withColumn("churn_prob", vector_to_array(F.col("probability")).getItem(1))
            .withColumn("risk_tier", risk_tier(F.col("churn_prob"), cuts))
            .select(*SCORE_COLUMNS))


def high_value_label(c360: DataFrame, share: float = C.CHURN_LABEL_SHARE) -> DataFrame:
    """W5 on a continuous score: the customers with the highest 90-day spend."""
    return top_share_flag(c360.select("customer_id", "total_spend_90d"), "total_spend_90d", "customer_id", share, 0, "high_value")


def decided_metrics(c360: DataFrame) -> DataFrame:
    """Metrics of a small model of ``is_churned``, which recency_days decides: what the fit can learn, it must."""
    labels = c360.select("customer_id", F.col("is_churned").alias("churn_label"))
    return fit_churn(c360, labels, max_iter=CHECK_TREES)[1]


def model_checks(metrics: DataFrame, scores: DataFrame, c360: DataFrame, decided: DataFrame) -> DataFrame:
    """Facts that hold for any fitted model, one row per check: (check, ok)."""
    one = scores.agg(
        (F.count(F.lit(1)) == c360.agg(F.count(F.lit(1))).scalar()).alias("one score per customer"),
        F.bool_and(F.col("churn_prob").between(0, 1)).alias("probabilities in 0..1"),
        F.bool_and(F.col("risk_tier") == risk_tier(F.col("churn_prob"))).alias("tiers follow the probabilities"))
    fit = metrics.agg(
        (F.abs(F.sum(F.when(F.col("key").startswith("feat_"), F.col("value"))) - 1) < 1e-3).alias("importances sum to 1"),
        F.bool_and(F.when(F.col("key") == "roc_auc", F.col("value") >= PLAIN_AUC)).alias("held-out AUC"))
    sure = decided.agg(F.bool_and(F.when(F.col("key") == "roc_auc", F.col("value") >= LEAST_AUC)).alias("held-out AUC of a decided label"))
    return _as_rows(one).unionByName(_as_rows(fit)).unionByName(_as_rows(sure))


def _as_rows(checks: DataFrame) -> DataFrame:
    named = [F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("ok")) for c in checks.columns]
    return checks.select(F.inline(F.array(*named)))


def feature_importances(metrics: DataFrame) -> DataFrame:
    """M8 as rows: (feature, importance)."""
    return (metrics.filter(F.col("key").startswith("feat_"))
            .select(F.regexp_replace("key", "^feat_", "").alias("feature"),
                    F.col("value").alias("importance")))
