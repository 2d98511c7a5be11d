"""Exact arithmetic beyond 2^53, money below a cent, one rounding of probabilities, tiers, shared folder."""

import pytest
from pyspark.sql import functions as F

from aislelens import session
from aislelens.functions.exact import MONEY_SCALE, floor_div, micros, money, round_ratio
from aislelens.operators import churn, gold, kpis


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_floor_div_beyond_double(spark):
    assert one(spark, floor_div(F.lit(42551445720978573), F.lit(88934289775678))) == 478
    assert one(spark, floor_div(F.lit(-7), 2)) == -4
    n = 9 * 10 ** 18
    assert one(spark, round_ratio(F.lit(n), F.lit(3 * 10 ** 17), 3)) == 30.0
    assert one(spark, round_ratio(F.lit(1), F.lit(0), 3)) is None


def test_money_below_a_cent(spark):
    rows = spark.createDataFrame([(1.005,), (1.004,), (1.004,)], "v double")
    assert rows.agg(money(F.sum(micros("v"))).alias("x")).first()["x"] == 3.013
    assert rows.agg(round_ratio(F.sum(micros("v")), F.lit(MONEY_SCALE), 2).alias("x")).first()["x"] == 3.01
    orders = spark.createDataFrame([(1, 7, "2024-01-0%d" % (k + 1), v, False) for k, v in enumerate([1.005, 1.004, 1.004])],
                                   "order_id long, customer_id long, order_date string, order_value double, is_returned boolean")
    row = gold.order_features(orders.withColumn("order_date", F.to_date("order_date"))).first()
    assert row["total_spend_90d"] == 3.013 and row["avg_order_value"] == 1.0


def test_probability_is_rounded_once(spark):
    scores = spark.createDataFrame([(1, "n", 1, "r", "s", 1, 1, 2.345, 0.1234996, "High"), (2, "n", 1, "r", "s", 1, 1, 2.0, 0.1235004, "High")],
                                   ", ".join(f"{c} {t}" for c, t in zip(churn.SCORE_COLUMNS, ["long", "string", "long", "string", "string", "long",
                                                                                          "long", "double", "double", "string"])))
    assert [r["churn_prob"] for r in kpis.top_churn_risk(scores).collect()] == [0.124, 0.123]
    assert kpis.assistant_kpis(scores).first()["avg_churn_pct"] == 12.4


@pytest.mark.parametrize("p, tier", [(0.0, "Low"), (0.33, "Low"), (0.66, "Medium"), (1.0, "High"), (None, None), (1.5, None)])
def test_tiers(spark, p, tier):
    assert one(spark, churn.risk_tier(F.lit(p).cast("double"))) == tier


def test_shared_folder_must_be_named_off_local():
    assert session.is_local("local[8]") and session.is_local("local")
    assert not session.is_local("local-cluster[3,2,1024]") and not session.is_local("yarn")

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster)


def test_date_filter_reaches_the_orders_scan_below_the_dedup(spark):
    from aislelens.plans.datasets import Datasets
    from tests.conftest import SMOKE

    plan = Datasets(spark, SMOKE).order_features._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.rindex("Filter")          # the filter lies below the window
    below = plan[plan.index("Window"):]
    assert "o_orderdate" in below and "date_sub" in below or "scalar-subquery" in below


def test_scratch_tables_go_at_the_end_of_their_scope(spark):
    out = session.scratch_path(spark, "kept")
    with session.scratch_scope(spark):
        inner = session.materialise(spark.range(5).toDF("x"), "inner")
        path = inner.inputFiles()[0].rpartition("/")[0]
        inner.write.parquet(out)
    assert session.folder_names(spark, path) == [] and spark.read.parquet(out).count() == 5


def test_model_cache_sees_new_data(spark):
    folder = session.scratch_path(spark, "state")
    spark.range(3).write.parquet(folder)
    before = session.file_state(spark, folder)
    spark.range(4).write.mode("overwrite").parquet(folder)
    assert session.file_state(spark, folder) != before
