"""Radix selection and rank sums against plain Python."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from aislelens.operators.churn import top_share_flag
from aislelens.operators.select import image, kth, rank_sum, top_rows


def bits(x):
    n = struct.unpack(">q", struct.pack(">d", abs(x)))[0]
    return -n if x < 0 else n


def test_image_is_the_bit_pattern(spark):
    rng = random.Random(1)
    xs = [struct.unpack(">d", struct.pack(">Q", rng.getrandbits(64)))[0] for _ in range(20_000)]
    xs = [x for x in xs if not math.isnan(x)]
    xs += [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf, -math.inf, 1.0, 2.0, 0.5]
    xs += [2.0 ** e for e in range(-1074, 1024)] + [math.nextafter(2.0 ** e, s) for e in range(-1073, 1023) for s in (0, math.inf)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,), (math.nan,)], "x double")
    got = df.select("x", image(df, "x").alias("i")).collect()
    assert all(r.i == bits(r.x) for r in got if r.x is not None and not math.isnan(r.x))
    by = {str(r.x): r.i for r in got}
    assert by["None"] == -(1 << 63) and by["nan"] > by["inf"]


@pytest.mark.parametrize("seed", range(3))
def test_kth(spark, seed):
    rng = random.Random(seed)
    xs = [rng.choice([rng.getrandbits(63), -rng.getrandbits(63), rng.randint(-3, 3), -(1 << 63), (1 << 63) - 1]) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    up, down = sorted(xs), sorted(xs, reverse=True)
    for k in (1, 2, 250, 499, 500):
        assert kth(df, "x", k) == (up[k - 1], up.index(up[k - 1]))
        assert kth(df, "x", k, descending=True) == (down[k - 1], down.index(down[k - 1]))


@pytest.mark.parametrize("kind", ["double", "int", "date"])
def test_top_rows(spark, kind):
    rng = random.Random(4)
    rows = [(k * 7 - 900, rng.choice([None, rng.gauss(0, 1), 0.25, 0.25])) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, x double")
    if kind == "int":
        df = df.withColumn("x", F.round(F.col("x") * 3).cast("int"))
    if kind == "date":
        df = df.withColumn("x", F.date_add(F.lit("2024-01-01").cast("date"), F.round(F.col("x") * 30).cast("int")))
    plain = sorted(df.collect(), key=lambda r: r.k)
    plain = [r for v in sorted({r.x for r in plain if r.x is not None}, reverse=True) for r in plain if r.x == v] + [
        r for r in plain if r.x is None]
    for n in (0, 1, 57, 200, 399, 400, 500):
        got = {r.k for r in df.filter(top_rows(df, "x", "k", n)).collect()}
        assert got == {r.k for r in plain[:n]}, n


def test_top_share_of_a_tie_and_of_extreme_keys(spark):
    df = spark.createDataFrame([((1 << 62) * s + k, 1.5) for s in (-1, 1) for k in range(50)], "customer_id long, s double")
    out = top_share_flag(df, "s", "customer_id", 0.3, 2).filter("churn_label = 1").collect()
    assert sorted(r.customer_id for r in out) == sorted(r.customer_id for r in df.collect())[:30]
    none = top_share_flag(df.limit(0), "s", "customer_id")
    assert none.count() == 0 and dict(none.dtypes)["churn_label"] == "int"


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_rank_sum(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([0.1, 0.5, rng.random(), None]), rng.choice([0, 1, 1, None])) for _ in range(600)]
    got = rank_sum(spark.createDataFrame(rows, "s double, y int"), "s", "y", parts).first()
    pos, neg = ([-1 if s is None else s for s, y in rows if (y == 1) == want] for want in (True, False))
    u = sum(2 * (p > q) + (p == q) for p in pos for q in neg)
    assert (got.positives, got.negatives, int(got.twice_u)) == (len(pos), len(neg), u)
    assert abs(got.auc - u / (2 * len(pos) * len(neg))) <= 5e-7


def test_rank_sum_of_one_class(spark):
    got = rank_sum(spark.createDataFrame([(0.5, 1)], "s double, y int"), "s", "y").first()
    assert (got.positives, got.negatives, got.auc) == (1, 0, None)


def test_spine_summary_without_the_spine(spark):
    """Also with returns (negative units), gaps, nulls and one-day series."""
    import datetime as dt

    from aislelens.operators import forecast

    rng = random.Random(8)
    rows = []
    for s in range(60):
        days = sorted(rng.sample(range(40), rng.randint(1, 9)))
        rows += [(s % 4, s, dt.date(2024, 1, 1) + dt.timedelta(d), rng.choice([None, -5, 0, 3, 9]), 2.0, rng.choice([None, 0, 4])) for d in days]
    inventory = spark.createDataFrame(rows, "store_id long, sku_id long, txn_date date, qty_sold int, unit_price double, inventory_on_hand int")
    want = forecast.spine_summary(forecast.daily_spine(inventory))
    got = forecast.spine_summary_direct(inventory).select(*want.columns)
    key = lambda r: (r.store_id, r.sku_id)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_sketches_merge(spark):
    from aislelens.operators import kpis

    rows = spark.range(40_000).selectExpr("id % 3 AS store_id", "id % 7 AS day", "id % 9001 AS customer_id")
    merged = {r.store_id: r.estimate for r in kpis.merged_sketches(kpis.daily_sketches(rows, ["store_id"], "day", "customer_id"), ["store_id"]).collect()}
    exact = {r[0]: r[1] for r in rows.groupBy("store_id").agg(F.count_distinct("customer_id")).collect()}
    assert all(abs(merged[s] - n) <= kpis.SKETCH_ERROR * n for s, n in exact.items())
