"""Independent ground truth: key KPIs recomputed in plain Python (Fraction /
Decimal) from collected rows at sf0.001, against the Spark operators."""

import math
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest

import __spark_entry__ as E
from tests.conftest import SMOKE

Q = E.queries()


def half_up(x: Fraction, places: int) -> float:
    q = x * 10 ** places
    return float(math.floor(q + Fraction(1, 2))) / 10 ** places


def dec_round(x: float, places: int) -> float:
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP))


@pytest.fixture(scope="module")
def c360(spark):
    return [r.asDict() for r in Q["customer_360"](spark, SMOKE).collect()]


def rule_prob(r):
    z = -(r["recency_days"] - 60) / 20.0 + 0.3 * r["order_count_90d"]
    return dec_round(1.0 / (1.0 + math.exp(z)), 6)


def tier(p):
    return "Low" if p <= 0.33 else ("Medium" if p <= 0.66 else "High")


def test_rule_scores_top_list_tiers_and_revenue(spark, c360):
    probs = {r["customer_id"]: rule_prob(r) for r in c360}
    got = {r["customer_id"]: r["churn_prob"] for r in Q["churn_scores_rule"](spark, SMOKE).collect()}
    assert got == probs
    high = sorted((cid for cid, p in probs.items() if tier(p) == "High"), key=lambda c: (-probs[c], c))
    top = {r["customer_id"]: r["churn_prob"] for r in Q["top_churn_risk"](spark, SMOKE).collect()}
    assert top == {c: half_up(Fraction(repr(probs[c])), 3) for c in high[:10]}
    counts = defaultdict(int)
    for p in probs.values():
        counts[tier(p)] += 1
    pct = {r["risk_tier"]: r["pct"] for r in Q["risk_tier_distribution"](spark, SMOKE).collect()}
    assert pct == {t: half_up(Fraction(n * 100, len(probs)), 1) for t, n in counts.items()}
    spend = {r["customer_id"]: Fraction(repr(r["total_spend_90d"])) for r in c360}
    rev = Q["revenue_at_risk"](spark, SMOKE).collect()[0]
    assert rev["high_risk_customers"] == len(high)
    assert rev["monthly_revenue_at_risk"] == half_up(sum((spend[c] / 90 * 30 for c in high), Fraction(0)), 0)


def test_inventory_health_and_forecast(spark):
    inv = sorted((r["store_id"], r["sku_id"], r["txn_date"], r["qty_sold"], r["unit_price"], r["inventory_on_hand"])
                 for r in Q["silver_inventory"](spark, SMOKE).collect())
    series = defaultdict(list)
    for s, k, d, q, p, h in inv:
        series[(s, k)].append((d, q, p, h))
    latest = max(d for _, _, d, *_ in inv)
    want = {}
    for key, rows in series.items():
        d, q, p, h = rows[-1]
        if d != latest:
            continue
        window = [r[1] for r in rows[-7:]]
        avg = Fraction(sum(window), len(window))
        if avg == 0:
            want[key] = (None, "OK")
        else:
            dos = Fraction(h) / avg
            want[key] = (half_up(dos, 1), "REORDER NOW" if dos < 3 else "WATCH" if dos < 7 else "OK")
    got = {(r["store_id"], r["sku_id"]): (r["days_of_supply"], r["inventory_status"])
           for r in Q["inventory_health"](spark, SMOKE).collect()}
    assert got == want
    # forecast: per-SKU daily totals, 7/14-row averages rounded to 1, +/- 5 % on the rounded values
    daily = defaultdict(lambda: defaultdict(int))
    for s, k, d, q, p, h in inv:
        daily[k][d] += q
    fc = {}
    for k, days in daily.items():
        ds = sorted(days)
        if ds[-1] != latest:
            continue
        qs = [days[d] for d in ds]
        a7, a14 = half_up(Fraction(sum(qs[-7:]), len(qs[-7:])), 1), half_up(Fraction(sum(qs[-14:]), len(qs[-14:])), 1)
        t7, t14 = Fraction(repr(a7)), Fraction(repr(a14))
        trend = "UP" if t7 > t14 * Fraction(105, 100) else "DOWN" if t7 < t14 * Fraction(95, 100) else "FLAT"
        fc[k] = (a7, a14, trend, int(half_up(t7 * 7, 0)))
    got = {r["sku_id"]: (r["demand_7d_avg"], r["demand_14d_avg"], r["trend"], r["predicted_units_7d"])
           for r in Q["demand_forecast"](spark, SMOKE).collect()}
    assert got == fc
