"""Data quality (D1-D3): warn-only expectations, their report, and
post-run invariant checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import config as C


def _failed(predicate: str) -> Column:
    """A row fails when the predicate is false or NULL."""
    return F.count_if(~F.coalesce(F.expr(predicate), F.lit(False)))


def expect(df: DataFrame, rules: dict[str, str], name: str = "expectations"):
    """Attach warn-only expectations. Rows are kept; the returned
    Observation holds ``rows`` and ``<rule>`` failure counts once an action
    has run on the returned DataFrame (no second pass over the data)."""
    obs = Observation(name)
    metrics = [F.count(F.lit(1)).alias("rows")] + [_failed(p).alias(r) for r, p in rules.items()]
    return df.observe(obs, *metrics), obs


def expectation_report(datasets: dict[str, DataFrame],
                       rules: dict[str, dict[str, str]] = C.EXPECTATIONS) -> DataFrame:
    """(dataset, rule, rows, failed) - one aggregate per dataset covering
    all its rules, unioned."""
    parts = []
    for ds, df in datasets.items():
        rs = rules.get(ds, {})
        if not rs:
            continue
        agg = df.agg(F.count(F.lit(1)).alias("rows"), *[_failed(p).alias(f"_f{i}") for i, p in
                                                        enumerate(rs.values())])
        for i, rule in enumerate(rs):
            parts.append(agg.select(F.lit(ds).alias("dataset"), F.lit(rule).alias("rule"),
                                    "rows", F.col(f"_f{i}").alias("failed")))
    return reduce(DataFrame.unionByName, parts)


def validation_checks(p) -> DataFrame:
    """D3: invariants between pipeline layers, one row per check:
    (check, expected, actual, ok)."""
    src = p.src

    def n(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    def distinct(df: DataFrame, cols) -> Column:
        return n(df.select(*cols).distinct())

    c360 = p.customer_360()
    labels = p.churn_labels
    inv = p.inventory()
    latest = inv.agg(F.max("txn_date")).scalar()
    n_c360 = n(c360)
    k = F.greatest(F.lit(C.CHURN_LABEL_MINIMUM).cast("long"),
                   F.floor(F.lit(float(C.CHURN_LABEL_SHARE)) * n_c360).cast("long"))
    checks = [
        ("silver.customers one row per customer_id", distinct(src.customers_raw, ["customer_id"]), n(p.customers)),
        ("silver.orders one row per order_id", distinct(src.orders_raw, ["order_id"]), n(p.orders)),
        ("silver.inventory one row per store, sku, day",
         distinct(src.inventory_raw, ["store_id", "sku_id", "txn_date"]), n(inv)),
        ("units in silver.inventory = units in lineitem",
         src.table("lineitem").agg(F.sum(F.col("l_quantity").cast("long"))).scalar(),
         inv.agg(F.sum("qty_sold")).scalar()),
        ("silver.crm_summary one row per customer with events",
         distinct(src.crm_events_raw, ["customer_id"]), n(p.crm_summary)),
        ("gold.customer_360 one row per customer", n(p.customers), n_c360),
        ("gold.churn_scores one row per customer", n_c360, n(p.rule_scores)),
        ("churn labels = max(2, floor(0.3 n))", k, labels.agg(F.sum("churn_label").cast("long")).scalar()),
        ("gold.inventory_health one row per series on the latest day",
         distinct(inv.filter(F.col("txn_date") == latest), ["store_id", "sku_id"]), n(p.inventory_health)),
        ("gold.demand_forecast one row per sku on the latest day",
         distinct(inv.filter(F.col("txn_date") == latest), ["sku_id"]), n(p.demand_forecast)),
        ("gold.store_staffing_summary one row per known store role",
         n(src.staffing_raw.join(src.stores.select("store_id"), "store_id", "left_semi")),
         n(p.staffing_summary)),
    ]
    base = p.stores.agg(F.count(F.lit(1)).alias("_one"))   # a one-row frame to hang the values on
    rows = [base.select(F.lit(name).alias("check"), e.cast("long").alias("expected"),
                        a.cast("long").alias("actual")) for name, e, a in checks]
    return reduce(DataFrame.unionByName, rows).withColumn("ok", F.col("expected") == F.col("actual"))
