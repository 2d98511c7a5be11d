"""D3 / KPI validation after a refresh: the KPI functions over tables read by name.

After ``Warehouse.register(database, ...)`` every layer is a catalog table, so
the post-run checks are the same functions that the dashboard uses, on
``spark.table``: one definition of each KPI.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import config as C
from ..operators import forecast, kpis

TABLES = {label: label.split(".", 1)[1] for label, _, _ in C.LAYER_TABLES}


def run(spark: SparkSession, db: str, scores: str = "churn_scores") -> dict[str, DataFrame]:
    """The validation results as DataFrames (lazy until an action)."""
    def at(name: str) -> DataFrame:
        return spark.table(f"{db}.{scores if name == 'churn_scores' else name}")

    return {
        "layer_row_counts": kpis.layer_row_counts({label: at(name) for label, name in TABLES.items()}),
        "risk_tier_distribution": kpis.risk_tier_distribution(at("churn_scores")),
        "top_churn_risk": kpis.top_churn_risk(at("churn_scores")),
        "revenue_at_risk": kpis.revenue_at_risk(at("churn_scores"), at("customer_360")),
        "inventory_alerts": kpis.inventory_alerts(at("inventory_health")),
        "demand_top10": forecast.top_demand(at("demand_forecast"), 10),
        "staffing_gaps": kpis.staffing_gaps(at("store_staffing_summary")),
    }
