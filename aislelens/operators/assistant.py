"""The keyword-routed assistant as one batch job over a questions table
(G6-G8, reading Q27-Q31).

Each question row gets five intent flags, then the context texts it asks
for. The texts are built once from the KPI queries and attached as scalar
subqueries, so a million questions cost one pass over the gold tables plus
a projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from . import kpis as K

_WS = "[ \\t\\n\\r\\f\\x0B]"


def normalized(col: Column) -> Column:
    """F16: trimmed (all ASCII whitespace) and lower-cased question."""
    return F.lower(F.regexp_replace(col, f"^{_WS}+|{_WS}+$", ""))


def _any_substring(q: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [q.contains(w) for w in words])


def _any_word(q: Column, words) -> Column:
    padded = F.concat(F.lit(" "), q, F.lit(" "))
    return reduce(lambda a, b: a | b, [padded.contains(f" {w} ") for w in words])


def route_intents(questions: DataFrame, text_col: str = "question") -> DataFrame:
    """KPI always; inventory, demand and staffing by substring; region
    by space-delimited whole word (punctuation is not a boundary)."""
    q = normalized(F.col(text_col))
    return questions.withColumns({
        "wants_kpi": F.lit(True),
        "wants_inventory": _any_substring(q, C.INTENT_INVENTORY),
        "wants_region": _any_word(q, C.INTENT_REGION_WORDS),
        "wants_demand": _any_substring(q, C.INTENT_DEMAND),
        "wants_staffing": _any_substring(q, C.INTENT_STAFFING)})


def context_texts(scores: DataFrame, health: DataFrame, forecast: DataFrame,
                  staffing: DataFrame) -> dict[str, Column]:
    """The five context sentences as scalar-subquery Columns."""
    k = K.assistant_kpis(scores)
    kpi = k.select(F.when(F.col("avg_churn_pct").isNotNull(), F.format_string(
        C.KPI_TEXT, "total_customers", "high_risk", "avg_churn_pct"))).scalar()
    inv_df = K.assistant_inventory(health)
    inv = inv_df.select(F.when(F.col("avg_dos").isNotNull(),
                               F.format_string(C.INVENTORY_TEXT, "cnt", "avg_dos"))).scalar()
    regions = K.assistant_regions(scores)
    reg = regions.agg(F.format_string(C.REGION_TEXT, F.coalesce(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("high_risk")).alias("o"), F.col("region").alias("r"),
                                             F.col("high_risk").alias("n")))),
        lambda s: F.format_string(C.REGION_ITEM, s["r"], s["n"])), ", "), F.lit("")))).scalar()
    dem_df = K.assistant_demand(forecast)
    dem = dem_df.agg(F.format_string(C.DEMAND_TEXT, F.coalesce(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("demand_7d_avg")).alias("o"),
                                             F.col("sku_id").alias("i"), F.col("sku_name").alias("n"),
                                             F.col("category").alias("c")))),
        lambda s: F.format_string(C.DEMAND_ITEM, s["n"], s["c"])), ", "), F.lit("")))).scalar()
    staff = K.assistant_staffing(staffing).select(F.format_string(C.STAFFING_TEXT, "gaps")).scalar()
    total = k.select("total_customers").scalar()
    return {"kpi": kpi, "inventory": inv, "region": reg, "demand": dem, "staffing": staff,
            "total_customers": total}


def ground(questions: DataFrame, texts: dict[str, Column], text_col: str = "question") -> DataFrame:
    """The grounded context per question - parts in the order KPI,
    inventory, region, demand, staffing - and how many were used."""
    routed = route_intents(questions, text_col)
    names = ["kpi", "inventory", "region", "demand", "staffing"]
    # subqueries may not sit inside the lambda below: project them first
    routed = routed.withColumns({f"_t_{n}": texts[n] for n in names})
    parts = F.filter(F.array(*[F.when(F.col(f"wants_{n}"), F.col(f"_t_{n}")) for n in names]),
                     lambda x: x.isNotNull())
    return (routed.withColumn("_parts", parts)
            .withColumns({
                "context": F.when(F.size("_parts") > 0, F.array_join("_parts", " "))
                            .otherwise(F.lit(C.NO_DATA_TEXT)),
                "context_used": F.size("_parts"),
                "answer": F.concat(F.lit(C.FALLBACK_HEADER), F.array_join(
                    F.transform("_parts", lambda p: F.concat(F.lit(C.FALLBACK_BULLET), p)), "\n"))})
            .drop("_parts", *[f"_t_{n}" for n in names]))


def chat_messages(grounded: DataFrame, total_customers: Column, text_col: str = "question") -> DataFrame:
    """G5 (serving form): system and user message for the hosted model."""
    return (grounded
            .withColumn("system_message", F.format_string(C.ASSISTANT_SYSTEM_TEMPLATE,
                                                          F.coalesce(total_customers, F.lit(0))))
            .withColumn("user_message", F.format_string(C.ASSISTANT_USER_TEMPLATE, F.col("context"),
                                                        F.col(text_col))))
