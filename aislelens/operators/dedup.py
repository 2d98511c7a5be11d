"""One survivor per key, chosen by a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row of each ``keys`` group under ``order``.

    ``row_number() ... = 1`` lets Spark plan a partial top-1 per key before
    the shuffle (WindowGroupLimit), so a hot key ships at most one row per
    map task. Give an ``order`` that is total on the output columns and the
    survivor is deterministic.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1).drop("_rn"))


def as_of_date(as_of, df: DataFrame, column: str) -> Column:
    """The run date: a literal when given, else max(``column``) of ``df``
    as a scalar subquery (computed once, never collected to the driver)."""
    if as_of is None:
        return df.agg(F.max(column)).scalar()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("date")
