"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

#: The white space and the words of the contracts, as Java and Python patterns.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A group with more than 1/HOT_SHARE of all rows is hot; so there are fewer than HOT_SHARE of them.
HOT_SHARE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Operators of a plan that keep each row of a scan at most once.
_SCAN = re.compile(r"[ :+-]*(Relation|Project|Filter|SubqueryAlias)\b")


def _is_scan(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().analyzed().toString().strip()
    return all(_SCAN.match(line) for line in plan.splitlines())


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` packed into the struct ``row`` (so no name of its can clash) beside a row id ``rid``.

    Rows of a parquet scan are identified by file and place in it, which any later read gives again. Other
    frames are written to the shared folder first, so their numbers are fixed even if executors are lost.
    """
    packed = F.struct("*").alias("row")
    if _is_scan(df):
        try:
            place = df.metadataColumn("_metadata")
            return df.select(packed, F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at")).alias("rid"))
        except AnalysisException:  # not parquet
            pass
    return materialise(df.select(packed, F.struct(F.lit(0).cast("long").alias("file"),
                                                  F.monotonically_increasing_id().alias("at")).alias("rid")), name)


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    """The packed input columns again, named and ordered as in ``like``."""
    return df.select([F.col("row").getField(c).alias(c) for c in like.columns])


def attach(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` to ``groups`` (one row per ``key``, ``count`` = its rows) that no key can overload.

    Fewer than HOT_SHARE groups hold more than 1/HOT_SHARE of all rows each; only these are broadcast, and
    their rows stay where they are. All other keys go through a shuffled join, where each brings at most
    1/HOT_SHARE of the rows. Both inputs should be materialised: they are read twice.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    hot = groups.filter(F.col(count) * HOT_SHARE > F.lit(total))
    cold = groups.filter(F.col(count) * HOT_SHARE <= F.lit(total))
    in_place = rows.join(F.broadcast(hot), key)
    shuffled = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return in_place.unionByName(shuffled)
