"""Exact selection and rank sums over any score, without ordering all rows in one place.

``image`` maps a score to a long that orders like it. ``kth`` finds the row of a given rank by radix selection: each
round counts the rows by the next DIGIT_BITS bits of the image (combined before the shuffle, so at most 65,536 counts
reach the driver), takes the digit in which the rank falls, and goes on below it; then the same for the key among
the rows that tie. ``rank_sum`` adds up ranks over ranges of distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exact import round_ratio
from ..session import materialise

DIGIT_BITS = 16
_SIGN = -(1 << 63)


def image(df: DataFrame, column: str) -> Column:
    """A long in the order of a number, date or timestamp; NULL stands below all values, NaN above.

    Of a double it is the bit pattern, formed exactly from exponent and fraction (negated below zero, so -0.0 and
    0.0 are one value).
    """
    kind, x = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.DateType):
        out = F.unix_date(x).cast("long")
    elif isinstance(kind, T.TimestampType):
        out = F.unix_micros(x)
    elif isinstance(kind, T.IntegralType):
        out = x.cast("long")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = _double_image(x.cast("double"))
    else:
        raise TypeError(f"no order-preserving image of {kind.simpleString()}")
    return F.coalesce(out, F.lit(_SIGN))


def _double_image(x: Column) -> Column:
    a, two = F.abs(x), F.lit(2.0)
    near = F.floor(F.log2(a)).cast("int")
    exponent = F.when(F.pow(two, near) > a, near - 1).when(F.pow(two, near + 1) <= a, near + 1).otherwise(near)
    exponent = F.greatest(exponent, F.lit(-1022))  # also of numbers too small for a leading 1
    fraction = (a / F.pow(two, exponent) * F.lit(float(1 << 52))).cast("long")
    bits = (F.when(F.isnan(x), F.lit(0x7FF << 52) + 1).when(a == float("inf"), F.lit(0x7FF << 52)).when(a == 0, F.lit(0))
            .otherwise((exponent + 1022).cast("long") * F.lit(1 << 52) + fraction))
    return F.when(F.isnan(x) | (x >= 0), bits).when(x < 0, -bits)


def _unsigned(x: Column) -> Column:
    """Bits whose unsigned order is the signed order of ``x``."""
    return x.bitwiseXOR(F.lit(_SIGN))


def kth(rows: DataFrame, column: str, k: int, descending: bool = False) -> tuple[int, int]:
    """The ``k``-th value (from 1) of a long column in order, and how many rows come strictly before that value."""
    value = F.bitwise_not(F.col(column)) if descending else F.col(column)
    bits, prefix, before = _unsigned(value), 0, 0
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        high = shift + DIGIT_BITS
        here = rows if high == 64 else rows.filter(F.shiftrightunsigned(bits, high) == F.lit(prefix))
        digit = F.shiftrightunsigned(bits, shift).bitwiseAND((1 << DIGIT_BITS) - 1)
        counts = here.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 ** DIGIT_BITS
        for r in sorted(counts, key=lambda r: r["d"]):
            if before + r["n"] >= k:
                prefix = prefix << DIGIT_BITS | r["d"]
                break
            before += r["n"]
        else:
            raise ValueError(f"no {k}th row")
    found = prefix + _SIGN  # back from unsigned
    return (~found if descending else found), before


def top_rows(df: DataFrame, score: str, key: str, k: int) -> Column:
    """Whether a row of ``df`` is among the first ``k`` by ``score`` descending, then ``key`` ascending.

    Keys are integral and unique; a NULL score comes last, a NULL key first among ties. The scores are written once
    and read in at most four rounds, the ties in at most four more.
    """
    s, i = image(df, score), image(df, key)
    if k <= 0:
        return F.lit(False)
    rows = materialise(df.select(s.alias("s"), i.alias("i")), "selection")
    if rows.count() <= k:
        return F.lit(True)
    cut, before = kth(rows, "s", k, descending=True)
    last, _ = kth(rows.filter(F.col("s") == cut), "i", k - before)
    return (s > cut) | ((s == cut) & (i <= last))


def rank_sum(df: DataFrame, score: str, label: str, parts: int | None = None) -> DataFrame:
    """M5: one row (positives, negatives, twice_u, auc): the exact area under the ROC curve, ties counted half.

    ``label`` is 1 for a positive row, anything else is negative. Rows are first counted by distinct score; ranges
    of scores then add up their own ranks, and the negatives of the ranges below are added to each range as a whole.
    """
    spark = df.sparkSession
    hit = F.coalesce(F.col(label) == 1, F.lit(False))
    values = df.groupBy(image(df, score).alias("s")).agg(
        F.count_if(hit).alias("p"), F.count_if(~hit).alias("q"))
    parts = parts or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialise(values.repartitionByRange(parts, "s").withColumn("part", F.spark_partition_id()), "rank-ranges")
    own = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    wide = "decimal(38,0)"
    below = F.coalesce(F.sum("q").over(own), F.lit(0))
    sums = (ranged.withColumn("below", below).groupBy("part")
            .agg(F.sum("p").alias("p"), F.sum("q").alias("q"),
                 F.sum((F.col("p") * (2 * F.col("below") + F.col("q")).cast("decimal(20,0)"))).cast(wide).alias("u")))
    u = p = q = 0
    for r in sorted(sums.collect(), key=lambda r: r["part"]):  # one row a range
        u, p, q = u + int(r["u"]) + 2 * q * r["p"], p + r["p"], q + r["q"]
    one = spark.createDataFrame([(p, q, str(u), str(2 * p * q))], "positives long, negatives long, u string, all string")
    return one.select("positives", "negatives", F.col("u").cast(wide).alias("twice_u"),
                      round_ratio(F.col("u").cast(wide), F.col("all").cast("decimal(28,0)"), 6).alias("auc"))
