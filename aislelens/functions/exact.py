"""Exact arithmetic on Columns.

Counts are integers and money is summed in millionths, so every average and
ratio the queries round is a ratio of two integers. Rounding that ratio with
integer arithmetic gives the mathematically right HALF_UP result, the same in
every engine, instead of whatever a double sum happened to produce. Products
are formed in decimal(38), so sums far beyond 2^53 (or 2^63) stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY_SCALE = 1_000_000           # money is exact to a millionth
PROB_SCALE = 1_000_000_000_000    # probabilities to 10^-12

WIDE = "decimal(38,0)"


def scaled(col: Column | str, scale: int) -> Column:
    """A double as an exact integer number of 1/``scale``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c * scale).cast("long")


def micros(col: Column | str) -> Column:
    """A money value in millionths; sum it as decimal, which can't overflow."""
    return scaled(col, MONEY_SCALE).cast("decimal(20,0)")


def floor_div(a: Column, b: Column | int) -> Column:
    """floor(a / b) as long for integer a and positive integer b, by integral division."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a - F.pmod(a, b), b).cast("long")


def round_ratio(num: Column, den: Column | int, places: int) -> Column:
    """HALF_UP round of num/den to ``places`` decimals, as double.

    num >= 0 and den > 0 are integers; den = 0 gives NULL.
    """
    value = _half_up(num, den, 10 ** places)
    return value.cast("double") if places == 0 else value / float(10 ** places)


def round_ratio_long(num: Column, den: Column | int) -> Column:
    """HALF_UP round of num/den to an integer, as long."""
    return _half_up(num, den, 1)


def _half_up(num: Column, den: Column | int, scale: int) -> Column:
    den = F.lit(den) if isinstance(den, int) else den
    wide = (num.cast("decimal(30,0)") * F.lit(2 * scale) + den.cast("decimal(28,0)")).cast(WIDE)
    return F.when(den != 0, F.call_function("div", wide, den.cast("decimal(28,0)") * F.lit(2)).cast("long"))


def money(micros_col: Column) -> Column:
    """Integer millionths back to a double amount."""
    return micros_col.cast("double") / float(MONEY_SCALE)
