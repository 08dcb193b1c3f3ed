"""Sums and ratios that do not depend on the order in which tasks finish.

DOUBLE sums change in the last digits with the order of partial results, which moves rounded
averages across ties. Sums here are exact, so a result is the same on 8 cores and on 1,000.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(18,6)"
DIGIT = 28  # bits of a value that one BIGINT sum takes, which leaves room for 2^35 rows
TOP, LOW = 40, -44  # the powers of two between which three such sums hold a value
WHOLE = "decimal(31,9)"


def exact_sum(value: Column) -> Column:
    """Sum of a numeric column as the DOUBLE nearest to the true sum, as `math.fsum` gives it.

    A value is split by exponent: a multiple of 2^40, three digits of 28 bits down to 2^-44, and what is
    below. The digits are summed as BIGINT, the outer parts as DOUBLE. Those sums are exact too, as long
    as values are zero or from 2^-10 to 2^80 in size; beyond that only bits far outside the rounding of
    a result are lost, and no value is ever dropped. NaN and infinity give what Spark's sum gives. Five
    plain sums stay in generated code and fold inside each task.
    """
    x = value.cast("double")
    finite = F.abs(x) < float("inf")
    inner = x % F.lit(2.0 ** TOP)
    parts, rest = [], F.when(finite, inner)
    for power in range(TOP - DIGIT, LOW - 1, -DIGIT):
        digit = (rest * F.lit(2.0 ** -power)).cast("long")  # towards zero, so that nothing is rounded
        parts.append(F.sum(digit))
        rest = rest - digit * F.lit(2.0 ** power)
    outer = F.sum(F.when(finite, x - inner).otherwise(x))
    return _joined(outer, parts, F.sum(rest))


def _joined(outer: Column, digits: list[Column], rest: Column) -> Column:
    """The nearest DOUBLE to the sum of all parts, the carries of the digits brought upwards first."""
    mask, carried = F.lit((1 << DIGIT) - 1), F.lit(0).cast("long")
    placed = []
    for i, digit in enumerate(reversed(digits)):
        total = digit + carried
        carried = F.shiftright(total, DIGIT)
        own = total if i == len(digits) - 1 else total.bitwiseAND(mask)
        placed.append(own * F.lit(2.0 ** (LOW + i * DIGIT)))
    low, middle, top = placed
    # Up to 2^36 both inner sums are exact, so the last one rounds once.
    plain = (top + middle) + (low + rest)
    usual = (outer == 0) & (F.abs(top) < F.lit(2.0 ** 36))
    # Elsewhere the error of every step is kept and added at the end.
    start = F.struct(outer.alias("s"), F.lit(0.0).alias("e"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["s"] + x
        back = s - acc["s"]
        return F.struct(s.alias("s"), (acc["e"] + (acc["s"] - (s - back)) + (x - back)).alias("e"))

    careful = F.aggregate(F.array(top, middle, low, rest), start, step, lambda acc: acc["s"] + acc["e"])
    return F.when(usual, plain).when(F.abs(outer) < float("inf"), careful).otherwise(outer)


def as_decimal(value: Column) -> Column:
    """A DOUBLE with nine digits after the point as DECIMAL, so that decimal ties stay ties; null where it
    has no room."""
    return F.when(F.abs(value) < 1e20, value).cast(WHOLE)


def ratio(numerator: Column, denominator: Column, digits: int, times: int = 1) -> Column:
    """times * numerator / denominator rounded half up; null when the denominator is zero or null.

    Numbers that no DECIMAL holds, not a number and infinity among them, are divided as DOUBLE.
    """
    top = numerator.cast("double")
    exact = F.round(F.try_divide(as_decimal(top) * times, denominator), digits).cast("double")
    return F.when(F.abs(top) < 1e20, exact).otherwise(F.try_divide(top * times, denominator))


def scaled_sum(value: Column, times: int) -> Column:
    """times * the exact sum, to nine digits after the point where a DECIMAL holds it."""
    total = exact_sum(value)
    return F.coalesce((as_decimal(total) * times).cast("double"), total * times)


def exact_avg(value: Column, digits: int, divide_by: int = 1) -> Column:
    """Rounded average over the non-null values, optionally divided by a constant."""
    count = F.count(value) * F.lit(divide_by)
    return ratio(exact_sum(value), count, digits)


def share_pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole of two counts, rounded half up."""
    share = F.try_divide(part.cast("decimal(20,0)") * 100, whole)
    return F.round(share, digits).cast("double")


def count_where(condition: Column) -> Column:
    """Rows where the condition holds; null counts as no."""
    return F.sum(F.when(condition, 1).otherwise(0))


def python_round(value: Column, digits: int) -> Column:
    """Round a non-negative DOUBLE as Python's round() does: by its exact binary value, ties to even.

    `value * scale` loses digits, so the lost part is computed too (an exact product after
    Veltkamp and Dekker) and decides on which side of the half the true product lies.
    """
    scale = F.lit(float(10 ** digits))
    product = value * scale
    wide = value * F.lit(134217729.0)  # 2**27 + 1 splits a DOUBLE into two halves
    upper = wide - (wide - value)
    lost = (upper * scale - product) + (value - upper) * scale
    floor = F.floor(product).cast("bigint")
    side = (product - floor - F.lit(0.5)) + lost
    up = F.when(side == 0, floor % 2 == 1).otherwise(side > 0)
    return (floor + F.when(up, 1).otherwise(0)) / scale


def weight_percent(weight: Column) -> Column:
    """Weights up to 1 are shares and shown as percent, larger ones are percent already."""
    value = F.coalesce(weight, F.lit(0.0))
    return F.when(value <= 1, python_round(value * 100, 2)).otherwise(python_round(value, 2))


def talk_share(part: Column, other: Column) -> Column:
    """part / (part + other) to three digits; null when both are zero."""
    share = F.try_divide(part.cast("double"), (part + other).cast("double"))
    return F.when(share.isNotNull(), python_round(share, 3))
