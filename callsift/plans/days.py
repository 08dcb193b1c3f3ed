"""Distinct calls of any range of days from stored summaries of single days.

A day's summary holds its calls' ids as bitmaps of 64 ids each, or as one sketch. Bitmaps of days are
joined by OR, so a call that occurs on several days counts once, and the result is exact. A bitmap is one
whole number and is stored only where it has a bit, so a summary never has more rows than the day has calls,
and whole numbers are joined in hash tables without a sort. Sketches take a few kilobytes whatever the number
of calls; with the 12 bits used here their counts are within 1.7 % in two cases of three and within 5 %
nearly always. A new day touches the folder of its month only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsift.operators.joins import KEY
from callsift.sources import keyed

SKETCH_BITS = 12
MONTH = "yyyy-MM"
SUMMARY = T.StructType([
    T.StructField("month", T.StringType()), T.StructField("day", T.DateType()), T.StructField("bucket", T.LongType()),
    T.StructField("bits", T.LongType()), T.StructField("held", T.BinaryType()),
])


def _known(rows: DataFrame, at: str) -> DataFrame:
    """Rows without a time or id don't count."""
    return rows.filter(F.col(KEY).isNotNull() & F.col(at).isNotNull())


def day_bits(rows: DataFrame, at: str) -> DataFrame:
    """(day, bucket, bits): for each row the bit of its call among the 64 ids of a bucket, yet to be joined."""
    call = F.col(KEY).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), call.bitwiseAND(F.lit(63)).cast("int"))
    return _known(rows, at).select(
        F.to_date(at).alias("day"), F.shiftright(call, 6).alias("bucket"), bit.alias("bits"))


def day_sketches(rows: DataFrame, at: str) -> DataFrame:
    """(day, bucket, held): the call ids of each day as one sketch, in bucket 0."""
    sketch = F.hll_sketch_agg(KEY, F.lit(SKETCH_BITS)).alias("held")
    return _known(rows, at).groupBy(F.to_date(at).alias("day")).agg(sketch).select(
        "day", F.lit(0).cast("long").alias("bucket"), "held")


def _whole(days: DataFrame, exact: bool) -> DataFrame:
    """Stored days of the other kind, or of bitmaps in bytes as they were stored before, are an error and
    not a count that lacks them."""
    column, kind = ("bits", "bits") if exact else ("held", "sketches")
    missing = F.raise_error(F.lit(f"these stored days hold no {kind}: make them anew"))
    return days.withColumn(column, F.coalesce(column, missing))


def _joined(parts: DataFrame, keys: list[str], exact: bool) -> DataFrame:
    union = F.bit_or("bits").alias("bits") if exact else F.hll_union_agg("held").alias("held")
    return parts.groupBy(*keys, "bucket").agg(union)


def add_days(rows: DataFrame, path: str, at: str, run: str, number: int, exact: bool = True) -> bool:
    """Add a batch's calls to the stored days at `path`; other days are not touched, and a batch that was
    added already changes nothing. Returns whether this one did."""
    spark, held = rows.sparkSession, "bits" if exact else "held"
    fresh = _joined(day_bits(rows, at), ["day"], exact) if exact else day_sketches(rows, at)
    days = _known(rows, at).select(F.to_date(at).alias("day")).distinct()
    stored = _whole(read_days(spark, path), exact).join(F.broadcast(days), "day", "left_semi")  # one row per day
    old, new = F.col(f"stored.{held}"), F.col(f"fresh.{held}")
    both = old.bitwiseOR(new) if exact else F.hll_union(old, new)
    pairs = stored.alias("stored").join(fresh.alias("fresh"), ["day", "bucket"], "full_outer")
    merged = pairs.select("day", "bucket", F.coalesce(both, old, new).alias(held))
    kinds = {f.name: F.lit(None).cast(f.dataType) for f in SUMMARY if f.name not in merged.columns}
    summary = merged.withColumns({**kinds, "month": F.date_format("day", MONTH)})
    return keyed.merge_parts(summary.select(*SUMMARY.names), path, "month", ["day"], run, number)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """The stored summaries of all days."""
    return keyed.read_parts(spark, path, SUMMARY, "month").drop("month")


def distinct_calls(days: DataFrame, *by: str, exact: bool = True) -> DataFrame:
    """The number of different calls in the given days, for each value of the columns `by`."""
    held = _joined(_whole(days, exact), list(by), exact)
    count = F.bit_count("bits") if exact else F.hll_sketch_estimate("held")
    return held.groupBy(*by).agg(F.sum(count).alias("total_calls"))
