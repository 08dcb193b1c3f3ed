"""Times without zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?)?$"
ZONE_SUFFIX = r"(Z|[+-]\d{2}:?\d{2})$"


def moment(at: datetime) -> Column:
    """A given time as TIMESTAMP_NTZ, the same in every session zone."""
    return F.lit(at.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def wall_clock(text: Column) -> Column:
    """ISO time without its zone, as written on the wall clock; null when it is no date."""
    plain = F.regexp_replace(text, ZONE_SUFFIX, "")
    return F.when(plain.rlike(ISO_TIME), plain.try_cast("timestamp_ntz"))
