"""One row per key without a window.

A window sorts all rows of a key in one task. These forms aggregate, so each task first reduces
its own rows and a key that holds a third of the table sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_match(df: DataFrame, key: str | list[str], order_by: str | list[str], last: bool = False):
    """The first (or last) row of each key in the given order, ties broken by the whole row; a known
    value comes before null either way."""
    keys = [key] if isinstance(key, str) else key
    order = [order_by] if isinstance(order_by, str) else order_by
    rest = [c for c in df.columns if c not in keys]
    ranked = [*order, *[c for c in rest if c not in order]]
    if last:
        pick = F.max(F.struct(*ranked))
    else:
        nullable = {f.name for f in df.schema if f.nullable}
        pick = F.min(F.struct(*[
            part for c in ranked
            for part in ([F.col(c).isNull().alias(f"_no_{c}")] if c in nullable else []) + [F.col(c)]
        ]))
    picked = df.groupBy(*keys).agg(pick.alias("_row"))
    return picked.select(*[c if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """Each key once; duplicates fold before the shuffle."""
    return df.select(key).distinct()
