"""Expensive columns computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with further columns that later steps read instead of recomputing.

    A filter on a plain derived column moves below the projection and repeats its expression there,
    and again for every part it is split into. A one-element generator keeps the expressions in one
    place and still runs inside code generation.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*df.columns, F.inline(F.array(row)))
