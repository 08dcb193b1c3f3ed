"""Size checks in front of everything that is sent to all tasks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 10_000
SMALL_BYTES = 64 << 20


def inline_if_small(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES):
    """(frame, is_small): a local copy of `df` when it is proven small, else `df` itself.

    Rows and bytes are added up where the rows are; only a frame within both bounds is collected. The
    caller broadcasts the local copy, and joins the untouched frame by shuffle otherwise, so the answer
    is the same either way.
    """
    shown = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, held = df.limit(max_rows + 1).agg(F.count("*"), F.sum(shown)).first()
    if rows > max_rows or (held or 0) > max_bytes:
        return df, False
    return df.sparkSession.createDataFrame(df.limit(max_rows).toArrow(), schema=df.schema), True


def lookup_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """`df` with a broadcast hint when it is proven small, without one otherwise."""
    frame, small = inline_if_small(df, max_rows)
    return F.broadcast(frame) if small else frame


def blocks(df: DataFrame, key: str, max_rows: int, size: Column | None = None,
           max_bytes: int = SMALL_BYTES) -> list[DataFrame]:
    """`df` split by key hash into parts of about `max_rows` rows and `max_bytes` each.

    `size` is the expression for a row's bytes where rows can be long.
    """
    total, held = df.agg(F.count("*"), F.sum(F.lit(0) if size is None else size)).first()
    parts = max(1, math.ceil(total / max_rows), math.ceil((held or 0) / max_bytes))
    if parts == 1:
        return [df]
    return [df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]
