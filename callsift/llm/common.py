"""Helpers of the training-data operators: running sums at any skew, word hashes of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callsift.session import settle

# What separates words: blank, and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> SparkSession:
    """Batches of 1,000 whole texts for Python workers, where the session has Spark's own setting.

    Ten thousand texts at once take a worker and its executor some hundred megabytes.
    """
    if spark.conf.get(BATCH_ROWS, "10000") == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    return spark


def running(df: DataFrame, group: list[str], order: list[str | Column], **sums: Column) -> DataFrame:
    """`df` with, for each of `sums`, its total over the rows of the group up to and with this one.

    `order` holds ascending columns. Works at any skew: rows are dealt out by ranges of (group, order), so a group with a third of
    the table lies in many parts. Each part sums by itself, and what earlier parts of the same group
    hold is added by a join with at most one row per part boundary, which is why it may be broadcast.
    Rows equal in group and order lie in one part and get their sums in any order. The rows dealt
    out are written once, so part numbers stay the same when a lost executor's work is repeated.
    """
    keys = [f"_key_{i}" for i in range(len(order))]
    named = df.withColumns({
        **{k: F.col(o) if isinstance(o, str) else o for k, o in zip(keys, order, strict=True)},
        **{f"_value_{n}": v.cast("long") for n, v in sums.items()},
    })
    dealt = settle(
        named.repartitionByRange(*group, *keys).withColumn("_part", F.spark_partition_id()),
        "ranges",
    )
    totals = dealt.groupBy(*group, "_part").agg(*[F.sum(f"_value_{n}").alias(n) for n in sums])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    boundaries = totals.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"),
        *[F.sum(n).over(earlier).alias(f"_before_{n}") for n in sums],
    ).filter(F.coalesce(*[F.col(f"_before_{n}") for n in sums]).isNotNull())
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    joined = dealt.join(F.broadcast(boundaries), [F.col("_part") == F.col("_p"), *same], "left")
    here = Window.partitionBy("_part", *group).orderBy(*keys).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return joined.select(*df.columns, *[
        (F.sum(f"_value_{n}").over(here) + F.coalesce(f"_before_{n}", F.lit(0))).alias(n)
        for n in sums
    ])


# Word hashes: a polynomial over the bytes of a word, modulo 2^64, then mixed.

_RANDOM = np.random.Generator(np.random.PCG64(7))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the polynomial's base and of its inverse, at least `n` of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 2**64))):
                filled = np.ones(size, dtype=np.uint64)
                filled[1:] = np.uint64(base)
                _powers[name] = np.multiply.accumulate(filled)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _hash_chunk(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of `data`, and how many begin before each of `bounds`.

    A word also ends at every bound.
    """
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = bounds[bounds < len(data)]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.zeros(len(bounds), dtype=np.int64)
    up, down = _power_table(len(data))
    with np.errstate(over="ignore"):
        values = np.add.reduceat(_BYTE[data] * up[: len(data)], starts) * down[starts]
    return mix(values), np.searchsorted(starts, bounds)


def _cuts_of(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about CHUNK bytes that end before white space, so that no word is cut."""
    at = 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data):
            spaces = np.flatnonzero(_SPACE[data[end : end + CHUNK]])
            if len(spaces):
                end += int(spaces[0])
                break
            end = min(len(data), end + CHUNK)
        yield at, end
        at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def word_hashes(column: pa.Array, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of all words, where each row's words begin) for some rows at a time.

    Texts are worked through whole, about a megabyte at a time. `lower` folds A-Z.
    """
    data, at = text_bytes(column)
    if lower:
        data = _LOWER[data]
    row = 0
    while row < len(at) - 1:
        last = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, "right")) - 1)
        if at[last] - at[row] <= CHUNK:
            hashes, begins = _hash_chunk(data[at[row] : at[last]], at[row : last + 1] - at[row])
        else:
            text = data[at[row] : at[last]]
            hashes = np.concatenate(
                [_hash_chunk(text[a:b], np.empty(0, dtype=np.int64))[0] for a, b in _cuts_of(text)]
            )
            begins = np.array([0, len(hashes)])
        yield row, hashes, begins
        row = last


_SEATS = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash per run of `n` following words; the run that begins at word i is at place i."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out += words[i : len(words) - n + 1 + i] * _SEATS[i % 64]
            if i % 64 == 63:
                out = mix(out)
    return mix(out)
