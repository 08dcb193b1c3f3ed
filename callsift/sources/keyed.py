"""Tables that a stream can add to for years: work per batch follows the batch, not the table.

`insert_ignore` keeps a table in key-hash folders. Each folder has a Bloom filter of its keys; a batch reads
the filters of its own folders, and of the table only the keys in folders where a filter says that one may
be stored already. A folder's files are merged when they get many.

`merge_parts` keeps a table in partitions, such as days, of which a batch rewrites only the ones it holds.

Both publish a manifest last, which names the files that count, so a reader sees whole batches only and a
batch that failed or is repeated changes nothing. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsift.plans.dedupe import first_match
from callsift.schemas import flat
from callsift.session import settled
from callsift.sources import sinks

FOLDERS = 256
MOST_FILES = 8  # versions that a folder's rows may lie in before they are merged
HASHES = 7
BITS_PER_KEY = 10
LEAST_BITS = 1 << 13
BUCKET = "key_bucket"
HELD = flat(f"{BUCKET} INT, held_in INT")
BLOOMS = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType()),
    T.StructField(BUCKET, T.IntegerType()),
])


# Bloom filters.


def places(h: np.ndarray, g: np.ndarray, m: int) -> np.ndarray:
    """The bits of keys with these two hashes in a filter of m bits, one row per key."""
    steps = np.arange(HASHES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return (h.view(np.uint64)[:, None] + steps * (g.view(np.uint64)[:, None] | np.uint64(1))) % np.uint64(m)


def may_hold(bits: bytes, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which keys may be in a filter; without bits none is."""
    if not bits:
        return np.zeros(len(h), dtype=bool)
    held = np.unpackbits(np.frombuffer(bits, dtype="u1"), bitorder="little").astype(bool)
    return held[places(h, g, len(held))].all(axis=1)


def filled(h: np.ndarray, g: np.ndarray, n: int, bits: bytes | None = None) -> bytes:
    """A filter with further keys, or a new one with room for twice as many as `n`."""
    if bits:
        held = np.unpackbits(np.frombuffer(bits, dtype="u1"), bitorder="little")
    else:
        size = max(LEAST_BITS, 1 << int(2 * n * BITS_PER_KEY - 1).bit_length())
        held = np.zeros(size, dtype="u1")
    held[places(h, g, len(held))] = 1
    return np.packbits(held, bitorder="little").tobytes()


def is_full(bits: bytes | None, n: int) -> bool:
    return not bits or n * BITS_PER_KEY > 8 * len(bits)


def _hashed(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, BUCKET, F.xxhash64(key).alias("h"), F.xxhash64(key, F.lit(1)).alias("g"))


def _suspects(keys: DataFrame, blooms: DataFrame, key: str) -> DataFrame:
    """(key, folder) of those keys that the filter of their folder may hold."""
    kind = keys.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField(BUCKET, T.IntegerType())])

    def test(rows: pa.Table, filters: pa.Table) -> pa.Table:
        bits = filters.column("bits")[0].as_py() if len(filters) else None
        held = may_hold(bits, rows.column("h").to_numpy(), rows.column("g").to_numpy())
        return rows.select([key, BUCKET]).filter(pa.array(held))

    grouped = _hashed(keys, key).groupBy(BUCKET).cogroup(blooms.groupBy(BUCKET))
    return grouped.applyInArrow(test, schema)


def _grown(keys: DataFrame, blooms: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The filters with the keys added. `stored` holds the keys of folders whose filter has no room left,
    which are made anew."""
    every = _hashed(keys, key).withColumn("old", F.lit(False)).unionByName(
        _hashed(stored, key).withColumn("old", F.lit(True)))

    def grow(rows: pa.Table, filters: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table({"n": [], "bits": [], BUCKET: []}, schema=told)
        bits = filters.column("bits")[0].as_py() if len(filters) else None
        had = filters.column("n")[0].as_py() if len(filters) else 0
        old = rows.column("old").to_numpy(zero_copy_only=False)
        n = had + int((~old).sum())
        kept = None if is_full(bits, n) else bits
        out = filled(rows.column("h").to_numpy(), rows.column("g").to_numpy(), n, kept)
        return pa.table({"n": [n], "bits": [out], BUCKET: rows.column(BUCKET).slice(0, 1)}, schema=told)

    told = pa.schema([("n", pa.int64()), ("bits", pa.binary()), (BUCKET, pa.int32())])
    return every.groupBy(BUCKET).cogroup(blooms.groupBy(BUCKET)).applyInArrow(grow, BLOOMS)


# Key-hash folders.


def _manifest(spark: SparkSession, path: str, schema: T.StructType = HELD) -> list:
    return sinks.read_published(spark, f"{path}/manifest", schema).collect()


def _read(spark: SparkSession, path: str, pairs: list[tuple], part: str, schema: T.StructType) -> DataFrame:
    """Rows of the (partition, version) folders below `path`, with the partition as a column."""
    if not pairs:
        return spark.createDataFrame([], schema)
    paths = [f"{path}/{sinks.VERSION_PREFIX}{v}/{part}={p}" for p, v in sorted(pairs)]
    return spark.read.schema(schema).option("basePath", path).parquet(*paths).select(*schema.names)


def ensure(spark: SparkSession, path: str) -> None:
    """An empty table at `path` unless there is one already."""
    if not sinks.exists(spark, f"{path}/manifest"):
        sinks.publish(spark.createDataFrame([], HELD), f"{path}/manifest")


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a table kept by `insert_ignore`."""
    wide = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    pairs = [(r[BUCKET], r["held_in"]) for r in _manifest(spark, path)]
    return _read(spark, f"{path}/data", pairs, BUCKET, wide).select(*schema.names)


def insert_ignore(batch: DataFrame, path: str, schema: T.StructType, key: str, order_by: str,
                  folders: int = FOLDERS) -> int:
    """Add the first row of each key that the table lacks; returns the number of rows added.

    What is read: the manifest (a few numbers per folder), the filters of the folders that the batch's keys
    belong to, the keys of folders where a filter says "maybe", and the rows of folders that are merged.
    Only folder numbers reach the driver. `folders` is fixed when a table is made.
    """
    spark = batch.sparkSession
    number = F.pmod(F.hash(key), F.lit(folders)).alias(BUCKET)
    first = first_match(batch.filter(F.col(key).isNotNull()), key, order_by).select(*schema.names, number)
    held: dict[int, list[int]] = {}
    for r in _manifest(spark, path):
        held.setdefault(r[BUCKET], []).append(r["held_in"])
    wide = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    keys_of = T.StructType([schema[key], T.StructField(BUCKET, T.IntegerType())])
    version = 1 + max((v for vs in held.values() for v in vs), default=0)
    with settled(first, "batch") as rows:
        touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]
        known = [b for b in touched if b in held]
        blooms = _read(spark, f"{path}/blooms", [(b, max(held[b])) for b in known], BUCKET, BLOOMS)
        with settled(_suspects(rows, blooms, key), "suspects") as suspects:
            asked = [r[0] for r in suspects.select(BUCKET).distinct().collect()]
            stored = _read(spark, f"{path}/data", [(b, v) for b in asked for v in held[b]], BUCKET, keys_of)
            old = suspects.join(stored.select(key).distinct(), key, "left_semi").select(key)
            with settled(rows.join(old, key, "left_anti").select(*wide.names), "new") as new:
                counts = {r[BUCKET]: r["count"] for r in new.groupBy(BUCKET).count().collect()}
                if not counts:
                    return 0
                _write(new, blooms, held, counts, path, version, wide, key, keys_of)
    return sum(counts.values())


def _write(new: DataFrame, blooms: DataFrame, held: dict[int, list[int]], counts: dict[int, int], path: str,
           version: int, wide: T.StructType, key: str, keys_of: T.StructType) -> None:
    """Write new rows and filters under the next version, merge folders of many files, publish."""
    spark = new.sparkSession
    merged = [b for b in counts if len(held.get(b, [])) >= MOST_FILES]
    old = _read(spark, f"{path}/data", [(b, v) for b in merged for v in held[b]], BUCKET, wide)
    out = f"{path}/data/{sinks.VERSION_PREFIX}{version}"
    new.unionByName(old).hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(out)
    sizes = {r[BUCKET]: (r["n"], r["m"]) for r in blooms.select(BUCKET, "n", F.octet_length("bits").alias("m"))
             .collect()}
    full = [
        b for b, n in counts.items()
        if b in sizes and (sizes[b][0] + n) * BITS_PER_KEY > 8 * sizes[b][1]
    ]
    again = _read(spark, f"{path}/data", [(b, v) for b in full for v in held[b]], BUCKET, keys_of)
    some = blooms.filter(F.col(BUCKET).isin(list(counts))) if len(sizes) > len(counts) else blooms
    grown = _grown(new.select(key, BUCKET), some, again, key)
    grown.write.mode("overwrite").partitionBy(BUCKET).parquet(
        f"{path}/blooms/{sinks.VERSION_PREFIX}{version}")
    for b in counts:
        held[b] = [version] if b in merged else [*held.get(b, []), version]
    listed = sorted((b, v) for b, vs in held.items() for v in vs)
    sinks.publish(spark.createDataFrame(listed, HELD).coalesce(1), f"{path}/manifest")


# Partitions that are merged batch by batch.

PARTS = flat("part STRING, held_in INT, run STRING, number BIGINT")


def read_parts(spark: SparkSession, path: str, schema: T.StructType, part: str) -> DataFrame:
    """All rows of a table kept by `merge_parts`."""
    pairs = [(r["part"], r["held_in"]) for r in _manifest(spark, path, PARTS)]
    return _read(spark, f"{path}/data", pairs, part, schema)


def merge_parts(batch: DataFrame, path: str, part: str, keys: list[str], run: str, number: int) -> bool:
    """Replace, in the partitions that the batch holds, the rows with its keys by the batch's rows.

    `number` is the number of the batch in the run called `run`. A batch that was merged already changes
    nothing; returns whether this one did. Partition values are all that reaches the driver.
    """
    spark = batch.sparkSession
    listed = _manifest(spark, path, PARTS)
    if any(r["run"] == run and r["number"] >= number for r in listed):
        return False
    held = {r["part"]: r["held_in"] for r in listed}
    with settled(batch, "parts") as rows:
        touched = [str(r[0]) for r in rows.select(part).distinct().collect()]
        if not touched:
            return False
        known = [(p, held[p]) for p in touched if p in held]
        stored = _read(spark, f"{path}/data", known, part, batch.schema)
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in (part, *keys)]
        kept = stored.alias("o").join(rows.select(part, *keys).distinct().alias("n"), same, "left_anti")
        version = 1 + max(held.values(), default=0)
        out = f"{path}/data/{sinks.VERSION_PREFIX}{version}"
        kept.unionByName(rows).hint("rebalance", part).write.mode("overwrite").partitionBy(part).parquet(out)
    current = sorted({**held, **{p: version for p in touched}}.items())
    manifest = spark.createDataFrame([(p, v, run, number) for p, v in current], PARTS).coalesce(1)
    sinks.publish(manifest, f"{path}/manifest")
    return True
