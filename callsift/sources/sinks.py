"""Writes: insert-ignore, upsert, overwrite, export and rubric changes.

The merge functions return the new table as a DataFrame; `publish` stores it as a new version so a
reader never sees half a table and a failed job leaves the old version in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsift.plans.dedupe import distinct_keys, first_match
from callsift.plans.sizing import lookup_side
from callsift.schemas import flat

VERSION_PREFIX = "version="
BUCKET = "key_bucket"
SMALL_BATCH = 1_000_000
MANIFEST_FIELDS = f"{BUCKET} INT, held_in INT"
MANIFEST = f"{BUCKET} int, held_in int"
# The columns of a rule that may be edited.
EDITABLE = (
    "section_name", "criteria_name", "section_weight", "criteria_weight", "effective_weight",
    "enabled", "what_to_check", "when_to_check", "good_example", "bad_example", "scoring_method",
)


def unseen(existing: DataFrame, new: DataFrame, key: str, order_by: str | list[str],
           small_batch: bool = False) -> DataFrame:
    """The first new row of each key that the existing table lacks.

    For a batch expected to be small, a capped read of its keys proves it so: then the stored keys
    are looked through where they lie, and only those the batch holds as well are shuffled.
    """
    batch = first_match(new.filter(F.col(key).isNotNull()), key, order_by)
    stored = existing.select(key)
    if small_batch:
        stored = stored.join(lookup_side(batch.select(key), SMALL_BATCH), key, "left_semi")
    return batch.join(distinct_keys(stored, key), key, "left_anti").select(*new.columns)


def insert_ignore(existing: DataFrame, new: DataFrame, key: str, order_by: str | list[str]):
    """Existing rows plus the first row of every unseen key."""
    return existing.unionByName(unseen(existing, new, key, order_by))


def upsert(existing: DataFrame, new: DataFrame, key: str, order_by: str | list[str]) -> DataFrame:
    """Existing rows without the keys of the batch, plus the last row of each key in the batch."""
    batch = first_match(new, key, order_by, last=True).select(*new.columns)
    kept = existing.join(distinct_keys(new, key), key, "left_anti").select(*existing.columns)
    return kept.unionByName(batch)


def upsert_table(
    batch: DataFrame, path: str, schema: T.StructType, key: str, order_by: str | list[str],
    buckets: int = 1024,
) -> int:
    """Upsert into a table stored in key-hash folders, rewriting only the folders a batch touches.

    The touched folders are written anew under the next version, and a manifest that says which version
    holds which folder is published last. Nothing that a reader may be using is changed, and a run that
    fails leaves the table as it was; the next run writes the same version again. Folder numbers, at
    most `buckets` of them, are all that reaches the driver. Returns the version.
    """
    spark = batch.sparkSession
    number = F.pmod(F.hash(key), F.lit(buckets)).alias(BUCKET)
    touched = [row[0] for row in batch.select(number).distinct().collect()]
    folders = _folders(spark, path)
    version = max((versions(spark, f"{path}/manifest") or [0])) + 1
    stored = _read_folders(spark, path, {b: folders[b] for b in touched if b in folders}, schema)
    merged = upsert(stored, batch.select(*schema.names), key, order_by)
    placed = merged.select("*", number).hint("rebalance", BUCKET)
    data = f"{path}/data/{VERSION_PREFIX}{version}"
    placed.write.mode("overwrite").partitionBy(BUCKET).parquet(data)
    current = sorted({**folders, **{b: version for b in touched}}.items())
    manifest = spark.createDataFrame(current, MANIFEST).coalesce(1)
    return publish(manifest, f"{path}/manifest")


def read_upserted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest complete state of a table kept by `upsert_table`."""
    return _read_folders(spark, path, _folders(spark, path), schema)


def _folders(spark: SparkSession, path: str) -> dict[int, int]:
    """The version that holds each key-hash folder."""
    manifest = read_published(spark, f"{path}/manifest", flat(MANIFEST_FIELDS))
    return {row[0]: row[1] for row in manifest.collect()}


def _read_folders(spark: SparkSession, path: str, folders: dict[int, int], schema: T.StructType):
    if not folders:
        return spark.createDataFrame([], schema)
    paths = [f"{path}/data/{VERSION_PREFIX}{v}/{BUCKET}={b}" for b, v in sorted(folders.items())]
    return spark.read.schema(schema).parquet(*paths)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str, version: int | None = None) -> None:
    """Replace a table, stamping the given version number on its rows."""
    out = df if version is None else df.withColumn("version", F.lit(version))
    out.write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A header-first export; quotes inside fields are doubled."""
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def _store(spark: SparkSession, path: str):
    """The file system of a path and the path in its terms, so any shared store works."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def exists(spark: SparkSession, path: str) -> bool:
    fs, root = _store(spark, path)
    return fs.exists(root)


def ensure_table(
    spark: SparkSession, path: str, schema: T.StructType, *partition_by: str
) -> None:
    """An empty table at `path` unless something is there already."""
    fs, root = _store(spark, path)
    if not fs.exists(root):
        spark.createDataFrame([], schema).write.partitionBy(*partition_by).parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of the table at `path`."""
    fs, root = _store(spark, path)
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        marker = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith(VERSION_PREFIX) and fs.exists(marker):
            found.append(int(name.removeprefix(VERSION_PREFIX)))
    return sorted(found)


def publish(df: DataFrame, path: str) -> int:
    """Write `df` as the next version of the table at `path`; returns the version number."""
    done = versions(df.sparkSession, path)
    number = done[-1] + 1 if done else 1
    df.write.mode("overwrite").parquet(f"{path}/{VERSION_PREFIX}{number}")
    return number


def read_published(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest complete version, or an empty table when there is none."""
    done = versions(spark, path)
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{VERSION_PREFIX}{done[-1]}")


def _blank(kind: T.DataType):
    """What an inserted rule holds in a field the insert left out."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    return F.lit(False) if isinstance(kind, T.BooleanType) else F.lit(0).cast(kind)


def apply_changes(
    rubric: DataFrame, changes: DataFrame, key: str = "framework_id", seq: str = "seq"
) -> DataFrame:
    """The rubric after a batch of changes, each key's changes taken in `seq` order.

    `changes` holds the key, `seq`, `op` (insert / update / delete), `changed_at` and the editable
    columns; a null field keeps the old value. An update of an absent rule does nothing. One
    aggregation finds the last insert or delete of a key and the latest value of each field; values
    older than that insert do not count.
    """
    fields = [c for c in rubric.columns if c in EDITABLE and c in changes.columns]
    lifecycle = F.when(F.col("op").isin("insert", "delete"), F.struct(seq, "op"))
    latest = [
        F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(seq).alias("at"), F.col(c).alias("v"))))
        .alias(f"_{c}")
        for c in fields
    ]
    folded = changes.groupBy(key).agg(
        F.max(lifecycle).alias("_base"), F.max(F.struct(seq, "changed_at")).alias("_last"), *latest
    )
    merged = rubric.withColumn("_stored", F.lit(True)).join(folded, key, "full_outer")
    inserted = F.coalesce(F.col("_base.op") == "insert", F.lit(False))
    deleted = F.coalesce(F.col("_base.op") == "delete", F.lit(False))
    started = F.col(f"_base.{seq}")

    def merged_column(name: str):
        if name == key:
            return F.col(key)
        if name == "updated_at":
            return F.coalesce("_last.changed_at", "updated_at").alias(name)
        if name not in fields:
            return F.when(~inserted, F.col(name)).alias(name)
        at, value = F.col(f"_{name}.at"), F.col(f"_{name}.v")
        fresh = F.coalesce(F.when(at >= started, value), _blank(rubric.schema[name].dataType))
        return F.when(inserted, fresh).otherwise(F.coalesce(value, F.col(name))).alias(name)

    alive = ~deleted & (inserted | F.col("_stored").isNotNull())
    return merged.filter(alive).select(*[merged_column(c) for c in rubric.columns])
