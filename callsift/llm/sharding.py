"""Sharding by fixed virtual slots with a versioned slot-to-shard map.

A record's slot never changes: the hash of its id and text, modulo a fixed number of slots in the
thousands. Bytes are added up per slot, and a small table says which shard holds which slot. To
rebalance, that map is edited: overfull shards hand slots on to the emptiest until no move brings
sizes closer, and the edited map is stored as the next version. Everything the driver holds has one
row per slot.

Defined results: null text has no bytes and counts its fixed overhead; null ids hash like a value;
repeated rows share a slot and are placed each; an empty table leaves the map as it is. Only doc_id
and text are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsift.llm.common import running
from callsift.session import settle

SLOTS = 8192
OVERHEAD = 16
MAP = "version int, virtual_slot int, shard int"


def virtual_slot(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id, text), F.lit(slots)).cast("int")


def first_map(slots: int, shards: int) -> np.ndarray:
    """Slots dealt out in turn."""
    return np.arange(slots) % shards


def rebalance(held: np.ndarray, sizes: np.ndarray, shards: int) -> np.ndarray:
    """The map edited so that sizes come near equal; most slots stay where they are.

    Shards above the mean give up slots, largest first, as long as that doesn't take them below it;
    those slots then go, largest first, to the shard that holds least. At the end, pairs of the
    fullest and the emptiest shard move or swap slots while this narrows the gap.
    """
    held = held.copy()
    load = np.bincount(held, weights=sizes, minlength=shards)
    mean = sizes.sum() / shards
    pool = []
    for shard in np.flatnonzero(load > mean):
        own = np.flatnonzero((held == shard) & (sizes > 0))
        for slot in own[np.argsort(-sizes[own], kind="stable")]:
            if load[shard] - sizes[slot] >= mean or (load[shard] > mean and sizes[slot] > 0 and
                                                     load[shard] - mean > sizes[slot] / 2):
                load[shard] -= sizes[slot]
                pool.append(slot)
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(pool, key=lambda s: (-sizes[s], s)):
        weight, shard = heapq.heappop(heap)
        held[slot] = shard
        heapq.heappush(heap, (weight + sizes[slot], shard))
    load = np.bincount(held, weights=sizes, minlength=shards)
    for _ in range(4 * shards):
        full, spare = int(load.argmax()), int(load.argmin())
        gap = load[full] - load[spare]
        given = np.flatnonzero((held == full) & (sizes > 0))
        taken = np.append(np.flatnonzero((held == spare) & (sizes > 0)), -1)
        moved = sizes[given][:, None] - np.where(taken >= 0, sizes[taken], 0)[None, :]
        off = np.abs(gap - 2 * moved)
        if not off.size or off.min() >= gap:
            break
        i, j = np.unravel_index(off.argmin(), off.shape)
        held[given[i]] = spare
        if taken[j] >= 0:
            held[taken[j]] = full
        load = np.bincount(held, weights=sizes, minlength=shards)
    return held


def slot_sizes(sized: DataFrame, slots: int) -> np.ndarray:
    """Bytes per slot of (virtual_slot, size) rows, one number for each of the fixed slots."""
    out = np.zeros(slots)
    for slot, size in sized.groupBy("virtual_slot").agg(F.sum("size")).collect():
        out[slot] = size
    return out


def write_map(spark: SparkSession, path: str, version: int, held: np.ndarray) -> None:
    """Store one version of the map; older versions stay readable."""
    frame = pd.DataFrame({"version": version, "virtual_slot": range(len(held)), "shard": held})
    spark.createDataFrame(frame.astype("int32"), MAP).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/version={version:06d}"
    )


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version:06d}")


def shard(docs: DataFrame, shards: int, path: str, slots: int = SLOTS) -> DataFrame:
    """One row per document: size, checksum, virtual slot, shard and the place (`slot`) in it.

    Writes version 1 of the map (slots in turn) and version 2 (edited by the bytes per slot) to
    `path` and places rows by the latter.
    """
    spark = docs.sparkSession
    sized = settle(docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        virtual_slot(F.col("doc_id"), F.col("text"), slots).alias("virtual_slot"),
    ), "sized")
    held = first_map(slots, shards)
    write_map(spark, path, 1, held)
    write_map(spark, path, 2, rebalance(held, slot_sizes(sized, slots), shards))
    mapped = sized.join(F.broadcast(read_map(spark, path, 2)), "virtual_slot")  # one row per slot
    placed = running(mapped, ["shard"], ["virtual_slot", "doc_id", "text_crc32"], _place=F.lit(1))
    return placed.withColumn("slot", F.col("_place") - 1).drop("_place")
