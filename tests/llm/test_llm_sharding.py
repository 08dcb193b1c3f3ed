import zlib
from collections import Counter, defaultdict

import numpy as np
from llm_data import AWKWARD, DOCS, awkward, empty, prose, rows

from callsift.llm import sharding
from callsift.session import scratch_path


def test_rows_slots_and_sizes(spark):
    path = scratch_path(spark, "map")
    got = sharding.shard(awkward(spark), 4, path, slots=64).collect()
    assert len(got) == len(AWKWARD) + 3
    places = defaultdict(list)
    for r in got:
        places[r["shard"]].append(r["slot"])
        if r["doc_id"] is not None:
            raw = (AWKWARD[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    first = {r["virtual_slot"]: r["shard"] for r in sharding.read_map(spark, path, 1).collect()}
    second = {r["virtual_slot"]: r["shard"] for r in sharding.read_map(spark, path, 2).collect()}
    assert first == {i: i % 4 for i in range(64)} and set(second) == set(first)
    assert all(second[r["virtual_slot"]] == r["shard"] for r in got)


def test_sizes_come_near_equal(spark):
    docs = spark.createDataFrame(rows([prose(i, 5 + i % 90) for i in range(3000)]), DOCS)
    got = sharding.shard(docs, 40, scratch_path(spark, "map")).collect()
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert len(loads) == 40 and max(loads.values()) - min(loads.values()) < 200
    again = sharding.shard(docs.repartition(5), 40, scratch_path(spark, "map")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_an_edit_moves_few_slots():
    sizes = np.random.Generator(np.random.PCG64(1)).integers(50, 150, 4000).astype(float)
    held = sharding.rebalance(sharding.first_map(4000, 20), sizes, 20)
    load = np.bincount(held, weights=sizes, minlength=20)
    assert load.max() - load.min() < 5
    grown = sizes.copy()
    grown[held == 3] *= 1.2
    edited = sharding.rebalance(held, grown, 20)
    assert (edited != held).sum() < 150
    load = np.bincount(edited, weights=grown, minlength=20)
    assert load.max() - load.min() < 5


def test_one_giant_slot_does_not_end_the_edit():
    sizes = np.ones(100)
    sizes[7] = 1e6
    load = np.bincount(sharding.rebalance(sharding.first_map(100, 5), sizes, 5), weights=sizes, minlength=5)
    assert load.max() == 1e6 and sorted(load)[:4] == [24, 25, 25, 25]


def test_empty(spark):
    path = scratch_path(spark, "map")
    assert sharding.shard(empty(spark), 4, path, slots=16).count() == 0
    assert sharding.read_map(spark, path, 2).count() == 16
