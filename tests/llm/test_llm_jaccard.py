import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from llm_data import AWKWARD, DOCS, awkward, empty, prose, rows

from callsift.llm import jaccard
from callsift.llm.components import components


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(docs, n=4, percent=85):
    """{(doc_id, text): (size, component)} over all pairs that share a shingle."""
    sets, holders = [shingles(t, n) for _, t in docs], defaultdict(list)
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, held in enumerate(sets):
        common = Counter(j for s in held for j in holders[s])
        for j, k in common.items():
            if 100 * k >= percent * (len(held) + len(sets[j]) - k):
                parent[root(i)] = root(j)
        for s in held:
            holders[s].append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((repr(d), len(sets[i]), repr(least.get(root(i)) if sets[i] else d))
                  for i, (d, _) in enumerate(docs))


def edited(text, pick, share):
    return " ".join("edit" + str(pick.random()) if pick.random() < share else w for w in text.split())


def families(seed):
    """Groups of copies with few and many changes, passages shared by many, plain documents."""
    pick, texts = random.Random(seed), []
    passage = prose(999, 60)
    for f in range(12):
        base = prose(1000 * seed + f, pick.choice([12, 60, 150, 400]))
        for _ in range(pick.choice([2, 5, 40])):
            texts.append(edited(base, pick, pick.choice([0, 0.005, 0.01, 0.02, 0.03])))
    for i in range(80):
        texts.append(prose(5000 + i, 40) + " " + passage + " " + prose(6000 + i, pick.choice([1, 3, 200])))
    texts += [prose(9000 + i, 3 + i) for i in range(60)]
    pick.shuffle(texts)
    return texts


def linked(spark, docs, **more):
    frame = spark.createDataFrame(rows([t for _, t in docs]), DOCS)
    got = jaccard.linked(frame, **more).collect()
    return sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in got)


@pytest.mark.parametrize("seed,often,percent", [(1, 32, 85), (2, 3, 85), (3, 8, 70)])
def test_all_links_are_found(spark, seed, often, percent):
    docs = list(enumerate(families(seed)))
    assert linked(spark, docs, often=often, percent=percent) == brute(docs, percent=percent)


def test_small_blocks_and_cells_change_nothing(spark, monkeypatch):
    docs = list(enumerate(families(7)))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "SMALL", 4)
    assert linked(spark, docs, often=10_000) == brute(docs)


def test_awkward_rows(spark):
    frame = awkward(spark)
    got = jaccard.linked(frame).collect()
    assert len(got) == len(AWKWARD) + 3
    want = brute([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()])
    assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in got) == want
    assert jaccard.linked(empty(spark)).count() == 0


def test_sets_without_id_among_them(spark):
    text = prose(1, 50)
    frame = spark.createDataFrame([(None, text), (None, text + " more"), (5, prose(2, 50))],
                                  "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.linked(frame).collect()}
    assert got == {(None, None), (5, 5)}


def test_links_through_a_set_without_id(spark):
    """Documents 1 and 3 are each near a third text, but not near each other."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[:185]), " ".join(words), " ".join(words[15:])]
    for middle, want in ((2, 1), (None, 1)):
        frame = spark.createDataFrame([(1, texts[0]), (middle, texts[1]), (3, texts[2]), (None, texts[1])],
                                      "doc_id long, text string")
        got = jaccard.linked(frame.repartition(3)).collect()
        assert [r["component_id"] for r in got] == [want] * 4
    alone = spark.createDataFrame([(1, texts[0]), (3, texts[2])], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.linked(alone).collect()} == {1, 3}


def test_cells_and_windows_miss_no_pair():
    pick = random.Random(2)
    texts = [edited(prose(f, 90), pick, pick.choice([0.01, 0.03])) for f in range(30) for _ in range(12)]
    sets = list(jaccard.row_sets(pa.array(texts), 4))
    block = jaccard.Block(pa.table({
        "node": list(range(len(sets))), "component": list(range(len(sets))),
        "n": [len(s) for s in sets], "signed": pa.array([jaccard.signature(s) for s in sets], pa.binary()),
    }), 85)
    everyone = np.arange(len(sets))
    cells = jaccard.pairs_of(block, list(block.joined(everyone, everyone[:0]))).tolist()
    flat = jaccard.pairs_of(block, list(block.compared(everyone, everyone[:0]))).tolist()
    assert cells == flat
    found = set(map(tuple, cells))
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                assert (j, i) in found


def open_region(spark, n, seed=3, families=8):
    """Members of one region: sets of many families, of which those of one are near each other."""
    pick = random.Random(seed)
    rows, texts = [], []
    heads = [prose(5000 + f, 60) for f in range(families)]
    for i in range(n):
        texts.append(edited(heads[i % families], pick, pick.choice([0.01, 0.02, 0.04])))
    sets = list(jaccard.row_sets(pa.array(texts), 4))
    for i, s in enumerate(sets):
        rows.append((77, i, i, len(s), bytearray(jaccard.signature(s)), n))
    return sets, spark.createDataFrame(
        rows, "region long, node long, component long, n long, signed binary, size long").repartition(4)


def test_large_regions_are_split_and_lose_no_pair(spark, monkeypatch):
    sets, members = open_region(spark, 1500)
    want = {tuple(sorted(r)) for r in jaccard.remaining_pairs(members, 85).collect()}  # one task
    monkeypatch.setattr(jaccard, "BLOCK", 250)
    parts = jaccard.in_parts(members, 85)
    assert parts.select("part").distinct().count() > 5
    sizes = [r["size"] for r in parts.groupBy("region", "part").agg(
        jaccard.F.first("size").alias("size")).collect()]
    assert sum(s * s for s in sizes) < 0.5 * 1500 * 1500
    got = {tuple(sorted(r)) for r in jaccard.remaining_pairs(members, 85).collect()}
    assert got == want
    for i, j in [(a, b) for a in range(0, 1500, 100) for b in range(a)]:
        common = len(np.intersect1d(sets[i], sets[j]))
        if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
            assert (j, i) in got


def test_a_region_that_cells_do_not_divide(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 50)
    _, members = open_region(spark, 300, families=1)
    want = {tuple(sorted(r)) for r in jaccard.remaining_pairs(members, 85).collect()}
    monkeypatch.setattr(jaccard, "BLOCK", 2048)
    assert {tuple(sorted(r)) for r in jaccard.remaining_pairs(members, 85).collect()} == want


def test_components(spark):
    pick = random.Random(4)
    pairs = [(pick.randrange(400), pick.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)]
    parent = {n: n for p in pairs for n in p}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {
        n: root(n) for n in parent if any(a != b and n in (a, b) for a, b in pairs)}
    assert len(got) == len({r["node"] for r in got})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bit_table(spark):
    held = jaccard.bit_table(spark.createDataFrame([(5,), (-1,), (69,)], "v long"), 64)
    assert jaccard.in_table(held, np.array([5, -1, 69, 6, 63, 0])).tolist() == [True, True, True, False, True, False]
    assert jaccard.table_size(3) == 1 << 24 and jaccard.table_size(10**7) == 1 << 28
    assert jaccard.table_size(10**10) == 1 << 30


def test_groups_are_whole_across_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(300).select((F.col("id") % 13).alias("k"), "id")
        got = jaccard.in_groups(rows, ["k"], lambda t: np.array([[t["k"][0].as_py(), len(t)]]))
        assert {tuple(r) for r in got.collect()} == {(k, 24 if k == 0 else 23) for k in range(13)}
        assert jaccard.in_groups(rows.limit(0), ["k"], lambda t: t).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
