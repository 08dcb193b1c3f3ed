"""Search over stored cells against a scan through all vectors."""

import numpy as np
import pytest

from callsift.operators import retrieval as rt
from callsift.operators import vectorindex as vi


def corpus(spark, points):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame([*rows, (10**6, None)], "vec_id long, embedding array<double>").repartition(4)


def asked(spark, points):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "query_id long, embedding array<double>")


def hits(df):
    return sorted((r["query_id"], r["hit_rank"], r["vec_id"], round(r["distance"], 8)) for r in df.collect())


@pytest.mark.parametrize("kind", ["grid", "random", "copies"])
def test_same_hits_as_the_scan(spark, tmp_path, monkeypatch, kind):
    pick = np.random.Generator(np.random.PCG64(3))
    points = pick.integers(-3, 4, size=(500, 4)).astype(float) if kind == "grid" else pick.normal(size=(500, 8))
    if kind == "copies":
        points[::3] = points[0]
    frame, queries = corpus(spark, points), asked(spark, points[:15] + 0.25)
    path = str(tmp_path / "cells")
    assert vi.build(frame, path) == 22
    for k in (1, 7, 600):
        assert hits(vi.search(queries, path, k=k)) == hits(rt.vector_topk(queries, frame, k=k))
    monkeypatch.setattr(rt, "QUERIES_PER_PASS", 4)
    assert hits(vi.search(queries, path, k=3)) == hits(rt.vector_topk(queries, frame, k=3))


def test_clustered_vectors_are_mostly_skipped(spark, tmp_path):
    pick = np.random.Generator(np.random.PCG64(5))
    middles = 20 * pick.normal(size=(40, 16))
    shares = []
    for n in (800, 6400):
        points = middles[pick.integers(0, 40, n)] + 0.5 * pick.normal(size=(n, 16))
        queries = asked(spark, points[:30])
        path, counted = str(tmp_path / f"cells{n}"), spark.sparkContext.accumulator(0)
        vi.build(corpus(spark, points), path)
        got = hits(vi.search(queries, path, k=5, scored=counted))
        shares.append(vi.share_scored(spark, path, 30, counted.value))
        assert got == hits(rt.vector_topk(queries, corpus(spark, points), k=5))
    assert shares[0] < 0.25 and shares[1] < 0.6 * shares[0]


def test_nothing_stored_and_nothing_asked(spark, tmp_path):
    path = str(tmp_path / "cells")
    none = np.empty((0, 3))
    vi.build(corpus(spark, none), path)
    assert vi.search(asked(spark, np.ones((2, 3))), path).count() == 0
    vi.build(corpus(spark, np.ones((3, 3))), path)
    assert vi.search(asked(spark, none), path).count() == 0
    assert hits(vi.search(asked(spark, np.ones((1, 3))), path, k=2)) == [(0, 1, 0, 0.0), (0, 2, 1, 0.0)]
