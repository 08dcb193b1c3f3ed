import numpy as np
import pytest
from pyspark.sql import functions as F

from callsift.llm import neighbours as nn

KINDS = "vec_id long, embedding array<float>, label int, score double, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, 9) for i, v in rows], KINDS)


def brute(rows, modulus, k):
    held = {}
    for i, v in rows:
        if i is None or v is None or any(x is None for x in v):
            continue
        v = np.array(np.array(v, dtype=np.float32), dtype=float)
        if len(v) and np.isfinite(v).all() and v.any():
            held[i] = v
    out = {}
    for q, a in held.items():
        if q % modulus == 0:
            near = [(-float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), i)
                    for i, b in held.items() if i != q and len(b) == len(a)]
            out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in near)[:k]]
    return out


def got(spark, rows, modulus=50, k=5):
    out = {}
    for r in nn.nearest(frame(spark, rows), F.col("vec_id") % modulus == 0, k).collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    return {q: [v[i] for i in sorted(v)] for q, v in out.items()}


def test_recall_and_exact_scores(spark):
    pick = np.random.Generator(np.random.PCG64(1))
    centres = pick.normal(size=(40, 64))
    data = centres[pick.integers(0, 40, 3000)] + 0.7 * pick.normal(size=(3000, 64))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(data)]
    want, found = brute(rows, 50, 5), got(spark, rows)
    assert set(found) == set(want) and all(len(v) == 5 for v in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    vectors = {i: np.array(v) for i, v in rows}
    for q, near in found.items():
        assert [s for _, s in near] == sorted((s for _, s in near), reverse=True)
        for i, s in near:
            exact = vectors[q] @ vectors[i] / np.linalg.norm(vectors[q]) / np.linalg.norm(vectors[i])
            assert s == pytest.approx(exact, abs=1e-12)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.9, 0.1, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [1.0, None, 0.0]),
            (5, [nan, 1.0, 0.0]), (6, [inf, 1.0, 0.0]), (7, []), (None, [1.0, 0.0, 0.0]),
            (8, [-1.0, 0.0, 0.0]), (50, [2.0, 0.0, 0.0]), (51, [1.0, 0.0]), (100, [0.0, 0.0, 0.0]),
            (150, [3.0, 4.0]), (200, [5.0]), (1, [0.9, 0.1, 0.0])]
    found = got(spark, rows)
    assert [i for i, _ in found[0]] == [50, 1, 8]
    assert [i for i, _ in found[50]] == [0, 1, 8]
    assert found[150] == [(51, pytest.approx(0.6))]
    assert set(found) == {0, 50, 150}


def test_ties_and_copies_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000 + i, [3.0, 2.0, 1.0]) for i in range(3)]
    found = got(spark, rows, 100, 5)
    assert [i for i, _ in found[0]] == [1, 2, 3, 4, 5]
    assert [i for i, _ in found[200]] == [0, 1, 2, 3, 4]
    assert [i for i, _ in found[1000]] == [1001, 1002, 0, 1, 2]


def test_blocks_of_large_buckets_change_nothing(spark, monkeypatch):
    pick = np.random.Generator(np.random.PCG64(4))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(pick.normal(size=(600, 16)))]
    before = got(spark, rows, 10)
    monkeypatch.setattr(nn, "VECTOR_BLOCK", 16)
    monkeypatch.setattr(nn, "QUERY_BLOCK", 4)
    assert got(spark, rows, 10) == before


def test_empty(spark):
    assert got(spark, []) == {}


def test_hadamard_keeps_lengths():
    x = np.random.Generator(np.random.PCG64(1)).normal(size=(5, 32))
    y = nn.hadamard(x)
    assert np.allclose((x**2).sum(1), (y**2).sum(1)) and np.allclose(nn.hadamard(y), x)
