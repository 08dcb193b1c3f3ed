import hashlib

import numpy as np
import pytest

from callsift.llm import clustering as cl


def brute(vectors, k, rounds, seed):
    """Plain rounds of assigning and averaging over (vec_id, whole numbers)."""
    def key(v):
        return hashlib.sha256(f"{seed}:{'' if v[0] is None else v[0]}".encode()).hexdigest(), v[1]

    places = [list(v) for _, v in sorted(vectors, key=key)[:k]]
    for turn in range(rounds + 1):
        own = []
        for _, v in vectors:
            d = [sum((a - b) ** 2 for a, b in zip(v, p, strict=True)) for p in places]
            own.append((min(d), d.index(min(d))))
        if turn == rounds:
            break
        for c in range(len(places)):
            held = [v for (_, v), (_, o) in zip(vectors, own, strict=True) if o == c]
            if held:
                places[c] = [sum(x) // len(held) for x in zip(*held, strict=True)]
    inertia = [sum(d for d, o in own if o == c) for c in range(len(places))]
    return sorted(
        ((i, c, d, inertia[c], sum(inertia), places[c]) for (i, _), (d, c) in zip(vectors, own, strict=True)),
        key=repr,
    )


SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 5, "mine") for i, v in vectors], SCHEMA)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(n, d, seed, spread=0.3, whole=False):
    pick = np.random.Generator(np.random.PCG64(seed))
    middles = pick.normal(size=(7, d))
    rows = middles[pick.integers(0, 7, n)] + spread * pick.normal(size=(n, d))
    if whole:  # few places, so that distances tie
        rows = np.round(rows) / 256
    return [(i, [float(x) for x in np.float32(r)]) for i, r in enumerate(rows)]


def scaled(vectors):
    return [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v in vectors]


@pytest.mark.parametrize("whole", [False, True])
def test_same_as_plain_rounds(spark, whole):
    vectors = made(400, 6, 3, whole=whole)
    got = cl.clustered(frame(spark, vectors).repartition(3), k=11, rounds=5, d=6, seed=2)
    assert found(got) == brute(scaled(vectors), 11, 5, 2)


def test_ties_and_copies(spark):
    corners = [(i, [float(i >> j & 1) for j in range(3)]) for i in range(8)]
    vectors = corners + [(100 + i, [0.5, 0.5, 0.5]) for i in range(50)] + [(3, [1.0, 1.0, 0.0])] * 20
    got = cl.clustered(frame(spark, vectors), k=9, rounds=3, d=3)
    assert found(got) == brute(scaled(vectors), 9, 3, 0)


def test_few_and_odd_vectors(spark):
    odd = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None, 0.0]), (5, [1.0, float("nan"), 0.0]),
           (6, [1.0, float("inf"), 0.0]), (7, [1e9, 0.0, 0.0])]
    good = [(8, [0.1, -0.1, 2.0]), (None, [0.0, 0.0, 0.0]), (8, [0.1, -0.1, 2.0])]
    got = cl.clustered(frame(spark, odd + good), k=5, rounds=2, d=3)
    assert found(got) == brute(scaled(good), 5, 2, 0)
    assert found(cl.clustered(frame(spark, odd), k=5, rounds=2, d=3)) == []
    assert found(cl.clustered(frame(spark, good[:1]), k=1, rounds=1, d=3))[0][1] == 0


def test_search_leaves_out_most_centroids():
    pick = np.random.Generator(np.random.PCG64(5))
    middles = pick.integers(-4000, 4000, (60, 8))
    vectors = (middles[pick.integers(0, 60, 5000)] + pick.integers(-80, 80, (5000, 8))).astype(np.int64)
    places = middles + pick.integers(-20, 20, (60, 8))
    zero = np.zeros(5000, dtype=np.int32)
    own = cl.Assignment(vectors, zero, zero + 1, np.full(5000, np.inf), np.zeros(5000))
    own.update(cl.Centroids(places))
    plain = ((vectors[:, None] - places[None]) ** 2).sum(axis=2)
    assert (own.cluster == plain.argmin(axis=1)).all()
    assert (own.second == np.argsort(plain, axis=1, kind="stable")[:, 1]).all()
    before = own.compared
    moved = places + pick.integers(-3, 4, places.shape)
    own.update(cl.Centroids(moved, places))
    assert (own.cluster == ((vectors[:, None] - moved[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert own.compared - before < 0.02 * plain.size  # bounds settle nearly all
    again = cl.Assignment(vectors, own.cluster, own.second, np.full(5000, np.inf), np.zeros(5000))
    again.update(cl.Centroids(moved))
    assert again.compared < 0.15 * plain.size  # and the ball leaves out the far ones


def test_equal_centroids():
    places = np.array([[0, 0], [5, 5], [0, 0], [5, 5], [5, 5]])
    pick = np.random.Generator(np.random.PCG64(2))
    vectors = pick.integers(-9, 9, (200, 2)).astype(np.int64)
    plain = ((vectors[:, None] - places[None]) ** 2).sum(axis=2)
    for first in range(5):
        for second in range(5):
            if first != second:
                seat = np.zeros(200, dtype=np.int32)
                own = cl.Assignment(vectors, seat + first, seat + second, np.full(200, np.inf), np.zeros(200))
                own.update(cl.Centroids(places))
                assert (own.cluster == plain.argmin(axis=1)).all()
