"""Multiclass boosting against plain loops, and its model stored and loaded."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from callsift.operators import boosting as bo


def plain(values, labels, thresholds, rounds, depth, rate):
    """Class probabilities by boosting written with loops over rows and every possible split."""
    n_classes = max(labels) + 1
    counts = np.bincount(labels, minlength=n_classes)
    scores = np.tile(np.log(counts / len(labels)), (len(labels), 1))

    def fit(rows, residual, level):
        total = round(sum(residual[i] for i in rows) * bo.UNIT) / bo.UNIT
        curve = sum(abs(residual[i]) * (1 - abs(residual[i])) for i in rows)
        if level == depth:
            value = rate * (n_classes - 1) / n_classes * total / curve if curve > 0 else 0.0
            return {i: value for i in rows}
        best, most = None, total ** 2 / max(len(rows), 1) * (1 + 1e-12)
        for f, cuts in enumerate(thresholds):
            for cut in cuts:
                left = [i for i in rows if values[i][f] <= cut]
                right = [i for i in rows if values[i][f] > cut]
                if left and right:
                    gain = sum(residual[i] for i in left) ** 2 / len(left) + (
                        sum(residual[i] for i in right) ** 2 / len(right))
                    if gain > most + 1e-12:
                        best, most = (left, right), gain
        if best is None:
            return fit(rows, residual, level + 1)
        return {**fit(best[0], residual, level + 1), **fit(best[1], residual, level + 1)}

    for _ in range(rounds):
        chances = bo.softmax(scores)
        step = np.zeros_like(scores)
        for c in range(n_classes):
            residual = [(labels[i] == c) - chances[i, c] for i in range(len(labels))]
            for i, value in fit(list(range(len(labels))), residual, 0).items():
                step[i, c] = value
        scores = scores + step
    return bo.softmax(scores)


def fixture(n=120, seed=4):
    pick = np.random.Generator(np.random.PCG64(seed))
    values = np.column_stack([pick.normal(size=n), pick.integers(0, 4, n), np.full(n, 3.0), pick.random(n)])
    labels = ((values[:, 0] > 0.3).astype(int) + (values[:, 1] > 1) * (values[:, 3] > 0.5)).astype(int)
    return values, labels


def frame(spark, values, labels, parts=3):
    rows = [(i, Vectors.dense(v), float(y)) for i, (v, y) in enumerate(zip(values, labels, strict=True))]
    return spark.createDataFrame(rows, ["id", "features", "label"]).repartition(parts)


def test_like_plain_loops(spark):
    values, labels = fixture()
    df = frame(spark, values, labels)
    model = bo.MulticlassBoosting(rounds=13, depth=3, rate=0.3).fit(df)  # beyond one update of the scores
    arrays = df.select(bo.vector_to_array("features").alias("x"))
    want = plain(values.tolist(), labels.tolist(), bo.quantiles(arrays, 4), 13, 3, 0.3)
    got = {r["id"]: r for r in model.transform(df).collect()}
    for i, chances in enumerate(want):
        assert got[i]["probability"].toArray() == pytest.approx(chances, abs=1e-6)
        assert got[i]["prediction"] == chances.argmax()
    assert sum(got[i]["prediction"] == y for i, y in enumerate(labels)) > 0.95 * len(labels)


def test_same_trees_on_any_partitioning_and_after_loading(spark, tmp_path):
    values, labels = fixture(400, 9)
    made = [bo.MulticlassBoosting(rounds=5).fit(frame(spark, values, labels, n)) for n in (1, 7)]
    assert made[0].getOrDefault("fitted") == made[1].getOrDefault("fitted")
    made[0].save(str(tmp_path / "model"))
    loaded = bo.MulticlassModel.load(str(tmp_path / "model"))
    df = frame(spark, values, labels)
    a, b = (sorted((r["id"], r["prediction"], tuple(r["probability"])) for r in m.transform(df).collect())
            for m in (made[0], loaded))
    assert a == b and all(sum(p) == pytest.approx(1) for _, _, p in a)


def test_one_class_and_no_rows(spark):
    values, _ = fixture(20)
    model = bo.MulticlassBoosting(rounds=3).fit(frame(spark, values, np.zeros(20, dtype=int)))
    assert {(r["prediction"], r["probability"][0]) for r in model.transform(
        frame(spark, values, np.zeros(20))).collect()} == {(0.0, 1.0)}
    with pytest.raises(ValueError, match="no labelled rows"):
        bo.MulticlassBoosting().fit(frame(spark, values, np.zeros(20)).limit(0))


def test_one_table_per_class_reaches_the_driver(spark):
    """However many tasks there are."""
    rng = np.random.default_rng(3)
    blocks = [(rng.integers(0, 9, (50, 2), dtype=np.uint8), rng.integers(0, 3, 50), np.zeros((50, 3))) for _ in range(12)]
    trees = [{"feature": np.zeros(1, int), "bin": np.array([4]), "threshold": np.zeros(1), "value": np.zeros(2)}] * 3
    sums = {}
    for parts in (1, 12):
        state = spark.sparkContext.parallelize(blocks, parts)
        read = []
        kind, real = type(state), type(state).collect
        try:
            kind.collect = lambda self, read=read, real=real: read.append(self.getNumPartitions()) or real(self)
            sums[parts] = bo._level_sums(state, [], 1)(trees, 0)
        finally:
            kind.collect = real
        assert read and max(read) <= 3
    assert sums[1].shape == (3, 1, 2, bo.BINS, 3) and (sums[1] == sums[12]).all()
