"""Multiclass gradient boosting over binned histograms.

In every round one tree per class is fitted to the residuals of one shared softmax. Values are binned once,
by quantiles; a level of all trees of a round is grown from one aggregation of residuals by (class, node,
feature, bin), which every task adds up over its own rows; the tables of all tasks are added up class by class
in the executors. What reaches the driver is one table of that fixed size per level, whatever the number of
rows and tasks. Sums run on whole numbers, so the trees don't depend on
the order of tasks.

The rows' bins and scores stay in the executors, a byte per value; scores are brought up to date every few
rounds. This is the one place that works on partitions by hand: three hundred small aggregations in a row,
each over arrays that tasks keep as they are. A lost executor's rows are read and binned again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 64
UNIT = float(1 << 30)
ROWS_OF_TASK = 20_000
ROUNDS_KEPT = 10  # rounds after which the rows' scores are brought up to date
Tree = dict[str, np.ndarray]  # feature, threshold, bin of the inner nodes; value of the leaves


class _Boosting(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    """Columns that the estimator and its model share."""


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def leaf_of(tree: Tree, rows: np.ndarray, cut: str, depth: int | None = None) -> np.ndarray:
    """The node that each row comes to: a leaf, or a node of the given depth of a tree being grown."""
    node = np.zeros(len(rows), dtype=np.int64)
    everyone = np.arange(len(rows))
    levels = int(np.log2(len(tree["feature"]) + 1)) if depth is None else depth
    for _ in range(levels):
        right = rows[everyone, tree["feature"][node]] > tree[cut][node]
        node = 2 * node + 1 + right
    return node - (2 ** levels - 1)


def added(scores: np.ndarray, rounds: list[list[Tree]], rows: np.ndarray, cut: str) -> np.ndarray:
    """Scores after further rounds of trees, one per class."""
    out = scores.copy()
    for trees in rounds:
        for c, tree in enumerate(trees):
            out[:, c] += tree["value"][leaf_of(tree, rows, cut)]
    return out


def residuals(scores: np.ndarray, labels: np.ndarray) -> np.ndarray:
    out = -softmax(scores)
    out[np.arange(len(labels)), labels] += 1
    return out


def sums_of(rows: np.ndarray, node: np.ndarray, n_nodes: int, residual: np.ndarray,
            leaves: bool) -> np.ndarray:
    """Of one class: by (node, feature, bin) the whole-number sums of residuals and, above `leaves`, of their
    curvature, and the number of rows."""
    whole = np.rint(residual * UNIT)
    kinds = [(0, whole), (2, None)]
    if leaves:
        size = np.abs(residual)
        kinds.append((1, np.rint(size * (1 - size) * UNIT)))
    out = np.zeros((n_nodes, rows.shape[1], BINS, 3), dtype=np.int64)
    first = node * BINS
    for f in range(rows.shape[1]):
        at = first + rows[:, f]
        for i, weights in kinds:
            held = np.bincount(at, weights, minlength=n_nodes * BINS)
            out[:, f, :, i] = held.reshape(n_nodes, BINS)
    return out


def best_split(sums: np.ndarray) -> tuple[int, int] | None:
    """(feature, bin) of the split of one node that takes away most squared error; the first one of equal
    ones, None where none does."""
    left = np.cumsum(sums, axis=1)[:, :-1].astype(float)
    whole = sums[0].sum(axis=0).astype(float)
    right = whole - left
    fits = (left[..., 2] > 0) & (right[..., 2] > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 0] ** 2 / left[..., 2] + right[..., 0] ** 2 / right[..., 2]
    gain = np.where(fits, gain, -1.0)
    place = int(gain.argmax())
    feature, cut = divmod(place, gain.shape[1])
    if gain[feature, cut] <= whole[0] ** 2 / max(whole[2], 1) * (1 + 1e-12):
        return None
    return feature, cut


def leaf_value(total: np.ndarray, n_classes: int, rate: float) -> float:
    """What a leaf with these sums adds to its class's score."""
    if total[1] <= 0:
        return 0.0
    return rate * (n_classes - 1) / n_classes * float(total[0]) / float(total[1])


def grown(level_sums, thresholds: list[np.ndarray], n_classes: int, depth: int, rate: float) -> list[Tree]:
    """One tree per class, level by level; `level_sums(trees, level)` has the sums by (class, node)."""
    inner = 2 ** depth - 1
    trees: list[Tree] = [{
        "feature": np.zeros(inner, dtype=np.int64), "bin": np.full(inner, BINS, dtype=np.int64),
        "threshold": np.full(inner, np.inf), "value": np.zeros(inner + 1),
    } for _ in range(n_classes)]
    for level in range(depth):
        sums = level_sums(trees, level)
        for c, tree in enumerate(trees):
            for i in range(2 ** level):
                node, split = 2 ** level - 1 + i, best_split(sums[c, i])
                if split is not None:
                    feature, cut = split
                    tree["feature"][node], tree["bin"][node] = feature, cut
                    tree["threshold"][node] = thresholds[feature][cut]
                if level == depth - 1:
                    whole = sums[c, i, 0].sum(axis=0)
                    left = whole if split is None else sums[c, i, split[0], : split[1] + 1].sum(axis=0)
                    for side, total in enumerate((left, whole - left)):
                        tree["value"][2 * i + side] = leaf_value(total, n_classes, rate)
    return trees


def binned(values: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """The number of a value's bin: how many thresholds are below it."""
    out = np.empty(values.shape, dtype=np.uint8)
    for f, cuts in enumerate(thresholds):
        out[:, f] = np.searchsorted(cuts, values[:, f], side="left")
    return out


def quantiles(rows: DataFrame, n_features: int) -> list[np.ndarray]:
    """At most BINS - 1 different thresholds per feature, from one pass over all rows."""
    columns = rows.select(*[F.col("x")[i].alias(f"f{i}") for i in range(n_features)])
    shares = [i / BINS for i in range(1, BINS)]
    found = columns.approxQuantile(columns.columns, shares, 1 / (16 * BINS))
    return [np.unique(np.array(f, dtype=float)) for f in found]


class MulticlassBoosting(Estimator, _Boosting, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees for any number of classes; labels are 0, 1, ... as numbers."""

    rounds = Param(Params._dummy(), "rounds", "rounds of one tree per class", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "levels of a tree", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "share of each tree that is added", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", rounds=100, depth=3, rate=0.1):
        super().__init__()
        self._setDefault(rounds=100, depth=3, rate=0.1)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> MulticlassModel:
        rows = df.select(
            vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("int").alias("y")
        )
        counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # one row per class
        if not counts:
            raise ValueError("no labelled rows to learn from")
        n_classes, total = max(counts) + 1, sum(counts.values())
        # A class without rows has no score that any row could lift above the others'.
        start = np.log(np.maximum([counts.get(c, 0) / total for c in range(n_classes)], 1e-300))
        thresholds = quantiles(rows, len(rows.first()["x"]))
        trees = self._boosted(rows, thresholds, start, n_classes, total) if n_classes > 1 else []
        return MulticlassModel._made(self, start, trees)

    def _boosted(self, rows: DataFrame, thresholds: list[np.ndarray], start: np.ndarray,
                 n_classes: int, total: int) -> list[list[Tree]]:
        depth, rate = self.getOrDefault(self.depth), self.getOrDefault(self.rate)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column("x").flatten().to_numpy(zero_copy_only=False)
                bins = binned(values.reshape(len(batch), -1), thresholds)
                labels = batch.column("y").to_numpy().astype(np.uint8 if n_classes < 256 else np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bins.tobytes()]), pa.array([labels.tobytes()])], ["bins", "labels"])

        n_features, kind = len(thresholds), np.uint8 if n_classes < 256 else np.int32

        def unpack(parts: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            held = list(parts)
            if held:
                bins = np.frombuffer(b"".join(r["bins"] for r in held), dtype=np.uint8)
                bins = np.asfortranarray(bins.reshape(-1, n_features))  # a feature's values side by side
                labels = np.frombuffer(b"".join(r["labels"] for r in held), dtype=kind).astype(np.int64)
                yield bins, labels, np.tile(start, (len(bins), 1))

        # Small tables in as few tasks as they are worth, larger ones in all there are.
        worth, held = -(-total // ROWS_OF_TASK), rows.rdd.getNumPartitions()
        wanted = max(1, min(worth, max(held, rows.sparkSession.sparkContext.defaultParallelism)))
        dealt = rows.repartition(wanted) if held < wanted else rows.coalesce(wanted)
        packed = dealt.mapInArrow(pack, "bins binary, labels binary")
        state = packed.rdd.mapPartitions(unpack).persist(StorageLevel.MEMORY_AND_DISK)
        done: list[list[Tree]] = []
        recent: list[list[Tree]] = []
        try:
            for _ in range(self.getOrDefault(self.rounds)):
                if len(recent) == ROUNDS_KEPT:
                    state, recent = _brought_up(state, recent), []
                trees = grown(_level_sums(state, recent, depth), thresholds, n_classes, depth, rate)
                recent.append(trees)
                done.append(trees)
        finally:
            state.unpersist()
        return done


def _brought_up(state: RDD, recent: list[list[Tree]]) -> RDD:
    """The rows with their scores after the recent rounds; what they come from is given up once they exist."""
    now = state.map(lambda held: (held[0], held[1], added(held[2], recent, held[0], "bin"))).persist(
        StorageLevel.MEMORY_AND_DISK)
    now.count()
    state.unpersist()
    return now


def _level_sums(state: RDD, recent: list[list[Tree]], depth: int):
    """The function that adds up a level of the trees being grown, over all rows in one aggregation."""

    def at_level(trees: list[Tree], level: int) -> np.ndarray:
        def add_up(parts: Iterator) -> Iterator[tuple[int, np.ndarray]]:
            for bins, labels, scores in parts:
                left = residuals(added(scores, recent, bins, "bin"), labels)
                for c, tree in enumerate(trees):
                    node = leaf_of(tree, bins, "bin", level)
                    yield c, sums_of(bins, node, 2 ** level, left[:, c], level == depth - 1)

        tables = state.mapPartitions(add_up)
        if state.getNumPartitions() > 1:
            tables = tables.reduceByKey(np.add, min(len(trees), state.getNumPartitions()))
        out = [0] * len(trees)
        for c, table in tables.collect():  # one of fixed size per class
            out[c] = out[c] + table
        return np.stack(out)

    return at_level


class MulticlassModel(Model, _Boosting, DefaultParamsReadable, DefaultParamsWritable):
    """Class probabilities and the likeliest class by boosted trees."""

    fitted = Param(Params._dummy(), "fitted", "start scores and trees as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", fitted=None):
        super().__init__()
        self._set(**self._input_kwargs)

    @classmethod
    def _made(cls, source: MulticlassBoosting, start: np.ndarray, rounds: list[list[Tree]]) -> MulticlassModel:
        shown = {
            "start": start.tolist(),
            "rounds": [[{k: tree[k].tolist() for k in ("feature", "threshold", "value")} for tree in trees]
                       for trees in rounds],
        }
        return cls(featuresCol=source.getFeaturesCol(), fitted=json.dumps(shown))

    def _transform(self, df: DataFrame) -> DataFrame:
        text = self.getOrDefault(self.fitted)

        @F.arrow_udf("array<double>")
        def chances(x: pa.Array) -> pa.Array:
            held = json.loads(text)
            rounds = [[{k: np.array(v, dtype=np.int64 if k == "feature" else float) for k, v in tree.items()}
                       for tree in trees] for trees in held["rounds"]]
            values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            begun = np.tile(np.array(held["start"]), (len(values), 1))
            return pa.array(list(softmax(added(begun, rounds, values, "threshold"))), pa.list_(pa.float64()))

        told = df.withColumn("_chances", chances(vector_to_array(self.getFeaturesCol())))
        best = F.array_position("_chances", F.array_max("_chances")) - 1
        return told.withColumns({
            self.getProbabilityCol(): array_to_vector("_chances"),
            self.getPredictionCol(): best.cast("double"),
        }).drop("_chances")
