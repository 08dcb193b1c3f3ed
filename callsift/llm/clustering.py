"""Exact centroid clustering of whole-numbered vectors by the Shallot search.

Every vector remembers its nearest and its second-nearest centroid, an upper bound of its distance to
the first and a lower bound of its distance to all others. When centroids have moved, the bounds are
widened by how far; a vector whose bounds still keep the nearest apart is left alone. For the others the
distances to the two remembered centroids are computed, and the closer one is the middle of the search:
the other centroids come in the order of their distance from it, and none beyond

    distance to the middle + distance to the second-nearest found so far

can be nearer than that second one. This ball shrinks whenever a nearer one is found, and the search
ends at the first centroid outside. What is left is compared by squared distances in whole numbers, ties
to the smaller number, so results don't depend on rounding: bounds only leave out what can't win or tie.

Vectors stay in their tasks. A round writes them with their new bounds, and sends to the driver only the
sums of those that changed their cluster, added up in each task; the driver holds one row per centroid.

Defined results: a vector takes part if it has exactly `d` components, none null or non-finite, and
none so large that a squared distance could leave the range of a long (for 64 components scaled by 256:
2^19 or more in size). Rows with equal vec_id are vectors of their own, among starts of equal hash the
smaller vector comes first; a null vec_id is hashed as nothing. With fewer vectors than centroids each is
a start. An empty table gives no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.session import settle, settled

SCALE = 256
SLACK = 1e-9  # a share of every bound, far above the rounding of square roots
STATE = ("vec_id long, vector array<int>, cluster int, second int, upper double, lower double, "
         "distance long, moved_from int")


def whole_numbered(rows: DataFrame, d: int, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector) of the rows that take part, every component as floor(scale * x)."""
    given = F.col("embedding").cast("array<double>")
    largest = math.isqrt((1 << 62) // d) // 2  # so that d squared differences fit in a long
    usable = (F.size("_given") == d) & F.forall(
        "_given", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < largest / scale)
    )
    vector = F.transform("_given", lambda x: F.floor(x * scale).cast("int"))
    return rows.select(F.col("vec_id").cast("long"), given.alias("_given")).filter(usable).select(
        "vec_id", vector.alias("vector")
    )


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the k smallest hashes of seed and id, in that order: the first centroids."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = vectors.select(F.sha2(text, 256).alias("h"), "vector").orderBy("h", "vector").limit(k)
    held = first.toArrow().column("vector").to_pylist()
    return np.array(held, dtype=np.int64) if held else np.empty((0, 0), dtype=np.int64)


def squared(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances in whole numbers, row by row."""
    return ((rows - others) ** 2).sum(axis=1)


class Centroids:
    """Centroids, for each one the others by distance, and how far each has moved."""

    def __init__(self, places: np.ndarray, before: np.ndarray | None = None):
        self.places = places
        self.k = len(places)
        gaps = np.stack([squared(places, p) for p in places]) if self.k else np.empty((0, 0))
        away = np.sqrt(gaps.astype(float))
        self.order = np.argsort(away, axis=1, kind="stable")
        self.away = np.take_along_axis(away, self.order, axis=1)
        moved = np.zeros(self.k) if before is None else np.sqrt(squared(places, before).astype(float))
        self.moved = moved * (1 + SLACK)
        # The farthest that any other centroid than this one has moved.
        ranked = np.argsort(-self.moved)
        self.others_moved = np.full(self.k, self.moved[ranked[0]] if self.k else 0.0)
        if self.k:
            self.others_moved[ranked[0]] = self.moved[ranked[1]] if self.k > 1 else 0.0


class Assignment:
    """Nearest and second-nearest centroids of a batch of vectors, with bounds."""

    def __init__(self, vectors: np.ndarray, cluster: np.ndarray, second: np.ndarray, upper: np.ndarray,
                 lower: np.ndarray):
        self.vectors, self.cluster, self.second = vectors, cluster.copy(), second.copy()
        self.upper, self.lower = upper.copy(), lower.copy()
        self.compared = 0

    def _to(self, at: np.ndarray, centroid: np.ndarray, c: Centroids) -> np.ndarray:
        self.compared += len(at)
        return squared(self.vectors[at], c.places[centroid])

    def update(self, c: Centroids) -> None:
        """Assign all vectors to the nearest of `c`, ties to the smaller number."""
        self.upper = self.upper + c.moved[self.cluster]
        self.lower = self.lower - c.others_moved[self.cluster]
        at = np.flatnonzero(self.upper * (1 + SLACK) >= self.lower * (1 - SLACK))
        # The bound from above becomes the distance itself; that settles many.
        self.upper[at] = np.sqrt(self._to(at, self.cluster[at], c).astype(float))
        at = at[self.upper[at] * (1 + SLACK) >= self.lower[at] * (1 - SLACK)]
        if c.k < 2:
            self.second[at] = self.cluster[at]
            self.lower[at] = np.inf
            return
        self._search(at, c)

    def _search(self, at: np.ndarray, c: Centroids) -> None:
        one, two = self.cluster[at], self.second[at]
        d1, d2 = self._to(at, one, c), self._to(at, two, c)
        swap = (d2 < d1) | ((d2 == d1) & (two < one))
        one, two = np.where(swap, two, one), np.where(swap, one, two)
        d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
        middle, tried = one.copy(), two.copy()
        reach = np.sqrt(d1.astype(float))
        left = np.arange(len(at))
        for place in range(1, c.k):  # at place 0 of a centroid's order is itself, or one equal to it
            ball = (reach[left] + np.sqrt(d2[left].astype(float))) * (1 + SLACK)
            left = left[c.away[middle[left], place] <= ball]
            if not len(left):
                break
            other = c.order[middle[left], place]
            fresh = left[(other != tried[left]) & (other != middle[left])]
            self._compare(at, fresh, c.order[middle[fresh], place], one, two, d1, d2, c)
        # Equal centroids may have put the middle itself behind place 0; what stood there is compared.
        front = c.order[middle, 0]
        odd = np.flatnonzero((front != middle) & (front != tried))
        self._compare(at, odd, front[odd], one, two, d1, d2, c)
        self.cluster[at], self.second[at] = one, two
        self.upper[at], self.lower[at] = np.sqrt(d1.astype(float)), np.sqrt(d2.astype(float))

    def _compare(self, at, rows, other, one, two, d1, d2, c: Centroids) -> None:
        """Let `other` take the first or second seat of `rows` where it is nearer."""
        d = self._to(at[rows], other, c)
        wins = (d < d1[rows]) | ((d == d1[rows]) & (other < one[rows]))
        follows = ~wins & ((d < d2[rows]) | ((d == d2[rows]) & (other < two[rows])))
        w, f = rows[wins], rows[follows]
        two[w], d2[w] = one[w], d1[w]
        one[w], d1[w] = other[wins], d[wins]
        two[f], d2[f] = other[follows], d[follows]


def assigned(state: DataFrame, c: Centroids, fresh: bool) -> DataFrame:
    """The state after assigning every vector to the nearest centroid of `c`.

    A `fresh` state has vectors only. `moved_from` is null where a vector stays in its cluster, and -1
    where it had none.
    """
    spark = state.sparkSession
    shipped = spark.sparkContext.broadcast(c)  # one row per centroid, whatever the number of vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        d = held.places.shape[1]
        for batch in batches:
            n = len(batch)
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            vectors = flat.astype(np.int64).reshape(n, d)
            if fresh:
                zero = np.zeros(n, dtype=np.int32)
                own = Assignment(vectors, zero, zero + min(1, held.k - 1), np.full(n, np.inf), np.zeros(n))
                before = np.full(n, -1, dtype=np.int32)
            else:
                column = {name: batch.column(name).to_numpy(zero_copy_only=False)
                          for name in ("cluster", "second", "upper", "lower")}
                own, before = Assignment(vectors, **column), column["cluster"]
            own.update(held)
            distance = squared(vectors, held.places[own.cluster])
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("vector"), pa.array(own.cluster.astype(np.int32)),
                pa.array(own.second.astype(np.int32)), pa.array(own.upper.astype(float)),
                pa.array(own.lower.astype(float)), pa.array(distance),
                pa.array(before, mask=before == own.cluster),
            ], ["vec_id", "vector", "cluster", "second", "upper", "lower", "distance", "moved_from"])

    return state.mapInArrow(assign, STATE)


def changes(state: DataFrame, k: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed clusters add to each cluster's sums and counts.

    Each task adds up its own and sends one row per cluster it touched, so at most tasks x k rows are
    folded by cluster and k rows reach the driver.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k, d + 1), dtype=np.int64)
        touched = np.zeros(k, dtype=bool)

        def add(cluster: np.ndarray, rows: np.ndarray) -> None:
            if len(cluster):
                order = np.argsort(cluster, kind="stable")
                first = np.flatnonzero(np.diff(cluster[order], prepend=-1))
                held[cluster[order[first]]] += np.add.reduceat(rows[order], first, axis=0)
                touched[cluster] = True

        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.column_stack([flat.reshape(len(batch), d), np.ones(len(batch), dtype=np.int64)])
            into = batch.column("cluster").to_numpy()
            out = batch.column("moved_from").to_numpy()
            add(into, rows)
            add(out[out >= 0], -rows[out >= 0])
        at = np.flatnonzero(touched)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(list(held[at]), pa.list_(pa.int64()))],
            ["cluster", "sums"],
        )

    moved = state.filter("moved_from IS NOT NULL").select("vector", "cluster", "moved_from")
    parts = moved.mapInArrow(fold, "cluster int, sums array<long>")
    each = parts.select("cluster", F.posexplode("sums").alias("place", "value"))
    totals = each.groupBy("cluster", "place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros((k, d + 1), dtype=np.int64)
    out[totals.column("cluster").to_numpy(), totals.column("place").to_numpy()] = (
        totals.column("value").to_numpy())
    return out[:, :d], out[:, d]


def clustered(rows: DataFrame, k: int, rounds: int, d: int, seed: int = 0) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): every vector's cluster after
    `rounds` of assigning and averaging and a last assignment; `centroid` is the cluster's place.

    Averages are exact, each component the floor of sum / count; a cluster without vectors stays where
    it is.
    """
    spark = rows.sparkSession
    schema = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
              "centroid array<long>")
    with settled(whole_numbered(rows, d), "vectors") as vectors:
        places = starts(vectors, k, seed)
        if not len(places):
            return spark.createDataFrame([], schema)
        state, before = vectors, None
        sums, counts = np.zeros((len(places), d), dtype=np.int64), np.zeros(len(places), dtype=np.int64)
        last = ExitStack()  # the tables of the round before, which go when the next ones are there
        for done in range(rounds + 1):
            now = ExitStack()
            moved = assigned(state, Centroids(places, before), before is None)
            state = now.enter_context(settled(moved, "bounds"))
            last.close()
            last = now
            if done < rounds:
                more, further = changes(state, len(places), d)
                sums, counts = sums + more, counts + further
                average = sums // np.maximum(counts, 1)[:, None]  # floors, negative sums too
                before, places = places, np.where(counts[:, None] > 0, average, places)
        with last:
            return settle(described(state, places), "clusters")


def described(state: DataFrame, places: np.ndarray) -> DataFrame:
    """The last state with the inertia of every cluster and of all, and the centroids."""
    inertia = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    of = {r["cluster"]: r["cluster_inertia"] for r in inertia.collect()}  # one row per centroid
    told = state.sparkSession.createDataFrame(
        [(c, of[c], sum(of.values()), [int(x) for x in places[c]]) for c in sorted(of)],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>",
    )
    # One row per centroid is small by its own bound, whatever the number of vectors.
    joined = state.select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
