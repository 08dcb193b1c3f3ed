"""Exact nearest vectors from stored cells: pivots, radii and the triangle inequality.

    path/kinds                  no rows, but the types of key and embedding
    path/pivots                 (cell, pivot, radius, n): at most MOST_PIVOTS rows
    path/cells/cell=C           (key, embedding, away): the vectors nearest to pivot C, by distance from it

A vector in a cell lies no nearer to a query than the query's distance from the pivot less the cell's
radius. A search scans the cells of the nearest pivots first; the k-th distance found there rules out
every cell, and in the others every vector by its own distance from the pivot, that can't come nearer.
Folders of cells that no query needs are not opened. The result is that of a scan through all vectors.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsift.operators import retrieval as rt
from callsift.plans.sizing import blocks
from callsift.session import settle

MOST_PIVOTS = 1_024
FIRST_CELLS = 3
SLACK = 1e-6  # of all distances, above the rounding of a matrix product


def _matrix(lists) -> np.ndarray:
    return np.array(list(lists), dtype=np.float64)


def _distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    squares = (rows * rows).sum(axis=1)[:, None] + (others * others).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(squares - 2 * rows @ others.T, 0.0))


def _stored_schema(vectors: T.StructType) -> T.StructType:
    more = [T.StructField("away", T.DoubleType()), T.StructField("cell", T.IntegerType())]
    return T.StructType([*vectors.fields, *more])


def build(corpus: DataFrame, path: str, key: str | list[str] = "vec_id") -> int:
    """Store the (key, embedding) vectors in cells; returns the number of cells.

    About sqrt(n) vectors are pivots, those with the smallest hashes of their keys. Vectors without
    components take no part, as in a scan.
    """
    keys = [key] if isinstance(key, str) else list(key)
    slim = corpus.select(*keys, "embedding").filter("embedding IS NOT NULL")
    n = slim.count()
    wanted = max(1, min(MOST_PIVOTS, math.isqrt(n)))
    held = slim.select("embedding").orderBy(F.xxhash64(*keys), *keys).limit(wanted).toArrow()
    pivots = _matrix(held.column("embedding").to_pylist())
    spark = corpus.sparkSession
    shipped = spark.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS rows

    def place(batches):
        for batch in batches:
            if not len(batch):
                continue
            away = _distances(_matrix(batch.column("embedding").to_pylist()), shipped.value)
            cell = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(away[np.arange(len(cell)), cell]), pa.array(cell, pa.int32())],
                [*batch.schema.names, "away", "cell"],
            )

    slim.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/kinds")
    schema = _stored_schema(slim.schema)
    placed = slim.mapInArrow(place, schema).hint("rebalance", "cell").sortWithinPartitions("cell", "away")
    placed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    sizes = spark.read.schema(schema).parquet(f"{path}/cells").groupBy("cell").agg(
        F.max("away").alias("radius"), F.count("*").alias("n"))
    rows = [(i, p.tolist()) for i, p in enumerate(pivots)]
    middle = spark.createDataFrame(rows, "cell int, pivot array<double>")
    middle.join(F.broadcast(sizes), "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")
    return len(rows)


def search(queries: DataFrame, path: str, key: str | list[str] = "vec_id", k: int = rt.TOP_K,
           scored=None) -> DataFrame:
    """(query_id, key, distance, hit_rank): the k nearest stored vectors per (query_id, embedding) query by
    squared distance, as `retrieval.vector_topk` finds them. `scored` is an accumulator for the number of
    distances computed."""
    spark, keys = queries.sparkSession, [key] if isinstance(key, str) else list(key)
    middle = spark.read.parquet(f"{path}/pivots").orderBy("cell").toArrow()
    cells = spark.read.schema(_stored_schema(spark.read.parquet(f"{path}/kinds").schema)).parquet(f"{path}/cells")
    parts = blocks(queries, "query_id", rt.QUERIES_PER_PASS, F.size("embedding") * 8)
    found = reduce(DataFrame.unionByName, [_one_pass(p, cells, middle, keys, k, scored) for p in parts])
    return found.withColumnRenamed("cost", "distance")


def _one_pass(block: DataFrame, cells: DataFrame, middle: pa.Table, keys: list[str], k: int, scored) -> DataFrame:
    held = block.select("query_id", "embedding").filter("embedding IS NOT NULL").toArrow()
    if not len(held) or not len(middle):
        return rt.no_hits(block, cells, keys)
    points = _matrix(held.column("embedding").to_pylist())
    ids = held.column("query_id").to_pylist()
    numbers = middle.column("cell").to_numpy()
    away = _distances(points, _matrix(middle.column("pivot").to_pylist()))  # queries x cells
    radius = middle.column("radius").to_numpy()
    kind = block.schema["query_id"].dataType
    # Cells in the order of how near a vector of theirs may be.
    least = np.maximum(away - radius[None, :], 0.0)
    order = np.argsort(least, axis=1, kind="stable")[:, :FIRST_CELLS]
    first = np.zeros(away.shape, dtype=bool)
    np.put_along_axis(first, order, True, axis=1)
    nothing = np.full(len(ids), np.inf)
    best = settle(rt.ranked(
        _scanned(cells, keys, points, ids, kind, k, numbers, away, first, nothing, scored), keys, k), "best")
    limit = np.full(len(ids), np.inf)
    place = {q: i for i, q in enumerate(ids)}
    for row in best.filter(F.col("hit_rank") == k).select("query_id", "cost").collect():  # one per query
        limit[place[row["query_id"]]] = math.sqrt(row["cost"])
    limit = limit * (1 + SLACK) + SLACK
    rest = (least <= limit[:, None]) & ~first
    if not rest.any():
        return best
    more = _scanned(cells, keys, points, ids, kind, k, numbers, away, rest, limit, scored)
    return rt.ranked(best.drop("hit_rank").unionByName(more), keys, k)


def _scanned(cells: DataFrame, keys: list[str], points: np.ndarray, ids: list, kind: T.DataType, k: int,
             numbers: np.ndarray, away: np.ndarray, wanted: np.ndarray, limit: np.ndarray, scored) -> DataFrame:
    """Each task's k nearest vectors per query among the wanted (query, cell) pairs."""
    asked = [int(c) for c in numbers[wanted.any(axis=0)]]
    column = {int(c): i for i, c in enumerate(numbers)}
    squares = (points * points).sum(axis=1)

    def costs(part):
        out = np.full((len(part), len(ids)), np.inf)
        rows = _matrix(part["embedding"])
        own = part["cell"].to_numpy()
        far = part["away"].to_numpy()
        for cell in np.unique(own):
            at, c = np.flatnonzero(own == cell), column[int(cell)]
            some = np.flatnonzero(wanted[:, c])
            # A vector outside the ring around the pivot that the limit leaves is not nearer than it.
            near = np.abs(away[some, c][None, :] - far[at][:, None]) <= limit[some][None, :]
            some, at = some[near.any(axis=0)], at[near.any(axis=1)]
            if not len(some) or not len(at):
                continue
            cross = rows[at] @ points[some].T
            if scored is not None:
                scored.add(len(at) * len(some))
            held = (rows[at] * rows[at]).sum(axis=1)[:, None] + squares[some] - 2 * cross
            out[np.ix_(at, some)] = np.maximum(held, 0.0)
        return out

    slim = cells.filter(F.col("cell").isin(asked)).select(*keys, "embedding", "away", "cell")
    return rt.scan_best(slim, keys, ids, kind, k, costs)


def share_scored(spark: SparkSession, path: str, queries: int, scored: int) -> float:
    """Of all pairs of query and vector, the share whose distance was computed."""
    total = spark.read.parquet(f"{path}/pivots").agg(F.sum("n")).first()[0] or 0
    return scored / max(1, total * queries)
