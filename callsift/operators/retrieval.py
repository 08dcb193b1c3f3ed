"""Chunks, vectors and nearest-neighbour search.

Search scans the corpus once per block of queries. The queries of a block travel to every task, each
task keeps its own k best per query, and only those are shuffled: no pair of query and document
leaves the task that scored it, the corpus is never shuffled by query, and results are exact.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from callsift.functions import text as tx
from callsift.plans.once import computed_once
from callsift.plans.sizing import blocks, lookup_side
from callsift.session import settle

KEY = "contact_id"
PARENT_SIZE, PARENT_OVERLAP = 2000, 200
CHILD_SIZE, CHILD_OVERLAP = 400, 50
TOP_K = 7
CONTEXT_PARENTS = 3
QUERIES_PER_PASS = 4_096
MERGE_GROUPS = 64
# The last bits of a sum depend on how rows were blocked; 40 leading ones decide, so equal texts tie.
LAST_BITS = 12


def chunk(docs: DataFrame, size: int = PARENT_SIZE, overlap: int = PARENT_OVERLAP,
          text_col: str = "text", number: str = "parent_no") -> DataFrame:
    """Documents cut into numbered overlapping pieces; all other columns are kept.

    The text is cut once into steps of size - overlap, and each piece is a step with the beginning
    of the next: linear in the text, where cutting each piece from the whole text would start over
    at its first character every time. A last step that the piece before it covers is no piece.
    """
    step = size - overlap
    if overlap > step:
        raise ValueError("an overlap beyond half the size would reach over the next step")
    kept = [c for c in docs.columns if c != text_col]
    text = F.col(text_col)
    pieces = F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / F.lit(float(step))) + 1
    cut = computed_once(
        docs,
        _steps=F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)),
        _count=pieces.cast("int"),
    )
    heads = F.slice("_steps", F.lit(1), F.col("_count"))
    tails = F.slice("_steps", F.lit(2), F.col("_count"))
    joined = F.zip_with(
        heads, tails,
        lambda a, b: F.concat(a, F.coalesce(F.substring(b, 1, overlap), F.lit(""))),
    )
    return cut.select(*kept, F.posexplode(joined).alias(number, text_col))


def parent_child_chunks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parent chunks of the documents, and the child chunks of those parents."""
    parents = chunk(docs)
    return parents, chunk(parents, CHILD_SIZE, CHILD_OVERLAP, number="child_no")


def embed(df: DataFrame, fn: Callable, text_col: str = "text", batch_size: int = 5) -> DataFrame:
    """`df` with an `embedding` column from `fn`, a function of a list of texts."""
    schema = T.StructType(df.schema.fields + [
        T.StructField("embedding", T.ArrayType(T.FloatType()))
    ])

    def run(frames):
        for frame in frames:
            vectors = []
            texts = frame[text_col].tolist()
            for start in range(0, len(texts), batch_size):
                vectors.extend(fn(texts[start:start + batch_size]))
            yield frame.assign(embedding=pd.Series(list(vectors), index=frame.index, dtype=object))

    return df.mapInPandas(run, schema)


def hashed_embedding(df: DataFrame, text_col: str = "text", dim: int = 256) -> DataFrame:
    """`df` with unit-length hashed word counts as `embedding`: the built-in default, JVM only."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    counted = HashingTF(numFeatures=dim, inputCol="_tokens", outputCol="_tf").transform(
        df.withColumn("_tokens", tx.tokens(F.col(text_col)))
    )
    unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(counted)
    vector = vector_to_array("_unit", "float32")
    return unit.select(*df.columns, vector.alias("embedding"))


def _names(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _leading(costs: np.ndarray) -> np.ndarray:
    """Costs rounded to their leading bits, whatever their size."""
    half, mask = 1 << (LAST_BITS - 1), ~((1 << LAST_BITS) - 1)
    whole = np.ascontiguousarray(costs, dtype=np.float64)
    rounded = ((whole.view(np.int64) + half) & mask).view(np.float64)
    return np.where(np.isfinite(whole), rounded, whole)


def scan_best(corpus: DataFrame, keys: list[str], query_ids: list, query_type: T.DataType, k: int,
               costs: Callable) -> DataFrame:
    """(query_id, keys, cost): each task's k cheapest rows per query, ties by key.

    `costs(frame)` gives the matrix rows x queries, with infinity where a row is no candidate.
    """
    schema = T.StructType([
        T.StructField("query_id", query_type),
        *[T.StructField(name, corpus.schema[name].dataType) for name in keys],
        T.StructField("cost", T.DoubleType()),
    ])

    def best_of(rows):
        ordered = rows.sort_values(["query_id", "cost", *keys], kind="stable")
        return ordered.groupby("query_id", sort=False).head(k)

    def run(frames):
        best = None
        for frame in frames:
            for start in range(0, len(frame), 1024):
                part = frame.iloc[start:start + 1024]
                matrix = _leading(costs(part))
                if len(part) > k:
                    limit = np.partition(matrix, k - 1, axis=0)[k - 1]
                else:
                    limit = np.full(matrix.shape[1], np.inf)
                row, query = np.nonzero((matrix <= limit) & np.isfinite(matrix))
                found = part[keys].iloc[row].assign(query_id=query, cost=matrix[row, query])
                best = best_of(found if best is None else pd.concat([best, found]))
        if best is not None and len(best):
            named = best.assign(query_id=[query_ids[i] for i in best["query_id"]])
            yield named[["query_id", *keys, "cost"]]

    return corpus.mapInPandas(run, schema)


def ranked(best: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of the tasks' lists, which hold at most k rows per query and task.

    Lists of many tasks are first cut in groups by hash, so that a search with few queries over many
    tasks does not end in as few tasks as there are queries.
    """
    group = F.pmod(F.xxhash64(*keys), F.lit(MERGE_GROUPS))
    within = Window.partitionBy("query_id", "_group").orderBy("cost", *keys)
    some = best.withColumn("_group", group).withColumn("hit_rank", F.row_number().over(within))
    window = Window.partitionBy("query_id").orderBy("cost", *keys)
    cut = some.filter(F.col("hit_rank") <= k).drop("_group", "hit_rank")
    numbered = cut.withColumn("hit_rank", F.row_number().over(window))
    return numbered.filter(F.col("hit_rank") <= k)


def no_hits(queries: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """The empty result of a block without queries or without words."""
    schema = T.StructType([
        queries.schema["query_id"],
        *[corpus.schema[name] for name in keys],
        T.StructField("cost", T.DoubleType()),
        T.StructField("hit_rank", T.IntegerType()),
    ])
    return queries.sparkSession.createDataFrame([], schema)


def vector_topk(queries: DataFrame, corpus: DataFrame, key: str | list[str] = "vec_id",
                k: int = TOP_K) -> DataFrame:
    """The k nearest vectors of each query (query_id, embedding) by squared distance."""
    keys = _names(key)

    def one_pass(block: DataFrame) -> DataFrame:
        held = block.select("query_id", "embedding").toArrow().to_pandas()
        if not len(held):
            return no_hits(block, corpus, keys)
        points = np.array(held["embedding"].tolist(), dtype=np.float64)
        squares = (points * points).sum(axis=1)

        def costs(part):
            rows = np.array(part["embedding"].tolist(), dtype=np.float64)
            cross = rows @ points.T
            return np.maximum((rows * rows).sum(axis=1)[:, None] + squares - 2 * cross, 0.0)

        slim = corpus.select(*keys, "embedding").filter("embedding IS NOT NULL")
        kind = block.schema["query_id"].dataType
        best = scan_best(slim, keys, held["query_id"].tolist(), kind, k, costs)
        return ranked(best, keys, k)

    parts = blocks(queries, "query_id", QUERIES_PER_PASS, F.size("embedding") * 8)
    found = reduce(DataFrame.unionByName, [one_pass(part) for part in parts])
    return found.withColumnRenamed("cost", "distance")


def document_topk(queries: DataFrame, docs: DataFrame, fn: Callable,
                  key: str | list[str] = KEY, k: int = TOP_K) -> DataFrame:
    """Whole documents nearest to each query text, both embedded by the same function.

    The embedded queries are written out, so that each is embedded once however often they are read.
    """
    return vector_topk(settle(embed(queries, fn), "queries"), embed(docs, fn), key, k)


def _known_terms(terms: list[str]) -> Callable:
    """A function from an Arrow column of word lists to (row, term number) of the words in `terms`."""

    def find(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        numbers = pc.index_in(tokens.flatten(), value_set=pa.array(terms, pa.string()))
        known = numbers.is_valid().to_numpy(zero_copy_only=False)
        lengths = tokens.value_lengths().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(tokens)), lengths)[known]
        return rows, numbers.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)

    return find


def _tokenised(docs: DataFrame, *keys: str) -> DataFrame:
    words = tx.tokens(F.col("text")).alias("tokens")
    return docs.select(*keys, words)


def counted_terms(docs: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """(keys, terms, times, length): per document its known terms, how often each occurs, and its words.

    A document is one row and is counted where it lies; documents without a known term drop out. Each task
    adds a row without terms whose length is the number of documents it has read.
    """
    find = _known_terms(terms)

    def count(batches):
        total = 0
        for batch in batches:
            tokens = batch.column(len(keys))
            rows, numbers = find(tokens)
            cells, times = np.unique(rows * len(terms) + numbers, return_counts=True)
            row, number = cells // max(len(terms), 1), cells % max(len(terms), 1)
            met, first = np.unique(row, return_index=True)
            bounds = pa.array(np.append(first, len(row)), pa.int32())
            kept = [batch.column(i).take(pa.array(met)) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([
                *kept, pa.ListArray.from_arrays(bounds, pa.array(number.astype(np.int32))),
                pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32))),
                tokens.value_lengths().cast(pa.int64()).take(pa.array(met)),
            ], schema=told)
            total += len(batch)
        nothing = [pa.nulls(1, told.field(i).type) for i in range(len(told) - 1)]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array([total], pa.int64())], schema=told)

    schema = T.StructType([
        *[T.StructField(name, docs.schema[name].dataType) for name in keys],
        T.StructField("terms", T.ArrayType(T.IntegerType())),
        T.StructField("times", T.ArrayType(T.IntegerType())),
        T.StructField("length", T.LongType()),
    ])
    told = to_arrow_schema(schema)
    return _tokenised(docs, *keys).mapInArrow(count, schema)


def tfidf_search(docs: DataFrame, queries: DataFrame, key: str | list[str] = KEY,
                 k: int = TOP_K) -> DataFrame:
    """The k best documents per query text by the sum of tf-idf weights of shared words.

    Texts are read once: a scan keeps, for every document in its own row, how often the words of the
    block's queries occur. How many documents hold each word, and every document's score, come from these
    lists. Documents are never shuffled.
    """

    keys = _names(key)

    def one_pass(block: DataFrame) -> DataFrame:
        kind = block.schema["query_id"].dataType
        pairs = block.select(
            "query_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term")
        ).toArrow().to_pandas()
        if not len(pairs):
            return no_hits(block, docs, keys)
        query_ids = sorted(pairs["query_id"].unique().tolist())
        terms = sorted(pairs["term"].unique().tolist())
        place = {term: i for i, term in enumerate(terms)}
        ordinal = {query: i for i, query in enumerate(query_ids)}
        term_no = pairs["term"].map(place).to_numpy(dtype=np.int64)
        query_no = pairs["query_id"].map(ordinal).to_numpy(dtype=np.int64)
        by_term = np.argsort(term_no, kind="stable")
        asked = query_no[by_term]
        first = np.searchsorted(term_no[by_term], np.arange(len(terms) + 1))
        width = len(query_ids)

        def costs(part):
            lists = part["terms"].tolist()
            sizes = np.array([len(x) for x in lists])
            rows = np.repeat(np.arange(len(lists)), sizes)
            numbers = np.concatenate(lists).astype(np.int64)
            times = np.concatenate(part["times"].tolist()).astype(np.float64)
            weights = (1 + np.log(times)) * idf[numbers] / np.sqrt(part["length"].to_numpy()[rows])
            spread = first[numbers + 1] - first[numbers]
            start = np.repeat(first[numbers], spread)
            within = np.arange(len(start)) - np.repeat(np.cumsum(spread) - spread, spread)
            cell = np.repeat(rows, spread) * width + asked[start + within]
            total = np.bincount(cell, np.repeat(weights, spread), len(lists) * width)
            scores = total.reshape(len(lists), width)
            return np.where(scores > 0, -scores, np.inf)

        counted = settle(counted_terms(docs, keys, terms), "terms")
        held = np.zeros(len(terms), dtype=np.int64)
        lists = counted.filter("terms IS NOT NULL")
        for number, n in lists.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            held[number] = n
        total = counted.filter("terms IS NULL").agg(F.sum("length")).first()[0]
        idf = np.log((total + 1) / (held + 1)) + 1
        return ranked(scan_best(lists, keys, query_ids, kind, k, costs), keys, k)

    parts = blocks(queries, "query_id", QUERIES_PER_PASS, F.length("text"))
    found = reduce(DataFrame.unionByName, [one_pass(part) for part in parts])
    return found.select("query_id", *keys, (-F.col("cost")).alias("score"), "hit_rank")


def parents_of_hits(hits: DataFrame, parents: DataFrame, n: int = CONTEXT_PARENTS) -> DataFrame:
    """Per query the first n distinct parents of its child hits, in rank order.

    Gives the parents' texts joined by a blank line and their call ids. `hits` holds query_id,
    hit_rank, contact_id and parent_no; it is small, and a read of it shows whether it can be
    broadcast, so that the parents' text stays where it is.
    """
    firsts = hits.groupBy("query_id", KEY, "parent_no").agg(F.min("hit_rank").alias("best"))
    window = Window.partitionBy("query_id").orderBy("best", KEY, "parent_no")
    chosen = firsts.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= n)
    found = parents.join(lookup_side(chosen), [KEY, "parent_no"])
    ordered = F.array_sort(F.collect_list(F.struct("place", KEY, "text")))
    gathered = found.groupBy("query_id").agg(ordered.alias("_parents"))
    return gathered.select(
        "query_id",
        F.array_join("_parents.text", "\n\n").alias("context"),
        F.array_join(F.col(f"_parents.{KEY}").cast("array<string>"), ",").alias("sources"),
    )

