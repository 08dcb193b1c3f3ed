"""A stored inverted index: words to the documents that hold them, added to in segments.

    path/segments            the published list of segments and their numbers of documents
    path/keys/segment=S      the keys of a segment's documents
    path/postings/segment=S/bucket=B    (term, part, best, n, entries)
    path/heads/segment=S/bucket=B       the same without entries

A term's bucket comes from its hash, so a search opens the folders of its own terms only. A segment's
documents are dealt into parts of about PART_DOCS by the hash of their key; a posting row holds the
entries of one term in one part, as lists of keys and weights, with the largest weight among them. Rows are
bounded by the size of a part, however frequent the term.

A search first reads the heads of its terms. Per query and part the sum of the largest weights is a bound
of every score there. The parts with the highest bounds are scored first, and their k-th best score is what
a part's bound must reach: all others are skipped with their postings. All words of a document lie in the
same part, so scores are whole, and the result is exact; they are added up where the part's postings are, and only
its k best documents per query go further. Weights are summed in whole 2^-40, which makes
scores independent of the order of tasks.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from callsift.functions import text as tx
from callsift.operators.retrieval import QUERIES_PER_PASS, TOP_K, ranked
from callsift.plans.sizing import blocks, lookup_side
from callsift.schemas import flat
from callsift.session import settle
from callsift.sources import sinks

BUCKETS = 256
PART_DOCS = 4_096
FIRST_PARTS = 4  # per query, scored before any bound is known
UNIT = float(1 << 40)
SEGMENTS = flat("segment INT, n_docs BIGINT")


def _bucket(term: str) -> Column:
    return F.pmod(F.hash(term), F.lit(BUCKETS)).alias("bucket")


def segments(spark: SparkSession, path: str) -> dict[int, int]:
    """The segments of the index and how many documents each holds."""
    listed = sinks.read_published(spark, f"{path}/segments", SEGMENTS)
    return {r["segment"]: r["n_docs"] for r in listed.collect()}


def _grouped_by(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each of the codes 0 to n - 1 begins in the sorted codes, and their end."""
    return np.searchsorted(codes, np.arange(n + 1))


def _entries_type(key_fields: list) -> T.StructType:
    """One list per key column and one of weights, of equal length."""
    weights = T.StructField("weight", T.DoubleType())
    return T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in [*key_fields, weights]])


def _postings(docs: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """(bucket, term, part, best, n, entries): every word of every document once, with
    (1 + ln times) / sqrt(length).

    Texts are dealt out by part, and all postings of a part are made where its texts are, so words are not
    shuffled one by one.
    """
    entries = _entries_type([docs.schema[c] for c in keys])
    schema = T.StructType([*flat("term STRING, part INT, best DOUBLE, n BIGINT").fields,
                           T.StructField("entries", entries)])
    told = to_arrow_schema(schema)

    def build(part: tuple, rows: pa.Table) -> pa.Table:
        tokens = rows.column("tokens").combine_chunks()
        lengths = tokens.value_lengths().to_numpy(zero_copy_only=False)
        words = tokens.flatten().dictionary_encode()
        n = len(words.dictionary)
        at_row = np.repeat(np.arange(len(rows)), lengths)
        cells, times = np.unique(
            words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(len(rows), 1) + at_row,
            return_counts=True)
        word, at = np.divmod(cells, max(len(rows), 1))
        weights = (1 + np.log(times)) / np.sqrt(lengths[at])
        first = _grouped_by(word, n)
        bounds, order = pa.array(first.astype(np.int32)), pa.array(at)
        lists = [pa.ListArray.from_arrays(bounds, rows.column(c).combine_chunks().take(order)) for c in keys]
        lists.append(pa.ListArray.from_arrays(bounds, pa.array(weights)))
        best = np.maximum.reduceat(weights, first[:-1]) if n else np.zeros(0)
        held = pa.StructArray.from_arrays(lists, names=[*keys, "weight"])
        return pa.table([
            words.dictionary, pa.array(np.full(n, part[0].as_py(), dtype=np.int32)), pa.array(best),
            pa.array(np.diff(first)), held.cast(told.field("entries").type),
        ], schema=told)

    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("part")
    dealt = docs.select(*keys, part, "text").repartition("part")
    tokens = dealt.select(*keys, "part", tx.tokens(F.col("text")).alias("tokens"))
    made = tokens.groupBy("part").applyInArrow(build, schema)
    return made.select(_bucket("term"), *schema.names)


def append(docs: DataFrame, path: str, key: str | list[str]) -> int:
    """Add (key, text) documents to the index as its next segment; returns the segment's number.

    Documents whose key is in the index already are left out. The segment counts once the list of segments
    is published, last of all; a run that failed before that is written over by the next one.
    """
    spark, keys = docs.sparkSession, [key] if isinstance(key, str) else list(key)
    held = segments(spark, path)
    number = max(held, default=0) + 1
    new = docs.select(*keys, "text")
    if held:
        stored = _segments_of(spark, f"{path}/keys", sorted(held), new.select(*keys).schema)
        new = new.join(stored.select(*keys).distinct(), keys, "left_anti")
    kept = f"{path}/keys/segment={number}"
    new.select(*keys).write.mode("overwrite").parquet(kept)
    n_docs = spark.read.schema(new.select(*keys).schema).parquet(kept).count()
    parts = max(1, math.ceil(n_docs / PART_DOCS))
    postings = _postings(new, keys, parts)
    out = f"{path}/postings/segment={number}"
    _by_bucket(postings).write.mode("overwrite").partitionBy("bucket").parquet(out)
    heads = spark.read.schema(postings.drop("entries").schema).parquet(out)
    _by_bucket(heads).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/heads/segment={number}")
    listed = sorted({**held, number: n_docs}.items())
    sinks.publish(spark.createDataFrame(listed, SEGMENTS).coalesce(1), f"{path}/segments")
    return number


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "part")


def _segments_of(spark: SparkSession, path: str, numbers: list[int], schema: T.StructType) -> DataFrame:
    """The rows of the listed segments, with `segment`; folders that no list names are not read."""
    wide = T.StructType([*schema.fields, T.StructField("segment", T.IntegerType())])
    paths = [f"{path}/segment={n}" for n in numbers]
    return spark.read.schema(wide).option("basePath", path).parquet(*paths)


def _term_rows(spark: SparkSession, path: str, name: str, numbers: list[int], buckets: list[int],
               entries: T.StructType | None = None) -> DataFrame:
    """Heads or postings in the folders of the given buckets."""
    fields = flat("term STRING, part INT, best DOUBLE, n BIGINT").fields
    more = [T.StructField("entries", entries)] if entries else []
    schema = T.StructType([*fields, *more, T.StructField("bucket", T.IntegerType())])
    rows = _segments_of(spark, f"{path}/{name}", numbers, schema)
    return rows.filter(F.col("bucket").isin(buckets))


def search(queries: DataFrame, path: str, key: str | list[str], k: int = TOP_K) -> DataFrame:
    """(query_id, key, score, hit_rank): the k best documents of the index per (query_id, text) query, as
    `retrieval.tfidf_search` finds them by reading all texts."""
    spark, keys = queries.sparkSession, [key] if isinstance(key, str) else list(key)
    held = segments(spark, path)
    schema = T.StructType([
        queries.schema["query_id"], *_key_fields(spark, path, held, keys),
        T.StructField("score", T.DoubleType()), T.StructField("hit_rank", T.IntegerType()),
    ])

    def one_pass(block: DataFrame) -> DataFrame:
        words = block.select(
            "query_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term")
        )
        asked = settle(words, "asked")
        buckets = sorted(r["bucket"] for r in asked.select(_bucket("term")).distinct().collect())
        if not buckets or not held:
            return spark.createDataFrame([], schema)
        return _hits(asked, path, held, buckets, keys, k, schema)

    parts = blocks(queries, "query_id", QUERIES_PER_PASS, F.length("text"))
    return reduce(DataFrame.unionByName, [one_pass(part) for part in parts])


def _key_fields(spark: SparkSession, path: str, held: dict[int, int], keys: list[str]) -> list:
    """The fields of the stored keys, from any segment."""
    if not held:
        return [T.StructField(c, T.StringType()) for c in keys]
    stored = spark.read.parquet(f"{path}/keys/segment={max(held)}").schema
    return [stored[c] for c in keys]


def _scorer(weighed: DataFrame, fields: list, query_field: T.StructField, k: int):
    """The function of a part's postings and the queries that want it, to (query_id, keys, cost): per query
    the k best documents of the part, ties by key, and those without a key.

    The words of a pass's queries go to every task; scores stay in the task that adds them up.
    """
    names = [f.name for f in fields]
    told = to_arrow_schema(T.StructType([query_field, *fields, T.StructField("cost", T.LongType())]))
    words = weighed.sparkSession.sparkContext.broadcast(weighed.select("query_id", "term", "idf").toArrow())

    def best_of(postings: pa.Table, pairs: pa.Table) -> pa.Table:
        if not len(postings) or not len(pairs):
            return told.empty_table()
        held = [pa.chunked_array([c.field(i) for c in postings.column("entries").chunks])
                for i in range(len(names) + 1)]
        sizes = pc.list_value_length(held[-1]).to_numpy()
        end = np.cumsum(sizes)
        weights = pc.list_flatten(held[-1]).to_numpy()
        columns = [pc.list_flatten(c).combine_chunks() for c in held[:-1]]
        keyed, doc = _numbered(columns, names)
        no_key = np.zeros(len(keyed), dtype=bool)
        for c in names:
            no_key |= keyed.column(c).is_null().to_numpy()
        place = {term: i for i, term in enumerate(postings.column("term").to_pylist())}
        asked = words.value
        asked = asked.filter(pc.is_in(asked.column("query_id"), pairs.column("query_id")))
        asked = asked.filter(pc.is_in(asked.column("term"), postings.column("term")))
        by_query: dict = {}
        for query, term, idf in zip(*(c.to_pylist() for c in asked.columns), strict=True):
            by_query.setdefault(query, []).append((place[term], idf))
        units: dict[int, np.ndarray] = {}
        found, total = [], np.zeros(len(keyed), dtype=np.int64)
        for query, of in by_query.items():
            total[:] = 0
            for row, idf in of:
                at = slice(end[row] - sizes[row], end[row])
                if row not in units:
                    units[row] = np.floor(weights[at] * idf * UNIT + 0.5).astype(np.int64)
                np.add.at(total, doc[at], units[row])  # a key can come twice
            met = np.flatnonzero(total)
            if len(met) > k:
                least = np.partition(total[met], len(met) - k)[len(met) - k]
                near = met[total[met] >= least]
                kept = near[np.argsort(-total[near], kind="stable")[:k]]
                met = np.union1d(kept, met[no_key[met]])
            found.append((query, met, -total[met]))
        if not found:
            return told.empty_table()
        rows = pa.array(np.concatenate([met for _, met, _ in found]))
        queries = [query for query, met, _ in found for _ in met]
        return pa.table([
            pa.array(queries, told.field("query_id").type), *[keyed.column(c).take(rows) for c in names],
            pa.array(np.concatenate([cost for _, _, cost in found])),
        ], schema=told)

    return best_of


def _numbered(columns: list[pa.Array], names: list[str]) -> tuple[pa.Table, np.ndarray]:
    """The different keys in ascending order, and the number of each row's key among them."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        coded = column.dictionary_encode(null_encoding="encode")
        code = code * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    first = np.unique(code, return_index=True)[1]
    each = pa.table([c.take(pa.array(first)) for c in columns], names=names)
    order = pc.sort_indices(
        each, sort_keys=[(c, "ascending") for c in names], null_placement="at_start").to_numpy()
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return each.take(pa.array(order)), back[code]


def _hits(asked: DataFrame, path: str, held: dict[int, int], buckets: list[int], keys: list[str], k: int,
          schema: T.StructType) -> DataFrame:
    spark, numbers = asked.sparkSession, sorted(held)
    terms = lookup_side(asked.select("term").distinct(), 1_000_000)
    heads = settle(_term_rows(spark, path, "heads", numbers, buckets).join(terms, "term", "left_semi"), "heads")
    total = F.lit(float(sum(held.values()) + 1))
    idf = (F.log(total / (F.sum("n") + 1)) + 1).alias("idf")
    weighed = settle(asked.join(heads.groupBy("term").agg(idf), "term"), "weighed")
    most = F.sum(F.ceil(F.col("best") * F.col("idf") * UNIT) + 1)
    bounds = settle(
        heads.join(lookup_side(weighed, 1_000_000), "term").groupBy("query_id", "segment", "part").agg(
            most.alias("bound")), "bounds",
    )
    fields = [schema[c] for c in keys]
    rows = _term_rows(spark, path, "postings", numbers, buckets, _entries_type(fields))
    best_of = _scorer(weighed, fields, schema["query_id"], k)

    def scored(pairs: DataFrame) -> DataFrame:
        """The k best per query in the given parts."""
        wanted = lookup_side(pairs.select("segment", "part").distinct(), 1_000_000)
        some = rows.join(terms, "term", "left_semi").join(wanted, ["segment", "part"], "left_semi")
        each = some.select("term", "segment", "part", "entries").groupBy("segment", "part").cogroup(
            pairs.select("query_id", "segment", "part").groupBy("segment", "part"))
        told = T.StructType([schema["query_id"], *fields, T.StructField("cost", T.LongType())])
        # Documents without a key can lie in several segments and count as one.
        sums = each.applyInArrow(best_of, told).groupBy("query_id", *keys).agg(F.sum("cost").alias("cost"))
        return ranked(sums, keys, k)

    order = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "part"))
    first = settle(bounds.withColumn("_n", order).filter(F.col("_n") <= FIRST_PARTS).drop("_n"), "first")
    best = settle(scored(first), "best")
    # Only where k are found already does a part have to reach the last of them.
    least = best.filter(F.col("hit_rank") == k).select("query_id", (-F.col("cost")).alias("least"))
    rest = bounds.join(first, ["query_id", "segment", "part"], "left_anti").join(
        least, "query_id", "left").filter(F.col("bound") >= F.coalesce("least", F.lit(0)))
    found = ranked(best.drop("hit_rank").unionByName(scored(rest).drop("hit_rank")), keys, k)
    return found.select("query_id", *keys, (-F.col("cost") / UNIT).alias("score"), "hit_rank")
