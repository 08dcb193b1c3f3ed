"""Search results against brute force, with ties, several passes and hot groups of copies."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callsift.operators import retrieval as rt
from callsift.plans import context as cx


def cut(text, size, overlap):
    pieces, start = [], 0
    while text:
        pieces.append(text[start:start + size])
        if start + size >= len(text):
            break
        start += size - overlap
    return pieces


def test_chunks(spark):
    texts = {1: "", 2: "ab", 3: "é" * 400, 4: "x" * 401, 5: "".join(map(str, range(3000))), 6: None}
    docs = spark.createDataFrame(list(texts.items()), "contact_id long, text string")
    parents, children = rt.parent_child_chunks(docs)
    got = {}
    for r in parents.orderBy("contact_id", "parent_no").collect():
        got.setdefault(r["contact_id"], []).append(r["text"])
    assert got == {k: cut(t, 2000, 200) for k, t in texts.items() if t}
    small = {}
    for r in children.orderBy("contact_id", "parent_no", "child_no").collect():
        small.setdefault((r["contact_id"], r["parent_no"]), []).append(r["text"])
    assert small == {(k, i): cut(p, 400, 50) for k, ps in got.items() for i, p in enumerate(ps)}


@pytest.fixture(scope="module")
def vectors(spark):
    """400 points on a grid, so that many distances tie; a third of them are one point."""
    rng = np.random.default_rng(5)
    points = rng.integers(-3, 4, size=(400, 4)).astype(float)
    points[::3] = points[0]
    data = [(i, p.tolist()) for i, p in enumerate(points)]
    return points, spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(5)


@pytest.mark.parametrize("per_pass", [4096, 3])
def test_nearest_vectors(spark, vectors, monkeypatch, per_pass):
    monkeypatch.setattr(rt, "QUERIES_PER_PASS", per_pass)
    points, corpus = vectors
    asked = points[:10] + 0.5
    queries = spark.createDataFrame(
        [(i, p.tolist()) for i, p in enumerate(asked)], "query_id long, embedding array<float>")
    got = {}
    for r in rt.vector_topk(queries, corpus, k=6).orderBy("query_id", "hit_rank").collect():
        got.setdefault(r["query_id"], []).append((r["distance"], r["vec_id"]))
    for q, p in enumerate(asked):
        costs = sorted((float(((p - v) ** 2).sum()), i) for i, v in enumerate(points))
        assert got[q] == costs[:6]


def test_fewer_rows_than_asked(spark, rows):
    corpus = spark.createDataFrame([(1, [0.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [2.0])], "query_id long, embedding array<float>")
    assert rows(rt.vector_topk(queries, corpus)) == [(1, 1, 4.0, 1)]
    assert rows(rt.vector_topk(queries.filter("query_id = 2"), corpus)) == []


def test_no_queries(spark, vectors, rows):
    none = spark.createDataFrame([], "query_id long, embedding array<float>")
    assert rows(rt.vector_topk(none, vectors[1])) == []
    docs = spark.createDataFrame([(1, "a b")], "contact_id long, text string")
    asked = spark.createDataFrame([(1, "?!")], "query_id long, text string")
    assert rows(rt.tfidf_search(docs, asked)) == []
    assert rows(rt.tfidf_search(docs, asked.filter("query_id = 2"))) == []


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def brute_tfidf(docs, queries, k):
    counts = {i: Counter(words(t)) for i, t in docs.items()}
    df = Counter(w for c in counts.values() for w in c)
    found = {}
    for q, text in queries.items():
        scored = []
        for i, c in counts.items():
            terms = set(words(text)) & set(c)
            if terms:
                idf = {w: math.log((1 + len(docs)) / (1 + df[w])) + 1 for w in terms}
                total = sum((1 + math.log(c[w])) * idf[w] for w in terms)
                scored.append((-round(total / math.sqrt(sum(c.values())), 9), i))
        found[q] = [i for _, i in sorted(scored)[:k]]
    return found


@pytest.mark.parametrize("per_pass", [4096, 2])
def test_tfidf(spark, monkeypatch, per_pass):
    monkeypatch.setattr(rt, "QUERIES_PER_PASS", per_pass)
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["the"] * 20
    docs = {i: " ".join(rng.choice(vocabulary, rng.integers(1, 30))) for i in range(150)}
    docs.update({i: "the same copy of the text" for i in range(150, 225)})
    docs[225], docs[226] = "", None
    queries = {1: "the w1 w2", 2: "copy of W3!", 3: "nothing known", 4: "w5 w5 w6", 5: "the"}
    corpus = spark.createDataFrame(list(docs.items()), "contact_id long, text string").repartition(6)
    asked = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    got = {q: [] for q in queries}
    for r in rt.tfidf_search(corpus, asked, k=5).orderBy("query_id", "hit_rank").collect():
        got[r["query_id"]].append(r["contact_id"])
    assert got == brute_tfidf(docs, queries, 5)


def test_parents_in_rank_order(spark, rows):
    hits = spark.createDataFrame(
        [(1, 1, 7, 0), (1, 2, 9, 1), (1, 3, 7, 0), (1, 4, 7, 1), (1, 5, 8, 0), (2, 1, 8, 0)],
        "query_id long, hit_rank int, contact_id long, parent_no int")
    parents = spark.createDataFrame(
        [(7, 0, "a"), (7, 1, "b"), (8, 0, "c"), (9, 1, "d"), (9, 0, "e")],
        "contact_id long, parent_no int, text string")
    assert rows(rt.parents_of_hits(hits, parents)) == [
        (1, "a\n\nd\n\nb", "7,9,7"), (2, "c", "8")]


def test_context_finds_the_passage(spark):
    filler = "lorem ipsum dolor " * 300
    docs = spark.createDataFrame(
        [(1, filler), (2, filler + " bitlocker recovery key " + filler)],
        "contact_id long, text string")
    queries = spark.createDataFrame([(5, "bitlocker key")], "query_id long, text string")
    row = cx.contexts(docs, queries).first()
    assert "bitlocker recovery key" in row["context"].split("\n\n")[0]
    assert row["sources"].split(",")[0] == "2"


def test_embedding_hooks(spark):
    def sizes(texts):
        assert len(texts) <= 2
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 8)], "contact_id long, text string")
    got = rt.embed(df, sizes, batch_size=2).collect()
    assert all(r["embedding"] == [float(r["contact_id"])] for r in got)
    hashed = rt.hashed_embedding(df, dim=16).select(
        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") ** 2))
    assert all(abs(r[0] - 1) < 1e-6 for r in hashed.collect())
    near = rt.document_topk(
        df.select(F.col("contact_id").alias("query_id"), "text"), df, lambda t: [[float(len(x))] for x in t], k=1)
    assert all(r["query_id"] == r["contact_id"] for r in near.collect())


def test_small_distances_are_told_apart(spark, rows):
    corpus = spark.createDataFrame([(1, [3e-6]), (2, [1e-6]), (3, [2e-6])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [0.0])], "query_id long, embedding array<double>")
    hits = rt.vector_topk(queries, corpus, k=2)
    assert rows(hits, "vec_id", "hit_rank") == [(2, 1), (3, 2)]


def test_each_text_is_embedded_once(spark, monkeypatch):
    monkeypatch.setattr(rt, "QUERIES_PER_PASS", 5)
    seen = spark.sparkContext.accumulator(0)

    def sizes(texts):
        seen.add(len(texts))
        return [[float(len(t))] for t in texts]

    docs = spark.createDataFrame([(i, "x" * i) for i in range(1, 31)], "contact_id long, text string")
    queries = docs.filter("contact_id <= 4").withColumnRenamed("contact_id", "query_id")
    rt.document_topk(queries, docs, sizes, k=1).collect()
    assert seen.value == 34


def test_context_by_vectors(spark):
    docs = spark.createDataFrame(
        [(1, "a" * 3000), (2, "b" * 500), (3, None)], "contact_id long, text string")
    queries = spark.createDataFrame([(5, "bbb")], "query_id long, text string")

    def share(texts):
        return [[t.count("a") / len(t), t.count("b") / len(t)] for t in texts]

    row = cx.contexts(docs, queries, k=2, embed=share).first()
    assert row["context"] == "b" * 500 and row["sources"] == "2"
