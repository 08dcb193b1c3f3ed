"""The stored inverted index: same hits as a search through all texts, few files, added to in steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callsift.operators import retrieval as rt
from callsift.operators import textindex as ti
from callsift.plans import context as cx


def corpus(spark, n=150):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["the"] * 20
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 30)))) for i in range(n)]
    docs += [(i, "the same copy of the text") for i in range(n, n + 75)] + [(900, ""), (901, None)]
    return spark.createDataFrame(docs, "contact_id long, text string").repartition(5)


def asked(spark):
    texts = {1: "the w1 w2", 2: "copy of W3!", 3: "nothing known", 4: "w5 w5 w6", 5: "the", 6: None, 7: "w1 w9"}
    return spark.createDataFrame(list(texts.items()), "query_id long, text string")


def hits(df):
    return sorted((r["query_id"], r["hit_rank"], r["contact_id"], round(r["score"], 8)) for r in df.collect())


@pytest.mark.parametrize("part_docs", [4096, 9])
def test_same_hits_as_the_scan(spark, tmp_path, monkeypatch, part_docs):
    monkeypatch.setattr(ti, "PART_DOCS", part_docs)
    monkeypatch.setattr(ti, "FIRST_PARTS", 1)
    docs, path = corpus(spark), str(tmp_path / "index")
    assert ti.append(docs.filter("contact_id < 100"), path, "contact_id") == 1
    assert ti.append(docs, path, "contact_id") == 2  # the first hundred are known and left out
    assert ti.segments(spark, path) == {1: 100, 2: 127}
    for k in (1, 5, 300):
        assert hits(ti.search(asked(spark), path, "contact_id", k)) == hits(
            rt.tfidf_search(docs, asked(spark), "contact_id", k))


def test_passes_of_few_queries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ti, "QUERIES_PER_PASS", 2)
    docs, path = corpus(spark, 40), str(tmp_path / "index")
    ti.append(docs, path, "contact_id")
    assert hits(ti.search(asked(spark), path, "contact_id", 3)) == hits(rt.tfidf_search(docs, asked(spark), k=3))


def test_files_read_fall_with_the_words_asked(spark, tmp_path):
    docs, path = corpus(spark), str(tmp_path / "index")
    ti.append(docs, path, "contact_id")

    def files(*terms):
        frame = spark.createDataFrame([(t,) for t in terms], "term string")
        buckets = [r["bucket"] for r in frame.select(ti._bucket("term")).distinct().collect()]
        rows = ti._term_rows(spark, path, "postings", [1], buckets)
        return rows.select("_metadata.file_path").distinct().count(), len(buckets)

    everything = files("the", "same", "copy", "of", "text", *[f"w{i}" for i in range(60)])[0]
    one, two = files("w1")[0], files("w1", "w2", "the")
    assert one == 1 and two[0] <= two[1] and everything > 30


def test_parts_that_cannot_win_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ti, "PART_DOCS", 10)
    docs = [(i, "rare " * 3 if i % 100 == 0 else f"rare {'filler ' * 40}") for i in range(500)]
    path = str(tmp_path / "index")
    ti.append(spark.createDataFrame(docs, "contact_id long, text string"), path, "contact_id")
    seen = []
    real = ti.ranked
    monkeypatch.setattr(ti, "ranked", lambda df, keys, k: seen.append(df.count()) or real(df, keys, k))
    queries = spark.createDataFrame([(1, "rare")], "query_id long, text string")
    assert [r["contact_id"] for r in ti.search(queries, path, "contact_id", 2).orderBy("hit_rank").collect()] == [0, 100]
    assert seen[0] + seen[1] < 200  # rows scored before and after the bound is known, of 500


def test_failed_append_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    docs, path = corpus(spark, 30), str(tmp_path / "index")
    ti.append(docs.filter("contact_id < 10"), path, "contact_id")
    before = hits(ti.search(asked(spark), path, "contact_id"))
    monkeypatch.setattr(ti.sinks, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        ti.append(docs, path, "contact_id")
    monkeypatch.undo()
    assert hits(ti.search(asked(spark), path, "contact_id")) == before
    ti.append(docs, path, "contact_id")
    assert sum(ti.segments(spark, path).values()) == docs.count()


def test_nothing_stored_and_nothing_asked(spark, tmp_path):
    path = str(tmp_path / "index")
    assert ti.search(asked(spark), path, "contact_id").count() == 0
    ti.append(corpus(spark).limit(0), path, "contact_id")
    assert ti.search(asked(spark), path, "contact_id").count() == 0
    ti.append(corpus(spark, 20), path, "contact_id")
    assert ti.search(asked(spark).filter("query_id = 6"), path, "contact_id").count() == 0


def test_contexts_from_the_index(spark, tmp_path):
    filler = "lorem ipsum dolor " * 300
    docs = spark.createDataFrame(
        [(1, filler), (2, filler + " bitlocker recovery key " + filler), (3, "key " * 900)],
        "contact_id long, text string")
    queries = spark.createDataFrame([(5, "bitlocker key"), (6, "dolor")], "query_id long, text string")
    path = str(tmp_path / "index")
    cx.index_chunks(docs, path)
    got, want = cx.contexts(docs, queries, index=path), cx.contexts(docs, queries)
    assert sorted(got.collect()) == sorted(want.collect())


def test_scores_stay_with_their_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ti, "PART_DOCS", 100)
    docs = spark.range(500).select(F.col("id").alias("contact_id"), F.lit("one word").alias("text"))
    path, seen = str(tmp_path / "index"), []
    ti.append(docs, path, "contact_id")
    real = ti.ranked
    monkeypatch.setattr(ti, "ranked", lambda df, keys, k: seen.append(df.count()) or real(df, keys, k))
    queries = spark.createDataFrame([(i, "word") for i in range(20)], "query_id long, text string")
    found = hits(ti.search(queries, path, "contact_id", 2))
    assert [h[:3] for h in found] == [(i, rank, rank - 1) for i in range(20) for rank in (1, 2)]
    assert seen[0] + seen[1] <= 20 * 2 * 5  # queries, hits and parts; not each document for each query


def test_keys_that_repeat_or_are_null_count_as_one_document(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red"), (1, "red blue"), (2, "red"), (None, "red"), (None, "red")],
                                 "contact_id long, text string")
    path, asks = str(tmp_path / "index"), spark.createDataFrame([(9, "red")], "query_id long, text string")
    ti.append(docs, path, "contact_id")
    got = {h["contact_id"]: (h["hit_rank"], h["score"]) for h in ti.search(asks, path, "contact_id", 5).collect()}
    unit = got[2][1]
    assert got[None] == (1, pytest.approx(2 * unit)) and got[1] == (2, pytest.approx(unit * (1 + 0.5 ** 0.5)))
    assert len(ti.search(asks, path, "contact_id", 1).collect()) == 1
