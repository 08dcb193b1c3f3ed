import random

import numpy as np
from llm_data import AWKWARD, awkward, empty
from pyspark.sql import functions as F

from callsift.llm import langid

SOUNDS = {"aa": "ka lo mi ne ru".split(), "bb": "sch ung eit ver ich".split(),
          "cc": "tion ing the ed ou".split()}


def corpus(n=300):
    pick = random.Random(5)
    out = []
    for i in range(n):
        lang = pick.choice(list(SOUNDS))
        words = ["".join(pick.choices(SOUNDS[lang], k=3)) for _ in range(pick.randint(3, 60))]
        out.append((i, " ".join(words), lang, "s", 1.0))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")


def test_held_out_accuracy_and_calibration(spark):
    docs = frame(spark, corpus())
    fold = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.filter(~fold).select("doc_id", "text", F.col("lang").alias("label")))
    assert model.labels == ["aa", "bb", "cc"] and (model.weights == 0).mean() > 0.5
    got = langid.with_language(docs, model).filter(fold)
    assert got.columns == docs.columns and got.count() > 40
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0


def test_awkward_texts(spark):
    docs = frame(spark, corpus(90))
    model = langid.train(docs.select("doc_id", "text", F.col("lang").alias("label")))
    rows = langid.with_language(awkward(spark), model).collect()
    assert len(rows) == len(AWKWARD) + 3
    for r in rows:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in model.labels and 0 <= r["score"] <= 1


def test_nothing_to_learn_from(spark):
    none = frame(spark, corpus(20)).withColumn("lang", F.lit(None).cast("string"))
    model = langid.train(none.select("doc_id", "text", F.col("lang").alias("label")))
    assert {r["lang_pred"] for r in langid.with_language(none, model).collect()} == {"und"}
    assert langid.with_language(empty(spark), model).count() == 0


def test_the_sample_is_bounded_and_fair(spark):
    rows = [(i, f"text {i}", "hot" if i % 10 else "seldom") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = langid.sampled(docs, per_label=50, most=80).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {"hot": 40, "seldom": 40}


def test_counts_cover_whole_texts():
    text = "ab Cd" * 300_000 + " zq"
    whole = langid.gram_counts(text)
    old = langid.SLICE
    try:
        langid.SLICE = 1000
        assert (langid.gram_counts(text) == whole).all()
    finally:
        langid.SLICE = old
    assert whole.sum() > 3 * 1_200_000
    assert not (langid.gram_counts(text[:-3]) == whole).all()


def test_document_frequencies_count_all_rows(spark):
    docs = frame(spark, corpus(60))
    counted, n = langid.document_frequencies(docs)
    want = sum((langid.gram_counts(r["text"]) > 0).astype(int) for r in docs.collect())
    assert n == 60 and (counted == want).all()


def test_temperature_lowers_the_loss():
    pick = np.random.Generator(np.random.PCG64(2))
    labels = pick.integers(0, 3, 4000)
    logits = pick.normal(size=(4000, 3))
    logits[np.arange(4000), labels] += 1.5
    fitted = langid.fit_temperature(logits, labels)
    assert 0.4 < fitted < 2
    assert abs(langid.fit_temperature(logits * 8, labels) / fitted - 8) < 0.01


def test_strong_penalty_leaves_few_weights():
    pick = np.random.Generator(np.random.PCG64(2))
    rows = [(np.append(pick.integers(0, 500, 20), langid.BUCKETS), np.ones(21) / 5, int(pick.integers(0, 2)))
            for _ in range(100)]
    loose = langid.follow_leader(rows, 2, l1=0.0)
    strict = langid.follow_leader(rows, 2, l1=2.0)
    assert (strict != 0).sum() < (loose != 0).sum() / 3


def test_repeated_rows_are_sampled_once(spark):
    rows = [(None, "the same text", "hot")] * 4000 + [(i, f"text {i}", "seldom") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = langid.sampled(docs, per_label=100, most=langid.MOST_ROWS).groupBy("label").count().collect()
    counts = {r["label"]: r["count"] for r in got}
    assert counts["hot"] == 1 and 50 <= counts["seldom"] <= 100
    model = langid.train(docs)
    assert model.labels == ["hot", "seldom"]


def test_the_sample_has_its_full_size(spark):
    rows = [(i, f"text {i}", f"label{i % 2}") for i in range(40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = langid.sampled(docs, langid.PER_LABEL, langid.MOST_ROWS).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {"label0": 600, "label1": 600}
