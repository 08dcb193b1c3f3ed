import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import AWKWARD, awkward, empty, prose

from callsift.llm import toxicity as tx
from pyspark.sql import functions as F

SAID = {"you": "target", "not": "negation", "said": "report"}


def brute(words, weights):
    """Score of a clause by its definition, cue by cue, without machines."""
    total, negated, targeted, reported = 0.0, 0, 0, False
    for word in words:
        if word in weights:
            factor = (tx.NEGATED if negated else 1) * (tx.REPORTED if reported else 1)
            total += weights[word] * factor * (tx.TARGETED if targeted else 1)
        negated, targeted = max(0, negated - 1), max(0, targeted - 1)
        kind = SAID.get(word)
        negated = tx.SCOPE if kind == "negation" else negated
        targeted = tx.SCOPE if kind == "target" else targeted
        reported = reported or kind == "report"
    return total


WEIGHTS = {"idiot": 3.0, "kill": 2.5}
MODEL = tx.Model({w + tx.WHOLE: v for w, v in WEIGHTS.items()})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("a on you not said idiot kill idiots".split()), max_size=14))
def test_composed_machine_is_its_parts(words):
    score, entries = MODEL.walked(" ".join(words))
    assert score == pytest.approx(brute(words, WEIGHTS))
    assert len(entries) == sum(w in WEIGHTS for w in words)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="idot .\n!éİ", max_size=60))
def test_matched_clauses_are_those_with_an_entry(text):
    low = text.lower()
    want, at = [], 0
    for mark in [*tx.CLAUSE_END.finditer(low), None]:
        stop = mark.start() if mark else len(low)
        score, entries = MODEL.walked(low[at:stop])
        if entries:
            want.append((at, stop, score, entries))
        at = mark.end() if mark else stop
    assert MODEL.clauses(text) == want


def test_factors():
    def score(text):
        return MODEL.walked(text)[0]

    assert score("you idiot") > score("an idiot") > score("she said an idiot") > score("not an idiot") > 0
    assert MODEL.clauses("You idiot. He is not. Said: kill")[0][2] == pytest.approx(3.9)


def corpus(spark, n=900):
    """Prose in which two invented stems and one word mark toxic texts; clean ones hold them by mistake."""
    pick, docs, labels = random.Random(4), [], []
    for i in range(n):
        words = prose(i, 60 + i % 40).split()
        toxic = i % 6 == 0
        for _ in range(pick.randrange(2, 6) if toxic else 0):
            bad = pick.choice(["zorb" + pick.choice(["a", "ik", "enu"]), "quex" + pick.choice("aeo"), "scum"])
            words.insert(pick.randrange(len(words)), bad)
        if i % 97 == 1:
            words.insert(3, "zorbek")
        docs.append((i, " ".join(words)))
        labels.append((i, i % 2, int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality long, toxic long"))


def test_learns_stems_and_judges_the_held_out(spark):
    docs, labels = corpus(spark)
    fold = tx.held_out(F.col("doc_id"))
    model = tx.train(docs.filter(~fold), labels.filter(~fold))
    assert {"zorb", "quex", "scum$"} <= set(model.lexicon)
    judged = tx.scored(docs, model).join(labels, "doc_id").filter(fold).collect()
    assert len(judged) > 200
    assert all((r["score"] >= 0.7) == bool(r["toxic"]) for r in judged)
    again = tx.train(docs.repartition(5).filter(~fold), labels.repartition(3).filter(~fold))
    assert again.lexicon == model.lexicon
    assert np.allclose(again.curve, model.curve)


def test_near_copies_do_not_make_words_toxic(spark):
    docs, labels = corpus(spark)
    copied = prose(77_777, 80).split()
    extra = []
    for i in range(400):
        words = list(copied)
        words[random.Random(i).randrange(80)] = f"odd{i}"
        extra.append((10_000 + i, " ".join([*words, "scum", "zorba"]) + "."))
    more = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    told = labels.unionByName(spark.createDataFrame([(i, 1, 1) for i, _ in extra], labels.schema))
    model = tx.train(more, told)
    plain = {w for w in copied}
    assert not [e for e in model.lexicon if e.removesuffix(tx.WHOLE) in plain]


def test_without_labels_the_given_words_decide(spark):
    docs, labels = corpus(spark, 60)
    for few in (labels.limit(0), labels.filter("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("long"))):
        assert tx.train(docs, few) == tx.Model()
    said = spark.createDataFrame([(1, "You worthless idiot, you scum."), (2, "a fine day")],
                                 "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in tx.scored(said, tx.Model()).collect()}
    assert got[1] > 0.5 > got[2]


def test_awkward_rows(spark):
    docs, labels = corpus(spark, 120)
    labels = labels.unionByName(spark.createDataFrame(
        [(None, 1, 1), (1, None, None), (99_999, 1, 1), (5, 0, 1)], labels.schema))
    model = tx.train(docs, labels)
    got = tx.scored(awkward(spark), model).collect()
    assert len(got) == len(AWKWARD) + 3
    assert all(0 <= r["score"] <= 1 for r in got)
    nothing = model.score([0.0] * 5)
    assert {r["score"] for r in got if r["doc_id"] in (0, 1, 2)} == {nothing}
    assert tx.scored(empty(spark), model).count() == 0
    assert tx.matched_clauses(empty(spark), model).count() == 0
    found = tx.matched_clauses(docs.filter("doc_id < 13"), tx.Model({"scum$": 2.0})).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all("scum" in texts[r["doc_id"]][r["start"] : r["end"]] for r in found)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no sample tables")
def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    fold = tx.held_out(F.col("doc_id"))
    model = tx.train(docs.filter(~fold), labels.filter(~fold))
    judged = tx.scored(docs, model).join(labels, "doc_id").filter(fold).collect()
    caught = [r["score"] >= 0.7 for r in judged if r["toxic"] == 1]
    clean = [r["score"] < 0.7 for r in judged if r["toxic"] == 0]
    # Some labels of this table contradict the texts, so not all toxic ones can be told.
    assert sum(caught) > 0.8 * len(caught) and sum(clean) > 0.995 * len(clean)
