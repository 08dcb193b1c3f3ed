"""Features and models on small fixtures."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from callsift.operators import features as ft
from callsift.operators import rollups as ru
from callsift.operators import training as tr


@pytest.fixture(scope="module")
def training(spark):
    """60 calls whose words tell the issue and whose score tells the resolution."""
    issues = ["Billing", "Account Access", "Technical Issue"]
    talk = ["invoice charge refund", "password login locked", "printer crash reboot"]
    outcomes = ["Resolved", "Escalated", "Unresolved", "Abandoned"]
    data = []
    for i in range(60):
        data.append((
            i, f"please {talk[i % 3]}", f"about {talk[i % 3]} today" if i else None,
            10 + i % 3, 20, 0.3, None if i % 10 == 0 else f"Camp {i % 2}", 300.0 + i % 5, 200.0,
            5.0, 0.0, i % 2, 30.0, False, i % 2 == 0, "1" if i % 2 else None, False,
            float(20 * (i % 4)) + 1, "Positive", "Neutral" if i % 2 else None, issues[i % 3],
            outcomes[i % 4]))
    return spark.createDataFrame(
        data, "contact_id long, agent_text string, customer_text string, agent_word_count long, "
        "customer_word_count long, talk_ratio double, campaign_name string, "
        "total_duration_sec double, agent_seconds double, in_queue_seconds double, "
        "hold_seconds double, hold_count int, acw_seconds double, is_abandoned boolean, "
        "is_outbound boolean, service_level_flag string, is_simulated boolean, "
        "overall_score double, sentiment_agent string, sentiment_customer string, "
        "issue_category string, resolution string")


def brute_tfidf(texts, stop):
    def grams(t):
        kept = [w for w in re.findall(r"(?u)\b\w\w+\b", t.lower()) if w not in stop]
        return Counter(kept + [f"{a} {b}" for a, b in zip(kept, kept[1:], strict=False)])

    counts = [grams(t) for t in texts]
    df = Counter(g for c in counts for g in c)
    out = []
    for c in counts:
        w = {g: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        out.append(sorted(round(x / norm, 6) for x in w.values()))
    return out


def test_text_weights(spark):
    texts = ["The printer is on fire, printer!", "login login login failed", "the of and", "fire drill login"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, combined_text string")
    fitted = Pipeline(stages=ft.text_stages()).fit(df).transform(df).orderBy("id")
    got = [sorted(round(x, 6) for x in r[0] if x) for r in fitted.select(vector_to_array("text_vec")).collect()]
    assert got == brute_tfidf(texts, {"the", "is", "on", "of", "and"})


@pytest.mark.parametrize("room", [10_000, 60, 12])
def test_frequent_terms_with_any_room(spark, room):
    """The same terms as counting all, ties included, also where summaries lose counts and are widened."""
    pick = random.Random(6)
    names = [f"t{i:03}" for i in range(400)]
    lists = [pick.choices(names, [1 / (1 + i // 5) for i in range(400)], k=pick.randint(0, 60)) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in [*lists, []]], "terms array<string>").repartition(5)
    counts = Counter(t for x in lists for t in x)
    for size in (5, 40, 1000):
        want = [t for t, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]
        assert ft.frequent_terms(df, size, room) == want
    assert ft.frequent_terms(df.limit(0), 5, room) == []


def test_too_many_values_are_no_category(spark, monkeypatch):
    monkeypatch.setattr(ft, "MOST_VALUES", 3)
    df = spark.createDataFrame([(x,) for x in "abcd"], "campaign_name string")
    with pytest.raises(ValueError, match="more than 3"):
        ft.label_stage("campaign_name").fit(df)
    assert ft.label_stage("campaign_name").fit(df.filter("campaign_name <> 'd'")).labels == ["a", "b", "c"]


def test_a_save_that_fails_leaves_the_last_model(spark, training, tmp_path, monkeypatch):
    path, model = str(tmp_path / "m"), tr.train_resolution(training, trees=2)
    assert tr.save(model, path, {"trained_on": 1}) == 1
    monkeypatch.setattr(tr.json, "dumps", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        tr.save(model, path, {"trained_on": 2})
    monkeypatch.undo()
    assert tr.load(spark, path)[1]["trained_on"] == 1
    assert tr.save(model, path, {"trained_on": 3}) == 2
    assert tr.load(spark, path)[1]["trained_on"] == 3


def test_unseen_category_is_all_zero(spark):
    seen = spark.createDataFrame([("b",), ("a",)], "campaign_name string")
    model = Pipeline(stages=ft.onehot_stages()).fit(seen)
    new = spark.createDataFrame([("a",), ("b",), ("c",)], "campaign_name string")
    got = [list(r[0]) for r in model.transform(new).select(vector_to_array("campaign_name_vec")).collect()]
    assert got == [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]


def test_defaults_and_frames(training):
    first = ft.issue_frame(training).orderBy("contact_id").first()
    assert first["campaign_name"] == "Unknown" and first["combined_text"] == " please invoice charge refund"
    frame = ft.resolution_frame(training)
    assert frame.count() == 45
    unknown = training.withColumn("resolution", F.when(F.col("contact_id") > 5, F.col("resolution")))
    assert ft.resolution_frame(unknown).filter("resolution IS NULL").count() == 6
    row = frame.filter("contact_id = 1").first()
    assert (row["sla_met"], row["issue_num"], row["sentiment_customer_num"]) == (1.0, 1.0, 1.0)


def test_abandoned_filter_keeps_unknown(spark, rows):
    df = spark.createDataFrame([("Abandoned",), ("Resolved",), (None,)], "resolution string")
    assert rows(ft.not_abandoned(df)) == [("Resolved",), (None,)]


def test_standard_scale(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "a double, b double")
    got = [tuple(r) for r in ft.standard_scale(df, ["a", "b"]).collect()]
    spread = math.sqrt(14 / 3)
    assert [round(a, 9) for a, _ in got] == [round((v - 3) / spread, 9) for v in (1, 2, 6)]
    assert [b for _, b in got] == [0.0, 0.0, 0.0]
    tiny = spark.createDataFrame([(0.0001, 2e13), (0.0003, 4e13)], "a double, b double")
    got = [tuple(round(x, 6) for x in r) for r in ft.standard_scale(tiny, ["a", "b"]).collect()]
    assert sorted(got) == [(-1.0, -1.0), (1.0, 1.0)]
    assert ft.standard_scale(tiny.limit(0), ["a"]).count() == 0


def test_class_weights(spark, rows):
    df = spark.createDataFrame([("a",)] * 3 + [("b",), (None,)], "label string")
    assert rows(ft.class_weights(df, "label")) == [("a", 4 / 6), ("b", 4 / 2)]
    assert ft.balanced_weights(df, "label").agg(F.sum("class_weight")).first()[0] == pytest.approx(4)


def test_issue_model_round_trip(spark, training, tmp_path):
    model = tr.train_issue(training, max_iter=100)
    frame = ft.issue_frame(training)
    told = tr.predict(model, frame, "issue_category")
    assert told.filter("correct").count() == 60
    assert told.filter(~F.col("confidence").rlike(r"^\d+%$")).count() == 0
    tr.save(model, str(tmp_path / "m"), {"trained_on": 60})
    loaded, meta = tr.load(spark, str(tmp_path / "m"))
    assert meta == {"trained_on": 60, "labels": ["Account Access", "Billing", "Technical Issue"]}
    assert tr.predict(loaded, frame, "issue_category").exceptAll(told).count() == 0


def test_resolution_model(training):
    model = tr.train_resolution(training, trees=5)
    told = tr.predict_resolution(model, training)
    assert told.columns == ["contact_id", "actual_resolution", "predicted_resolution", "correct",
                            "confidence", "overall_score"]
    assert told.filter("correct").count() == 45
    assert told.select("predicted_resolution").distinct().count() == 3


def test_every_call_is_predicted(spark, training):
    """Calls without a label and with one not seen in training are predicted like the others."""
    model = tr.train_issue(training.filter("contact_id < 50"), max_iter=50)
    relabelled = training.withColumn("issue_category", F.when(F.col("contact_id") >= 50, F.when(
        F.col("contact_id") % 2 == 0, "Never seen")).otherwise(F.col("issue_category")))
    told = {r["contact_id"]: r for r in tr.predict_issue(model, relabelled).collect()}
    assert len(told) == 60 and all(r["predicted"] for r in told.values())
    assert told[51]["correct"] is None and told[52]["correct"] is False and told[1]["correct"] is True
    assert tr.predict_issue(model, relabelled.limit(0)).count() == 0
    assert tr.predict_issue(model, relabelled.filter("contact_id = 52")).count() == 1


def test_predictions_go_into_the_summary(spark, training, rows):
    issues = tr.predict_issue(tr.train_issue(training, max_iter=30), training.filter("contact_id < 3"))
    found = tr.predict_resolution(tr.train_resolution(training, trees=2), training.filter("contact_id < 3"))
    stored = training.select("contact_id", F.lit("old").alias("pred_issue_category")).filter("contact_id in (1, 9)")
    table = tr.with_predictions(stored, issues, found)
    assert rows(table) == [(1, "Account Access", "Escalated"), (9, "old", None)]
    meta = tr.model_meta(tr.train_resolution(training, trees=2), training, "resolution")
    assert meta["labels"] == ["Escalated", "Resolved", "Unresolved"] and meta["trained_on"] == 45


def test_accuracy_predicts_every_row_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, "a")], "actual string, predicted string")
    told = ru.accuracy(rows.mapInArrow(count, rows.schema), "actual", "predicted").collect()
    assert sorted((r["actual"], r["predicted"], r["n"]) for r in told) == [("a", "a", 1), ("a", "b", 1), ("b", "b", 1)]
    assert seen.value == 4
