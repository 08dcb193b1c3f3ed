"""Model answers, batch inference, keyword and sentiment scores."""

import json
import os
import random
import time
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from callsift import schemas
from callsift.operators import scoring as sc
from callsift.plans.answers import answered, stored_answers
from callsift.plans.audit import audit_all, score_unscored, summarise_missing

RUN = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def rubric(spark):
    return spark.createDataFrame(
        [("r1", "S1", "A", 0.2, True, "w", "g", "b", ["Hello", "hi there"]),
         ("r2", "S1", "B", 0.3, True, "w", "g", "b", ["bye"]),
         ("r3", "S2", "A", 0.9, True, "w", "g", "b", ["zzz"]),
         ("r4", "S2", "D", 0.5, False, "w", "g", "b", ["x"])],
        "framework_id string, section_name string, criteria_name string, effective_weight double, "
        "enabled boolean, what_to_check string, good_example string, bad_example string, "
        "check_keywords array<string>")


def answers(spark, *texts):
    data = [(i, 100 + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "contact_id long, agent_id long, content string")


def test_score_answers(spark, rubric):
    good = 'Here:\n```json\n[{"criteria_name": "A", "passed": true, "reasoning": "it\'s"},' \
           ' {"section_name": "S1", "criteria_name": "B", "passed": null},' \
           ' {"criteria_name": "Z", "passed": 1}]\n```'
    responses = answers(
        spark, good, "no list", '[{"criteria_name": "A", "passed": tr]', "[1, 2]", "[]",
        '[{"criteria_name": "B", "passed": "false"}]', '[{"criteria_name": "B"}] see [1] ', None)
    scores, errors = sc.parse_scores(responses, rubric, RUN)
    got = {(r["contact_id"], r["criteria_name"]): (r["score"], r["passed"]) for r in scores.collect()}
    assert got == {(0, "A"): (0.2, True), (0, "B"): (0.0, False), (0, "Z"): (0.0, True),
                   (5, "B"): (0.3, True)}
    failed = {r["contact_id"]: r["reason"] for r in errors.collect()}
    assert failed == {1: "no array", 2: "not readable", 3: "not readable", 6: "not readable",
                      7: "no array"}
    assert scores.select("score_id").distinct().count() == 4


def test_score_ids_are_unique_and_repeatable(spark, rubric):
    verdicts = '[{"criteria_name": "A"}, {"criteria_name": "A"}, {"criteria_name": "B"}]'
    data = [(1, 7, verdicts), (1, 7, verdicts), (1, 8, verdicts), (1, 7, verdicts + " "), (None, None, verdicts)]
    responses = spark.createDataFrame(data, "contact_id long, agent_id long, content string")
    ids = sorted(r["score_id"] for r in sc.parse_scores(responses, rubric, RUN)[0].collect())
    assert len(set(ids)) == len(ids) == 15
    again = sc.parse_scores(responses.repartition(3), rubric, RUN)[0]
    assert sorted(r["score_id"] for r in again.collect()) == ids


def test_rule_without_keywords(spark, rubric, rows):
    none = rubric.withColumn("check_keywords", F.when(F.col("framework_id") != "r2", F.col("check_keywords")))
    transcripts = spark.createDataFrame([(1, "bye")], "contact_id long, agent_text string")
    got = sc.keyword_scores(transcripts, none).filter("criteria_name = 'B'")
    assert rows(got, "hits", "passed", "score") == [(0, False, 0.0)]


def test_summary_answers(spark):
    def answer(score):
        return '{"issue_category": "Billing", "ai_recot": "r"' + score + "}"

    responses = answers(
        spark, answer(""), answer(', "overall_score": 7.9'), answer(', "overall_score": " 8 "'),
        answer(', "overall_score": "7.5"'), answer(', "overall_score": null'),
        answer(', "overall_score": true'), "text", "{broken}", answer(', "overall_score": -0.5'))
    read, errors = sc.parse_summaries(responses)
    got = {r["contact_id"]: r["overall_score"] for r in read.collect()}
    assert got == {0: 5, 1: 7, 2: 8, 5: 1, 8: 0}
    assert {r["contact_id"] for r in errors.collect()} == {3, 4, 6, 7}
    row = read.filter("contact_id = 0").first()
    assert (row["issue_category"], row["ai_recommendation"], row["resolution"]) == ("Billing", "r", None)


def test_audit_answers(spark):
    long = "free text " * 200
    responses = answers(
        spark, '\n{"summary": "s", "strengths": ["a", "b"], "failed_criteria": "one"}',
        '\n ```json\n{"summary": "f"}\n```\n', long, "[1]", '{"summary": null}')
    got = {r["contact_id"]: r for r in sc.parse_ai_summary(responses).collect()}
    assert (got[0]["summary"], got[0]["strengths"], got[0]["failed_criteria"]) == ("s", ["a", "b"], ["one"])
    assert got[0]["improvements"] == [] and not got[0]["is_fallback"]
    assert got[1]["summary"] == "f"
    assert got[2]["summary"] == long[:1000] + sc.NOTE and got[2]["is_fallback"]
    assert got[3]["summary"] == "[1]" + sc.NOTE
    assert got[4]["summary"] == ""


def test_keyword_scores(spark, rubric, rows, monkeypatch):
    transcripts = spark.createDataFrame(
        [(1, "HELLO and hi there, bye"), (2, None)], "contact_id long, agent_text string")
    expected = [(1, "S1", "A", 2, 0.2), (1, "S1", "B", 1, 0.3), (1, "S2", "A", 0, 0.0),
                (2, "S1", "A", 0, 0.0), (2, "S1", "B", 0, 0.0), (2, "S2", "A", 0, 0.0)]
    columns = ("contact_id", "section_name", "criteria_name", "hits", "score")
    assert rows(sc.keyword_scores(transcripts, rubric), *columns) == expected
    monkeypatch.setattr(sc, "RULES_PER_PASS", 1)
    assert rows(sc.keyword_scores(transcripts, rubric), *columns) == expected
    strict = sc.keyword_scores(transcripts, rubric, min_hits=2).filter("passed")
    assert rows(strict, "contact_id", "criteria_name") == [(1, "A")]


def test_many_keywords_in_one_walk(spark):
    pick = random.Random(2)
    words = ["".join(pick.choice("abc") for _ in range(pick.randint(1, 6))) for _ in range(300)]
    lists = [[pick.choice([*words, "", None]) for _ in range(pick.randint(0, 12))] for _ in range(200)]
    texts = ["".join(pick.choice("abc ") for _ in range(n)) for n in (0, 5, 60, 800)]
    keywords = sc.Keywords(lists)
    for text in texts:
        assert keywords.hits(text).tolist() == [sum(k is not None and k in text for k in ks) for ks in lists]
    assert sc.Keywords([]).hits("abc").tolist() == [] and sc.Keywords([[], [""]]).hits("x").tolist() == [0, 1]


def test_time_hardly_grows_with_keywords():
    text = " ".join(f"word{i % 997}" for i in range(40_000))

    def seconds(n):
        keywords = sc.Keywords([[f"ward{i}x", f"other{i}"] for i in range(n)])
        began = time.perf_counter()
        for _ in range(5):
            keywords.hits(text)
        return time.perf_counter() - began

    assert seconds(5_000) < 10 * seconds(5)


def test_sentiment(spark, rows):
    lexicon = spark.createDataFrame([("good", 1), ("bad", -1)], "token string, polarity int")
    transcripts = spark.createDataFrame(
        [(1, "Good, good day. Bad!", "bad bad"), (2, "plain", None), (3, None, "GOOD bad")],
        "contact_id long, agent_text string, customer_text string")
    assert rows(sc.sentiment(transcripts, lexicon)) == [
        (1, "Positive", "Negative"), (2, "Neutral", "Neutral"), (3, "Neutral", "Neutral")]


def test_sentiment_by_join_is_the_same(spark, rows, monkeypatch):
    pick = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    lexicon = spark.createDataFrame(
        [(w, pick.choice([-1, 0, 1, None])) for w in words[:20]] + [("w1", 1), (None, 1)],
        "token string, polarity int")
    data = [(pick.randrange(25), *[" ".join(pick.choices(words, k=pick.randint(0, 8))) or None for _ in "ab"])
            for _ in range(60)]
    transcripts = spark.createDataFrame(data, "contact_id long, agent_text string, customer_text string")
    here = rows(sc.sentiment(transcripts, lexicon))
    monkeypatch.setattr(sc, "MOST_TOKENS", 3)
    assert rows(sc.sentiment(transcripts, lexicon)) == here
    assert {r[0] for r in here} == {r[0] for r in data}


def test_failed_and_recommendation(spark, rubric, rows):
    scores = spark.createDataFrame(
        [(1, "B", False), (1, "A", False), (1, "A", False), (1, "?", None), (2, "A", True)],
        "contact_id long, criteria_name string, passed boolean")
    failed = {r["contact_id"]: json.loads(r["failed_criteria"])
              for r in sc.failed_criteria(scores, rubric).collect()}
    assert failed == {1: ["A", "B", "?"], 2: []}
    assert rows(sc.recommendations(scores, rubric, 2)) == [(1, "Improve: A, B"), (2, sc.ALL_MET)]


def test_failed_criteria_beyond_a_word_of_bits(spark, rubric, monkeypatch):
    pick = random.Random(5)
    names = [f"c{i:03}" for i in range(150)] + ["A", "B", None]
    data = [(pick.randrange(20), pick.choice(names), pick.choice([True, False, None])) for _ in range(900)]
    scores = spark.createDataFrame(data, "contact_id long, criteria_name string, passed boolean")
    frame = sc.failed_criteria(scores, rubric)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan
    bits = sorted(map(tuple, frame.collect()))
    monkeypatch.setattr(sc, "MOST_CRITERIA", 5)
    assert sorted(map(tuple, sc.failed_criteria(scores, rubric).collect())) == bits
    assert sc.failed_criteria(scores.limit(0), rubric).count() == 0


def test_equal_answers_are_numbered(spark, rubric):
    content = '[{"criteria_name": "A", "passed": true}, {"criteria_name": "B", "passed": false}]'
    answers = [(1, 7, content)] * 3 + [(2, 7, content), (1, 8, content)] + [(3, 7, "?")] * 2
    responses = spark.createDataFrame(answers, "contact_id long, agent_id long, content string")
    scores, errors = sc.parse_scores(responses, rubric, RUN)
    got = scores.collect()
    assert len(got) == 10 and len({r["score_id"] for r in got}) == 10
    assert [tuple(r) for r in errors.collect()] == [(3, "?", "no array")] * 2


def test_answers_are_asked_once_and_kept(spark, tmp_path):
    store, asked = str(tmp_path / "answers"), spark.sparkContext.accumulator(0)
    prompts = spark.createDataFrame(
        [(i, f"prompt {i % 30}") for i in range(90)] + [(90, None)], "contact_id long, prompt string")
    broken = str(tmp_path / "broken")
    open(broken, "w").close()

    def model(texts):
        if os.path.exists(broken) and any(t == "prompt 7" for t in texts):
            raise RuntimeError("the model is gone")
        asked.add(len(texts))
        return pd.DataFrame({"content": [None if t is None else t.upper() for t in texts]})

    with pytest.raises(Exception, match="gone"):
        answered(prompts, model, store, per_wave=4)
    kept = stored_answers(spark, store).count()
    before = asked.value
    assert 0 < kept < 31
    os.remove(broken)
    got = answered(prompts, model, store, per_wave=4).collect()
    assert len(got) == 91 and asked.value - before == 31 - kept  # nothing that was stored is asked again
    assert all(r["content"] == (None if r["contact_id"] == 90 else f"PROMPT {r['contact_id'] % 30}") for r in got)
    answered(prompts, model, store).collect()
    assert asked.value - before == 31 - kept
    answered(prompts.limit(3), model, store, "another model").collect()
    assert asked.value - before == 31 - kept + 3


def test_citations(spark, rows):
    data = [("see 12", [12, 7]), ("none", [3, 3, 5]), ("no ids", []), ("null ids", None),
            ("many", list(range(20, 40)))]
    df = spark.createDataFrame(data, "answer string, ids array<long>")
    got = {r["answer"] for r in sc.with_citations(df, "ids").collect()}
    ten = ", ".join(str(i) for i in range(20, 30))
    assert got == {"see 12", "none\n\nCitations (Call IDs): 3, 5", "no ids", "null ids",
                   f"many\n\nCitations (Call IDs): {ten}"}


def test_infer_batches(spark, rows):
    def longest(texts):
        return pd.DataFrame({"seen": [len(texts)] * len(texts), "size": texts.str.len()})

    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 12)], "id long, t string").coalesce(1)
    got = sc.infer(df, longest, "t", "seen long, size long", batch_size=4)
    assert rows(got, "id", "size") == sorted([(i, i) for i in range(1, 12)], key=repr)
    assert max(r["seen"] for r in got.collect()) == 4


def test_scoring_run(spark, rubric):
    transcripts = spark.createDataFrame(
        [(1, "hello"), (2, "quiet"), (3, "done")], "contact_id long, full_text string")
    calls = spark.createDataFrame([(i, 10 * i) for i in (1, 2, 3)], "contact_id long, agent_id long")
    scored = spark.createDataFrame([(3,)], "contact_id long")

    def model(prompts):
        assert all("one JSON array" in p and "Rule A" in p for p in prompts)
        assert all(k in p for p in prompts for k in ("section_name", "criteria_name", "passed", "reasoning"))
        verdict = ['[{"criteria_name": "A", "passed": true}]' if "hello" in p else "?" for p in prompts]
        return pd.DataFrame({"content": verdict})

    scores, errors = score_unscored(transcripts, calls, scored, rubric, model, RUN)
    assert [(r["contact_id"], r["agent_id"], r["score"]) for r in scores.collect()] == [(1, 10, 0.2)]
    assert [r["contact_id"] for r in errors.collect()] == [2]


def test_summary_run(spark, rows):
    transcripts = spark.createDataFrame(
        [(1, "a", "old"), (2, "b", "bill"), (3, "c", "odd")],
        "contact_id long, agent_text string, customer_text string")
    stored = spark.createDataFrame(
        [(1, "Login", 90.0, "keep"), (2, None, 10.0, "gone")],
        "contact_id long, issue_category string, overall_score double, key_moments string")

    def model(prompts):
        told = ['{"issue_category": "Billing", "overall_score": 7}' if "bill" in p else "no"
                for p in prompts]
        return pd.DataFrame({"content": told})

    table, errors = summarise_missing(transcripts, stored, model, RUN)
    assert rows(table) == [(1, "Login", 90.0, "keep"), (2, "Billing", 7.0, None)]
    assert rows(errors, "contact_id") == [(3,)]


def test_audit_run(spark, rubric):
    transcripts = spark.createDataFrame(
        [(1, "x" * 900), (2, None), (3, "hi")], "contact_id long, full_text string")
    calls = spark.createDataFrame([(1, 10), (1, 10)], "contact_id long, agent_id long")
    plain = audit_all(transcripts, calls, rubric, RUN, version=4)
    assert plain.schema.names == schemas.AI_SUMMARY.names
    got = {r["contact_id"]: r for r in plain.collect()}
    assert sorted(got) == [1, 3]
    assert got[1]["summary"] == "x" * 800 + sc.NOTE and got[1]["agent_id"] == 10
    assert (got[3]["agent_id"], got[3]["strengths"], got[3]["version"]) == (None, "[]", 4)

    def model(prompts):
        return pd.DataFrame({"content": ['{"summary": "s", "strengths": ["a"]}'] * len(prompts)})

    told = {r["contact_id"]: r for r in audit_all(
        transcripts, calls, rubric, RUN, model=model, model_name="m").collect()}
    assert (told[1]["summary"], told[1]["strengths"], told[1]["model_name"]) == ("s", '["a"]', "m")
    assert told[1]["agent_id"] == 10


def test_prompt_holds_the_whole_transcript(spark):
    text = "word " * 5000
    transcripts = spark.createDataFrame([(1, text)], "contact_id long, full_text string")
    rules = spark.createDataFrame([("- S:\n  • A",)], "rubric_text string")
    prompt = sc.model_input(transcripts, rules).first()["prompt"]
    assert prompt.endswith(text) and "- S:\n  • A" in prompt
    assert "No rules" in sc.model_input(transcripts, rules.filter(F.lit(False))).first()["prompt"]
