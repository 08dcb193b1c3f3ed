"""Joins, roll-ups, rubric views and quality rules on small hand-made tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from callsift import schemas
from callsift.operators import joins, quality, rollups, rubric as rb
from callsift.plans import dashboard

CALLS = ("contact_id long, agent_id long, team_name string, skill_name string, first_name string, "
         "last_name string, contact_start timestamp_ntz, total_duration_sec double, "
         "hold_seconds double, service_level_flag string, disposition_notes string")
SUMMARY = ("contact_id long, overall_score double, resolution string, sentiment_agent string, "
           "sentiment_customer string, issue_category string")
SCORES = ("contact_id long, agent_id long, section_name string, criteria_name string, "
          "score double, passed boolean, reasoning string")


@pytest.fixture(scope="module")
def calls(spark):
    day = datetime(2025, 3, 1, 9)
    return spark.createDataFrame(
        [(1, 10, "T", "S", "Ann", "Lee", day, 60.0, 0.0, "1", "ok"),
         (2, 10, "T", "S", "Ann", "Lee", day.replace(day=2), 90.0, 1500.5, "0", None),
         (3, 10, "T", "S2", "Ann", "Lee", day.replace(day=9), 30.0, 1000.0, None, ""),
         (4, 11, "U", "S", "Bo", "Ray", day.replace(day=2), 10.0, None, "1", "ok")], CALLS)


@pytest.fixture(scope="module")
def summary(spark):
    return spark.createDataFrame(
        [(1, 59.6, "Resolved", "Positive", "Positive", "Billing"),
         (2, 24.05, "Escalated", "Neutral", None, None),
         (4, 94.1, None, "Negative", "Negative", "Billing")], SUMMARY)


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(
        [(1, 10, "S1", "A", 0.2, True, "r"), (1, 10, "S1", "B", 0.0, False, "r"),
         (2, 10, "S1", "A", 0.0, None, "r"), (2, 10, "S1", "B", 0.3, True, "r"),
         (4, 11, "S1", "A", 0.2, True, "r"), (9, 12, "S1", "B", 0.0, False, None)], SCORES)


@pytest.fixture(scope="module")
def transcripts(spark):
    return spark.createDataFrame(
        [(1, "a", "c", "a c", 0.5), (2, "a2", "c2", "a2 c2", 0.231), (3, None, "x", None, 0.0),
         (5, "b", "d", "b d", None)],
        "contact_id long, agent_text string, customer_text string, full_text string, talk_ratio double")


def test_agent_rollup(calls, summary):
    got = {(r["agent_id"], r["skill_name"]): r
           for r in rollups.agent_rollup(calls, summary, with_range=True).collect()}
    ann = got[10, "S"]
    assert (ann["total_calls"], ann["avg_score"]) == (2, 41.8)
    assert (ann["resolved"], ann["escalated"], ann["unresolved"]) == (1, 1, 0)
    assert (ann["avg_dur_min"], ann["avg_hold_sec"], ann["sla_met"]) == (1.3, 750.0, 1)
    assert (ann["csat_pct"], ann["best_score"], ann["worst_score"]) == (50.0, 59.6, 24.05)
    assert got[11, "S"]["avg_hold_sec"] is None
    assert (10, "S2") not in got


def test_pass_rates_count_unknown_as_failed(scores, rows):
    assert rows(rollups.criteria_pass_rate(scores)) == [("A", "S1", 66.7, 2, 3), ("B", "S1", 33.3, 1, 3)]
    assert rollups.by_pass_rate(rollups.criteria_pass_rate(scores), 1).first()[0] == "B"
    wide = {r["agent_id"]: (r["A"], r["B"]) for r in rollups.heatmap(scores, True, ["A", "B"]).collect()}
    assert wide == {10: (50.0, 50.0), 11: (100.0, None), 12: (None, 0.0)}
    with pytest.raises(ValueError):
        rollups.heatmap(scores, True)
    many = [f"C{i}" for i in range(1001)]
    assert len(rollups.heatmap(scores, True, many).columns) == 1002


def test_agents(calls, summary):
    got = {r["agent_id"]: r for r in rollups.agents_dimension(calls, summary).collect()}
    assert (got[10]["skill_name"], got[10]["total_calls"]) == ("S2", 3)
    assert (got[10]["avg_handle_time"], got[10]["last_call_date"].day) == (60.0, 9)
    stored = rollups.agents_dimension(calls, summary, run_ts=datetime(2026, 1, 1))
    assert stored.schema.names == schemas.AGENTS.names


def test_scores_by_call_and_agent(scores, rows):
    assert rows(rollups.call_scores(scores)) == [(1, 20.0), (2, 30.0), (4, 20.0), (9, 0.0)]
    assert rows(rollups.agent_avg_quality(scores)) == [
        (10, 2, 0.25, 25.0), (11, 1, 0.2, 20.0), (12, 1, 0.0, 0.0)]
    assert rollups.total_calls(scores).first()[0] == 4
    assert rollups.total_calls(scores, approx=True).first()[0] == 4
    assert rows(rollups.most_failed(scores, 1)) == [("B", 2)]


def test_daily_series(calls, summary):
    per_day = rollups.daily(calls, summary)
    delta = {r["day"].day: r["change"] for r in rollups.day_delta(per_day).collect()}
    assert delta == {1: None, 2: 1}
    rolling = {r["day"].day: r["rolling_score"] for r in rollups.rolling_score(per_day).collect()}
    assert rolling == {1: 59.6, 2: 59.3}


def test_leaderboard_shares_ranks(spark):
    board = spark.createDataFrame(
        [(1, "t", "s", 90.0), (2, "t", "s", 80.0), (3, "t", "s", 90.0), (4, "t", "s", None),
         (5, "t", "s", 70.0)], "agent_id long, team_name string, skill_name string, avg_score double")
    got = {r["agent_id"]: r["score_rank"] for r in rollups.leaderboard(board).collect()}
    assert got == {1: 1, 3: 1, 2: 3, 5: 4, 4: 5}


def test_breakdown_volume_accuracy(summary, rows):
    assert rows(rollups.resolution_breakdown(summary)) == [
        ("Escalated", 1, 33.3), ("Resolved", 1, 33.3), (None, 1, 33.3)]
    assert rows(rollups.issue_volume(summary)) == [("Billing", 2, True)]
    guessed = summary.select("issue_category", F.lit("Billing").alias("p"))
    assert rows(rollups.accuracy(guessed, "issue_category", "p")) == [("Billing", "Billing", 2, 100.0)]


def test_unsummarized_covers_absent_and_empty(transcripts, summary, rows):
    assert rows(joins.unsummarized(transcripts, summary), "contact_id") == [(2,), (3,), (5,)]
    twice = summary.union(summary)
    assert rows(joins.unsummarized(transcripts, twice), "contact_id") == [(2,), (2,), (3,), (5,)]


def test_unscored_and_the_null_key(spark, transcripts, calls, scores, rows):
    assert rows(joins.unscored(transcripts, calls, scores), "contact_id") == [(3,)]
    with_null = scores.union(spark.createDataFrame([(None, 1, "S", "A", 0.0, True, "r")], SCORES))
    assert rows(joins.unscored(transcripts, calls, with_null)) == []


def test_weight_lookup_takes_the_first_rule(spark, scores):
    rubric = spark.createDataFrame(
        [("r2", "A", 0.9), ("r1", "A", 0.2)],
        "framework_id string, criteria_name string, effective_weight double")
    got = {r["criteria_name"]: r["effective_weight"] for r in joins.with_weights(scores, rubric).collect()}
    assert got == {"A": 0.2, "B": 0.0}
    risky = joins.critical_risk(scores, rubric, threshold=0.15).collect()
    assert {(r["contact_id"], r["criteria_name"], r["risk"]) for r in risky} == {
        (1, "B", None), (2, "A", "CRITICAL BUSINESS RISK"), (9, "B", None)}


def test_missing_and_detail(calls, transcripts, scores, rows):
    assert rows(joins.missing_transcripts(calls, transcripts), "contact_id") == [(4,)]
    detail = joins.call_detail(calls, scores, contact_id=1)
    assert rows(detail, "criteria_name", "score_pct") == [("A", 20.0), ("B", 0.0)]
    everything = rows(joins.call_detail(calls, scores), "contact_id", "criteria_name")
    assert everything == [(1, "A"), (1, "B"), (2, "A"), (2, "B"), (3, None), (4, "A")]
    audit = dict(quality.load_audit({"calls": calls, "transcripts": transcripts}).collect())
    assert audit == {"calls": 4, "transcripts": 4, "matched pairs": 3}


def test_quality_log(calls, transcripts, rows):
    log = quality.quality_log(calls, transcripts)
    assert rows(log, "contact_id", "field_name", "issue_description", "severity") == [
        (2, "dispositionNotes", "No disposition notes", "low"),
        (2, "holdSeconds", "Long hold: 1500.5s", "high"),
        (2, "talk_ratio", "Agent only 23%", "medium"),
        (3, "dispositionNotes", "No disposition notes", "low"),
        (3, "talk_ratio", "Agent only 0%", "medium")]
    assert log.select("log_id").distinct().count() == 5
    assert dict(quality.quality_summary(log).collect()) == {"low": 2, "high": 1, "medium": 2, "total": 5}
    assert [r["severity_rank"] for r in quality.severity_sort(log).collect()] == [1, 2, 2, 3, 3]


def test_profile_without_dates_or_scores(spark, rows):
    got = quality.profile(spark.createDataFrame([(1,), (2,)], "a int"), "t")
    assert rows(got, "table_name", "row_count", "column_name", "kind") == [("t", 2, "a", "columns")]


def test_dashboard_frames_share_one_join(calls, summary, scores, transcripts, rows):
    log = quality.quality_log(calls, transcripts)
    shown = dashboard.frames(calls, summary, scores, transcripts, log)
    for name, alone in {
        "agents": rollups.agent_rollup(calls, summary, with_range=True),
        "overview": rollups.overview(calls, summary),
        "days": rollups.daily_trend(calls, summary),
        "resolutions": rollups.resolution_breakdown(summary),
    }.items():
        assert rows(shown[name]) == rows(alone), name
        assert "Join" not in shown[name]._jdf.queryExecution().executedPlan().toString()
    assert all(df.count() > 0 for df in shown.values())


RULES = ("section_name string, criteria_name string, criteria_weight double, "
         "effective_weight double, enabled boolean, what_to_check string, good_example string, "
         "bad_example string")


def test_rubric_views(spark, rows):
    rubric = spark.createDataFrame(
        [("S2", "Tone", 1.0, 0.0875, True, "be calm", "g", "b"),
         ("S1", "Hello", 0.4, 0.1, True, "greet", "g", "b"),
         ("S1", "Name", 0.6, 0.3, True, None, "g", "b"),
         ("S1", "Off", 0.0, 0.9, False, "x", "g", "b"),
         (None, "Loose", 1.0, 5.0, True, "y", "g", "b"),
         (None, "Zero", 0.0, 0.0, True, "z", "g", "b")], RULES)
    assert rb.rubric_text(rubric).first()[0] == (
        "- S1:\n  • Name (30.0%): \n  • Hello (10.0%): greet\n"
        "- S2:\n  • Tone (8.75%): be calm\n"
        "- General:\n  • Loose (5.0%): y\n  • Zero (0%): z")
    prompt = rb.rubric_prompt(rubric).first()[0]
    assert prompt.startswith("In section S1\nRule Name\nAsks: \nMet, e.g.: g\nNot met, e.g.: b\n\n")
    assert prompt.count("Asks:") == 5
    assert rows(rb.rubric_counts(rubric)) == [
        ("S1", 3, 2, 1.0, True), ("S2", 1, 1, 1.0, True), (None, 2, 2, 1.0, True)]
    assert [r["criteria_name"] for r in rb.sorted_rules(rubric, 3).collect()] == ["Off", "Name", "Hello"]


def test_rubric_under_other_names(spark):
    flat = spark.createDataFrame(
        [("Tone", 0.2, "be calm"), ("Name", 0.8, None)],
        "criteria_name string, weight double, description string")
    assert rb.rubric_text(flat).first()[0] == "- Name (80.0%): \n- Tone (20.0%): be calm"
    by_section = flat.withColumn("section_name", F.lit("S"))
    assert rb.rubric_text(by_section).first()[0] == (
        "- S:\n  • Name (80.0%): \n  • Tone (20.0%): be calm")
    bare = flat.drop("description").withColumn("enabled", F.col("criteria_name") == "Tone")
    assert rb.rubric_text(bare).first()[0] == "- Tone (20.0%): "


def test_profile_holds_small_values_and_all_columns(spark):
    dates = ", ".join(f"d{i} timestamp_ntz" for i in range(5))
    df = spark.createDataFrame([(2e-7, *[None] * 5), (4e-7, *[None] * 5)], f"score double, {dates}")
    got = {r["column_name"]: r for r in quality.profile(df, "t").collect()}
    assert len(got) == 7 and got["score"]["avg_value"] == 3e-7
    assert quality.profile(df, "t", most=3).count() == 5
