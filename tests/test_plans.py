"""What the physical plans must and must not hold, and results under skew."""

import os
import re

import pytest
from pyspark.sql import functions as F

from callsift.operators import joins, retrieval, rollups, scoring
from callsift.plans import sizing
from callsift.plans.dedupe import first_match
from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample tables")
MODELS = {"train_issue_classifier", "predict_issue", "train_resolution_model", "predict_resolution",
          "tfidf_features", "save_models", "predict_issue_cover", "predict_resolution_cover",
          "saved_model_meta", "summary_predictions"}
# One row per distinct score rounded to one digit.
SINGLE_TASK_WINDOWS = {"agent_leaderboard"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODELS))
def test_no_cross_join_and_no_single_task_window(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name not in SINGLE_TASK_WINDOWS:
        for window in re.findall(r"Window \[.*", plan):
            assert "windowspecdefinition(" in window
            assert re.search(r"windowspecdefinition\([^)]*#\d+L?, [^)]* (ASC|DESC)", window), window


@needs_tables
def test_scans_read_only_what_is_used(spark):
    plan = plan_of(QUERIES["agent_avg_quality"](spark, FOLDER))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {
        "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"}
    one_call = joins.call_detail(
        spark.read.parquet(f"{FOLDER}/orders.parquet").withColumnRenamed("o_orderkey", "contact_id"),
        spark.read.parquet(f"{FOLDER}/lineitem.parquet").select(
            F.col("l_orderkey").alias("contact_id"), F.lit("A").alias("criteria_name"),
            F.lit(True).alias("passed"), F.lit(0.1).alias("score"), F.lit("r").alias("reasoning")),
        contact_id=5)
    assert "EqualTo(o_orderkey,5)" in plan_of(one_call)
    assert "EqualTo(l_orderkey,5)" in plan_of(one_call)


@needs_tables
def test_search_never_shuffles_documents(spark):
    search = QUERIES["tfidf_search"](spark, FOLDER)
    search.collect()
    final = plan_of(search).split("Initial Plan")[0]
    assert "regexp_extract_all" not in final  # texts were read before, once, see below
    for exchange in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", final):
        assert exchange.startswith("query_id")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumnRenamed("doc_id", "contact_id")
    counting = plan_of(retrieval.counted_terms(docs, ["contact_id"], ["a", "b"]))
    assert counting.count("regexp_extract_all") == 1 and "Exchange" not in counting


def test_small_sides_are_checked(spark, rows):
    df = spark.range(50)
    assert sizing.inline_if_small(df, 49)[1] is False
    small, proven = sizing.inline_if_small(df, 50)
    assert proven and rows(small) == rows(df)
    assert "broadcast" not in sizing.lookup_side(df, 49)._jdf.queryExecution().logical().toString()
    parts = sizing.blocks(df, "id", 20)
    assert len(parts) == 3 and sum(p.count() for p in parts) == 50
    assert sizing.inline_if_small(df, 50, max_bytes=100)[1] is False
    heavy = sizing.blocks(df, "id", 100, F.lit(10), max_bytes=100)
    assert len(heavy) == 5 and sum(p.count() for p in heavy) == 50


def test_large_lookup_gives_the_same_rows(spark, rows, monkeypatch):
    evaluations = spark.range(200).select((F.col("id") % 40).cast("string").alias("criteria_name"))
    rubric = spark.range(30).select(
        F.col("id").cast("string").alias("framework_id"),
        F.col("id").cast("string").alias("criteria_name"), (F.col("id") / 10).alias("effective_weight"))
    few = rows(joins.with_weights(evaluations, rubric))
    monkeypatch.setattr(joins, "lookup_side", lambda df: sizing.lookup_side(df, 3))
    assert rows(joins.with_weights(evaluations, rubric)) == few


@pytest.fixture(scope="module")
def hot(spark):
    """60,000 score rows of which a third belong to one call, agent and criterion."""
    n = F.col("id")
    third = n % 3 == 0
    return spark.range(60_000).select(
        F.when(third, 7).otherwise(n % 5000).alias("contact_id"),
        F.when(third, 1).otherwise(n % 50).alias("agent_id"),
        F.when(third, "A").otherwise(F.concat(F.lit("C"), (n % 9).cast("string")))
        .alias("criteria_name"),
        F.lit("S").alias("section_name"),
        ((n % 4) / 10).alias("score"), (n % 4 != 0).alias("passed"), n.alias("at"))


def test_hot_keys_fold_before_the_shuffle(spark, hot):
    """What a hot key sends to the shuffle is at most a row per task and group."""
    first = first_match(hot.repartition(4), "contact_id", "at")
    assert first.count() == 5000
    for df in (first, scoring.failed_criteria(hot, rubric_for(spark))):
        plan = plan_of(df)
        assert "partial_" in plan and "Window" not in plan


def rubric_for(spark):
    return spark.createDataFrame(
        [("r0", "A")] + [(f"r{i + 1}", f"C{i}") for i in range(9)],
        "framework_id string, criteria_name string")


def test_hot_results_equal_pandas(spark, hot):
    data = hot.toPandas()
    got = {r["contact_id"]: r["at"] for r in first_match(hot, "contact_id", "at").collect()}
    assert got == data.groupby("contact_id")["at"].min().to_dict()
    scores = {r[0]: r[1] for r in rollups.call_scores(hot).collect()}
    want = (data.groupby("contact_id")["score"].sum() * 100).round(6).to_dict()
    assert {k: round(v, 6) for k, v in scores.items()} == want
    failed = {r["contact_id"]: r["n_failed"] for r in scoring.failed_criteria(hot, rubric_for(spark)).collect()}
    want = data[~data["passed"]].groupby("contact_id")["criteria_name"].nunique().to_dict()
    assert {k: v for k, v in failed.items() if v} == want


def test_averages_do_not_depend_on_partitioning(spark, hot):
    a = rollups.agent_avg_quality(hot.repartition(3)).collect()
    b = rollups.agent_avg_quality(hot.repartition(17)).collect()
    assert sorted(a) == sorted(b)
