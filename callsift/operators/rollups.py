"""Aggregations, rankings, daily series and orderings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsift.functions.moments import moment
from callsift.functions.numbers import (
    count_where, exact_avg, exact_sum, ratio, scaled_sum, share_pct,
)
from callsift.session import settle

KEY = "contact_id"
AGENT_GROUP = ("agent_id", "team_name", "skill_name")


def _facts(calls: DataFrame, call_summary: DataFrame | None, of_call: list, of_summary: list,
           how: str = "inner") -> DataFrame:
    """The named columns of calls and their summaries, narrowed before the join.

    Without `call_summary` the calls hold the summary columns already: several roll-ups can then
    share one stored join.
    """
    if call_summary is None:
        return calls.select(KEY, *of_call, *of_summary)
    return calls.select(KEY, *of_call).join(call_summary.select(KEY, *of_summary), KEY, how)


def agent_rollup(calls: DataFrame, call_summary: DataFrame | None = None,
                 with_range: bool = False) -> DataFrame:
    """Volume, outcome, time and satisfaction by agent, team and skill."""
    joined = _facts(
        calls, call_summary,
        [*AGENT_GROUP, "total_duration_sec", "hold_seconds", "service_level_flag"],
        ["overall_score", "resolution", "sentiment_customer"],
    )
    score = F.col("overall_score")
    measures = [
        F.count_distinct(KEY).alias("total_calls"),
        exact_avg(score, 1).alias("avg_score"),
        count_where(F.col("resolution") == "Resolved").alias("resolved"),
        count_where(F.col("resolution") == "Escalated").alias("escalated"),
        count_where(F.col("resolution") == "Unresolved").alias("unresolved"),
        exact_avg(F.col("total_duration_sec"), 1, divide_by=60).alias("avg_dur_min"),
        exact_avg(F.col("hold_seconds"), 0).alias("avg_hold_sec"),
        count_where(F.col("service_level_flag") == "1").alias("sla_met"),
        share_pct(count_where(F.col("sentiment_customer") == "Positive"), F.count("*"))
        .alias("csat_pct"),
    ]
    if with_range:
        measures += [F.max(score).alias("best_score"), F.min(score).alias("worst_score")]
    return joined.groupBy(*AGENT_GROUP).agg(*measures)


def by_score(rollup: DataFrame, k: int | None = None) -> DataFrame:
    """Best average first; ties by agent, team and skill."""
    ordered = rollup.orderBy(F.desc_nulls_last("avg_score"), *AGENT_GROUP)
    return ordered if k is None else ordered.limit(k)


def criteria_pass_rate(scores: DataFrame) -> DataFrame:
    """Pass rate, passes and volume by criterion; an unknown outcome counts as failed."""
    passed = count_where(F.col("passed"))
    return scores.groupBy("criteria_name", "section_name").agg(
        share_pct(passed, F.count("*")).alias("pass_rate"),
        passed.alias("passed_count"),
        F.count("*").alias("total"),
    )


def by_pass_rate(rates: DataFrame, k: int | None = None) -> DataFrame:
    """Worst criterion first."""
    ordered = rates.orderBy("pass_rate", "criteria_name", "section_name")
    return ordered if k is None else ordered.limit(k)


def heatmap(scores: DataFrame, wide: bool = False, criteria: list[str] | None = None) -> DataFrame:
    """Pass rate by agent and criterion.

    The wide form has one column for each of the given criteria and takes one shuffle; it needs the
    list, since a table's columns must be known before it is read.
    """
    if not wide:
        return scores.groupBy("agent_id", "criteria_name", "section_name").agg(
            share_pct(count_where(F.col("passed")), F.count("*")).alias("pass_rate")
        )
    if criteria is None:
        raise ValueError("the wide form needs the list of criteria")

    def rate(name: str) -> Column:
        of_name = F.col("criteria_name").eqNullSafe(F.lit(name))
        return share_pct(count_where(of_name & F.col("passed")), count_where(of_name)).alias(name)

    return scores.groupBy("agent_id").agg(*[rate(name) for name in criteria])


def agents_dimension(calls: DataFrame, call_summary: DataFrame | None = None,
                     run_ts: datetime | None = None) -> DataFrame:
    """One row per agent; team and skill are those of the latest call.

    With `run_ts` the rows carry it as `updated_at`, as the stored table does.
    """
    joined = _facts(
        calls, call_summary, [*AGENT_GROUP, "total_duration_sec", "contact_start"],
        ["overall_score"], "left",
    )
    latest = F.max(F.struct("contact_start", KEY, "team_name", "skill_name"))
    grouped = joined.groupBy("agent_id").agg(
        latest.alias("_latest"),
        F.count("*").alias("total_calls"),
        exact_avg(F.col("overall_score"), 1).alias("avg_quality_score"),
        exact_avg(F.col("total_duration_sec"), 1).alias("avg_handle_time"),
    )
    stamp = [] if run_ts is None else [moment(run_ts).alias("updated_at")]
    return grouped.select(
        "agent_id",
        F.col("_latest.team_name").alias("team_name"),
        F.col("_latest.skill_name").alias("skill_name"),
        "total_calls",
        "avg_quality_score",
        "avg_handle_time",
        F.col("_latest.contact_start").alias("last_call_date"),
        *stamp,
    )


def overview(calls: DataFrame, call_summary: DataFrame | None = None) -> DataFrame:
    """Calls, mean score and number of agents in one row."""
    joined = _facts(calls, call_summary, ["agent_id"], ["overall_score"])
    return joined.agg(
        F.count("*").alias("total_calls"),
        exact_avg(F.col("overall_score"), 1).alias("avg_score"),
        F.count_distinct("agent_id").alias("agents"),
    )


def resolution_breakdown(call_summary: DataFrame) -> DataFrame:
    """Calls and share by resolution."""
    counts = call_summary.groupBy("resolution").agg(F.count("*").alias("calls"))
    total = counts.agg(F.sum("calls")).scalar()
    return counts.withColumn("share_pct", share_pct(F.col("calls"), total))


def total_calls(scores: DataFrame, approx: bool = False) -> DataFrame:
    """Calls behind the per-criterion rows."""
    counted = F.approx_count_distinct(KEY) if approx else F.count_distinct(KEY)
    return scores.agg(counted.alias("total_calls"))


def agent_avg_quality(scores: DataFrame) -> DataFrame:
    """Sum of criterion scores over distinct calls, as points and as percent."""
    points, n = exact_sum(F.col("score")), F.count_distinct(KEY)
    return scores.groupBy("agent_id").agg(
        n.alias("total_calls"),
        ratio(points, n, 4).alias("avg_quality"),
        ratio(points, n, 1, times=100).alias("avg_quality_pct"),
    )


def most_failed(scores: DataFrame, k: int) -> DataFrame:
    """The k criteria that fail most often."""
    failed = count_where(~F.coalesce("passed", F.lit(False)))
    counts = scores.groupBy("criteria_name").agg(failed.alias("failed"))
    return counts.orderBy(F.desc("failed"), "criteria_name").limit(k)


def call_scores(scores: DataFrame) -> DataFrame:
    """Score of a call: the weights of its passed criteria, in percent."""
    return scores.groupBy(KEY).agg(
        scaled_sum(F.col("score"), 100).alias("overall_score")
    )


def daily(calls: DataFrame, call_summary: DataFrame | None = None) -> DataFrame:
    """Calls and exact score totals per calendar day: the small base of all daily series."""
    joined = _facts(calls, call_summary, ["contact_start"], ["overall_score"])
    return joined.groupBy(F.to_date("contact_start").alias("day")).agg(
        F.count("*").alias("calls"),
        F.count("overall_score").alias("scored"),
        exact_sum(F.col("overall_score")).alias("score_sum"),
    )


def daily_trend(calls: DataFrame, call_summary: DataFrame | None = None) -> DataFrame:
    """Average score per day."""
    average = ratio(F.col("score_sum"), F.col("scored"), 1).alias("avg_score")
    return daily(calls, call_summary).select("day", "calls", average)


def rolling_score(per_day: DataFrame, days: int = 7) -> DataFrame:
    """Average score over the last `days` calendar days, each call counted once.

    Every day adds itself to the days it counts for, so one aggregation does without a window over
    the whole series.
    """
    ahead = F.sequence(F.lit(0), F.lit(days - 1))
    spread = per_day.select("day", "score_sum", "scored", F.explode(ahead).alias("_ahead"))
    summed = spread.groupBy(F.date_add("day", F.col("_ahead")).alias("day")).agg(
        ratio(exact_sum(F.col("score_sum")), F.sum("scored"), 1).alias("rolling_score"),
        F.bool_or(F.col("_ahead") == 0).alias("_present"),
    )
    return summed.filter("_present").drop("_present")


def day_delta(per_day: DataFrame) -> DataFrame:
    """Calls per day and the change against the previous calendar day, null when that had none."""
    calls, none = F.col("calls"), F.lit(None).cast("bigint")
    own = F.struct(F.col("day").alias("day"), calls.alias("calls"), none.alias("before"))
    next_day = F.struct(
        F.date_add("day", 1).alias("day"), none.alias("calls"), calls.alias("before")
    )
    spread = per_day.select(F.inline(F.array(own, next_day)))
    paired = spread.groupBy("day").agg(F.max("calls").alias("calls"), F.max("before").alias("before"))
    return paired.filter("calls IS NOT NULL").select(
        "day", "calls", (F.col("calls") - F.col("before")).alias("change")
    )


def issue_volume(call_summary: DataFrame) -> DataFrame:
    """Calls per issue category and whether it is the most frequent one."""
    counts = call_summary.filter("issue_category IS NOT NULL").groupBy("issue_category").agg(
        F.count("*").alias("calls")
    )
    top = counts.agg(F.min_by("issue_category", F.struct(-F.col("calls"), "issue_category")))
    return counts.withColumn("is_top", F.col("issue_category") == top.scalar())


def confusion(predictions: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows per actual and predicted label."""
    known = predictions.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return known.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def accuracy(predictions: DataFrame, actual: str, predicted: str) -> DataFrame:
    """The confusion counts with the overall accuracy in percent beside them."""
    # A row per pair of labels; written out, since both reads would predict every row.
    counts = settle(confusion(predictions, actual, predicted), "confusion")
    correct = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    overall = counts.agg(share_pct(correct, F.sum("n"))).scalar()
    return counts.withColumn("accuracy_pct", overall)


def leaderboard(rollup: DataFrame) -> DataFrame:
    """Rank of each agent row by average score, equal scores sharing a rank.

    Ranks come from the histogram of scores, not from sorting all agents in one task: an average is
    rounded to one digit between 0 and 100, so there are at most 1,001 distinct ones. Spark sees the
    small histogram at run time and broadcasts it; a hot score would be split as a skewed one.
    """
    histogram = rollup.groupBy("avg_score").agg(F.count("*").alias("_n"))
    better = Window.orderBy(F.desc_nulls_last("avg_score")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranks = histogram.select(
        F.col("avg_score").alias("_score"),
        (F.coalesce(F.sum("_n").over(better), F.lit(0)) + 1).alias("score_rank"),
    )
    same = F.col("avg_score").eqNullSafe(F.col("_score"))
    return rollup.join(ranks, same).drop("_score")


def distinct_calls(scores: DataFrame) -> DataFrame:
    """Ids of the calls that have scores."""
    return scores.select(KEY).distinct()


def sample_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key, so the sample is the same every time."""
    return df.orderBy(key).limit(n)
