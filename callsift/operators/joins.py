"""Joins between the call tables.

Right sides that must be unique are reduced to one row per key first. Row-level joins leave the
strategy to Spark: it broadcasts by measured size and splits skewed partitions at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.functions.labels import risk_label
from callsift.plans.dedupe import distinct_keys, first_match
from callsift.plans.sizing import lookup_side

KEY = "contact_id"
MOST_WAITING = 1_000_000
# The columns that the joined tables hold.
SUMMARY_COLUMNS = (
    "overall_score", "resolution", "sentiment_agent", "sentiment_customer", "issue_category",
    "ai_recommendation", "pred_issue_category", "pred_resolution", "key_moments",
)
TRAINING_FROM_TRANSCRIPTS = (
    "agent_text", "customer_text", "agent_word_count", "customer_word_count", "talk_ratio",
)
TRAINING_FROM_CALLS = (
    "campaign_name", "total_duration_sec", "agent_seconds", "in_queue_seconds", "hold_seconds",
    "hold_count", "acw_seconds", "is_abandoned", "is_outbound", "service_level_flag",
    "is_simulated",
)
TRAINING_FROM_SUMMARY = (
    "overall_score", "sentiment_agent", "sentiment_customer", "issue_category", "resolution",
)


def calls_with_summary(calls: DataFrame, call_summary: DataFrame) -> DataFrame:
    """Every call that has a summary, with the summary's columns."""
    present = [c for c in SUMMARY_COLUMNS if c in call_summary.columns]
    return calls.join(call_summary.select(KEY, *present), KEY)


def training_set(transcripts: DataFrame, calls: DataFrame, call_summary: DataFrame) -> DataFrame:
    """The 22 training columns of calls that have both a transcript and a summary."""
    return (
        transcripts.select(KEY, *TRAINING_FROM_TRANSCRIPTS)
        .join(calls.select(KEY, *TRAINING_FROM_CALLS), KEY)
        .join(call_summary.select(KEY, *TRAINING_FROM_SUMMARY), KEY)
    )


def scores_with_calls(scores: DataFrame, calls: DataFrame) -> DataFrame:
    """Score rows with the call's agent (as `ag_id`) and team."""
    side = calls.select(KEY, F.col("agent_id").alias("ag_id"), "team_name")
    return scores.join(side, KEY)


def scores_with_names(scores: DataFrame, calls: DataFrame) -> DataFrame:
    """Score rows with the agent's readable name."""
    name = F.concat_ws(" ", "first_name", "last_name").alias("agent_name")
    return scores.join(calls.select(KEY, name), KEY)


def call_detail(calls: DataFrame, scores: DataFrame, contact_id: int | None = None) -> DataFrame:
    """A call (or all calls) with its score rows, the score as whole percent.

    A left join whose right side has a hot key cannot be split at run time. An inner join can, and
    the calls without scores are added by an anti join against folded keys.
    """
    if contact_id is not None:
        calls = calls.filter(F.col(KEY) == contact_id)
        scores = scores.filter(F.col(KEY) == contact_id)
    percent = F.round(F.col("score").cast("decimal(18,6)") * 100, 0).cast("double")
    lines = scores.select(KEY, "criteria_name", "passed", percent.alias("score_pct"), "reasoning")
    without = calls.join(distinct_keys(scores, KEY), KEY, "left_anti")
    return calls.join(lines, KEY).unionByName(without, allowMissingColumns=True)


def unsummarized(transcripts: DataFrame, call_summary: DataFrame) -> DataFrame:
    """Transcripts whose call has no summary, or once per summary without a category.

    Which calls these are is found on keys alone, summaries counted per call first, so that a hot key folds
    early. Where the waiting calls prove few, no text is shuffled.
    """
    empty = F.count_if(F.col("issue_category").isNull()).alias("_empty")
    summaries = call_summary.groupBy(KEY).agg(empty)
    known = distinct_keys(transcripts, KEY).join(summaries, KEY, "left")
    times = F.coalesce("_empty", F.lit(1)).cast("int").alias("_times")
    waiting = known.select(KEY, times).filter("_times > 0")
    # A null key joins nothing, but its transcript has no summary either.
    nameless = transcripts.filter(F.col(KEY).isNull()).select(KEY, "agent_text", "customer_text")
    joined = transcripts.select(KEY, "agent_text", "customer_text").join(
        lookup_side(waiting.filter(F.col(KEY).isNotNull()), MOST_WAITING), KEY)
    repeated = joined.select(
        KEY, "agent_text", "customer_text", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_one")
    )
    return repeated.drop("_one").unionByName(nameless)


def unscored(transcripts: DataFrame, calls: DataFrame, scores: DataFrame) -> DataFrame:
    """Transcribed calls NOT IN the scored ones: one null key among the scores empties the result.

    An anti join on keys alone plus a one-value check for null keys; the check reads only the key
    column's statistics where the files hold them. Where the waiting calls prove few, no text is shuffled.
    """
    null_keys = scores.filter(F.col(KEY).isNull()).agg(F.count("*")).scalar()
    keys = distinct_keys(transcripts, KEY).join(distinct_keys(scores, KEY), KEY, "left_anti")
    waiting = calls.select(KEY, "agent_id").join(keys, KEY, "left_semi")
    remaining = transcripts.select(KEY, "full_text").join(lookup_side(waiting, MOST_WAITING), KEY)
    return remaining.filter(null_keys == 0).select(KEY, "agent_id", "full_text")


def with_weights(evaluations: DataFrame, rubric: DataFrame, order_by: str = "framework_id"):
    """Evaluations with the weight of the first rule of that name, 0 when there is none."""
    keyed = rubric.select("criteria_name", order_by, "effective_weight")
    first = first_match(keyed, "criteria_name", order_by).drop(order_by)
    joined = evaluations.join(lookup_side(first), "criteria_name", "left")
    return joined.withColumn("effective_weight", F.coalesce("effective_weight", F.lit(0.0)))


def critical_risk(scores: DataFrame, rubric: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Failed criteria with their weight and, above the threshold, the risk label."""
    failed = scores.filter(~F.coalesce("passed", F.lit(False)))
    weighted = with_weights(failed, rubric)
    label = risk_label(F.col("passed"), F.col("effective_weight"), threshold)
    return weighted.withColumn("risk", label)


def with_agent(transcripts: DataFrame, calls: DataFrame) -> DataFrame:
    """Transcripts with the agent of their call, null when the call is unknown."""
    side = first_match(calls.select(KEY, "agent_id"), KEY, "agent_id")
    return transcripts.join(side, KEY, "left")


def missing_transcripts(calls: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Calls that have no transcript."""
    return calls.join(distinct_keys(transcripts, KEY), KEY, "left_anti").select(*calls.columns)


def union_calls(real: DataFrame, simulated: DataFrame) -> DataFrame:
    """One calls table of recorded and generated rows, told apart by `is_simulated`."""
    return real.withColumn("is_simulated", F.lit(False)).unionByName(
        simulated.withColumn("is_simulated", F.lit(True))
    )
