"""The three model runs: score unscored calls, summarise calls without summary, audit all calls.

`model` maps a pandas Series of prompts to a frame with a `content` column; see `scoring.infer`.
Answers go to a store, see `answers`: reading rows and errors from them does not ask twice, and with a
`store` that outlives the run, neither does a run after one that died.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.functions.moments import moment
from callsift.operators import joins, scoring
from callsift.operators import rubric as rb
from callsift.plans.answers import answered
from callsift.plans.dedupe import first_match
from callsift.session import scratch_path, settle
from callsift.sources import sinks

KEY = joins.KEY
SCORE_INSTRUCTION = (
    "Judge the call against every rule below. Answer with one JSON array and nothing else; it holds one "
    "object per rule with the keys section_name, criteria_name, passed (true or false) and reasoning "
    "(one sentence).\n\n"
)
SUMMARY_INSTRUCTION = (
    "Read the call and answer with one JSON object with the keys issue_category, "
    "issue_description, resolution, sentiment_agent, sentiment_customer, overall_score (1 to 10), "
    "key_moments and ai_recot.\n\n"
)


def _answers(prompts: DataFrame, model: Callable, store: str | None, model_name: str) -> DataFrame:
    """`prompts` with the model's answer as `content` instead of the prompt."""
    kept = store or scratch_path(prompts.sparkSession, "answers")
    return settle(answered(prompts, model, kept, model_name), "answered")


def score_unscored(
    transcripts: DataFrame, calls: DataFrame, scores: DataFrame, rubric: DataFrame,
    model: Callable, run_ts: datetime, store: str | None = None, model_name: str = "model",
) -> tuple[DataFrame, DataFrame]:
    """New score rows and unreadable answers for calls without scores."""
    waiting = joins.unscored(transcripts, calls, scores)
    prompts = scoring.model_input(waiting, rb.rubric_prompt(rubric), SCORE_INSTRUCTION)
    return scoring.parse_scores(_answers(prompts, model, store, model_name), rubric, run_ts)


def summarise_missing(
    transcripts: DataFrame, call_summary: DataFrame, model: Callable, run_ts: datetime,
    store: str | None = None, model_name: str = "model",
) -> tuple[DataFrame, DataFrame]:
    """The summary table with fresh rows for calls that lacked one, and unreadable answers."""
    every = joins.unsummarized(transcripts, call_summary)
    waiting = first_match(every, KEY, ["customer_text", "agent_text"])
    prompt = F.concat(
        F.lit(SUMMARY_INSTRUCTION + "The customer said:\n"), F.coalesce("customer_text", F.lit("")),
        F.lit("\n\nThe agent said:\n"), F.coalesce("agent_text", F.lit("")),
    )
    answers = _answers(waiting.select(KEY, prompt.alias("prompt")), model, store, model_name)
    rows, errors = scoring.parse_summaries(answers)
    known = {f.name: f.dataType for f in call_summary.schema}
    stamped = rows.withColumn("created_at", moment(run_ts))
    fresh = stamped.select(*[
        (F.col(c) if c in stamped.columns else F.lit(None)).cast(kind).alias(c)
        for c, kind in known.items()
    ])
    return sinks.upsert(call_summary, fresh, KEY, KEY), errors


def audit_all(
    transcripts: DataFrame, calls: DataFrame, rubric: DataFrame, run_ts: datetime, version: int = 1,
    model: Callable | None = None, model_name: str = "model", store: str | None = None,
) -> DataFrame:
    """The whole audit table anew: by the model, or from the transcripts' start without one."""
    waiting = joins.with_agent(scoring.has_text(transcripts).select(KEY, "full_text"), calls)
    if model is None:
        read = scoring.fallback_summary(waiting)
    else:
        prompts = scoring.model_input(waiting, rb.rubric_text(rubric))
        read = scoring.parse_ai_summary(_answers(prompts, model, store, model_name)).withColumn(
            "model_name", F.lit(model_name)
        )
    return read.select(
        KEY, "agent_id", "summary",
        *[F.to_json(c).alias(c) for c in ("strengths", "improvements", "failed_criteria")],
        "model_name", F.lit(version).alias("version"), moment(run_ts).alias("created_at"),
    )
