"""All dashboard frames from one stored join of calls and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from callsift.operators import joins, quality, rollups
from callsift.session import settle


def frames(
    calls: DataFrame, call_summary: DataFrame, scores: DataFrame, transcripts: DataFrame,
    quality_log: DataFrame,
) -> dict[str, DataFrame]:
    """The dashboard's frames by name.

    Five of them need calls with their summaries; that join is shuffled and written once, and each
    frame then reads only its own columns of it.
    """
    facts = settle(joins.calls_with_summary(calls, call_summary), "facts")
    per_day = rollups.daily(facts)
    return {
        "calls": facts,
        "agents": rollups.by_score(rollups.agent_rollup(facts, with_range=True)),
        "overview": rollups.overview(facts),
        "resolutions": rollups.resolution_breakdown(facts),
        "issues": rollups.issue_volume(facts),
        "days": rollups.daily_trend(facts),
        "rolling": rollups.rolling_score(per_day),
        "changes": rollups.day_delta(per_day),
        "criteria": rollups.by_pass_rate(rollups.criteria_pass_rate(scores)),
        "heatmap": rollups.heatmap(scores),
        "scores": joins.scores_with_calls(scores, calls),
        "transcripts": transcripts,
        "quality_log": quality.severity_sort(quality_log),
    }
