"""Declared schemas: the stored tables and the raw JSON documents."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "DATE": T.DateType(), "ARRAY<FLOAT>": T.ArrayType(T.FloatType()),
}


def flat(columns: str) -> T.StructType:
    """A schema from "name TYPE, ..." that, unlike fromDDL, needs no running session."""
    pairs = [column.split() for column in columns.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CALLS = flat(
    "contact_id BIGINT, agent_id BIGINT, campaign_name STRING, skill_name STRING, team_name STRING, "
    "first_name STRING, last_name STRING, from_addr STRING, to_addr STRING, "
    "contact_start TIMESTAMP_NTZ, total_duration_sec DOUBLE, agent_seconds DOUBLE, "
    "in_queue_seconds DOUBLE, hold_seconds DOUBLE, acw_seconds DOUBLE, hold_count INT, "
    "is_abandoned BOOLEAN, is_outbound BOOLEAN, service_level_flag STRING, state STRING, "
    "media_type_name STRING, is_simulated BOOLEAN, created_at TIMESTAMP_NTZ"
)

TRANSCRIPTS = flat(
    "transcript_id STRING, contact_id BIGINT, agent_text STRING, customer_text STRING, "
    "full_text STRING, agent_word_count INT, customer_word_count INT, talk_ratio DOUBLE, "
    "created_at TIMESTAMP_NTZ"
)

AGENTS = flat(
    "agent_id BIGINT, team_name STRING, skill_name STRING, total_calls BIGINT, "
    "avg_quality_score DOUBLE, avg_handle_time DOUBLE, last_call_date TIMESTAMP_NTZ, "
    "updated_at TIMESTAMP_NTZ"
)

QUALITY_SCORES = flat(
    "score_id STRING, contact_id BIGINT, agent_id BIGINT, section_name STRING, "
    "criteria_name STRING, score DOUBLE, passed BOOLEAN, reasoning STRING, scored_by STRING, "
    "evaluated_at TIMESTAMP_NTZ"
)

CALL_SUMMARY = flat(
    "contact_id BIGINT, issue_category STRING, issue_description STRING, resolution STRING, "
    "sentiment_agent STRING, sentiment_customer STRING, overall_score DOUBLE, key_moments STRING, "
    "ai_recommendation STRING, created_at TIMESTAMP_NTZ, pred_issue_category STRING, "
    "pred_resolution STRING"
)

RUBRIC = flat(
    "framework_id STRING, section_name STRING, criteria_name STRING, section_weight DOUBLE, "
    "criteria_weight DOUBLE, effective_weight DOUBLE, enabled BOOLEAN, what_to_check STRING, "
    "when_to_check STRING, good_example STRING, bad_example STRING, scoring_method STRING, "
    "updated_at TIMESTAMP_NTZ"
)

DATA_QUALITY_LOG = flat(
    "log_id STRING, contact_id BIGINT, field_name STRING, issue_type STRING, "
    "issue_description STRING, severity STRING, logged_at TIMESTAMP_NTZ"
)

AI_SUMMARY = flat(
    "contact_id BIGINT, agent_id BIGINT, summary STRING, strengths STRING, improvements STRING, "
    "failed_criteria STRING, model_name STRING, version INT, created_at TIMESTAMP_NTZ"
)

# Raw documents. Only the keys that feed a table are declared, so the JSON reader skips the rest. Every
# value is read as text: documents quote numbers or write whole ones as 2.0, and a typed reader would
# turn what it can't read into null.
CORRUPT = "_corrupt_record"
CALL_DETAIL = flat(
    "contactId STRING, agentId STRING, campaignName STRING, skillName STRING, teamName STRING, "
    "firstName STRING, lastName STRING, fromAddr STRING, toAddr STRING, contactStart STRING, "
    "totalDurationSeconds STRING, agentSeconds STRING, inQueueSeconds STRING, holdSeconds STRING, "
    "ACWSeconds STRING, holdCount STRING, abandoned STRING, isOutbound STRING, "
    "serviceLevelFlag STRING, state STRING, mediaTypeName STRING, dispositionNotes STRING, "
    f"{CORRUPT} STRING"
)

TRANSCRIPT_DOC = "map<string, struct<agent_conversation: string, customer_conversation: string>>"

RUBRIC_CONFIG = (
    "struct<quality_framework: map<string, struct<weight: double, enabled: boolean, "
    "criteria: map<string, struct<weight: double, enabled: boolean, `when`: string, what: string, "
    "good_example: string, bad_example: string, check_keywords: array<string>, scoring: string>>>>>"
)
