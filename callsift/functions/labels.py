"""Codes and labels derived from single columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label codes and the order of severities.
SENTIMENT_CODE = {"Positive": 2, "Neutral": 1, "Negative": 0}
ISSUE_CODE = {"Technical Issue": 0, "Account Access": 1, "Billing": 2, "Software Request": 3}
SEVERITY_ORDER = {"high": 1, "medium": 2}
SEVERITY_LAST = 3
RISK_LABEL = "CRITICAL BUSINESS RISK"


def _code(value: Column, codes: dict[str, int], default: int) -> Column:
    chain = F
    for label, code in codes.items():
        chain = chain.when(value == label, code)
    return chain.otherwise(default)


def sentiment_code(value: Column) -> Column:
    return _code(value, SENTIMENT_CODE, SENTIMENT_CODE["Neutral"])


def issue_code(value: Column) -> Column:
    return _code(value, ISSUE_CODE, 0)


def sla_code(flag: Column) -> Column:
    return F.when(flag == "1", 1).otherwise(0)


def severity_rank(severity: Column) -> Column:
    return _code(severity, SEVERITY_ORDER, SEVERITY_LAST)


def risk_label(passed: Column, weight: Column, threshold: float) -> Column:
    """Label for a failed criterion above the weight threshold, null otherwise."""
    failed = ~F.coalesce(passed, F.lit(False))
    return F.when(failed & (weight > threshold), F.lit(RISK_LABEL))
