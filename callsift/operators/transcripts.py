"""Transcript columns: word counts, talk ratio, full text, dialogue, normal form, cut text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.functions import text as tx
from callsift.functions.numbers import talk_share


def transcript_features(transcripts: DataFrame) -> DataFrame:
    """Word counts per speaker, the agent's share of all words, and both texts joined."""
    counted = transcripts.withColumns({
        "agent_word_count": tx.word_count(F.col("agent_text")),
        "customer_word_count": tx.word_count(F.col("customer_text")),
    })
    agent, customer = (F.coalesce(c, F.lit("")) for c in ("agent_text", "customer_text"))
    return counted.withColumns({
        "talk_ratio": talk_share(F.col("agent_word_count"), F.col("customer_word_count")),
        "full_text": F.concat(agent, F.lit(" "), customer),
    })


def format_dialogue(transcripts: DataFrame) -> DataFrame:
    """(contact_id, formatted_text) with both sides labelled."""
    formatted = tx.dialogue(F.col("agent_text"), F.col("customer_text"))
    return transcripts.select("contact_id", formatted.alias("formatted_text"))


def normalize_text(df: DataFrame, col: str, to: str = "normalized") -> DataFrame:
    return df.withColumn(to, tx.normalized(F.col(col)))


def truncate(df: DataFrame, col: str, n: int, to: str | None = None) -> DataFrame:
    """`df` with the first n characters of a text, in place or as a new column."""
    return df.withColumn(to or col, tx.head(F.col(col), n))
