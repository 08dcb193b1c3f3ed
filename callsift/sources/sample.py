"""The provided benchmark tables seen as the call-centre tables.

Every view is a projection of one table without a shuffle, except `rubric`, which aggregates the
line items to their seven criteria.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsift.operators.transcripts import transcript_features
from callsift.plans.once import computed_once
from callsift.schemas import flat

# Invented rules 1-7 with section and weight in basis points (section, share, effective).
SECTION_1 = "Opening"
SECTION_2 = "Handling"
CRITERIA = [
    (1, SECTION_1, "Says a name", 4000, 2500, 1000),
    (2, SECTION_1, "Asks for the order", 4000, 2500, 1000),
    (3, SECTION_1, "Repeats the request", 4000, 5000, 2000),
    (4, SECTION_2, "Lets the customer finish", 5000, 2000, 1000),
    (5, SECTION_2, "Names the next step", 5000, 4000, 2000),
    (6, SECTION_2, "Explains a pause", 5000, 1500, 750),
    (7, SECTION_2, "Offers a call back", 5000, 1500, 750),
]
ISSUES = {
    "1-URGENT": "Technical Issue",
    "2-HIGH": "Account Access",
    "3-MEDIUM": "Billing",
    "5-LOW": "Software Request",
}
RESOLUTIONS = {"F": "Resolved", "O": "Escalated", "P": "Unresolved"}

SCHEMAS = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_acctbal DOUBLE",
    "benchmark": "item_id BIGINT, text STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A provided table with its declared schema."""
    return spark.read.schema(flat(SCHEMAS[name])).parquet(f"{folder}/{name}.parquet")


def choose(value: Column, options: dict) -> Column:
    chain = F
    for key, label in options.items():
        chain = chain.when(value == key, label)
    return chain.otherwise(None)


def calls(spark: SparkSession, folder: str) -> DataFrame:
    key, agent = F.col("o_orderkey"), F.col("o_custkey")

    def numbered(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(prefix), value.cast("string"))

    return table(spark, folder, "orders").select(
        key.alias("contact_id"),
        agent.alias("agent_id"),
        F.when(key % 11 != 0, numbered("Campaign ", agent % 7)).alias("campaign_name"),
        numbered("Skill ", key % 3).alias("skill_name"),
        numbered("Team ", agent % 5).alias("team_name"),
        F.lit("Agent").alias("first_name"),
        agent.cast("string").alias("last_name"),
        numbered("+1", agent).alias("from_addr"),
        numbered("+2", key).alias("to_addr"),
        F.col("o_orderdate").alias("contact_start"),
        F.col("o_totalprice").alias("total_duration_sec"),
        (key * 13 % 2400).cast("double").alias("agent_seconds"),
        (key * 17 % 120).cast("double").alias("in_queue_seconds"),
        (key * 37 % 3000).cast("double").alias("hold_seconds"),
        (key * 7 % 60).cast("double").alias("acw_seconds"),
        (key % 4).cast("int").alias("hold_count"),
        (key % 29 == 0).alias("is_abandoned"),
        (key % 5 == 0).alias("is_outbound"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "1").otherwise("0")
        .alias("service_level_flag"),
        F.lit("EndContact").alias("state"),
        F.lit("Call").alias("media_type_name"),
        (key % 10 == 9).alias("is_simulated"),
        F.col("o_orderdate").alias("created_at"),
    )


def call_summary(spark: SparkSession, folder: str) -> DataFrame:
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5)
    outcome = choose(F.col("o_orderstatus"), RESOLUTIONS)
    resolution = F.when(key % 31 == 0, None).when(key % 29 == 0, "Abandoned").otherwise(outcome)
    issue = choose(priority, ISSUES)
    return table(spark, folder, "orders").select(
        key.alias("contact_id"),
        issue.alias("issue_category"),
        F.concat(F.lit("About "), priority).alias("issue_description"),
        resolution.alias("resolution"),
        F.when(key % 3 == 0, "Positive").when(key % 3 == 1, "Neutral").otherwise("Negative")
        .alias("sentiment_agent"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), "Positive")
        .when(priority == "3-MEDIUM", "Neutral").otherwise("Negative")
        .alias("sentiment_customer"),
        (cents % 10001 / F.lit(100.0)).alias("overall_score"),
        F.concat(F.lit("Moment "), key.cast("string")).alias("key_moments"),
        F.lit(None).cast("string").alias("ai_recommendation"),
        F.col("o_orderdate").alias("created_at"),
        F.when(key % 6 == 0, "Billing").otherwise(issue).alias("pred_issue_category"),
        F.when(key % 7 == 0, "Resolved").otherwise(outcome).alias("pred_resolution"),
    )


def criterion(position: int, of: Column) -> Column:
    return choose(of, {row[0]: row[position] for row in CRITERIA})


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("l_linenumber")
    passed = F.when(F.col("l_quantity") != 1, F.col("l_returnflag") != "R")
    weight = criterion(5, number) / F.lit(10000.0)
    return table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("score_id"),
        F.col("l_orderkey").alias("contact_id"),
        F.col("l_suppkey").alias("agent_id"),
        criterion(1, number).alias("section_name"),
        criterion(2, number).alias("criteria_name"),
        F.when(passed, weight).otherwise(F.lit(0.0)).alias("score"),
        passed.alias("passed"),
        F.concat(F.lit("flag "), "l_returnflag").alias("reasoning"),
        F.lit("auditor").alias("scored_by"),
        F.col("l_shipdate").alias("evaluated_at"),
    )


def rubric(spark: SparkSession, folder: str) -> DataFrame:
    """The rules met in the line items; the last one has no section, the sixth is disabled."""
    number = F.col("l_linenumber")
    seen = table(spark, folder, "lineitem").groupBy(number).agg(
        F.max("l_shipdate").alias("updated_at")
    )
    return seen.select(
        F.concat(F.lit("R"), number.cast("string")).alias("framework_id"),
        F.when(number != 7, criterion(1, number)).alias("section_name"),
        criterion(2, number).alias("criteria_name"),
        (criterion(3, number) / F.lit(10000.0)).alias("section_weight"),
        (criterion(4, number) / F.lit(10000.0)).alias("criteria_weight"),
        (criterion(5, number) / F.lit(10000.0)).alias("effective_weight"),
        (number != 6).alias("enabled"),
        F.concat(F.lit("check "), number.cast("string")).alias("what_to_check"),
        F.lit("always").alias("when_to_check"),
        F.concat(F.lit("good "), number.cast("string")).alias("good_example"),
        F.concat(F.lit("bad "), number.cast("string")).alias("bad_example"),
        F.lit("binary").alias("scoring_method"),
        "updated_at",
    )


def rules(spark: SparkSession, folder: str) -> DataFrame:
    """A rule table that grows with the data: one rule per part."""
    key = F.col("p_partkey")
    cents = F.floor(F.col("p_retailprice") * 100 + 0.5)
    return table(spark, folder, "part").select(
        F.concat(F.lit("P"), key.cast("string")).alias("framework_id"),
        F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("section_name"),
        F.concat_ws(" ", "p_brand", "p_name").alias("criteria_name"),
        (F.col("p_size") / F.lit(50.0)).alias("section_weight"),
        (cents % 100 / F.lit(100.0)).alias("criteria_weight"),
        (cents % 20000 / F.lit(10000.0)).alias("effective_weight"),
        (F.col("p_size") > 5).alias("enabled"),
        F.concat(F.lit("check "), "p_name").alias("what_to_check"),
        F.lit("always").alias("when_to_check"),
        F.lit("good").alias("good_example"),
        F.lit("bad").alias("bad_example"),
        F.lit("binary").alias("scoring_method"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"),
    )


def speaker_sides(text: Column) -> tuple[Column, Column]:
    """Odd lines belong to the customer, even lines to the agent; an absent side is null."""
    lines = F.split(text, "\n")

    def side(remainder: int) -> Column:
        chosen = F.filter(lines, lambda _, i: i % 2 == remainder)
        return F.nullif(F.array_join(chosen, " "), F.lit(""))

    return side(1), side(0)


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """One transcript per document; its full text is null where a side is absent."""
    documents = table(spark, folder, "documents").select(
        F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("transcript_id"),
        F.col("doc_id").alias("contact_id"), "text",
    )
    agent, customer = speaker_sides(F.col("text"))
    sides = computed_once(documents, agent_text=agent, customer_text=customer).drop("text")
    joined = F.concat("agent_text", F.lit(" "), "customer_text")
    return transcript_features(sides).withColumn("full_text", joined)


TABLES = {
    "calls": calls,
    "call_summary": call_summary,
    "quality_scores": quality_scores,
    "rubric": rubric,
    "rules": rules,
    "transcripts": transcripts,
}
