"""Scans: raw JSON documents, processed exports and stored tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsift import schemas
from callsift.functions import jsontext as js
from callsift.functions.moments import moment, wall_clock
from callsift.functions.numbers import EXACT
from callsift.plans.once import computed_once

FILE_NAME = "file_name"


def _whole(text: Column) -> Column:
    """A whole number written as 7, "7" or 7.0; null for anything else."""
    plain = F.trim(text)
    fraction = plain.try_cast("double")
    exact = F.when(fraction == F.floor(fraction), fraction).try_cast("bigint")
    return F.coalesce(plain.try_cast("bigint"), exact)


def _finite(text: Column) -> Column:
    """A number; null for anything else, for what is not a number and for infinity."""
    number = text.try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def _flag(text: Column) -> Column:
    """Missing, false, empty and zero are false, anything else is true."""
    plain = F.lower(F.trim(text))
    number = plain.try_cast("double")
    untrue = plain.isNull() | plain.isin("false", "") | F.coalesce(number == 0, F.lit(False))
    return ~untrue


def parse_calls(details: DataFrame, run_ts: datetime, *keep: str) -> tuple[DataFrame, DataFrame]:
    """Typed `calls` rows from raw call documents, in stored column order, and the rejects.

    Missing keys and explicit nulls both take the default; a bad start time becomes `run_ts`. A
    document that is no JSON, has no contact id, or holds a value that is no number where one belongs
    is a reject: (contact_id as text, content, reason). Columns named in `keep` follow unchanged in
    both.
    """
    run_at = moment(run_ts)

    def text(key: str, default: str) -> Column:
        return F.coalesce(F.col(key), F.lit(default))

    numbers = {
        "total_duration_sec": "totalDurationSeconds", "agent_seconds": "agentSeconds",
        "in_queue_seconds": "inQueueSeconds", "hold_seconds": "holdSeconds",
        "acw_seconds": "ACWSeconds",
    }
    typed = {
        "contact_id": _whole(F.col("contactId")),
        "agent_id": _whole(F.col("agentId")),
        **{name: _finite(F.trim(key)) for name, key in numbers.items()},
        "hold_count": _finite(F.trim("holdCount")).try_cast("int"),
    }
    sources = {"agent_id": "agentId", **numbers, "hold_count": "holdCount"}
    read = computed_once(details, **{f"_{name}": value for name, value in typed.items()})
    unread = [
        F.when(F.col(key).isNotNull() & F.col(f"_{name}").isNull(), F.lit(f"{key} is no number"))
        for name, key in sources.items()
    ]
    # Only the trimmed id decides whether there is one; 0 is how exports write none.
    no_id = F.coalesce(F.trim("contactId"), F.lit("")) == ""
    reason = F.coalesce(
        F.when(F.col(schemas.CORRUPT).isNotNull(), "no JSON"),
        F.when(no_id | (F.col("_contact_id") == 0), "no contact id"),
        F.when(F.col("_contact_id").isNull(), "contactId is no number"),
        *unread,
    )
    judged = computed_once(read, _reason=reason)
    rows = judged.filter("_reason IS NULL").select(
        F.col("_contact_id").alias("contact_id"),
        F.col("_agent_id").alias("agent_id"),
        text("campaignName", "Unknown").alias("campaign_name"),
        text("skillName", "Unknown").alias("skill_name"),
        text("teamName", "Unknown").alias("team_name"),
        text("firstName", "").alias("first_name"),
        text("lastName", "").alias("last_name"),
        text("fromAddr", "").alias("from_addr"),
        text("toAddr", "").alias("to_addr"),
        F.coalesce(wall_clock(F.col("contactStart")), run_at).alias("contact_start"),
        *[F.coalesce(f"_{name}", F.lit(0.0)).alias(name) for name in numbers],
        F.coalesce("_hold_count", F.lit(0)).alias("hold_count"),
        _flag(F.col("abandoned")).alias("is_abandoned"),
        _flag(F.col("isOutbound")).alias("is_outbound"),
        text("serviceLevelFlag", "0").alias("service_level_flag"),
        text("state", "Unknown").alias("state"),
        text("mediaTypeName", "Call").alias("media_type_name"),
        F.lit(False).alias("is_simulated"),
        run_at.alias("created_at"),
        *keep,
    )
    fields = [c for c in schemas.CALL_DETAIL.names if c != schemas.CORRUPT]
    rejects = judged.filter("_reason IS NOT NULL").select(
        F.col("contactId").alias("contact_id"),
        F.coalesce(schemas.CORRUPT, F.to_json(F.struct(*fields))).alias("content"),
        F.col("_reason").alias("reason"), *keep,
    )
    return rows, rejects


def calls_from_details(details: DataFrame, run_ts: datetime, *keep: str) -> DataFrame:
    """The readable calls of `parse_calls`."""
    return parse_calls(details, run_ts, *keep)[0]


def read_call_details(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Raw call documents and the file each came from: one (or a list) per file, or one per line,
    which lets Spark split files."""
    reader = spark.read.schema(schemas.CALL_DETAIL).option("multiLine", not one_per_line)
    return with_file_name(reader.option("columnNameOfCorruptRecord", schemas.CORRUPT).json(path))


def with_file_name(scan: DataFrame) -> DataFrame:
    return scan.select("*", F.col("_metadata.file_name").alias(FILE_NAME))


def read_calls(
    spark: SparkSession, path: str, run_ts: datetime, one_per_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Calls and rejects of all document files below `path`."""
    return parse_calls(read_call_details(spark, path, one_per_line), run_ts)


def listed_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, n_bytes) of all files below a folder whose name matches; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("length").alias("n_bytes"))


def details_from_text(df: DataFrame, text_col: str) -> DataFrame:
    """Raw call documents held as text in a column instead of in files."""
    parsed = F.from_json(
        text_col, schemas.CALL_DETAIL, {"columnNameOfCorruptRecord": schemas.CORRUPT}
    )
    return computed_once(df, doc=parsed).select("doc.*")


def parse_transcripts(df: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(contact_id, agent_text, customer_text) from documents keyed by call id, and the rejects: the
    (contact_id as text, content, reason) of documents and entries that can't be read."""
    pair = computed_once(df.select(F.col(text_col).alias("content")), _pair=js.wrapped(F.col("content")))
    opened = computed_once(pair, _doc=js.unwrapped(F.col("_pair"))).drop("_pair")
    calls = F.try_variant_get("_doc", "$", schemas.TRANSCRIPT_DOC)
    read = computed_once(opened.select("content", calls.alias("_calls")), _entries=F.map_entries("_calls"))
    entries = computed_once(
        read.filter("_entries IS NOT NULL").select(F.explode("_entries").alias("_entry")),
        contact_id=_whole(F.col("_entry.key")),
    )
    rows = entries.filter("contact_id IS NOT NULL").select(
        "contact_id",
        F.col("_entry.value.agent_conversation").alias("agent_text"),
        F.col("_entry.value.customer_conversation").alias("customer_text"),
    )
    nothing = F.lit(None).cast("string").alias("contact_id")
    unread = read.filter("_entries IS NULL").select(
        nothing, "content", F.lit("no map of calls").alias("reason")
    )
    unnamed = entries.filter("contact_id IS NULL").select(
        F.col("_entry.key").alias("contact_id"), F.to_json("_entry.value").alias("content"),
        F.lit("contact id is no number").alias("reason"),
    )
    return rows, unread.unionByName(unnamed)


def transcripts_from_text(df: DataFrame, text_col: str) -> DataFrame:
    """The readable transcripts of `parse_transcripts`."""
    return parse_transcripts(df, text_col)[0]


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Transcripts and rejects; a file holds one call or a few, so it is read whole."""
    return parse_transcripts(spark.read.text(path, wholetext=True), "value")


def rubric_from_text(df: DataFrame, text_col: str) -> DataFrame:
    """One row per criterion from nested configuration text; weights multiply down the tree."""
    config = F.from_json(text_col, T.DataType.fromDDL(schemas.RUBRIC_CONFIG))
    sections = df.select(
        F.explode(config["quality_framework"]).alias("section_name", "section")
    )
    rows = sections.select(
        "section_name", "section", F.explode("section.criteria").alias("criteria_name", "rule")
    )
    product = F.col("section.weight").cast(EXACT) * F.col("rule.weight").cast(EXACT)
    return rows.select(
        "section_name",
        "criteria_name",
        F.col("section.weight").alias("section_weight"),
        F.col("rule.weight").alias("criteria_weight"),
        F.round(product, 6).cast("double").alias("effective_weight"),
        (
            F.coalesce("section.enabled", F.lit(True)) & F.coalesce("rule.enabled", F.lit(True))
        ).alias("enabled"),
        F.col("rule.what").alias("what_to_check"),
        F.col("rule.when").alias("when_to_check"),
        F.col("rule.good_example").alias("good_example"),
        F.col("rule.bad_example").alias("bad_example"),
        F.col("rule.check_keywords").alias("check_keywords"),
        F.col("rule.scoring").alias("scoring_method"),
    )


def read_rubric(spark: SparkSession, path: str) -> DataFrame:
    return rubric_from_text(spark.read.text(path, wholetext=True), "value")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A stored table. With a schema no file is opened while planning."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A processed export with a header line; quoted fields may span lines."""
    options = {"header": True, "multiLine": True, "escape": '"'}
    return spark.read.schema(schema).options(**options).csv(path)
