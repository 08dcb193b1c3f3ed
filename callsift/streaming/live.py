"""Structured Streaming forms: ingest, daily metrics and the quality log.

Every write of a micro-batch can be repeated after a failure without changing the result.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callsift import schemas
from callsift.functions.numbers import exact_sum, ratio
from callsift.operators import quality
from callsift.plans import loads
from callsift.sources import files, keyed, sinks

EPOCH, DAY = "1970-01-01", 86_400
DAILY = schemas.flat("year STRING, day DATE, issue_category STRING, calls BIGINT, avg_score DOUBLE")


def _run(writer, trigger_seconds: int | None) -> StreamingQuery:
    if trigger_seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{trigger_seconds} seconds").start()


def details_stream(spark: SparkSession, folder: str, one_per_line: bool = False) -> DataFrame:
    """New call-document files as they arrive: one document per file, or one per line."""
    reader = spark.readStream.schema(schemas.CALL_DETAIL).option("multiLine", not one_per_line)
    return files.with_file_name(
        reader.option("columnNameOfCorruptRecord", schemas.CORRUPT).json(folder)
    )


def transcripts_stream(spark: SparkSession, folder: str, one_per_line: bool = False) -> DataFrame:
    """New transcript files as they arrive: a file is one document, or holds one per line."""
    return spark.readStream.option("wholetext", not one_per_line).text(folder)


def _keep_rejects(rejects: DataFrame, out: str | None, batch: int) -> None:
    """Store the rejects of a batch under its number, so that a repeated batch replaces them."""
    if out:
        sinks.overwrite(rejects, f"{out}/batch={batch}")


def start_ingest(
    spark: SparkSession, folder: str, out: str, checkpoint: str, run_ts: datetime | None = None,
    trigger_seconds: int | None = None, one_per_line: bool = False, rejects_out: str | None = None,
) -> StreamingQuery:
    """Add calls of new files to the table at `out`, which `keyed.read` reads; a call already there is left
    alone.

    Within a batch the first file by name wins. A repeated batch finds its calls in the table and
    adds nothing. Without `run_ts` every batch is stamped with the time it runs at. Unreadable
    documents go to `rejects_out`. A trigger reads the key filters of its calls' folders, and keys only
    where a call may be stored already; see `keyed`.
    """
    keyed.ensure(spark, out)

    def add(batch: DataFrame, number: int) -> None:
        at = run_ts or datetime.now(UTC)
        batch = batch.persist()  # read once for both writes
        try:
            calls, rejects = files.parse_calls(batch, at, files.FILE_NAME)
            keyed.insert_ignore(calls, out, schemas.CALLS, loads.KEY, files.FILE_NAME)
            _keep_rejects(rejects, rejects_out, number)
        finally:
            batch.unpersist()

    details = details_stream(spark, folder, one_per_line)
    writer = details.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return _run(writer, trigger_seconds)


def start_transcripts(
    spark: SparkSession, folder: str, out: str, checkpoint: str, run_ts: datetime | None = None,
    trigger_seconds: int | None = None, one_per_line: bool = False, rejects_out: str | None = None,
) -> StreamingQuery:
    """Add transcripts of new files, with their features, to the table at `out`, which `keyed.read` reads;
    a call that has one is left alone."""
    keyed.ensure(spark, out)

    def add(batch: DataFrame, number: int) -> None:
        parsed, rejects = files.parse_transcripts(batch, "value")
        rows = loads.transcript_rows(parsed, run_ts or datetime.now(UTC))
        keyed.insert_ignore(rows, out, schemas.TRANSCRIPTS, loads.KEY, "transcript_id")
        _keep_rejects(rejects, rejects_out, number)

    texts = transcripts_stream(spark, folder, one_per_line)
    writer = texts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return _run(writer, trigger_seconds)


def _as_utc(wall_clock: Column) -> Column:
    """A time without zone as TIMESTAMP, read as UTC whatever the session's zone: windows of a day
    start at midnight UTC, and watermarks refuse times without zone."""
    days = F.datediff(wall_clock.cast("date"), F.lit(EPOCH).cast("date")).cast("bigint")
    clock = F.hour(wall_clock) * 3600 + F.minute(wall_clock) * 60 + F.second(wall_clock)
    return F.timestamp_seconds(days * DAY + clock)


def daily_metrics_stream(stream: DataFrame, delay: str | None = "1 day") -> DataFrame:
    """Calls, calls per category and average score per day and category of a summary stream.

    The stream holds contact_start, issue_category and overall_score. With a delay, days that are
    older than it are closed and late rows dropped; None keeps all days open, for complete output.
    """
    timed = stream.withColumn("at", _as_utc(F.col("contact_start")))
    if delay is not None:
        timed = timed.withWatermark("at", delay)
    day = F.date_add(F.lit(EPOCH).cast("date"), F.floor(F.unix_seconds("w.start") / DAY).cast("int"))
    grouped = timed.groupBy(F.window("at", "1 day").alias("w"), "issue_category").agg(
        F.count("*").alias("calls"),
        F.count("overall_score").alias("scored"),
        exact_sum(F.col("overall_score")).alias("score_sum"),
    )
    return grouped.select(
        day.alias("day"), "issue_category", "calls",
        ratio(F.col("score_sum"), F.col("scored"), 1).alias("avg_score"),
    )


def start_daily_metrics(
    stream: DataFrame, out: str, checkpoint: str, trigger_seconds: int | None = None,
    delay: str = "7 days",
) -> StreamingQuery:
    """Keep the daily table at `out` current; `read_daily` reads it.

    State holds the days of the last `delay` only: older ones are closed and leave it, and a row that comes
    later still is dropped. A batch hands on the groups it has changed, which replace theirs in the folder
    of their year, some hundred small rows; other years are not touched, and a repeated batch changes
    nothing. A new checkpoint counts anew and replaces the groups that it meets.
    """

    def merge(batch: DataFrame, number: int) -> None:
        by_year = batch.select(F.date_format("day", "yyyy").alias("year"), "*")
        keyed.merge_parts(by_year, out, "year", ["day", "issue_category"], checkpoint, number)

    metrics = daily_metrics_stream(stream, delay)
    writer = (
        metrics.writeStream.outputMode("update").foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
    )
    return _run(writer, trigger_seconds)


def read_daily(spark: SparkSession, out: str) -> DataFrame:
    """The daily table as it now is."""
    return keyed.read_parts(spark, out, DAILY, "year").drop("year")


def quality_log_stream(calls: DataFrame, max_hold: float = 1000.0) -> DataFrame:
    """The call rules of the quality log on a stream of calls; needs no state."""
    return quality.call_issues(calls, max_hold)


def talk_log_stream(transcripts: DataFrame, min_ratio: float = 0.25) -> DataFrame:
    """The transcript rule of the quality log on a stream of transcripts with their features."""
    return quality.transcript_issues(transcripts, min_ratio)


def start_log(
    issues: DataFrame, out: str, checkpoint: str, trigger_seconds: int | None = None
) -> StreamingQuery:
    """Append streamed issues to the log at `out`; the file sink drops repeated batches."""
    writer = (
        issues.writeStream.outputMode("append").format("parquet")
        .option("path", out).option("checkpointLocation", checkpoint)
    )
    return _run(writer, trigger_seconds)


def start_quality_log(
    calls: DataFrame, out: str, checkpoint: str, trigger_seconds: int | None = None
) -> StreamingQuery:
    """Append the issues of new calls to the log at `out`."""
    return start_log(quality_log_stream(calls), out, checkpoint, trigger_seconds)
