"""Batch loads: document files into the stored tables, leaving known rows alone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsift import schemas
from callsift.functions.moments import moment
from callsift.functions.text import stable_key
from callsift.operators.transcripts import transcript_features
from callsift.sources import files, sinks

KEY = "contact_id"


def new_calls(stored: DataFrame, batch: DataFrame, small_batch: bool = False) -> DataFrame:
    """Calls of the batch that are not stored yet; of several, the first by file name."""
    new = sinks.unseen(stored, batch, KEY, files.FILE_NAME, small_batch)
    return new.select(*schemas.CALLS.names)


def load_calls(
    spark: SparkSession, path: str, out: str, run_ts: datetime, one_per_line: bool = False,
    rejects_out: str | None = None,
) -> None:
    """Add the calls of all document files below `path` to the table at `out`; what can't be read
    replaces the table at `rejects_out`."""
    sinks.ensure_table(spark, out, schemas.CALLS)
    details = files.read_call_details(spark, path, one_per_line)
    batch, rejects = files.parse_calls(details, run_ts, files.FILE_NAME)
    sinks.append(new_calls(files.read_table(spark, out, schemas.CALLS), batch), out)
    if rejects_out:
        sinks.overwrite(rejects, rejects_out)


def transcript_rows(parsed: DataFrame, run_ts: datetime) -> DataFrame:
    """Rows of the transcripts table from parsed transcripts."""
    stamped = transcript_features(parsed).withColumns({
        "transcript_id": stable_key(F.col(KEY)), "created_at": moment(run_ts),
    })
    return stamped.select(*[
        F.col(field.name).cast(field.dataType) for field in schemas.TRANSCRIPTS
    ])


def load_transcripts(spark: SparkSession, path: str, out: str, run_ts: datetime,
                     rejects_out: str | None = None) -> None:
    """Add the transcripts of all files below `path`, with their features, to the table at `out`; what
    can't be read replaces the table at `rejects_out`."""
    sinks.ensure_table(spark, out, schemas.TRANSCRIPTS)
    parsed, rejects = files.read_transcripts(spark, path)
    stored = files.read_table(spark, out, schemas.TRANSCRIPTS)
    sinks.append(sinks.unseen(stored, transcript_rows(parsed, run_ts), KEY, "transcript_id"), out)
    if rejects_out:
        sinks.overwrite(rejects, rejects_out)
