"""Data-quality log, load audit and table profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsift.functions.labels import severity_rank
from callsift.functions.numbers import exact_avg, exact_sum
from callsift.functions.text import stable_key
from callsift.plans.dedupe import distinct_keys

KEY = "contact_id"
# Column names that count as scores.
SCORE_NAMES = ("score", "quality_score", "avg_score", "total_score", "qs")


def _issue(condition: Column, field: str, kind: str, text: Column, severity: str) -> Column:
    entry = F.struct(
        F.lit(field).alias("field_name"),
        F.lit(kind).alias("issue_type"),
        text.alias("issue_description"),
        F.lit(severity).alias("severity"),
    )
    return F.when(condition, entry)


def _logged(df: DataFrame, *issues: Column) -> DataFrame:
    """All issues of a row in one pass over the table."""
    found = df.select(KEY, F.explode(F.array_compact(F.array(*issues))).alias("issue"))
    rows = found.select(KEY, "issue.*")
    key = stable_key(F.col(KEY), F.col("field_name"), F.col("issue_type"))
    return rows.select(key.alias("log_id"), *rows.columns)


def call_issues(calls: DataFrame, max_hold: float = 1000.0) -> DataFrame:
    """Issues visible in a call row: missing notes and overlong holds."""
    hold = F.col("hold_seconds")
    return _logged(
        calls,
        _issue(
            F.coalesce("disposition_notes", F.lit("")) == "",
            "dispositionNotes", "missing", F.lit("No disposition notes"), "low",
        ),
        _issue(
            hold > max_hold, "holdSeconds", "outlier",
            F.concat(F.lit("Long hold: "), hold.cast("string"), F.lit("s")), "high",
        ),
    )


def transcript_issues(transcripts: DataFrame, min_ratio: float = 0.25) -> DataFrame:
    """Issues visible in a transcript row: an agent who hardly speaks."""
    ratio = F.col("talk_ratio")
    percent = F.bround(ratio * 100, 0).cast("int").cast("string")
    text = F.concat(F.lit("Agent only "), percent, F.lit("%"))
    return _logged(
        transcripts, _issue(ratio < min_ratio, "talk_ratio", "outlier", text, "medium")
    )


def quality_log(
    calls: DataFrame, transcripts: DataFrame, max_hold: float = 1000.0, min_ratio: float = 0.25
) -> DataFrame:
    """Every rule violation of calls (with `disposition_notes`) and transcripts."""
    return call_issues(calls, max_hold).unionByName(transcript_issues(transcripts, min_ratio))


def severity_sort(log: DataFrame) -> DataFrame:
    """Worst first, with the rank that decides."""
    ranked = log.withColumn("severity_rank", severity_rank(F.col("severity")))
    return ranked.orderBy("severity_rank", KEY, "field_name")


def quality_summary(log: DataFrame) -> DataFrame:
    """Issues by severity and in total."""
    counts = log.rollup("severity").agg(F.count("*").alias("issues"))
    return counts.select(F.coalesce("severity", F.lit("total")).alias("severity"), "issues")


def load_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and, given calls and transcripts, the calls that have both."""

    def counted(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.lit(name).alias("item"), F.count("*").alias("row_count"))

    parts = [counted(name, df) for name, df in tables.items()]
    if {"calls", "transcripts"} <= set(tables):
        calls, transcripts = tables["calls"], tables["transcripts"]
        pairs = calls.select(KEY).join(distinct_keys(transcripts, KEY), KEY, "left_semi")
        parts.append(counted("matched pairs", pairs))
    return reduce(DataFrame.unionByName, parts)


def file_audit(details: DataFrame, transcripts: DataFrame, call_of: str = r"([^/]+)\.[^./]+$") -> DataFrame:
    """Files, their bytes, and calls with both kinds of files, from two `files.listed_files`.

    `call_of` is the pattern whose group is the call's id in a path.
    """
    def ids(listed: DataFrame, kind: str) -> DataFrame:
        return listed.select(F.lit(kind).alias("kind"), F.regexp_extract("path", call_of, 1).alias("id"), "n_bytes")

    def of(kind: str, value: Column) -> Column:
        return F.sum(F.when(F.col("kind") == kind, value).otherwise(0))

    one = F.lit(1).cast("bigint")
    each = ids(details, "detail").unionByName(ids(transcripts, "talk")).groupBy("id").agg(
        of("detail", one).alias("details"), of("detail", F.col("n_bytes")).alias("detail_bytes"),
        of("talk", one).alias("talks"), of("talk", F.col("n_bytes")).alias("talk_bytes"),
    )
    paired = (F.col("details") > 0) & (F.col("talks") > 0)

    def item(name: str, files: Column, n_bytes: Column) -> Column:
        return F.struct(
            F.lit(name).alias("item"), F.coalesce(F.sum(files), F.lit(0)).cast("bigint").alias("n_files"),
            F.coalesce(F.sum(n_bytes), F.lit(0)).cast("bigint").alias("n_bytes"),
        )

    items = each.agg(F.array(
        item("call detail files", F.col("details"), F.col("detail_bytes")),
        item("transcript files", F.col("talks"), F.col("talk_bytes")),
        item("matched pairs", F.when(paired, one), F.when(paired, F.col("detail_bytes"))),
    ).alias("items"))
    return items.select(F.inline("items"))


def profile(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Columns, rows, date ranges and score statistics of a table from one pass over it; of all date
    and score columns, or of the first `most` of each."""
    moments = (T.DateType, T.TimestampType, T.TimestampNTZType)
    dates = [f.name for f in df.schema if isinstance(f.dataType, moments)][:most]
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    scores = [c for c in numeric if c.lower() in SCORE_NAMES][:most]
    measures = [F.count("*").alias("_rows")]
    for i, c in enumerate(dates):
        measures += [F.min(c).alias(f"_d{i}_min"), F.max(c).alias(f"_d{i}_max")]
    for i, c in enumerate(scores):
        mean = exact_sum(F.col(c)) / F.count(c)
        # Nine digits after the point, but a small mean keeps its own.
        average = F.when(F.abs(mean) < 1e-6, mean).otherwise(exact_avg(F.col(c), 9))
        stats = (F.min(c).alias(f"_s{i}_min"), average.alias(f"_s{i}_avg"))
        measures += [*stats, F.max(c).alias(f"_s{i}_max")]

    def entry(column: str, kind: str, first=None, last=None, low=None, avg=None, high=None):
        def pick(source: str | None, to: str) -> Column:
            return (F.col(source) if source else F.lit(None)).cast(to)

        return F.struct(
            F.lit(column).alias("column_name"), F.lit(kind).alias("kind"),
            pick(first, "timestamp_ntz").alias("first_value"),
            pick(last, "timestamp_ntz").alias("last_value"),
            pick(low, "double").alias("min_value"), pick(avg, "double").alias("avg_value"),
            pick(high, "double").alias("max_value"),
        )

    entries = [entry(",".join(df.columns), "columns")]
    entries += [entry(c, "dates", f"_d{i}_min", f"_d{i}_max") for i, c in enumerate(dates)]
    entries += [
        entry(c, "scores", low=f"_s{i}_min", avg=f"_s{i}_avg", high=f"_s{i}_max")
        for i, c in enumerate(scores)
    ]
    rows = df.agg(*measures).select("_rows", F.inline(F.array(*entries)))
    return rows.select(
        F.lit(name).alias("table_name"), F.col("_rows").alias("row_count"),
        *[c for c in rows.columns if c != "_rows"],
    )
