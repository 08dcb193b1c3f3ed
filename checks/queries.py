"""One Spark query per operator over the provided tables; `checks.oracle` holds the same as SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.ml import Pipeline
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsift import schemas
from callsift.operators import features as ft
from callsift.operators import joins as jn
from callsift.operators import quality as ql
from callsift.operators import retrieval as rt
from callsift.operators import rollups as ru
from callsift.operators import rubric as rb
from callsift.operators import scoring as sc
from callsift.operators import textindex as ti
from callsift.operators import training as tr
from callsift.operators import transcripts as ts
from callsift.operators import vectorindex as vi
from callsift.plans import audit as au
from callsift.plans import context as cx
from callsift.plans import days as ds
from callsift.plans.dedupe import first_match
from callsift.session import scratch_path, settle
from callsift.sources import files, keyed, sample, sinks
from callsift.streaming import live
from checks.inputs import (
    KEY, audit_responses, detail_documents, first_sentences, keyword_rubric, label_centres,
    letter_profile, lexicon, noted_calls, obedient_judge, rubric_document, score_responses, search_documents,
    search_queries, summary_responses, training, transcript_documents, view,
)

RUN_TS = datetime(2026, 1, 1)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return keep


def over(name: str, *tables: str):
    """Register a function of the named views."""

    def keep(fn: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(*[view(spark, folder, t) for t in tables])
        return fn

    return keep


# Scans and sinks.

@query("scan_call_details")
def _(spark, folder):
    details = files.details_from_text(detail_documents(spark, folder), "document")
    return files.calls_from_details(details, RUN_TS)


@query("scan_transcripts")
def _(spark, folder):
    return files.transcripts_from_text(transcript_documents(spark, folder), "document")


@query("scan_call_detail_errors")
def _(spark, folder):
    details = files.details_from_text(detail_documents(spark, folder), "document")
    _, rejects = files.parse_calls(details, RUN_TS)
    known = F.when(F.col("reason") != "no JSON", F.col("contact_id"))
    return rejects.select(known.alias("contact_id"), "reason")


@query("scan_transcript_errors")
def _(spark, folder):
    return files.parse_transcripts(transcript_documents(spark, folder), "document")[1]


@query("scan_rubric_config")
def _(spark, folder):
    rules = files.rubric_from_text(rubric_document(spark, folder), "document")
    return rules.withColumn("check_keywords", F.array_join("check_keywords", ","))


@query("scan_table")
def _(spark, folder):
    schema = sample.table(spark, folder, "orders").schema
    return files.read_table(spark, f"{folder}/orders.parquet", schema)


def _as_batch(spark, folder):
    return sample.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias(KEY), F.col("l_suppkey").alias("agent_id"),
        F.col("l_extendedprice").alias("seconds"), F.col("l_shipdate").alias("moment"),
    )


def _as_stored(spark, folder):
    return sample.table(spark, folder, "documents").select(
        F.col("doc_id").alias(KEY), F.length("lang").cast("bigint").alias("agent_id"),
        F.col("n_chars").cast("double").alias("seconds"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("moment"),
    )


@query("sink_insert_ignore")
def _(spark, folder):
    return sinks.insert_ignore(_as_stored(spark, folder), _as_batch(spark, folder), KEY, "moment")


@query("sink_upsert")
def _(spark, folder):
    return sinks.upsert(_as_stored(spark, folder), _as_batch(spark, folder), KEY, "moment")


@query("sink_upsert_stored")
def _(spark, folder):
    """Both tables put one after the other into a stored table of key-hash folders."""
    path, batch = scratch_path(spark, "upserted"), _as_batch(spark, folder)
    for rows in (_as_stored(spark, folder), batch):
        sinks.upsert_table(rows, path, batch.schema, KEY, "moment", buckets=8)
    return sinks.read_upserted(spark, path, batch.schema)


@query("sink_overwrite")
def _(spark, folder):
    """The fallback summaries stored twice; the second version replaces the first."""
    path = scratch_path(spark, "ai-summary")
    rows = sc.fallback_summary(view(spark, folder, "transcripts")).select(
        KEY, "summary", F.to_json("strengths").alias("strengths"), "model_name"
    )
    for version in (1, 2):
        sinks.overwrite(rows, path, version)
    return files.read_table(spark, path)


def _exported(spark, folder, *columns):
    path = scratch_path(spark, "export")
    rows = view(spark, folder, "transcripts").select(*columns)
    sinks.export_csv(rows, path)
    return path, rows.schema


@query("sink_csv_export")
def _(spark, folder):
    """The lines of an export of numbers without the header that starts each file."""
    path, schema = _exported(spark, folder, KEY, "agent_word_count", "talk_ratio")
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines.filter(F.col("line") != ",".join(schema.names))


@query("scan_csv")
def _(spark, folder):
    path, schema = _exported(spark, folder, KEY, "full_text", "talk_ratio", "agent_word_count")
    return files.read_csv(spark, path, schema)


@query("rubric_changes")
def _(spark, folder):
    """Line items as changes of the parts' rules: quantity 50 inserts, 1 deletes, others update."""
    quantity = F.col("l_quantity")
    part = F.col("l_partkey").cast("string")
    inserting = quantity == 50
    changes = sample.table(spark, folder, "lineitem").select(
        F.concat(F.when(inserting, "N").otherwise("P"), part).alias("framework_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.when(inserting, "insert").when(quantity == 1, "delete").otherwise("update").alias("op"),
        F.col("l_shipdate").alias("changed_at"),
        F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("effective_weight"),
        F.when(F.col("l_tax") > 0.04, F.col("l_linestatus") == "O").alias("enabled"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("look at "), F.col("l_linenumber")
               .cast("string"))).alias("what_to_check"),
    )
    slim = view(spark, folder, "rules").select(
        "framework_id", "section_name", "effective_weight", "enabled", "what_to_check", "updated_at"
    )
    return sinks.apply_changes(slim, changes)


# Projections and filters.

@query("normalize_text")
def _(spark, folder):
    docs = sample.table(spark, folder, "documents").select("doc_id", "text")
    return ts.normalize_text(docs, "text").drop("text")


@over("transcript_features", "transcripts")
def _(transcripts):
    features = ts.transcript_features(transcripts.select(KEY, "agent_text", "customer_text"))
    return features.drop("agent_text", "customer_text")


over("format_dialogue", "transcripts")(ts.format_dialogue)


@query("truncate_text")
def _(spark, folder):
    docs = sample.table(spark, folder, "documents").select("doc_id", "text")
    for n in (4000, 3000, 1000, 800):
        docs = ts.truncate(docs, "text", n, to=f"first_{n}")
    return docs.drop("text")


over("filter_enabled_rules", "rules")(rb.enabled_rules)
over("weight_percent", "rules")(rb.with_weight_percent)


@over("filter_not_abandoned", "call_summary")
def _(summary):
    return ft.not_abandoned(summary).select(KEY, "resolution")


@over("filter_has_text", "transcripts")
def _(transcripts):
    return sc.has_text(transcripts).select(KEY, "full_text")


@over("call_detail_lookup", "calls", "quality_scores")
def _(calls, scores):
    slim = calls.select(KEY, "agent_id", "team_name", "contact_start", "total_duration_sec")
    return jn.call_detail(slim, scores)


@over("encode_sentiment", "call_summary")
def _(summary):
    return ft.encode_sentiment(summary).select(
        KEY, "sentiment_agent_num", "sentiment_customer_num"
    )


@over("encode_issue", "call_summary")
def _(summary):
    return ft.encode_issue(summary).select(KEY, "issue_num")


@over("encode_sla", "calls")
def _(calls):
    return ft.encode_sla(calls).select(KEY, "sla_met")


@over("critical_risk_flag", "quality_scores", "rubric")
def _(scores, rubric):
    flagged = jn.critical_risk(scores, rubric, threshold=0.1)
    return flagged.select("score_id", KEY, "criteria_name", "effective_weight", "risk")


@query("default_fill")
def _(spark, folder):
    return ft.default_fill(training(spark, folder)).select(
        KEY, "agent_text", "campaign_name", *ft.ISSUE_NUMBERS
    )


# Joins.

@over("join_calls_summary", "calls", "call_summary")
def _(calls, summary):
    return jn.calls_with_summary(calls, summary)


QUERIES["join_training_set"] = training


@over("join_scores_calls", "quality_scores", "calls")
def _(scores, calls):
    return jn.scores_with_calls(scores, calls)


@over("join_agent_names", "quality_scores", "calls")
def _(scores, calls):
    return jn.scores_with_names(scores.select("score_id", KEY, "criteria_name", "score"), calls)


over("unsummarized_calls", "transcripts", "call_summary")(jn.unsummarized)
over("unscored_calls", "transcripts", "calls", "quality_scores")(jn.unscored)


@over("rubric_weight_lookup", "quality_scores", "rubric")
def _(scores, rubric):
    evaluations = scores.select("score_id", "criteria_name", "passed")
    return jn.with_weights(evaluations, rubric)


@over("agent_id_lookup", "transcripts", "calls")
def _(transcripts, calls):
    return jn.with_agent(transcripts.select(KEY, "full_text"), calls)


@over("missing_transcripts", "calls", "transcripts")
def _(calls, transcripts):
    return jn.missing_transcripts(calls.select(KEY, "agent_id", "contact_start"), transcripts)


# Aggregations.

over("agent_rollup", "calls", "call_summary")(ru.agent_rollup)


@over("agent_rollup_minmax", "calls", "call_summary")
def _(calls, summary):
    return ru.agent_rollup(calls, summary, with_range=True)


@over("criteria_pass_rate", "quality_scores")
def _(scores):
    return ru.criteria_pass_rate(scores).drop("passed_count")


over("criteria_passed_count", "quality_scores")(ru.criteria_pass_rate)
over("agent_criteria_heatmap", "quality_scores")(ru.heatmap)


@over("agent_criteria_heatmap_wide", "quality_scores")
def _(scores):
    names = [row[2] for row in sample.CRITERIA]
    wide = ru.heatmap(scores, wide=True, criteria=names)
    return wide.select("agent_id", *[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names, 1)])


over("agents_dimension", "calls", "call_summary")(ru.agents_dimension)
over("overview_kpis", "calls", "call_summary")(ru.overview)
over("resolution_breakdown", "call_summary")(ru.resolution_breakdown)
over("total_calls_distinct", "quality_scores")(ru.total_calls)
over("agent_avg_quality", "quality_scores")(ru.agent_avg_quality)


@query("distinct_calls_by_month")
def _(spark, folder):
    """Calls per month of score rows, merged from the stored days of two batches."""
    path, scores = scratch_path(spark, "days"), view(spark, folder, "quality_scores")
    for number, half in enumerate((F.col(KEY) % 2 == 0, F.col(KEY) % 2 != 0)):
        ds.add_days(scores.filter(half), path, "evaluated_at", "checks", number)
    stored = ds.read_days(spark, path).withColumn("month", F.date_format("day", "yyyy-MM"))
    return ds.distinct_calls(stored, "month")


@over("most_failed_criteria", "quality_scores")
def _(scores):
    return ru.most_failed(scores, 5)


over("overall_call_score", "quality_scores")(ru.call_scores)
over("failed_criteria_list", "quality_scores", "rubric")(sc.failed_criteria)
over("recommendation_text", "quality_scores", "rubric")(sc.recommendations)
over("rubric_text", "rubric")(rb.rubric_text)
over("rubric_prompt_text", "rubric")(rb.rubric_prompt)
over("rubric_counts", "rules")(rb.rubric_counts)


@query("quality_log")
def _(spark, folder):
    return ql.quality_log(noted_calls(spark, folder), view(spark, folder, "transcripts"))


@query("quality_log_summary")
def _(spark, folder):
    return ql.quality_summary(QUERIES["quality_log"](spark, folder))


@query("severity_sort")
def _(spark, folder):
    ranked = ql.severity_sort(QUERIES["quality_log"](spark, folder))
    return ranked.select("severity_rank", "severity", KEY, "field_name")


@query("load_audit")
def _(spark, folder):
    names = ("calls", "transcripts", "quality_scores", "call_summary", "rubric")
    tables = {n: view(spark, folder, n) for n in names}
    return ql.load_audit({**tables, "quality_log": QUERIES["quality_log"](spark, folder)})


@query("file_audit")
def _(spark, folder):
    """One file per supplier as call detail, one per supplier with money as transcript."""
    rows = sample.table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    details, talk = scratch_path(spark, "detail-files"), scratch_path(spark, "transcript-files")
    one = rows.select("s_suppkey", F.col("s_name").alias("value"))
    rich = rows.filter("s_acctbal > 0").select(F.col("s_suppkey") + 3, F.lit("talk").alias("value"))
    for path, texts in ((details, one), (talk, rich.toDF("s_suppkey", "value"))):
        # All rows of a supplier in one task make one file; tasks put their files in place themselves.
        dealt = texts.repartition(4 * spark.sparkContext.defaultParallelism, "s_suppkey")
        dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(
            "s_suppkey").text(path)
    listed = [files.listed_files(spark, p, "part-*") for p in (details, talk)]
    return ql.file_audit(*listed, call_of="s_suppkey=([0-9]+)/")


@over("table_profile", "quality_scores")
def _(scores):
    return ql.profile(scores, "quality_scores")


over("daily_score_trend", "calls", "call_summary")(ru.daily_trend)
over("issue_volume", "call_summary")(ru.issue_volume)


@over("prediction_accuracy", "call_summary")
def _(summary):
    return ru.accuracy(summary, "issue_category", "pred_issue_category")


# Rankings, series, orderings, sets.

@over("agent_leaderboard", "calls", "call_summary")
def _(calls, summary):
    board = ru.leaderboard(ru.agent_rollup(calls, summary))
    return board.select(*ru.AGENT_GROUP, "avg_score", "score_rank")


@over("rolling_7d_score", "calls", "call_summary")
def _(calls, summary):
    return ru.rolling_score(ru.daily(calls, summary))


@over("kpi_day_delta", "calls", "call_summary")
def _(calls, summary):
    return ru.day_delta(ru.daily(calls, summary))


@over("first_match_dedupe", "quality_scores")
def _(scores):
    rows = scores.select(KEY, "evaluated_at", "agent_id", "criteria_name", "score")
    return first_match(rows, KEY, "evaluated_at")


over("rules_sort", "rules")(rb.sorted_rules)


@over("topk_rules", "rules")
def _(rules):
    shown = rules.select("section_name", "criteria_name", "effective_weight", "what_to_check",
                         "enabled", "framework_id")
    ordered = rb.enabled_rules(shown).orderBy(*rb.rule_order(), "framework_id")
    return ordered.limit(5)


@over("leaderboard_sort", "calls", "call_summary")
def _(calls, summary):
    return ru.by_score(ru.agent_rollup(calls, summary), 20)


@over("worst_criteria_sort", "quality_scores")
def _(scores):
    return ru.by_pass_rate(ru.criteria_pass_rate(scores), 3)


@over("sample_rows", "calls")
def _(calls):
    return ru.sample_rows(calls.select(KEY, "agent_id", "contact_start"), KEY, 5)


over("distinct_scored_calls", "quality_scores")(ru.distinct_calls)


@query("union_real_simulated")
def _(spark, folder):
    real = view(spark, folder, "calls").select(KEY, "agent_id", "contact_start", "is_simulated")
    generated = sample.table(spark, folder, "events").select(
        F.col("event_id").alias(KEY), F.col("user_id").alias("agent_id"),
        F.col("ts").alias("contact_start"), F.lit(True).alias("is_simulated"),
    )
    return jn.union_calls(real, generated)


@query("citation_dedupe")
def _(spark, folder):
    """Each document as answer, citing twelve ids drawn from its number, one of them twice."""
    key = F.col("doc_id")
    ids = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: (key + i % 12) * 3)
    answer = F.when(key % 4 == 0, F.concat("lang", F.lit(" call "), (key * 3).cast("string")))
    docs = sample.table(spark, folder, "documents").select(
        "doc_id", F.coalesce(answer, F.col("lang")).alias("answer"),
        F.when(F.col("source") != "src1", ids).alias("ids"),
    )
    return sc.with_citations(docs, "ids").drop("ids")


# Model responses and batch inference.

@query("parse_score_responses")
def _(spark, folder):
    scores, _ = sc.parse_scores(
        score_responses(spark, folder), view(spark, folder, "rubric"), RUN_TS
    )
    return scores


@query("scored_calls_run")
def _(spark, folder):
    """The scoring run over calls without scores, with a model that does what the prompt asks."""
    tables = [view(spark, folder, t) for t in ("transcripts", "calls", "quality_scores", "rubric")]
    scores, _ = au.score_unscored(*tables, obedient_judge(), RUN_TS)
    return scores.select(KEY, "agent_id", "criteria_name", "score", "reasoning")


@query("score_response_errors")
def _(spark, folder):
    _, errors = sc.parse_scores(
        score_responses(spark, folder), view(spark, folder, "rubric"), RUN_TS
    )
    return errors


@query("parse_summary_responses")
def _(spark, folder):
    rows, _ = sc.parse_summaries(summary_responses(spark, folder))
    return rows.select(KEY, "issue_category", "issue_description", "resolution",
                       "ai_recommendation", "overall_score")


@query("summary_response_errors")
def _(spark, folder):
    return sc.parse_summaries(summary_responses(spark, folder))[1]


@query("parse_ai_summary")
def _(spark, folder):
    read = sc.parse_ai_summary(audit_responses(spark, folder))
    lists = [F.to_json(c).alias(c) for c in ("strengths", "improvements", "failed_criteria")]
    return read.select(KEY, "summary", *lists, "is_fallback")


@query("lenient_json")
def _(spark, folder):
    """Event properties as answers: plain, fenced, quoted with apostrophes inside text, or none."""
    swapped = F.concat(F.lit("see "), F.replace("props", F.lit('"'), F.lit("'")), F.lit(" ok"))
    answer = (
        F.when(F.col("event_type") == "view", F.col("props"))
        .when(F.col("event_type") == "click", F.concat(F.lit("```"), "props", F.lit("```")))
        .when(F.col("event_type") == "error", F.lit("none")).otherwise(swapped)
    )
    events = sample.table(spark, folder, "events").select("event_id", answer.alias("answer"))
    return sc.lenient_json(events, "answer").select("event_id", "json")


@over("fallback_summary", "transcripts")
def _(transcripts):
    rows = sc.fallback_summary(transcripts)
    lists = [F.to_json(c).alias(c) for c in ("strengths", "improvements", "failed_criteria")]
    return rows.select(KEY, "summary", "model_name", *lists)


@over("assemble_model_input", "transcripts", "rubric")
def _(transcripts, rubric):
    return sc.model_input(transcripts, rb.rubric_text(rubric))


@over("model_inference_batch", "transcripts")
def _(transcripts):
    waiting = sc.has_text(transcripts).select(KEY, "full_text")
    return sc.infer(waiting, first_sentences(), "full_text", "summary string").drop("full_text")


@query("keyword_rubric_score")
def _(spark, folder):
    return sc.keyword_scores(view(spark, folder, "transcripts"), keyword_rubric(spark, folder))


@query("sentiment_label")
def _(spark, folder):
    return sc.sentiment(view(spark, folder, "transcripts"), lexicon(spark, folder))


# Retrieval.

@query("chunk_documents")
def _(spark, folder):
    return rt.parent_child_chunks(search_documents(spark, folder))[1]


@query("embed_chunks")
def _(spark, folder):
    chunks = rt.parent_child_chunks(search_documents(spark, folder))[1]
    vectors = rt.embed(chunks, letter_profile())
    cells = F.transform("embedding", lambda x: x.cast("int").cast("string"))
    return vectors.select(KEY, "parent_no", "child_no", F.array_join(cells, ",").alias("vector"))


@query("embed_chunks_hashed")
def _(spark, folder):
    chunks = rt.parent_child_chunks(search_documents(spark, folder))[1]
    return rt.hashed_embedding(chunks).drop("text")


@query("vector_topk")
def _(spark, folder):
    corpus = sample.table(spark, folder, "embeddings")
    hits = rt.vector_topk(label_centres(spark, folder), corpus)
    return hits.withColumn("distance", F.round("distance", 6))


@query("vector_topk_stored")
def _(spark, folder):
    """The same from stored cells."""
    path = scratch_path(spark, "cells")
    vi.build(sample.table(spark, folder, "embeddings"), path)
    return vi.search(label_centres(spark, folder), path).withColumn("distance", F.round("distance", 6))


@query("document_topk")
def _(spark, folder):
    return rt.document_topk(
        search_queries(spark, folder), search_documents(spark, folder), letter_profile()
    )


@query("tfidf_search")
def _(spark, folder):
    hits = rt.tfidf_search(search_documents(spark, folder), search_queries(spark, folder))
    return hits.withColumn("score", F.round("score", 6))


@query("child_to_parent")
def _(spark, folder):
    return cx.contexts(search_documents(spark, folder), search_queries(spark, folder))


@query("indexed_search")
def _(spark, folder):
    """The search over a stored index that was built in two steps."""
    path, docs = scratch_path(spark, "index"), search_documents(spark, folder)
    for part in (docs.filter(F.col(KEY) % 3 != 0), docs):
        ti.append(part, path, KEY)
    hits = ti.search(search_queries(spark, folder), path, KEY)
    return hits.withColumn("score", F.round("score", 6))


@query("indexed_contexts")
def _(spark, folder):
    path, docs = scratch_path(spark, "chunk-index"), search_documents(spark, folder)
    cx.index_chunks(docs, path)
    return cx.contexts(docs, search_queries(spark, folder), index=path)


# Features and models.

@query("tfidf_features")
def _(spark, folder):
    """The weight of every kept term of every call."""
    known = training(spark, folder).filter("issue_category IS NOT NULL")
    frame = settle(ft.issue_frame(known).select(KEY, "combined_text"))
    fitted = Pipeline(stages=ft.text_stages()).fit(frame)
    counted = next(s for s in fitted.stages if isinstance(s, CountVectorizerModel))
    terms = F.array(*[F.lit(term) for term in counted.vocabulary])
    cells = fitted.transform(frame).select(
        KEY, F.posexplode(vector_to_array("text_vec")).alias("place", "weight")
    )
    kept = cells.filter("weight > 0")
    return kept.select(
        KEY, F.get(terms, F.col("place")).alias("term"), F.round("weight", 6).alias("weight")
    )


@query("onehot_campaign")
def _(spark, folder):
    frame = ft.default_fill(view(spark, folder, "calls").select(KEY, "campaign_name")
                            .withColumns({"agent_text": F.lit(""), "customer_text": F.lit("")}))
    fitted = Pipeline(stages=ft.onehot_stages()).fit(frame)
    flags = F.transform(vector_to_array("campaign_name_vec"), lambda x: x.cast("int").cast("string"))
    return fitted.transform(frame).select(KEY, F.array_join(flags, "").alias("flags"))


@query("numeric_features")
def _(spark, folder):
    return ft.resolution_frame(training(spark, folder))


@over("label_encode", "call_summary")
def _(summary):
    rows = ft.not_abandoned(summary).filter("resolution IS NOT NULL").select(KEY, "resolution")
    indexed = ft.label_stage("resolution").fit(rows).transform(rows)
    return indexed.select(KEY, F.col("label").cast("bigint").alias("label"))


@query("standard_scale")
def _(spark, folder):
    frame = ft.resolution_frame(training(spark, folder))
    columns = list(ft.RESOLUTION_NUMBERS)
    scaled = ft.standard_scale(frame, columns)
    return scaled.select(KEY, *[F.round(c, 6).alias(c) for c in columns])


@over("balanced_weights", "call_summary")
def _(summary):
    return ft.balanced_weights(summary.select(KEY, "issue_category"), "issue_category")


def fitted(kind: str, spark: SparkSession, folder: str):
    train = tr.train_issue if kind == "issue" else tr.train_resolution
    return train(training(spark, folder))


@query("train_issue_classifier")
def _(spark, folder):
    told = QUERIES["predict_issue"](spark, folder).filter("actual IS NOT NULL")
    return ru.accuracy(told, "actual", "predicted")


@query("predict_issue")
def _(spark, folder):
    return tr.predict_issue(fitted("issue", spark, folder), training(spark, folder))


@query("predict_issue_cover")
def _(spark, folder):
    """What SQL can know of the predictions: every call has one, and when it can be judged."""
    told = QUERIES["predict_issue"](spark, folder)
    return told.select(
        KEY, "actual", F.col("predicted").isNotNull().alias("is_predicted"),
        F.col("correct").isNotNull().alias("is_judged"),
        F.col("confidence").rlike(r"^\d{1,3}%$").alias("has_confidence"),
    )


@query("train_resolution_model")
def _(spark, folder):
    told = QUERIES["predict_resolution"](spark, folder).filter("actual_resolution IS NOT NULL")
    return ru.accuracy(told, "actual_resolution", "predicted_resolution")


@query("predict_resolution")
def _(spark, folder):
    return tr.predict_resolution(fitted("resolution", spark, folder), training(spark, folder))


@query("predict_resolution_cover")
def _(spark, folder):
    told = QUERIES["predict_resolution"](spark, folder)
    return told.select(
        KEY, "actual_resolution", F.col("predicted_resolution").isNotNull().alias("is_predicted"),
        F.col("correct").isNotNull().alias("is_judged"), "overall_score",
    )


@query("save_models")
def _(spark, folder):
    """What a stored and reloaded issue model predicts."""
    path, rows = scratch_path(spark, "model"), training(spark, folder)
    model = fitted("issue", spark, folder)
    tr.save(model, path, tr.model_meta(model, rows, "issue_category"))
    loaded, _ = tr.load(spark, path)
    return tr.predict_issue(loaded, rows)


@query("saved_model_meta")
def _(spark, folder):
    """What is stored beside the resolution model: its labels in order and the rows it learned from."""
    path, rows = scratch_path(spark, "model"), training(spark, folder)
    model = fitted("resolution", spark, folder)
    tr.save(model, path, tr.model_meta(model, rows, "resolution"))
    meta = tr.load(spark, path)[1]
    stored = [(i, label, meta["trained_on"], len(meta["columns"])) for i, label in enumerate(meta["labels"])]
    return spark.createDataFrame(stored, "place int, label string, trained_on long, n_columns int")


@query("summary_predictions")
def _(spark, folder):
    """The summary table after a run of both models: which calls hold a prediction now."""
    rows, summary = training(spark, folder), view(spark, folder, "call_summary")
    bare = summary.drop("pred_issue_category", "pred_resolution")
    issues = tr.predict_issue(fitted("issue", spark, folder), rows)
    resolutions = tr.predict_resolution(fitted("resolution", spark, folder), rows)
    filled = tr.with_predictions(bare, issues, resolutions)
    return filled.select(
        KEY, "issue_category", "resolution",
        F.col("pred_issue_category").isNotNull().alias("has_issue"),
        F.col("pred_resolution").isNotNull().alias("has_resolution"),
    )


# Streams, run until their input is used up.

@query("stream_calls_ingest")
def _(spark, folder):
    """The orders as document files, read by the stream in two runs over a growing folder."""
    incoming, out, state = (scratch_path(spark, n) for n in ("incoming", "calls", "ingest"))
    documents = detail_documents(spark, folder)
    for _ in range(2):
        documents.write.mode("append").text(incoming)
        live.start_ingest(
            spark, incoming, out, state, RUN_TS, one_per_line=True
        ).awaitTermination()
    return keyed.read(spark, out, schemas.CALLS)


def _order_stream(spark, folder):
    """The orders table as a stream of files."""
    schema = sample.table(spark, folder, "orders").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(folder)


@query("stream_daily_metrics")
def _(spark, folder):
    out, state = scratch_path(spark, "daily"), scratch_path(spark, "daily-state")
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5)
    stream = _order_stream(spark, folder).select(
        F.col("o_orderdate").alias("contact_start"),
        sample.choose(F.col("o_orderpriority"), sample.ISSUES).alias("issue_category"),
        (cents % 10001 / F.lit(100.0)).alias("overall_score"),
    )
    live.start_daily_metrics(stream, out, state).awaitTermination()
    return live.read_daily(spark, out)


@query("stream_quality_log")
def _(spark, folder):
    out, state = scratch_path(spark, "quality"), scratch_path(spark, "quality-state")
    priority = F.col("o_orderpriority")
    calls = _order_stream(spark, folder).select(
        F.col("o_orderkey").alias(KEY),
        F.when(priority != "4-NOT SPECIFIED", priority).alias("disposition_notes"),
        (F.col("o_orderkey") * 37 % 3000).cast("double").alias("hold_seconds"),
    )
    live.start_quality_log(calls, out, state).awaitTermination()
    return spark.read.schema(live.quality_log_stream(calls).schema).parquet(out)


@query("stream_transcripts")
def _(spark, folder):
    """The transcript documents, read by the stream, and what it stores."""
    incoming, out, state = (scratch_path(spark, n) for n in ("talk-in", "talk", "talk-state"))
    transcript_documents(spark, folder).write.text(incoming)
    live.start_transcripts(
        spark, incoming, out, state, RUN_TS, one_per_line=True
    ).awaitTermination()
    stored = keyed.read(spark, out, schemas.TRANSCRIPTS)
    return stored.select(KEY, "agent_text", "customer_text", "talk_ratio")


@query("stream_talk_log")
def _(spark, folder):
    """The talk-ratio rule on streamed transcripts."""
    talk, out, state = (scratch_path(spark, n) for n in ("talk-rows", "talk-log", "talk-log-state"))
    rows = view(spark, folder, "transcripts").select(KEY, "talk_ratio")
    rows.write.parquet(talk)
    stream = spark.readStream.schema(rows.schema).parquet(talk)
    issues = live.talk_log_stream(stream)
    live.start_log(issues, out, state).awaitTermination()
    return spark.read.schema(issues.schema).parquet(out)
