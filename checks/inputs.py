"""Inputs of the registered queries that Spark derives from the provided tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsift.functions import text as tx
from callsift.operators import joins as jn
from callsift.operators import scoring as sc
from callsift.sources import sample

KEY = "contact_id"


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return sample.TABLES[name](spark, folder)


def detail_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each order as the text of a raw call document with gaps, zones and bad dates, numbers written in
    other ways, some that are none, and some documents cut off."""
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    start = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(key % 3 == 0, "Z").when(key % 3 == 1, "+02:00").otherwise("")
    bad_date = priority == "5-LOW"
    documents = sample.table(spark, folder, "orders").select(
        key.alias("key"), F.to_json(F.struct(
            F.when(key != 0, key).alias("contactId"),
            F.col("o_custkey").alias("agentId"),
            F.when(key % 11 != 0, F.concat(F.lit("Campaign "), (key % 7).cast("string")))
            .alias("campaignName"),
            F.when(priority != "2-HIGH", priority).alias("skillName"),
            F.lit("Ann").alias("firstName"),
            F.col("o_custkey").alias("fromAddr"),
            F.when(bad_date, F.lit("n/a")).otherwise(F.concat(start, zone))
            .alias("contactStart"),
            F.col("o_totalprice").alias("totalDurationSeconds"),
            F.when(key % 2 == 0, key * 37 % 3000).alias("holdSeconds"),
            F.when(key % 4 != 0, key % 4).alias("holdCount"),
            (key % 29 == 0).alias("abandoned"),
            F.when(priority == "1-URGENT", "1").alias("serviceLevelFlag"),
            F.lit("not read").alias("otherKey"),
        )).alias("document")
    )

    def rewritten(document: Column, every: int, field: str, value: str) -> Column:
        other = F.regexp_replace(document, f'"{field}":([-+.0-9E]+)', f'"{field}":{value}')
        return F.when(F.col("key") % every == 0, other).otherwise(document)

    document = F.col("document")
    for every, field, value in ((5, "contactId", '"$1"'), (3, "holdCount", "$1.0"),
                                (7, "totalDurationSeconds", '"$1"'), (89, "holdSeconds", '"long"')):
        document = rewritten(document, every, field, value)
    cut = F.substring(document, 1, 40)
    return documents.select(F.when(F.col("key") % 97 == 0, cut).otherwise(document).alias("document"))


def transcript_documents(spark: SparkSession, folder: str) -> DataFrame:
    sides = F.struct(
        F.col("agent_text").alias("agent_conversation"),
        F.col("customer_text").alias("customer_conversation"),
    )
    keyed = F.create_map(F.col(KEY).cast("string"), sides)
    document = F.to_json(keyed)
    cut = F.when(F.col(KEY) % 41 == 0, F.substring(document, 1, 20)).otherwise(document)
    return view(spark, folder, "transcripts").select(cut.alias("document"))


def rubric_document(spark: SparkSession, folder: str) -> DataFrame:
    """The rules met in the line items as one nested configuration; seven rules at most."""
    rule = F.struct(
        F.col("criteria_weight").alias("weight"), "enabled",
        F.col("when_to_check").alias("when"), F.col("what_to_check").alias("what"),
        "good_example", "bad_example", F.array("criteria_name").alias("check_keywords"),
        F.col("scoring_method").alias("scoring"),
    )
    rules = view(spark, folder, "rubric").withColumn(
        "section", F.coalesce("section_name", F.lit("General"))
    )
    sections = rules.groupBy("section").agg(F.struct(
        F.max("section_weight").alias("weight"),
        F.lit(True).alias("enabled"),
        F.map_from_entries(F.collect_list(F.struct("criteria_name", rule))).alias("criteria"),
    ).alias("body"))
    tree = F.map_from_entries(F.collect_list(F.struct("section", "body")))
    return sections.agg(F.to_json(F.struct(tree.alias("quality_framework"))).alias("document"))


def keyword_rubric(spark: SparkSession, folder: str) -> DataFrame:
    """The rubric with two keywords per criterion."""
    number = F.substring("framework_id", 2, 1).cast("int")
    words = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in sample_keywords()])
    return view(spark, folder, "rubric").withColumn("check_keywords", F.element_at(words, number))


def sample_keywords() -> list[tuple[str, str]]:
    return [("the ", "thank"), ("ing ", "my name"), ("ion", "callback"), ("eau", "help"),
            ("den", "fixed"), ("por", "hold"), ("que", "escalate")]


def score_responses(spark: SparkSession, folder: str) -> DataFrame:
    """One model answer of two verdicts per line item: plain, fenced, without or with a cut array."""
    number = F.col("l_linenumber")
    second = number % 7 + 1
    passed = F.when(F.col("l_returnflag") == "N", "true").when(
        F.col("l_returnflag") == "R", "false").otherwise("\"yes\"")

    def verdict(of, value, more):
        return F.concat(
            F.lit('{"section_name": "'), sample.criterion(1, of), F.lit('", "criteria_name": "'),
            sample.criterion(2, of), F.lit('"'), value, more, F.lit("}"),
        )

    first = verdict(number, F.concat(F.lit(', "passed": '), passed), F.lit(', "reasoning": "it\'s so"'))
    other = verdict(second, F.lit(""), F.lit(""))
    body = F.concat(F.lit("["), first, F.lit(", "), other, F.lit("]"))
    content = (
        F.when(F.col("l_tax") == 0.08, F.lit("I cannot grade this."))
        .when(F.col("l_tax") == 0.07, F.concat(F.lit("[1, "), first, F.lit(" ]")))
        .when(F.col("l_tax") == 0.06, F.concat(F.lit('[{"section_name": "'), F.lit("cut off ]")))
        .when(F.col("l_tax") == 0.05, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(body)
    )
    return sample.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias(KEY), F.col("l_suppkey").alias("agent_id"),
        content.alias("content"),
    )


def summary_responses(spark: SparkSession, folder: str) -> DataFrame:
    """One model answer per order, with the score as number, fraction, text, missing or unusable."""
    key = F.col("o_orderkey")
    score = (
        F.when(key % 7 == 0, "").when(key % 7 == 1, ', "overall_score": 7.5')
        .when(key % 7 == 2, ', "overall_score": "8"').when(key % 7 == 3, ', "overall_score": "7.5"')
        .when(key % 7 == 4, ', "overall_score": null').otherwise(', "overall_score": 9')
    )
    body = F.concat(
        F.lit('{"issue_category": "'), "o_orderpriority", F.lit('", "resolution": "'),
        "o_orderstatus", F.lit('", "ai_recot": "call back"'), score, F.lit("}"),
    )
    content = F.when(key % 13 == 0, F.lit("no answer")).when(
        key % 13 == 1, F.concat(F.lit("Sure:\n"), body, F.lit("\nDone"))
    ).when(key % 13 == 2, F.concat(body, F.lit(" }"))).otherwise(body)
    return sample.table(spark, folder, "orders").select(key.alias(KEY), content.alias("content"))


def audit_responses(spark: SparkSession, folder: str) -> DataFrame:
    """One audit answer per document: plain, fenced or free text."""
    key = F.col("doc_id")
    body = F.concat(
        F.lit('{"summary": "call '), key.cast("string"), F.lit('", "strengths": ["'), "lang",
        F.lit('", "polite"], "failed_criteria": ["'), "source", F.lit('"]}'),
    )
    content = F.when(F.col("lang") == "en", body).when(
        F.col("lang") == "de", F.concat(F.lit("```json\n"), body, F.lit("```"))
    ).otherwise(F.col("text"))
    return sample.table(spark, folder, "documents").select(
        key.alias(KEY), content.alias("content")
    )


def lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the benchmark texts: +1 when they occur more in even items, -1 in odd ones."""
    words = sample.table(spark, folder, "benchmark").select(
        F.explode(tx.tokens(F.col("text"))).alias("token"),
        F.when(F.col("item_id") % 2 == 0, 1).otherwise(-1).alias("vote"),
    )
    polarity = F.signum(F.sum("vote")).cast("int")
    return words.groupBy("token").agg(polarity.alias("polarity")).filter("polarity <> 0")


def search_documents(spark: SparkSession, folder: str) -> DataFrame:
    return sample.table(spark, folder, "documents").select(F.col("doc_id").alias(KEY), "text")


def search_queries(spark: SparkSession, folder: str) -> DataFrame:
    return sample.table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), "text"
    )


def label_centres(spark: SparkSession, folder: str) -> DataFrame:
    """The mean vector of each label, from sums of millionths so that task order cannot matter."""
    units = F.transform("embedding", lambda x: F.round(x.cast("double") * 1e6).cast("bigint"))
    cells = sample.table(spark, folder, "embeddings").select("label", F.posexplode(units))
    sums = cells.groupBy("label", "pos").agg(
        F.sum("col").alias("s"), F.count("*").alias("n")
    )
    mean = (F.col("s") / F.col("n") / F.lit(1e6)).alias("x")
    ordered = F.array_sort(F.collect_list(F.struct("pos", mean)))
    return sums.groupBy("label").agg(ordered.alias("_x")).select(
        F.col("label").cast("bigint").alias("query_id"), F.col("_x.x").alias("embedding")
    )


def letter_profile():
    """A stand-in embedding function: how often each letter a-z occurs."""

    def profile(texts):
        return [[float(t.count(chr(97 + i))) for i in range(26)] for t in texts]

    return profile


def first_sentences():
    """A stand-in model: the first 800 characters and the note."""
    note = sc.NOTE

    def summarise(texts):
        import pandas as pd

        return pd.DataFrame({"summary": [t[:800] + note for t in texts]})

    return summarise


def obedient_judge():
    """A stand-in model that answers in the shape that the prompt asks for, one verdict per rule."""

    def judge(prompts):
        import json
        import re

        import pandas as pd

        def answer(prompt):
            if "JSON array" not in prompt or "reasoning" not in prompt:
                return "I was not asked for verdicts."
            found = re.findall("In section (.*)\nRule (.*)\nAsks", prompt)
            return json.dumps([
                {"section_name": section, "criteria_name": rule, "passed": True,
                 "reasoning": "asked for an array"} for section, rule in found
            ])

        return pd.DataFrame({"content": [answer(p) for p in prompts]})

    return judge


def noted_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls with disposition notes, absent where the priority is not given."""
    priority = sample.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias(KEY),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority"))
        .alias("disposition_notes"),
        (F.col("o_orderkey") * 37 % 3000).cast("double").alias("hold_seconds"),
    )
    return priority


def training(spark: SparkSession, folder: str) -> DataFrame:
    return jn.training_set(*[view(spark, folder, t) for t in ("transcripts", "calls", "call_summary")])
