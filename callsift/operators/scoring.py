"""Rubric scoring, reading of model responses and batch inference around an injected function."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from callsift.functions import jsontext as js
from callsift.functions import text as tx
from callsift.functions.moments import moment
from callsift.operators.joins import with_weights
from callsift.plans.once import computed_once
from callsift.plans.sizing import blocks, inline_if_small, lookup_side

KEY = "contact_id"
# Texts that go into stored rows.
NOTE = " Note: Machine-generated, not human-intervened."
ALL_MET = "Excellent — all criteria met!"
SCORED_BY = "auditor"
RULES_PER_PASS = 100_000
MOST_CRITERIA = 2_048
MOST_TOKENS = 1_000_000
DEFAULT_SCORE = 5
EVALUATION = "array<struct<section_name: string, criteria_name: string, passed: variant, reasoning: string>>"
SUMMARY_FIELDS = (
    "issue_category", "issue_description", "resolution", "sentiment_agent", "sentiment_customer",
    "key_moments",
)
INSTRUCTION = (
    "Audit the call transcript against the rubric and answer with JSON only.\n"
    "Keys: summary, strengths, improvements, failed_criteria.\n\n"
)


def _opened(df: DataFrame, text: Column) -> DataFrame:
    """`df` with the JSON value of a text as `_doc`, parsed once per row."""
    return computed_once(computed_once(df, _pair=js.wrapped(text)), _doc=js.unwrapped(F.col("_pair")))


def _evaluations(responses: DataFrame) -> DataFrame:
    """Responses with the found array text and its items, null unless all of them are objects."""
    found = computed_once(responses, _json=js.array_part(F.col("content")))
    opened = _opened(found, F.col("_json"))
    read = computed_once(opened, _read=F.try_variant_get("_doc", "$", EVALUATION))
    odd = F.exists("_read", lambda item: item.isNull())
    return computed_once(read, _items=F.when(~odd, F.col("_read")))


def parse_scores(
    responses: DataFrame, rubric: DataFrame, run_ts: datetime, scored_by: str = SCORED_BY
) -> tuple[DataFrame, DataFrame]:
    """Score rows from (contact_id, agent_id, content) responses, and the unreadable responses.

    A passed criterion earns the weight of its rule; an unknown one earns nothing. A row's id comes
    from the call, the agent, the answer's content, the place in it and, among equal answers, a
    number, so ids are unique and the same answers always get the same ids.
    """
    # Equal answers of a call are read once; how many there were numbers their rows.
    folded = responses.groupBy(KEY, "agent_id", "content").agg(F.count("*").alias("_n"))
    parsed = _evaluations(folded)
    copies = F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy")
    items = parsed.select(
        KEY, "agent_id", "_n", F.md5("content").alias("_answer"), F.posexplode("_items").alias("_no", "_item")
    )
    rows = items.select(
        KEY, "agent_id", "_answer", "_no", copies,
        F.coalesce("_item.section_name", F.lit("")).alias("section_name"),
        F.coalesce("_item.criteria_name", F.lit("")).alias("criteria_name"),
        js.truthy(F.col("_item.passed")).alias("passed"),
        F.coalesce("_item.reasoning", F.lit("")).alias("reasoning"),
    )
    weighted = with_weights(rows, rubric)
    identity = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
                (KEY, "agent_id", "_answer", "_no", "_copy")]
    scores = weighted.select(
        tx.stable_key(*identity).alias("score_id"),
        KEY, "agent_id", "section_name", "criteria_name",
        F.when(F.col("passed"), F.col("effective_weight")).otherwise(F.lit(0.0)).alias("score"),
        "passed", "reasoning", F.lit(scored_by).alias("scored_by"),
        moment(run_ts).alias("evaluated_at"),
    )
    reason = F.when(F.col("_json").isNull(), "no array").otherwise("not readable")
    errors = parsed.filter("_items IS NULL").select(KEY, "content", reason.alias("reason"), copies)
    return scores, errors.drop("_copy")


def parse_summaries(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Call summaries from (contact_id, content) responses, and the unreadable responses."""
    found = computed_once(responses, _json=js.object_part(F.col("content")))
    opened = _opened(found, F.col("_json"))
    document = computed_once(opened, score=F.try_variant_get("_doc", "$.overall_score", "variant"))

    def text(name: str) -> Column:
        return F.try_variant_get("_doc", f"$.{name}", "string")

    known = F.when(F.col("_doc").isNotNull(), js.whole_number(F.col("score"), DEFAULT_SCORE))
    read = computed_once(document, overall_score=known)
    usable = F.col("overall_score").isNotNull()
    rows = read.filter(usable).select(
        KEY,
        *[text(name).alias(name) for name in SUMMARY_FIELDS],
        text("ai_recot").alias("ai_recommendation"),
        "overall_score",
    )
    return rows, read.filter(~usable).select(KEY, "content")


def parse_ai_summary(responses: DataFrame) -> DataFrame:
    """Summary, strengths, improvements and failed criteria; unreadable text is kept as summary."""
    content = F.col("content")
    plain = _opened(responses, content).withColumnRenamed("_doc", "_plain").drop("_pair")
    unfenced = F.when(F.col("_plain").isNull(), js.without_fence(content))
    opened = _opened(plain, unfenced).withColumn("_doc", F.coalesce("_plain", "_doc"))
    kind = F.coalesce(F.schema_of_variant("_doc").startswith("OBJECT"), F.lit(False))
    read = computed_once(opened, _is_object=kind)
    is_object = F.col("_is_object")
    note = F.concat(tx.head(content, 1000), F.lit(NOTE))
    nothing = F.array().cast("array<string>")

    def listed(name: str) -> Column:
        return F.when(is_object, js.text_list(F.col("_doc"), f"$.{name}")).otherwise(nothing)

    summary = F.coalesce(F.try_variant_get("_doc", "$.summary", "string"), F.lit(""))
    return read.select(
        *responses.columns,
        F.when(is_object, summary).otherwise(note).alias("summary"),
        listed("strengths").alias("strengths"),
        listed("improvements").alias("improvements"),
        listed("failed_criteria").alias("failed_criteria"),
        (~is_object).alias("is_fallback"),
    )


def lenient_json(df: DataFrame, col: str) -> DataFrame:
    """The table with the readable JSON of a text column as `json`."""
    return df.withColumn("json", js.recovered(F.col(col)))


def has_text(transcripts: DataFrame) -> DataFrame:
    return transcripts.filter("full_text IS NOT NULL")


def fallback_summary(transcripts: DataFrame) -> DataFrame:
    """Summary rows when no model is at hand: the start of the transcript and a note."""
    nothing = F.array().cast("array<string>")
    kept = [c for c in (KEY, "agent_id") if c in transcripts.columns]
    return has_text(transcripts).select(
        *kept,
        F.concat(tx.head(F.col("full_text"), 800), F.lit(NOTE)).alias("summary"),
        nothing.alias("strengths"),
        nothing.alias("improvements"),
        nothing.alias("failed_criteria"),
        F.lit("fallback").alias("model_name"),
    )


def model_input(
    transcripts: DataFrame, rubric_text: DataFrame, instruction: str = INSTRUCTION
) -> DataFrame:
    """Prompt per transcript. The one-row rubric text enters as a scalar, not by a join."""
    rules = F.coalesce(F.nullif(rubric_text.scalar(), F.lit("")), F.lit("No rules"))
    prompt = F.concat(
        F.lit(instruction + "Rubric:\n"), rules, F.lit("\n\nTranscript:\n"),
        F.coalesce("full_text", F.lit("")),
    )
    kept = [c for c in (KEY, "agent_id") if c in transcripts.columns]
    return transcripts.select(*kept, prompt.alias("prompt"))


def infer(
    df: DataFrame, fn: Callable, in_col: str, out_schema: str, batch_size: int = 5
) -> DataFrame:
    """`df` with the columns that `fn` returns for a batch of texts.

    `fn` takes a pandas Series of up to `batch_size` texts and returns a pandas DataFrame with the
    columns of `out_schema`. Rows stream through each task, one Arrow batch at a time.
    """
    added = T.StructType.fromDDL(out_schema)
    names = added.names

    def run(frames):
        import pandas as pd

        for frame in frames:
            texts = frame[in_col]
            parts = [
                fn(texts.iloc[start:start + batch_size].reset_index(drop=True))[names]
                for start in range(0, len(frame), batch_size)
            ]
            if parts:
                told = pd.concat(parts, ignore_index=True)
                yield pd.concat([frame.reset_index(drop=True), told], axis=1)

    return df.mapInPandas(run, T.StructType(df.schema.fields + added.fields))


class Keywords:
    """All keywords of some rules as one automaton, and the rules that each of them counts for."""

    def __init__(self, lists: list[list[str | None]]):
        self.n_rules = len(lists)
        self.everywhere = np.zeros(self.n_rules, dtype=np.int64)  # the empty text is in every text
        rules_of: dict[str, list[int]] = {}
        for rule, words in enumerate(lists):
            for word in words:
                if word:
                    rules_of.setdefault(word, []).append(rule)
                elif word is not None:
                    self.everywhere[rule] += 1
        self.rules_of = [np.array(rules) for rules in rules_of.values()]
        self.automaton = ahocorasick.Automaton()
        for number, word in enumerate(rules_of):
            self.automaton.add_word(word, number)
        if rules_of:
            self.automaton.make_automaton()

    def hits(self, text: str) -> np.ndarray:
        """For each rule how many of its keywords the text holds, from one walk over the text."""
        out = self.everywhere.copy()
        if self.rules_of:
            for number in {number for _, number in self.automaton.iter(text)}:
                np.add.at(out, self.rules_of[number], 1)
        return out


def keyword_scores(transcripts: DataFrame, rubric: DataFrame, min_hits: int = 1) -> DataFrame:
    """Keyword verdict of every enabled criterion on every transcript; a rule without keywords has no
    hits.

    The keywords of a pass over the rules form one automaton, which goes through each text once, however
    many they are; transcripts are neither joined nor shuffled. The rules of a pass are at most
    RULES_PER_PASS and 64 MB of keywords; a larger table is worked through in several.
    """
    words_of = F.coalesce("check_keywords", F.array().cast("array<string>"))
    rule = F.struct("section_name", "criteria_name", "effective_weight")

    def one_pass(some_rules: DataFrame) -> DataFrame:
        lowered = F.transform(words_of, lambda k: F.lower(k)).alias("keywords")
        held = some_rules.select(rule.alias("rule"), lowered).toArrow()
        shipped = transcripts.sparkSession.sparkContext.broadcast(held.column("keywords").to_pylist())
        numbered = held.select(["rule"]).append_column("no", pa.array(range(len(held)), pa.int32()))
        listed = transcripts.sparkSession.createDataFrame(numbered)
        in_order = F.array_sort(F.collect_list(F.struct("no", "rule")))
        rules = listed.agg(F.transform(in_order, lambda r: r["rule"])).scalar()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keywords = Keywords(shipped.value)
            for batch in batches:
                found = [keywords.hits(t.as_py()) for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(KEY), pa.array(found, pa.list_(pa.int64()))], [KEY, "hits"])

        spoken = F.lower(F.coalesce("agent_text", F.lit(""))).alias("text")
        schema = T.StructType([transcripts.schema[KEY], T.StructField("hits", T.ArrayType(T.LongType()))])
        counted = transcripts.select(KEY, spoken).mapInArrow(count, schema)
        each = F.arrays_zip(rules.alias("rule"), F.col("hits"))
        return counted.select(KEY, F.inline(each)).select(KEY, "rule.*", "hits")

    enabled = rubric.filter("enabled")
    size = F.aggregate(words_of, F.lit(0), lambda total, k: total + F.coalesce(F.length(k), F.lit(0)))
    parts = blocks(enabled, "criteria_name", RULES_PER_PASS, size)
    found = reduce(DataFrame.unionByName, [one_pass(part) for part in parts])
    passed = F.col("hits") >= min_hits
    score = F.when(passed, F.col("effective_weight")).otherwise(F.lit(0.0))
    return found.select(
        KEY, "section_name", "criteria_name", "hits", passed.alias("passed"), score.alias("score")
    )


def sentiment(
    transcripts: DataFrame, lexicon: DataFrame, lo: float = -0.05, hi: float = 0.05
) -> DataFrame:
    """Positive / Neutral / Negative per speaker from a (token, polarity) lexicon.

    A lexicon that proves small is looked up where the text lies, so that a call sends four numbers and no
    tokens; a larger one is joined.
    """
    known = lexicon.filter("polarity IS NOT NULL AND token IS NOT NULL").groupBy("token").agg(
        F.sum("polarity").cast("double").alias("polarity"), F.count("*").cast("double").alias("n"))
    few, small = inline_if_small(known, MOST_TOKENS)
    sums = _looked_up(transcripts, few.toArrow()) if small else _joined_sums(transcripts, known)

    def label(side: str) -> Column:
        mean = F.try_divide(F.sum(f"{side}_sum"), F.sum(f"{side}_n"))
        return F.when(mean > hi, "Positive").when(mean < lo, "Negative").otherwise("Neutral")

    return sums.groupBy(KEY).agg(
        label("agent").alias("sentiment_agent"), label("customer").alias("sentiment_customer")
    )


SIDES = ("agent", "customer")


def _looked_up(transcripts: DataFrame, known: pa.Table) -> DataFrame:
    """Per transcript and side the sum of polarities and the number of words in the lexicon."""
    shipped = transcripts.sparkSession.sparkContext.broadcast(known.combine_chunks())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        words = table.column("token").combine_chunks()
        values = [np.append(table.column(c).to_numpy(), 0.0) for c in ("polarity", "n")]
        for batch in batches:
            out = []
            for side in SIDES:
                tokens = batch.column(side)
                at = pc.index_in(tokens.flatten(), value_set=words).fill_null(len(words))
                rows = np.repeat(np.arange(len(batch)), tokens.value_lengths().to_numpy(zero_copy_only=False))
                out += [pa.array(np.bincount(rows, v[at.to_numpy(zero_copy_only=False)], len(batch)))
                        for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(KEY), *out], schema=told)

    schema = T.StructType([transcripts.schema[KEY], *[
        T.StructField(f"{side}_{what}", T.DoubleType()) for side in SIDES for what in ("sum", "n")
    ]])
    told = to_arrow_schema(schema)
    spoken = [tx.tokens(F.col(f"{side}_text")).alias(side) for side in SIDES]
    return transcripts.select(KEY, *spoken).mapInArrow(look, schema)


def _joined_sums(transcripts: DataFrame, known: DataFrame) -> DataFrame:
    """The same for a lexicon of any size, one row per known token; an empty marker token keeps calls
    without any."""
    marker = F.lit("")
    sides = F.array(*[
        F.struct(F.lit(side).alias("side"),
                 F.array_append(tx.tokens(F.col(f"{side}_text")), marker).alias("tokens"))
        for side in SIDES
    ])
    spoken = transcripts.select(KEY, F.inline(sides)).select(KEY, "side", F.explode("tokens").alias("token"))
    found = spoken.join(known, "token", "left").filter(F.col("n").isNotNull() | (F.col("token") == marker))
    return found.select(KEY, *[
        F.when(F.col("side") == side, F.col(column)).alias(f"{side}_{what}")
        for side in SIDES for column, what in (("polarity", "sum"), ("n", "n"))
    ])


def _criteria_in_order(scores: DataFrame, rubric: DataFrame) -> list | None:
    """The names of all scored criteria in rubric order, those outside the rubric last; None if they are
    more than MOST_CRITERIA."""
    order = rubric.groupBy("criteria_name").agg(F.min("framework_id").alias("_place"))
    named = order.select(F.col("criteria_name").alias("_name"), "_place")
    every = scores.select("criteria_name").distinct().join(
        named, F.col("criteria_name").eqNullSafe(F.col("_name")), "left").select("criteria_name", "_place")
    few, small = inline_if_small(every, MOST_CRITERIA)
    if not small:
        return None
    listed = [(r["_place"], r["criteria_name"]) for r in few.collect()]
    return [name for _, name in sorted(listed, key=lambda x: (
        x[0] is None, "" if x[0] is None else x[0], x[1] is not None, x[1] or ""))]


def _failed_in_order(scores: DataFrame, rubric: DataFrame) -> DataFrame:
    """Per call the distinct failed criteria in rubric order, those outside the rubric last.

    A call's failed criteria are bits, one word of 64 for so many names, which fold inside each task in a
    hash aggregation, however many score rows a call has. Names beyond MOST_CRITERIA are gathered as sets.
    """
    failed = ~F.coalesce("passed", F.lit(False))
    names = _criteria_in_order(scores, rubric)
    if names is None:
        return _failed_sets(scores.select(KEY, "criteria_name", failed.alias("_failed")), rubric)
    numbered = pa.table({"_name": pa.array(names, pa.string()), "_no": pa.array(range(len(names)), pa.int32())})
    places = F.broadcast(scores.sparkSession.createDataFrame(numbered))
    placed = scores.select(KEY, "criteria_name", failed.alias("_failed")).join(
        places, F.col("criteria_name").eqNullSafe(F.col("_name")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_no") % 64)
    words = [
        F.bit_or(F.when(F.col("_failed") & (F.floor(F.col("_no") / 64) == w), bit)).alias(f"_w{w}")
        for w in range(-(-len(names) // 64))
    ]
    held = placed.groupBy(KEY).agg(*words) if words else placed.select(KEY).distinct()

    def named(word: Column, own: list[str | None]) -> Column:
        """The names whose bits are set in a word."""
        bits = F.coalesce(word, F.lit(0).cast("long"))
        places = F.filter(
            F.sequence(F.lit(0), F.lit(len(own) - 1)), lambda i: F.call_function("bit_get", bits, i) == 1)
        listed = F.array(*[F.lit(n).cast("string") for n in own])
        return F.transform(places, lambda i: F.get(listed, i))

    lists = [named(F.col(f"_w{w}"), names[64 * w : 64 * w + 64]) for w in range(len(words))]
    found = F.concat(*lists) if lists else F.array().cast("array<string>")
    return held.select(KEY, found.alias("failed"))


def _failed_sets(scores: DataFrame, rubric: DataFrame) -> DataFrame:
    """The same for any number of names, by an aggregation of sets."""
    order = lookup_side(
        rubric.groupBy("criteria_name").agg(F.min("framework_id").alias("_place"))
    )
    placed = scores.join(order, "criteria_name", "left")
    unknown = F.col("_place").isNull().alias("unknown")
    entry = F.when(F.col("_failed"), F.struct(unknown, "_place", "criteria_name"))
    sets = placed.groupBy(KEY).agg(F.array_sort(F.collect_set(entry)).alias("_set"))
    names = F.transform("_set", lambda e: e["criteria_name"])
    return sets.select(KEY, names.alias("failed"))


def failed_criteria(scores: DataFrame, rubric: DataFrame) -> DataFrame:
    """Failed criteria of each scored call, in rubric order, as JSON text."""
    return _failed_in_order(scores, rubric).select(
        KEY, F.to_json("failed").alias("failed_criteria"),
        F.size("failed").cast("bigint").alias("n_failed"),
    )


def recommendations(scores: DataFrame, rubric: DataFrame, n: int = 3) -> DataFrame:
    """What to improve: the first n failed criteria, or praise when none failed."""
    first = F.array_join(F.slice("failed", 1, n), ", ")
    advice = F.when(F.size("failed") == 0, ALL_MET).otherwise(F.concat(F.lit("Improve: "), first))
    return _failed_in_order(scores, rubric).select(KEY, advice.alias("ai_recommendation"))


def with_citations(answers: DataFrame, ids_col: str, limit: int = 10) -> DataFrame:
    """Answers with their call ids appended, unless an id already occurs in the answer."""
    ids = F.array_distinct(
        F.filter(F.transform(ids_col, lambda i: i.cast("string")), lambda s: s != "")
    )
    listed = F.array_join(F.slice("_ids", 1, limit), ", ")
    cited = F.exists("_ids", lambda i: F.contains(F.col("answer"), i)) | (F.size("_ids") == 0)
    text = F.when(cited, F.col("answer")).otherwise(
        F.concat("answer", F.lit("\n\nCitations (Call IDs): "), listed)
    )
    known = answers.withColumn("_ids", F.coalesce(ids, F.array().cast("array<string>")))
    return known.withColumn("answer", text).drop("_ids")
