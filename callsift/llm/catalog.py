"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsift.llm import (
    chat, clustering, infilling, jaccard, langid, mixing, neighbours, packing, pii, quality_rules,
    sharding, tokens, toxicity,
)
from callsift.llm.common import small_batches, table
from callsift.llm.sql import SQL  # noqa: F401
from callsift.session import scratch_path, settle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, folder: fn(small_batches(spark), folder)
    return fn


@query
def op1_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed by source, weights 5, 2 and 1 in turn, 150 % of all words, 2 epochs at most."""
    docs = table(spark, folder, "documents")
    weights = mixing.cycled_weights(docs.select("source").distinct(), (5.0, 2.0, 1.0))
    planned = mixing.plan(docs, weights, share=1.5, max_epochs=2.0)
    return planned.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
        "source",
    )


@query
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from those outside the held-out fold."""
    docs = table(spark, folder, "documents")
    fold = langid.held_out(F.col("doc_id"))
    labelled = docs.filter(~fold).select("doc_id", "text", F.col("lang").alias("label"))
    judged = langid.with_language(docs.select("doc_id", "text"), langid.train(labelled))
    return judged.select("doc_id", fold.alias("held_out"), "lang_pred", "score")


@query
def op3_prefix_targets(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose texts hold marks, as examples, read back from them."""
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string",
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.examples(turns.unionByName(more)))


@query
def op4_cross_polytope(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest of every 50th vector, against all vectors."""
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query
def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as byte-level BPE pieces in sequences of 2,048 ids."""
    docs = table(spark, folder, "documents")
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=2048)
    return packing.pack(cut, limit=2048)


@query
def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents that share 85 % of their 4-word shingles."""
    found = jaccard.linked(table(spark, folder, "documents"), n=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op7_decision_list(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of all documents and the verdict of a decision list learned from the labels."""
    counted = settle(quality_rules.statistics(table(spark, folder, "documents")), "statistics")
    rules = quality_rules.train(counted, table(spark, folder, "labels"))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.base_failed().alias("base_failed"), quality_rules.verdict(rules).alias("kept"),
    )


@query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents; the cache begins empty, so every distinct text is encoded."""
    docs = table(spark, folder, "documents")
    counted = tokens.count_tokens(
        docs, public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "token-cache")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op9_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    placed = sharding.shard(table(spark, folder, "documents"), 40, scratch_path(spark, "slot-map"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


@query
def op10_contextual_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document, by form and by bootstrapped context."""
    return pii.report(table(spark, folder, "documents"))


@query
def op11_shallot_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors of 64 components in 40 clusters, after five rounds and a last assignment."""
    found = clustering.clustered(table(spark, folder, "embeddings"), k=40, rounds=5, d=64, seed=2)
    shown = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(shown, 256).alias("centroid_sha256"),
    )


@query
def op12_pattern_grammar(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document, learned from labels outside the held-out fold."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    fold = toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs.filter(~fold), labels.filter(~fold))
    judged = toxicity.scored(docs, model)
    return judged.select(
        "doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "n_clauses",
    )


@query
def op13_skip_list_infill(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a fill-in-middle example, and the text got back from it."""
    made = infilling.transformed(table(spark, folder, "documents"))
    back = infilling.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )
