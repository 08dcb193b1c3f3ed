"""From raw documents to packed training sequences in five stages.

`run(spark, folder)` writes every stage's result as Parquet to the shared folder and reads it again for
the next one. All stages but the last return the columns of `documents`.

Rows that a stage takes out: the first one texts without a letter and texts whose language is unclear;
the second one all but one document of each group of near copies. The third replaces personal data in
the text, the fourth repeats or leaves out documents by the mix, the last one packs what is left.
Null texts go in the first stage; an empty table stays empty; repeated rows (equal doc_id) are one
document from the second stage on; further columns are carried along until the last stage.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsift.llm import jaccard, langid, mixing, packing, pii
from callsift.llm.common import small_batches
from callsift.session import ensure_shared_dir, settle

WORDS, ALIKE = 5, 80  # near copies share this percent of the union of their runs of so many words
CLEAR = 0.5  # the least calibrated probability of a language that stays
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_EPOCHS = 2.0
SEQUENCE = 2048
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def keep_clear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the model is sure of; it learns from the labelled ones."""
    model = langid.train(docs.select("doc_id", "text", F.col("lang").alias("label")))
    judged = langid.with_language(docs.withColumnsRenamed({"lang_pred": "_own_pred", "score": "_own"}),
                                  model)
    clear = judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= CLEAR))
    back = {"_own_pred": "lang_pred", "_own": "score"}
    return clear.drop("lang_pred", "score").withColumnsRenamed(back).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest doc_id. Two documents link when their
    sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    Of rows that share a doc_id the one with the smallest hash of its text stays, and of rows that share the
    text too the one with the smallest hash of all columns, on any partitioning. Rows
    without a doc_id link like all others: one stays of each group that no doc_id is in, again the one
    with the smallest hash, and one of each text without words.
    """
    grouped = settle(jaccard.linked(docs, n=WORDS, percent=ALIKE), "groups")
    known = grouped.filter("doc_id = component_id").groupBy("doc_id").agg(F.min("text_key").alias("_key"))
    nameless = grouped.filter("doc_id IS NULL AND component_id IS NULL")
    alone = nameless.groupBy(F.coalesce("group", "text_key")).agg(F.min("text_key").alias("_key"))
    keyed = docs.withColumns({"_text": jaccard.text_key(), "_row": F.xxhash64(*docs.columns)})
    # Of rows with equal id and text the one with the smallest hash, found without moving any text.
    first = keyed.groupBy("doc_id", "_text").agg(F.min("_row").alias("_row"))
    one = first.withColumnRenamed("_text", "_key")
    wanted = one.filter("doc_id IS NOT NULL").join(known, ["doc_id", "_key"])
    nameless = one.filter("doc_id IS NULL").drop("doc_id").join(alone.select("_key"), "_key")
    found = keyed.join(wanted.withColumnRenamed("_key", "_text"), ["doc_id", "_text", "_row"])
    others = keyed.filter(F.col("doc_id").isNull()).join(
        nameless.withColumnRenamed("_key", "_text"), ["_text", "_row"])
    return found.dropDuplicates(["doc_id", "_text", "_row"]).select(*docs.columns).unionByName(
        others.dropDuplicates(["_text", "_row"]).select(*docs.columns))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by marks, and n_chars as the text now is."""
    done = pii.redacted(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    weights = mixing.cycled_weights(docs.select("source").distinct(), WEIGHTS)
    return mixing.resample(docs, settle(mixing.plan(docs, weights, SHARE, MOST_EPOCHS), "mix"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack(packing.pieces(docs, TOKENIZER, SEQUENCE), SEQUENCE)


def ready(stage):
    """`stage` with bounded batches for Python workers, and on a local session without a shared folder,
    which then gets one; see `session.py`."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(small_batches(ensure_shared_dir(spark)), docs, sf_dir)

    return run_stage


STAGES = [
    ("language ID", ready(keep_clear_language)),
    ("n-gram Jaccard join", ready(keep_one_of_each_group)),
    ("PII", ready(replace_personal_data)),
    ("mixing sources to target weights", ready(mix_sources)),
    ("best-fit packing", ready(pack_sequences)),
]

# No SQL: the first stage is a trained model, the last one a library's tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ensure_shared_dir(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.split()[0])
    return docs
