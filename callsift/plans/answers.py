"""A store of model answers, so that no prompt is paid for twice.

Answers are kept under the digest of model and prompt. A run asks for equal prompts once, leaves out those
that are stored, and works through the rest in waves, each of which is stored before the next begins. A run
that dies keeps all finished waves, and the next one goes on where it stopped.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsift.operators import scoring
from callsift.schemas import flat
from callsift.session import settled
from callsift.sources import sinks

STORED = flat("digest STRING, content STRING")
PER_WAVE = 5_000


def digest(prompt: Column, model_name: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{model_name}\n"), F.coalesce(prompt, F.lit(""))), 256)


def stored_answers(spark: SparkSession, store: str) -> DataFrame:
    """(digest, content) of all answers so far, each once."""
    sinks.ensure_table(spark, store, STORED)
    return spark.read.schema(STORED).parquet(store).groupBy("digest").agg(F.min("content").alias("content"))


def answered(prompts: DataFrame, model: Callable, store: str, model_name: str = "model",
             per_wave: int = PER_WAVE) -> DataFrame:
    """`prompts` with the model's answer as `content` instead of the prompt.

    `model` maps a pandas Series of prompts to a frame with a `content` column; see `scoring.infer`.
    """
    spark = prompts.sparkSession
    keyed = prompts.withColumn("_digest", digest(F.col("prompt"), model_name))
    asked = keyed.select(F.col("_digest").alias("digest"), "prompt")
    known = stored_answers(spark, store).select("digest")
    # Digests decide what is missing; only the prompts of those are shuffled to make them one each.
    with settled(asked.select("digest").distinct().join(known, "digest", "left_anti"), "missing") as missing:
        each = asked.join(missing, "digest").groupBy("digest").agg(F.min("prompt").alias("prompt"))
        with settled(each, "prompts") as waiting:
            waves = max(1, math.ceil(waiting.count() / per_wave))
            for wave in range(waves):
                part = waiting.filter(F.pmod(F.xxhash64("digest"), F.lit(waves)) == wave)
                told = scoring.infer(part, model, "prompt", "content string").select("digest", "content")
                sinks.append(told, store)
    held = stored_answers(spark, store).withColumnRenamed("digest", "_digest")
    return keyed.join(held, "_digest").select(*[c for c in prompts.columns if c != "prompt"], "content")
