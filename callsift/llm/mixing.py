"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

A source's target is its weight times one common level, but at most `max_epochs` times its size; the
level rises until the targets add up to the budget, which hands the excess of full sources on by
weight. A source then takes every document floor(target / size) times, and once more a fraction of
them: its documents are lined up by size, ties by a seeded hash, and picked at even steps from one of
a few seeded starts, the one whose words come closest to the target. Twice then a single document whose
choice is reversed brings the words closer still; this matters only where a source is small beside its
longest documents.

Defined results: null text counts no words; a null source is a source of its own, last in order; a
source without words or with weight null or under 0 has target 0; repeated rows count each; an empty
table gives an empty mix. Other columns are not looked at and survive `resample`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.llm.common import WORD, running
from callsift.session import settle

SEED = 17
STARTS = 32
CORRECTIONS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """(source, weight): the given weights, repeating, over sources by code point, null last."""
    placed = running(
        sources.select("source", F.col("source").isNull().alias("_last")), [],
        ["_last", "source"], place=F.lit(1),
    )
    at = ((F.col("place") - 1) % len(weights) + 1).cast("int")
    return placed.select("source", F.element_at(F.array(*map(F.lit, weights)), at).alias("weight"))


def level(sources: DataFrame, budget: float) -> float:
    """The level at which min(cap, level * weight) over (weight, cap) rows adds up to the budget.

    Each round clamps the sources that the present level fills and shares the rest among the others;
    the level only rises, and it stays the same once no further source fills.
    """
    full = F.col("cap") <= F.col("weight") * F.lit(0.0)
    reached = -1.0
    while True:
        clamped, open_weight = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        if not open_weight:
            return float("inf")
        raised = max(0.0, budget - clamped) / open_weight
        if raised <= reached:
            return reached
        reached = raised
        full = F.col("cap") <= F.col("weight") * F.lit(reached)


def targets(sizes: DataFrame, weights: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target) for (source, size) rows; `share` times all sizes is mixed."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double"))
    sources = settle(
        per_source.join(weighed, F.col("source").eqNullSafe(F.col("_source")), "left").select(
            "source", "source_size",
            F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"),
        ).withColumn("cap", F.when(F.col("weight") > 0, F.col("source_size") * float(max_epochs))
                     .otherwise(F.lit(0.0))),
        "sources",
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    top = level(sources, share * total)
    target = F.col("cap") if top == float("inf") else F.least("cap", F.col("weight") * F.lit(top))
    return sources.select("source", "source_size", target.alias("target"))


def unit(text: Column) -> Column:
    """A number in [0, 1) from a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def plan(docs: DataFrame, weights: DataFrame, share: float, max_epochs: float,
         seed: int = SEED) -> DataFrame:
    """One narrow row per document row: doc_id, source, text_key, size, its source's size and target,
    and `copies`, how often the mix takes it. Only these columns are shuffled, never the text."""
    narrow = settle(docs.select(
        "doc_id", "source", F.xxhash64("text").alias("text_key"), word_count(F.col("text")).alias("size")
    ), "sizes")
    aims = targets(narrow, weights, share, max_epochs)
    tie = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = running(narrow, ["source"], ["size", tie, "text_key"], place=F.lit(1))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = aims.select(F.col("source").alias("_source"), "source_size", "target")
    seeded = unit(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))))
    aimed = settle(
        placed.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumns({"epochs": epochs, "start": seeded}), "aimed",
    )
    part = F.col("epochs") - F.floor("epochs")

    def copies(start: Column) -> Column:
        """Whole repetitions, and one more where a step ends on this document."""
        at = F.col("place")
        further = F.floor(part * at + start) - F.floor(part * (at - 1) + start)
        return (F.floor("epochs") + further).cast("long")

    taken = [F.sum(F.col("size") * copies(F.col("start") + i / STARTS)) for i in range(STARTS)]
    missed = [F.struct(F.abs(t - F.max("target")).alias("by"), F.lit(i / STARTS).alias("shift"))
              for i, t in enumerate(taken)]
    best = aimed.groupBy(F.col("source").alias("_source")).agg(F.least(*missed).alias("_best"))
    chosen = aimed.join(best, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "copies", copies(F.col("start") + F.col("_best.shift"))
    ).drop("_source", "_best")
    for _ in range(CORRECTIONS):
        chosen = corrected(settle(chosen, "chosen"))
    return chosen.select("doc_id", "source", "text_key", "size", "source_size", "target", "copies")


def corrected(chosen: DataFrame) -> DataFrame:
    """`chosen` with the choice of one document per source reversed, if that comes closer to the target."""
    words = F.sum(F.col("size") * F.col("copies"))
    off = chosen.groupBy(F.col("source").alias("_of")).agg((words - F.max("target")).alias("_off"))
    further = F.col("copies") > F.floor("epochs")
    fractional = F.col("epochs") > F.floor("epochs")
    left = F.abs(F.col("_off") + F.when(further, -F.col("size")).otherwise(F.col("size")))
    known = chosen.join(off, F.col("source").eqNullSafe(F.col("_of")))
    best = known.filter(fractional & (left < F.abs("_off"))).groupBy(F.col("_of").alias("_source")).agg(
        F.min(F.struct(left.alias("left"), F.col("place").alias("place"))).alias("_best")
    )
    marked = chosen.join(best, F.col("source").eqNullSafe(F.col("_source")), "left")
    reversed_ = F.floor("epochs") + F.when(further, 0).otherwise(1)
    here = F.coalesce(F.col("_best.place") == F.col("place"), F.lit(False))
    copies = F.when(here, reversed_).otherwise(F.col("copies")).cast("long")
    return marked.withColumn("copies", copies).drop("_source", "_best")


def resample(docs: DataFrame, planned: DataFrame) -> DataFrame:
    """The mix itself: every row of `docs` as often as the plan says, with the columns of `docs`.

    Equal rows are folded first and share their copies, so that a row repeated without end is one row
    per task before the shuffle.
    """
    keys = ["_id", "_source", "_text"]
    totals = planned.groupBy(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_key").alias("_text")
    ).agg(F.sum("copies").alias("_copies"))
    folded = docs.withColumns({
        "_id": F.col("doc_id"), "_source": F.col("source"), "_text": F.xxhash64("text")
    }).dropDuplicates(keys)
    # Null keys are part of the key; both sides are flagged rather than dropped by the join.
    sides = [
        frame.withColumns({
            "_nulls": F.concat_ws("", *[F.col(k).isNull().cast("string") for k in keys]),
            "_id": F.coalesce("_id", F.lit(0)), "_source": F.coalesce("_source", F.lit("")),
        }) for frame in (folded, totals)
    ]
    joined = sides[0].join(sides[1], [*keys, "_nulls"])
    times = F.explode(F.sequence(F.lit(1), F.col("_copies")))
    return joined.filter("_copies > 0").select(*docs.columns, times.alias("_time")).drop("_time")
