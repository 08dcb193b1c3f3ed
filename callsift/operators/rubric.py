"""Rubric views: enabled rules, orderings, counts and the text given to a model.

A rubric is configuration that has to fit into a model prompt, so gathering its rules into one text
is bounded by that. Rule tables of any size go through the filters, orderings and counts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.functions.numbers import EXACT, count_where, weight_percent

def rule_order() -> tuple[Column, ...]:
    """By section, heaviest first, then name; unknown values last."""
    return (
        F.asc_nulls_last("section_name"),
        F.desc_nulls_last("effective_weight"),
        F.asc_nulls_last("criteria_name"),
    )


# Other names under which a rubric may hold a column.
OTHER_NAMES = {"effective_weight": "weight", "what_to_check": "description"}


def standard_rubric(rubric: DataFrame) -> DataFrame:
    """A rubric under its usual column names; without an `enabled` column all rules count."""
    for usual, other in OTHER_NAMES.items():
        if usual not in rubric.columns:
            held = F.col(other) if other in rubric.columns else F.lit(None).cast("string")
            rubric = rubric.withColumn(usual, held)
    if "enabled" not in rubric.columns:
        rubric = rubric.withColumn("enabled", F.lit(True))
    return rubric


def enabled_rules(rubric: DataFrame) -> DataFrame:
    return rubric.filter("enabled")


def with_weight_percent(rubric: DataFrame, col: str = "effective_weight") -> DataFrame:
    return rubric.withColumn("weight_pct", weight_percent(F.col(col)))


def sorted_rules(rubric: DataFrame, k: int | None = None) -> DataFrame:
    """Rules by section, then heaviest first, then name; optionally only the first k."""
    ordered = rubric.orderBy(*rule_order())
    return ordered if k is None else ordered.limit(k)


def rubric_counts(rubric: DataFrame) -> DataFrame:
    """Rules, enabled rules and weight total by section, and whether the total is one."""
    total = F.sum(F.col("criteria_weight").cast(EXACT))
    return rubric.groupBy("section_name").agg(
        F.count("*").alias("rules"),
        count_where(F.col("enabled")).alias("enabled_rules"),
        total.cast("double").alias("weight_sum"),
        (total == 1).alias("sums_to_one"),
    )


def _position() -> Column:
    """The place of a rule in `rule_order` as one comparable value."""
    weight = F.col("effective_weight")
    return F.struct(
        F.col("section_name").isNull().alias("s0"),
        F.col("section_name").alias("s1"),
        weight.isNull().alias("w0"),
        (-weight).alias("w1"),
        F.col("criteria_name").isNull().alias("c0"),
        F.col("criteria_name").alias("c1"),
    )


def _ordered_join(order: Column, text: Column, separator: str) -> Column:
    lines = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(lines, lambda line: line["t"]), separator)


def _or_blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def rubric_text(rubric: DataFrame) -> DataFrame:
    """Enabled rules as one text: a line per section, below it a line per criterion.

    A rubric without sections gives one line per criterion, heaviest first.
    """
    rubric = standard_rubric(rubric)
    percent = F.when(F.coalesce("effective_weight", F.lit(0.0)) == 0, "0").otherwise(
        weight_percent(F.col("effective_weight")).cast("string")
    )
    line = F.concat(
        _or_blank("criteria_name"), F.lit(" ("), percent, F.lit("%): "), _or_blank("what_to_check")
    )
    if "section_name" not in rubric.columns:
        flat = rubric.withColumn("section_name", F.lit(None).cast("string"))
        listed = _ordered_join(_position(), F.concat(F.lit("- "), line), "\n")
        return enabled_rules(flat).agg(listed.alias("rubric_text"))
    section = F.coalesce(F.nullif(F.col("section_name"), F.lit("")), F.lit("General"))
    rules = enabled_rules(rubric).select(
        section.alias("section"), _position().alias("position"),
        F.concat(F.lit("  • "), line).alias("line"),
    )
    blocks = rules.groupBy("section").agg(
        F.min("position").alias("position"),
        _ordered_join(F.col("position"), F.col("line"), "\n").alias("lines"),
    )
    block = F.concat(F.lit("- "), "section", F.lit(":\n"), "lines")
    return blocks.agg(_ordered_join(F.col("position"), block, "\n").alias("rubric_text"))


def rubric_prompt(rubric: DataFrame) -> DataFrame:
    """Enabled rules with their pass and fail examples as one text."""
    entry = F.concat(
        F.lit("In section "), _or_blank("section_name"),
        F.lit("\nRule "), _or_blank("criteria_name"),
        F.lit("\nAsks: "), _or_blank("what_to_check"),
        F.lit("\nMet, e.g.: "), _or_blank("good_example"),
        F.lit("\nNot met, e.g.: "), _or_blank("bad_example"),
        F.lit("\n\n"),
    )
    return enabled_rules(rubric).agg(_ordered_join(_position(), entry, "").alias("rubric_prompt"))
