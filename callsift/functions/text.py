"""Text expressions; all stay inside JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python counts as white space and as word characters.
SPACE_CLASS = r"\s\p{Z}\x1c-\x1f\x{85}"
WORD_CLASS = r"\p{L}\p{N}_"


def normalized(text: Column) -> Column:
    """Lower case without anything that is neither a word character nor white space."""
    return F.regexp_replace(F.lower(text), f"[^{WORD_CLASS}{SPACE_CLASS}]", "")


def stripped(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, rf"\A[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\z", "")


def word_count(text: Column) -> Column:
    """Number of white-space separated words; null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE_CLASS}]+")).cast("bigint")


def tokens(text: Column) -> Column:
    """Lower-case word tokens in order."""
    pattern = F.lit(f"[{WORD_CLASS}]+")
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), pattern, F.lit(0))


def dialogue(agent: Column, customer: Column) -> Column:
    """Both sides of a call as one labelled text."""
    return F.concat(
        F.lit("AGENT: "),
        F.coalesce(agent, F.lit("")),
        F.lit("\n\nCUSTOMER: "),
        F.coalesce(customer, F.lit("")),
    )


def head(text: Column, n: int) -> Column:
    """First n characters."""
    return F.substring(text, 1, n)


def stable_key(*parts: Column) -> Column:
    """A repeatable text key, so a re-run writes the same ids."""
    return F.sha2(F.concat_ws("|", *[part.cast("string") for part in parts]), 256)
