"""JSON inside free text: finding it, checking it, reading values of unknown type.

Parsed structs are never tested for null, since malformed text gives a struct of nulls. Spark's
parsers also stop after the first value and ignore what follows it. `parsed` is strict instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callsift.functions.text import stripped


def _between(text: Column, left: str, right: str) -> Column:
    found = F.regexp_extract(text, rf"(?s)\{left}.*\{right}", 0)
    return F.nullif(found, F.lit(""))


def array_part(text: Column) -> Column:
    """From the first `[` to the last `]`; null when there is no such part."""
    return _between(text, "[", "]")


def object_part(text: Column) -> Column:
    """From the first `{` to the last `}`; null when there is no such part."""
    return _between(text, "{", "}")


END = "~end of text~"


def wrapped(text: Column) -> Column:
    """The text and an end mark as the two elements of a JSON list, parsed; see `unwrapped`."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{END}"]')))


def unwrapped(pair: Column) -> Column:
    """The text's value if the end mark follows it directly, so nothing else came after the value."""
    whole = F.try_variant_get(pair, "$[1]", "string") == END
    return F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))


def parsed(text: Column) -> Column:
    """A text that is one JSON value as VARIANT, null for anything else."""
    return unwrapped(wrapped(text))


def without_fence(text: Column) -> Column:
    """Text without surrounding blanks and backticks and without the word json."""
    return F.replace(F.btrim(stripped(text), F.lit("`")), F.lit("json"), F.lit(""))


def truthy(value: Column) -> Column:
    """Whether a JSON value counts as true: false, 0, empty and null do not."""
    shown = F.to_json(value)
    zero = F.when(shown.rlike("^-?[0-9]"), F.coalesce(shown.try_cast("double") == 0, F.lit(False)))
    untrue = shown.isNull() | shown.isin("false", "null", '""', "[]", "{}")
    return ~(untrue | F.coalesce(zero, F.lit(False)))


def whole_number(value: Column, default: int) -> Column:
    """A JSON value as INT: missing gives the default, fractions are cut, other text gives null."""
    kind = F.schema_of_variant(value)
    as_text = stripped(F.try_variant_get(value, "$", "string"))
    return (
        F.when(value.isNull(), default)
        .when(kind == "BOOLEAN", F.when(as_text == "true", 1).otherwise(0))
        .when(kind == "STRING", F.when(as_text.rlike(r"^[+-]?\d+$"), as_text.try_cast("int")))
        .otherwise(F.try_variant_get(value, "$", "double").try_cast("int"))
    )


def text_list(document: Column, path: str) -> Column:
    """A JSON list as ARRAY<STRING>; a lone text becomes a list of one, anything else is empty."""
    listed = F.try_variant_get(document, path, "array<string>")
    single = F.nullif(F.try_variant_get(document, path, "string"), F.lit(""))
    alone = F.when(single.isNotNull(), F.array(single)).otherwise(F.array().cast("array<string>"))
    return F.coalesce(listed, alone)


def recovered(text: Column) -> Column:
    """The first readable JSON in a text: as is, without fence, then each braced snippet as is or
    with its quotes swapped; an empty object when nothing can be read. Returned as JSON text."""

    def json_of(candidate: Column) -> Column:
        """`parsed` as text; the lambda holds the parsed pair, so it is made once per candidate."""
        pairs = F.transform(F.array(candidate), wrapped)
        return F.get(F.transform(pairs, lambda pair: F.to_json(unwrapped(pair))), F.lit(0))

    def read(snippet: Column) -> Column:
        swapped = F.replace(snippet, F.lit("'"), F.lit('"'))
        return F.coalesce(json_of(snippet), json_of(swapped))

    snippets = F.regexp_extract_all(text, F.lit(r"(?s)\{.*?\}"), F.lit(0))
    readable = F.filter(F.transform(snippets, read), lambda s: s.isNotNull())
    return F.coalesce(
        json_of(text),
        json_of(F.btrim(stripped(text), F.lit("`"))),
        F.try_element_at(readable, F.lit(1)),
        F.lit("{}"),
    )
