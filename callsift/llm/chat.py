"""Chat formatting by prefix-target expansion.

Every assistant turn is an example of its own: all turns before it are context, and only that reply is
trainable. Because the template formats turn after turn, an example's text is a prefix of its
conversation's formatted text. Examples are therefore kept as one row per turn: the formatted turn,
where it lies in the conversation, and for an assistant turn the example it ends (its length and the
span under the loss mask). That is as long as the input, whatever the length of a conversation;
`example_texts` writes the prefixes out as whole strings, and `read_back` reads them, not the turns. Written
out, a conversation's examples grow with the square of its turns; a task holds one example at a time.

A turn is written as `<|role|>`, a line break, the text, `<|end|>` and a line break. Inside role and
text a backslash and a bar get a backslash in front, so no text can contain a mark, and reading back
drops exactly those backslashes.

Defined results: null or empty text is an empty turn, null role an empty role; turns of equal number
are ordered by role and text, a null turn comes first; rows with null conv_id are one conversation;
repeated rows are turns of their own; an empty table has no turns. Only the four columns are read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.llm.common import running

TARGET = "assistant"
TURN_END = "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\|])", r"\\$1")


def examples(conversations: DataFrame) -> DataFrame:
    """One row per turn, in order by (conv_id, turn_no).

    conv_id, turn_no (from 1), piece (the formatted turn), start (of the piece in the conversation),
    example_no (which example a turn completes; null unless it is the target), example_chars (the
    example's length), loss_start and loss_end (in the example; escaped characters).
    """
    head = F.concat(F.lit("<|"), escaped(F.col("role")), F.lit("|>\n"))
    pieces = conversations.select(
        "conv_id", "turn", "role", "text", head.alias("_head"),
        F.concat(head, escaped(F.col("text")), F.lit(TURN_END)).alias("piece"),
    ).withColumn("_target", F.coalesce(F.col("role") == TARGET, F.lit(False)))
    placed = running(
        pieces, ["conv_id"], ["turn", "role", "text"],
        turn_no=F.lit(1), _end=F.length("piece"), _example=F.col("_target"),
    )
    start = F.col("_end") - F.length("piece")

    def targets(value: Column) -> Column:
        return F.when(F.col("_target"), value)

    return placed.select(
        "conv_id", "turn_no", "piece", start.alias("start"),
        targets(F.col("_example")).alias("example_no"),
        targets(F.col("_end")).alias("example_chars"),
        targets(start + F.length("_head")).alias("loss_start"),
        targets(F.col("_end") - len(TURN_END)).alias("loss_end"),
    )


_PLAIN = r"([^|\\]*(?:\\.[^|\\]*)*)"
_PIECE = re.compile(rf"<\|{_PLAIN}\|>\n{_PLAIN}<\|end\|>\n", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def read_piece(piece: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    if piece.endswith(TURN_END) and "\\" not in piece:
        role, _, text = piece[2 : -len(TURN_END)].partition("|>\n")
        return role, text
    role, text = _PIECE.fullmatch(piece).groups()
    return _ESCAPE.sub(r"\1", role), _ESCAPE.sub(r"\1", text)


def in_order(rows: DataFrame) -> DataFrame:
    """Turns dealt out by conversation, in order within each; sorting spills, nothing is gathered."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")


Written = tuple[int | None, int | None, str, int | None, int | None]


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[Written]:
    """(conv_id, example_no, text, loss_start, loss_end) of every example, its text written out whole, and
    without a number the turns after a conversation's last reply."""
    names = ("conv_id", "piece", "example_no", "loss_start", "loss_end")
    begun, key, parts, new = False, None, [], 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in names]
        for conv, piece, number, start, end in zip(*columns, strict=True):
            if not begun or conv != key:
                if new:
                    yield key, None, "".join(parts[-new:]), None, None
                begun, key, parts, new = True, conv, [], 0
            parts.append(piece)
            new += 1
            if number is not None:
                parts, new = ["".join(parts)], 0
                yield key, number, parts[0], start, end
    if new:
        yield key, None, "".join(parts[-new:]), None, None


def _turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    at = 0
    while at < len(text):
        found = _PIECE.match(text, at)
        if found is None:
            raise ValueError(f"no formatted turn at character {at}")
        role, said = found.groups()
        yield (_ESCAPE.sub(r"\1", role), _ESCAPE.sub(r"\1", said)) if "\\" in found[0] else (role, said)
        at = found.end()


def read_back(rows: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its examples as `example_texts` writes them.

    Every example is written out and read in the same task, one at a time: it has to begin with the example
    before it, what follows are further turns, and its reply is what lies under the loss mask.
    """
    kinds = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long, n_examples long")
    names = [k.split()[0] for k in kinds.split(", ")]

    def told(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(c, pa.string() if n.endswith("sha256") else pa.int64())
            for n, c in zip(names, zip(*done, strict=True), strict=True)
        ], names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for key, examples_of in itertools.groupby(_written(batches), key=lambda example: example[0]):
            n_turns = loss_chars = formatted = n_examples = 0
            turns, loss, before = hashlib.sha256(), hashlib.sha256(), ""
            for _, number, text, start, end in examples_of:
                further = text
                if number is not None:
                    if not text.startswith(before):
                        raise ValueError("an example does not begin with the one before it")
                    further, before = text[len(before):], text
                    reply = _ESCAPE.sub(r"\1", text[start:end])
                    loss_chars += len(reply)
                    loss.update(reply.encode())
                    n_examples += 1
                for role, said in _turns(further):
                    n_turns += 1
                    turns.update(f"{role}\n{said}\n".encode())
                formatted += len(text)
            done.append((key, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted, n_examples))
            if len(done) == 1000:
                yield told(done)
                done.clear()
        if done:
            yield told(done)

    return in_order(rows).mapInArrow(digest, kinds)


def example_texts(rows: DataFrame) -> DataFrame:
    """(conv_id, example_no, text, loss_start, loss_end): the examples written out whole.

    Their total length grows with the square of a conversation's turns.
    """
    kinds = "conv_id long, example_no long, text string, loss_start long, loss_end long"
    schema = pa.schema([("conv_id", pa.int64()), ("example_no", pa.int64()), ("text", pa.string()),
                        ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for example in _written(batches):
            if example[1] is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([value], field.type) for value, field in zip(example, schema, strict=True)],
                    schema=schema)

    return in_order(rows).mapInArrow(write, kinds)
