"""Fill-in-middle examples, cut at token ranks that an indexable skip list turns into places in the text.

A text's tokens (white space and the word behind it; white space at the end is one of its own) are the
nodes of a skip list. Every link of every lane carries two widths: how many tokens and how many code
points it leaps. A cut is given as a number of tokens; descending from the widest lane, each link that
doesn't leap beyond the rank is taken, and the code points gathered on the way are the exact place of
the cut, found in a logarithmic number of steps. Which node rises to which lane is a fixed function of
its rank, so a repeated task builds the same list.

Cuts and form come from a digest of seed and doc_id alone. A text becomes `plain` (unchanged), `psm`
(prefix, suffix, middle) or `spm` (suffix, prefix, middle), each part behind its mark. A text that
holds a mark stays plain, so the parts can be told apart again and `restored` gives back every text.

Defined results: null text is empty, and an empty text is plain with no tokens; a null doc_id is
digested as nothing; repeated rows give the same example each; an empty table gives no rows; texts of
any length are cut whole. Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.llm.common import mix, text_bytes

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
SEED = 42
SPLIT_PERCENT = 50  # of texts that are cut at all
SUFFIX_FIRST_PERCENT = 80  # of these, with the suffix first

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def token_ends(text: np.ndarray) -> np.ndarray:
    """How many code points of a text in UTF-8 bytes lie before the end of each token."""
    if not len(text):
        return np.empty(0, dtype=np.int64)
    blank = _SPACE[text]
    last = ~blank
    last[:-1] &= blank[1:]
    last[-1] = True  # a word, or white space that no word follows
    begun = np.cumsum(text & 0xC0 != 0x80)
    return begun[last]


@dataclass(frozen=True)
class Lane:
    """The links of one lane, in order: the node each leads to, and its two widths."""

    node: np.ndarray
    units: np.ndarray
    points: np.ndarray


class SkipList:
    """Tokens under lanes that every fourth node or so rises to; ranks to places by accumulated widths.

    A node's place on the next lane's links is found by the number of risen nodes before it, so going
    down a lane needs no search.
    """

    def __init__(self, ends: np.ndarray):
        self.n = len(ends)
        at = np.arange(1, self.n + 1)  # a node stands behind its token: rank i has i tokens before it
        bits = mix(at.astype(np.uint64))
        self.lanes: list[Lane] = []
        self.below: list[np.ndarray] = []  # per lane, for each of its nodes the place one lane down
        own = np.arange(self.n)
        while True:
            self.lanes.append(Lane(at[own], np.diff(at[own], prepend=0), np.diff(ends[own], prepend=0)))
            lane = 2 * len(self.below)
            rises = (bits[own] >> np.uint64(lane)) & np.uint64(3) == 0
            if len(own) <= 4 or lane > 60 or not rises.any():
                break
            self.below.append(np.flatnonzero(rises))
            own = own[rises]

    def place(self, rank: int) -> tuple[int, int]:
        """The code points before the cut behind `rank` tokens, and the number of links looked at."""
        units = points = steps = 0
        link = 0  # the next link to take on the lane in hand
        for level in range(len(self.lanes) - 1, -1, -1):
            lane = self.lanes[level]
            while link < len(lane.node):
                steps += 1
                if units + lane.units[link] > rank:
                    break
                units += int(lane.units[link])
                points += int(lane.points[link])
                link += 1
            if level:
                link = int(self.below[level - 1][link - 1]) + 1 if link else 0
        if units != rank:
            raise ValueError(f"rank {rank} of {self.n} tokens")
        return points, steps


def drawn(doc_id: Column, seed: int = SEED) -> Column:
    """Four unsigned numbers of 32 bits from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[
        F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)
    ])


CUT = "n long, first long, second long"


def cuts(text: Column, draws: Column) -> Column:
    """Number of tokens and the code points before both cuts, as a struct."""

    @F.arrow_udf(CUT)
    def cut(texts: pa.Array, four: pa.Array) -> pa.Array:
        data, at = text_bytes(texts)
        found = np.empty((len(texts), 3), dtype=np.int64)
        for i, h in enumerate(four.to_pylist()):
            listed = SkipList(token_ends(data[at[i] : at[i + 1]]))
            low, high = sorted(x % (listed.n + 1) for x in h[:2])
            found[i] = listed.n, listed.place(low)[0], listed.place(high)[0]
        return pa.StructArray.from_arrays(list(found.T.copy()), ["n", "first", "second"])

    return cut(text, draws)


def transformed(docs: DataFrame, seed: int = SEED, split_percent: int = SPLIT_PERCENT,
                suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the example's text as `output`.

    Only cuts come from Python workers; texts stay where they are and are put together in Spark.
    """
    text = F.col("text")
    cut = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).withColumn(
        "draws", drawn(F.col("doc_id"), seed)
    ).withColumn("cut", cuts(text, F.col("draws")))
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | text.contains(mark)
    whole = (F.col("cut.n") == 0) | marked | (F.col("draws")[2] % 100 >= split_percent)
    suffix_first = F.col("draws")[3] % 100 < suffix_first_percent
    form = F.when(whole, "plain").when(suffix_first, "spm").otherwise("psm")
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix = F.substr(text, F.lit(1), first)
    middle = F.substr(text, first + 1, second - first)
    suffix = F.substr(text, second + 1, F.length(text))
    formed = cut.withColumn("form", form)
    output = (
        F.when(F.col("form") == "plain", text)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE),
                                               middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    was_cut = F.col("form") != "plain"
    return formed.select(
        "doc_id", F.col("cut.n").alias("n"), "form",
        F.when(was_cut, F.col("cut.first")).alias("prefix_chars"),
        F.when(was_cut, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an example was made of, from the example and its form alone."""
    behind = F.substr(output, F.lit(1 + len(PREFIX)), F.length(output))
    psm = F.split(behind, f"{SUFFIX}|{MIDDLE}", -1)
    spm = F.split(behind, f"{PREFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(psm[0], psm[2], psm[1]))
        .when(form == "spm", F.concat(spm[1], spm[2], spm[0]))
    )
