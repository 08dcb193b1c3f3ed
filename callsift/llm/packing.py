"""Best-fit packing: documents as token pieces in as few sequences of a fixed length as possible.

Best-fit decreasing only looks at lengths, and there are at most `limit` of them. So the whole run
over all documents is carried out exactly on the table of lengths and their counts: pieces of one
length go, as a batch, into the tightest open bins, which a segment tree over remaining capacities
finds in logarithmic time. The result is a bounded list of runs ("the pieces of this length from
place a on go to the bins from b on, q to a bin"), and Spark gives every piece its place in its
length and looks its run up. No task or driver ever holds the pieces.

Defined results: null text is empty and gives one piece with the end id; a document of more than
`limit` ids is cut so that only its first piece may be shorter; repeated rows are packed each; an
empty table gives no pieces. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.llm.common import running
from callsift.llm.tokens import byte_pair_ids
from callsift.session import settle

PIECE = ("doc_id long, piece int, start long, length long, ids_crc32 long")


def cut_points(n: int, limit: int) -> list[int]:
    """Where pieces begin, and the end; all but the first hold `limit` ids."""
    first = n % limit or limit
    return [0, *range(min(first, n), n + 1, limit)]


def pieces(docs: DataFrame, tokenizer: str, limit: int, end_id: int = 0,
           with_ids: bool = False) -> DataFrame:
    """Token pieces of whole texts, each document's ids followed by `end_id`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(5 + with_ids)]
            ids_of = byte_pair_ids(tokenizer)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(ids_of(text.as_py() or ""), end_id).astype("<u4")
                points = cut_points(len(ids), limit)
                for i, (a, b) in enumerate(zip(points, points[1:], strict=False)):
                    row = (doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                    for held, value in zip(columns, (*row, ids[a:b].tolist()), strict=False):
                        held.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = [*(c.split()[0] for c in PIECE.split(", ")), "ids"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names[: len(columns)]
            )

    kept = docs.select(F.col("doc_id").cast("long"), "text")
    return kept.mapInArrow(cut, PIECE + (", ids array<long>" if with_ids else ""))


class Capacities:
    """Open bins by remaining capacity, as intervals of bin numbers, under a segment tree."""

    def __init__(self, limit: int):
        self.leaves = 1 << limit.bit_length()
        self.open = np.zeros(2 * self.leaves, dtype=bool)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]

    def _mark(self, capacity: int) -> None:
        at = self.leaves + capacity
        self.open[at] = bool(self.bins[capacity])
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def add(self, capacity: int, first: int, count: int) -> None:
        if capacity and count:
            self.bins[capacity].append((first, count))
            self._mark(capacity)

    def take(self, capacity: int) -> tuple[int, int]:
        found = self.bins[capacity].pop()
        self._mark(capacity)
        return found

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of an open bin that still holds `length`."""
        at = self.leaves + length
        while not self.open[at]:
            while at % 2:  # a right child: nothing further right below this parent
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at + (not self.open[2 * at])
        return at - self.leaves


def runs(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over {length: pieces}: (length, from place, to place, bin, per bin, offset).

    Places count from 0 within a length. A bin that takes a piece and still holds another of the same
    length is then the tightest, so it takes as many as fit before the next bin is looked for.
    """
    free, used, found = Capacities(limit), 0, []
    for length in sorted(counts, reverse=True):
        place, left = 0, counts[length]
        while left:
            room = free.tightest(length)
            if room is None:
                room = limit
                first, count = used, -(-left // (limit // length))
                used += count
            else:
                first, count = free.take(room)
            each = room // length
            filled = min(count, left // each)
            if not filled:  # one bin that takes the last few
                filled, each = 1, left
            found.append((length, place, place + filled * each, first, each, limit - room))
            free.add(room - each * length, first, filled)
            place, left = place + filled * each, left - filled * each
            if filled < count:
                if room == limit and left:  # new bins not reached yet: the last is not full
                    found.append((length, place, place + left, first + filled, left, 0))
                    free.add(limit - left * length, first + filled, 1)
                    place, left = place + left, 0
                elif room < limit:
                    free.add(room, first + filled, count - filled)
    return found


def pack(cut: DataFrame, limit: int) -> DataFrame:
    """`cut` with sequence_id and offset: the sequence of each piece and its place there."""
    stored = settle(cut, "pieces")
    counts = dict(stored.groupBy("length").count().collect())  # at most `limit` rows
    frame = pd.DataFrame(
        runs(counts, limit), columns=["_length", "_from", "_to", "_bin", "_each", "_base"], dtype="int64"
    )
    looked_up = cut.sparkSession.createDataFrame(
        frame, "_length long, _from long, _to long, _bin long, _each long, _base long"
    )
    placed = running(stored, ["length"], ["doc_id", "piece", "ids_crc32"], _place=F.lit(1))
    at = F.col("_place") - 1
    within = (F.col("length") == F.col("_length")) & (at >= F.col("_from")) & (at < F.col("_to"))
    step = at - F.col("_from")
    return placed.join(F.broadcast(looked_up), within).select(
        *cut.columns,
        (F.col("_bin") + F.floor(step / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_base") + (step % F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )
