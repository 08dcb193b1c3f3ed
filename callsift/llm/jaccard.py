"""N-gram Jaccard join as a metric-space join: pivots, Voronoi regions, triangle-inequality windows.

Jaccard distance is a metric, but nearly all pairs of documents lie at distance 1, where no window can
tell them apart. So the space is first cut where it is exactly safe to cut it: two sets that share
`percent` of their union share one of the first |x| - percent |x| + 1 shingles of each, under any
common order (here: seldom shingles first). The documents with such a shingle in common form a
region, regions with the same members are joined once, and everything below happens inside regions:

- A signature counts a set's shingles in 512 cells of the hash space. The L1 distance of signatures is
  a metric too, and never more than the size of the symmetric difference, which a link bounds by
  (100 - percent) / (100 + percent) of both sizes. So it gives exact triangle-inequality windows.
- First every region elects pivots, and each document hooks to the first pivot within reach. These
  pairs are checked on the whole sets. What is linked is one component from here on, and pairs inside
  a component need no further look; a group of thousands of copies costs thousands of checks.
- Regions that still hold several components are joined exactly: pivots split them into Voronoi
  cells, a document is replicated into the cells whose window it falls into, cells are split again
  until they are small or no longer get smaller, and all pairs of different components there whose
  signatures are within reach are checked on the whole sets.

Regions of more than BLOCK members are split in Spark, by pivots, cells and windows shared by all tasks;
cells that are still large, and don't get smaller, are cut into blocks, and a task compares two of them.
Inside a task the same goes on with smaller cells. The driver holds bit tables, which only ever save work;
they grow with the number of keys in them, up to 128 MB.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; a text with
fewer words than a shingle is one shingle; equal sets are one node and always linked; rows that share a
doc_id are one document; rows without doc_id link like all others, and a component of such rows alone has
a null id; an empty table gives no rows. Only doc_id and text are read; doc_id must be a whole number or
a text of one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.llm.common import mix, window_hashes, word_hashes
from callsift.llm.components import components
from callsift.plans.sizing import lookup_side
from callsift.session import settle, settled

CELLS = 512
BIT_TABLE, MOST_BITS = 1 << 24, 1 << 30
OFTEN = 32  # a shingle that more documents than this begin with goes to the end of the order
BLOCK = 2048
SMALL = 96
PIVOTS = 8
REGION_PIVOTS = 24  # about so many split a region, or cell, of more than BLOCK members


def row_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted hashes of the distinct n-word shingles of each whole text."""
    for _, words, begins in word_hashes(column, lower=True):
        windows = window_hashes(words, n)
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            if b - a >= n:
                yield np.unique(windows[a : b - n + 1])
            else:
                yield window_hashes(words[a:b], b - a) if b > a else words[:0]


def first_shingles(shingles: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """Those of a set of which every linked set has one among its own, shingles seen often last."""
    n = len(shingles)
    if not n:
        return shingles
    late = in_table(often, shingles)
    return np.concatenate([shingles[~late], shingles[late]])[: n - (percent * n + 99) // 100 + 1]


def signature(shingles: np.ndarray) -> bytes:
    cells = (shingles >> np.uint64(24)) & np.uint64(CELLS - 1)
    return np.minimum(np.bincount(cells.astype(np.int64), minlength=CELLS), 255).astype("u1").tobytes()


def table_size(n: int) -> int:
    """Bits for n keys, so that about one other value in sixteen is taken for one of them at most; no more
    than MOST_BITS, which is 128 MB, beyond which more are."""
    return min(MOST_BITS, max(BIT_TABLE, 1 << (16 * n - 1).bit_length()))


def bit_table(values: DataFrame, size: int = BIT_TABLE) -> np.ndarray:
    """Which remainders modulo `size`, a power of two, the long column `v` has, as packed bits."""
    placed = values.select(F.pmod(F.col("v"), F.lit(size)).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    word = F.floor(F.col("at") / 64).cast("int").alias("word")
    words = placed.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()
    held = np.zeros(size // 64, dtype="<i8")
    held[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return held.view("u1")


def in_table(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit values may be in a bit table."""
    at = values.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def seen_often(docs: DataFrame, n: int, percent: int, often: int) -> np.ndarray:
    """Bits of the shingles that more than `often` documents begin with, counted over all documents."""
    nothing = np.zeros(1, dtype="u1")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [first_shingles(s, nothing, percent) for s in row_sets(batch.column(0), n)]
            flat = np.concatenate(found) if found else np.empty(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], ["v"])

    counted = docs.select("text").mapInArrow(begin, "v long").groupBy("v").count()
    with settled(counted.filter(F.col("count") > often).select("v"), "often") as found:
        return bit_table(found, table_size(found.count()))


def described(docs: DataFrame, often: np.ndarray, n: int, percent: int) -> DataFrame:
    """Per row: doc_id, a hash of its text (null counts as empty), set size, the set's 128-bit digest (hi,
    lo), its first shingles and signature.

    A task leaves out shingles and signature of a set that it has described before.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(often)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shipped.value
        known: set[bytes] = set()
        for batch in batches:
            sizes, digests, firsts, signed = [], [], [], []
            for shingles in row_sets(batch.column(1), n):
                sizes.append(len(shingles))
                digest = xxhash.xxh3_128_digest(shingles.tobytes())
                digests.append(digest)
                fresh = digest not in known and len(shingles) > 0
                known.add(digest)
                firsts.append(first_shingles(shingles, late, percent).view(np.int64) if fresh else None)
                signed.append(signature(shingles) if fresh else None)
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(halves[:, 0]),
                pa.array(halves[:, 1]), pa.array(firsts, pa.list_(pa.int64())),
                pa.array(signed, pa.binary()),
            ], ["doc_id", "text_key", "n", "hi", "lo", "firsts", "signed"])

    return docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("text_key")).mapInArrow(
        describe,
        "doc_id long, text_key long, n long, hi long, lo long, firsts array<long>, signed binary",
    )


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def shared_members(rows: DataFrame) -> DataFrame:
    """(region, hi, lo): the sets that have a first shingle in common with another set."""
    begun = rows.filter(F.col("firsts").isNotNull())
    each = begun.select(F.explode("firsts").alias("region"), "hi")
    shared = settle(
        each.groupBy("region").agg(F.min("hi").alias("a"), F.max("hi").alias("b"))
        .filter("a < b").select("region"), "shared",
    )
    bits = bit_table(shared.select(F.col("region").alias("v")), table_size(shared.count()))
    shipped = rows.sparkSession.sparkContext.broadcast(bits)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shipped.value
        for batch in batches:
            firsts = batch.column("firsts")
            flat = firsts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(batch)), firsts.value_lengths().to_numpy(zero_copy_only=False))
            kept = in_table(wanted, flat)
            at = pa.array(row[kept])
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[kept]), batch.column("hi").take(at), batch.column("lo").take(at)],
                ["region", "hi", "lo"],
            )

    likely = begun.select("firsts", "hi", "lo").mapInArrow(candidates, "region long, hi long, lo long")
    return likely.join(shared, "region").distinct()


def distinct_regions(members: DataFrame) -> DataFrame:
    """`members` with one region for each set of members, and `size`, how many they are."""
    named = settle(members.groupBy("region").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    ), "regions")
    kept = named.filter("size > 1").groupBy("size", "x", "y").agg(F.min("region").alias("region"))
    return members.join(kept.select("region", "size"), "region")


def reach(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The most that the symmetric difference of a link of a set of this size can be."""
    return sizes * (100 + 10000 / percent) * (100 - percent) / (100 + percent) / 100 + 1e-6


class Block:
    """Members of a region in numpy: nodes, components, sizes and signatures."""

    def __init__(self, table: pa.Table, percent: int):
        self.node = table.column("node").to_numpy()
        self.component = table.column("component").to_numpy()
        self.size = table.column("n").to_numpy()
        self.cells = signatures(table.column("signed").to_pylist())
        self.percent = percent

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """L1 distance of signatures, pair by pair."""
        out = np.empty(len(a), dtype=np.int64)
        for i in range(0, len(a), 1 << 14):
            part = slice(i, i + (1 << 14))
            out[part] = np.abs(self.cells[a[part]] - self.cells[b[part]]).sum(axis=1, dtype=np.int64)
        return out

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs may be linked, by component, size and signature."""
        x, y = self.size[a], self.size[b]
        kept = np.flatnonzero((self.component[a] != self.component[b]) & (
            100 * np.minimum(x, y) >= self.percent * np.maximum(x, y)))
        both = x[kept] + y[kept]
        near = (100 + self.percent) * self.apart(a[kept], b[kept]) <= (100 - self.percent) * both
        return kept[near]

    def hooked(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each member once with the first pivot within its reach; the others become pivots."""
        left, found = np.arange(len(self.node)), []
        while len(left) > 1:
            pivot, left = left[0], left[1:]
            near = self.possible(np.full(len(left), pivot), left)
            found.append((np.full(len(near), pivot), left[near]))
            left = np.delete(left, near)
        return found

    def joined(self, home: np.ndarray, guests: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All possible pairs of `home` with `home` and `guests`, by Voronoi cells and their windows."""
        members = np.concatenate([home, guests])
        if len(home) > SMALL:
            pivots = home[np.linspace(0, len(home) - 1, PIVOTS).astype(int)]
            away = np.stack([self.apart(members, np.full(len(members), p)) for p in pivots], axis=1)
            cell = away.argmin(axis=1)
            window = away.min(axis=1) + 2 * reach(self.size[members], self.percent)
            inside = away <= window[:, None]
            if inside.sum() < PIVOTS * len(members) // 3:
                for i in range(PIVOTS):
                    own = members[: len(home)][cell[: len(home)] == i]
                    stay = np.ones(len(members), dtype=bool)
                    stay[: len(home)] = cell[: len(home)] != i
                    if len(own) and len(own) < len(home):
                        yield from self.joined(own, members[inside[:, i] & stay])
                    elif len(own):
                        yield from self.compared(own, members[inside[:, i] & stay])
                return
        yield from self.compared(home, guests)

    def compared(self, home: np.ndarray, guests: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        members = np.concatenate([home, guests])
        for i, x in enumerate(home):
            others = members[i + 1 :]
            near = self.possible(np.full(len(others), x), others)
            if len(near):
                yield np.full(len(near), x), others[near]


PAIR = "a long, b long"
NO_PAIRS = np.empty((0, 2), dtype=np.int64)


def pairs_of(block: Block, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The nodes of the found places, the smaller one first, each pair once."""
    if not found:
        return NO_PAIRS
    a = np.concatenate([block.node[x] for x, _ in found])
    b = np.concatenate([block.node[y] for _, y in found])
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)


def in_groups(rows: DataFrame, keys: list[str], pairs: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """The distinct (a, b) that `pairs` finds in each group of rows with equal keys.

    Groups are many and mostly of a few rows, so they are dealt out and sorted by key and taken from
    the stream, rather than handed over one by one. A group must fit into memory.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def batch_of(groups: list[pa.Table]) -> pa.RecordBatch:
            found = np.concatenate([NO_PAIRS, *map(pairs, groups)])
            return pa.RecordBatch.from_arrays(
                [pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([rest, table]) if rest is not None else table
            new = np.zeros(len(held), dtype=bool)
            for key in keys:
                values = held.column(key).to_numpy()
                new[1:] |= values[1:] != values[:-1]
            ends = np.flatnonzero(new)
            begins = [0, *ends[:-1]]
            yield batch_of([held.slice(i, j - i) for i, j in zip(begins, ends, strict=False)])
            rest = held.slice(ends[-1]) if len(ends) else held
        if rest is not None and len(rest):
            yield batch_of([rest])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(find, PAIR).distinct()


def pivot_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of members with pivots of their region, each block of a region by itself."""
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)).alias("block")

    def hook(table: pa.Table) -> np.ndarray:
        held = Block(table.sort_by("node"), percent)
        return pairs_of(held, held.hooked())

    dealt = members.select("region", block, "node", "component", "n", "signed")
    return in_groups(dealt, ["region", "block"], hook)


MEMBER = "region long, part long, home boolean, node long, component long, n long, signed binary"


def split(places: DataFrame, percent: int, turn: int) -> DataFrame:
    """Places in the Voronoi cells of pivots of their part, for parts with pivots.

    Pivots are members by hash, about REGION_PIVOTS of each part. A home member is at home in the cell of its
    nearest pivot and a guest of the others whose window it falls into; a guest is one of all it falls into.
    """
    chosen = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("homes")) < REGION_PIVOTS
    pivots = places.filter(F.col("home") & chosen).groupBy("region", "part").agg(
        F.array_sort(F.collect_list(F.struct("node", "signed"))).alias("pivots"))
    dealt = places.drop("homes").join(lookup_side(pivots), ["region", "part"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            region, part = (table.column(c).to_numpy().view(np.uint64) for c in ("region", "part"))
            key = region ^ mix(part)
            for one in np.unique(key):
                own = table.filter(pa.array(key == one))
                listed = own.column("pivots")[0].as_py()
                middle = signatures([p["signed"] for p in listed])
                cells = signatures(own.column("signed").to_pylist())
                away = np.stack([np.abs(cells - m).sum(axis=1, dtype=np.int64) for m in middle], axis=1)
                window = away.min(axis=1) + 2 * reach(own.column("n").to_numpy(), percent)
                row, cell = np.nonzero(away <= window[:, None])
                home = np.array(own.column("home").to_pylist(), dtype=bool)
                home = home[row] & (away.argmin(axis=1)[row] == cell)
                names = mix(np.array([p["node"] for p in listed], dtype=np.int64).view(np.uint64)
                            ^ own.column("part").to_numpy()[:1].view(np.uint64)).view(np.int64)
                at = pa.array(row)
                yield from pa.table({
                    "region": own.column("region").take(at), "part": pa.array(names[cell]),
                    "home": pa.array(home), "node": own.column("node").take(at),
                    "component": own.column("component").take(at), "n": own.column("n").take(at),
                    "signed": own.column("signed").take(at), "parent": own.column("part").take(at),
                }).combine_chunks().to_batches()

    return dealt.mapInArrow(deal, f"{MEMBER}, parent long")


def signatures(signed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signed), dtype="u1").reshape(-1, CELLS).astype(np.int16)


def in_parts(members: DataFrame, percent: int) -> DataFrame:
    """`members` in parts small enough for a task, or that cells don't make smaller: places with `homes`, the
    members at home in the part, and `size`, guests included.

    Regions of more than BLOCK members are split into cells, and cells again, all of them in one shuffle per
    turn. A split is taken back where it copies members too often or leaves a cell nearly as large.
    """
    whole = members.select(
        "region", F.lit(0).cast("long").alias("part"), F.lit(True).alias("home"), "node", "component", "n",
        "signed", F.col("size").alias("homes"), "size",
    )
    done, left, turn = whole.filter(F.col("homes") <= BLOCK), whole.filter(F.col("homes") > BLOCK), 0
    left = settle(left, "places")
    while not left.isEmpty():
        cut = settle(split(left.drop("size"), percent, turn), "places")
        sizes = cut.groupBy("region", "parent", "part").agg(
            F.count_if("home").alias("homes"), F.count("*").alias("size"))
        before = left.groupBy("region", "part").agg(F.first("homes").alias("was"), F.count("*").alias("rows"))
        after = sizes.groupBy("region", F.col("parent").alias("part")).agg(
            F.max("homes").alias("most"), F.sum("size").alias("copies"))
        judged = settle(before.join(after, ["region", "part"], "left").select(
            "region", "part", (
                (F.col("copies") < REGION_PIVOTS * F.col("rows") / 3) & (F.col("most") < 0.9 * F.col("was"))
            ).alias("better")), "judged")
        better = judged.filter("better").select("region", F.col("part").alias("parent"))
        kept = judged.filter("NOT coalesce(better, false)").select("region", "part")
        done = done.unionByName(left.join(kept, ["region", "part"]))
        now = cut.join(better, ["region", "parent"]).join(
            sizes.filter("homes > 0"), ["region", "parent", "part"]).drop("parent")
        now = settle(now, "places")
        done = done.unionByName(now.filter(F.col("homes") <= BLOCK))
        left = settle(now.filter(F.col("homes") > BLOCK), "places")
        turn += 1
    return done


def remaining_pairs(members: DataFrame, percent: int) -> DataFrame:
    """All possible pairs across components, every two blocks of a part compared once."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    placed = in_parts(members, percent)
    dealt = placed.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("node"), blocks)}).select(
        "region", "part", "home", "node", "component", "n", "signed", "own",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"),
    ).select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def join(table: pa.Table) -> np.ndarray:
        held = Block(table, percent)
        home = np.array(table.column("home").to_pylist(), dtype=bool)
        own, i = table.column("own").to_numpy(), table.column("i").to_numpy()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own != i)
        if len(right):  # two blocks: pairs inside one are another task's
            found = []
            for x in left:
                others = right if home[x] else right[home[right]]
                near = held.possible(np.full(len(others), x), others)
                found.append((np.full(len(near), x), others[near]))
        else:
            found = list(held.joined(left[home[left]], left[~home[left]]))
        return pairs_of(held, found)

    return in_groups(dealt, ["region", "part", "i", "j"], join)


def sets_of(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, shingles) of the given (node, hi, lo, _least), from whole texts of the rows with these ids.

    A set that only rows without doc_id hold is found by its digest among these rows. A task gives each
    set once.
    """
    size = table_size(nodes.count())
    known = bit_table(nodes.filter(F.col("_least").isNotNull()).select(F.col("_least").alias("v")), size)
    nameless = bit_table(nodes.filter(F.col("_least").isNull()).select(F.col("hi").alias("v")), size)
    shipped = docs.sparkSession.sparkContext.broadcast((known, nameless))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, by_digest = shipped.value
        some_nameless, given = by_digest.any(), set()
        for batch in batches:
            no_id = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            asked = in_table(wanted, ids) & ~no_id | (no_id & some_nameless)
            part = batch.take(pa.array(np.flatnonzero(asked)))
            held, halves = [], []
            for i, shingles in enumerate(row_sets(part.column(1), n)):
                digest = xxhash.xxh3_128_digest(shingles.tobytes())
                halves_of = np.frombuffer(digest, dtype="<i8")
                hi, lo = (int(x) for x in halves_of)
                listed = part.column(0)[i].is_valid or in_table(by_digest, halves_of[:1])[0]
                if listed and digest not in given:
                    given.add(digest)
                    held.append(shingles.view(np.int64))
                    halves.append((hi, lo))
            yield pa.RecordBatch.from_arrays([
                pa.array([hi for hi, _ in halves], pa.int64()), pa.array([lo for _, lo in halves], pa.int64()),
                pa.array(held, pa.list_(pa.int64())),
            ], ["hi", "lo", "shingles"])

    built = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        build, "hi long, lo long, shingles array<long>"
    )
    found = built.join(nodes.select("node", "hi", "lo"), ["hi", "lo"])
    return found.dropDuplicates(["hi", "lo"]).select("node", "shingles")


def checked(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """The (a, b) pairs that are links, by the exact similarity of their whole sets."""
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    wanted = nodes.join(asked.distinct(), "node").select("node", "hi", "lo", "_least")
    held = settle(sets_of(docs, settle(wanted, "asked"), n), "sets")
    x = held.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = held.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return pairs.join(x, "a").join(y, "b").filter(100 * common >= percent * union).select("a", "b")


def linked(docs: DataFrame, n: int = 4, percent: int = 85, often: int = OFTEN) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles and component_id, the smallest doc_id that links
    reach. Two documents link when they share `percent` of the union of their n-word shingles.

    Two more columns serve rows that doc_id can't tell apart: `text_key`, see above, and `group`, a number
    of the component whether or not it has a doc_id, null for an empty set.
    """
    rows = settle(described(docs, seen_often(docs, n, percent, often), n, percent), "described")
    nodes = settle(
        rows.filter("n > 0").groupBy("hi", "lo").agg(
            F.min("doc_id").alias("_least"), F.first("n").alias("n"),
            F.first("signed", ignorenulls=True).alias("signed"),
        ).select("hi", "lo", F.coalesce("_least", "hi").alias("node"), "_least", "n", "signed"),
        "nodes",
    )
    narrow = nodes.select("node", "hi", "n", "signed")
    regions = settle(distinct_regions(
        shared_members(rows).join(nodes.select("hi", "lo", "node"), ["hi", "lo"])
        .select("region", "node").distinct()
    ), "regions")
    alone = narrow.withColumn("component", F.col("node"))
    first = settle(pivot_pairs(regions.join(alone, "node"), percent), "pairs")
    links = settle(checked(docs, first, nodes, n, percent), "links")
    held = settle(components(links), "components")
    labelled = regions.join(held, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    open_regions = labelled.groupBy("region").agg(
        F.min("component").alias("a"), F.max("component").alias("b")
    ).filter("a < b").select("region")
    second = settle(
        remaining_pairs(labelled.join(open_regions, "region").join(narrow, "node"), percent)
        .join(first, ["a", "b"], "left_anti"), "pairs",
    )
    more = checked(docs, second, nodes, n, percent)
    final = components(links.unionByName(more))
    # A node without a doc_id of its own must not lend its digest as an id.
    ids = nodes.join(final, "node", "left").select(
        "hi", "lo", F.coalesce("component", "node").alias("component"), "_least"
    )
    named = settle(ids, "ids")
    least = named.groupBy("component").agg(F.min("_least").alias("component_id"))
    of_set = named.join(least, "component").select("hi", "lo", "component", "component_id")
    joined = rows.select("doc_id", "text_key", "n", "hi", "lo").join(of_set, ["hi", "lo"], "left")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "text_key", F.col("component").alias("group"),
    )
