import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import AWKWARD, awkward, empty
from tokenizers import Tokenizer

from callsift.llm import packing, tokens

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def best_fit(lengths, limit):
    """One piece at a time into the tightest bin."""
    room = []
    for length in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= length]
        if fits:
            room[min(fits)[1]] -= length
        else:
            room.append(limit - length)
    return sorted(room)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120), st.integers(30, 40))
def test_runs_are_best_fit_decreasing(lengths, limit):
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    bins, placed = defaultdict(list), defaultdict(int)
    for length, begin, end, first, each, base in packing.runs(dict(counts), limit):
        assert begin == placed[length]
        placed[length] = end
        for k in range(end - begin):
            bins[first + k // each].append((base + (k % each) * length, length))
    assert placed == counts
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= limit
    assert sorted(limit - sum(n for _, n in held) for held in bins.values()) == best_fit(lengths, limit)


def test_tightest_capacity():
    tree, open_now = packing.Capacities(50), set()
    pick = random.Random(1)
    for _ in range(500):
        c = pick.randint(1, 50)
        if c in open_now and pick.random() < 0.6:
            tree.take(c)
            if not tree.bins[c]:
                open_now.discard(c)
        else:
            tree.add(c, 0, 1)
            open_now.add(c)
        for length in (1, 17, 50):
            assert tree.tightest(length) == min((x for x in open_now if x >= length), default=None)


@pytest.mark.parametrize("n,want", [(1, [0, 1]), (4, [0, 4]), (5, [0, 1, 5]), (8, [0, 4, 8]),
                                    (11, [0, 3, 7, 11])])
def test_only_the_first_piece_is_shorter(n, want):
    assert packing.cut_points(n, 4) == want


def test_pieces_hold_the_library_ids(spark):
    slow = Tokenizer.from_file(BYTES)
    got = packing.pieces(awkward(spark), BYTES, 64, with_ids=True).collect()
    texts = defaultdict(list)
    for r in got:
        assert len(r["ids"]) == r["length"] <= 64
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]
        texts[r["doc_id"]].append((r["start"], r["ids"]))
    for i, text in enumerate(AWKWARD):
        want = slow.encode(text or "", add_special_tokens=False).ids + [0]
        parts = {start: ids for start, ids in texts[i]}
        joined = [x for start in sorted(parts) for x in parts[start]]
        assert joined == want


def test_special_strings_in_texts_are_the_librarys():
    slow, ids = Tokenizer.from_file(BYTES), tokens.byte_pair_ids(BYTES)
    pick = random.Random(3)
    signs = [chr(c) for c in range(9, 0x180)] + ["<|endoftext|>", "  ", "\n\n", "'ll", "漢"]
    for _ in range(3000):
        text = "".join(pick.choice(signs) for _ in range(pick.randint(0, 30)))
        assert list(ids(text)) == slow.encode(text, add_special_tokens=False).ids


def test_packed_places(spark):
    got = packing.pack(packing.pieces(awkward(spark), BYTES, 128), 128).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) == len(best_fit([r["length"] for r in got], 128))
    assert packing.pack(packing.pieces(empty(spark), BYTES, 128), 128).count() == 0
