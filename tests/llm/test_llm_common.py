import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callsift.llm import common


def test_running_is_the_sum_in_order_at_any_skew(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"),
        "id", (F.col("id") % 7).alias("v"),
    ).withColumn("g", F.when(F.col("id") % 11 != 0, F.col("g")))
    got = common.running(df, ["g"], ["id"], total=F.col("v"), place=F.lit(1)).collect()
    sums: dict = {}
    for r in sorted(got, key=lambda r: r["id"]):
        total, place = sums.get(r["g"], (0, 0))
        sums[r["g"]] = total + r["v"], place + 1
        assert (r["total"], r["place"]) == sums[r["g"]]
    assert len(got) == 3000


def test_running_without_group_and_without_rows(spark):
    df = spark.range(100)
    got = common.running(df, [], [-F.col("id")], place=F.lit(1)).collect()
    assert {r["id"]: r["place"] for r in got} == {i: 100 - i for i in range(100)}
    assert common.running(df.filter("id < 0"), [], ["id"], place=F.lit(1)).count() == 0


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def hashes_of(texts, lower):
    out = [None] * len(texts)
    for row, words, begins in common.word_hashes(pa.array(texts, pa.string()), lower):
        for i in range(len(begins) - 1):
            out[row + i] = words[begins[i] : begins[i + 1]]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aAbB \t\n\x0b\x1c\x85 é漢", max_size=30), max_size=8))
def test_word_hashes_stand_for_words(texts):
    for lower in (False, True):
        held = hashes_of(texts, lower)
        seen: dict = {}
        for text, found in zip(texts, held, strict=True):
            fold = str.maketrans("AB", "ab") if lower else {}
            words = WORDS.findall((text or "").translate(fold))
            assert len(words) == len(found)
            for word, value in zip(words, found, strict=True):
                assert seen.setdefault(word, value) == value
        assert len(set(seen.values())) == len(seen)


def test_long_texts_are_read_whole():
    words = [f"w{i}" for i in range(400_000)]
    long, short = " ".join(words), "w5 w399999"
    held = hashes_of([short, long, short], False)
    assert len(held[1]) == 400_000 and held[1][5] == held[0][0] and held[1][-1] == held[2][1]
    giant = "y" * (3 * common.CHUNK)
    assert len(hashes_of([giant + " z"], False)[0]) == 2


def test_window_hashes_tell_order():
    a = common.mix(np.arange(1, 9, dtype=np.uint64))
    assert common.window_hashes(a, 4)[1] == common.window_hashes(a[1:5], 4)[0]
    assert common.window_hashes(a[[0, 1, 3, 2]], 4)[0] != common.window_hashes(a[:4], 4)[0]
    assert len(common.window_hashes(a[:3], 4)) == 0
