import json
import math
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from callsift.functions import jsontext as js
from callsift.functions import labels, numbers
from callsift.functions import text as tx
from callsift.functions.moments import wall_clock


def test_share_rounds_like_python(spark):
    pairs = [(a, b) for a in range(0, 161) for b in range(0, 161)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select("a", "b", numbers.talk_share(F.col("a"), F.col("b")).alias("r")).collect()
    for a, b, r in got:
        assert r == (round(a / (a + b), 3) if a + b else None), (a, b)


def test_python_round_on_ties_and_neighbours(spark):
    values = [m / 2000 for m in range(1, 4000)] + [0.0, 2.675, 1.005, 1.035, 99.995, 1e6 + 0.005]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 2, 3):
        got = df.select("v", numbers.python_round(F.col("v"), digits).alias("r")).collect()
        assert [r for _, r in got] == [round(v, digits) for v, _ in got]


def test_weight_percent(spark):
    df = spark.createDataFrame([(0.0875,), (1.0,), (1.5,), (0.0,), (None,)], "w double")
    got = [r[0] for r in df.select(numbers.weight_percent(F.col("w"))).collect()]
    assert got == [8.75, 100.0, 1.5, 0.0, 0.0]


def sums_of(spark, groups):
    rows = [(i, float(x)) for i, values in enumerate(groups) for x in values]
    df = spark.createDataFrame(rows, "g int, v double").repartition(4)
    got = df.groupBy("g").agg(numbers.exact_sum(F.col("v")).alias("s")).collect()
    return {r["g"]: r["s"] for r in got}


def test_exact_sum_is_fsum(spark):
    pick = random.Random(3)
    groups = [
        [pick.uniform(-1, 1) * 10 ** pick.randint(-3, 22) for _ in range(pick.randint(1, 40))]
        for _ in range(400)
    ]
    groups += [[0.1] * n for n in (1, 3, 10, 999)]
    groups += [[1e20, 1.0, -1e20], [2.0**53, 1.0, 1.0], [2.0**60, 0.5, -(2.0**60)], [-57.2, -0.3], [-0.0],
               [1e16, 1.0, 1e-3], [2.0**36, 2.0**-44, -1.0], [-(2.0**40), 2.0**-40], [5e11 + 0.125] * 7]
    got = sums_of(spark, groups)
    assert got == {i: math.fsum(values) for i, values in enumerate(groups)}


def test_exact_sum_of_tiny_huge_and_odd_values(spark):
    got = sums_of(spark, [[2e-10, 4e-10], [1e-300, 1e-300], [1e300, 1e300], [float("inf"), 1.0],
                          [float("inf"), float("-inf")], [float("nan"), 1.0], [-1e19, 5.0]])
    assert got[0] == pytest.approx(6e-10, rel=1e-15) and got[1] == 2e-300 and got[2] == 2e300
    assert got[3] == math.inf and math.isnan(got[4]) and math.isnan(got[5]) and got[6] == -1e19 + 5.0
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert math.isnan(df.agg(numbers.exact_avg(F.col("v"), 1)).first()[0])
    big = spark.createDataFrame([(1e19,), (3e19,), (float("inf"),)], "v double")
    assert big.filter("v < 1e20").agg(numbers.exact_avg(F.col("v"), 1)).first()[0] == 2e19
    assert big.agg(numbers.exact_avg(F.col("v"), 1)).first()[0] == math.inf


def test_decimal_ties_round_up(spark):
    df = spark.createDataFrame([(57.2,), (57.3,)], "v double")
    row = df.agg(numbers.exact_avg(F.col("v"), 1), numbers.scaled_sum(F.col("v"), 100)).first()
    assert tuple(row) == (57.3, 11450.0)


def test_exact_sum_stays_in_generated_code(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plan = df.groupBy("g").agg(numbers.exact_sum(F.col("v")))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHash" not in plan and "SortAggregate" not in plan


def test_ratio_of_nothing_is_null(spark):
    df = spark.createDataFrame([], "v double")
    assert df.agg(numbers.exact_avg(F.col("v"), 1)).first()[0] is None


SAMPLES = [
    "Hello, World! It's 5 o'clock_somewhere.", "  tabs\tand\nlines   nbsp em ", "",
    "éÀ çouelle ñandú — straße", "数据 分析, 完成!", "a\x1cb\x85c", "½ Ⅷ x² ٣", None,
]


def test_normalized_like_python(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES if s is not None], "s string")
    for s, got in df.select("s", tx.normalized(F.col("s"))).collect():
        assert got == re.sub(r"[^\w\s]", "", s.lower()), s


def test_word_count_like_python(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    for s, got in df.select("s", tx.word_count(F.col("s"))).collect():
        assert got == len((s or "").split()), s


def test_dialogue_and_head(spark):
    df = spark.createDataFrame([("hi", None)], "a string, c string")
    assert df.select(tx.dialogue(F.col("a"), F.col("c"))).first()[0] == "AGENT: hi\n\nCUSTOMER: "
    assert df.select(tx.head(F.col("a"), 1)).first()[0] == "h"


def test_codes(spark):
    df = spark.createDataFrame([("Positive",), ("Negative",), ("odd",), (None,)], "s string")
    got = [r[0] for r in df.select(labels.sentiment_code(F.col("s"))).collect()]
    assert got == [2, 0, 1, 1]
    issues = spark.createDataFrame([("Billing",), ("Hardware",), (None,)], "s string")
    assert [r[0] for r in issues.select(labels.issue_code(F.col("s"))).collect()] == [2, 0, 0]
    flags = spark.createDataFrame([("1",), ("0",), (None,)], "s string")
    assert [r[0] for r in flags.select(labels.sla_code(F.col("s"))).collect()] == [1, 0, 0]


def test_strict_json_like_python(spark):
    texts = ['{"a": 1}', "[1, 2]", "1", '"x"', "null", "", "{", '{"a": 1} }', "1, 2", "1] junk",
             '{"a": 1}} more', "[1] [2]", "tru", " true ", "{'a': 1}", "[1,]"]
    random.seed(4)
    texts += ["".join(random.choices('{}[]",:1a ', k=random.randint(1, 7))) for _ in range(600)]

    def readable(s):
        try:
            json.loads(s)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame([(s,) for s in texts], "s string")
    for s, got in df.select("s", js.parsed(F.col("s")).isNotNull()).collect():
        assert got == readable(s), s


def test_truthiness(spark):
    cases = {"true": True, "false": False, '"no"': True, '""': False, "0": False, "2": True,
             "0.0": False, "null": False, "[]": False, "[0]": True, "{}": False, '{"a":0}': True}
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    for s, got in df.select("s", js.truthy(F.try_parse_json("s"))).collect():
        assert got == cases[s], s


def test_recovered(spark):
    cases = {
        '{"a":1}': '{"a":1}', '```{"a":1}```': '{"a":1}', 'x {"a":1} y': '{"a":1}',
        "\n```\n{'a':1}```\t\n": '{"a":1}', "x {'a':1} y": '{"a":1}', "x {a} {'b':2}": '{"b":2}', "nothing": "{}", "": "{}",
    }
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    for s, got in df.select("s", js.recovered(F.col("s"))).collect():
        assert got == cases[s], s


def test_wall_clock_like_python(spark):
    texts = ["2025-04-17T05:19:16.277Z", "2025-04-17T05:19:16+02:00", "2025-04-17 05:19", "2025-04-17",
             " 2025-04-17", "2025-04-17T05:19:16 ", "2025", "12:30", "2025-13-01", "2025-02-30T10:00:00",
             "2025-04-17T25:00:00", "n/a", "", "2025-04-17T05"]

    def read(s):
        try:
            return datetime.fromisoformat(s.replace("Z", "+00:00")).replace(tzinfo=None)
        except ValueError:
            return None

    df = spark.createDataFrame([(s,) for s in texts], "s string")
    for s, got in df.select("s", wall_clock(F.col("s"))).collect():
        assert got == read(s), s
