"""Stored summaries of days: merged, they count like a pass over all rows."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from callsift.plans import days
from callsift.sources import keyed

SCHEMA = "contact_id long, at timestamp_ntz"


def rows_of(spark, numbers, n=800, seed=1):
    pick = random.Random(seed)
    data = [(pick.randrange(-5, 100_000), datetime(2025, 1, pick.choice(numbers), pick.randrange(24)))
            for _ in range(n)]
    return spark.createDataFrame([*data, *data[:50], (None, datetime(2025, 1, 1)), (7, None)], SCHEMA)


def direct(frame, first, last):
    inside = frame.filter(F.dayofmonth("at").between(first, last))
    return inside.agg(F.count_distinct("contact_id")).first()[0]


def merged(spark, path, first, last, exact=True):
    inside = days.read_days(spark, path).filter(F.dayofmonth("day").between(first, last))
    return days.distinct_calls(inside, exact=exact).first()["total_calls"]


def test_merged_days_count_like_all_rows(spark, tmp_path):
    path, frame = str(tmp_path / "days"), rows_of(spark, [1, 2, 3, 4])
    assert days.add_days(frame, path, "at", "run", 0)
    for first, last in ((1, 1), (2, 3), (1, 4)):
        assert merged(spark, path, first, last) == direct(frame, first, last)
    late = rows_of(spark, [4, 5], seed=2)  # a day again, and a new one
    assert days.add_days(late, path, "at", "run", 1)
    both = frame.unionByName(late)
    for first, last in ((4, 4), (5, 5), (1, 5)):
        assert merged(spark, path, first, last) == direct(both, first, last)
    assert not days.add_days(late, path, "at", "run", 1)


def test_a_new_day_touches_one_folder(spark, tmp_path):
    path, frame = str(tmp_path / "days"), rows_of(spark, [1, 2, 3])
    both = frame.unionByName(frame.withColumn("at", F.col("at") - F.make_dt_interval(F.lit(40))))
    days.add_days(both, path, "at", "run", 0)
    days.add_days(rows_of(spark, [9]), path, "at", "run", 1)
    held = {r["part"]: r["held_in"] for r in keyed._manifest(spark, path, keyed.PARTS)}
    assert held == {"2024-11": 1, "2025-01": 2}


def test_sketches_are_near(spark, tmp_path):
    path, frame = str(tmp_path / "sketches"), rows_of(spark, [1, 2, 3, 4], n=6000)
    days.add_days(frame.filter("contact_id % 2 = 0"), path, "at", "run", 0, exact=False)
    days.add_days(frame.filter("contact_id % 2 <> 0"), path, "at", "run", 1, exact=False)
    for first, last in ((1, 1), (2, 3), (1, 4)):
        want = direct(frame, first, last)
        assert abs(merged(spark, path, first, last, exact=False) - want) < 0.05 * want


def test_nothing(spark, tmp_path):
    path = str(tmp_path / "days")
    assert not days.add_days(rows_of(spark, [1]).limit(0), path, "at", "run", 0)
    assert days.distinct_calls(days.read_days(spark, path), "day").count() == 0


def size(value):
    return 0 if value is None else len(value) if isinstance(value, (bytes, bytearray)) else 8


def test_calls_far_apart_take_little(spark, tmp_path):
    path, at = str(tmp_path / "days"), datetime(2025, 1, 1)
    frame = spark.createDataFrame([(number * 40_000, at) for number in range(300)], SCHEMA)
    days.add_days(frame.filter("contact_id % 80000 = 0"), path, "at", "run", 0)
    days.add_days(frame.filter("contact_id % 80000 <> 0"), path, "at", "run", 1)
    stored = days.read_days(spark, path)
    assert sum(size(value) for row in stored.collect() for value in row) <= 300 * 3 * 8
    assert days.distinct_calls(stored).first()["total_calls"] == 300


def test_calls_side_by_side_share_a_row(spark, tmp_path):
    path, at = str(tmp_path / "days"), datetime(2025, 1, 1)
    frame = spark.createDataFrame([(number, at) for number in range(64 * 300)], SCHEMA)
    days.add_days(frame.filter("contact_id % 2 = 0"), path, "at", "run", 0)
    days.add_days(frame.filter("contact_id % 3 <> 0"), path, "at", "run", 1)
    stored = days.read_days(spark, path)
    assert stored.count() == 300
    want = frame.filter("contact_id % 2 = 0 OR contact_id % 3 <> 0").count()
    assert days.distinct_calls(stored, "day").collect() == [(date(2025, 1, 1), want)]


def test_any_id_counts_once(spark, tmp_path):
    ids = [0, 1, 31, 32, 62, 63, 64, -1, -63, -64, -65, 2**31, -(2**31), 2**63 - 1, -(2**63)]
    path, at = str(tmp_path / "days"), datetime(2025, 1, 1)
    frame = spark.createDataFrame([(number, at) for number in ids * 2], SCHEMA)
    for number in range(2):
        days.add_days(frame, path, "at", "run", number)
        assert days.distinct_calls(days.read_days(spark, path)).first()["total_calls"] == len(ids)


def test_bitmaps_are_joined_without_a_sort(spark, tmp_path, capsys):
    path = str(tmp_path / "days")
    days.add_days(rows_of(spark, [1, 2]), path, "at", "run", 0)
    days.distinct_calls(days.read_days(spark, path), "day").explain()
    plan = capsys.readouterr().out
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_days_of_the_other_kind_are_an_error(spark, tmp_path):
    path = str(tmp_path / "sketches")
    days.add_days(rows_of(spark, [1, 2]), path, "at", "run", 0, exact=False)
    stored = days.read_days(spark, path)
    with pytest.raises(Exception, match="hold no bits"):
        days.distinct_calls(stored).collect()
    with pytest.raises(Exception, match="hold no bits"):
        days.add_days(rows_of(spark, [1, 2]), path, "at", "run", 1)
    assert days.distinct_calls(stored, exact=False).first()["total_calls"] > 0
