import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsift import schemas
from callsift.plans import loads
from callsift.session import settle, shared_dir
from callsift.sources import files, sinks

RUN = datetime(2026, 1, 2, 3, 4, 5)


def write(folder, name, value):
    (folder / name).write_text(json.dumps(value), encoding="utf-8")


def test_call_details(spark, tmp_path, rows):
    full = {
        "contactId": 1, "agentId": 7, "campaignName": "C", "skillName": "S", "teamName": "T",
        "firstName": "Ann", "lastName": "Lee", "fromAddr": 5551, "toAddr": "5552",
        "contactStart": "2025-04-17T05:19:16.277Z", "totalDurationSeconds": 761.107,
        "agentSeconds": 742, "inQueueSeconds": 18.1, "holdSeconds": 0.0, "ACWSeconds": 30,
        "holdCount": 2, "abandoned": True, "isOutbound": False, "serviceLevelFlag": 1,
        "state": "EndContact", "mediaTypeName": "Call", "unused": {"x": 1},
    }
    write(tmp_path, "a.json", full)
    write(tmp_path, "b.json", {"contactId": 2})
    write(tmp_path, "c.json", {"agentId": 9})
    write(tmp_path, "d.json", {"contactId": 0})
    write(tmp_path, "e.json", [{"contactId": 3, "contactStart": "2025-04-17T05:19:16+02:00"},
                               {"contactId": 4, "contactStart": "yesterday", "state": None}])
    calls, rejects = files.read_calls(spark, str(tmp_path), RUN)
    assert rows(rejects, "contact_id", "reason") == [("0", "no contact id"), (None, "no contact id")]
    assert calls.schema.names == schemas.CALLS.names
    assert [f.dataType for f in calls.schema] == [f.dataType for f in schemas.CALLS]
    got = {r["contact_id"]: r for r in calls.collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1]["contact_start"] == datetime(2025, 4, 17, 5, 19, 16, 277000)
    assert (got[1]["from_addr"], got[1]["service_level_flag"]) == ("5551", "1")
    assert (got[1]["hold_count"], got[1]["is_abandoned"]) == (2, True)
    two = got[2]
    assert (two["campaign_name"], two["first_name"], two["service_level_flag"]) == ("Unknown", "", "0")
    assert (two["media_type_name"], two["total_duration_sec"], two["hold_count"]) == ("Call", 0.0, 0)
    assert two["contact_start"] == RUN and two["created_at"] == RUN
    assert got[3]["contact_start"] == datetime(2025, 4, 17, 5, 19, 16)
    assert got[4]["contact_start"] == RUN and got[4]["state"] == "Unknown"


def test_transcripts(spark, tmp_path, rows):
    write(tmp_path, "a.json", {"1": {"agent_conversation": "hé\nllo", "customer_conversation": "hi"}})
    write(tmp_path, "b.json", {"2": {"agent_conversation": None}, "x": {"agent_conversation": "?"}})
    (tmp_path / "c.json").write_text('{"3": {"agent_conversation": "cut', encoding="utf-8")
    read, rejects = files.read_transcripts(spark, str(tmp_path))
    assert rows(read) == [(1, "hé\nllo", "hi"), (2, None, None)]
    assert rows(rejects, "contact_id", "reason") == [
        ("x", "contact id is no number"), (None, "no map of calls")]


def test_odd_values_are_read_or_rejected(spark, tmp_path, rows):
    write(tmp_path, "a.json", {"contactId": "624279072949", "agentId": "77", "abandoned": "true",
                               "totalDurationSeconds": "12.5", "holdCount": 2.0, "isOutbound": 0})
    (tmp_path / "b.json").write_text('{"contactId":7, "agentId":', encoding="utf-8")
    write(tmp_path, "c.json", {"contactId": 8, "holdSeconds": "long"})
    write(tmp_path, "d.json", {"contactId": "x9"})
    write(tmp_path, "e.json", {"contactId": 9.0, "abandoned": False, "isOutbound": 1})
    calls, rejects = files.read_calls(spark, str(tmp_path), RUN)
    assert rows(calls, "contact_id", "agent_id", "total_duration_sec", "hold_count", "is_abandoned",
                "is_outbound") == [(624279072949, 77, 12.5, 2, True, False), (9, None, 0.0, 0, False, True)]
    assert rows(rejects, "contact_id", "reason") == [
        ("8", "holdSeconds is no number"), ("x9", "contactId is no number"), (None, "no JSON")]
    assert '"contactId":7' in rejects.filter("reason = 'no JSON'").first()["content"]


def test_loads_keep_the_first_file_and_known_rows(spark, tmp_path, rows):
    details, talk = tmp_path / "details", tmp_path / "talk"
    details.mkdir()
    talk.mkdir()
    calls, transcripts = str(tmp_path / "calls"), str(tmp_path / "transcripts")
    write(details, "b.json", {"contactId": 1, "firstName": "late", "contactStart": "2024-01-01T00:00:00Z"})
    write(details, "a.json", {"contactId": 1, "firstName": "first", "contactStart": "2025-01-01T00:00:00Z"})
    write(talk, "1.json", {"1": {"agent_conversation": "hello there", "customer_conversation": "hi"}})
    for name in ("again", "second"):
        loads.load_calls(spark, str(details), calls, RUN)
        loads.load_transcripts(spark, str(talk), transcripts, RUN)
        write(details, "0.json", {"contactId": 1, "firstName": name})
        write(details, f"{name}.json", {"contactId": len(name), "firstName": name})
    assert rows(files.read_table(spark, calls, schemas.CALLS), "contact_id", "first_name") == [
        (1, "first"), (5, "again")]
    row = files.read_table(spark, transcripts, schemas.TRANSCRIPTS).collect()
    assert [(r["full_text"], r["agent_word_count"], r["talk_ratio"]) for r in row] == [
        ("hello there hi", 2, 0.667)]


def test_rubric(spark, tmp_path):
    def rule(weight, enabled=True):
        return {"weight": weight, "enabled": enabled, "when": "w", "what": "x", "good_example": "g",
                "bad_example": "b", "check_keywords": ["k"], "scoring": "binary"}

    config = {"project": "p", "quality_framework": {
        "S1": {"weight": 0.6, "enabled": True, "criteria": {"A": rule(0.33), "B": rule(0.67, False)}},
        "S2": {"weight": 0.4, "enabled": False, "criteria": {"C": rule(1.0)}},
    }}
    write(tmp_path, "config.json", config)
    rubric = files.read_rubric(spark, str(tmp_path / "config.json"))
    got = {r["criteria_name"]: r for r in rubric.collect()}
    assert {k: r["effective_weight"] for k, r in got.items()} == {"A": 0.198, "B": 0.402, "C": 0.4}
    assert [got[k]["enabled"] for k in "ABC"] == [True, False, False]
    assert got["A"]["check_keywords"] == ["k"] and got["A"]["what_to_check"] == "x"


def test_csv_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, 'say "hi",\nthere'), (2, None)], "a long, b string")
    path = str(tmp_path / "out")
    sinks.export_csv(df, path)
    assert rows(files.read_csv(spark, path, df.schema)) == rows(df)


def test_table_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "x"), (2, "yy")], "a int, b string")
    path = str(tmp_path / "table")
    sinks.overwrite(df, path, version=3)
    sinks.overwrite(df.filter("a = 2"), path, version=4)
    assert rows(files.read_table(spark, path)) == [(2, "yy", 4)]


def test_insert_ignore(spark, rows):
    old = spark.createDataFrame([(1, "old", 0)], "k long, v string, at int")
    new = spark.createDataFrame(
        [(1, "new", 1), (2, "late", 9), (2, "early", 2), (None, "no key", 1)], old.schema)
    assert rows(sinks.insert_ignore(old, new, "k", "at")) == [(1, "old", 0), (2, "early", 2)]
    assert rows(sinks.unseen(old, new, "k", "at", small_batch=True)) == [(2, "early", 2)]
    again = sinks.insert_ignore(old, new, "k", "at")
    assert rows(sinks.insert_ignore(again, new, "k", "at")) == rows(again)


def test_upsert(spark, rows):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, at int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], old.schema)
    assert rows(sinks.upsert(old, new, "k", "at")) == [(1, "a", 0), (2, "d", 2), (3, "e", 1)]


def test_upsert_rewrites_only_touched_folders(spark, tmp_path, rows):
    path, schema = str(tmp_path / "table"), T.StructType.fromDDL("k long, v string")

    def put(*data):
        batch = spark.createDataFrame(data, schema)
        sinks.upsert_table(batch, path, schema, "k", "v", buckets=8)
        return {os.path.join(folder, name) for folder, _, names in os.walk(path)
                for name in names if name.endswith("parquet") and sinks.BUCKET in folder}

    first = [(i, "a") for i in range(40)]
    before = put(*first)
    assert len({os.path.dirname(f) for f in before}) == 8
    after = put((3, "b"), (3, "c"))
    assert before < after and len({os.path.dirname(f) for f in after - before}) == 1
    stored = rows(sinks.read_upserted(spark, path, schema))
    assert stored == sorted([r for r in first if r[0] != 3] + [(3, "c")], key=repr)
    put((3, "b"), (3, "c"))
    assert rows(sinks.read_upserted(spark, path, schema)) == stored


def test_upsert_that_fails_leaves_the_table(spark, tmp_path, rows, monkeypatch):
    path, schema = str(tmp_path / "kept"), T.StructType(
        [T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])

    def put(*data):
        sinks.upsert_table(spark.createDataFrame(data, schema), path, schema, "k", "v", buckets=4)

    assert rows(sinks.read_upserted(spark, path, schema)) == []
    put((1, "a"), (2, "a"))
    with monkeypatch.context() as broken:
        broken.setattr(sinks, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            put((1, "b"), (3, "b"))
    assert rows(sinks.read_upserted(spark, path, schema)) == [(1, "a"), (2, "a")]
    put((1, "b"), (3, "b"))
    assert rows(sinks.read_upserted(spark, path, schema)) == [(1, "b"), (2, "a"), (3, "b")]


def test_publish_keeps_the_last_whole_version(spark, tmp_path, rows):
    path = str(tmp_path / "published")
    df = spark.createDataFrame([(1,)], "a int")
    assert rows(sinks.read_published(spark, path, df.schema)) == []
    assert sinks.publish(df, path) == 1
    merged = sinks.read_published(spark, path, df.schema).union(spark.createDataFrame([(2,)], "a int"))
    assert sinks.publish(merged, path) == 2
    half = tmp_path / "published" / "version=3"
    half.mkdir()
    assert rows(sinks.read_published(spark, path, df.schema)) == [(1,), (2,)]
    assert sinks.publish(df, path) == 3


def test_rubric_changes(spark):
    day = datetime(2025, 1, 1)
    rubric = spark.createDataFrame(
        [("a", "S", 0.1, True, day), ("b", "S", 0.2, True, day), ("c", "S", 0.3, True, day)],
        "framework_id string, section_name string, effective_weight double, enabled boolean, "
        "updated_at timestamp_ntz")

    def at(n):
        return datetime(2025, 2, n)

    changes = spark.createDataFrame(
        [("a", 1, "update", at(1), 0.5, None), ("a", 2, "update", at(2), None, False),
         ("b", 3, "update", at(3), 0.9, None), ("b", 4, "delete", at(4), None, None),
         ("b", 5, "update", at(5), 0.8, None),
         ("d", 6, "update", at(6), 0.7, None),
         ("e", 7, "update", at(7), 0.7, None), ("e", 8, "insert", at(8), None, True),
         ("e", 9, "update", at(9), 0.6, None),
         ("c", 10, "delete", at(10), None, None), ("c", 11, "insert", at(11), 0.4, None)],
        "framework_id string, seq int, op string, changed_at timestamp_ntz, "
        "effective_weight double, enabled boolean")
    got = {r[0]: tuple(r)[1:] for r in sinks.apply_changes(rubric, changes).collect()}
    assert got == {
        "a": ("S", 0.5, False, at(2)),
        "c": (None, 0.4, False, at(11)),
        "e": (None, 0.6, True, at(9)),
    }


def test_settle_uses_the_named_folder(spark, rows):
    df = spark.range(3)
    kept = settle(df)
    assert rows(kept) == [(0,), (1,), (2,)]
    assert shared_dir(spark) in kept.inputFiles()[0]


def test_first_of_equal_rows_is_one_row(spark, rows):
    from callsift.plans.dedupe import first_match

    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.lit(1).alias("v"))
    assert rows(first_match(df, "k", "v")) == [(0, 1), (1, 1), (2, 1)]


def test_file_audit_reads_each_listing_once(spark, tmp_path):
    from callsift.operators import quality as ql

    for name, files_of in (("details", {"1.json": "abc", "2.json": "d"}), ("talk", {"2.json": "x", "3.json": "yy"})):
        (tmp_path / name).mkdir()
        for file, text in files_of.items():
            (tmp_path / name / file).write_text(text)
    told = ql.file_audit(*[files.listed_files(spark, str(tmp_path / name)) for name in ("details", "talk")])
    assert {tuple(r) for r in told.collect()} == {
        ("call detail files", 2, 4), ("transcript files", 2, 3), ("matched pairs", 1, 1)}
    assert told._jdf.queryExecution().sparkPlan().toString().count("FileScan binaryFile") == 2
    nothing = [files.listed_files(spark, str(tmp_path / name), "none*") for name in ("details", "talk")]
    assert [tuple(r)[1:] for r in ql.file_audit(*nothing).collect()] == [(0, 0)] * 3
