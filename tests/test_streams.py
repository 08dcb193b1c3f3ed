"""Streams run until their input is used up, some of them twice."""

import json
from datetime import datetime

import numpy as np

from callsift import schemas
from callsift.sources import keyed
from callsift.streaming import live

RUN = datetime(2026, 1, 1)


def put(folder, name, *ids):
    folder.mkdir(exist_ok=True)
    for i in ids:
        doc = {"contactId": i, "firstName": name, "contactStart": f"2025-01-0{i}T10:00:00Z"}
        (folder / f"{name}{i}.json").write_text(json.dumps(doc), encoding="utf-8")


def test_ingest_ignores_known_calls(spark, tmp_path, rows):
    incoming, out, state = tmp_path / "in", str(tmp_path / "calls"), str(tmp_path / "state")
    put(incoming, "a", 1, 2)
    live.start_ingest(spark, str(incoming), out, state, RUN).awaitTermination()
    put(incoming, "b", 2, 3)
    live.start_ingest(spark, str(incoming), out, state, RUN).awaitTermination()
    stored = keyed.read(spark, out, schemas.CALLS)
    assert rows(stored, "contact_id", "first_name") == [(1, "a"), (2, "a"), (3, "b")]


def test_a_repeated_batch_adds_nothing(spark, tmp_path, rows):
    incoming, out = tmp_path / "in", str(tmp_path / "calls")
    put(incoming, "a", 1, 2)
    for run in range(2):
        state = str(tmp_path / f"state{run}")
        live.start_ingest(spark, str(incoming), out, state, RUN).awaitTermination()
    assert rows(keyed.read(spark, out, schemas.CALLS), "contact_id") == [(1,), (2,)]


def test_batches_are_stamped_when_they_run_and_rejects_kept(spark, tmp_path, rows):
    incoming, out, bad = tmp_path / "in", str(tmp_path / "calls"), str(tmp_path / "bad")
    put(incoming, "a", 1)
    (incoming / "x.json").write_text('{"contactId": 2, ', encoding="utf-8")
    state = str(tmp_path / "state")
    live.start_ingest(spark, str(incoming), out, state, rejects_out=bad).awaitTermination()
    put(incoming, "b", 3)
    live.start_ingest(spark, str(incoming), out, state, rejects_out=bad).awaitTermination()
    stamps = rows(keyed.read(spark, out, schemas.CALLS), "contact_id", "created_at")
    assert [k for k, _ in stamps] == [1, 3] and stamps[0][1] < stamps[1][1]
    assert rows(spark.read.parquet(bad), "reason") == [("no JSON",)]


def test_transcripts_and_their_log(spark, tmp_path, rows):
    incoming, out, log = tmp_path / "in", str(tmp_path / "talk"), str(tmp_path / "log")
    incoming.mkdir()

    def say(name, key, agent, customer):
        doc = {key: {"agent_conversation": agent, "customer_conversation": customer}}
        (incoming / name).write_text(json.dumps(doc), encoding="utf-8")

    say("a.json", "1", "hi", "a b c d e f g")
    for run in range(2):
        live.start_transcripts(spark, str(incoming), out, str(tmp_path / "s1"), RUN).awaitTermination()
        say("b.json", "2", "hello you", "hi")
        say("c.json", "1", "late", "late")
    assert rows(keyed.read(spark, out, schemas.TRANSCRIPTS), "contact_id", "agent_text") == [
        (1, "hi"), (2, "hello you")]
    talk = str(tmp_path / "talk-rows")
    keyed.read(spark, out, schemas.TRANSCRIPTS).write.parquet(talk)
    stream = spark.readStream.schema(schemas.TRANSCRIPTS).parquet(talk)
    live.start_log(live.talk_log_stream(stream), log, str(tmp_path / "s2")).awaitTermination()
    assert rows(spark.read.parquet(log), "contact_id", "field_name") == [(1, "talk_ratio")]


METRICS = "contact_start timestamp_ntz, issue_category string, overall_score double"


def feed(spark, path, *rows_of):
    spark.createDataFrame(list(rows_of), METRICS).coalesce(1).write.mode("append").parquet(path)


def test_daily_table_stays_whole(spark, tmp_path, rows):
    source, out, state = (str(tmp_path / n) for n in ("in", "daily", "state"))
    day = datetime(2025, 1, 1, 8)
    feed(spark, source, (day, "A", 10.0), (day, "A", 20.05), (day.replace(day=2), None, None))

    def run():
        stream = spark.readStream.schema(METRICS).parquet(source)
        live.start_daily_metrics(stream, out, state).awaitTermination()
        return [(d.day, *r) for d, *r in rows(live.read_daily(spark, out))]

    assert run() == [(1, "A", 2, 15.0), (2, None, 1, None)]
    feed(spark, source, (day, "A", 30.0))
    assert run() == [(1, "A", 3, 20.0), (2, None, 1, None)]


def test_old_days_leave_the_state_and_late_rows_are_dropped(spark, tmp_path, rows):
    source, out, state = (str(tmp_path / n) for n in ("in", "daily", "state"))
    day = datetime(2025, 1, 1, 8)

    def run():
        stream = spark.readStream.schema(METRICS).parquet(source)
        query = live.start_daily_metrics(stream, out, state, delay="2 days")
        query.awaitTermination()
        told = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return [(d.day, *r) for d, *r in rows(live.read_daily(spark, out))], told[-1]

    feed(spark, source, (day, "A", 10.0), (day, "B", 1.0), (day.replace(day=2), "A", 5.0))
    assert run() == ([(1, "A", 1, 10.0), (1, "B", 1, 1.0), (2, "A", 1, 5.0)], 3)
    feed(spark, source, (day.replace(day=20), "A", 7.0), (day, "A", 30.0))  # still in time
    table, held = run()
    assert table == [(1, "A", 2, 20.0), (1, "B", 1, 1.0), (2, "A", 1, 5.0), (20, "A", 1, 7.0)]
    assert held == 1  # the first two days are closed
    feed(spark, source, (day, "A", 99.0), (day.replace(day=19), "C", 3.0))  # one too late, one not
    assert run()[0] == sorted([*table, (19, "C", 1, 3.0)], key=repr)


def test_a_batch_touches_its_days_only_and_once(spark, tmp_path, rows):
    out = str(tmp_path / "daily")

    def batch(*values):
        rows_of = [(f"part {d}", datetime(2025, 1, d).date(), c, n, s) for d, c, n, s in values]
        return spark.createDataFrame(rows_of, live.DAILY)

    def versions():
        return {r["part"]: r["held_in"] for r in keyed._manifest(spark, out, keyed.PARTS)}

    keys = ["day", "issue_category"]
    assert keyed.merge_parts(batch((1, "A", 1, 1.0), (1, None, 2, None), (2, "A", 3, 3.0)), out, "year",
                             keys, "run", 0)
    more = batch((2, "A", 4, 4.0), (3, None, 1, None))
    assert keyed.merge_parts(more, out, "year", keys, "run", 1)
    want = [(1, "A", 1, 1.0), (1, None, 2, None), (2, "A", 4, 4.0), (3, None, 1, None)]
    for _ in range(2):
        assert sorted([(d.day, *r) for d, *r in rows(live.read_daily(spark, out))], key=repr) == sorted(want, key=repr)
        assert versions() == {"part 1": 1, "part 2": 2, "part 3": 2}
        assert not keyed.merge_parts(more, out, "year", keys, "run", 1)


def test_files_read_per_trigger_do_not_grow(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(keyed, "MOST_FILES", 3)
    out, schema = str(tmp_path / "keyed"), keyed.flat("k BIGINT, v STRING")
    read, opened = keyed._read, []
    monkeypatch.setattr(keyed, "_read", lambda s, p, pairs, *a: opened.append((p, len(pairs))) or read(s, p, pairs, *a))
    keyed.ensure(spark, out)
    per_batch = []
    for number in range(12):
        opened.clear()
        fresh = [(number * 100 + i, f"b{number}") for i in range(100)]
        again = [(number * 50 + i, "late") for i in range(3)] if number else []
        frame = spark.createDataFrame(fresh + again, schema)
        assert keyed.insert_ignore(frame, out, schema, "k", "v", folders=4) == 100
        per_batch.append(sum(n for p, n in opened if p.endswith("/data")))
    stored = rows(keyed.read(spark, out, schema))
    assert stored == sorted([(i, f"b{i // 100}") for i in range(1200)], key=repr)
    # At most the folders' files, once for keys that may be known and once where folders are merged or
    # filters made anew.
    assert max(per_batch) <= 3 * 4 * 3
    opened.clear()
    assert keyed.insert_ignore(spark.createDataFrame([(10**9, "x")], schema), out, schema, "k", "v", folders=4) == 1
    assert sum(n for p, n in opened if p.endswith("/data")) <= 3  # one folder at most, for a new key mostly none


def test_bloom_filters_never_miss():
    pick = np.random.Generator(np.random.PCG64(1))
    h, g = (pick.integers(-(2**63), 2**63, 4000, dtype=np.int64) for _ in range(2))
    bits = keyed.filled(h[:1000], g[:1000], 1000)
    bits = keyed.filled(h[1000:2000], g[1000:2000], 2000, bits)
    assert keyed.may_hold(bits, h[:2000], g[:2000]).all()
    assert keyed.may_hold(bits, h[2000:], g[2000:]).mean() < 0.02
    assert not keyed.is_full(bits, 2000) and keyed.is_full(bits, 10**6) and keyed.is_full(None, 0)


def test_watermark_closes_days(spark, tmp_path, rows):
    source, out, state = (str(tmp_path / n) for n in ("in", "closed", "state"))
    day = datetime(2025, 1, 1, 8)

    def run():
        stream = spark.readStream.schema(METRICS).parquet(source)
        query = live.daily_metrics_stream(stream, "1 day").writeStream.format("parquet").option(
            "path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()

    feed(spark, source, (day, "A", 10.0))
    run()
    feed(spark, source, (day.replace(day=5), "A", 20.0))
    run()
    feed(spark, source, (day, "A", 99.0))
    run()
    closed = rows(spark.read.parquet(out))
    assert [(r[0].day, r[2], r[3]) for r in closed] == [(1, 1, 10.0)]


def test_quality_log_stream(spark, tmp_path, rows):
    source, out, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    schema = "contact_id long, disposition_notes string, hold_seconds double"
    data = [(1, "x", 2000.0), (2, None, 0.0), (3, "x", None)]
    spark.createDataFrame(data, schema).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(source)
        live.start_quality_log(stream, out, state).awaitTermination()
    assert rows(spark.read.parquet(out), "contact_id", "severity") == [(1, "high"), (2, "low")]
