"""The merge sinks against a row-by-row model, on random batches."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from callsift.sources import sinks

few = settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
ROW = "k long, at int, v string"
stored_rows = st.dictionaries(st.integers(0, 8), st.tuples(st.integers(0, 9), st.sampled_from("abc")))
batch_rows = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 9), st.sampled_from("xyz")), max_size=20)


def table(stored):
    return [(k, at, v) for k, (at, v) in stored.items()]


@few
@given(stored_rows, batch_rows)
def test_insert_ignore_and_upsert(spark, stored, batch):
    old = spark.createDataFrame(table(stored), ROW)
    new = spark.createDataFrame(batch, ROW)
    ignored, replaced = dict(stored), dict(stored)
    for k, at, v in sorted(batch, key=lambda r: r[1:]):
        ignored.setdefault(k, (at, v))
        replaced[k] = (at, v)
    assert sorted(map(tuple, sinks.insert_ignore(old, new, "k", "at").collect())) == sorted(table(ignored))
    assert sorted(map(tuple, sinks.upsert(old, new, "k", "at").collect())) == sorted(table(replaced))


START = datetime(2025, 1, 1)
RULE = ("framework_id string, criteria_name string, effective_weight double, enabled boolean, "
        "updated_at timestamp_ntz")
CHANGE = ("framework_id string, seq int, op string, changed_at timestamp_ntz, criteria_name string, "
          "effective_weight double, enabled boolean")
change_rows = st.lists(st.tuples(
    st.sampled_from("abcd"), st.sampled_from(["insert", "update", "update", "delete"]),
    st.one_of(st.none(), st.sampled_from(["n1", "n2"])),
    st.one_of(st.none(), st.sampled_from([0.1, 0.2])), st.one_of(st.none(), st.booleans())), max_size=14)


@few
@given(st.sets(st.sampled_from("abc")), change_rows)
def test_rubric_changes(spark, present, changes):
    rules = {k: ["n0", 0.5, True, START] for k in present}
    rubric = spark.createDataFrame([(k, *v) for k, v in rules.items()], RULE)
    log = []
    for seq, (key, op, *fields) in enumerate(changes):
        at = START + timedelta(days=seq + 1)
        log.append((key, seq, op, at, *fields))
        if op == "insert":
            blank = ["", 0.0, False]
            rules[key] = [b if f is None else f for f, b in zip(fields, blank, strict=True)] + [at]
        elif op == "delete":
            rules.pop(key, None)
        elif key in rules:
            kept = rules[key]
            rules[key] = [o if f is None else f for f, o in zip(fields, kept, strict=False)] + [at]
    got = sinks.apply_changes(rubric, spark.createDataFrame(log, CHANGE))
    assert {r[0]: list(r)[1:] for r in got.collect()} == rules
