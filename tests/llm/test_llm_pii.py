import hashlib
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from llm_data import AWKWARD, awkward, empty, prose

from callsift.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group(0))
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group(0).split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 8 <= len(digits) <= 15}[kind]():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want, r = brute(text), got[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k + ":") for w in want) for k in PATTERNS]
        assert set(want) <= set(r["spans"].split(",")) | {""}
    return got


FIXED = [
    "mail a.b+c@mail1.example.com, x@y (no), q@w.e_d@e.f é@x.y", "1.2.3.4 1.2.3.256 1.2.3.4.5.6.7.8 001.02.3.0255",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 0", "+1 (437) 555-0689. +49 30 1234567890123456 +12",
    "Ä漢 +1 234 567 8901 a@b.c 10.0.0.1", "1" * 4000, "1-" * 3000 + "4111111111111111", "a" * 3000 + "@b.c",
    "." * 50 + "@x.y", "a@b@c.d.e..f", "1.1.1.1" * 50, "+1" * 200, "9999999999999999.9.9.9",
]


def test_base_spans_are_those_of_the_patterns(spark):
    check(spark, FIXED + AWKWARD)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a.@-_+ 0149() é\n", max_size=40), min_size=30, max_size=60))
def test_any_base_spans(spark, texts):
    check(spark, texts)


def test_confident_contexts_discover_unseen_identifiers(spark):
    texts = [f"ping host: 10.0.{i}.1 now" for i in range(6)]
    texts += ["ping host: srv-00412.local now", "the host: nobody", "the note: 10.0.0.9", "note: all12345",
              "note: b123456", "Host = 10.9.9.9"]
    texts += [f'token = "{hashlib.sha256(str(i).encode()).hexdigest()}"' for i in range(4)]
    texts += ['TOKEN = "unseen-123456-zz" end', "token = none", "say: id1234567"]
    got = check(spark, texts)
    assert "ip:11:26" in got[6]["spans"]  # srv-00412.local, by its context
    assert got[7]["spans"] == got[9]["spans"] == got[10]["spans"] == got[18]["spans"] == ""
    assert got[16]["spans"] == "secret:9:25" and got[17]["spans"] == ""
    assert got[12]["spans"] == "secret:9:73"


def test_known_values_carry_confidence_to_other_patterns(spark):
    """Values learned in one context make a second one confident, which finds a further value."""
    texts = [f"host: 10.0.{i}.1" for i in range(8)] + [f"host: box-77{i}-x" for i in range(4)]
    texts += [f"node: box-77{i}-x" for i in range(4)] + ["node: box-9991-y"]
    got = check(spark, texts)
    assert got[16]["spans"] == "ip:6:16"


def test_redaction(spark):
    texts = ["call +1 (437) 555-0689 or a@b.cd now", "4111111111111111@x.y", "clean text 12", None, "Ä a@b.c"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_email long")
    got = {r["doc_id"]: r["text"] for r in pii.redacted(docs.unionAll(docs.limit(1))).collect()}
    assert got == {0: "call [PHONE] or [EMAIL] now", 1: "[EMAIL]", 2: "clean text 12", 3: None, 4: "Ä [EMAIL]"}
    assert pii.redacted(docs).columns == docs.columns


def test_awkward_rows(spark):
    assert pii.report(awkward(spark)).count() == len(AWKWARD) + 3
    assert pii.redacted(awkward(spark)).count() == len(AWKWARD) + 3
    assert pii.report(empty(spark)).count() == 0 and pii.redacted(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = pii.report(awkward(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_words_around_a_seed_find_more(spark):
    """Seeds in prose, without a sign before them, make patterns of the words around them."""
    texts = [f"you may write to ann{i}@mail.example.com today" for i in range(5)]
    texts += [f"reach me by phone +1 437 555 06{i}9" for i in range(5)]
    texts += [f"our key is {hashlib.md5(str(i).encode()).hexdigest()} ok" for i in range(5)]
    texts += ["you may write to ann.lee77123 today", "phone: 555 123 4567", "our key is 5fa2-77x1-99 ok",
              "page 123456 of it", "we sold 1234567 in all"]
    texts += [f"the 10.5.{i}.7 here" for i in range(4)] + ["the 2468101 here"]  # "the" has other words, too
    texts += [f"the {w} here" for w in "dog cat cow pig hen".split()]
    got = check(spark, texts)
    assert got[24]["spans"] == ""
    assert "email:17:29" in got[15]["spans"].split(",")
    assert got[16]["spans"] == "phone:7:19"
    assert got[17]["spans"] == "secret:11:23"
    assert got[18]["spans"] == got[19]["spans"] == ""


def test_learning_goes_on_until_nothing_is_new(spark):
    """Each context is learned from the one before it, over more rounds than three."""
    texts = [f"hosta: 10.0.{i}.1" for i in range(9)]
    for level in range(6):
        for name in "abcdefg"[level : level + 2]:
            texts += [f"host{name}: box{level}-77{i}-x" for i in range(4)]
            texts += [f"host{name}: 10.1.{level}.{i}" for i in range(1)]
    got = check(spark, texts)
    assert all("ip:" in got[i]["spans"] for i in range(len(texts)))


def test_nested_and_chained_assignments(spark):
    key = "5fa2b6cd" * 4
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(
        [f"config: token={key}", "Note: email: jane@x.org", "?user=jdoe77123&token=abc123456"])],
        "doc_id long, text string")
    found = pii.examined(docs).selectExpr("doc_id", "inline(mentions)")
    edges = {(r["doc_id"], r["pattern"], r["start"], r["text"]) for r in found.collect()}
    assert edges >= {(0, "token=", 14, key), (1, "email:", 13, "jane@x.org"), (2, "user=", 6, "jdoe77123"),
                     (2, "token=", 22, "abc123456")}
    assert not any(r[1] in ("config:", "note:") for r in edges)


def test_looks_rule_out_what_all_texts_would(spark, monkeypatch):
    """Growing looks leave the same patterns and counts as one look at all texts."""
    pick = random.Random(8)
    common = ["the", "of", "and", "ticket", "account", "ref"]
    docs = spark.createDataFrame(
        [(i, " ".join(pick.choice([*common, prose(i * 9 + j, 1)]) for j in range(30))) for i in range(400)],
        "doc_id long, text string")
    asked = spark.createDataFrame(
        [("the _", 5), ("account _", 400), ("_ of", 3), ("of the _", 2), ("never seen _", 1)],
        "pattern string, all long")
    whole = [tuple(sorted(map(tuple, f.collect()))) for f in pii.unrefuted(docs, asked)]
    real = pii.looks
    monkeypatch.setattr(pii, "looks", lambda d: real(d, 10, 3))
    left, seen = pii.unrefuted(docs, asked)
    assert tuple(sorted(map(tuple, left.collect()))) == whole[0]
    kept = {p for p, _ in whole[0]}
    assert {"never seen _", "account _"} >= kept >= {"never seen _"}
    assert {r for r in map(tuple, seen.collect()) if r[0] in kept} == {r for r in whole[1] if r[0] in kept}


def test_ordinary_words_like_plain_python(spark):
    texts = [prose(i, 60) + f" order A{i}77123 of the day. the the {i}" for i in range(30)] + [None, "", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    patterns = ["the _", "of the _", "_ of", "day the the _", "order _", "_ order"]
    want = {}
    for text in texts:
        words = re.findall(r"[^\W]+", re.sub(r"[0-9]+", "0", re.sub(r"\S*[0-9]\S*", " 0 ", (text or "").lower())))
        for i, word in enumerate(words):
            if "0" in word:
                continue
            near = [" ".join(words[i - n : i]) + " _" for n in (1, 2, 3) if i >= n]
            near += [f"_ {words[i + 1]}"] if i + 1 < len(words) else []
            for pattern in set(near) & set(patterns):
                want.setdefault(pattern, set()).add(word)
    got = pii.ordinary(docs, spark.createDataFrame([(p,) for p in patterns], "pattern string")).collect()
    assert {r["pattern"]: r["n_ordinary"] for r in got} == {p: len(w) for p, w in want.items()}
