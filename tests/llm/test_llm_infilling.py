import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import AWKWARD, awkward, empty, rows

from callsift.llm import infilling as fim
from pyspark.sql import functions as F

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    """The example by its definition: n, form, prefix, middle and output."""
    text = text or ""
    found = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(found) + 1) for x in h[:2])
    p, m, s = "".join(found[:a]), "".join(found[a:b]), "".join(found[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(found), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(found), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(found), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def ends(text):
    return fim.token_ends(np.frombuffer(text.encode(), dtype=np.uint8))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é漢😀\n\t\x0b\u0085 <P>", max_size=80))
def test_tokens(text):
    places, at = [], 0
    for token in TOKEN.findall(text):
        at += len(token)
        places.append(at)
    assert ends(text).tolist() == places


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=400))
def test_every_rank_is_reached(lengths):
    places = np.cumsum([0, *lengths])
    listed = fim.SkipList(places[1:])
    assert [listed.place(r)[0] for r in range(len(lengths) + 1)] == places.tolist()
    for lane in listed.lanes:
        assert lane.units.sum() <= len(lengths) and lane.points.sum() <= places[-1]


def test_few_steps():
    n = 300_000
    listed = fim.SkipList(np.arange(1, n + 1) * 3)
    pick = random.Random(1)
    taken = [listed.place(r) for r in (pick.randrange(n + 1) for _ in range(500))]
    assert max(steps for _, steps in taken) < 150
    assert sum(map(len, (lane.node for lane in listed.lanes))) < 1.5 * n


def test_awkward_rows(spark):
    got = fim.transformed(awkward(spark)).withColumn(
        "back", fim.restored(F.col("output"), F.col("form"))
    ).collect()
    assert len(got) == len(AWKWARD) + 3
    for r in got:
        if r["doc_id"] is not None:
            text = AWKWARD[r["doc_id"]]
            assert tuple(r)[1:-1] == brute(r["doc_id"], text)
            assert r["back"] == (text or "")
    assert fim.transformed(empty(spark)).count() == 0


def test_marks_and_edges_of_marks(spark):
    texts = ["a <P> b", "<S>", "x<M>", "< P>", "<", "<P", "P> <S", "a <", "> b <", "M><P <S <M"] * 40
    docs = spark.createDataFrame(
        [(i, *r[1:]) for i, r in enumerate(rows(texts))], "doc_id long, text string, a string, "
        "source string, n_chars long, n long, form string",
    )
    forms = set()
    for r in fim.transformed(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect():
        assert tuple(r)[1:-1] == brute(r["doc_id"], texts[r["doc_id"]])
        assert r["back"] == texts[r["doc_id"]]
        forms.add(r["form"])
    assert forms == {"plain", "psm", "spm"}


def test_other_shares(spark):
    docs = spark.createDataFrame(rows(["one two three"] * 50), "doc_id long, text string, a string, "
                                 "b string, c long, d long, e string")
    every = fim.transformed(docs, split_percent=100, suffix_first_percent=0)
    assert {r["form"] for r in every.collect()} == {"psm"}
    assert {r["form"] for r in fim.transformed(docs, split_percent=0).collect()} == {"plain"}
