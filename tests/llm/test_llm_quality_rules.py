import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import AWKWARD, awkward, empty, prose

from callsift.llm import quality_rules as qr


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 8))
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_are_exact(spark):
    got = qr.statistics(awkward(spark)).collect()
    assert len(got) == len(AWKWARD) + 3
    for r in got:
        if r["doc_id"] is not None and len(AWKWARD[r["doc_id"]] or "") < 20_000:
            assert tuple(r[n] for n in NAMES) == brute(AWKWARD[r["doc_id"]])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("a b #c é*".split()), max_size=60))
def test_repeated_words(words):
    _, ids = np.unique(np.array(words + ["."]), return_inverse=True)
    from callsift.llm.common import mix
    assert qr.repeated_words(mix(ids[: len(words)].astype(np.uint64) + np.uint64(1))) == brute(" ".join(words))[4]


def test_lines_and_symbols(spark):
    texts = ["a\na\n\n\na \nb\na", "x|y <z>\r\nq", "".join(prose(2, 30) + " ") * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in qr.statistics(docs).collect():
        assert tuple(r[n] for n in NAMES) == brute(texts[r["doc_id"]])


def labelled(spark):
    pick, texts, labels = random.Random(3), [], []
    for i in range(600):
        bad = i % 5 == 0
        words = prose(i, 30 + i % 50).split()
        if bad and i % 2:
            words = [w + "***" for w in words]
        elif bad:
            words = [w.upper() for w in words]
        texts.append((i, " ".join(words)))
        labels.append((i, 0 if bad != (pick.random() < 0.01) else 1, 0))
    return (spark.createDataFrame(texts, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality long, toxic long"))


def test_learned_list_finds_both_kinds_of_junk(spark):
    docs, labels = labelled(spark)
    stats = qr.statistics(docs)
    rules = qr.train(stats, labels)
    assert 2 <= len(rules) <= 5 and all(1 <= len(r) <= 4 for r in rules)
    assert "upper_share > " in " ".join(qr.described(rules))
    rejected = {r["doc_id"] for r in stats.filter(~qr.verdict(rules)).collect()}
    assert rejected == set(range(0, 600, 5))


def test_ordered_expression_matches_the_rules(spark):
    docs, labels = labelled(spark)
    stats = qr.statistics(docs)
    rules = [(qr.Test("words", True, 40.0), qr.Test("upper_share", False, 0.5)),
             (qr.Test("symbols_per_word", True, 1.0),)]
    wide = stats.select("doc_id", qr.verdict(rules).alias("kept"), qr.base_failed().alias("b"),
                        *[m.alias(n) for n, m in qr.measures().items()]).toPandas()
    data = {n: wide[n].to_numpy() for n in qr.measures()}
    want = ~wide["b"].to_numpy()
    for rule in rules:
        want &= ~qr.covers(rule, data, len(wide))
    assert (wide["kept"].to_numpy() == want).all()


def test_without_labels_only_the_base_decides(spark):
    docs, labels = labelled(spark)
    stats = qr.statistics(docs)
    assert qr.train(stats, labels.limit(0)) == []
    assert qr.train(stats, labels.filter("quality = 1")) == []
    null = labels.selectExpr("doc_id", "cast(null as long) as quality")
    assert qr.train(stats, null.unionAll(null)) == []
    assert stats.filter(qr.verdict([])).count() == 600
    assert qr.statistics(empty(spark)).count() == 0


def test_pruning_drops_noise():
    pick = np.random.Generator(np.random.PCG64(1))
    n = 3000
    data = {"words": pick.random(n), "noise": pick.random(n)}
    bad = data["words"] > 0.8
    rules = qr.learn(data, bad, np.arange(n) % 3 == 2)
    found = np.zeros(n, dtype=bool)
    for rule in rules:
        found |= qr.covers(rule, data, n)
    assert (found == bad).mean() > 0.99
    assert qr.learn(data, pick.random(n) < 0.2, np.arange(n) % 3 == 2) == []
