"""The pipeline on a small folder, stage by stage, against plain versions of each decision."""

import random
import re
from collections import Counter

import pytest
from llm_data import awkward, empty, prose

import corpus_pipeline

PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    pick, rows = random.Random(8), []
    for i in range(160):
        text = prose(i, pick.choice([30, 80, 700]))
        if i % 10 == 3:
            text += " write to a.person@mail.example.com now"
        rows.append((i, text, "xx", f"s{i % 3}", len(text)))
    for i in range(40):  # copies and near copies of every fourth document
        words = rows[4 * i][1].split()
        if i % 2:
            words[len(words) // 2] = "changed"
        rows.append((1000 + i, " ".join(words), "xx", "s1", 5))
    rows += [(2000, None, "xx", "s0", None), (2001, "1234 5678", "xx", "s0", 9), (2002, "", None, None, 0)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), PLAIN).write.parquet(f"{path}/documents.parquet")
    return path


def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.settle(stage(spark, docs, folder))
        yield name, before, docs


def test_every_stage_decides(spark, folder):
    seen = []
    for name, before, after in stages(spark, folder):
        seen.append(name)
        if name != "best-fit packing":
            assert after.columns == before.columns
        old = {r["doc_id"]: r for r in before.collect()}
        if name == "language ID":
            assert set(old) - {r["doc_id"] for r in after.collect()} == {2000, 2001, 2002}
        if name == "n-gram Jaccard join":
            kept = {r["doc_id"] for r in after.collect()}
            assert kept >= set(range(160)) and 1000 not in kept and len(kept) < len(old)
            for i in set(old) - kept:
                twin = old[4 * (i - 1000)]["text"].split()
                assert sum(a != b for a, b in zip(twin, old[i]["text"].split(), strict=True)) <= 1
        if name == "PII":
            for r in after.collect():
                assert r["text"] == re.sub(r"a\.person@mail\.example\.com", "[EMAIL]", old[r["doc_id"]]["text"])
                assert r["n_chars"] == len(r["text"])
        if name == "mixing sources to target weights":
            times = Counter(r["doc_id"] for r in after.collect())
            assert set(times) <= set(old) and max(times.values()) == 2
            words = {s: sum(len(r["text"].split()) for r in old.values() if r["source"] == s) for s in ("s0", "s1", "s2")}
            taken = Counter()
            for r in after.collect():
                assert r["text"] == old[r["doc_id"]]["text"]
                taken[r["source"]] += len(r["text"].split())
            assert abs(sum(taken.values()) - 1.5 * sum(words.values())) < 1500
        if name == "best-fit packing":
            rows = after.collect()
            times = Counter((r["doc_id"], r["piece"]) for r in rows)
            assert {d for d, _ in times} == set(old)
            bins = Counter()
            for r in rows:
                bins[r["sequence_id"]] += r["length"]
            assert max(bins.values()) <= 2048
    assert seen == [name for name, _ in corpus_pipeline.STAGES]


def test_run_gives_the_last_stage(spark, folder):
    *_, (_, _, last) = stages(spark, folder)
    got = corpus_pipeline.run(spark, folder)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(got.select(columns).collect()) == sorted(last.select(columns).collect())


def test_awkward_and_empty_tables(spark, tmp_path):
    for name, frame in (("a", awkward(spark)), ("b", empty(spark))):
        docs = frame
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.settle(stage(spark, docs, str(tmp_path)))
        assert (docs.count() > 0) == (name == "a")


def test_columns_of_the_same_name_survive(spark, tmp_path):
    rows = [(i, prose(i, 40), "xx", "s", 5, 0.25, "kept") for i in range(30)]
    docs = spark.createDataFrame(rows, PLAIN + ", score double, lang_pred string")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.settle(stage(spark, docs, str(tmp_path)))
    assert {(r["score"], r["lang_pred"]) for r in docs.collect()} == {(0.25, "kept")}


def test_copies_from_five_words_and_four_fifths_go(spark, tmp_path):
    """Copies at similarities between 0.80 and 0.85, and one just below 0.80 that stays."""
    def similarity(a, b):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        return len(x & y) / len(x | y)

    rows = []
    for i, cut in enumerate([30, 33, 36, 39, 41]):
        words = [f"{w}{j}" for j, w in enumerate(prose(900 + i, 204).split())]
        part = words[: 204 - cut]
        assert (similarity(words, part) >= 0.8) == (cut < 41) and 0.79 < similarity(words, part) < 0.855
        rows += [(i, " ".join(words), "xx", "s", 5), (100 + i, " ".join(part), "xx", "s", 5)]
    docs = spark.createDataFrame(rows, PLAIN)
    kept = corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 3, 4, 104}


def test_rows_without_id_and_ids_with_two_texts(spark, tmp_path):
    words = [f"w{i}" for i in range(300)]
    whole, cut, other = " ".join(words), " ".join(words[:280]), prose(7, 60)
    rows = [(1, whole), (None, whole), (None, cut), (2, cut), (None, other), (None, other),
            (None, other + " and more"), (None, None), (None, ""), (5, prose(8, 50)), (5, prose(9, 50))]
    docs = spark.createDataFrame([(i, t, "xx", "s", 5) for i, t in rows], PLAIN)
    kept = [
        sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.STAGES[1][1](
            spark, docs.repartition(n), str(tmp_path)).collect()), key=repr)
        for n in (1, 5)
    ]
    assert kept[0] == kept[1]
    ids = [i for i, _ in kept[0]]
    assert sorted(i for i in ids if i is not None) == [1, 5]
    texts = [t for i, t in kept[0] if i is None]
    assert len(texts) == 2 and sum(bool(t) for t in texts) == 1  # one of the others, one empty
