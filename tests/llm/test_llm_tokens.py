import random
import re

import public_tokenizers
import sentencepiece
from llm_data import AWKWARD, awkward, empty
from tokenizers import Tokenizer

from callsift.llm import tokens
from callsift.session import scratch_path

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_counts_are_the_librarys(spark):
    slow, path = Tokenizer.from_file(WORDS), scratch_path(spark, "cache")
    got = tokens.count_tokens(awkward(spark), WORDS, path).collect()
    assert len(got) == len(AWKWARD) + 3
    want = {i: len(slow.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(AWKWARD)}
    sizes = {i: len((t or "").encode()) for i, t in enumerate(AWKWARD)}
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_tokens"], r["n_bytes"]) == (want[r["doc_id"]], sizes[r["doc_id"]])


def test_normalised_white_space_counts_the_same():
    slow = Tokenizer.from_file(WORDS)
    assert tokens.collapses(WORDS)
    for text in ("a  b\n\nc", "<|endoftext|> x\t", "  lead", "it's\r\n'll", "a\x0bb \n c"):
        flat = re.sub(
            r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ", text)
        assert len(slow.encode(text, add_special_tokens=False).ids) == len(
            slow.encode(flat, add_special_tokens=False).ids)


def test_words_add_up_to_the_librarys_counts(monkeypatch):
    slow, count, pick = Tokenizer.from_file(WORDS), tokens.counter(WORDS), random.Random(6)
    assert isinstance(count, tokens.WordCounts)
    monkeypatch.setattr(tokens.WordCounts, "KEPT", 50)
    signs = [chr(c) for c in range(9, 0x180)] + ["<|endoftext|>", "'ll", "'S", "漢", *" " * 40, *"'" * 8]
    for _ in range(60):
        texts = ["".join(pick.choice(signs) for _ in range(pick.randint(0, 40))) for _ in range(50)]
        whole = [len(e.ids) for e in slow.encode_batch(texts, add_special_tokens=False)]
        assert count(texts) == whole


def test_only_misses_are_encoded_and_appended(spark):
    path, docs = scratch_path(spark, "cache"), awkward(spark)
    half = docs.filter("doc_id < 6")
    tokens.count_tokens(half, WORDS, path).collect()
    before = spark.read.parquet(path)
    assert before.count() == before.select("content").distinct().count() == 5  # null is "", one text twice
    files = set(before.inputFiles())
    tokens.count_tokens(docs, WORDS, path).collect()
    after = spark.read.parquet(path)
    assert after.count() == after.select("content").distinct().count()
    assert files < set(after.inputFiles())
    now = after.count()
    tokens.count_tokens(docs, WORDS, path).collect()
    assert spark.read.parquet(path).count() == now


def test_stored_counts_are_used_per_version(spark):
    path = scratch_path(spark, "cache")
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    tokens.count_tokens(docs, WORDS, path).collect()
    stored = spark.read.parquet(path).first()
    spark.createDataFrame([(stored["content"], "another version", 99)], tokens.CACHE).write.mode(
        "append").parquet(path)
    assert tokens.count_tokens(docs, WORDS, path).first()["n_tokens"] == stored["n_tokens"]


def test_other_libraries(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    plain = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = spark.createDataFrame([(1, "Some words, e.g. äöü"), (2, None)], "doc_id long, text string")
    got = tokens.count_tokens(docs, model, scratch_path(spark, "cache")).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {1: len(plain.encode("Some words, e.g. äöü")), 2: 0}


def test_empty(spark):
    assert tokens.count_tokens(empty(spark), WORDS, scratch_path(spark, "cache")).count() == 0


def test_slices():
    import numpy as np
    assert list(tokens.slices(np.array([5, 5, 20, 1, 1]), 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(tokens.slices(np.array([], dtype=int), 10)) == []


def test_a_full_cache_shuffles_no_text(spark):
    path, docs = scratch_path(spark, "cache"), awkward(spark).select("doc_id", "text")
    tokens.count_tokens(docs, WORDS, path).collect()
    content = tokens.F.md5(tokens.normalised(tokens.F.col("text"), tokens.collapses(WORDS)))
    version = tokens.file_digest(WORDS)
    known = tokens.read_cache(spark, path).filter(tokens.F.col("tokenizer") == version)
    left = tokens.missing_texts(docs, content, known)
    assert left.count() == 0
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    # All text that a shuffle sees comes out of the Python step, which hands on missing texts only.
    above, below = plan.split("MapInArrow", 1)
    assert "Window" in above and "Window" not in below and "Join" not in below
    fewer = known.filter(known["content"] != known.first()["content"])
    assert tokens.missing_texts(docs, content, fewer).count() == 1
