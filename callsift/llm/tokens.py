"""Token counts with a digest cache, and token ids of a byte-level vocabulary.

Digest cache: a text is known by the digest of its normalised content and the digest of the
tokenizer's file. Counts are stored under both; a run joins the digests of its documents with the
stored ones, encodes each distinct missing text once and appends it.

Defined results: null text is empty; a text counts as the library counts it, special strings inside
it included; repeated rows and equal texts are encoded once and counted each; an empty table gives
no rows and appends nothing. Only doc_id and text are read. A cache that was appended to twice after
a failure holds equal rows twice, which readers fold.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsift.llm.jaccard import bit_table, in_table, table_size
from callsift.session import settle

CACHE = "content string, tokenizer string, n_tokens long"
BATCH_BYTES = 1 << 20
HELD_DIGESTS = 1_000_000  # that a task remembers to leave out copies
# Letters and signs on which all Unicode versions agree; other texts take the slower library.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ÿĀ-įĲ-ſ]*")


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@functools.lru_cache(maxsize=4)
def _fast_encoding(path: str):
    """The vocabulary of a byte-level BPE file in a faster library, or None if it isn't of that kind."""
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    if held.get("normalizer") or held["pre_tokenizer"].get("type") != "ByteLevel" or (
        held["pre_tokenizer"].get("add_prefix_space")
    ):
        return None
    special = {t["content"]: t["id"] for t in held["added_tokens"]}
    # The alphabet that byte-level files write bytes in: printable ones as they are, others shifted.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    if set(ByteLevel.alphabet()) != set(letters):
        return None
    ranks = {bytes(letters[c] for c in k): v for k, v in held["model"]["vocab"].items() if k not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def byte_pair_ids(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids as the tokenizers library gives them, no ids added.

    Texts of plain letters and signs go through a faster library with the same vocabulary, which the
    tests compare with the first; all other texts go through the tokenizers library itself.
    """
    fast = _fast_encoding(path)

    def ids(text: str) -> np.ndarray:
        if fast is not None and PLAIN.fullmatch(text):
            return fast.encode_to_numpy(text, allowed_special="all")
        # Loaded only where a text needs it: two vocabularies in every worker are a lot of memory.
        encoded = _tokenizer(path).encode_batch_fast([text], add_special_tokens=False)
        return np.array(encoded[0].ids, dtype=np.uint32)

    return ids


def slices(sizes: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, one row at least."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


class WordCounts:
    """Token counts of texts from the counts of their words, which the library gives once per word.

    For tokenizers that fold to lower case, cut texts by one pattern and encode every part by itself.
    Only plain texts without special strings are counted so; words are kept up to a number and then
    forgotten, and words longer than LONG at once, which bounds the memory.
    """

    KEPT, LONG = 400_000, 256

    def __init__(self, path: str, rule: str, special: list[str]):
        self.tokenizer = _tokenizer(path)
        signs = [chr(c) for c in range(0x20, 0x180) if PLAIN.fullmatch(chr(c))]
        kinds = {
            k: "".join(re.escape(c) for c in signs if unicodedata.category(c)[0] == k) for k in "LN"
        }
        # The classes written out for the letters and digits that plain texts can hold.
        self.parts = re.compile(rule.replace(r"\p{L}", kinds["L"]).replace(r"\p{N}", kinds["N"])).findall
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        cut = [
            self.parts(t.lower()) if PLAIN.fullmatch(t) and not self.special.search(t) else None
            for t in texts
        ]
        if len(self.known) > self.KEPT:
            self.known.clear()
        new = list({word for words in cut if words for word in words if word not in self.known})
        whole = [t for t, words in zip(texts, cut, strict=True) if words is None]
        found = self.tokenizer.encode_batch_fast(new + whole, add_special_tokens=False)
        fresh = dict(zip(new, map(len, found), strict=False))
        self.known.update(fresh)
        rest = iter(found[len(new) :])
        counts = [
            len(next(rest)) if words is None else sum(map(self.known.__getitem__, words)) for words in cut
        ]
        for word in fresh:
            if len(word) > self.LONG:
                del self.known[word]
        return counts


def _word_rule(path: str) -> tuple[str, list[str]] | None:
    """The pattern of a tokenizer that `WordCounts` can stand for, and its special strings."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    steps = [s.get("type") for s in (held.get("normalizer") or {}).get("normalizers", [])]
    cuts = (held.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [c.get("type") for c in cuts] != ["Split", "ByteLevel"]:
        return None
    if not (cuts[0]["invert"] and cuts[0]["behavior"] == "Removed") or cuts[1]["use_regex"] or (
        cuts[1]["add_prefix_space"]
    ):
        return None
    return cuts[0]["pattern"]["Regex"], [t["content"] for t in held["added_tokens"]]


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their token counts, by the library that the file's ending names."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    rule = _word_rule(path)
    if rule is not None:
        return WordCounts(path, *rule)
    made = _tokenizer(path)
    return lambda texts: [len(e) for e in made.encode_batch_fast(texts, add_special_tokens=False)]


def file_digest(path: str) -> str:
    """The version of a tokenizer: the digest of its file."""
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def normalised(text: Column, collapse: bool) -> Column:
    """The content that decides the count: null as empty, runs of white space as one blank.

    `collapse` is for tokenizers that do the same replacement themselves.
    """
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ") if collapse else text


def collapses(path: str) -> bool:
    """Whether the tokenizer itself replaces runs of white space by one blank."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        rule = json.load(file).get("normalizer") or {}
    steps = rule.get("normalizers", [rule])
    return any(s.get("pattern", {}).get("Regex") == r"\s+" and s.get("content") == " " for s in steps)


def read_cache(spark, path: str) -> DataFrame:
    """The stored counts, each once; an empty cache is made where there is none."""
    spark.createDataFrame([], CACHE).write.mode("ignore").parquet(path)
    return spark.read.schema(CACHE).parquet(path).dropDuplicates(["content", "tokenizer"])


def missing_texts(docs: DataFrame, content: Column, known: DataFrame) -> DataFrame:
    """(content, text), one row per digest of `docs` that `known` lacks.

    Which digests are missing is found on digests alone. Texts are looked at where they lie: a task hands on
    a text only if its digest may be missing, by a bit table, and only once, so neither
    texts with a stored count nor a task's copies are shuffled.
    """
    spark = docs.sparkSession
    keyed = docs.select(content.alias("content"), F.coalesce("text", F.lit("")).alias("text"))
    first = F.row_number().over(Window.partitionBy("content").orderBy("text"))
    if known.isEmpty():  # every digest is missing; the window folds a task's copies before the shuffle
        return keyed.withColumn("_n", first).filter("_n = 1").drop("_n")
    misses = settle(
        keyed.select("content").distinct().join(known.select("content"), "content", "left_anti"), "misses"
    )
    hashes = misses.select(F.xxhash64("content").alias("v"))
    shipped = spark.sparkContext.broadcast(bit_table(hashes, table_size(misses.count())))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, given = shipped.value, set()
        for batch in batches:
            kept = []
            for i in np.flatnonzero(in_table(wanted, batch.column("h").to_numpy())):
                digest = batch.column("content")[int(i)].as_py()
                if digest not in given:
                    kept.append(i)
                    if len(given) < HELD_DIGESTS:  # beyond it copies are let through, and folded below
                        given.add(digest)
            yield batch.take(pa.array(kept, pa.int64())).drop_columns(["h"])

    likely = keyed.withColumn("h", F.xxhash64("content")).mapInArrow(pick, "content string, text string")
    return likely.withColumn("_n", first).filter("_n = 1").drop("_n").join(misses, "content", "left_semi")


def count_tokens(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of whole texts; `cache` is the folder of stored counts."""
    spark, version, collapse = docs.sparkSession, file_digest(tokenizer), collapses(tokenizer)
    content = F.md5(normalised(F.col("text"), collapse))
    known = read_cache(spark, cache).filter(F.col("tokenizer") == version)
    misses = missing_texts(docs, content, known)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            texts = batch.column("text")
            sizes = np.array([len(t.as_buffer()) for t in texts], dtype=np.int64)
            counts = [n for a, b in slices(sizes) for n in count(texts[a:b].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array([version] * len(counts), pa.string()),
                 pa.array(counts, pa.int64())],
                ["content", "tokenizer", "n_tokens"],
            )

    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    stored = read_cache(spark, cache).filter(F.col("tokenizer") == version).drop("tokenizer")
    keyed = docs.select(
        "doc_id", content.alias("content"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return keyed.join(stored, "content").select("doc_id", "n_bytes", "n_tokens")
