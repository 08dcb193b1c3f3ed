"""Quality rules: decision lists learned from labelled statistics by sequential covering.

Statistics of whole texts are counted in one pass. From a bounded sample of labelled documents,
conjunctions of thresholds that pick out bad documents are grown one condition at a time by
information gain on two thirds of the sample and pruned on the rest; a rule is kept if it is precise
on the rows it has not seen, its rows are taken away, and the next one is learned. The list becomes
one ordered Spark conditional expression.

Defined results: null text has no words; a document without words fails the base; without labelled
documents of both kinds no rule is learned and only the base decides; a document with several labels
counts as bad if one of them is; repeated rows are judged each. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsift.llm.common import text_bytes, window_hashes, word_hashes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct",
          "n_upper", "n_marks")
WINDOW = 8
SAMPLE = 20_032
SAMPLE_GROUPS = 64

_SPACE = [0x20, *range(0x09, 0x0E)]
_TABLES = {
    # Continuation bytes are no code points of their own, white space is in no word.
    "word_chars": [b not in _SPACE and b & 0xC0 != 0x80 for b in range(256)],
    "n_symbols": [b in b"#*$%&|<>" for b in range(256)],
    "n_upper": [0x41 <= b <= 0x5A for b in range(256)],
    "n_marks": [b in b"!?;:\"'()[]{}/\\^~_=+@`" for b in range(256)],
}


def repeated_words(words: np.ndarray) -> int:
    """How many words lie in a window of WINDOW words that occurs twice or more."""
    windows = window_hashes(words, WINDOW)
    if len(windows) < 2:
        return 0
    _, group, times = np.unique(windows, return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[group] > 1)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return int((np.cumsum(change) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """How many lines with a word equal an earlier line."""
    seen, found = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            found += bool(line.strip())
        else:
            seen.add(line)
    return found


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of its whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {name: np.array(mask) for name, mask in _TABLES.items()}
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            out = {name: np.zeros(len(at) - 1, dtype=np.int64) for name in COUNTS}
            for row, words, begins in word_hashes(batch.column(1), lower=False):
                for i in range(len(begins) - 1):
                    own = words[begins[i] : begins[i + 1]]
                    text = data[at[row + i] : at[row + i + 1]]
                    out["n_words"][row + i] = len(own)
                    out["n_distinct"][row + i] = len(np.unique(own))
                    out["n_repeat_words"][row + i] = repeated_words(own)
                    out["n_dup_lines"][row + i] = duplicate_lines(text.tobytes())
                    bytes_held = np.bincount(text, minlength=256)
                    for name, mask in tables.items():
                        out[name][row + i] = bytes_held[mask].sum()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(out[name]) for name in COUNTS]], ["doc_id", *COUNTS]
            )

    kinds = ", ".join(f"{name} long" for name in COUNTS)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, f"doc_id long, {kinds}")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """What rules may test, from the counts."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    letters = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "duplicate_lines": F.col("n_dup_lines").cast("double"),
        "repeated_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("n_distinct") / words,
        "upper_share": F.col("n_upper") / letters,
        "marks_per_word": F.col("n_marks") / words,
    }


@dataclass(frozen=True)
class Test:
    measure: str
    above: bool
    threshold: float

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        value = data[self.measure]
        return value > self.threshold if self.above else value <= self.threshold

    def column(self) -> Column:
        value = measures()[self.measure]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def covers(rule: Rule, data: dict[str, np.ndarray], n: int) -> np.ndarray:
    held = np.ones(n, dtype=bool)
    for test in rule:
        held &= test.holds(data)
    return held


def best_test(data: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> Test | None:
    """The condition with the highest information gain among the rows inside."""
    p, n = (inside & bad).sum(), (inside & ~bad).sum()
    before, best, most = np.log2(p / (p + n)), None, 1e-9
    for name, values in data.items():
        seen = np.unique(np.quantile(values[inside], np.linspace(0, 1, 65)))
        for threshold in (seen[1:] + seen[:-1]) / 2:  # halfway, so that unseen values fall either way
            for above in (True, False):
                test = Test(name, above, float(threshold))
                held = inside & test.holds(data)
                p1, n1 = (held & bad).sum(), (held & ~bad).sum()
                if p1 and (gain := p1 * (np.log2(p1 / (p1 + n1)) - before)) > most:
                    best, most = test, gain
    return best


def learn(data: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, precision: float = 0.95,
          support: int = 5, most_rules: int = 16, most_tests: int = 4) -> list[Rule]:
    """Ordered rules for bad rows. Rows with `fold` true prune and judge, the others grow."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < most_rules and (left & bad & ~fold).any():
        inside, rule = left & ~fold, ()
        while len(rule) < most_tests and (inside & ~bad).any():
            test = best_test(data, bad, inside)
            if test is None:
                break
            rule = (*rule, test)
            inside &= test.holds(data)
        if not rule:
            break

        def worth(kept: Rule) -> float:
            held = covers(kept, data, len(bad)) & left & fold
            return ((held & bad).sum() - (held & ~bad).sum()) / max(1, held.sum())

        shorter = [rule[:i] for i in range(len(rule), 0, -1)]
        rule = max(shorter, key=lambda kept: (worth(kept), -len(kept)))
        held = covers(rule, data, len(bad)) & left
        judged = held & fold
        if (held & bad).sum() < support or (judged & bad).sum() < precision * judged.sum() or (
            (held & bad).sum() < precision * held.sum()
        ):
            break
        rules.append(rule)
        left &= ~held
    return rules


def train(stats: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[Rule]:
    """Rules from the statistics of labelled documents that pass the base; at most `most` of them reach
    the driver as a few numbers each: of every group of ids the ones with the smallest hashes."""
    judged = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("quality")
    )
    joined = stats.filter(~base_failed()).join(judged, "doc_id")
    hashed = F.xxhash64("doc_id")
    wanted = joined.select(
        hashed.alias("h"), F.pmod(hashed, F.lit(SAMPLE_GROUPS)).alias("g"),
        (F.col("quality") == 0).alias("bad"), *[m.alias(name) for name, m in measures().items()],
    )
    # Tasks cut their own rows first, so no task gets more than a bounded list from each of them.
    place = F.row_number().over(Window.partitionBy("g").orderBy("h", *measures()))
    few = wanted.withColumn("n", place).filter(F.col("n") <= most // SAMPLE_GROUPS)
    frame = few.toArrow().sort_by([(c, "ascending") for c in ("h", *measures())]).to_pandas()
    bad = frame["bad"].to_numpy(dtype=bool)
    if not bad.any() or bad.all():
        return []
    return learn(
        {name: frame[name].to_numpy(dtype=float) for name in measures()}, bad,
        np.arange(len(frame)) % 3 == 2,
    )


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one expression: the first rule that holds rejects, else the row is kept."""
    chain = F.when(base_failed(), F.lit(False))
    for rule in rules:
        held = F.lit(True)
        for test in rule:
            held = held & test.column()
        chain = chain.when(held, F.lit(False))
    return chain.otherwise(F.lit(True))


def described(rules: list[Rule]) -> list[str]:
    return [" AND ".join(map(str, rule)) for rule in rules]
