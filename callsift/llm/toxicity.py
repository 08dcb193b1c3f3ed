"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause runs from one mark of punctuation or line end to the next. Three kinds of machines work on it:

- The lexicon is an automaton over letters. It accepts insults and threats, as whole words or as
  beginnings of words, each with a weight. Given words start it; labelled texts set the weights, add the
  words and beginnings that tell labelled texts apart, and take away given ones that don't.
- Three transducers over a clause's words rewrite what the lexicon accepted: a negation shortly before
  marks it as negated, a word of reported speech as reported, a word for a person as targeted. Their arcs
  carry factors. They are composed into one machine, built state by state, before any text is read.
- A clause scores the sum over its accepted words of lexical weight times the factors on the path. Only
  clauses with such a word are walked through; a word on its own has no score.

A text's clauses give a few measures (their sum, the strongest, their number, the share of words, how many
different words), and a logistic curve turns these into the score. It is fitted, like the lexicon, on a
bounded sample: about SAMPLE_TOXIC and SAMPLE_CLEAN labelled texts, by the smallest hashes of their ids;
near copies in it, which share one of four min-hashes, count once. Two thirds set the lexicon, one third
the curve. Scoring reads whole texts of all rows.

Defined results: null, empty and wordless texts score what a text without any matched clause scores;
without labelled texts of both kinds the given words and a fixed curve decide; a document with several
labels is toxic if one of them says so, labels that are null or belong to no text count for nothing; rows
that share a doc_id are scored each, and the smallest of their texts is the labelled one; an empty table
gives no rows. Of documents only doc_id and text are read.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.llm.common import window_hashes, word_hashes
from callsift.session import settled

SAMPLE_TOXIC, SAMPLE_CLEAN = 6_000, 9_000
MOST_ENTRIES = 8_192
SHORTEST, LONGEST = 3, 8  # code points of a beginning of a word
LEAST_TEXTS = 4  # toxic sample texts that hold a learned entry
LEAST_WEIGHT, GIVEN_WEIGHT = 2.0, 2.0
LEAST_EVIDENCE = 18.0  # of the log-likelihood ratio
WHOLE = "$"  # behind an entry that is a whole word

# The given words.
INSULTS = (
    "idiot moron imbecile stupid dumb loser scum trash clown worthless pathetic disgusting vermin "
    "dummkopf abschaum trottel versager idiotin imbécile crétin ordure connard raté "
    "idiota imbécil estúpido basura escoria"
).split()
THREATS = (
    "kill murder stab shoot strangle destroy umbringen töten erschießen tuer étrangler matar apuñalar"
).split()
TARGETS = (
    "you your yours he she they him her them u du dich dir ihr euch sie tu toi te vous vos ton ta "
    "tú te usted ustedes él ella"
).split()
NEGATIONS = (
    "not no never nobody none isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás"
).split()
REPORTS = (
    "said says say saying called calls claimed wrote quoted reported according "
    "sagte sagt nannte schrieb laut dit disait écrit selon dijo dice llamó escribió según"
).split()

# Arcs' factors: what is negated or only reported weighs less, what is aimed at someone more.
NEGATED, REPORTED, TARGETED = 0.2, 0.5, 1.3
SCOPE = 3  # words behind a negation or a target that it reaches

CLAUSE_END = re.compile(r"[.!?;:\n…]+")
CLAUSE_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


# Transducers.


@dataclass
class Transducer:
    """A deterministic weighted transducer: (state, symbol) -> (state, symbol, factor).

    A symbol without an arc stays as it is, leads where `rest` says, and has factor 1.
    """

    arcs: dict[tuple[int, str], tuple[int, str, float]] = field(default_factory=dict)
    rest: dict[int, int] = field(default_factory=dict)
    start: int = 0

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        found = self.arcs.get((state, symbol))
        return found or (self.rest.get(state, state), symbol, 1.0)


def marker(cue: str, accepted: list[str], mark: str, factor: float, scope: int | None) -> Transducer:
    """Marks accepted symbols up to `scope` words behind a cue, or to the end without a scope."""
    made = Transducer()
    reach = 1 if scope is None else scope
    for state in range(reach + 1):
        made.arcs[state, cue] = (reach, cue, 1.0)
        behind = state if scope is None else max(0, state - 1)
        made.rest[state] = behind
        if state:
            for symbol in accepted:
                made.arcs[state, symbol] = (behind, symbol + mark, factor)
    return made


def composed(first: Transducer, then: Transducer, symbols: list[str]) -> Transducer:
    """One transducer that does what both do in turn, with only the states that can be reached."""
    number = {(first.start, then.start): 0}
    left, made = [(first.start, then.start)], Transducer()
    while left:
        pair = left.pop()
        for symbol in symbols:
            a, between, x = first.step(pair[0], symbol)
            b, out, y = then.step(pair[1], between)
            if (a, b) not in number:
                number[a, b] = len(number)
                left.append((a, b))
            made.arcs[number[pair], symbol] = (number[a, b], out, x * y)
    return made


SYMBOLS = ["other", "insult", "threat", "target", "negation", "report"]


@functools.cache
def grammar() -> Transducer:
    """Negation, reported speech and target in one machine."""
    plain = ["insult", "threat"]
    once = plain + [s + "-" for s in plain]
    twice = once + [s + '"' for s in once]
    negation = marker("negation", plain, "-", NEGATED, SCOPE)
    report = marker("report", once, '"', REPORTED, None)
    target = marker("target", twice, ">", TARGETED, SCOPE)
    return composed(composed(negation, report, SYMBOLS), target, SYMBOLS)


# Lexicon and model.


@dataclass
class Model:
    """The lexicon and the curve over a text's measures."""

    lexicon: dict[str, float] = field(default_factory=lambda: {
        word + WHOLE: GIVEN_WEIGHT for word in [*INSULTS, *THREATS]
    })
    curve: tuple[float, ...] = (-4.0, 0.0, 1.0, 1.0, 0.0, 1.0)  # the constant and a slope per measure

    @functools.cached_property
    def automaton(self):
        """All entries as one automaton over letters."""
        import ahocorasick

        made = ahocorasick.Automaton()
        for entry in self.lexicon:
            made.add_word(entry.removesuffix(WHOLE), entry.removesuffix(WHOLE))
        if len(made):
            made.make_automaton()
        return made

    @functools.cached_property
    def cues(self) -> dict[str, str]:
        kinds = {"target": TARGETS, "negation": NEGATIONS, "report": REPORTS}
        return {word: kind for kind, words in kinds.items() for word in words}

    def entry_of(self, word: str) -> str | None:
        """The longest entry that accepts a word."""
        if word + WHOLE in self.lexicon:
            return word + WHOLE
        for n in range(min(len(word), LONGEST), SHORTEST - 1, -1):
            if word[:n] in self.lexicon:
                return word[:n]
        return None

    def clauses(self, text: str | None) -> list[tuple[int, int, float, list[str]]]:
        """(start, end, score, entries) of the matched clauses of a text; places in the lower-case text."""
        low = (text or "").lower()
        if not len(self.automaton):
            return []
        # Where an entry begins a word; whole words are told apart when the clause is walked through.
        found = [
            end - len(entry) + 1 for end, entry in self.automaton.iter(low)
            if end < len(entry) or not low[end - len(entry)].isalnum()
        ]
        out, at = [], 0
        if not found:
            return out
        ends = [(m.start(), m.end()) for m in CLAUSE_END.finditer(low)] + [(len(low), len(low))]
        found.sort()
        begin = 0
        for stop, resume in ends:
            if at < len(found) and found[at] < stop:
                while at < len(found) and found[at] < stop:
                    at += 1
                score, entries = self.walked(low[begin:stop])
                if entries:
                    out.append((begin, stop, score, entries))
            begin = resume
            if at == len(found):
                break
        return out

    def walked(self, clause: str) -> tuple[float, list[str]]:
        """Score and accepted entries of a clause."""
        machine, state, score, entries = grammar(), grammar().start, 0.0, []
        for word in CLAUSE_WORD.findall(clause):
            entry, symbol = self.entry_of(word), self.cues.get(word, "other")
            if entry:
                symbol = "threat" if word in _THREATS else "insult"
            state, _, factor = machine.step(state, symbol)
            if entry:
                score += self.lexicon[entry] * factor
                entries.append(entry)
        return score, entries

    def measures(self, text: str | None) -> list[float]:
        """Measures of a text's matched clauses, all zero where there are none."""
        found = self.clauses(text)
        if not found:
            return [0.0] * (len(self.curve) - 1)
        total = sum(score for _, _, score, _ in found)
        words = 1 + text.count(" ") + text.count("\n")
        return [
            math.log1p(total), math.log1p(max(score for _, _, score, _ in found)),
            math.log1p(len(found)), math.log1p(100 * total / words),
            math.log1p(len({e for _, _, _, entries in found for e in entries})),
        ]

    def score(self, measures: list[float]) -> float:
        x = self.curve[0] + sum(a * b for a, b in zip(self.curve[1:], measures, strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


_THREATS = frozenset(THREATS)


# Learning.


def stems(text: str) -> set[str]:
    """All words of a text, and their beginnings."""
    words = set(CLAUSE_WORD.findall(text.lower()))
    out = {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST + 1))}
    return out | {w + WHOLE for w in words}


def min_hashes(column: pa.Array) -> np.ndarray:
    """Four min-hashes of each text's runs of five words; of all its words where there are fewer."""
    out = np.zeros((len(column), 4), dtype=np.uint64)
    turns = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93],
                     dtype=np.uint64)
    for row, words, begins in word_hashes(column, lower=True):
        for i, (a, b) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
            runs = window_hashes(words[a:b], min(5, int(b - a))) if b > a else words[:0]
            if len(runs):
                with np.errstate(over="ignore"):
                    out[row + i] = [(runs * t ^ (runs >> np.uint64(29))).min() for t in turns]
    return out


def labels_by_id(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic), each id once, toxic if one of its labels says so."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))


def sample(docs: DataFrame, labels: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """(doc_id, text, toxic, fold): about so many labelled texts of both kinds, each group of near copies
    once.

    Ids are chosen by the share of the hash range that holds the wanted number, before any text is read;
    the text of the chosen ones only is shuffled.
    """
    told = labels_by_id(labels).withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    counts = {r["toxic"]: r["count"] for r in told.groupBy("toxic").count().collect()}
    limits = {
        kind: int((1 << 40) * min(1.0, most / max(1, counts.get(kind, 0))))
        for kind, most in ((1, n_toxic), (0, n_clean))
    }
    chosen = told.filter(
        F.col("_h") < F.when(F.col("toxic") == 1, F.lit(limits[1])).otherwise(F.lit(limits[0]))
    )
    # About n_toxic + n_clean narrow rows, a bound that doesn't grow with the tables.
    narrow = F.broadcast(chosen.select(F.col("doc_id").alias("_id"), "toxic"))
    held = docs.filter("text IS NOT NULL").join(narrow, F.col("doc_id") == F.col("_id"))
    each = held.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = min_hashes(batch.column("text")).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(found[:, i].copy()) for i in range(4)]],
                [*batch.schema.names, "m0", "m1", "m2", "m3"],
            )

    hashes = "m0 long, m1 long, m2 long, m3 long"
    out = each.mapInArrow(hashed, f"doc_id long, toxic int, text string, {hashes}")
    for i in range(4):
        others = [F.col(c) for c in out.columns if c != f"m{i}"]
        out = out.groupBy(f"m{i}").agg(F.min_by(F.struct(*others), F.struct(F.xxhash64("doc_id"), "doc_id"))
                                  .alias("s"))
        out = out.select(f"m{i}", "s.*")
    return out.select("doc_id", "text", "toxic", F.pmod("m0", F.lit(3)).alias("fold"))


def evidence(n1: int, n0: int, total1: int, total0: int) -> float:
    """The log-likelihood ratio of n1 in total1 against n0 in total0."""
    def part(n: int, total: int, share: float) -> float:
        return sum(a * math.log(a / (total * s)) for a, s in ((n, share), (total - n, 1 - share)) if a and s)

    share = (n1 + n0) / (total1 + total0)
    return 2 * (part(n1, total1, share) + part(n0, total0, share))


def learned_lexicon(texts: DataFrame) -> dict[str, float]:
    """Entries whose texts are toxic far more often, the ones with the most evidence first; of entries that
    are one another's beginning only the better one.

    Tasks fold their own texts before the one shuffle of entries; only what may be an entry comes back.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held[toxic].update(stems(text.as_py()))
        names = list(held[0].keys() | held[1].keys())
        yield pa.RecordBatch.from_arrays([
            pa.array(names, pa.string()), pa.array([held[1][s] for s in names], pa.int64()),
            pa.array([held[0][s] for s in names], pa.int64()),
        ], ["stem", "n1", "n0"])

    totals = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    total1, total0 = totals.get(1, 0), totals.get(0, 0)
    if not total1 or not total0:
        return {}
    # A weight as below needs this many times the share of toxic texts.
    more = math.exp(LEAST_WEIGHT) * total1 / total0
    counted = texts.select("text", "toxic").mapInArrow(count, "stem string, n1 long, n0 long")
    sums = counted.groupBy("stem").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    likely = sums.filter((F.col("n1") >= LEAST_TEXTS) & (F.col("n1") + 0.5 >= more * F.col("n0")))
    rarely = F.desc(F.col("n1") / (F.col("n0") + 1.0))
    best = likely.orderBy(rarely, F.desc("n1"), "stem").limit(4 * MOST_ENTRIES)
    ranked = []
    for stem, n1, n0 in best.collect():
        weight = math.log((n1 + 0.5) / (total1 + 1)) - math.log((n0 + 0.5) / (total0 + 1))
        proof = evidence(n1, n0, total1, total0)
        if weight >= LEAST_WEIGHT and proof >= LEAST_EVIDENCE:
            # With equal evidence the longest entry says most exactly what was seen.
            ranked.append((-round(proof, 9), -len(stem), stem, weight))
    chosen: dict[str, float] = {}
    taken: set[str] = set()  # beginnings of what was chosen
    for _, _, stem, weight in sorted(ranked):
        plain = stem.removesuffix(WHOLE)
        covered = any(plain[:n] in chosen for n in range(SHORTEST, len(plain) + 1))
        if not covered and (stem.endswith(WHOLE) or plain not in taken) and len(chosen) < MOST_ENTRIES:
            chosen[stem] = weight
            taken |= {plain[:n] for n in range(1, len(plain) + 1)}
    return chosen


def fitted_curve(rows: np.ndarray, toxic: np.ndarray, penalty: float = 1.0) -> tuple[float, ...]:
    """The constant and the slopes of a logistic curve, slopes kept small and not below zero, by Newton's
    steps on those in use."""
    x = np.column_stack([np.ones(len(rows)), rows])
    used = np.ones(x.shape[1], dtype=bool)
    while True:
        w, held = np.zeros(used.sum()), x[:, used]
        keep = np.full(len(w), penalty)
        keep[0] = 1e-3
        for _ in range(50):
            chance = 1 / (1 + np.exp(-np.clip(held @ w, -30, 30)))
            gradient = held.T @ (chance - toxic) + keep * w
            curvature = (held * (chance * (1 - chance))[:, None]).T @ held + np.diag(keep)
            step = np.linalg.solve(curvature, gradient)
            w = w - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        if (w[1:] >= 0).all():
            break
        at = np.flatnonzero(used)
        used[at[1 + int(np.argmin(w[1:]))]] = False
    out = np.zeros(x.shape[1])
    out[used] = w
    return tuple(float(v) for v in out)


def train(docs: DataFrame, labels: DataFrame, n_toxic: int = SAMPLE_TOXIC,
          n_clean: int = SAMPLE_CLEAN) -> Model:
    """A model from the labelled ones of `docs`; `labels` holds doc_id and toxic."""
    model = Model()
    with settled(sample(docs.select("doc_id", "text"), labels, n_toxic, n_clean), "sample") as held:
        found = learned_lexicon(held.filter("fold <> 0"))
        if not found:
            return model
        # Given words that the sample knows and doesn't hold against a text were not learned: they go.
        known = held.filter("fold <> 0").select("text")
        absent = _unseen(known, [e for e in model.lexicon if e not in found])
        lexicon = {e: GIVEN_WEIGHT for e in absent} | found
        judged = Model(lexicon, model.curve)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [judged.measures(t.as_py()) for t in batch.column(0)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"]
                )

        # About a third of the sample, a few numbers each.
        told = held.filter("fold = 0").select("text", "toxic").mapInArrow(
            measure, "toxic int, x array<double>").toArrow()
    toxic = told.column("toxic").to_numpy()
    if not len(toxic) or toxic.all() or not toxic.any():
        return judged
    return Model(lexicon, fitted_curve(np.array(told.column("x").to_pylist()), toxic.astype(float)))


def _unseen(texts: DataFrame, entries: list[str]) -> list[str]:
    """The entries that are a word of none of the texts."""
    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, met = set(entries), set()
        for batch in batches:
            for text in batch.column(0):
                met |= {w + WHOLE for w in CLAUSE_WORD.findall(text.as_py().lower())} & asked
        yield pa.RecordBatch.from_arrays([pa.array(sorted(met), pa.string())], ["entry"])

    met = {r["entry"] for r in texts.mapInArrow(seen, "entry string").distinct().collect()}
    return [e for e in entries if e not in met]


# Scoring.

SCORED = "score double, n_clauses long, strongest double"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, the number of matched clauses and the score of the strongest one, for each row."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.curve))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shipped.value)
        for batch in batches:
            rows = [own.measures(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([own.score(r) for r in rows], pa.float64()),
                pa.array([round(math.expm1(r[2])) for r in rows], pa.int64()),
                pa.array([math.expm1(r[1]) for r in rows], pa.float64()),
            ], ["doc_id", "score", "n_clauses", "strongest"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, f"doc_id long, {SCORED}")


def matched_clauses(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, score, entries): every matched clause, places in the lower-case text."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.curve))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shipped.value)
        for batch in batches:
            listed = [own.clauses(t.as_py()) for t in batch.column("text")]
            at = np.repeat(np.arange(len(listed)), [len(found) for found in listed])
            flat = [clause for found in listed for clause in found]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(at, pa.int64())),
                pa.array([c[0] for c in flat], pa.int64()), pa.array([c[1] for c in flat], pa.int64()),
                pa.array([c[2] for c in flat], pa.float64()),
                pa.array([c[3] for c in flat], pa.list_(pa.string())),
            ], ["doc_id", "start", "end", "score", "entries"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        find, "doc_id long, start long, end long, score double, entries array<string>"
    )


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are for judging the model only."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
