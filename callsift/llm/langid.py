"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are folded to lower case, everything but letters becomes one boundary sign, and all runs of 1
to 3 signs are hashed into a fixed number of buckets. Document frequencies come from every training
row. The regression is trained with the follow-the-regularised-leader rule (per-coordinate steps,
L1 and L2 penalty) on a bounded sample of labelled rows, and a temperature fitted on rows it has not
seen turns its scores into probabilities. Prediction reads whole texts, a slice at a time.

Defined results: a text that is null or without a letter is `und` with score 0; rows without label
are never learned from; without any labelled row every text is `und`; repeated rows are predicted
each. Columns named lang_pred or score are replaced; other columns pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
BUCKETS = 1 << 15
ORDERS = 3
SLICE = 1 << 20
PER_LABEL = 600
MOST_ROWS = 4000
SAMPLE_GROUPS = 50
EPOCHS = 4


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    before = np.zeros(1, dtype=np.uint32)
    letters = _letters()
    for at in range(0, len(text), SLICE):
        codes = np.frombuffer(
            text[at : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32
        )
        codes = np.where(letters[codes], codes, np.uint32(0))
        kept = codes > 0
        kept[1:] |= codes[:-1] > 0
        kept[0] |= before[-1] > 0
        codes = codes[kept]
        if at + SLICE >= len(text) and len(codes) and codes[-1]:
            codes = np.append(codes, np.uint32(0))
        for order in range(1, ORDERS + 1):
            joined = np.concatenate([before[len(before) - min(len(before), order - 1) :], codes])
            n = len(joined) - order + 1
            if n <= 0:
                continue
            hashed = np.full(n, order, dtype=np.uint32)
            for i in range(order):
                hashed = (hashed ^ joined[i : i + n]) * np.uint32(0x85EBCA6B)
                hashed ^= hashed >> np.uint32(13)
            counts += np.bincount(hashed % np.uint32(BUCKETS), minlength=BUCKETS)
        before = np.concatenate([before, codes])[-(ORDERS - 1) :]
    return counts


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the damped counts in them."""
    counts = gram_counts(text)
    held = np.flatnonzero(counts)
    return held, 1 + np.log(counts[held])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """For each bucket the number of texts with it, and the number of texts. All rows are counted;
    a task sends at most one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(BUCKETS + 1, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if has_letter(value := text.as_py()):
                    seen[:BUCKETS] += gram_counts(value) > 0
                    rows += 1
        seen[BUCKETS] = rows
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held])], ["bucket", "n"])

    totals = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket")
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for bucket, n in totals.agg(F.sum("n")).collect():
        out[bucket] = n
    return out[:BUCKETS], int(out[BUCKETS])


def sampled(labelled: DataFrame, per_label: int, most: int) -> DataFrame:
    """At most `most` (text, label) rows, by turns from each label; of a label about `per_label`, the ones
    with the smallest hashes in each of SAMPLE_GROUPS groups.

    Rows with the same label and hash are one, and ranks are taken over hashes alone. As each group is cut by
    itself, a label with most of the table sends no more than the others to the task that counts it.
    """
    hashed = F.xxhash64("doc_id", "text")
    group = F.pmod("h", F.lit(SAMPLE_GROUPS)).alias("g")
    keyed = labelled.select("label", hashed.alias("h")).distinct().select("label", "h", group)
    within = F.row_number().over(Window.partitionBy("label", "g").orderBy("h"))
    each = -(-per_label // SAMPLE_GROUPS)
    some = keyed.withColumn("_n", within).filter(F.col("_n") <= each).drop("_n")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    picks = some.withColumn("_n", rank)
    bounded = picks.orderBy("_n", "h", "label").limit(most).select("label", "h")
    hashed = labelled.withColumn("h", F.xxhash64("doc_id", "text"))
    found = hashed.join(F.broadcast(bounded), ["label", "h"])
    return found.groupBy("label", "h").agg(F.min("text").alias("text"))


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS + 1 rows, the last for the constant; one column per label
    temperature: float = 1.0

    def vector(self, held: np.ndarray, damped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF values and the constant."""
        values = (damped * self.idf[held]).astype(np.float32)
        values /= max(float(np.sqrt((values * values).sum())), 1e-12)
        return np.append(held, BUCKETS).astype(np.int32), np.append(values, np.float32(1))

    def logits(self, held: np.ndarray, damped: np.ndarray) -> np.ndarray:
        at, values = self.vector(held, damped)
        return (values @ self.weights[at]).astype(float)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not has_letter(text):
            return UNKNOWN, 0.0
        chances = softmax(self.logits(*features(text)) / self.temperature)
        best = int(chances.argmax())
        return self.labels[best], float(min(1.0, chances[best]))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], n_labels: int, alpha: float = 0.5,
                  beta: float = 1.0, l1: float = 0.05, l2: float = 0.05,
                  epochs: int = EPOCHS) -> np.ndarray:
    """Weights by the follow-the-regularised-leader rule over (buckets, values, label) rows."""
    z = np.zeros((BUCKETS + 1, n_labels))
    squares = np.zeros((BUCKETS + 1, n_labels))

    def weights(z: np.ndarray, squares: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * l1 - z
        return np.where(np.abs(z) <= l1, 0.0, shrunk / ((beta + np.sqrt(squares)) / alpha + l2))

    order = np.random.Generator(np.random.PCG64(3))
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, values, label = rows[i]
            own, past = z[at], squares[at]
            w = weights(own, past)
            error = softmax(values @ w)
            error[label] -= 1
            gradient = values[:, None] * error[None, :]
            grown = past + gradient * gradient
            z[at] = own + gradient - (np.sqrt(grown) - np.sqrt(past)) / alpha * w
            squares[at] = grown
    return weights(z, squares)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    def loss(log_t: float) -> float:
        scaled = logits / np.exp(log_t)
        scaled = scaled - scaled.max(axis=1, keepdims=True)
        return float((np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(len(labels)), labels]).mean())

    low, high, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(labelled: DataFrame, per_label: int = PER_LABEL, most: int = MOST_ROWS) -> Model:
    """A model from (doc_id, text, label) rows; document frequencies from all of them, weights from at
    most `most` rows, of which a fifth only sets the temperature."""
    usable = labelled.filter(F.col("label").isNotNull() & F.col("text").isNotNull())
    frequencies, n = document_frequencies(usable)
    idf = np.log((1 + n) / (1 + frequencies)) + 1

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [i for i, t in enumerate(batch.column("text")) if has_letter(t.as_py())]
            found = [features(batch.column("text")[i].as_py()) for i in kept]
            yield pa.RecordBatch.from_arrays([
                batch.column("label").take(pa.array(kept, pa.int64())),
                batch.column("h").take(pa.array(kept, pa.int64())),
                pa.array([f[0].astype("i4") for f in found], pa.list_(pa.int32())),
                pa.array([f[1].astype("f4") for f in found], pa.list_(pa.float32())),
            ], ["label", "h", "at", "damped"])

    kinds = "label string, h long, at array<int>, damped array<float>"
    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("h", "ascending"), ("label", "ascending")]).slice(0, most)
        labels = sorted(set(rows.column("label").to_pylist()))
        number = {label: i for i, label in enumerate(labels)}
        blank = Model(labels, idf, np.zeros((BUCKETS + 1, len(labels))))
        data = [
            (*blank.vector(at.values.to_numpy(), damped.values.to_numpy()), number[label.as_py()])
            for label, at, damped in zip(rows["label"], rows["at"], rows["damped"], strict=True)
        ]
        kept_out = [row for i, row in enumerate(data) if i % 5 == 4]
        learned = follow_leader([row for i, row in enumerate(data) if i % 5 != 4], len(labels))
        temperature = 1.0
        if kept_out:
            logits = np.array([values @ learned[at] for at, values, _ in kept_out])
            temperature = fit_temperature(logits, np.array([row[2] for row in kept_out]))
        at, of = np.nonzero(learned)
        return pa.table({
            "label": pa.array([*labels, *np.array(labels, dtype=object)[of]], pa.string()),
            "bucket": pa.array(np.append(np.full(len(labels), -1), at), pa.int32()),
            "weight": pa.array(np.append(np.full(len(labels), temperature), learned[at, of]), pa.float64()),
        })

    # One task gets the bounded sample; the driver only the weights that are not zero.
    rows = sampled(usable, per_label, most).mapInArrow(extract, kinds)
    fitted = rows.groupBy(F.lit(0).alias("all")).applyInArrow(
        fit, "label string, bucket int, weight double"
    ).toArrow()
    bucket, weight = fitted.column("bucket").to_numpy(), fitted.column("weight").to_numpy()
    names = np.array(fitted.column("label").to_pylist(), dtype=object)
    labels = sorted(names[bucket < 0].tolist())
    model = Model(labels, idf.astype(np.float32), np.zeros((BUCKETS + 1, len(labels)), np.float32))
    if labels:
        model.temperature = float(weight[bucket < 0][0])
        model.weights[bucket[bucket >= 0], np.searchsorted(labels, names[bucket >= 0].astype(str))] = (
            weight[bucket >= 0])
    return model


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score, from the text alone."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights per label

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(
                [shipped.value.predict(t) for t in texts], columns=["lang_pred", "score"]
            )

    judged = docs.withColumn("_language", predict("text"))
    return judged.withColumns({
        "lang_pred": F.col("_language.lang_pred"), "score": F.col("_language.score")
    }).drop("_language")


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from; a null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
