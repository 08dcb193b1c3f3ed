"""Model features: defaults, codes, text weights, one-hot, scaling and class weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml import feature as mlf
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.functions import labels
from callsift.functions.text import WORD_CLASS
from callsift.plans.sizing import lookup_side
from callsift.session import settled

VOCABULARY = 300
SUMMARY_ROOM = 50_000
MOST_VALUES = 10_000
# The columns that the two models use.
ISSUE_NUMBERS = (
    "total_duration_sec", "agent_word_count", "customer_word_count", "talk_ratio",
    "overall_score", "hold_count", "hold_seconds", "in_queue_seconds",
)
RESOLUTION_NUMBERS = (
    "total_duration_sec", "agent_seconds", "acw_seconds", "in_queue_seconds", "hold_seconds",
    "hold_count", "agent_word_count", "customer_word_count", "talk_ratio", "overall_score",
    "sentiment_agent_num", "sentiment_customer_num", "sla_met", "issue_num", "is_abandoned",
    "is_outbound",
)


def default_fill(training: DataFrame) -> DataFrame:
    """Text null -> "", campaign null -> "Unknown", numbers of the issue model null -> 0."""
    present = [c for c in ISSUE_NUMBERS if c in training.columns]
    return training.fillna({"customer_text": "", "agent_text": "", "campaign_name": "Unknown"}).fillna(
        0, subset=present
    )


def not_abandoned(call_summary: DataFrame) -> DataFrame:
    """Rows whose resolution is not "Abandoned"; an unknown resolution stays."""
    return call_summary.filter(~F.col("resolution").eqNullSafe("Abandoned"))


def encode_sentiment(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "sentiment_agent_num": labels.sentiment_code(F.col("sentiment_agent")),
        "sentiment_customer_num": labels.sentiment_code(F.col("sentiment_customer")),
    })


def encode_issue(df: DataFrame) -> DataFrame:
    return df.withColumn("issue_num", labels.issue_code(F.col("issue_category")))


def encode_sla(df: DataFrame) -> DataFrame:
    return df.withColumn("sla_met", labels.sla_code(F.col("service_level_flag")))


def issue_frame(training: DataFrame) -> DataFrame:
    """Input of the issue model for every call: one text column and filled numbers."""
    filled = default_fill(training)
    both = F.concat("customer_text", F.lit(" "), "agent_text")
    return filled.withColumn("combined_text", both)


def resolution_frame(training: DataFrame) -> DataFrame:
    """Input of the resolution model: 16 numbers per call that was not abandoned, also where the
    resolution is not known yet."""
    coded = encode_sla(encode_issue(encode_sentiment(not_abandoned(training))))
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in RESOLUTION_NUMBERS]
    return coded.select("contact_id", "resolution", *numbers)


class SublinearTf(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable,
                  DefaultParamsWritable):
    """Term counts to 1 + ln(count); zero stays zero."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        damped = F.transform(
            vector_to_array(self.getInputCol()),
            lambda n: F.when(n > 0, 1 + F.log(n)).otherwise(F.lit(0.0)),
        )
        return df.withColumn(self.getOutputCol(), array_to_vector(damped))


class TokenGrams(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable,
                 DefaultParamsWritable):
    """Words followed by their adjacent pairs."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        words = F.col(self.getInputCol())
        after = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
        before = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
        pairs = F.zip_with(before, after, lambda a, b: F.concat(a, F.lit(" "), b))
        return df.withColumn(self.getOutputCol(), F.concat(words, pairs))


class Summary:
    """Counts of the most frequent terms of a stream in bounded room.

    When more than `room` terms are held, the count of the first that has no place is taken from all, which
    leaves at most `room`. So a term's true count is its count here, or more by at most `lost`.
    """

    def __init__(self, room: int):
        self.room, self.lost = room, 0
        self.counts: dict[str, int] = {}

    def add(self, terms: pa.Array) -> None:
        found = terms.value_counts()
        for term, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True):
            if term is not None:
                self.counts[term] = self.counts.get(term, 0) + n
        if len(self.counts) > self.room:
            least = sorted(self.counts.values(), reverse=True)[self.room]
            self.counts = {t: n - least for t, n in self.counts.items() if n > least}
            self.lost += least


def summarised(lists: DataFrame, room: int) -> DataFrame:
    """(term, n) of every task's summary of a column of term lists, and per task a row without a term that
    says how much a count may be short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Summary(room)
        for batch in batches:
            held.add(batch.column(0).flatten())
        terms, counts = [None, *held.counts], [held.lost, *held.counts.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["term", "n"])

    return lists.mapInArrow(run, "term string, n long")


def frequent_terms(lists: DataFrame, size: int, room: int = SUMMARY_ROOM) -> list[str]:
    """The `size` most frequent terms of a column of term lists, equally frequent ones in alphabetical order.

    Tasks send a summary of `room` terms each instead of all their terms. The sums rule out every term that
    can't be among the first `size`; what is left is counted again exactly, unless no summary lost anything.
    Where a term that no summary holds might still be among them, the room is widened.
    """
    while True:
        with settled(summarised(lists, room).groupBy("term").agg(F.sum("n").alias("n")), "terms") as sums:
            lost = sums.filter("term IS NULL").agg(F.sum("n")).first()[0] or 0
            known = sums.filter("term IS NOT NULL")
            first = known.orderBy(F.desc("n"), "term").limit(size).collect()
            if not lost:
                return [r["term"] for r in first]
            least = first[-1]["n"] if len(first) == size else 0
            if lost >= least:
                room *= 4
                continue
            # At most the first `size` and those within `lost` of the last of them.
            likely = [r["term"] for r in known.filter(F.col("n") + lost >= least).select("term").collect()]
        break
    wanted = lists.sparkSession.sparkContext.broadcast(likely)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(wanted.value, pa.string())
        held = np.zeros(len(asked) + 1, dtype=np.int64)
        for batch in batches:
            at = pc.index_in(batch.column(0).flatten(), value_set=asked).fill_null(len(asked))
            held += np.bincount(at.to_numpy(zero_copy_only=False), minlength=len(held))
        yield pa.RecordBatch.from_arrays([asked, pa.array(held[:-1])], ["term", "n"])

    counts = lists.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return [r["term"] for r in counts.orderBy(F.desc("n"), "term").limit(size).collect()]


class FrequentTerms(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable,
                    DefaultParamsWritable):
    """Counts of the most frequent terms, equally frequent ones in alphabetical order; see
    `frequent_terms`."""

    size = Param(Params._dummy(), "size", "terms to keep", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, size=VOCABULARY):
        super().__init__()
        self._setDefault(size=VOCABULARY)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> mlf.CountVectorizerModel:
        terms = F.coalesce(F.col(self.getInputCol()), F.array().cast("array<string>"))
        best = frequent_terms(df.select(terms.alias("terms")), self.getOrDefault(self.size))
        return mlf.CountVectorizerModel.from_vocabulary(best, self.getInputCol(), self.getOutputCol())


class AddVectors(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable,
                 DefaultParamsWritable):
    """The sum of two vector columns."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        left, right = (vector_to_array(c) for c in self.getInputCols())
        total = F.zip_with(left, right, lambda a, b: a + b)
        return df.withColumn(self.getOutputCol(), array_to_vector(total))


class KnownSize(Estimator, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Note the size of a vector column, which is lost on the way through arrays, so that assembling
    it needs no look at the rows and works on an empty batch."""

    @keyword_only
    def __init__(self, *, inputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> mlf.VectorSizeHint:
        row = df.select(F.size(vector_to_array(self.getInputCol()))).first()
        return mlf.VectorSizeHint(
            inputCol=self.getInputCol(), size=row[0] if row else 0, handleInvalid="optimistic"
        )


class MomentScaler(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Each column as `<name>_scaled`: shifted by a mean and divided by a spread found in fitting."""

    means = Param(Params._dummy(), "means", "per column", TypeConverters.toListFloat)
    spreads = Param(Params._dummy(), "spreads", "per column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, means=None, spreads=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        moments = zip(self.getInputCols(), self.getOrDefault(self.means),
                      self.getOrDefault(self.spreads), strict=True)
        return df.withColumns({
            f"{c}_scaled": (F.col(c).cast("double") - F.lit(mean)) / F.lit(spread)
            for c, mean, spread in moments
        })


class PopulationScaler(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Columns to zero mean and unit population deviation; a constant column becomes zero.

    Two numbers per column reach the driver, whatever the number of rows.
    """

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> MomentScaler:
        columns = self.getInputCols()
        row = df.agg(
            *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in columns],
        ).first()
        means = [row[f"m_{c}"] or 0.0 for c in columns]
        # Rounding leaves a constant column a spread of some last digits.
        spreads = [row[f"s_{c}"] or 0.0 for c in columns]
        usable = [s if s > 1e-12 * abs(m) else 1.0 for s, m in zip(spreads, means, strict=True)]
        return MomentScaler(inputCols=columns, means=means, spreads=usable)


class ValueNumbers(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable,
                   DefaultParamsWritable):
    """Numbers of a text column's values in alphabetical order.

    At most MOST_VALUES values are taken to the driver; a column with more is no category, and fitting says
    so instead.
    """

    invalid = Param(Params._dummy(), "invalid", "what becomes of unseen values", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, invalid="keep"):
        super().__init__()
        self._setDefault(invalid="keep")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> mlf.StringIndexerModel:
        name = self.getInputCol()
        values = df.select(F.col(name).alias("v")).filter("v IS NOT NULL").distinct()
        first = [r["v"] for r in values.orderBy("v").limit(MOST_VALUES + 1).collect()]
        if len(first) > MOST_VALUES:
            raise ValueError(f"{name} has more than {MOST_VALUES} different values")
        return mlf.StringIndexerModel.from_labels(
            first, name, self.getOutputCol(), handleInvalid=self.getOrDefault(self.invalid)
        )


def text_stages(text_col: str = "combined_text", vocabulary: int = VOCABULARY,
                stop_words: list[str] | None = None) -> list:
    """tf-idf of words and word pairs: most frequent terms, 1 + ln tf, smooth idf, unit length."""
    remover = mlf.StopWordsRemover(inputCol="words", outputCol="kept")
    if stop_words is not None:
        remover = remover.setStopWords(stop_words)
    return [
        mlf.RegexTokenizer(
            inputCol=text_col, outputCol="words", gaps=False, pattern=f"[{WORD_CLASS}]{{2,}}"
        ),
        remover,
        TokenGrams(inputCol="kept", outputCol="grams"),
        FrequentTerms(inputCol="grams", outputCol="counts", size=vocabulary),
        SublinearTf(inputCol="counts", outputCol="tf"),
        # Spark's idf is ln((1 + N) / (1 + df)); adding tf itself makes it that plus one.
        mlf.IDF(inputCol="tf", outputCol="tf_idf"),
        AddVectors(inputCols=["tf", "tf_idf"], outputCol="weighted"),
        mlf.Normalizer(inputCol="weighted", outputCol="text_vec", p=2.0),
    ]


def onehot_stages(col: str = "campaign_name") -> list:
    """One-hot in alphabetical order; an unseen category is all zero."""
    return [
        ValueNumbers(inputCol=col, outputCol=f"{col}_no", invalid="keep"),
        mlf.OneHotEncoder(inputCol=f"{col}_no", outputCol=f"{col}_vec", dropLast=True),
    ]


def label_stage(col: str, to: str = "label") -> ValueNumbers:
    """Alphabetical label numbers."""
    return ValueNumbers(inputCol=col, outputCol=to, invalid="skip")


def feature_pipeline(kind: str) -> Pipeline:
    """The unfitted feature stages of the "issue" or the "resolution" model."""
    if kind == "issue":
        parts = ["text_vec", *ISSUE_NUMBERS, "campaign_name_vec"]
        gathered = mlf.VectorAssembler(inputCols=parts, outputCol="features")
        sized = KnownSize(inputCol="text_vec")
        return Pipeline(stages=[*text_stages(), sized, *onehot_stages(), gathered])
    scaled = PopulationScaler(inputCols=list(RESOLUTION_NUMBERS))
    names = [f"{c}_scaled" for c in RESOLUTION_NUMBERS]
    gathered = mlf.VectorAssembler(inputCols=names, outputCol="features")
    return Pipeline(stages=[scaled, gathered])


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with the columns as the resolution model scales them."""
    scaled = PopulationScaler(inputCols=columns).fit(df).transform(df)
    return scaled.select(*[
        F.col(f"{c}_scaled").alias(c) if c in columns else F.col(c) for c in df.columns
    ])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, class_weight): n / (classes * rows of the class)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.struct(F.sum("_n").alias("n"), F.count("*").alias("k"))).scalar()
    weight: Column = totals["n"] / (totals["k"] * F.col("_n"))
    return counts.select(label, weight.cast("double").alias("class_weight"))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Rows with a known label and the weight of their class. The few classes are broadcast once
    a capped read has shown that they are few, so the rows of a hot class stay spread out."""
    return df.join(lookup_side(class_weights(df, label)), label)

