"""Training, saving and applying the issue and resolution models with Spark ML."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsift.operators import features as ft
from callsift.operators.boosting import MulticlassBoosting
from callsift.session import settled
from callsift.sources import sinks

MAX_ITERATIONS = 1000
INVERSE_PENALTY = 1.0
TREES, DEPTH, RATE = 100, 3, 0.1


def _fitted(stages: list, frame: DataFrame, label: str, to: str) -> PipelineModel:
    """Fit stages on the rows with a known label, and name the predicted label at the end.

    Label numbers are needed for fitting only. They are no part of the model, so calls without a
    label, or with one not seen before, are predicted like all others.
    """
    indexer = ft.label_stage(label).fit(frame)
    fitted = Pipeline(stages=stages).fit(indexer.transform(frame))
    back = IndexToString(inputCol="prediction", outputCol=to, labels=indexer.labels)
    return PipelineModel([*fitted.stages, back])


def labels_of(model: PipelineModel) -> list[str]:
    """The labels a model knows, in the order of their numbers."""
    return list(model.stages[-1].getLabels())


def train_issue(training: DataFrame, max_iter: int = MAX_ITERATIONS) -> PipelineModel:
    """Balanced multinomial logistic regression on text, numbers and campaign.

    The columns it needs are written out once: counting classes and terms read those instead of repeating
    the joins, and every later pass reads the counts of the kept terms. Both are removed once the model is
    fitted.
    """
    needed = ["issue_category", "combined_text", "campaign_name", *ft.ISSUE_NUMBERS]
    known = ft.issue_frame(training.filter("issue_category IS NOT NULL")).select(*needed)
    with settled(known, "issue") as frame:
        rows = frame.count()
        # The penalty of the summed loss, restated for Spark's mean loss; balanced weights sum to rows.
        classifier = LogisticRegression(
            featuresCol="features", labelCol="label", weightCol="class_weight", maxIter=max_iter,
            regParam=1.0 / (INVERSE_PENALTY * max(rows, 1)), standardization=False,
            family="multinomial",
        )
        stages = [*ft.feature_pipeline("issue").getStages(), classifier]
        weighted = ft.balanced_weights(frame, "issue_category")
        # Weights and coefficients are fitted on the stored term counts; texts are not taken apart again.
        at = 1 + next(i for i, stage in enumerate(stages) if isinstance(stage, ft.FrequentTerms))
        counter = Pipeline(stages=stages[:at]).fit(weighted)
        wanted = ["issue_category", "class_weight", "counts", "campaign_name", *ft.ISSUE_NUMBERS]
        with settled(counter.transform(weighted).select(*wanted), "counts") as counted:
            rest = _fitted(stages[at:], counted, "issue_category", "predicted")
        return PipelineModel([*counter.stages, *rest.stages])


def train_resolution(training: DataFrame, trees: int = TREES) -> PipelineModel:
    """Boosted trees, one per resolution class and round, on shared residuals."""
    known = ft.resolution_frame(training.filter("resolution IS NOT NULL"))
    with settled(known, "resolution") as frame:
        classifier = MulticlassBoosting(rounds=trees, depth=DEPTH, rate=RATE)
        stages = [*ft.feature_pipeline("resolution").getStages(), classifier]
        return _fitted(stages, frame, "resolution", "predicted")


def _confidence(df: DataFrame):
    """The largest class probability as whole percent."""
    return F.round(F.array_max(vector_to_array("probability")) * 100, 0).cast("int")


def predict(model: PipelineModel, frame: DataFrame, actual: str, *keep: str) -> DataFrame:
    """(contact_id, actual, predicted, correct, confidence) for each row of a model frame, and the
    columns to keep. `correct` is null where the actual label is not known."""
    scored = model.transform(frame)
    return scored.select(
        "contact_id",
        F.col(actual).alias("actual"),
        "predicted",
        (F.col(actual) == F.col("predicted")).alias("correct"),
        F.concat(_confidence(scored).cast("string"), F.lit("%")).alias("confidence"),
        *keep,
    )


def predict_issue(model: PipelineModel, training: DataFrame) -> DataFrame:
    """The issue predictions as exported."""
    return predict(model, ft.issue_frame(training), "issue_category")


def predict_resolution(model: PipelineModel, training: DataFrame) -> DataFrame:
    """The resolution predictions as exported."""
    told = predict(model, ft.resolution_frame(training), "resolution", "overall_score")
    return told.withColumnsRenamed(
        {"actual": "actual_resolution", "predicted": "predicted_resolution"}
    )


def with_predictions(call_summary: DataFrame, issues: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The summary table with `pred_issue_category` and `pred_resolution` from the two prediction
    frames; a call that has no new prediction keeps the one it had."""
    sides = {
        "pred_issue_category": issues.select("contact_id", F.col("predicted").alias("_issue")),
        "pred_resolution": resolutions.select(
            "contact_id", F.col("predicted_resolution").alias("_resolution")),
    }
    out = call_summary
    for name, side in sides.items():
        fresh = [c for c in side.columns if c != "contact_id"][0]
        one = side.groupBy("contact_id").agg(F.max(fresh).alias(fresh))
        old = F.col(name) if name in out.columns else F.lit(None).cast("string")
        out = out.join(one, "contact_id", "left").withColumn(name, F.coalesce(fresh, old)).drop(fresh)
    return out


def model_meta(model: PipelineModel, training: DataFrame, label: str, **more) -> dict:
    """What is stored beside a model: its labels in order, its columns and the rows it learned from."""
    columns = [*ft.ISSUE_NUMBERS, "campaign_name", "combined_text"] if label == "issue_category" else (
        list(ft.RESOLUTION_NUMBERS))
    frame = training if label == "issue_category" else ft.not_abandoned(training)
    trained = frame.filter(F.col(label).isNotNull()).count()
    return {"labels": labels_of(model), "columns": columns, "trained_on": trained, "target": label, **more}


def save(model: PipelineModel, path: str, meta: dict) -> int:
    """Store the model as the next version below `path`, and one JSON row about it, see `model_meta`; its
    labels are always stored. The row is written last and makes the version count, so a run that fails
    before leaves the last complete version in place. Returns the version."""
    spark = SparkSession.getActiveSession()
    version = 1 + max(sinks.versions(spark, f"{path}/meta"), default=0)
    model.write().overwrite().save(f"{path}/model/{sinks.VERSION_PREFIX}{version}")
    row = [(json.dumps({"labels": labels_of(model), **meta}, sort_keys=True),)]
    told = spark.createDataFrame(row, "meta string")
    told.write.mode("overwrite").text(f"{path}/meta/{sinks.VERSION_PREFIX}{version}")
    return version


def load(spark, path: str) -> tuple[PipelineModel, dict]:
    """The newest complete version of a model and what is stored about it."""
    version = max(sinks.versions(spark, f"{path}/meta"))
    row = spark.read.text(f"{path}/meta/{sinks.VERSION_PREFIX}{version}").first()
    return PipelineModel.load(f"{path}/model/{sinks.VERSION_PREFIX}{version}"), json.loads(row[0])
