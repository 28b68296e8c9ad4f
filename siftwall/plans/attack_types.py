"""Multiclass classifier of attack types over per-IP features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AttackTypeConfig
from ..operators.features import BASE_FEATURES, align_features
from ..operators.ranks import class_sample, hash_split
from ..session import stage
from .supervised import classifier_report


@dataclass(frozen=True)
class AttackTypeTraining:
    model: PipelineModel
    accuracy: float
    report: DataFrame
    dropped_rows: int


def rare_class_filter(labeled: DataFrame, min_rows: int = 2) -> DataFrame:
    """Rows whose class has at least ``min_rows`` rows."""
    common = (
        labeled.groupBy("label")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_rows)
        .select("label")
    )
    return labeled.join(common, "label", "left_semi")


def train_attack_classifier(
    labeled: DataFrame, config: AttackTypeConfig | None = None
) -> AttackTypeTraining:
    """Fit on features with string labels; accuracy on the held-out part (M9).

    What is fitted is bounded by ``max_training_rows``, rows count alike; all rows held out are
    tested.
    """
    config = config or AttackTypeConfig()
    columns = list(BASE_FEATURES)
    kept = rare_class_filter(labeled, config.min_class_rows)
    rows = align_features(kept, columns, keep=("label",))
    split = stage(hash_split(rows, "label", "ip", config.train_fraction, config.seed), "split")
    index = StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc")
    names = index.fit(split)
    pipeline = Pipeline(
        stages=[
            names,
            VectorAssembler(inputCols=columns, outputCol="features"),
            RandomForestClassifier(
                featuresCol="features",
                labelCol="target",
                numTrees=config.trees,
                maxDepth=config.max_depth,
                maxBins=config.max_bins,
                seed=config.seed,
            ),
            IndexToString(inputCol="prediction", outputCol="predicted", labels=names.labels),
        ]
    )
    train = split.where("is_train")
    model = pipeline.fit(
        class_sample(train, "label", "ip", config.max_training_rows, config.seed)
    )
    tested = model.transform(split.where(~F.col("is_train")))
    accuracy = MulticlassClassificationEvaluator(
        labelCol="target", predictionCol="prediction", metricName="accuracy"
    ).evaluate(tested)
    report = classifier_report(tested.select("label", F.col("predicted").alias("prediction")))
    dropped = labeled.count() - split.count()
    return AttackTypeTraining(model, accuracy, report, dropped)
