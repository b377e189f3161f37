"""From a feature table to routed models, validation metrics and test scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import dataset, metrics, models


@dataclass
class Outcome:
    """Models; average precision over labelled validation rows by segment and over all (key None); scores of the test part."""

    routed: models.Routed
    precision: dict[int | None, float]
    submission: DataFrame


def train_baseline(features: DataFrame, labels: DataFrame, cutoff: str, end: str, **options) -> Outcome:
    """Split by time, train the training rows of each segment, evaluate on labelled validation rows, score the test rows.

    Rows with is_train = 0 are history only before `end`; the test part keeps all.  Unlabelled rows train as negatives.  Validation rows
    whose segment has no model have no score and don't count; test rows without one get 0.
    """
    df = dataset.with_labels(features, labels).withColumn("split", dataset.split_of(cutoff, end)).filter("split = 'test' OR is_train = 1").persist()
    dataset.check_splits(dataset.split_counts(df))
    columns = dataset.feature_columns(df.drop("split").schema)
    train, val, test = (df.filter(F.col("split") == part) for part in ("train", "val", "test"))
    known = val.filter("is_labeled = 1")
    routed = models.fit_routed(train, known, columns, **options)
    scored = routed.score(known, unrouted=None).select("model_group", "target", "score").persist()
    precision: dict[int | None, float] = {g: metrics.average_precision(scored.filter(F.col("model_group") == g)).first()[0] for g in routed.ensembles}
    precision[None] = metrics.average_precision(scored).first()[0]
    scored.unpersist()
    return Outcome(routed, precision, routed.score(test).select("event_id", F.col("score").alias("predict")))
