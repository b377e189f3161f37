"""Ranking metrics as aggregates over (target, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import score_levels, with_before

PERCENTILES = (0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


def _points(scored: DataFrame) -> DataFrame:
    """Each distinct score with positives and rows, those with smaller scores before it and those of all.  Null and NaN scores are left out."""
    known = scored.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    points = known.groupBy("score").agg(F.sum("target").alias("pos"), F.count(F.lit(1)).alias("n"))
    levels = score_levels()
    return with_before(points.withColumns(levels), [*levels, "score"], ["pos", "n"])


def thresholds(scored: DataFrame) -> DataFrame:
    """For each distinct score: true and false positives when everything from it upwards is predicted positive.  Null and NaN scores are left out."""
    df = _points(scored).withColumn("tp", F.col("_all_pos") - F.col("_before_pos"))
    return df.select("score", "pos", "n", "tp", (F.col("_all_n") - F.col("_before_n") - F.col("tp")).alias("fp"), F.col("_all_pos").alias("positives"))


def average_precision(scored: DataFrame) -> DataFrame:
    """One row: the step-wise average precision (not the trapezoid); 0 without positives."""
    part = (F.col("pos") / F.nullif("positives", F.lit(0))) * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return thresholds(scored).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("average_precision"))


def max_f1(scored: DataFrame) -> DataFrame:
    """One row: the threshold with the highest F1 with its precision and recall; of equals the lowest threshold.  None without rows."""
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.nullif("positives", F.lit(0))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall + 1e-9))
    points = thresholds(scored).select(F.col("score").alias("threshold"), precision.alias("precision"), F.coalesce(recall, F.lit(0.0)).alias("recall"), F.coalesce(f1, F.lit(0.0)).alias("f1"))
    best = points.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct(F.round("f1", 12), -F.col("threshold"))).alias("b"))
    return best.filter("b IS NOT NULL").select("b.*")


def classification_report(scored: DataFrame, threshold: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of both classes, their macro and weighted means; threshold is a one-row frame."""
    p = scored.crossJoin(F.broadcast(threshold.select("threshold"))).select("target", (F.col("score") >= F.col("threshold")).cast("int").alias("p"))  # one row
    count = lambda t, q: F.sum(((F.col("target") == t) & (F.col("p") == q)).cast("long"))
    c = p.agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), F.lit(0.0))
    rows = c.select(F.explode(F.array(*(F.struct(F.lit(k).alias("class"), ratio(a, b).alias("precision"), ratio(a, d).alias("recall"), (F.col(a) + F.col(d)).alias("support")) for k, a, b, d in (("0", "tn", "fn", "fp"), ("1", "tp", "fp", "fn"))))).alias("r")).select("r.*")
    rows = rows.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))
    mean = lambda m, w: (F.sum(F.col(m) * w) / F.sum(w)).alias(m)
    macro, weighted = (rows.agg(*(mean(m, w) for m in ("precision", "recall", "f1")), F.sum("support").alias("support")).select(F.lit(k).alias("class"), "precision", "recall", "support", "f1") for k, w in (("macro", F.lit(1)), ("weighted", F.col("support"))))
    return rows.unionByName(macro).unionByName(weighted)


def score_percentiles(scored: DataFrame) -> DataFrame:
    """Exact percentiles with linear interpolation, one row each; null without scores.  Null and NaN scores are left out.

    A percentile lies between the scores of two ranks, which the numbers of smaller scores tell; no task sees all scores.
    """
    points, place = _points(scored), lambda p: F.lit(p) * (F.col("_all_n") - 1)
    at = lambda rank: F.max(F.when((F.col("_before_n") <= rank) & (rank < F.col("_before_n") + F.col("n")), F.col("score")))
    found = [F.struct(F.lit(int(100 * p)).alias("pct"), at(F.floor(place(p))).alias("a"), at(F.ceil(place(p))).alias("b"), F.max(place(p) - F.floor(place(p))).alias("w")) for p in PERCENTILES]
    rows = points.agg(F.array(*found).alias("v")).select(F.explode("v").alias("r")).select("r.*")
    return rows.select("pct", (F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("score"))


def duplicate_check(ids: DataFrame, column: str = "event_id") -> DataFrame:
    """Rows, distinct ids (null counts as one) and repeated rows."""
    distinct = F.count_distinct(column) + F.max(F.col(column).isNull().cast("long"))
    return ids.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(distinct, F.lit(0)).alias("n_ids")).withColumn("n_repeated", F.col("n_rows") - F.col("n_ids"))
