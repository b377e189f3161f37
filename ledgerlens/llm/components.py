"""Connected components by label passing with pointer jumping; every table stays on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

STEPS = 2


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each end of links (a, b): the smallest node that it reaches.

    A step takes the smallest label among neighbours and then the label of that label, so the number of steps grows
    with the logarithm of a component's diameter.  Tables are written after every other step.
    """
    pairs = links.select("a", "b")
    edges = scratch.keep(pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    rows = edges.count()
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    while True:
        for _ in range(STEPS):
            near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
            step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
            jump = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            step = step.join(jump, "label").select("node", "old", F.least("label", "next").alias("label"))
            labels = step.select("node", "label")
        step = scratch.keep(step, "labels", rows)
        labels = step.select("node", "label")
        if step.filter("label != old").isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more links.  Only the labels of the links' ends are gone through again, not the links that labels came from."""
    named = lambda c: F.coalesce(F.col(f"label_{c}"), F.col(c)).alias(c)
    ends = links
    for c in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")), c, "left")
    ends = scratch.keep(ends.select("a", "b", named("a").alias("x"), named("b").alias("y")), "links")
    new = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a != b"))
    known = labels.unionAll(ends.select(F.col("a").alias("node"), F.col("x").alias("label"))).unionAll(ends.select(F.col("b").alias("node"), F.col("y").alias("label"))).distinct()
    known = known.join(new.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
    return scratch.keep(known.select("node", F.coalesce("next", "label").alias("label")), "labels")
