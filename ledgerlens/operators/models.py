"""Models by segment: boosted trees over several seeds, blended with a second learner.

Spark's gradient-boosted trees and random forest stand in for the two boosting libraries; the procedure is the same, the scores
are not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dataset import RATIO, assemble, undersampling

SEEDS = (42, 7, 13)
SECOND_WEIGHT = 0.25
SEGMENTS = {0: "np_type7", 1: "np_other", 2: "card", 3: "p2p"}
#: Segments fitted at a time; each of them fits all its seeds and its forest at once.
AT_ONCE = 4


def seed_average(scores: Sequence[Column | str]) -> Column:
    """The mean of the seeds' scores."""
    return reduce(lambda a, b: a + b, (F.col(s) if isinstance(s, str) else s for s in scores)) / len(scores)


def blend(first: Column | str, second: Column | str, weight: float = SECOND_WEIGHT) -> Column:
    first, second = (F.col(x) if isinstance(x, str) else x for x in (first, second))
    return (1 - weight) * first + weight * second


def route(scores: dict[int, Column], unrouted: float | None) -> Column:
    """The score of the row's segment; rows of a segment without a model get `unrouted` (0 when scoring, null when evaluating)."""
    out = F.lit(unrouted).cast("double")
    for group, score in scores.items():
        out = F.when(F.col("model_group") == group, score).otherwise(out)
    return out


@dataclass
class Ensemble:
    """A segment's models."""

    columns: list[str]
    boosted: list[GBTClassificationModel]
    second: RandomForestClassificationModel
    weight: float = SECOND_WEIGHT

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """df with the blended probability."""
        positive = lambda c: vector_to_array(c)[1]
        rows, names = _vectors(df, self.columns), [f"_p{i}" for i in range(len(self.boosted) + 1)]
        for name, model in zip(names, [*self.boosted, self.second], strict=True):
            model = model.copy()
            model.setProbabilityCol(name).setRawPredictionCol(f"{name}_raw").setPredictionCol(f"{name}_hat")
            rows = model.transform(rows)
        first = seed_average([positive(n) for n in names[:-1]])
        return rows.withColumn(out, blend(first, positive(names[-1]), self.weight)).drop(*{"features"} - {*df.columns}, *(f"{n}{e}" for n in names for e in ("", "_raw", "_hat")))

    def importance(self, top: int = 30) -> list[tuple[str, float]]:
        """The features with the largest mean importance."""
        total = sum(m.featureImportances.toArray() for m in self.boosted) / len(self.boosted)
        return sorted(zip(self.columns, total.tolist(), strict=True), key=lambda p: (-p[1], p[0]))[:top]

    def save(self, folder: str) -> None:
        for i, m in enumerate(self.boosted):
            m.write().overwrite().save(f"{folder}/boosted_{i}")
        self.second.write().overwrite().save(f"{folder}/second")

    @classmethod
    def load(cls, folder: str, columns: list[str], seeds: int = len(SEEDS)) -> Ensemble:
        return cls(columns, [GBTClassificationModel.load(f"{folder}/boosted_{i}") for i in range(seeds)], RandomForestClassificationModel.load(f"{folder}/second"))


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the vectors that learners read, unless it has them already."""
    return df if "features" in df.columns and isinstance(df.schema["features"].dataType, VectorUDT) else assemble(df, columns)


def fit_ensemble(train: DataFrame, val: DataFrame | None, columns: list[str], seeds: Sequence[int] = SEEDS, ratio: float | None = RATIO, rounds: int = 20, depth: int = 5) -> Ensemble:
    """Boosted trees for each seed on an undersampled training part, stopped early on val if given, and a forest.

    With ratio None nothing is left out; positives then weigh as much as negatives together.  All learners read one table, which is kept meanwhile: the rows of
    val, and those of train that any seed's sample has, with a flag for each seed.
    """
    flags = [f"_seed_{i}" for i in range(len(seeds))]
    rows = train.withColumns(dict(zip(flags, undersampling(train, ratio, seeds), strict=True))).filter(" OR ".join(flags)).withColumns({"_val": F.lit(False), "_weight": F.lit(1.0)})
    if ratio is None:
        n = train.agg(F.sum("target").alias("p"), F.count(F.lit(1)).alias("n")).first()
        rows = rows.withColumn("_weight", F.when(F.col("target") == 1, F.lit((n["n"] - n["p"]) / max(n["p"], 1))).otherwise(1.0))
    used = ["features", "target", "_val", "_weight", *flags]
    rows = _vectors(rows, columns).select(used)
    if val is not None:
        held = val.withColumns({"_val": F.lit(True), "_weight": F.lit(1.0)} | {f: F.lit(True) for f in flags})
        rows = rows.unionAll(_vectors(held, columns).select(used))
    rows = rows.hint("rebalance").persist()  # in partitions of the advisory size: each level of each tree is a job with a task for every partition

    def boost(i: int) -> GBTClassificationModel:
        model = GBTClassifier(labelCol="target", maxIter=rounds, maxDepth=depth, seed=seeds[i], subsamplingRate=0.8)
        if ratio is None:
            model = model.setWeightCol("_weight")
        if val is not None:
            model = model.setValidationIndicatorCol("_val")
        return model.fit(rows.filter(flags[i]))

    def forest() -> RandomForestClassificationModel:
        return RandomForestClassifier(labelCol="target", numTrees=20, maxDepth=depth, seed=seeds[0]).fit(rows.filter(f"{flags[0]} AND NOT _val"))

    try:
        rows.count()
        *boosted, second = _together(train, [*(lambda i=i: boost(i) for i in range(len(seeds))), forest], len(seeds) + 1)
    finally:
        rows.unpersist()
    return Ensemble(columns, boosted, second)


def _together(df: DataFrame, tasks: Iterable[Callable], at_once: int) -> list:
    """The tasks' results in their order.  A fit is hundreds of small jobs one after the other, which leave most cores idle, so several run at a time."""
    run = inheritable_thread_target(df.sparkSession)(lambda task: task())
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(run, tasks))


@dataclass
class Routed:
    """An ensemble for each segment that could be trained; skipped tells why others could not."""

    ensembles: dict[int, Ensemble]
    skipped: dict[int, str] = field(default_factory=dict)

    def score(self, df: DataFrame, unrouted: float | None = 0.0) -> DataFrame:
        rest = df.filter(~F.coalesce(F.col("model_group").isin(*self.ensembles), F.lit(False))) if self.ensembles else df
        out = rest.withColumn("score", F.lit(unrouted).cast("double"))
        for group, ensemble in self.ensembles.items():
            out = out.unionByName(ensemble.score(df.filter(F.col("model_group") == group)))
        return out


def fit_routed(train: DataFrame, val: DataFrame | None, columns: list[str], groups: Sequence[int] = tuple(SEGMENTS), **options) -> Routed:
    """fit_ensemble() by segment; a segment without rows, or with only one class, is skipped."""
    counts = {r["model_group"]: r for r in train.groupBy("model_group").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("p")).collect()}
    out, tasks = Routed({}), {}
    for group in groups:
        c = counts.get(group)
        if c is None or not c["p"] or c["p"] == c["n"]:
            out.skipped[group] = "no rows" if c is None else "one class only"
            continue
        tasks[group] = lambda g=group: fit(g)

    def fit(group: int) -> Ensemble:
        part, held = (None if df is None else df.filter(F.col("model_group") == group) for df in (train, val))
        return fit_ensemble(part, held if held is not None and not held.isEmpty() else None, columns, **options)

    out.ensembles |= zip(tasks, _together(train, tasks.values(), AT_ONCE), strict=True)
    return out
