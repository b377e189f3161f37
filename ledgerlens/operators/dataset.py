"""Time splits, label joins, undersampling and feature vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that are no features.
NOT_FEATURES = {
    "customer_id", "event_id", "event_dttm", "target", "is_train", "mcc_code", "accept_language", "browser_language", "battery",
    "device_system_version", "screen_size", "developer_tools", "compromised", "model_group",
}
SEED, RATIO = 42, 0.05
DIGITS = 4
RANGES = 16**DIGITS


def split_of(cutoff: str, end: str) -> Column:
    """train before cutoff, val in [cutoff, end), test from end on; null without a time."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    ts = F.col("event_dttm")
    return F.when(ts < at(cutoff), "train").when(ts < at(end), "val").when(ts >= at(end), "test")


def with_labels(tx: DataFrame, labels: DataFrame) -> DataFrame:
    """All transactions with target (0 where there is no label) and is_labeled."""
    keys = [c for c in ("customer_id", "event_id") if c in labels.columns]
    marked = labels.groupBy(*keys).agg(F.max("target").alias("_target"))
    return tx.join(marked, keys, "left").select(*(tx[c] for c in tx.columns if c not in keys), *keys, F.coalesce("_target", F.lit(0)).cast("int").alias("target"), F.col("_target").isNotNull().cast("int").alias("is_labeled"))


def feature_columns(schema: T.StructType) -> list[str]:
    """Numeric columns that are no ids, labels or raw texts."""
    return [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in NOT_FEATURES and f.name != "is_labeled"]


def undersample(df: DataFrame, ratio: float | None = RATIO, seed: int = SEED) -> DataFrame:
    """All positives, and of the n_neg negatives max(floor(n_neg * ratio), n_pos), or all if there are fewer; ratio None keeps all.

    Negatives are ordered by the MD5 of event id and seed.  The counts of hash ranges tell in which range the last one to keep lies;
    only that range is sorted, so the choice is exact without a global sort.
    """
    if ratio is None:
        return df
    digest = F.md5(F.concat_ws(":", F.col("event_id").cast("string"), F.lit(str(seed))))
    bucket = F.conv(F.substring("_digest", 1, DIGITS), 16, 10).cast("int")
    keyed = df.withColumn("_digest", digest).withColumn("_range", bucket)
    negatives = keyed.filter("target = 0")
    counts = negatives.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # at most RANGES rows
    before = counts.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.col("_n"))
    total = df.agg(F.sum((F.col("target") == 1).cast("long")).alias("n_pos"), F.sum((F.col("target") == 0).cast("long")).alias("n_neg"))
    keep = total.select(F.greatest(F.floor(F.col("n_neg") * ratio), F.col("n_pos")).alias("_keep"))
    plan = before.crossJoin(F.broadcast(keep))  # one row
    placed = negatives.join(F.broadcast(plan), "_range")  # at most RANGES rows
    inside = placed.filter("_before + _n <= _keep")
    edge = placed.filter("_before < _keep AND _before + _n > _keep")
    edge = edge.withColumn("_rank", F.row_number().over(W.partitionBy("_range").orderBy("_digest", "event_id"))).filter("_before + _rank <= _keep")
    return keyed.filter("target = 1").select(df.columns).unionByName(inside.select(df.columns)).unionByName(edge.select(df.columns))


def undersampling(df: DataFrame, ratio: float | None, seeds: Sequence[int]) -> list[Column]:
    """For each seed, the condition that a row of df is in undersample(df, ratio, seed).

    It names the last negative to keep, so one pass over wide rows gives the samples of all seeds, and only event ids and targets are read before.  Rows that
    repeat the id of the last one stay with it.
    """
    kept = (F.col("target") == 1) | (F.col("target") == 0)
    if ratio is None:
        return [F.lit(True)] * len(seeds)
    total = df.agg(F.count_if(F.col("target") == 1).alias("p"), F.count_if(F.col("target") == 0).alias("n")).first()
    keep = max(math.floor(total["n"] * ratio), total["p"])
    if keep >= total["n"]:
        return [kept] * len(seeds)
    if not keep:
        return [F.lit(False)] * len(seeds)
    digest = {s: F.md5(F.concat_ws(":", F.col("event_id").cast("string"), F.lit(str(s)))) for s in seeds}
    keys = F.explode(F.array(*(F.struct(F.lit(s).alias("seed"), d.alias("digest")) for s, d in digest.items())))
    keyed = df.filter("target = 0").select("event_id", keys.alias("k")).select("event_id", "k.*").withColumn("range", F.substring("digest", 1, DIGITS))
    counts = keyed.groupBy("seed", "range").agg(F.count(F.lit(1)).alias("n"))  # at most RANGES rows for each seed
    upto = counts.withColumn("upto", F.sum("n").over(W.partitionBy("seed").orderBy("range")))
    edges = upto.filter((F.col("upto") >= keep) & (F.col("upto") - F.col("n") < keep)).select("seed", "range", (keep - F.col("upto") + F.col("n")).alias("nth"))
    inside = keyed.join(F.broadcast(edges), ["seed", "range"])  # a row for each seed
    last = inside.withColumn("rank", F.row_number().over(W.partitionBy("seed").orderBy("digest", "event_id"))).filter("rank = nth")
    lasts = {r["seed"]: r for r in last.select("seed", "digest", "event_id").collect()}

    def condition(seed: int) -> Column:
        own, end = digest[seed], lasts[seed]
        upto = F.col("event_id").isNull() | (F.col("event_id") <= F.lit(end["event_id"]))
        return (F.col("target") == 1) | ((F.col("target") == 0) & ((own < end["digest"]) | ((own == end["digest"]) & upto)))

    return [condition(s) for s in seeds]


def split_counts(df: DataFrame) -> DataFrame:
    """Rows, labels and positives by split and model group."""
    return df.groupBy("split", "model_group").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("is_labeled").alias("n_labeled"), F.sum("target").alias("n_positive"))


def split_problems(counts: DataFrame) -> DataFrame:
    """(split, problem) for an empty training, validation or test part, and for a validation part without positives."""
    n = lambda part: F.coalesce(F.sum(F.when(F.col("split") == part, F.col("n_rows"))), F.lit(0))
    good = F.coalesce(F.sum(F.when(F.col("split") == "val", F.col("n_positive"))), F.lit(0))
    said = [F.when(n(part) == 0, F.struct(F.lit(part).alias("split"), F.lit(f"the {part} part has no rows").alias("problem"))) for part in ("train", "val", "test")]
    said.append(F.when((n("val") > 0) & (good == 0), F.struct(F.lit("val").alias("split"), F.lit("the val part has no positives").alias("problem"))))
    return counts.agg(F.array_compact(F.array(*said)).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def check_splits(counts: DataFrame) -> None:
    """Raise if the training or validation part is empty, validation has no positives, or there is nothing to score."""
    for row in split_problems(counts).collect():  # four at most
        raise ValueError(row["problem"])


def assemble(df: DataFrame, columns: list[str], missing: float = -999.0, indicators: bool = False) -> DataFrame:
    """df with a vector column features; nulls, NaN and infinities become a constant that trees can split off.

    With indicators a second half of the vector tells for each column whether the value is missing (null or NaN), so that missing values differ from
    infinities and from values that equal the constant.
    """
    x = lambda c: f"cast(`{c}` AS double)"
    cells = {f"_f_{c}": F.expr(f"CASE WHEN abs({x(c)}) < double('infinity') THEN {x(c)} ELSE {missing!r}D END") for c in columns}
    if indicators:
        cells |= {f"_m_{c}": F.expr(f"CASE WHEN {x(c)} IS NULL OR isnan({x(c)}) THEN 1D ELSE 0D END") for c in columns}
    out = VectorAssembler(inputCols=list(cells), outputCol="features").transform(df.withColumns(cells))
    return out.drop(*cells)
