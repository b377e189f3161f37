"""Profiles of categorical columns: volumes, rates, dominant groups, cross tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.sources.files import write_csv

GROUP = "tx_type_group"
GROUPS = {0: "nonpayment", 1: "card", 2: "p2p"}


def _label_counts(labelled: DataFrame, keys: list[str]) -> DataFrame:
    return labelled.groupBy(*keys).agg(F.sum("target").alias("fraud_count"), F.count(F.lit(1)).alias("labeled_count"))


def _rate() -> Column:
    return (F.col("fraud_count") / F.col("labeled_count") * 100).alias("fraud_rate_pct")


def dominant_group(tx: DataFrame, key: str) -> DataFrame:
    """(key, tx_type_group_mode): the most frequent group; of equals the smaller one."""
    counts = tx.groupBy(key, GROUP).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.max_by(GROUP, F.struct("n", -F.col(GROUP))).alias("tx_type_group_mode"))


def value_counts(tx: DataFrame, labelled: DataFrame, key: str, top: int = 40) -> DataFrame:
    """The top values with volume, share, labels, rate and dominant group; ties by value, nulls first."""
    counts = tx.groupBy(key).agg(F.count(F.lit(1)).alias("total_count"))
    whole = tx.agg(F.count(F.lit(1)).alias("whole"))
    df = counts.join(_label_counts(labelled, [key]), key, "left").join(dominant_group(tx, key), key, "left").crossJoin(F.broadcast(whole))  # one row
    df = df.select(key, "total_count", "fraud_count", "labeled_count", "tx_type_group_mode", (F.col("total_count") / F.col("whole") * 100).alias("pct_of_all"), _rate())
    return df.orderBy(F.desc("total_count"), key).limit(top)


def crosstab(tx: DataFrame, key: str, top: int = 30) -> DataFrame:
    """Shares of the three groups within each of the top values."""
    wide = tx.groupBy(key).pivot(GROUP, list(GROUPS)).count().na.fill(0, [str(g) for g in GROUPS])
    total = F.col("0") + F.col("1") + F.col("2")
    wide = wide.withColumn("total", total).orderBy(F.desc("total"), key).limit(top)
    return wide.select(key, *((F.col(str(g)) / F.greatest("total", F.lit(1))).alias(name) for g, name in GROUPS.items()))


def grouped_rates(tx: DataFrame, labelled: DataFrame, keys: list[str], label_keys: list[str] | None = None) -> DataFrame:
    """Volume of each group of keys, with labels counted by label_keys, and the rate."""
    label_keys = label_keys or keys
    volume = tx.groupBy(*keys).agg(F.count(F.lit(1)).alias("volume"))
    return volume.join(_label_counts(labelled, label_keys), label_keys, "left").select(*keys, "volume", "fraud_count", "labeled_count", _rate())


def within_group_stats(tx: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    """Volumes and rates of a key's values by group: groups ascending, within them the largest volumes first, ties by value."""
    return grouped_rates(tx, labelled, [GROUP, key]).orderBy(F.asc(GROUP), F.desc("volume"), F.asc(key))


def group_volumes(stats: DataFrame) -> DataFrame:
    """The total volume of each of the three groups, 0 for one without rows, from a table with volumes by group."""
    total = stats.groupBy(GROUP).agg(F.sum("volume").alias("total_volume"))
    names = F.array(*(F.struct(F.lit(g).alias(GROUP), F.lit(name).alias("group_name")) for g, name in GROUPS.items()))
    every = stats.sparkSession.range(1).select(F.explode(names).alias("g")).select("g.*")
    return every.join(total, GROUP, "left").select(GROUP, "group_name", F.coalesce("total_volume", F.lit(0)).alias("total_volume"))


def export(tables: dict[str, DataFrame], folder: str) -> None:
    """Each profile as a CSV table below the folder; an earlier one is replaced."""
    for name, table in tables.items():
        write_csv(table.coalesce(1), f"{folder}/{name}")  # a profile is a report of few rows


def pair_stats(tx: DataFrame, labelled: DataFrame) -> DataFrame:
    return grouped_rates(tx, labelled, ["event_type_nm", "event_desc", GROUP], ["event_type_nm", "event_desc"])


def channel_pair_stats(tx: DataFrame, labelled: DataFrame) -> DataFrame:
    return grouped_rates(tx, labelled, ["channel_indicator_type", "channel_indicator_sub_type"])


def top_rates(stats: DataFrame, least: int, top: int, by: str | None = None) -> DataFrame:
    """Rows with at least `least` labels and the highest rates, overall or for each value of by; ties by volume, then by the keys."""
    keys = [c for c in stats.columns if c not in ("volume", "fraud_count", "labeled_count", "fraud_rate_pct")]
    order = [F.desc("fraud_rate_pct"), F.desc("volume"), *keys]
    enough = stats.filter(F.col("labeled_count") >= least)
    if by is None:
        return enough.orderBy(*order).limit(top)
    return enough.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= top)


def channel_pivot(tx: DataFrame, kinds: list[int]) -> DataFrame:
    """Volumes by channel type (rows) and the given subtypes (columns c_<subtype>)."""
    wide = tx.filter("channel_indicator_type IS NOT NULL").groupBy("channel_indicator_type").pivot("channel_indicator_sub_type", kinds).count()
    return wide.select("channel_indicator_type", *(F.coalesce(F.col(str(k)), F.lit(0)).alias(f"c_{k}") for k in kinds))
