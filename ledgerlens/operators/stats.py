"""Population statistics: frequencies, amount distributions and smoothed target encodings.

Two aggregations with grouping sets give all tables: one over the transactions, one over the labelled ones.  Their results are kept in
memory, so each lookup is a join with a relation whose size Spark knows, which it broadcasts if it is small
and shuffles if it is not.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import expr as X

from .transaction import tx_type_group

ALPHA = 20
#: table -> (keys, count column)
COUNTS = {
    "mcc_global": (("mcc_code",), "global_mcc_freq"),
    "channel_global": (("channel_indicator_type",), "global_channel_freq"),
    "os_global": (("operating_system_type",), "global_device_os_freq"),
    "timezone_global": (("timezone",), "global_timezone_freq"),
    "language_global": (("accept_language",), "global_language_freq"),
    "pos_global": (("pos_cd",), "global_pos_cd_freq"),
    "evtype_global": (("event_type_nm",), "global_event_type_freq"),
    "evdesc_global": (("event_desc",), "global_event_desc_freq"),
    "combination_global": (("channel_indicator_type", "operating_system_type"), "global_combination_freq"),
    "subchannel_global": (("channel_indicator_sub_type",), "global_subchannel_freq"),
}
#: table -> (key, prefix of the mean and std columns)
AMOUNTS = {
    "channel_stats_global": ("channel_indicator_type", "channel"),
    "mcc_stats_global": ("mcc_code", "mcc"),
    "event_desc_stats_global": ("event_desc", "event_desc_global"),
    "event_type_stats_global": ("event_type_nm", "event_type_global"),
    "subchannel_stats_global": ("channel_indicator_sub_type", "subchannel_global"),
    "pos_stats_global": ("pos_cd", "pos_global"),
}
#: table -> (keys, encoding column)
ENCODINGS = {
    "evtype_target_enc": (("event_type_nm",), "event_type_nm_target_enc"),
    "evdesc_target_enc": (("event_desc",), "event_desc_target_enc"),
    "channel_type_target_enc": (("channel_indicator_type",), "channel_type_target_enc"),
    "channel_subtype_target_enc": (("channel_indicator_sub_type",), "channel_subtype_target_enc"),
    "mcc_target_enc": (("mcc_code",), "mcc_target_enc"),
    "type_desc_target_enc": (("event_type_nm", "event_desc"), "type_desc_pair_target_enc"),
    "channel_type_within_group_te": (("tx_type_group", "channel_indicator_type"), "channel_type_fraud_rate_within_group"),
    "channel_subtype_within_group_te": (("tx_type_group", "channel_indicator_sub_type"), "channel_subtype_fraud_rate_within_group"),
}


@dataclass
class Stats:
    """Tables by name; release() drops what is kept in memory."""

    tables: dict[str, DataFrame]
    kept: list[DataFrame] = field(default_factory=list)

    def __contains__(self, key: str) -> bool:
        return key in self.tables

    def __getitem__(self, key: str) -> DataFrame:
        return self.tables[key]

    def save(self, folder: str) -> None:
        for key, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{folder}/{key}")

    @classmethod
    def load(cls, spark, folder: str, with_labels: bool = True, only: Collection[str] | None = None) -> Stats:
        keys = [t for t in (*COUNTS, *AMOUNTS, *([*ENCODINGS, "global_fraud_rate"] if with_labels else [])) if only is None or t in only]
        return cls({key: spark.read.parquet(f"{folder}/{key}") for key in keys})

    def release(self) -> None:
        for table in self.kept:
            table.unpersist()


def _sets(df: DataFrame, sets: list[tuple[str, ...]], *aggregates) -> tuple[DataFrame, dict[tuple[str, ...], int]]:
    """One row for each group of each set, with _set; and the number of each set there."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in columns)).agg(F.grouping_id().alias("_set"), *aggregates)
    return out, {s: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s) for s in sets}


def labelled(tx: DataFrame, labels: DataFrame) -> DataFrame:
    """Transactions with a label, joined on customer and event if the labels have both; of repeated labels the largest counts."""
    keys = [c for c in ("customer_id", "event_id") if c in labels.columns]
    return tx.join(labels.groupBy(*keys).agg(F.max("target").alias("target")), keys)


def compute_stats(tx: DataFrame, labels: DataFrame | None = None, alpha: float = ALPHA, as_of: str | None = None, only: Collection[str] | None = None) -> Stats:
    """All tables, or only some; those of labels only if there are any.  as_of: only events before that time count."""
    if as_of is not None:
        tx = tx.filter(F.col("event_dttm") < F.lit(as_of).cast("timestamp_ntz"))
    amount = X.nz("operaton_amt", 0.0)
    some = lambda tables: {t: v for t, v in tables.items() if only is None or t in only}
    counts, amounts, encodings = some(COUNTS), some(AMOUNTS), some(ENCODINGS)
    tables, kept = {}, []
    if sets := list(dict.fromkeys([k for k, _ in counts.values()] + [(k,) for k, _ in amounts.values()])):
        every, number = _sets(tx, sets, F.count(F.lit(1)).alias("n"), F.avg(amount).alias("mean"), F.stddev_samp(amount).alias("std"))
        every = every.persist()
        every.count()
        kept.append(every)
        tables |= {t: every.filter(F.col("_set") == number[keys]).select(*keys, F.col("n").alias(out)) for t, (keys, out) in counts.items()}
        tables |= {t: every.filter(F.col("_set") == number[(key,)]).select(key, F.col("mean").alias(f"{out}_mean"), F.col("std").alias(f"{out}_std")) for t, (key, out) in amounts.items()}
    if labels is not None and (encodings or only is None or "global_fraud_rate" in only):
        rows = labelled(tx, labels).withColumn("tx_type_group", tx_type_group())
        found, number = _sets(rows, [*dict.fromkeys(k for k, _ in encodings.values()), ()], F.sum("target").cast("double").alias("bad"), F.count(F.lit(1)).cast("double").alias("n"))
        found = found.persist()
        found.count()
        kept.append(found)
        total = found.filter(F.col("_set") == number[()]).select((F.col("bad") / F.col("n")).alias("global_fraud_rate"))
        tables["global_fraud_rate"] = total
        rate = (total.first() or [None])[0]  # one number, of a table that is in memory
        smooth = (F.col("bad") + alpha * F.lit(rate)) / (F.col("n") + alpha)
        tables |= {t: found.filter(F.col("_set") == number[keys]).select(*keys, smooth.alias(out)) for t, (keys, out) in encodings.items()}
    return Stats(tables, kept)


def look_up(df: DataFrame, table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Left join; null keys match nothing.  A table whose columns df has already is not joined again."""
    return df if set(table.columns) <= set(df.columns) else df.join(table, list(keys), "left")


def with_lookups(df: DataFrame, stats: Stats | None) -> DataFrame:
    """df with the columns of all tables.  Best called while rows are narrow: the joins then run in one generated stage."""
    if stats is None:
        return df
    keys = {t: k for t, (k, _) in (COUNTS | ENCODINGS).items()} | {t: (k,) for t, (k, _) in AMOUNTS.items()}
    for table, on in keys.items():
        if table in stats:
            df = look_up(df, stats[table], on)
    if "global_fraud_rate" in stats and "global_fraud_rate" not in df.columns:
        df = df.crossJoin(F.broadcast(stats["global_fraud_rate"]))  # one row
    return df
