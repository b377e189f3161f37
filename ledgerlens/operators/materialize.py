"""Customer buckets, narrower types, and the bucketed feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.sources.files import write_parquet

from .ranks import id_levels, with_before
from .stats import Stats

IDS = ("customer_id", "event_id", "session_id")


def customer_buckets(tx: DataFrame, n_buckets: int) -> DataFrame:
    """(customer_id, bucket): contiguous chunks of ceil(customers / n_buckets) sorted ids; none for an empty table.

    A customer's place is the number of customers with smaller ids, from counts of ranges of ids; no task sees all customers, however sparse the ids are.
    """
    if n_buckets < 1:
        raise ValueError("n_buckets must be positive")
    ids, levels = tx.filter("customer_id IS NOT NULL").select("customer_id").distinct().withColumn("_n", F.lit(1).cast("long")), id_levels("customer_id")
    placed = with_before(ids.withColumns(levels), [*levels, "customer_id"], ["_n"])
    return placed.select("customer_id", F.floor(F.col("_before__n") / F.ceil(F.col("_all__n") / n_buckets)).cast("int").alias("bucket"))


def in_bucket(tx: DataFrame, buckets: DataFrame, bucket: int) -> DataFrame:
    """The transactions of a bucket's customers."""
    return tx.join(buckets.filter(F.col("bucket") == bucket), "customer_id", "left_semi")


def downcast(df: DataFrame) -> DataFrame:
    """double -> float and long -> int, but for ids; a long that doesn't fit raises an error."""
    narrow = {T.DoubleType(): "float", T.LongType(): "int"}
    return df.select([F.col(f.name).cast(narrow[f.dataType]) if f.dataType in narrow and f.name not in IDS else F.col(f.name) for f in df.schema.fields])


def write_features(tx: DataFrame, path: str, n_buckets: int, stats: Stats | None = None, train_only: bool = False) -> None:
    """Build, narrow and write the features, in a folder for each bucket of customers."""
    from ledgerlens.plans.features import build_features

    built = build_features(tx, stats)
    if train_only:  # after the windows: earlier events are history
        built = built.filter("is_train = 1")
    write_parquet(downcast(built.join(customer_buckets(tx, n_buckets), "customer_id")), path, by=["bucket"])
