"""Bounded training samples, and the fixed split of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """True for the quarter of the ids that is never learned from; null ids are not in it."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, targets: list[str], id_col: str, text_col: str, most: int) -> DataFrame:
    """(id, text, *targets) of at most `most` labelled rows outside the held-out quarter, chosen by a hash of their ids.

    Rows with a null label are left out; of rows that repeat an id the smallest text and the largest labels count.
    """
    known = labels.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).dropna(subset=targets).groupBy(F.col(id_col).cast("long").alias("id")).agg(*(F.max(t).alias(t) for t in targets))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "id")  # at most `most` rows are broadcast
    return rows.groupBy("id").agg(F.min("text").alias("text"), *(F.first(t).alias(t) for t in targets))
