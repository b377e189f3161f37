"""The feature build: raw transactions and population statistics to 390 more columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import expr as X
from ledgerlens.operators import behavior, category, device, rolling, temporal, transaction, zscore
from ledgerlens.operators.history import with_history
from ledgerlens.operators.stats import Stats, with_lookups

KEYS_AT_ONCE = 6
PART_BYTES, GROWTH, MOST_PARTS = 128 << 20, 10, 1 << 20


def bytes_read(tx: DataFrame) -> int:
    """The sizes of the tables that tx reads, added up; rows of unknown size, as those of a local list or an RDD, count nothing.

    The planner's estimate for tx itself won't do: it is the largest number there is for unknown sizes, and the product of both sides for a join.
    """
    unknown = tx.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes()
    leaves = tx._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length())]
    return sum(s for s in sizes if s < unknown)


def by_customer(tx: DataFrame, partitions: int | None = None) -> DataFrame:
    """Hash-partitioned by customer, unless told otherwise into as many parts as the tables that tx reads need, or spark.sql.shuffle.partitions if that is more.

    With a stated number adaptive execution doesn't merge parts: it goes by the size of the raw rows, and the rows grow more than
    tenfold on this partitioning.
    """
    if partitions is None:
        partitions = max(int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, bytes_read(tx) * GROWTH // PART_BYTES))
    return tx.repartition(partitions, "customer_id")


def with_all_windows(df: DataFrame) -> DataFrame:
    """df with the window primitives and time windows of all sections.

    Each window operator copies its rows field by field, so what a window doesn't read travels in structs, which are copied whole: the
    other columns, and the results of every few windows.
    """
    needs = list(dict.fromkeys(n for m in (behavior, rolling, device, temporal, zscore, category) for n in m.NEEDS))
    keys = list(dict.fromkeys(tuple(n[1:]) for n in needs if len(n) > 1))
    read = {"customer_id", "event_id", X.US, "amount_clean", "hour_of_day", *rolling.SPENDS.values(), *rolling.DIVERSITY.values()}
    read |= {k for key in keys for k in key} | {kind.split(":")[1] for kind, *_ in needs if ":" in kind}
    bare, structs = [c for c in df.columns if c in read], []

    def pack(df: DataFrame) -> DataFrame:
        structs.append(f"_struct_{len(structs)}")
        rest = [c for c in df.columns if c not in bare and c not in structs]
        return df.select(*bare, *structs[:-1], F.struct(*rest).alias(structs[-1]))

    df = pack(df)
    for i in range(0, len(keys), KEYS_AT_ONCE):
        df = pack(with_history(df, [n for n in needs if tuple(n[1:]) in keys[i : i + KEYS_AT_ONCE]]))
    df = rolling.with_windows(with_history(df, [n for n in needs if len(n) == 1]))
    return df.select(*(f"{c}.*" if c in structs else c for c in df.columns))


def build_features(tx: DataFrame, stats: Stats | None = None, partitions: int | None = None) -> DataFrame:
    """tx with all features.

    The transactions are hash-partitioned by customer once; all windows, whatever further keys they have, run on that
    partitioning.  Lookups come first and then all windows, those that need a sort of their own before the customer's own; what is
    left is arithmetic.
    """
    df = transaction.transaction_features(tx)
    df = by_customer(df, partitions)
    df = with_all_windows(with_lookups(df, stats))
    df = behavior.behavior_features(df)
    df = rolling.rolling_features(df)
    df = device.device_features(df)
    df = temporal.temporal_features(df, stats)
    df = zscore.zscore_features(df, stats)
    df = category.category_features(df, stats)
    df = transaction.risk_features(df)
    added = [c for c in df.columns if c not in tx.columns and c != "amount_clean" and not c.startswith("_")]
    return df.select(*tx.columns, *added)


def engineered(tx: DataFrame, built: DataFrame) -> list[str]:
    """The columns that the build has added."""
    return [c for c in built.columns if c not in tx.columns and c != X.US]
