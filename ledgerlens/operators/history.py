"""Window primitives, named by what they hold, which the feature sections are built from.

A section asks for what it needs; :func:`with_history` adds what is missing.  All primitives of one call go into one
select, so Spark gives each distinct window one operator, and since every window is partitioned by the customer first,
one shuffle by customer serves them all.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import expr as X


#: kind -> column, first and last row of the window, least number of values in it, aggregate, value of a window with fewer
ROW_WINDOWS = {
    "gap_mean_3": ("_minutes", -2, 0, 3, F.avg, None),
    "gap_std_90": ("_minutes", -90, -1, 2, F.stddev_samp, 0.0),
    "gap_mean_90": ("_minutes", -90, -1, 2, F.avg, 0.0),
    "gap_min_10": ("_minutes", -10, -1, 1, F.min, 0),
    "hour_std_90": ("hour_of_day", -90, -1, 2, F.stddev_samp, 0.0),
}


def name(kind: str, *keys: str) -> str:
    return "_" + "__".join((kind, *keys))


def whole(difference: Column, unit: int) -> Column:
    """Whole units in a difference of microseconds."""
    return F.call_function("div", difference, F.lit(unit))


def _primitive(kind: str, keys: tuple[str, ...]) -> Column:
    amount, us = F.col("amount_clean"), F.col(X.US)
    match kind:
        case "n":  # earlier events
            return F.row_number().over(X.ordered(*keys)) - 1
        case "sum":
            return X.nz(F.sum(amount).over(X.prior(*keys)), 0.0)
        case "mean":
            return X.nz(F.avg(amount).over(X.prior(*keys)), 0.0)
        case "std":
            return X.nz(F.stddev_samp(amount).over(X.prior(*keys)), 0.0)
        case "max":
            return X.nz(F.max(amount).over(X.prior(*keys)), 0.0)
        case "hours":
            return X.nz(F.sum("hour_of_day").over(X.prior(*keys)), 0)
        case "days":  # since the last one
            return X.nz(whole(us - F.lag(us).over(X.ordered(*keys)), X.DAY), 999)
        case "minutes":
            return X.nz(whole(us - F.lag(us).over(X.ordered(*keys)), X.MINUTE), 0)
        case "seconds":
            return X.nz(whole(us - F.lag(us).over(X.ordered(*keys)), 1_000_000), 0)
        case "age":  # minutes since the first one
            return X.nz(whole(us - F.min(us).over(X.up_to_now(*keys)), X.MINUTE), 0)
    if kind in ROW_WINDOWS:
        column, first, last, least, aggregate, empty = ROW_WINDOWS[kind]
        over = X.rows(first, last)
        found = F.when(F.count(column).over(over) >= least, aggregate(F.col(column)).over(over))
        return found if empty is None else X.nz(found, empty)
    if kind.startswith("lag"):  # lag<n>:<column>
        n, column = kind[3:].split(":")
        return F.lag(column, int(n)).over(X.ordered(*keys))
    raise ValueError(kind)


def with_history(df: DataFrame, needs: Iterable[tuple[str, ...]]) -> DataFrame:
    """df with a column for each (kind, *keys) that it lacks.

    Windows with further keys come first, while rows are narrow; the customer's own windows, which share one sort, come last, and
    among them those over the gaps between events after the gaps.
    """
    lacking = [need for need in dict.fromkeys(needs) if name(*need) not in df.columns]
    if any(k in ROW_WINDOWS and ROW_WINDOWS[k][0] == "_minutes" for k, *_ in lacking) and "_minutes" not in df.columns:
        lacking.append(("minutes",))
    stages = [[n for n in lacking if len(n) > 1], [n for n in lacking if len(n) == 1 and n[0] not in ROW_WINDOWS], [n for n in lacking if n[0] in ROW_WINDOWS]]
    for stage in stages:
        if stage:
            df = df.withColumns({name(*need): _primitive(need[0], tuple(need[1:])) for need in stage})
    return df


def h(kind: str, *keys: str) -> Column:
    return F.col(name(kind, *keys))


def seen(key: str) -> Column:
    """Earlier events with the same non-null value; 0 where the value is null."""
    return F.when(F.col(key).isNotNull(), h("n", key)).otherwise(0)


def is_new(key: str) -> Column:
    """1 for the first event with a non-null value."""
    return F.when(F.col(key).isNotNull() & (h("n", key) == 0), 1).otherwise(0)


def changed(column: str, *keys: str) -> Column:
    """1 if the value differs from the one before; 0 if either is null."""
    return X.sure(F.col(column) != h(f"lag1:{column}", *keys))


def same(column: str) -> Column:
    return X.sure(F.col(column) == h(f"lag1:{column}"))
