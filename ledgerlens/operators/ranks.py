"""Running sums over sorted keys without a task that sees all keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_before(points: DataFrame, levels: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """points with _before_<c>, the sum of c over all rows with a smaller key, and _all_<c>, the sum over all rows, for each c of sums.

    levels: columns that give the key from coarse to fine; each but the last is a function of the finer ones that never falls as they rise, and the last is the key itself, one row
    for each.  Sums run within a value of the coarser levels and are completed from the totals of these; so no window holds more than one level's
    values below a value of the level before.  Key columns hold no nulls.
    """
    up: DataFrame | None = None
    for k, level in enumerate(levels):
        last = k == len(levels) - 1
        df = points if last else points.groupBy(*levels[: k + 1]).agg(*(F.sum(c).alias(c) for c in sums))
        over = W.partitionBy(*levels[:k]).orderBy(level).rowsBetween(W.unboundedPreceding, -1)
        df = df.withColumns({f"_at_{c}": F.coalesce(F.sum(c).over(over), F.lit(0)) for c in sums})
        if up is None:
            df = df.withColumns({f"_all_{c}": F.sum(c).over(W.partitionBy()) for c in sums})  # few rows: the coarsest level's values
        else:
            df = df.join(up, list(levels[:k])).withColumns({f"_at_{c}": F.col(f"_at_{c}") + F.col(f"_before_{c}") for c in sums}).drop(*(f"_before_{c}" for c in sums))
        df = df.withColumnsRenamed({f"_at_{c}": f"_before_{c}" for c in sums})
        up = df if last else df.select(*levels[: k + 1], *(f"_{w}_{c}" for c in sums for w in ("before", "all")))
    return up


def score_levels(score: str = "score") -> dict[str, Column]:
    """Levels for a column of scores, mostly between 0 and 1, that may pile up anywhere: 2 ** 10 and 2 ** 24 steps to a unit, then the score itself."""
    step = lambda n: F.floor(F.greatest(F.least(F.col(score), F.lit(1e9)), F.lit(-1e9)) * float(1 << n))
    return {"_r0": step(10), "_r1": step(24)}


def id_levels(column: str) -> dict[str, Column]:
    """Levels for a column of 64-bit numbers, dense or sparse: the high 24 bits, then the high 44."""
    return {"_r0": F.shiftright(F.col(column), 40), "_r1": F.shiftright(F.col(column), 20)}
