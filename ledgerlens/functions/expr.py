"""Scalar rules and window specifications that all features share.

Arithmetic follows IEEE 754 where a denominator can be zero: a null operand gives null, x / 0 gives an infinity or NaN, and
filling nulls leaves NaN alone.  Row-based windows order a customer's events by (time, event id), so ties are stable;
time windows are left-closed and exclude the present moment.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS, OFFSET = 1e-9, 1.37e-5
US = "_us"
MINUTE, DAY = 60_000_000, 86_400_000_000
#: Lengths of the time windows in microseconds.
PERIODS = {"15m": 15 * MINUTE, "1h": 60 * MINUTE, "6h": 360 * MINUTE, "12h": 720 * MINUTE, "1d": DAY, "3d": 3 * DAY, "7d": 7 * DAY, "30d": 30 * DAY, "90d": 90 * DAY}


def col_of(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone; independent of the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col_of(ts))


def nz(x: Column | str, value: float | int | str = 0) -> Column:
    """x, or value where it is null; NaN stays."""
    return F.coalesce(col_of(x), F.lit(value))


def flag(condition: Column) -> Column:
    """1 or 0; null stays null."""
    return condition.cast("int")


def sure(condition: Column) -> Column:
    """1 or 0; null counts as false."""
    return F.when(condition, 1).otherwise(0)


def at_least(x: Column | str, low: float | int) -> Column:
    """x, raised to low; null stays null."""
    x = col_of(x)
    return F.when(x < low, F.lit(low)).otherwise(x)


def fdiv(a: Column | str, b: Column | str) -> Column:
    """a / b as IEEE 754 has it, null if either is null."""
    a, b = col_of(a).cast("double"), col_of(b).cast("double")
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).when(b == 0, by_zero).otherwise(a / b)


def over_eps(a: Column | str, b: Column | str, empty: float = 0.0) -> Column:
    """a / (b + 1e-9), where a null b counts as empty."""
    return col_of(a) / (nz(col_of(b).cast("double"), empty) + F.lit(EPS))


def log1p(x: Column | str) -> Column:
    """ln(1 + x): minus infinity at -1 and NaN below, where Spark's own has null."""
    x = col_of(x).cast("double")
    return F.when(x > -1, F.log1p(x)).when(x == -1, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))


def finite(x: Column | str) -> Column:
    """x for comparisons between engines: null unless finite, 4 decimals below a million and whole millions above.

    The offset keeps values that lie halfway between two decimals, as means of amounts often do, away from the point where the last bit decides.
    """
    if isinstance(x, str):  # one expression instead of a dozen calls
        return F.expr(finite_sql(f"cast(`{x}` AS double)"))
    x = x.cast("double")
    small = F.round(x + F.lit(OFFSET), 4) + F.lit(0.0)
    return F.when(F.abs(x) < 1e6, small).when(F.abs(x) < float("inf"), F.round(x / 1e6 + F.lit(OFFSET)) * 1e6)


def finite_sql(x: str) -> str:
    """finite() of a double, as text; floor() is far faster than round() and differs from it only halfway between two decimals."""
    return f"CASE WHEN abs({x}) < 1e6D THEN floor(({x} + {OFFSET!r}D) * 1e4D + 0.5D) / 1e4D WHEN abs({x}) < double('infinity') THEN round({x} / 1e6D + {OFFSET!r}D) * 1e6D END"


def number_in(text: Column | str, pattern: str, kind: str) -> Column:
    """The first group of a pattern as a number, or null."""
    return F.nullif(F.regexp_extract(col_of(text), pattern, 1), F.lit("")).try_cast(kind)


def ordered(*keys: str) -> WindowSpec:
    """A customer's events, or those with equal keys, in order; null is a key like others."""
    return W.partitionBy("customer_id", *keys).orderBy(US, "event_id")


def prior(*keys: str) -> WindowSpec:
    return ordered(*keys).rowsBetween(W.unboundedPreceding, -1)


def up_to_now(*keys: str) -> WindowSpec:
    return ordered(*keys).rowsBetween(W.unboundedPreceding, 0)


def rows(first: int, last: int) -> WindowSpec:
    return ordered().rowsBetween(first, last)


def span(micro_seconds: int) -> WindowSpec:
    """Events of the customer in [t - length, t)."""
    return W.partitionBy("customer_id").orderBy(US).rangeBetween(-micro_seconds, -1)
