"""Time windows [t - p, t) of a customer's events, and ratios between them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import expr as X

from .history import h, with_history

DIVERSITY = {"channel": "channel_indicator_type", "device": "operating_system_type", "merchant": "mcc_code", "event_desc": "event_desc", "event_type": "event_type_nm"}
SPENDS = {"card_spend": "amount_card", "p2p_spend": "amount_p2p"}
NEEDS = [("n",), ("lag1:amount_clean",), ("sum", "channel_indicator_type"), ("n", "channel_indicator_type")]


def amount_window(period: str) -> dict[str, Column]:
    """Count, sum and distribution of the amounts in one period.

    Counts and sums of an empty window are 0, other aggregates null.  An event without a time has an empty window.
    """
    over, amount = X.span(X.PERIODS[period]), F.col("amount_clean")
    put = lambda c: F.when(F.col(X.US).isNotNull(), c.over(over))
    return {
        "tx_count": X.nz(put(F.count(F.lit(1))), 0),
        "amount_mean": put(F.avg(amount)),
        "amount_std": put(F.stddev_samp(amount)),
        "amount_median": put(F.percentile(amount, 0.5)),
        "amount_max": put(F.max(amount)),
        "amount_min": put(F.min(amount)),
        "cumulative_spend": X.nz(put(F.sum(amount)), 0.0),
    }


def window_metrics(period: str) -> dict[str, Column]:
    """14 aggregates over one period: amount_window(), spend by type, and distinct values (null is one of them)."""
    over = X.span(X.PERIODS[period])
    put = lambda c, empty: X.nz(F.when(F.col(X.US).isNotNull(), c), empty)
    distinct = lambda c: F.size(F.collect_set(c).over(over)) + X.nz(F.max(F.col(c).isNull().cast("int")).over(over), 0)
    out = amount_window(period)
    out |= {k: put(F.sum(c).over(over), 0.0) for k, c in SPENDS.items()}
    out |= {f"{k}_diversity": put(distinct(c), 0) for k, c in DIVERSITY.items()}
    return {f"{k}_{period}": c for k, c in out.items()}


def with_windows(df: DataFrame, periods: Iterable[str] = tuple(X.PERIODS)) -> DataFrame:
    """14 columns for each period; periods that df has already stay."""
    new = {k: c for p in periods if f"tx_count_{p}" not in df.columns for k, c in window_metrics(p).items()}
    return df.withColumns(new) if new else df


def rolling_features(df: DataFrame) -> DataFrame:
    """126 window columns and 49 derived ones; needs behavior_features()."""
    df = with_windows(with_history(df, NEEDS))
    amount, c = F.col("amount_clean"), F.col
    spend = lambda p: c(f"cumulative_spend_{p}")
    place = lambda p: (amount - c(f"amount_min_{p}")) / (c(f"amount_max_{p}") - c(f"amount_min_{p}") + F.lit(X.EPS))
    previous = h("lag1:amount_clean")
    ratios = {f"spend_ratio_{a}_vs_{b}": X.over_eps(spend(a), spend(b)) for a, b in (("15m", "1d"), ("1h", "1d"), ("6h", "1d"), ("12h", "1d"), ("1d", "30d"), ("1d", "90d"), ("7d", "90d"))}
    ratios |= {f"tx_count_ratio_{a}_vs_{b}": X.over_eps(f"tx_count_{a}", c(f"tx_count_{b}")) for a, b in (("15m", "1h"), ("1h", "1d"))}
    for kind in ("card", "p2p"):
        fractions = ("1d", "7d", "30d", "90d") if kind == "card" else ("1d", "30d", "90d")
        ratios |= {f"{kind}_fraction_{p}": X.over_eps(f"{kind}_spend_{p}", spend(p)) for p in fractions}
        ratios |= {f"{kind}_spend_ratio_{a}_vs_{b}": X.over_eps(f"{kind}_spend_{a}", c(f"{kind}_spend_{b}")) for a, b in (("1d", "30d"), ("1d", "90d"), ("7d", "90d"))}
    ratios |= {f"card_vs_p2p_ratio_{p}": X.over_eps(f"card_spend_{p}", c(f"p2p_spend_{p}")) for p in ("1d", "30d", "90d")}
    return df.withColumns(
        ratios
        | {
            "burst_flag_15m": X.flag(c("tx_count_15m") > 2),
            "burst_flag_1h": X.flag(c("tx_count_1h") > 5),
            **{f"amount_ratio_to_mean_{p}": X.over_eps(amount, c(f"amount_mean_{p}"), 1.0) for p in ("1h", "6h")},
            **{f"amount_rank_percentile_{p}": place(p) for p in ("7d", "30d", "90d")},
            "amount_zscore_30d": X.fdiv(amount - c("amount_mean_30d"), X.nz("amount_std_30d", 1.0)),
            "amount_ratio_to_mean_30d": X.fdiv(amount, X.nz("amount_mean_30d", 1.0)),
            "avg_tx_per_day_30d": c("tx_count_30d") / 30.0,
            "spend_velocity_1d": spend("30d") / 30.0,
            "tx_count_ratio_7d_vs_90d": X.fdiv("tx_count_7d", X.nz("tx_count_90d", 1)),
            "amount_mean_ratio_7d_vs_90d": X.fdiv("amount_mean_7d", X.nz("amount_mean_30d", 1.0)),
            "amount_diff_from_prev": X.nz(amount - previous, 0.0),
            "amount_ratio_prev": X.fdiv(amount, X.nz(previous, 1.0)),
            "burst_flag": X.sure(c("time_since_last_tx_minutes") < 5),
            "spend_velocity_7d": spend("7d") / 7.0,
            "spend_velocity_30d": spend("30d") / 30.0,
            "amount_top5pct_30d": X.flag(place("30d") > 0.95),
            "amount_top1pct_90d": X.flag(place("90d") > 0.99),
            "amount_above_personal_max_flag": X.flag(amount > X.nz("amount_max_90d", 0.0)),
            "spend_in_channel_lifetime": h("sum", "channel_indicator_type"),
            "tx_count_in_channel_lifetime": h("n", "channel_indicator_type"),
            "channel_usage_share": h("n", "channel_indicator_type") / X.at_least("tx_count_lifetime", 1),
        }
    )
