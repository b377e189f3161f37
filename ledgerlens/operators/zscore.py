"""Scores against a channel's or merchant code's amounts, change flags and composite flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import expr as X

from .history import changed, h, with_history
from .stats import Stats, look_up

BASES = {"channel": "channel_indicator_type", "mcc": "mcc_code"}
PAIR = ("channel_indicator_type", "operating_system_type")
NEEDS = [("n", "session_id"), ("n", *PAIR), ("days",), ("days", "mcc_code"), *((f"lag1:{c}",) for c in ("accept_language", "operating_system_type", "timezone")), *((s, k) for k in BASES.values() for s in ("mean", "std"))]


def zscore_features(df: DataFrame, stats: Stats | None = None) -> DataFrame:
    """21 columns; needs temporal_features().  Without a table its baseline is the customer's own."""
    df, c, amount = with_history(df, NEEDS), F.col, F.col("amount_clean")
    for short, key in BASES.items():
        if stats and f"{short}_stats_global" in stats:
            df = look_up(df, stats[f"{short}_stats_global"], (key,))
        else:
            df = df.withColumns({f"{short}_mean": h("mean", key), f"{short}_std": h("std", key)})
    if stats and "combination_global" in stats:
        df = look_up(df, stats["combination_global"], PAIR).withColumn("global_combination_freq", X.nz("global_combination_freq", 0))
    else:
        df = df.withColumn("global_combination_freq", h("n", *PAIR))
    paid = X.nz("operaton_amt", 0.0)
    both = lambda a, b: a.bitwiseAND(X.sure(b))
    first = X.flag(h("n", "session_id") == 0)
    df = df.withColumns(
        {
            **{f"amount_zscore_{short}": X.fdiv(amount - c(f"{short}_mean"), X.nz(f"{short}_std", 1.0)) for short in BASES},
            "session_first_tx_flag": first,
            "language_change_flag": changed("accept_language"),
            "os_change_flag": changed("operating_system_type"),
            "timezone_change_flag": changed("timezone"),
            "rapid_sequence_flag": X.flag(c("time_since_last_tx_minutes") < 5),
            "suspicious_env_flag": X.flag(c("device_risk_score") > 1),
            "mcc_rare_global_flag": X.flag(c("global_mcc_freq") < 100),
            "rare_combination_flag": X.flag(c("global_combination_freq") < 10),
            "device_change_and_large_amount_flag": both(c("operating_system_is_new"), paid > 1000),
            "voip_and_new_mcc_flag": c("phone_voip_call_flag").bitwiseAND(c("mcc_is_new_for_user")),
            "compromised_and_high_amount_flag": both(c("compromised_flag"), paid > c("amount_mean_7d") * 2),
            "session_first_tx_large_flag": both(first, paid > 1000),
            "geo_jump_proxy": X.nz(F.abs(c("timezone") - h("lag1:timezone")), 0),
            "device_entropy_ratio": X.nz(X.fdiv("device_diversity_30d", X.nz("tx_count_30d", 1)), 0.0),
            "language_mismatch": X.flag(X.nz("accept_language", "Unknown") != X.nz("browser_language", "Unknown")),
            "timezone_mismatch": X.flag(c("timezone").isNull()),
            "merchant_last_seen_days": h("days"),
            "mcc_last_seen_days": h("days", "mcc_code"),
        }
    )
    return df.drop("channel_mean", "channel_std", "mcc_mean", "mcc_std")
