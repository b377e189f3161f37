"""Global frequencies, time of day, gaps between events, and a few interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import expr as X

from .history import changed, h, is_new, seen, with_history
from .stats import COUNTS, Stats, look_up

FREQUENCIES = {t: v for t, v in COUNTS.items() if t not in ("combination_global", "subchannel_global")}
GIVEN = {"channel": "channel_indicator_type", "mcc": "mcc_code", "device": "operating_system_type"}
NEEDS = [*(("n", k) for (k,), _ in FREQUENCIES.values()), ("n",), ("hours",), ("gap_std_90",), ("gap_mean_90",), ("gap_min_10",), ("hour_std_90",), ("lag1:channel_indicator_type",), *(("mean", k) for k in GIVEN.values())]


def temporal_features(df: DataFrame, stats: Stats | None = None) -> DataFrame:
    """26 columns; needs device_features().  Without a table a frequency is the customer's own."""
    df = with_history(df, NEEDS)
    for table, (keys, out) in FREQUENCIES.items():
        df = look_up(df, stats[table], keys) if stats and table in stats else df.withColumn(out, seen(keys[0]))
    c, hour = F.col, F.col("hour_of_day")
    return df.withColumns(
        {
            "time_gap_variance_30d": h("gap_std_90"),
            "time_gap_mean_30d": h("gap_mean_90"),
            "circadian_deviation_score": F.abs(hour - h("hours") / X.at_least("tx_count_lifetime", 1)),
            "channel_shift_score": changed("channel_indicator_type"),
            "velocity_change_flag": X.sure(c("tx_count_1d") > c("avg_tx_per_day_30d") * 2),
            "time_gap_min_10tx": h("gap_min_10"),
            "new_device_flag": c("operating_system_is_new"),
            "new_mcc_flag": c("mcc_is_new_for_user"),
            "new_channel_flag": is_new("channel_indicator_type"),
            "merchant_entropy_user": X.nz(X.fdiv("mcc_freq_user_cum", "tx_count_lifetime"), 0.0),
            "time_gap_cv_30d": h("gap_std_90") / (h("gap_mean_90") + F.lit(X.EPS)),
            "browser_language_mismatch": X.sure(c("accept_language") != c("browser_language")),
            "new_device_and_night_flag": X.sure((c("is_night") == 1) & (c("operating_system_is_new") == 1)),
            "rdp_and_large_amount_flag": X.sure((c("web_rdp_connection_flag") == 1) & (c("amount_clean") > 1000)),
            **{f"amount_zscore_given_{short}": h("mean", key) for short, key in GIVEN.items()},
            "tx_time_zscore_given_user": h("hour_std_90"),
        }
    )
