"""A customer's own history: counts, shares, lags, running maxima, log counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import expr as X

from .history import changed, h, is_new, same, seen, with_history

LAGGED = {"type": "event_type_nm", "desc": "event_desc", "channel": "channel_indicator_type", "subchannel": "channel_indicator_sub_type"}
MAXIMA = {"": (), "_mcc": ("mcc_code",), "_type": ("channel_indicator_type",), "_desc": ("event_desc",), "_sub": ("channel_indicator_sub_type",)}
LOG_COUNTS = {"event_desc": "event_desc", "mcc": "mcc_code", "pos_cd": "pos_cd"} | {
    c: c
    for c in ("event_type_nm", "timezone", "operating_system_type", "channel_indicator_type", "device_system_version", "compromised", "developer_tools", "browser_language", "currency_iso_cd", "phone_voip_call_state", "web_rdp_connection")
}
NEEDS = [
    ("n",),
    ("minutes",),
    ("gap_mean_3",),
    *(("n", k) for k in LOG_COUNTS.values()),
    *(("max", *k) for k in MAXIMA.values()),
    *((f"lag{n}:{c}",) for c in LAGGED.values() for n in range(1, 6)),
    *((f"lag1:{c}",) for c in ("mcc_code", "pos_cd", "currency_iso_cd")),
]


def behavior_features(df: DataFrame) -> DataFrame:
    """58 columns; needs transaction_features()."""
    df = with_history(df, NEEDS).withColumns({"tx_count_lifetime": h("n"), "time_since_last_tx_minutes": h("minutes")})
    gap = F.col("time_since_last_tx_minutes")
    share = lambda key: X.nz(X.fdiv(seen(key), F.col("tx_count_lifetime")), 0.0)
    return df.withColumns(
        {
            "mcc_freq_user_cum": seen("mcc_code"),
            "pos_freq_user_cum": seen("pos_cd"),
            "event_desc_user_freq": seen("event_desc"),
            "event_type_user_freq": seen("event_type_nm"),
            "mcc_is_new_for_user": is_new("mcc_code"),
            "pos_cd_is_new": is_new("pos_cd"),
            "event_desc_is_new_for_user": is_new("event_desc"),
            "event_type_is_new_for_user": is_new("event_type_nm"),
            "mcc_transaction_share_user": share("mcc_code"),
            "pos_cd_transaction_share_user": share("pos_cd"),
            "event_desc_share_user": share("event_desc"),
            "merchant_switch_flag": changed("mcc_code"),
            "time_since_last_3_tx_mean": h("gap_mean_3"),
            "mcc_frequency_user": seen("mcc_code"),
            "prev_1_op_timediff": gap,
            **{f"prev_{n}_op_{short}": X.nz(h(f"lag{n}:{c}"), -1) for short, c in LAGGED.items() for n in range(1, 6)},
            **{f"operaton_amt{suffix}_max_prev": h("max", *keys) for suffix, keys in MAXIMA.items()},
            **{f"{short}_log_count": X.log1p(seen(key)) for short, key in LOG_COUNTS.items()},
            "pos_cd_prev": same("pos_cd"),
            "currency_iso_cd_prev": same("currency_iso_cd"),
        }
    )
