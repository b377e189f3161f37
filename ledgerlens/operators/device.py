"""Device state, novelty, and the session so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import expr as X

from .history import changed, h, is_new, with_history

NOVELTY = {"operating_system": "operating_system_type", "os_version": "device_system_version", "screen_size": "screen_size", "timezone": "timezone", "accept_language": "accept_language"}
SESSION = "session_id"
NEEDS = [*(("n", k) for k in NOVELTY.values()), ("n", SESSION), ("sum", SESSION), ("age", SESSION), ("seconds", SESSION), *((f"lag1:{c}", SESSION) for c in ("channel_indicator_type", "mcc_code"))]


def device_features(df: DataFrame) -> DataFrame:
    """23 columns; needs rolling_features().  Events without a session form one session per customer."""
    c = F.col
    battery = X.nz(X.number_in("battery", r"(\d+(?:\.\d+)?)\s*%", "double"), 100.0)
    df = with_history(df, NEEDS).withColumns(
        {
            "compromised_flag": X.sure(c("compromised") == "true"),
            "web_rdp_connection_flag": X.nz("web_rdp_connection", 0),
            "developer_tools_flag": X.sure(c("developer_tools") == "true"),
            "phone_voip_call_flag": X.nz("phone_voip_call_state", 0),
            "low_battery_flag": X.sure(battery < 15),
        }
    )
    count, total = h("n", SESSION), h("sum", SESSION)
    return df.withColumns(
        {
            **{f"{short}_is_new": is_new(key) for short, key in NOVELTY.items()},
            "device_risk_score": (c("compromised_flag") * 5 + c("web_rdp_connection_flag") * 3 + c("developer_tools_flag") * 2).cast("double"),
            "session_tx_count": count,
            "session_amount_sum": total,
            "session_channel_diversity": changed("channel_indicator_type", SESSION),
            "session_length_estimate": count,
            "session_mcc_switch": changed("mcc_code", SESSION),
            "session_duration_minutes": h("age", SESSION),
            "pause_ses": h("seconds", SESSION),
            "screen_w": X.nz(X.number_in("screen_size", r"^(\d+)", "int"), 0),
            "screen_h": X.nz(X.number_in("screen_size", r"x(\d+)", "int"), 0),
            "session_avg_amount": total / X.at_least(count, 1),
            "compromised_x_amount_ratio": X.over_eps(c("compromised_flag").cast("double") * c("amount_clean"), c("amount_mean_30d"), 1.0),
            "rdp_x_session_depth": c("web_rdp_connection_flag").cast("double") * count.cast("double"),
        }
    )
