"""History within each category, novelty of pairs, scores against the population, and target encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import expr as X

from .history import h, with_history
from .stats import AMOUNTS, ENCODINGS, Stats, look_up

#: key -> names of its spend, mean, std, count, days, score, share of lifetime spend, share against 90 days, share of events
KEYS = {
    "event_desc": ("event_desc_spend_user", "event_desc_amount_mean_user", "event_desc_amount_std_user", None, "event_desc_last_seen_days", "event_desc", "event_desc_spend_share_user", "event_desc_spend_vs_90d", None),
    "event_type_nm": ("event_type_spend_user", "event_type_amount_mean_user", "event_type_amount_std_user", None, "event_type_last_seen_days", "event_type", "event_type_spend_share_user", "event_type_spend_vs_90d", None),
    "channel_indicator_sub_type": ("spend_in_subchannel_lifetime", "amount_mean_subchannel_user", "amount_std_subchannel_user", "tx_count_in_subchannel_lifetime", "subchannel_last_seen_days", "subchannel", None, "subchannel_spend_vs_90d", "subchannel_usage_share"),
    "pos_cd": ("spend_in_pos_lifetime", "amount_mean_pos_user", "amount_std_pos_user", None, "pos_last_seen_days", "pos", None, "pos_spend_vs_90d", None),
    "tx_type_group": ("spend_in_tx_type_lifetime", "amount_mean_tx_type_user", "amount_std_tx_type_user", "tx_count_in_tx_type_lifetime", None, "tx_type", "tx_type_spend_share", "tx_type_spend_vs_90d", "tx_type_usage_share"),
}
COMBINATIONS = {
    "channel_desc": ("channel_indicator_type", "event_desc"),
    "channel_type": ("channel_indicator_type", "event_type_nm"),
    "subchannel_type": ("channel_indicator_sub_type", "event_type_nm"),
    "type_desc": ("event_type_nm", "event_desc"),
    "txtype_channel": ("tx_type_group", "channel_indicator_type"),
}
GLOBAL_SCORES = {"event_desc": "event_desc_stats_global", "event_type": "event_type_stats_global", "subchannel": "subchannel_stats_global", "pos": "pos_stats_global"}
SUB = "channel_indicator_sub_type"
NEEDS = [("sum",), *((s, k) for k in KEYS for s in ("n", "sum", "mean", "std")), *(("days", k) for k, v in KEYS.items() if v[4]), *(("n", *k) for k in COMBINATIONS.values())]


def category_features(df: DataFrame, stats: Stats | None = None) -> DataFrame:
    """56 columns; needs rolling_features().  A table that is missing gives a constant, never a missing column."""
    df, c, amount = with_history(df, NEEDS), F.col, F.col("amount_clean")
    new = {}
    for key, (spend, mean, std, count, days, score, share, recent, usage) in KEYS.items():
        new |= {spend: h("sum", key), mean: h("mean", key), std: h("std", key)}
        new[f"amount_zscore_given_{score}"] = (amount - h("mean", key)) / (h("std", key) + F.lit(X.EPS))
        new[recent] = X.over_eps(h("sum", key), c("cumulative_spend_90d"))
        if count:
            new[count] = h("n", key)
        if days:
            new[days] = h("days", key)
        if share:
            new[share] = h("sum", key) / (h("sum") + F.lit(X.EPS))
        if usage:
            new[usage] = h("n", key) / X.at_least("tx_count_lifetime", 1)
    new["channel_indicator_sub_type_log_count"] = X.log1p(h("n", SUB))
    new["is_new_subchannel_for_user"] = X.flag(h("n", SUB) == 0)
    new |= {f"is_new_{short}_combo": X.flag(h("n", *keys) == 0) for short, keys in COMBINATIONS.items()}
    return target_encodings(global_scores(df.withColumns(new), stats), stats)


def global_scores(df: DataFrame, stats: Stats | None) -> DataFrame:
    """Scores against the population's amounts, and the subchannel's frequency."""
    for short, table in GLOBAL_SCORES.items():
        out, (key, prefix) = f"amount_zscore_{short}_global", AMOUNTS[table]
        if stats and table in stats:
            score = (F.col("amount_clean") - X.nz(f"{prefix}_mean", 0.0)) / (X.nz(f"{prefix}_std", 1.0) + F.lit(X.EPS))
            df = look_up(df, stats[table], (key,)).withColumn(out, score).drop(f"{prefix}_mean", f"{prefix}_std")
        else:
            df = df.withColumn(out, F.lit(0.0))
    if stats and "subchannel_global" in stats:
        return look_up(df, stats["subchannel_global"], (SUB,)).withColumn("global_subchannel_freq", X.nz("global_subchannel_freq", 0))
    return df.withColumn("global_subchannel_freq", F.lit(0))


def target_encodings(df: DataFrame, stats: Stats | None) -> DataFrame:
    """Smoothed rates; a value without a label gets the global rate, or 0.5 without labels."""
    rate = "global_fraud_rate"
    if rate not in df.columns:
        df = df.crossJoin(F.broadcast(stats[rate])) if stats and rate in stats else df.withColumn(rate, F.lit(0.5))  # one row
    for table, (keys, out) in ENCODINGS.items():
        df = look_up(df, stats[table], keys).withColumn(out, F.coalesce(out, rate)) if stats and table in stats else df.withColumn(out, F.col(rate))
    return df.drop(rate)
