"""Features of a transaction alone: calendar, amount, type groups, and rule flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import expr as X

#: Public holidays with a fixed date, as month * 100 + day.
HOLIDAYS = (101, 102, 103, 104, 105, 106, 107, 108, 223, 308, 501, 509, 612, 1104)
#: Event descriptions by risk, and the event type of the near-certain pairs.
VERY_HIGH_RISK = (60, 41, 27, 73, 103)
HIGH_RISK = (68, 29, 31, 119, 113, 109, 37)
LOW_RISK = (51, 5, 4, 69, 97, 32)
NEAR_CERTAIN_TYPE, NEAR_CERTAIN = 14, (60, 41, 73)
RISKY_CHANNEL, RISKY_SUBCHANNEL, P2P_SUBCHANNEL = 6, 11, 5


def parsed_time(df: DataFrame) -> DataFrame:
    """event_dttm as a timestamp without zone (null where a text is none), and its microseconds."""
    kind = df.schema["event_dttm"].dataType
    ts = F.col("event_dttm")
    if isinstance(kind, T.StringType):
        df = df.withColumn("event_dttm", F.try_to_timestamp(ts).cast("timestamp_ntz"))
    elif not isinstance(kind, T.TimestampNTZType):
        df = df.withColumn("event_dttm", ts.cast("timestamp_ntz"))
    return df.withColumn(X.US, X.micros("event_dttm"))


def tx_type_group() -> Column:
    """0 without an amount, 1 with a merchant code, else 2."""
    card = F.col("mcc_code").isNotNull() & (F.col("mcc_code") != "")
    return F.when(F.col("operaton_amt").isNull(), 0).when(card, 1).otherwise(2)


def transaction_features(df: DataFrame) -> DataFrame:
    """25 columns, and amount_clean."""
    df = parsed_time(df).withColumns({"amount_clean": X.nz("operaton_amt", 0.0), "tx_type_group": tx_type_group()})
    ts, amount, group, kind = F.col("event_dttm"), F.col("amount_clean"), F.col("tx_type_group"), F.col("event_type_nm")
    hour, day, weekday = F.hour(ts), F.dayofmonth(ts), F.weekday(ts) + 1
    whole = lambda n: X.flag(amount % n == 0)
    return df.withColumns(
        {
            "hour": hour,
            "day_of_week": weekday,
            "day_of_month": day,
            "week_of_year": F.weekofyear(ts),
            "hour_of_day": hour,
            "is_weekend": X.flag(weekday >= 6),
            "is_night": X.flag(hour <= 6),
            "is_working_hour": X.flag(hour.between(9, 18)),
            "minutes_from_midnight": hour * 60 + F.minute(ts),
            "log_amount": X.log1p(amount),
            "amount_abs": F.abs(amount),
            "amount_round_100": whole(100),
            "amount_round_1000": whole(1000),
            "amount_is_integer": whole(1),
            "amount_missing_flag": X.flag(F.col("operaton_amt").isNull()),
            "amount_currency_mismatch_flag": X.flag(F.col("currency_iso_cd").isNull()),
            "amount_usd_normalized": F.lit(None).cast("double"),
            "is_month_start": X.flag(day.isin(1, 2, 3)),
            "is_month_end": X.flag(day.isin(28, 29, 30, 31)),
            "is_payday": X.flag(day.isin(1, 15, 25)),
            "is_holiday": X.flag((F.month(ts) * 100 + day).isin(*HOLIDAYS)),
            "model_group": F.when((group == 0) & (kind == 7), 0).when((group == 0) & (kind != 7), 1).when(group == 1, 2).otherwise(3),
            "amount_card": F.when(group == 1, amount).otherwise(0.0),
            "amount_p2p": F.when(group == 2, amount).otherwise(0.0),
        }
    )


def risk_features(df: DataFrame) -> DataFrame:
    """Six rule flags; null where the rule's input is null and decides."""
    desc, kind, channel, sub, group = (F.col(c) for c in ("event_desc", "event_type_nm", "channel_indicator_type", "channel_indicator_sub_type", "tx_type_group"))
    return df.withColumns(
        {
            "is_very_high_risk_desc": X.flag(desc.isin(*VERY_HIGH_RISK)),
            "is_high_risk_desc": X.flag(desc.isin(*HIGH_RISK)),
            "is_low_risk_desc": X.flag(desc.isin(*LOW_RISK)),
            "is_high_risk_channel": X.flag((channel == RISKY_CHANNEL) | (sub == RISKY_SUBCHANNEL)),
            "is_p2p_danger_channel": X.flag((group == 2) & (sub == P2P_SUBCHANNEL)),
            "is_near_certain_fraud_pair": X.flag((kind == NEAR_CERTAIN_TYPE) & desc.isin(*NEAR_CERTAIN)),
        }
    )
