"""Transactions and labels derived from the driver's events and orders tables (rules in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CUTOFF, END, TRAIN_START = "2024-01-21", "2024-01-26", "2024-01-08"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def transactions(raw: DataFrame) -> DataFrame:
    """The 24 columns of a transaction."""
    k, user = F.col("k"), F.col("user_id").cast("int")
    hit = lambda n, r=0: k % n == r
    text = lambda c: c.cast("string")
    null = F.lit(None)
    paid = ~F.col("event_type").isin("view", "signup")
    types = {"view": 7, "click": 3, "purchase": 14, "signup": 9, "error": 21}
    code = F.create_map(*(F.lit(x) for pair in types.items() for x in pair))[F.col("event_type")]
    df = raw.withColumn("k", _k())
    return df.select(
        F.col("user_id").alias("customer_id"),
        "event_id",
        F.when(k != 0, F.col("user_id") * 1000 + F.dayofmonth("ts")).alias("session_id"),
        F.col("ts").alias("event_dttm"),
        code.alias("event_type_nm"),
        k.alias("event_desc"),
        F.when(~hit(23), k % 7).alias("channel_indicator_type"),
        F.when(hit(10, 9), 11).when(hit(10, 8), 5).otherwise((k * 3) % 12).alias("channel_indicator_sub_type"),
        F.when(paid, F.when(hit(10), F.floor("value").cast("double") * 100).otherwise(F.col("value") * 20)).alias("operaton_amt"),
        F.when(hit(13), null).when(hit(13, 1), 840).otherwise(643).cast("int").alias("currency_iso_cd"),
        F.when(hit(29), "").when((F.col("event_type") == "purchase") | ((F.col("event_type") == "error") & hit(2)), F.concat(F.lit("5"), text(k % 20))).alias("mcc_code"),
        F.when(~hit(17), k % 5).alias("pos_cd"),
        F.when(hit(31), null).otherwise(user % 12 + F.when(hit(19), k).otherwise(0)).cast("int").alias("timezone"),
        F.when(hit(9), (user + 1) % 4).otherwise(user % 4).alias("operating_system_type"),
        F.when(hit(6), "en").otherwise("ru").alias("accept_language"),
        F.when(hit(37), null).when(hit(8), "en").otherwise("ru").alias("browser_language"),
        F.when(hit(43), null).when(hit(41), "unknown").otherwise(F.concat(text(k), F.lit(" %"))).alias("battery"),
        F.concat(F.lit("v"), text(user % 5), F.lit("."), text(k % 3)).alias("device_system_version"),
        F.when(~hit(47), F.concat(text(720 + (k % 3) * 360), F.lit("x"), text(1280 + (k % 4) * 320))).alias("screen_size"),
        F.when(hit(25), null).when(hit(12), "true").otherwise("false").alias("developer_tools"),
        F.when(hit(15), "true").otherwise("false").alias("compromised"),
        F.when(hit(16), 1).when(hit(2, 1), null).otherwise(0).cast("int").alias("web_rdp_connection"),
        F.when(hit(11), 1).when(hit(11, 1), 2).when(hit(3), null).otherwise(0).cast("int").alias("phone_voip_call_state"),
        F.when(F.col("ts") >= F.lit(TRAIN_START).cast("timestamp_ntz"), 1).otherwise(0).alias("is_train"),
    )


def event_labels(raw: DataFrame) -> DataFrame:
    """(customer_id, event_id, target) of every fifth event id."""
    df = raw.filter(F.col("event_id") % 5 == 0).withColumn("k", _k())
    bad = (F.col("k") >= 80) | ((F.col("event_type") == "error") & (F.col("k") % 4 == 0))
    return df.select(F.col("user_id").alias("customer_id"), "event_id", F.when(bad, 1).otherwise(0).alias("target"))


def pseudo_score(raw: DataFrame) -> DataFrame:
    """(event_id, score): a model-free score with many ties."""
    return raw.select("event_id", (((F.col("event_id") * 7919 + _k() * 104729) % 1000) / 1000.0).alias("score"))


def order_transactions(orders: DataFrame) -> DataFrame:
    """Orders as transactions: years of history, with ties in time."""
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return orders.select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderdate").alias("event_dttm"),
        F.col("o_totalprice").alias("operaton_amt"),
        status.alias("event_type_nm"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("event_desc"),
    )
