"""A Spark session with the settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic, adaptive execution with skew joins.  On a cluster leave master and shuffle_partitions to its defaults."""
    builder = SparkSession.builder.appName("ledgerlens")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # else each column function looks up its call site, which takes longer than all other planning
        "spark.sql.windowExec.buffer.in.memory.threshold": "65536",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings | conf).getOrCreate()


def fmt_seconds(seconds: float) -> str:
    """A duration as h:mm:ss, or m:ss below an hour."""
    whole = int(round(seconds))
    hours, rest = divmod(whole, 3600)
    return f"{hours}:{rest // 60:02d}:{rest % 60:02d}" if hours else f"{rest // 60}:{rest % 60:02d}"
