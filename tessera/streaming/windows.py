"""Event-time variants of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum per key and tumbling window; rows later than ``late`` are dropped."""
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    got = timed.groupBy(F.window("__t", width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return got.select(F.col("window.start").alias("start"), key, "n", "total")


def once(stream: DataFrame, time: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Resume-safe rows: each key once within the watermark."""
    return stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late).dropDuplicatesWithinWatermark([key]).drop("__t")


def gap_pairs(left: DataFrame, right: DataFrame, key: str, time: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Stream-stream pairs of a key at most ``seconds`` apart; right columns get the suffix ``_d``."""
    a = left.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    b = right.select(*[F.col(c).alias(f"{c}_d") for c in right.columns]).withColumn("__u", F.col(f"{time}_d").cast("timestamp")).withWatermark("__u", late)
    near = F.expr(f"__u >= __t - INTERVAL {seconds} SECONDS AND __u <= __t + INTERVAL {seconds} SECONDS")
    return a.join(b, (F.col(key) == F.col(f"{key}_d")) & near).drop("__t", "__u")
