"""Pseudo-cores from an event table: one series for each event type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORIGIN_MICROS = 1_704_067_200_000_000  # 2024-01-01 00:00 UTC
#: Events are put in order within an hour; what crosses its borders comes from a table of the hours.
HOUR_MICROS = 3_600_000_000
SAMPLES = ["site", "sample_no", "cm_top", "cm_bot", "age_top", "age_bot", "vol", "cnt"]


def pseudo_cores(events: DataFrame) -> DataFrame:
    """events: event_id, ts, event_type, value. Returns the columns of SAMPLES.

    Ages are minutes since ORIGIN, depths half a unit a sample; volumes are forced to 0
    (missing) where event_id is a multiple of 97, but never at the ends of a series.
    """
    x = events.select(
        F.col("event_type").alias("site"), "event_id", F.col("value").alias("v"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
    ).where("site is not null and micros is not null").withColumn("hour", F.floor(F.col("micros") / HOUR_MICROS))
    by_hour, by_time = Window.partitionBy("site").orderBy("hour"), Window.partitionBy("site", "hour").orderBy("micros", "event_id")
    hours = x.groupBy("site", "hour").agg(F.count(F.lit(1)).alias("k"), F.min("micros").alias("least"))
    hours = hours.select("site", "hour", (F.sum("k").over(by_hour) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy("site")).alias("n"), F.lead("least").over(by_hour).alias("beyond"))
    x = x.withColumns({"no": F.row_number().over(by_time), "next": F.lead("micros").over(by_time)}).join(hours, ["site", "hour"])
    x = x.withColumns({"sample_no": (F.col("before") + F.col("no")).cast("int"), "next": F.coalesce("next", "beyond")})
    x = x.where("next is not null")  # the last event only ends the one before
    gap = (F.col("event_id") % 97 == 0) & (F.col("sample_no") > 1) & (F.col("sample_no") < F.col("n") - 1)
    return x.select(
        "site", "sample_no", (0.5 * (F.col("sample_no") - 1)).alias("cm_top"), (0.5 * F.col("sample_no")).alias("cm_bot"),
        ((F.col("micros") - ORIGIN_MICROS) / 60e6).alias("age_top"), ((F.col("next") - ORIGIN_MICROS) / 60e6).alias("age_bot"),
        F.when(gap, 0.0).otherwise((1 + F.col("event_id") % 3).cast("double")).alias("vol"), F.floor(F.col("v") / 10).cast("double").alias("cnt"),
    )
