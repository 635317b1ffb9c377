"""Domain views over the driver's tables: activity segments and observed days from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.config import ACTIVITIES

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, `{col}`)")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: segment_id, home_id, track_id, role, activity_id, activity_name, day, start_us, end_us, duration_s, room, confidence."""
    names = F.array(*[F.lit(a) for a in ACTIVITIES])
    e = table(spark, sf_dir, "events").filter("user_id is not null and ts is not null")
    activity = F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(len(ACTIVITIES)))
    took = F.round((F.col("value") + 1) * 1_000_000).cast("long")
    return e.select(
        F.col("event_id").alias("segment_id"),
        (F.col("user_id") % 10).alias("home_id"),
        F.col("user_id").alias("track_id"),
        F.when(F.col("user_id") % 7 == 3, "visitor").when(F.col("user_id") % 7 == 5, "carer").otherwise("resident").alias("role"),
        activity.alias("activity_id"),
        F.get(names, activity).alias("activity_name"),
        F.to_date("ts").alias("day"),
        micros("ts").alias("start_us"),
        (micros("ts") + took).alias("end_us"),
        (took / 1_000_000).alias("duration_s"),
        F.col("event_type").alias("room"),
        (F.pmod(F.col("event_id") * 7919, F.lit(100)) / 100).alias("confidence"),
    )


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """home_id, day, observed_hours (some days are cut to three tenths, as in an outage) and tracking_coverage."""
    e = table(spark, sf_dir, "events").filter("user_id is not null and ts is not null").select((F.col("user_id") % 10).alias("home_id"), F.to_date("ts").alias("day"), F.hour("ts").alias("h"))
    hours = F.count_distinct("h") * F.when((F.col("home_id") + F.dayofmonth("day")) % 13 == 0, 0.3).otherwise(1.0)
    return e.groupBy("home_id", "day").agg(hours.alias("observed_hours"), F.least(F.lit(1.0), F.count("*") / 20).alias("tracking_coverage"))
