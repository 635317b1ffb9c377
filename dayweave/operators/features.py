"""Daily features from activity segments (one shuffle by home and day)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.config import SEDENTARY, Thresholds

KEYS = ("home_id", "day")


def seconds(duration: Column) -> Column:
    """The sum of durations, in whole microseconds while it is summed: the same in whatever order, so that halves round alike."""
    return F.sum(F.round(duration * 1_000_000).cast("long")) / 1_000_000


def mobility_index() -> Column:
    return 0.4 * F.col("walking_duration_s") / 60 + 0.3 * F.col("sit_to_stand_count") + 0.3 * F.col("room_transitions")


def sedentary_ratio() -> Column:
    still = F.col("sitting_duration_s") + F.col("lying_duration_s")
    return F.when(still + F.col("standing_duration_s") > 0, still / (still + F.col("standing_duration_s"))).otherwise(0.0)


def timeline(segments: DataFrame, config: Thresholds = Thresholds(), subject: str = "resident") -> DataFrame:
    """Segments with own (is it the subject's), moved (room changed), new_meal and island (of inactivity), in order of start.

    Everything is derived within (home, day, own) partitions of one exchange by (home, day).
    """
    rows = segments.withColumn("own", F.col("role") == subject).repartition(*KEYS)
    w = Window.partitionBy(*KEYS, "own").orderBy("start_us", "segment_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    still = F.col("activity_name").isin(*SEDENTARY)
    eats = F.col("activity_name") == "eating"
    last_meal = F.last(F.when(eats, F.col("end_us")), ignorenulls=True).over(before)
    gap = F.coalesce(F.col("start_us") - F.lag("end_us").over(w), F.lit(0))
    room = lambda c: F.when(c != "", c)
    return (
        rows.withColumn("moved", F.coalesce(room(F.col("room")) != room(F.lag("room").over(w)), F.lit(False)))
        .withColumn("new_meal", eats & (last_meal.isNull() | (F.col("start_us") - last_meal > int(config.meal_gap_s * 1e6))))
        .withColumn("_break", F.when(~still | (gap > int(config.bridge_s * 1e6)), 1).otherwise(0))
        .withColumn("island", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("still", still)
        .drop("_break")
    )


def daily_features(segments: DataFrame, days: DataFrame, config: Thresholds = Thresholds(), subject: str = "resident") -> DataFrame:
    """One row per row of days: all features of the day's segments, zero where there are none; mobility_index and sedentary_ratio."""
    t = timeline(segments, config, subject)
    own = F.col("own")
    took = lambda a: F.coalesce(seconds(F.when(own & (F.col("activity_name") == a), F.col("duration_s"))), F.lit(0.0))
    times = lambda a: F.count(F.when(own & (F.col("activity_name") == a), 1))
    mean = lambda a: F.coalesce(seconds(F.when(own & (F.col("activity_name") == a), F.col("duration_s"))) / F.count_if(own & (F.col("activity_name") == a) & F.col("duration_s").isNotNull()), F.lit(0.0))
    island = t.groupBy(*KEYS, "own", "island").agg(
        seconds(F.when(F.col("still"), F.col("duration_s"))).alias("block_s"),
        F.sum(F.when(own, F.col("moved").cast("long"))).alias("moves"),
        F.sum(F.when(own, F.col("new_meal").cast("long"))).alias("meals"),
    )
    blocks = island.groupBy(*KEYS).agg(
        F.coalesce(F.max(F.when(own, F.col("block_s"))), F.lit(0.0)).alias("longest_inactive_block_s"),
        F.coalesce(F.sum("moves"), F.lit(0)).alias("room_transitions"),
        F.coalesce(F.sum("meals"), F.lit(0)).alias("meal_events"),
    )
    sums = t.groupBy(*KEYS).agg(
        took("walking").alias("walking_duration_s"),
        times("walking").alias("walking_bouts"),
        mean("walking").alias("mean_bout_duration_s"),
        times("standing_up").alias("sit_to_stand_count"),
        mean("standing_up").alias("mean_sit_to_stand_duration_s"),
        took("sitting").alias("sitting_duration_s"),
        took("lying_down").alias("lying_duration_s"),
        took("standing").alias("standing_duration_s"),
        took("eating").alias("eating_duration_s"),
        times("drinking").alias("drinking_events"),
        took("cooking_food_prep").alias("cooking_duration_s"),
        times("taking_medication").alias("medication_events"),
        took("watching_tv").alias("tv_duration_s"),
        took("reading").alias("reading_duration_s"),
        times("using_phone").alias("phone_events"),
        took("interacting_with_person").alias("social_interaction_duration_s"),
        F.count_distinct(F.when(~own & F.col("role").isin("visitor", "carer"), F.col("track_id"))).alias("visitor_count"),
        took("cleaning_housework").alias("housework_duration_s"),
        times("falling").alias("fall_events"),
        F.coalesce(F.max(F.when(own & (F.col("activity_name") == "fallen_on_ground"), F.col("duration_s"))), F.lit(0.0)).alias("max_post_fall_immobility_s"),
    )
    out = days.join(sums, list(KEYS), "left").join(blocks, list(KEYS), "left").na.fill(0)
    return out.withColumn("mobility_index", mobility_index()).withColumn("sedentary_ratio", sedentary_ratio())


def observed_hours(frames: DataFrame, keys: list[str], time_us: str = "time_us", longest_s: float = 5.0) -> DataFrame:
    """Hours seen per key: gaps between consecutive frames, those of at most longest_s."""
    w = Window.partitionBy(*keys).orderBy(time_us)
    gap = (F.col(time_us) - F.lag(time_us).over(w)) / 1_000_000
    return frames.withColumn("_gap", gap).groupBy(*keys).agg((F.coalesce(F.sum(F.when(F.col("_gap") <= longest_s, F.col("_gap"))), F.lit(0.0)) / 3600).alias("observed_hours"))
