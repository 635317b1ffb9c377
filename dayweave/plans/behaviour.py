"""The daily behaviour pipeline as queries: segments, features, baselines, drift, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.config import DRIFT, Thresholds
from dayweave.operators.alerts import alerts
from dayweave.operators.baseline import long_baselines, with_baselines, with_drift, with_sustained
from dayweave.operators.features import daily_features
from dayweave.plans.behaviour_sql import FEATURE_COLUMNS
from dayweave.sources import domain


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_features(domain.segments(spark, sf_dir), domain.days(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str, config: Thresholds = Thresholds()) -> DataFrame:
    """Features with baselines, z, drift and sustained change."""
    return with_sustained(with_drift(with_baselines(features(spark, sf_dir), config), config), config)


def q_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.segments(spark, sf_dir).drop("confidence")


def q_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("home_id", "day", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in FEATURE_COLUMNS])


def q_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return long_baselines(with_baselines(features(spark, sf_dir))).select("home_id", "day", "feature", r("median"), r("mad"), F.col("n_days").cast("long").alias("n_days"), "window_start", "window_end", r("value"), r("z"))


def q_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in DRIFT]).alias("feature")
    d = with_drift(with_baselines(features(spark, sf_dir)))
    d = d.select("home_id", "day", F.explode(F.arrays_zip(names, F.col("reported"), F.col("carried"))).alias("r"))
    return d.select("home_id", "day", "r.feature", F.round("r.reported", 6).alias("reported"), F.round("r.carried", 6).alias("carried"))


def q_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alerts(scored(spark, sf_dir))
    return a.select("home_id", "day", "kind", "severity", "rule_name", "rule_expression", F.size("evidence").alias("n_evidence"), "alert_id")


QUERIES = {"segments": q_segments, "daily_features": q_features, "baselines": q_baselines, "drift": q_drift, "alerts": q_alerts}
