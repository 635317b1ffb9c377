"""Robust trailing baselines, deviations, drift and sustained change, one row per home and day.

A day's 18 tracked values travel as one array, so that history is gathered by two windows over days and not by 18 over features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.config import DRIFT, TRACKED, Thresholds
from dayweave.functions.arrays import mad, median


def is_reliable(config: Thresholds = Thresholds()) -> Column:
    return (F.col("observed_hours") >= config.least_hours) & (F.col("tracking_coverage") >= config.least_coverage)


def robust_z(value: Column, centre: Column, spread: Column, config: Thresholds = Thresholds()) -> Column:
    """0 at the median; else scaled by the MAD, which is at least a share of the median, and clamped."""
    floor = F.greatest(spread, config.mad_floor * F.abs(centre), F.lit(1e-9))
    z = 0.6745 * (value - centre) / floor
    return F.when(F.abs(value - centre) < 1e-12, 0.0).otherwise(F.greatest(F.lit(-config.z_clamp), F.least(F.lit(config.z_clamp), z)))


def pct_change(value: Column, centre: Column) -> Column:
    return F.when(F.abs(centre) < 1e-9, 0.0).otherwise(100 * (value - centre) / centre)


def direction(delta: Column) -> Column:
    return F.when(F.abs(delta) < 1e-9, "unchanged").when(delta > 0, "increase").otherwise("decrease")


def with_baselines(features: DataFrame, config: Thresholds = Thresholds(), subject: str = "home_id") -> DataFrame:
    """features with vals (tracked values), baseline (array of median and mad for each, null where there is no baseline), n_days,
    window_start, window_end, z (array), history_days.

    The window is the reliable days strictly before, of the same kind (weekend or not) within the longer span; with fewer than
    least_days of those, all reliable days of the pooled span; with fewer again, none.
    """
    f = features.withColumn("vals", F.array(*[F.col(c).cast("double") for c in TRACKED])).withColumn("_n", F.date_diff("day", F.lit("1970-01-01").cast("date"))).withColumn("_weekend", F.weekday("day") >= 5)
    row = F.when(is_reliable(config), F.struct("day", "vals"))
    kind = Window.partitionBy(subject, "_weekend").orderBy("_n")
    whole = Window.partitionBy(subject).orderBy("_n")
    seen = lambda w, span: F.collect_list(row).over(w.rangeBetween(-span, -1))
    f = f.withColumn("_pooled", seen(whole, config.window_days)).withColumn("history_days", F.least(F.count(F.lit(1)).over(whole.rowsBetween(Window.unboundedPreceding, 0)), F.lit(config.weekend_span + config.window_days)))
    if config.split_weekends:
        f = f.withColumn("_kind", F.when(F.col("_weekend"), seen(kind, config.weekend_span)).otherwise(seen(kind, config.weekday_span)))
        f = f.withColumn("_use", F.when(F.size("_kind") >= config.least_days, F.col("_kind")).when(F.size("_pooled") >= config.least_days, F.col("_pooled")))
    else:
        f = f.withColumn("_use", F.when(F.size("_pooled") >= config.least_days, F.col("_pooled")))
    use = F.col("_use")
    f = f.withColumn("_columns", F.when(use.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(len(TRACKED) - 1)), lambda i: F.transform(use, lambda d: F.get(d["vals"], i)))))
    f = f.withColumn("_medians", F.transform("_columns", median))
    stats = F.zip_with("_columns", "_medians", lambda xs, m: F.struct(m.alias("median"), mad(xs, m).alias("mad")))
    f = f.withColumn("baseline", stats).withColumn("n_days", F.coalesce(F.size(F.nullif(use, F.array().cast(f.schema["_use"].dataType))), F.lit(0)))
    f = f.withColumn("window_start", F.array_min(F.transform(use, lambda d: d["day"]))).withColumn("window_end", F.array_max(F.transform(use, lambda d: d["day"])))
    z = F.zip_with("vals", "baseline", lambda v, b: F.when(b.isNotNull(), robust_z(v, b["median"], b["mad"], config)))
    return f.withColumn("z", F.when(use.isNotNull(), z)).drop("_n", "_weekend", "_pooled", "_kind", "_use", "_columns", "_medians")


def observable(config: Thresholds = Thresholds()) -> Column:
    return F.lit(True) if not config.gate_absence else F.col("observed_hours") >= config.least_hours


def with_drift(scored: DataFrame, config: Thresholds = Thresholds(), subject: str = "home_id") -> DataFrame:
    """scored with drift: for each drift feature the statistic that the day reports, and what it carries on after a reset.

    S = max(0, decay * S - z - slack), held on unobserved days and where z is missing, kept at zero in warm-up; after a day on which the
    rules are evaluated and the mobility or social statistic has reached the limit, that statistic starts again at zero. The fold runs
    over one subject's days, in order.
    """
    names = DRIFT if config.social_drift else DRIFT[:-1]
    at = [TRACKED.index(n) for n in names]
    own = [n for n in names if n in ("mobility_index", "social_interaction_duration_s")]
    day = F.struct(
        "day",
        observable(config).alias("open"),
        (observable(config) & F.col("z").isNotNull()).alias("ruled"),
        (F.col("n_days") >= config.cusum_warmup).alias("warm"),
        F.array(*[F.get("z", i) for i in at]).alias("z"),
        F.struct(*[F.col(f"`{c}`") for c in scored.columns]).alias("row"),
    )
    # The whole row is folded along, so that what scored computes is neither joined nor computed again.
    folded = scored.groupBy(subject).agg(F.array_sort(F.collect_list(day)).alias("days"))
    kind = "struct<reported: array<double>, carried: array<double>>"
    zero = F.array(*[F.lit(0.0)] * len(names))
    start = F.struct(zero.alias("s"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(state, d):
        stat = lambda s, z: F.when(~d["open"] | z.isNull(), s).when(~d["warm"], 0.0).otherwise(F.greatest(F.lit(0.0), config.cusum_decay * s - z - config.cusum_slack))
        reported = F.zip_with(state["s"], d["z"], stat)
        carried = F.transform(reported, lambda s, i: F.when(d["ruled"] & i.isin(*[names.index(n) for n in own]) & (s >= config.cusum_limit), 0.0).otherwise(s))
        return F.struct(carried.alias("s"), F.concat(state["out"], F.array(F.struct(reported.alias("reported"), carried.alias("carried")))).alias("out"))

    found = folded.withColumn("_s", F.aggregate("days", start, step, lambda s: s["out"]))
    return found.select(F.inline(F.zip_with("days", "_s", lambda d, s: F.struct(d["row"].alias("row"), s.alias("s"))))).select("row.*", "s.reported", "s.carried")


def with_sustained(scored: DataFrame, config: Thresholds = Thresholds(), subject: str = "home_id") -> DataFrame:
    """scored with declined (the last sustained_days observable days all had a mobility z below the limit) and shifted (for each tracked
    feature: the last routine_days observable days were all beyond the limit on the same side)."""
    s = scored.withColumn("_open", observable(config))
    w = Window.partitionBy(subject, "_open").orderBy("day")
    mobility = F.coalesce(F.get("z", TRACKED.index("mobility_index")), F.lit(0.0)) < -config.z_limit
    low = F.sum(mobility.cast("int")).over(w.rowsBetween(-(config.sustained_days - 1), 0))
    past = F.collect_list(F.coalesce("z", F.array(*[F.lit(None).cast("double")] * len(TRACKED)))).over(w.rowsBetween(-(config.routine_days - 1), 0))
    side = lambda zs, i, sign: F.forall(zs, lambda z: F.coalesce(sign * F.get(z, i) > config.z_limit, F.lit(False)))
    s = s.withColumn("declined", F.col("_open") & (low == config.sustained_days)).withColumn("_past", past)
    enough = F.size("_past") >= config.routine_days
    shifted = F.transform(F.sequence(F.lit(0), F.lit(len(TRACKED) - 1)), lambda i: F.lit(config.routine_days <= 1) | (F.col("_open") & enough & (side(F.col("_past"), i, 1) | side(F.col("_past"), i, -1))))
    return s.withColumn("shifted", shifted).drop("_open", "_past")


def long_baselines(scored: DataFrame, subject: str = "home_id") -> DataFrame:
    """Long form: subject, day, feature, median, mad, n_days, window_start, window_end, value, z; days with a baseline only."""
    rows = scored.filter("z is not null").select(subject, "day", "n_days", "window_start", "window_end", F.explode(F.arrays_zip(F.array(*[F.lit(t) for t in TRACKED]).alias("feature"), F.col("vals").alias("value"), F.col("baseline").alias("b"), F.col("z").alias("z"))).alias("r"))
    return rows.select(subject, "day", "r.feature", F.col("r.b.median").alias("median"), F.col("r.b.mad").alias("mad"), "n_days", "window_start", "window_end", "r.value", "r.z")
