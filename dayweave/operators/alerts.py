"""Alert rules over scored days: one array of alerts per day, exploded; no joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayweave.config import DRIFT, OWN_RULE, TRACKED, Thresholds
from dayweave.operators.baseline import observable, pct_change, robust_z


def evidence(features: list[str], config: Thresholds = Thresholds()) -> Column:
    """Evidence rows for features of the day; without a baseline the reference is zero, of one day."""

    def one(name: str) -> Column:
        value = F.col(name).cast("double")
        b = F.get("baseline", TRACKED.index(name)) if name in TRACKED else None
        has = b.isNotNull() if b is not None else F.lit(False)
        centre = F.when(has, b["median"]).otherwise(0.0) if b is not None else F.lit(0.0)
        spread = F.when(has, b["mad"]).otherwise(0.0) if b is not None else F.lit(0.0)
        return F.struct(
            F.concat_ws(":", F.lit("feat"), F.lit(name), F.date_format("day", "yyyy-MM-dd")).alias("ref"),
            F.lit(name).alias("feature"),
            value.alias("observed"),
            centre.alias("baseline_median"),
            robust_z(value, centre, spread, config).alias("robust_z"),
            pct_change(value, centre).alias("pct_change"),
            (value - centre).alias("delta"),
            F.when(has, F.col("n_days")).otherwise(1).alias("baseline_n_days"),
        )

    return F.array(*[one(f) for f in features])


def alerts(scored: DataFrame, config: Thresholds = Thresholds(), subject: str = "home_id") -> DataFrame:
    """One row per alert: subject, day, alert_id (a hash of subject, day and rule), kind, severity, rule_name, rule_expression, evidence.

    scored comes from with_baselines, with_drift and with_sustained.
    """
    z = lambda name: F.coalesce(F.get("z", TRACKED.index(name)), F.lit(0.0))
    drift = lambda name: F.get("reported", DRIFT.index(name)) if config.social_drift or name != DRIFT[-1] else F.lit(0.0)
    t, h = config.z_limit, config.cusum_limit
    shown = lambda *names: evidence(list(names), config)

    def alert(when: Column, kind: str, severity: str, expression: Column | str, shows: Column, rule: str | None = None) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(rule or kind).alias("rule_name"), (F.lit(expression) if isinstance(expression, str) else expression).alias("rule_expression"), shows.alias("evidence")))

    gate = observable(config) & F.col("z").isNotNull()
    mobile, social = drift("mobility_index") >= h, drift("social_interaction_duration_s") >= h
    alone = (z("social_interaction_duration_s") < -t) & (F.col("visitor_count") == 0)
    found = [
        alert(F.col("fall_events") > 0, "fall_detected", "urgent", "fall_events > 0", shown("fall_events")),
        alert(F.col("max_post_fall_immobility_s") >= config.post_fall_s, "fall_no_recovery", "emergency", f"max_post_fall_immobility_s >= {config.post_fall_s:.0f}", shown("max_post_fall_immobility_s")),
        alert(F.col("longest_inactive_block_s") >= config.inactivity_s, "prolonged_inactivity", "urgent", f"longest_inactive_block_s >= {config.inactivity_s:.0f}", shown("longest_inactive_block_s")),
        alert(gate & ((F.col("meal_events") < config.least_meals) | (z("meal_events") < -t)), "meal_skipped", "advisory", f"meal_events < {config.least_meals} or robust_z(meal_events) < -{t}", shown("meal_events")),
        alert(gate & (F.col("drinking_events") < config.least_drinks), "hydration_low", "advisory", f"drinking_events < {config.least_drinks}", shown("drinking_events")),
        alert(gate & (F.get("baseline", TRACKED.index("medication_events"))["median"] >= 1) & (F.col("medication_events") == 0), "medication_missed", "urgent", "medication_events == 0 while baseline median >= 1", shown("medication_events")),
        alert(
            gate & (F.col("declined") | mobile), "mobility_decline", "urgent",
            F.when(F.col("declined"), f"robust_z(mobility_index) < -{t} for {config.sustained_days} consecutive days").otherwise(f"CUSUM(mobility_index) >= {h}"),
            shown("mobility_index", "walking_duration_s", "sit_to_stand_count", "room_transitions"),
        ),
        alert(
            gate & (alone | social), "social_isolation", "advisory",
            F.when(social, f"CUSUM(social_interaction_duration_s) >= {h}").otherwise(f"robust_z(social_interaction_duration_s) < -{t} and visitor_count == 0"),
            shown("social_interaction_duration_s"),
        ),
        alert(gate & (F.abs(z("lying_duration_s")) > t), "sleep_disruption", "advisory", f"|robust_z(lying_duration_s)| > {t}", shown("lying_duration_s")),
        *[
            alert(gate & (F.abs(z(n)) > t) & F.get("shifted", TRACKED.index(n)), "routine_deviation", "info", f"|robust_z({n})| > {t} for {config.routine_days} consecutive days", shown(n), f"routine_deviation:{n}")
            for n in TRACKED
            if n not in OWN_RULE
        ],
    ]
    rows = scored.select(subject, "day", F.explode(F.array_compact(F.array(*found))).alias("a")).select(subject, "day", "a.*")
    return rows.withColumn("alert_id", F.sha2(F.concat_ws("|", F.col(subject).cast("string"), F.date_format("day", "yyyy-MM-dd"), "rule_name"), 256))
