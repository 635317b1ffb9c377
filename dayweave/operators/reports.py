"""What a report is made from: deviations shown, a reference cohort's baseline, states worth reporting, prompt rows, two verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.config import TRACKED, Thresholds
from dayweave.operators.baseline import is_reliable, pct_change, robust_z


def top_deviations(scored: DataFrame, most: int = 10, subject: str = "home_id", config: Thresholds = Thresholds()) -> DataFrame:
    """subject, day, rank, feature, robust_z: the features that deviate most; withheld (none) on unreliable days and without a baseline."""
    names = F.array(*[F.lit(t) for t in TRACKED])
    pairs = F.transform(F.arrays_zip(names.alias("f"), F.col("z").alias("z")), lambda p: F.struct((-F.abs(p["z"])).alias("k"), F.array_position(names, p["f"]).alias("i"), p["f"].alias("feature"), p["z"].alias("z")))
    top = F.slice(F.array_sort(F.filter(pairs, lambda p: p["z"].isNotNull())), 1, most)
    rows = scored.filter(is_reliable(config) & F.col("z").isNotNull()).select(subject, "day", F.posexplode(top).alias("i", "p"))
    return rows.select(subject, "day", (F.col("i") + 1).alias("rank"), "p.feature", F.round("p.z", 2).alias("robust_z"))


def against_cohort(days: DataFrame, cohorts: DataFrame, subject: str = "home_id", config: Thresholds = Thresholds()) -> DataFrame:
    """Days of subjects without a history (subject, cohort_id, day, TRACKED) held against a reference cohort's baseline.

    cohorts: cohort_id, baseline (array of median and mad by feature), n_days, reference_day; one row per cohort. A row per feature, with
    where the baseline and the subject's values come from.
    """
    j = days.join(cohorts, "cohort_id").withColumn("_v", F.array(*[F.col(t).cast("double") for t in TRACKED]))
    rows = j.select(subject, "cohort_id", "day", "reference_day", F.col("n_days").alias("baseline_days"), F.inline(F.arrays_zip(F.array(*[F.lit(t) for t in TRACKED]).alias("feature"), F.col("_v").alias("value"), F.col("baseline").alias("b"))))
    z = robust_z(F.col("value"), F.col("b")["median"], F.col("b")["mad"], config)
    return rows.select(subject, "cohort_id", "day", "reference_day", "baseline_days", "feature", "value", F.col("b")["median"].alias("median"), z.alias("z"), pct_change(F.col("value"), F.col("b")["median"]).alias("pct_change"), F.lit("reference_cohort").alias("baseline_provenance"), F.lit("measured").alias("subject_provenance"))


def latest_baselines(scored: DataFrame, subject: str = "home_id") -> DataFrame:
    """cohort_id, baseline, n_days, reference_day: the last day of each subject that has a baseline."""
    return scored.filter("z is not null").groupBy(F.col(subject).alias("cohort_id")).agg(F.max_by("baseline", "day").alias("baseline"), F.max_by("n_days", "day").alias("n_days"), F.max("day").alias("reference_day"))


def alerting_states(states: DataFrame, alerts: DataFrame, subject: str = "home_id") -> DataFrame:
    """subject, day, n_alerts: every state that alerts and, in order of day and subject, as many that don't (one at least)."""
    n = alerts.groupBy(subject, "day").agg(F.count("*").alias("n_alerts"))
    s = states.select(subject, "day").join(n, [subject, "day"], "left").withColumn("n_alerts", F.coalesce("n_alerts", F.lit(0)))
    loud, quiet = s.filter("n_alerts > 0"), s.filter("n_alerts = 0")
    # Quiet states before each day are counted by day, so that no task orders them all.
    per_day = quiet.groupBy("day").agg(F.count("*").alias("_n"))
    before = per_day.select("day", F.coalesce(F.sum("_n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row per day
    most = loud.agg(F.greatest(F.lit(1), F.count("*")).alias("_most"))
    ranked = quiet.withColumn("_r", F.row_number().over(Window.partitionBy("day").orderBy(subject))).join(F.broadcast(before), "day").join(F.broadcast(most))
    return loud.unionByName(ranked.filter(F.col("_before") + F.col("_r") <= F.col("_most")).select(subject, "day", "n_alerts"))


def prompt_rows(payload: DataFrame, subject: str = "home_id") -> DataFrame:
    """subject, day, template: the payload rows as a JSON list to copy figures from, in the payload's order; nulls are written out."""
    row = F.struct("place", F.struct("evidence_ref", "feature", F.col("observed_value").alias("value"), F.col("pct_change").alias("pct"), "direction", "observed_in_window", "baseline_comparable").alias("r"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"])
    return payload.groupBy(subject, "day").agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias("template"), F.count("*").alias("n_rows"))


def prompts(payload: DataFrame, instructions: str, subject: str = "home_id") -> DataFrame:
    """subject, day, prompt: instructions, then the template rows."""
    p = prompt_rows(payload, subject)
    return p.select(subject, "day", F.concat(F.lit(instructions + "\n\nFILLED TEMPLATE:\n"), "template", F.lit("\n\nJSON:")).alias("prompt"))


def report_heads(ranked: DataFrame, alerts: DataFrame, subject: str = "home_id") -> DataFrame:
    """subject, day, summary, escalate (some alert is urgent or worse), recommendation."""
    severe = alerts.groupBy(subject, "day").agg(F.max(F.col("severity").isin("urgent", "emergency")).alias("_severe"))
    n = ranked.groupBy(subject, "day").agg(F.count("*").alias("_n")).join(severe, [subject, "day"], "left")
    escalate = F.coalesce("_severe", F.lit(False))
    advice = F.when(escalate, "Contact the resident and review recent alerts.").otherwise("Continue routine monitoring.")
    return n.select(subject, "day", F.concat(F.col("_n").cast("string"), F.lit(" features reviewed for "), F.date_format("day", "yyyy-MM-dd"), F.lit(".")).alias("summary"), escalate.alias("escalate"), advice.alias("recommendation"))


def agreed(claims: DataFrame, verdicts: DataFrame, checks: list[str], keys: list[str]) -> DataFrame:
    """claims (keys, claim_id, faithful) with accepted: the id is given and unique, the claim faithful, and the other verifier, where it
    has a verdict on the id, passes every check."""
    unique = F.count("*").over(Window.partitionBy(*keys, "claim_id")) == 1
    other = verdicts.groupBy(*keys, "claim_id").agg(F.min(_all(checks)).alias("_other"))
    j = claims.withColumn("_unique", unique & (F.coalesce("claim_id", F.lit("")) != "")).join(other, [*keys, "claim_id"], "left")
    return j.withColumn("accepted", F.col("_unique") & F.coalesce("faithful", F.lit(False)) & F.coalesce("_other", F.lit(True))).drop("_unique", "_other")


def _all(checks: list[str]) -> Column:
    ok = F.lit(True)
    for c in checks:
        ok = ok & F.coalesce(F.col(c), F.lit(False))
    return ok


def top_classes(rows: DataFrame, posterior: str, names: list[str], most: int = 3) -> DataFrame:
    """rows with top: the names and shares of the most likely classes of each, the first of equals."""
    pairs = F.transform(F.col(posterior), lambda p, i: F.struct((-p).alias("k"), i.alias("i"), F.get(F.array(*[F.lit(n) for n in names]), i).alias("name"), F.round(p, 4).alias("share")))
    return rows.withColumn("top", F.transform(F.slice(F.array_sort(pairs), 1, most), lambda p: F.struct(p["name"].alias("name"), p["share"].alias("share"))))


def scenario_rollup(scenarios: DataFrame, *by: str) -> DataFrame:
    """by, recall, median_latency, control_false_per_100_days, n_scenarios, n_controls of scenarios (by, is_control, latency_days: null if
    the anomaly was never seen; n_relative: alerts of kinds that a baseline decides; n_days that can be scored).

    Recall and latency are of the anomalies, false alerts of the controls, in which nothing happens; a group without anomalies has recall
    0, one without control days 0 false alerts. Latencies are whole days, so the median keeps a count for each.
    """
    anomaly = ~F.col("is_control")
    s = scenarios.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(anomaly, F.col("latency_days").isNotNull().cast("double"))), F.lit(0.0)).alias("recall"), F.median(F.when(anomaly, F.col("latency_days"))).alias("median_latency"),
        F.coalesce(F.try_divide(100.0 * F.sum(F.when(F.col("is_control"), F.col("n_relative"))), F.sum(F.when(F.col("is_control"), F.col("n_days")))), F.lit(0.0)).alias("control_false_per_100_days"),
        F.count("*").alias("n_scenarios"), F.count_if("is_control").alias("n_controls"),
    )
    return s
