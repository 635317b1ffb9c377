"""Claim queries over the behaviour state, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.config import TRACKED
from dayweave.functions.text import DOWN, UP, numbers, said_direction
from dayweave.operators import claims as C
from dayweave.operators import responses as R
from dayweave.operators.alerts import alerts
from dayweave.plans.behaviour import scored
from dayweave.plans.behaviour_sql import ALERTS
from dayweave.sources.domain import table
from dayweave.sources.shared import staged


def _state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = staged(scored(spark, sf_dir), "state")  # alerts, evidence and payload all read the state
    return s, alerts(s)


def q_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.evidence_index(*_state(spark, sf_dir))
    r = lambda c: F.round(c, 6).alias(c)
    return e.select("home_id", "day", "feature", "source", "ref", r("observed"), r("baseline_median"), r("robust_z"), r("pct_change"), r("delta"), F.col("baseline_n_days").cast("long").alias("baseline_n_days"))


def q_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.payload(scored(spark, sf_dir)).drop("place", "history_days")


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s, a = _state(spark, sf_dir)
    return s, a, C.ranked(C.payload(s), a)


def q_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.faithful_claims(_ranked(spark, sf_dir)[2])


def q_corrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.corrupted_claims(_ranked(spark, sf_dir)[2], 0.5)
    return c.withColumn("claimed_value", F.round("claimed_value", 6))


def _all_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, a, r = _ranked(spark, sf_dir)
    both = C.faithful_claims(r).withColumn("injected", F.lit(None).cast("string")).withColumn("arm", F.lit("faithful")).unionByName(C.corrupted_claims(r, 0.5).withColumn("arm", F.lit("corrupted")))
    return C.verify(both, C.evidence_index(s, a))


def q_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_verified(spark, sf_dir).select("arm", "home_id", "day", "claim_id", "injected", "ref_exists", "value_matches", "pct_matches", "direction_consistent", "prose_quoted", "faithful")


def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.summary(_all_verified(spark, sf_dir), "arm", "injected")
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in s.dtypes])


def q_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms side by side: rates, and the z-test of their difference."""
    v = _all_verified(spark, sf_dir).groupBy().agg(*[f(F.col("arm") == a).alias(f"{n}_{a}") for a in ("faithful", "corrupted") for n, f in (("n", F.count_if), ("k", lambda c: F.count_if(c & ~F.col("faithful"))))])
    z, p = C.two_proportion_z(F.col("k_faithful"), F.col("n_faithful"), F.col("k_corrupted"), F.col("n_corrupted"))
    return v.select("*", F.round(z, 6).alias("z"), F.round(p, 4).alias("p_value"))


def q_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.report_lines(_all_verified(spark, sf_dir).filter("arm = 'corrupted'"), "home_id", "day")


def q_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrupted claims written as loose responses, read back, repaired, checked and verified."""
    s, a, r = _ranked(spark, sf_dir)
    raw = R.response_text(C.corrupted_claims(r, 0.5), "home_id", "day")
    out = R.assembled(raw, C.evidence_index(s, a), "home_id", "day")
    return out.select("home_id", "day", "n_claims", "n_rejected", "n_withheld", "summary")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms written as responses, some cut off, some with references or directions that no repair mends, read back."""
    s, a, r = _ranked(spark, sf_dir)
    both = C.faithful_claims(r).withColumn("arm", F.lit("faithful")).unionByName(C.corrupted_claims(r, 0.5).drop("injected").withColumn("arm", F.lit("corrupted")))
    raw, kind = R.response_text(both, "home_id", "day", "arm"), (F.col("home_id") + F.dayofmonth("day")) % 5
    told = F.when(kind == 0, F.substring("raw_response", 1, 40)).when(kind == 1, F.replace("raw_response", F.lit("`feat:"), F.lit("`fact:"))).when(kind == 2, F.regexp_replace("raw_response", '"direction":"[A-Za-z]+"', '"direction":"sideways"')).otherwise(F.col("raw_response"))
    return R.outcomes(raw.withColumn("raw_response", told), C.evidence_index(s, a), "home_id", "day", "arm")


def q_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _outcomes(spark, sf_dir)
    return o.select("home_id", "day", "arm", "parse_failed", "n_emitted", "n_claims", "n_repaired", "n_dropped", "n_faithful", F.size("rejections").alias("n_rejections"))


def q_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.run_summary(_outcomes(spark, sf_dir), "arm")
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.array_join(c, "; ").alias(c) if c == "top_causes" else c for c, t in s.dtypes])


def q_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and direction of every conversation turn and every claim-like document line."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", "text", F.lit("walking fell to 1,800 s, -5k"), F.col("turn").cast("string")).alias("text"))
    n = numbers(F.col("text"))
    return t.select("conv_id", "turn", F.size(n).cast("long").alias("n_numbers"), F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 6).alias("total"), said_direction(F.col("text")).alias("said"))


QUERIES = {"evidence": q_evidence, "report_payload": q_payload, "faithful_claims": q_claims, "corrupted_claims": q_corrupted, "verified_claims": q_verified, "verification_summary": q_summary, "arm_comparison": q_arms, "report_lines": q_report_lines, "assembled_reports": q_reports, "prose_numbers": q_numbers, "report_outcomes": q_outcomes, "run_summary": q_run_summary}

# ---- SQL ------------------------------------------------------------------------------------------------------

_REPORT = ", ".join(f"'{n}'" for n in C.REPORTABLE if n in TRACKED)
_PLACE = f"list_position([{_REPORT}], s.feature)"
_RULE_FEATURE = (
    "CASE rule_name WHEN 'fall_detected' THEN ['fall_events'] WHEN 'fall_no_recovery' THEN ['max_post_fall_immobility_s'] WHEN 'prolonged_inactivity' THEN ['longest_inactive_block_s'] "
    "WHEN 'meal_skipped' THEN ['meal_events'] WHEN 'hydration_low' THEN ['drinking_events'] WHEN 'medication_missed' THEN ['medication_events'] "
    "WHEN 'mobility_decline' THEN ['mobility_index', 'walking_duration_s', 'sit_to_stand_count', 'room_transitions'] WHEN 'social_isolation' THEN ['social_interaction_duration_s'] "
    "WHEN 'sleep_disruption' THEN ['lying_duration_s'] ELSE [split_part(rule_name, ':', 2)] END"
)
_STATE = f"""{ALERTS},
cited AS (SELECT DISTINCT home_id, day, unnest({_RULE_FEATURE}) AS feature FROM alerts),
shown AS (
  SELECT s.home_id, s.day, s.feature, observed_hours >= 8 AND tracking_coverage >= 0.6 AS ok, {_PLACE} AS place, value, median, z, 'feat:' || feature || ':' || strftime(day, '%Y-%m-%d') AS ref,
    CASE WHEN abs(median) < 1e-9 THEN 0 ELSE 100 * (value - median) / median END AS pct
  FROM scored s WHERE z IS NOT NULL AND feature IN ({_REPORT})
),
payload AS (
  SELECT home_id, day, feature, place, ok AS baseline_comparable, ref AS evidence_ref, floor((value) * 100 + (0.5::DOUBLE + 1e-9)) / 100 AS observed_value, abs(value) > 1e-9 AS observed_in_window,
    CASE WHEN ok THEN floor((median) * 100 + (0.5::DOUBLE + 1e-9)) / 100 END AS baseline_median, CASE WHEN ok THEN floor((value - median) * 100 + (0.5::DOUBLE + 1e-9)) / 100 END AS delta,
    CASE WHEN ok AND abs(median) > 1e-9 THEN floor((pct) * 10 + (0.5::DOUBLE + 1e-9)) / 10 END AS pct_change, CASE WHEN ok THEN floor((z) * 100 + (0.5::DOUBLE + 1e-9)) / 100 END AS robust_z,
    CASE WHEN ok THEN CASE WHEN abs(value - median) < 1e-9 THEN 'unchanged' WHEN value > median THEN 'increase' ELSE 'decrease' END END AS direction
  FROM shown
),
ranked AS (
  SELECT * FROM (SELECT p.*, c.feature IS NOT NULL AS alerted, row_number() OVER (PARTITION BY p.home_id, p.day ORDER BY
      CASE WHEN c.feature IS NOT NULL THEN 0 WHEN baseline_comparable THEN 1 ELSE 2 END,
      CASE WHEN c.feature IS NOT NULL THEN 0 WHEN baseline_comparable THEN -abs(coalesce(robust_z, 0)) WHEN observed_in_window THEN 0 ELSE 1 END, place) AS rank
    FROM payload p LEFT JOIN cited c USING (home_id, day, feature)) WHERE rank <= 6
),
claims AS (
  SELECT 'faithful' AS arm, home_id, day, 'c' || row_number() OVER (PARTITION BY home_id, day ORDER BY rank) AS claim_id,
    CASE WHEN NOT baseline_comparable AND observed_in_window THEN replace(feature, '_', ' ') || ' was observed at ' || observed_value || ' in the window.'
      WHEN NOT baseline_comparable THEN replace(feature, '_', ' ') || ' was not observed in the window (value 0.0).'
      ELSE replace(feature, '_', ' ') || CASE direction WHEN 'decrease' THEN ' showed a decrease' WHEN 'increase' THEN ' showed an increase' ELSE ' was stable at' END || ' at ' || observed_value || ' versus a baseline of ' || baseline_median || '.' END AS text,
    evidence_ref, observed_value AS claimed_value, pct_change AS claimed_pct_change, direction, NULL::VARCHAR AS injected
  FROM ranked WHERE baseline_comparable OR observed_in_window OR alerted
),
drawn AS (
  SELECT *, 'c' || rank AS claim_id, CASE WHEN ('0x' || substr(md5('0|rate|' || home_id || '|' || strftime(day, '%Y-%m-%d') || '|c' || rank), 1, 8))::BIGINT / 4294967296.0 < 0.5
    THEN ({list(C.CORRUPTIONS)})[floor(('0x' || substr(md5('0|mode|' || home_id || '|' || strftime(day, '%Y-%m-%d') || '|c' || rank), 1, 8))::BIGINT / 4294967296.0 * 6)::INT + 1] END AS m FROM ranked
),
moded AS (SELECT *, CASE WHEN m = 'sign_flipped_pct' AND NOT coalesce(direction = 'decrease' AND abs(pct_change) > 1, false) THEN 'wrong_pct' ELSE m END AS injected FROM drawn),
corrupted AS (
  SELECT 'corrupted' AS arm, home_id, day, claim_id,
    CASE injected WHEN 'inverted_direction' THEN replace(feature, '_', ' ') || ' improved to ' || observed_value || ', a clear increase.'
      WHEN 'prose_contradiction' THEN replace(feature, '_', ' ') || CASE WHEN direction = 'decrease' THEN ' increased' ELSE ' decreased' END || ' markedly to ' || observed_value || '.'
      WHEN 'sign_flipped_pct' THEN replace(feature, '_', ' ') || ' rose by ' || abs(pct_change) || '% today.'
      ELSE replace(feature, '_', ' ') || ' was ' || observed_value || ' against a baseline of ' || coalesce(baseline_median::VARCHAR, 'None') || ', a ' || coalesce(direction, 'None') || '.' END AS text,
    CASE WHEN injected = 'fabricated_ref' THEN 'feat:stair_climbing_duration_s:' || strftime(day, '%Y-%m-%d') ELSE evidence_ref END AS evidence_ref,
    CASE WHEN injected = 'invented_value' THEN observed_value * 1.9 + 13 ELSE observed_value END AS claimed_value,
    CASE injected WHEN 'wrong_pct' THEN coalesce(pct_change + 47, 47) WHEN 'sign_flipped_pct' THEN abs(pct_change) ELSE pct_change END AS claimed_pct_change,
    CASE WHEN injected = 'inverted_direction' THEN CASE WHEN direction = 'increase' THEN 'decrease' ELSE 'increase' END ELSE direction END AS direction, injected
  FROM moded
)"""

_NUMBERS = r"list_transform(regexp_extract_all(text, '-?\d(?:\d|,\d{3})*(?:\.\d+)?(?:[kKmM]\b)?'), lambda t: regexp_replace(t, '[,kKmM]', '', 'g')::DOUBLE * CASE lower(right(t, 1)) WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 ELSE 1 END)"
_SAID = f"CASE WHEN list_has_any(w, {UP}) AND NOT list_has_any(w, {DOWN}) THEN 'increase' WHEN list_has_any(w, {DOWN}) AND NOT list_has_any(w, {UP}) THEN 'decrease' END"
_VERIFIED = f"""{_STATE},
joined AS (
  SELECT c.*, s.value AS obs, s.median AS med, s.value - s.median AS dl, CASE WHEN abs(s.median) < 1e-9 THEN 0 ELSE 100 * (s.value - s.median) / s.median END AS ep, s.feature IS NOT NULL AS has,
    {_NUMBERS} AS nums, regexp_extract_all(lower(text), '[a-z]+') AS w
  FROM (SELECT * FROM claims UNION ALL SELECT * FROM corrupted) c
  LEFT JOIN (SELECT home_id, day, feature, value, median FROM scored WHERE z IS NOT NULL) s ON s.home_id = c.home_id AND s.day = c.day AND 'feat:' || s.feature || ':' || strftime(s.day, '%Y-%m-%d') = c.evidence_ref
),
said AS (SELECT *, {_SAID} AS says, CASE WHEN abs(dl) < 1e-9 THEN 'unchanged' WHEN dl > 0 THEN 'increase' ELSE 'decrease' END AS actual FROM joined),
verified AS (
  SELECT arm, home_id, day, claim_id, injected, has AS ref_exists,
    has AND (claimed_value IS NULL OR CASE WHEN abs(obs) < 1e-6 THEN abs(claimed_value) < 1e-3 ELSE abs(claimed_value - obs) <= greatest(0.02 * abs(obs), 0.005) END) AS value_matches,
    has AND (claimed_pct_change IS NULL OR (abs(med) >= 1e-9 AND abs(claimed_pct_change - ep) <= 2)) AS pct_matches,
    has AND NOT coalesce(direction <> actual, false) AND NOT coalesce(says <> actual AND actual <> 'unchanged', false) AND NOT coalesce(says <> direction, false)
      AND NOT coalesce(abs(claimed_pct_change) > 1e-9 AND abs(dl) > 1e-9 AND (claimed_pct_change > 0) <> (dl > 0), false) AS direction_consistent,
    NOT has OR claimed_value IS NULL OR len(list_filter(nums, lambda n: CASE WHEN abs(claimed_value) < 1e-6 THEN abs(n) < 1e-3 ELSE abs(n - claimed_value) <= greatest(0.02 * abs(claimed_value), 0.005) END)) > 0 AS prose_quoted
  FROM said
),
judged AS (SELECT *, ref_exists AND value_matches AND pct_matches AND direction_consistent AND prose_quoted AS faithful FROM verified)"""
_CLAIM = "home_id, day, claim_id, text, evidence_ref, {}, claimed_pct_change, direction"
_PCT = "CASE WHEN abs(median) < 1e-9 THEN 0 ELSE 100 * (value - median) / median END"

_OUTCOMES = f"""{_VERIFIED},
said_by AS (SELECT arm, home_id, day, claim_id, direction, claimed_pct_change FROM claims UNION ALL SELECT arm, home_id, day, claim_id, direction, claimed_pct_change FROM corrupted),
each AS (SELECT j.*, b.direction, b.claimed_pct_change, (j.home_id + day(j.day)) % 5 AS kind FROM judged j JOIN said_by b USING (arm, home_id, day, claim_id)),
fate AS (SELECT *, kind = 1 OR kind = 2 AND direction IS NOT NULL AS dropped FROM each WHERE kind <> 0),
outcome AS (SELECT arm, home_id, day, kind = 0 AS parse_failed, count(*) FILTER (WHERE kind <> 0) AS n_emitted, count(*) FILTER (WHERE kind <> 0 AND NOT (kind = 1 OR kind = 2 AND direction IS NOT NULL)) AS n_claims,
  count(*) FILTER (WHERE kind = 1 OR kind = 2 AND direction IS NOT NULL) AS n_dropped, count(*) FILTER (WHERE faithful AND kind <> 0 AND NOT (kind = 1 OR kind = 2 AND direction IS NOT NULL)) AS n_faithful,
  coalesce(sum(1 + (claimed_pct_change IS NOT NULL)::INT + (direction IS NOT NULL)::INT) FILTER (WHERE kind = 1 OR kind = 2 AND direction IS NOT NULL), 0)::INT AS n_rejections FROM each GROUP BY arm, home_id, day, kind)"""
ORACLES = {
    "report_outcomes": f"WITH {_OUTCOMES} SELECT home_id, day, arm, parse_failed, n_emitted, n_claims, n_claims AS n_repaired, n_dropped, n_faithful, n_rejections FROM outcome",
    "run_summary": f"""WITH {_OUTCOMES},
why AS (SELECT arm, cause, count(*) AS n FROM (SELECT arm, unnest(list_filter(['evidence_ref: pattern', CASE WHEN claimed_pct_change IS NOT NULL THEN 'claimed_pct_change: not a number' END, CASE WHEN direction IS NOT NULL THEN 'direction: not one of the three' END], lambda x: x IS NOT NULL)) AS cause FROM fate WHERE dropped) GROUP BY ALL),
top AS (SELECT arm, string_agg(cause || ': ' || n, '; ' ORDER BY n DESC, cause) AS top_causes FROM (SELECT * FROM why QUALIFY row_number() OVER (PARTITION BY arm ORDER BY n DESC, cause) <= 4) GROUP BY arm)
SELECT arm, count(*) AS n_reports, sum(n_emitted)::BIGINT AS n_emitted, sum(n_claims)::BIGINT AS n_claims, sum(n_claims)::BIGINT AS n_repaired, sum(n_faithful)::BIGINT AS n_faithful,
  round(median((n_claims - n_faithful) / n_claims) FILTER (WHERE n_claims > 0), 6) AS per_report_median, count(*) FILTER (WHERE parse_failed) AS parse_failures, sum(n_dropped)::BIGINT AS schema_rejected,
  round((sum(n_claims) - sum(n_faithful)) / sum(n_claims), 6) AS unfaithful_rate, round((sum(n_emitted) - sum(n_faithful)) / sum(n_emitted), 6) AS unusable_rate, coalesce(any_value(top_causes), '') AS top_causes
FROM outcome LEFT JOIN top USING (arm) GROUP BY arm""",
    "evidence": f"""WITH {ALERTS},
cited AS (SELECT DISTINCT home_id, day, unnest({_RULE_FEATURE}) AS feature FROM alerts),
bare AS (SELECT home_id, day, unnest(['fall_events', 'max_post_fall_immobility_s', 'longest_inactive_block_s']) AS feature, unnest([fall_events, max_post_fall_immobility_s, longest_inactive_block_s])::DOUBLE AS value FROM features)
SELECT s.home_id, s.day, s.feature, CASE WHEN c.feature IS NULL THEN 'feature' ELSE 'alert' END AS source, 'feat:' || s.feature || ':' || strftime(s.day, '%Y-%m-%d') AS ref, round(value, 6) AS observed, round(median, 6) AS baseline_median,
  round(z, 6) AS robust_z, round({_PCT}, 6) AS pct_change, round(value - median, 6) AS delta, n_days AS baseline_n_days
FROM scored s LEFT JOIN cited c USING (home_id, day, feature) WHERE z IS NOT NULL
UNION ALL
SELECT b.home_id, b.day, b.feature, 'alert', 'feat:' || b.feature || ':' || strftime(b.day, '%Y-%m-%d'), round(b.value, 6), 0, CASE WHEN b.value < 1e-12 THEN 0 ELSE 10 END, 0, round(b.value, 6), 1
FROM cited JOIN bare b USING (home_id, day, feature) LEFT JOIN scored s USING (home_id, day, feature) WHERE s.z IS NULL""",
    "report_payload": f"WITH {_STATE} SELECT * EXCLUDE (place) FROM payload",
    "faithful_claims": f"WITH {_STATE} SELECT {_CLAIM.format('claimed_value')} FROM claims",
    "corrupted_claims": f"WITH {_STATE} SELECT {_CLAIM.format('round(claimed_value, 6) AS claimed_value')}, injected FROM corrupted",
    "verified_claims": f"WITH {_VERIFIED} SELECT * FROM judged",
    "verification_summary": f"""WITH {_VERIFIED},
t AS (SELECT arm, injected, count(*) AS n_claims, count(*) FILTER (WHERE faithful) AS n_faithful, count(*) FILTER (WHERE NOT ref_exists) AS bad_ref, count(*) FILTER (WHERE ref_exists AND NOT value_matches) AS bad_value,
  count(*) FILTER (WHERE ref_exists AND NOT pct_matches) AS bad_pct, count(*) FILTER (WHERE ref_exists AND NOT direction_consistent) AS bad_direction, count(*) FILTER (WHERE ref_exists AND NOT prose_quoted) AS bad_prose FROM judged GROUP BY ALL),
p AS (SELECT *, (n_claims - n_faithful) / n_claims AS r FROM t)
SELECT * EXCLUDE (r), round(r, 6) AS unfaithful_rate,
  round(greatest(0, ((r + 1.96 * 1.96 / (2 * n_claims)) - 1.96 * sqrt(r * (1 - r) / n_claims + 1.96 * 1.96 / (4 * n_claims * n_claims))) / (1 + 1.96 * 1.96 / n_claims)), 6) AS rate_low,
  round(least(1, ((r + 1.96 * 1.96 / (2 * n_claims)) + 1.96 * sqrt(r * (1 - r) / n_claims + 1.96 * 1.96 / (4 * n_claims * n_claims))) / (1 + 1.96 * 1.96 / n_claims)), 6) AS rate_high FROM p""",
    "arm_comparison": f"""WITH {_VERIFIED},
t AS (SELECT count(*) FILTER (WHERE arm = 'faithful') AS n_faithful, count(*) FILTER (WHERE arm = 'faithful' AND NOT faithful) AS k_faithful, count(*) FILTER (WHERE arm = 'corrupted') AS n_corrupted, count(*) FILTER (WHERE arm = 'corrupted' AND NOT faithful) AS k_corrupted FROM judged),
z AS (SELECT *, (k_faithful / n_faithful - k_corrupted / n_corrupted) / sqrt((k_faithful + k_corrupted) / (n_faithful + n_corrupted) * (1 - (k_faithful + k_corrupted) / (n_faithful + n_corrupted)) * (1 / n_faithful + 1 / n_corrupted)) AS z0 FROM t),
e AS (SELECT *, 1 / (1 + 0.3275911 * abs(z0) / sqrt(2)) AS t0 FROM z)
SELECT n_faithful, k_faithful, n_corrupted, k_corrupted, round(z0, 6) AS z,
  round(t0 * (0.254829592 + t0 * (-0.284496736 + t0 * (1.421413741 + t0 * (-1.453152027 + t0 * 1.061405429)))) * exp(-z0 * z0 / 2), 4) AS p_value FROM e""",
    "report_lines": f"""WITH {_VERIFIED}, t AS (SELECT j.*, c.text FROM judged j JOIN corrupted c USING (home_id, day, claim_id) WHERE j.arm = 'corrupted')
SELECT home_id, day, coalesce(string_agg(text, chr(10) ORDER BY claim_id) FILTER (WHERE faithful), '') AS summary, count(*) FILTER (WHERE NOT faithful) AS n_withheld, count(*) FILTER (WHERE faithful) = 0 AS nothing_shown FROM t GROUP BY ALL""",
    "assembled_reports": f"""WITH {_VERIFIED}, t AS (SELECT j.*, c.text FROM judged j JOIN corrupted c USING (home_id, day, claim_id) WHERE j.arm = 'corrupted')
SELECT home_id, day, count(*) AS n_claims, 0 AS n_rejected, count(*) FILTER (WHERE NOT faithful) AS n_withheld, coalesce(string_agg(text, chr(10) ORDER BY claim_id) FILTER (WHERE faithful), '') AS summary FROM t GROUP BY ALL""",
    "prose_numbers": f"""WITH t AS (SELECT conv_id, turn, concat_ws(' ', text, 'walking fell to 1,800 s, -5k', turn::VARCHAR) AS text FROM conversations),
n AS (SELECT conv_id, turn, {_NUMBERS} AS nums, regexp_extract_all(lower(text), '[a-z]+') AS w FROM t)
SELECT conv_id, turn, len(nums) AS n_numbers, round(coalesce(list_sum(nums), 0), 6) AS total, {_SAID} AS said FROM n""",
}
