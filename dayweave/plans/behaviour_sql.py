"""SQL twins of the behaviour queries, for a second engine over the same tables; common table expressions build on each other."""

from __future__ import annotations

from dayweave.config import ACTIVITIES, DRIFT, OWN_RULE, SEDENTARY, TRACKED, UNTRACKED, Thresholds

T = Thresholds()
_NAMES = ", ".join(f"'{a}'" for a in ACTIVITIES)
_STILL = ", ".join(f"'{a}'" for a in SEDENTARY)

SEGMENTS = f"""
segments AS (
  SELECT event_id AS segment_id, user_id % 10 AS home_id, user_id AS track_id,
    CASE WHEN user_id % 7 = 3 THEN 'visitor' WHEN user_id % 7 = 5 THEN 'carer' ELSE 'resident' END AS role,
    (props->>'$.k')::INT % 20 AS activity_id, ([{_NAMES}])[(props->>'$.k')::INT % 20 + 1] AS activity_name,
    ts::DATE AS day, epoch_us(ts) AS start_us, epoch_us(ts) + round((value + 1) * 1000000)::BIGINT AS end_us,
    round((value + 1) * 1000000)::BIGINT / 1000000 AS duration_s, event_type AS room, (event_id * 7919 % 100) / 100 AS confidence
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
),
days AS (
  SELECT home_id, day, hours * CASE WHEN (home_id + day(day)) % 13 = 0 THEN 0.3::DOUBLE ELSE 1 END AS observed_hours, least(1, n / 20) AS tracking_coverage
  FROM (SELECT user_id % 10 AS home_id, ts::DATE AS day, count(DISTINCT hour(ts)) AS hours, count(*) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL)
)"""


#: Summed in whole microseconds, the same in whatever order.
_SECONDS = "sum(round(duration_s * 1000000)::BIGINT)"


def _took(name: str) -> str:
    return f"coalesce({_SECONDS} FILTER (WHERE own AND activity_name = '{name}') / 1000000, 0)"


def _times(name: str) -> str:
    return f"count(*) FILTER (WHERE own AND activity_name = '{name}')"


def _mean(name: str) -> str:
    return f"coalesce({_SECONDS} FILTER (WHERE own AND activity_name = '{name}') / 1000000 / count(*) FILTER (WHERE own AND activity_name = '{name}'), 0)"


FEATURES = f"""{SEGMENTS},
line AS (
  SELECT *, role = 'resident' AS own, lag(room) OVER w AS room_before, lag(end_us) OVER w AS end_before, activity_name IN ({_STILL}) AS still,
    max(CASE WHEN activity_name = 'eating' THEN rn END) OVER (PARTITION BY home_id, day, role = 'resident' ORDER BY start_us, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS meal_rn
  FROM (SELECT *, row_number() OVER (PARTITION BY home_id, day, role = 'resident' ORDER BY start_us, segment_id) AS rn FROM segments)
  WINDOW w AS (PARTITION BY home_id, day, role = 'resident' ORDER BY start_us, segment_id)
),
isle AS (
  SELECT l.*, sum(CASE WHEN NOT l.still OR coalesce(l.start_us - l.end_before, 0) > {int(T.bridge_s * 1e6)} THEN 1 ELSE 0 END) OVER (PARTITION BY l.home_id, l.day, l.own ORDER BY l.rn) AS island,
    l.activity_name = 'eating' AND (m.end_us IS NULL OR l.start_us - m.end_us > {int(T.meal_gap_s * 1e6)}) AS new_meal
  FROM line l LEFT JOIN line m ON m.home_id = l.home_id AND m.day = l.day AND m.own = l.own AND m.rn = l.meal_rn
),
block AS (SELECT home_id, day, max(s) AS longest FROM (SELECT home_id, day, island, {_SECONDS} / 1000000 AS s FROM isle WHERE own AND still GROUP BY ALL) GROUP BY ALL),
sums AS (
  SELECT home_id, day, {_took('walking')} AS walking_duration_s, {_times('walking')} AS walking_bouts, {_mean('walking')} AS mean_bout_duration_s,
    count(*) FILTER (WHERE own AND room_before <> room) AS room_transitions, {_times('standing_up')} AS sit_to_stand_count, {_mean('standing_up')} AS mean_sit_to_stand_duration_s,
    {_took('sitting')} AS sitting_duration_s, {_took('lying_down')} AS lying_duration_s, {_took('standing')} AS standing_duration_s,
    count(*) FILTER (WHERE own AND new_meal) AS meal_events, {_took('eating')} AS eating_duration_s, {_times('drinking')} AS drinking_events, {_took('cooking_food_prep')} AS cooking_duration_s,
    {_times('taking_medication')} AS medication_events, {_took('watching_tv')} AS tv_duration_s, {_took('reading')} AS reading_duration_s, {_times('using_phone')} AS phone_events,
    {_took('interacting_with_person')} AS social_interaction_duration_s, count(DISTINCT CASE WHEN NOT own AND role IN ('visitor', 'carer') THEN track_id END) AS visitor_count,
    {_took('cleaning_housework')} AS housework_duration_s, {_times('falling')} AS fall_events, coalesce(max(duration_s) FILTER (WHERE own AND activity_name = 'fallen_on_ground'), 0) AS max_post_fall_immobility_s
  FROM isle GROUP BY ALL
),
f0 AS (
  SELECT d.home_id, d.day, d.observed_hours, d.tracking_coverage, s.* EXCLUDE (home_id, day), coalesce(b.longest, 0) AS longest_inactive_block_s
  FROM days d LEFT JOIN sums s USING (home_id, day) LEFT JOIN block b USING (home_id, day)
),
features AS (
  SELECT *, 0.4 * walking_duration_s / 60 + 0.3 * sit_to_stand_count + 0.3 * room_transitions AS mobility_index,
    CASE WHEN sitting_duration_s + lying_duration_s + standing_duration_s > 0 THEN (sitting_duration_s + lying_duration_s) / (sitting_duration_s + lying_duration_s + standing_duration_s) ELSE 0 END AS sedentary_ratio
  FROM f0
)"""

_LONG = " UNION ALL ".join(f"SELECT home_id, day, {i} AS k, '{n}' AS feature, {n}::DOUBLE AS value, observed_hours, tracking_coverage FROM features" for i, n in enumerate(TRACKED))
_SPAN = f"CASE WHEN isodow(a.day) >= 6 THEN {T.weekend_span} ELSE {T.weekday_span} END"
BASELINES = f"""{FEATURES},
vals AS ({_LONG}),
good AS (SELECT * FROM vals WHERE observed_hours >= {T.least_hours} AND tracking_coverage >= {T.least_coverage}),
kind AS (SELECT a.home_id, a.day, a.k, median(b.value) AS median, mad(b.value) AS mad, count(*) AS n, min(b.day) AS lo, max(b.day) AS hi
  FROM vals a JOIN good b ON b.home_id = a.home_id AND b.k = a.k AND b.day < a.day AND b.day >= a.day - ({_SPAN})::INT AND (isodow(b.day) >= 6) = (isodow(a.day) >= 6) GROUP BY ALL),
pool AS (SELECT a.home_id, a.day, a.k, median(b.value) AS median, mad(b.value) AS mad, count(*) AS n, min(b.day) AS lo, max(b.day) AS hi
  FROM vals a JOIN good b ON b.home_id = a.home_id AND b.k = a.k AND b.day < a.day AND b.day >= a.day - {T.window_days} GROUP BY ALL),
base AS (
  SELECT v.*, CASE WHEN kind.n >= {T.least_days} THEN kind.median WHEN pool.n >= {T.least_days} THEN pool.median END AS median,
    CASE WHEN kind.n >= {T.least_days} THEN kind.mad WHEN pool.n >= {T.least_days} THEN pool.mad END AS mad,
    CASE WHEN kind.n >= {T.least_days} THEN kind.n WHEN pool.n >= {T.least_days} THEN pool.n ELSE 0 END AS n_days,
    CASE WHEN kind.n >= {T.least_days} THEN kind.lo WHEN pool.n >= {T.least_days} THEN pool.lo END AS window_start,
    CASE WHEN kind.n >= {T.least_days} THEN kind.hi WHEN pool.n >= {T.least_days} THEN pool.hi END AS window_end
  FROM vals v LEFT JOIN kind USING (home_id, day, k) LEFT JOIN pool USING (home_id, day, k)
),
scored AS (
  SELECT *, CASE WHEN median IS NULL THEN NULL WHEN abs(value - median) < 1e-12 THEN 0
    ELSE greatest(-{T.z_clamp}, least({T.z_clamp}, 0.6745 * (value - median) / greatest(mad, {T.mad_floor} * abs(median), 1e-9))) END AS z
  FROM base
)"""

_DRIFT_IDS = ", ".join(str(TRACKED.index(n)) for n in DRIFT)
_RESET = ", ".join(str(TRACKED.index(n)) for n in ("mobility_index", "social_interaction_duration_s"))
DRIFTED = f"""{BASELINES.replace("segments AS (", "RECURSIVE segments AS (", 1)},
turn AS (SELECT *, row_number() OVER (PARTITION BY home_id, k ORDER BY day) AS rn, observed_hours >= {T.least_hours} AS open FROM scored WHERE k IN ({_DRIFT_IDS})),
drift AS (
  SELECT home_id, day, k, feature, rn, CASE WHEN NOT open OR z IS NULL OR n_days < {T.cusum_warmup} THEN 0::DOUBLE ELSE greatest(0, -z - {T.cusum_slack}) END AS reported,
    CASE WHEN NOT open OR z IS NULL OR n_days < {T.cusum_warmup} THEN 0::DOUBLE WHEN k IN ({_RESET}) AND greatest(0, -z - {T.cusum_slack}) >= {T.cusum_limit} THEN 0 ELSE greatest(0, -z - {T.cusum_slack}) END AS carried
  FROM turn WHERE rn = 1
  UNION ALL
  SELECT home_id, day, k, feature, rn, s, CASE WHEN open AND z IS NOT NULL AND k IN ({_RESET}) AND s >= {T.cusum_limit} THEN 0 ELSE s END
  FROM (SELECT t.*, CASE WHEN NOT open OR z IS NULL THEN d.carried WHEN n_days < {T.cusum_warmup} THEN 0 ELSE greatest(0, {T.cusum_decay} * d.carried - z - {T.cusum_slack}) END AS s
        FROM turn t JOIN drift d ON d.home_id = t.home_id AND d.k = t.k AND t.rn = d.rn + 1)
)"""

_z = lambda n: f"coalesce(max(z) FILTER (WHERE feature = '{n}'), 0)"
ALERTS = f"""{DRIFTED},
open_days AS (SELECT *, count(*) OVER w AS seen, lag(z) OVER w AS z_before, min(coalesce(z, 0) < -{T.z_limit}) OVER (PARTITION BY home_id, k ORDER BY day ROWS BETWEEN {T.sustained_days - 1} PRECEDING AND CURRENT ROW) AS all_low
  FROM scored WHERE observed_hours >= {T.least_hours} WINDOW w AS (PARTITION BY home_id, k ORDER BY day)),
wide AS (
  SELECT home_id, day, bool_or(feature = 'mobility_index' AND all_low AND seen >= {T.sustained_days}) AS declined, bool_or(z IS NOT NULL) AS based,
    {_z('meal_events')} AS z_meal, {_z('social_interaction_duration_s')} AS z_social, {_z('lying_duration_s')} AS z_lying, max(median) FILTER (WHERE feature = 'medication_events') AS med
  FROM open_days GROUP BY ALL
),
d2 AS (SELECT home_id, day, max(reported) FILTER (WHERE feature = 'mobility_index') AS mob, max(reported) FILTER (WHERE feature = 'social_interaction_duration_s') AS soc FROM drift GROUP BY ALL),
r AS (SELECT f.*, w.* EXCLUDE (home_id, day), d2.mob, d2.soc FROM features f LEFT JOIN wide w USING (home_id, day) LEFT JOIN d2 USING (home_id, day)),
alerts AS (
  SELECT home_id, day, 'fall_detected' AS kind, 'urgent' AS severity, 'fall_detected' AS rule_name, 'fall_events > 0' AS rule_expression, 1 AS n_evidence FROM r WHERE fall_events > 0
  UNION ALL SELECT home_id, day, 'fall_no_recovery', 'emergency', 'fall_no_recovery', 'max_post_fall_immobility_s >= 60', 1 FROM r WHERE max_post_fall_immobility_s >= 60
  UNION ALL SELECT home_id, day, 'prolonged_inactivity', 'urgent', 'prolonged_inactivity', 'longest_inactive_block_s >= 14400', 1 FROM r WHERE longest_inactive_block_s >= 14400
  UNION ALL SELECT home_id, day, 'meal_skipped', 'advisory', 'meal_skipped', 'meal_events < 2 or robust_z(meal_events) < -3.0', 1 FROM r WHERE based AND (meal_events < 2 OR z_meal < -3)
  UNION ALL SELECT home_id, day, 'hydration_low', 'advisory', 'hydration_low', 'drinking_events < 4', 1 FROM r WHERE based AND drinking_events < 4
  UNION ALL SELECT home_id, day, 'medication_missed', 'urgent', 'medication_missed', 'medication_events == 0 while baseline median >= 1', 1 FROM r WHERE based AND med >= 1 AND medication_events = 0
  UNION ALL SELECT home_id, day, 'mobility_decline', 'urgent', 'mobility_decline', CASE WHEN declined THEN 'robust_z(mobility_index) < -3.0 for 3 consecutive days' ELSE 'CUSUM(mobility_index) >= 5.0' END, 4 FROM r WHERE based AND (declined OR mob >= 5)
  UNION ALL SELECT home_id, day, 'social_isolation', 'advisory', 'social_isolation', CASE WHEN soc >= 5 THEN 'CUSUM(social_interaction_duration_s) >= 5.0' ELSE 'robust_z(social_interaction_duration_s) < -3.0 and visitor_count == 0' END, 1
    FROM r WHERE based AND ((z_social < -3 AND visitor_count = 0) OR soc >= 5)
  UNION ALL SELECT home_id, day, 'sleep_disruption', 'advisory', 'sleep_disruption', '|robust_z(lying_duration_s)| > 3.0', 1 FROM r WHERE based AND abs(z_lying) > 3
  UNION ALL SELECT home_id, day, 'routine_deviation', 'info', 'routine_deviation:' || feature, '|robust_z(' || feature || ')| > 3.0 for 2 consecutive days', 1
    FROM open_days WHERE feature NOT IN ({", ".join(f"'{n}'" for n in OWN_RULE)}) AND ((z > 3 AND z_before > 3) OR (z < -3 AND z_before < -3))
)"""

FEATURE_COLUMNS = [*TRACKED, *UNTRACKED, "observed_hours", "tracking_coverage"]
ORACLES = {
    "segments": f"WITH {SEGMENTS} SELECT segment_id, home_id, track_id, role, activity_id, activity_name, day, start_us, end_us, duration_s, room FROM segments",
    "daily_features": f"WITH {FEATURES} SELECT home_id, day, {', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in FEATURE_COLUMNS)} FROM features",
    "baselines": f"WITH {BASELINES} SELECT home_id, day, feature, round(median, 6) AS median, round(mad, 6) AS mad, n_days, window_start, window_end, round(value, 6) AS value, round(z, 6) AS z FROM scored WHERE z IS NOT NULL",
    "drift": f"WITH {DRIFTED} SELECT home_id, day, feature, round(reported, 6) AS reported, round(carried, 6) AS carried FROM drift",
    "alerts": f"WITH {ALERTS} SELECT home_id, day, kind, severity, rule_name, rule_expression, n_evidence, sha256(home_id || '|' || strftime(day, '%Y-%m-%d') || '|' || rule_name) AS alert_id FROM alerts",
}
