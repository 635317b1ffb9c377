"""Small rows for every rule that would silently change an answer."""

import datetime
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayweave.config import DRIFT, TRACKED, UNTRACKED, Thresholds
from dayweave.functions import skeleton
from dayweave.functions.arrays import adjusted, cosine_distance, logsumexp, median, normalised, softmax
from dayweave.functions.text import agrees, coerced_number, numbers, quotes, said_direction
from dayweave.operators import claims, decode, labels, metrics, tracks
from dayweave.operators.alerts import alerts
from dayweave.operators.baseline import long_baselines, with_baselines, with_drift, with_sustained
from dayweave.operators.features import daily_features, observed_hours
from dayweave.sources import annotations, sinks

D0 = datetime.date(2024, 1, 1)


def day(n):
    return D0 + datetime.timedelta(days=n)


def feature_rows(spark, rows):
    """rows: (day number, observed hours, coverage, changes)."""
    names = [*TRACKED, *UNTRACKED]
    usual = {"walking_duration_s": 1800.0, "sit_to_stand_count": 20.0, "room_transitions": 30.0, "meal_events": 3.0, "drinking_events": 6.0, "medication_events": 1.0, "social_interaction_duration_s": 1200.0, "lying_duration_s": 28800.0, "mobility_index": 27.0, "visitor_count": 1.0}
    data = [(1, day(n), float(h), float(c), *[float({**usual, **ch}.get(x, 0.0)) for x in names]) for n, h, c, ch in rows]
    return spark.createDataFrame(data, "home_id long, day date, observed_hours double, tracking_coverage double, " + ", ".join(f"{x} double" for x in names))


def scored(df, config=Thresholds()):
    return with_sustained(with_drift(with_baselines(df, config), config), config)


def test_six_days_are_no_baseline_seven_are(spark):
    r = {x.day: x for x in with_baselines(feature_rows(spark, [(n, 24, 1, {}) for n in range(8)])).collect()}
    assert r[day(6)].z is None and r[day(7)].n_days == 7
    assert all(z == 0 for z in r[day(7)].z)


def test_outage_days_do_not_enter(spark):
    rows = [(n, 3 if n == 2 else 24, 0.5 if n == 4 else 1, {"walking_duration_s": 0.0 if n in (2, 4) else 1800.0}) for n in range(12)]
    b = {(x.day, x.feature): x for x in long_baselines(with_baselines(feature_rows(spark, rows))).collect()}
    assert (day(8), "meal_events") not in b and b[day(9), "meal_events"].n_days == 7 and b[day(9), "walking_duration_s"].mad == 0


def test_mad_floor_zero_median_and_clamp(spark):
    rows = [(n, 24, 1, {}) for n in range(10)] + [(10, 24, 1, {"meal_events": 2.0, "eating_duration_s": 5.0})]
    z = {x.feature: x for x in long_baselines(with_baselines(feature_rows(spark, rows))).filter(F.col("day") == day(10)).collect()}
    assert z["meal_events"].z == pytest.approx(-0.6745 / 0.15) and z["eating_duration_s"].z == 10 and z["tv_duration_s"].z == 0


def test_cusum_holds_resets_and_reports_before_reset(spark):
    low = {"mobility_index": 20.0, "walking_duration_s": 1200.0}
    rows = [(n, 24, 1, {"mobility_index": 27.0 + (n % 3)}) for n in range(12)] + [(12, 24, 1, low), (13, 4, 1, low), (14, 24, 1, low)]
    k, prev = DRIFT.index("mobility_index"), 0.0
    i = TRACKED.index("mobility_index")
    for r in sorted(with_drift(with_baselines(feature_rows(spark, rows))).collect(), key=lambda r: r.day):
        if r.observed_hours < 8 or r.z is None:
            assert r.reported[k] == r.carried[k] == prev
        else:
            assert r.reported[k] == pytest.approx(max(0, 0.98 * prev - r.z[i] - 0.75))
            assert r.carried[k] == (0 if r.reported[k] >= 5 else r.reported[k])
        prev = r.carried[k]
    slow = Thresholds(cusum_warmup=10)
    warm = {r.day: r for r in with_drift(with_baselines(feature_rows(spark, rows), slow), slow).collect()}
    assert warm[day(9)].n_days < 10 and warm[day(9)].reported[k] == 0


def test_rules_and_gates(spark):
    quiet = [(n, 24, 1, {}) for n in range(10)]
    bad = {"fall_events": 1.0, "max_post_fall_immobility_s": 60.0, "longest_inactive_block_s": 14400.0, "meal_events": 1.0, "drinking_events": 3.0, "medication_events": 0.0, "social_interaction_duration_s": 0.0, "visitor_count": 0.0, "lying_duration_s": 0.0}
    kinds = lambda rows, d: {a.rule_name for a in alerts(scored(feature_rows(spark, rows))).collect() if a.day == day(d)}
    assert kinds([*quiet, (10, 24, 1, bad)], 10) >= {"fall_detected", "fall_no_recovery", "prolonged_inactivity", "meal_skipped", "hydration_low", "medication_missed", "social_isolation", "sleep_disruption"}
    assert kinds([*quiet, (10, 7.9, 1, bad)], 10) == kinds([(0, 24, 1, bad)], 0) == {"fall_detected", "fall_no_recovery", "prolonged_inactivity"}
    first = alerts(scored(feature_rows(spark, [(0, 24, 1, bad)]))).filter("kind = 'fall_detected'").first()
    assert first.evidence[0].robust_z == 10 and first.evidence[0].baseline_n_days == 1 and first.alert_id
    tv = lambda *v: [*quiet, *[(10 + i, 24, 1, {"tv_duration_s": x}) for i, x in enumerate(v)]]
    assert "routine_deviation:tv_duration_s" not in kinds(tv(9.0), 10) and "routine_deviation:tv_duration_s" in kinds(tv(9.0, 9.0), 11)
    down = [*quiet, *[(10 + i, 24, 1, {"mobility_index": 5.0}) for i in range(3)]]
    assert "mobility_decline" in kinds(down, 12)


def seg(spark, rows):
    data = [(i, 1, t, role, a, D0, int(s * 1e6), int(e * 1e6), float(e - s), room) for i, (t, role, a, s, e, room) in enumerate(rows)]
    return spark.createDataFrame(data, "segment_id long, home_id long, track_id long, role string, activity_name string, day date, start_us long, end_us long, duration_s double, room string")


def test_daily_features_from_segments(spark):
    days = spark.createDataFrame([(1, D0, 24.0, 1.0), (1, day(1), 24.0, 1.0)], "home_id long, day date, observed_hours double, tracking_coverage double")
    rows = [
        (1, "resident", "eating", 0, 100, "kitchen"), (1, "resident", "eating", 3700, 3800, "kitchen"), (1, "resident", "eating", 7401, 7500, "hall"),  # exactly an hour after, and a second more
        (1, "resident", "sitting", 8000, 8100, None), (1, "resident", "reading", 8160, 8200, ""), (1, "resident", "sitting", 8261, 8300, "hall"), (1, "resident", "walking", 8300, 8400, "bath"),
        (2, "visitor", "walking", 10, 20, "x"), (2, "visitor", "sitting", 30, 40, "x"), (3, "carer", "falling", 50, 60, "x"), (4, "unknown", "falling", 70, 80, "x"),
    ]
    f = {r.day: r for r in daily_features(seg(spark, rows), days).collect()}
    r = f[D0]
    assert (r.meal_events, r.longest_inactive_block_s, r.visitor_count, r.fall_events, r.walking_bouts, r.room_transitions) == (2, 140.0, 2, 0, 1, 2)
    assert r.mobility_index == pytest.approx(0.4 * 100 / 60 + 0.3 * 2) and f[day(1)].meal_events == 0 and f[day(1)].sedentary_ratio == 0


def test_observed_hours_skip_gaps(spark):
    f = spark.createDataFrame([(1, int(t * 1e6)) for t in (0, 1, 6, 11.5, 12)], "k long, time_us long")
    assert observed_hours(f, ["k"]).first().observed_hours == pytest.approx(6.5 / 3600)


def test_numbers_and_directions_in_prose(spark):
    cases = [("1,800 s", [1800.0]), ("1,80", [1.0, 80.0]), ("5m and 5 mb", [5e6, 5.0]), ("-2.5k", [-2500.0]), ("on 2026-03-01", [2026.0, -3.0, -1.0]), ("none", []), ("70%", [70.0]), ("5kg", [5.0])]
    got = spark.createDataFrame([(t,) for t, _ in cases], "t string").coalesce(1).select(numbers(F.col("t")).alias("n")).collect()
    assert [g.n for g in got] == [w for _, w in cases]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(said_direction(F.lit("fall events 1"))) == "decrease" and one(said_direction(F.lit("rose then fell"))) is None and one(said_direction(F.lit("same"))) is None
    assert one(agrees(F.lit(0.07), F.lit(0.074))) and not one(agrees(F.lit(0.08), F.lit(0.074))) and one(agrees(F.lit(102.0), F.lit(100.0))) and not one(agrees(F.lit(102.1), F.lit(100.0))) and one(agrees(F.lit(0.0009), F.lit(0.0)))
    assert one(quotes(F.lit("walked 1,800 s"), F.lit(1800.0))) and not one(quotes(F.lit("walked far"), F.lit(5.0)))
    assert one(coerced_number(F.lit("1,234%"))) == 1234 and one(coerced_number(F.lit("n/a"))) is None


def test_claim_checks(spark):
    index = spark.createDataFrame([(1, D0, "meal_events", 2.0, 4.0, -50.0, -2.0), (1, D0, "tv_duration_s", 5.0, 0.0, 0.0, 5.0)], "home_id long, day date, feature string, observed double, baseline_median double, pct_change double, delta double")
    ref = "feat:meal_events:2024-01-01"
    cases = {
        "good": ("meals fell to 2", ref, 2.0, -50.0, "decrease"), "pct edge": ("meals fell to 2", ref, 2.0, -48.0, "decrease"), "value": ("meals fell to 3", ref, 3.0, None, None), "pct": ("meals fell to 2", ref, 2.0, -47.9, None),
        "sign": ("meals 2", ref, 2.0, 50.0, None), "prose": ("meals rose to 2", ref, 2.0, None, "decrease"), "field": ("meals 2", ref, 2.0, None, "increase"), "unquoted": ("fewer meals", ref, 2.0, None, None),
        "fabricated": ("x 2", "feat:stairs:2024-01-01", 2.0, None, None), "malformed": ("x 2", "meal_events", 2.0, None, None), "missing": ("x", None, None, None, None), "zero": ("tv 5", "feat:tv_duration_s:2024-01-01", 5.0, 10.0, None), "other day": ("x", "feat:meal_events:2024-01-02", None, None, None),
    }
    df = spark.createDataFrame([(1, D0, k, *v) for k, v in cases.items()], "home_id long, day date, claim_id string, text string, evidence_ref string, claimed_value double, claimed_pct_change double, direction string")
    got = {r.claim_id: r for r in claims.verify(df, index).collect()}
    assert {k for k, r in got.items() if r.faithful} == {"good", "pct edge"}
    for k, check in (("value", "value_matches"), ("pct", "pct_matches"), ("sign", "direction_consistent"), ("prose", "direction_consistent"), ("field", "direction_consistent"), ("unquoted", "prose_quoted"), ("fabricated", "ref_exists"), ("malformed", "ref_exists"), ("missing", "ref_exists"), ("zero", "pct_matches"), ("other day", "ref_exists")):
        assert not got[k][check] and got[k].notes, k


def test_intervals_of_shares(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (5, 10)], "k long, n long").coalesce(1)
    low, high = claims.wilson(F.col("k"), F.col("n"))
    r = df.select(low.alias("a"), high.alias("b")).collect()
    assert np.isnan(r[0].a) and r[1].a == 0 and r[2].a == pytest.approx(0.2366, abs=1e-3) and r[2].b == pytest.approx(0.7634, abs=1e-3)
    z, p = claims.two_proportion_z(F.lit(30), F.lit(100), F.lit(50), F.lit(100))
    x = spark.range(1).select(z.alias("z"), p.alias("p")).first()
    assert x.z == pytest.approx(-2.8868, abs=1e-3) and x.p == pytest.approx(0.0039, abs=2e-4)


def test_array_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(median(arr(3, 1, 2))) == 2 and one(median(arr(4, 1, 2, 3))) == 2.5 and one(median(F.array().cast("array<double>"))) is None
    z = [1.0, 700.0, 699.0]
    e = np.exp(np.array(z) - 700)
    assert one(softmax(arr(*z))) == pytest.approx((e / e.sum()).tolist()) and one(logsumexp(arr(*z))) == pytest.approx(700 + np.log(e.sum()))
    assert one(cosine_distance(arr(0, 0), arr(1, 0))) == 2 and one(cosine_distance(arr(1, 0), arr(0, 1))) == 1 and one(normalised(arr(3, 4))) == pytest.approx([0.6, 0.8])
    assert one(adjusted(arr(1, 2), arr(5, 6), 0.0)) == [1, 2]
    assert one(decode.masked_cross_entropy(arr(1, 9, 2), F.array(F.lit(True), F.lit(False), F.lit(True)), F.lit(0))) == pytest.approx(np.log(np.exp(1) + np.exp(2)) - 1)
    with pytest.raises(Exception, match="masked"):
        one(decode.masked_cross_entropy(arr(1, 9, 2), F.array(F.lit(True), F.lit(False), F.lit(True)), F.lit(1)))


@pytest.mark.parametrize("buckets", [1, 8])
def test_auroc_counts_ties_half(spark, buckets):
    rng = np.random.default_rng(0)
    s, t = rng.integers(0, 9, 120) / 8, rng.integers(0, 2, 120)
    df = spark.createDataFrame(list(zip(s.tolist(), t.tolist())), "s double, t int")
    want = np.mean([(a > b) + (a == b) / 2 for a in s[t == 1] for b in s[t == 0]])
    assert metrics.auroc(df, "s", "t", buckets=buckets).first().auroc == pytest.approx(want)
    same = spark.createDataFrame([(1.0, 1), (1.0, 0), (1.0, 0)], "s double, t int")
    assert metrics.auroc(same, "s", "t").first().auroc == 0.5 and np.isnan(metrics.auroc(same.filter("t = 1"), "s", "t").first().auroc)


def test_decoding_equals_enumeration():
    rng = np.random.default_rng(3)
    e, a, pi = np.log(rng.dirichlet(np.ones(3), 5)), np.log(rng.dirichlet(np.ones(3), 3)), np.log(np.full(3, 1 / 3))
    paths = list(itertools.product(range(3), repeat=5))
    score = np.array([pi[p[0]] + sum(e[t, p[t]] for t in range(5)) + sum(a[p[t], p[t + 1]] for t in range(4)) for p in paths])
    assert tuple(decode.viterbi(e, a, pi)) == paths[int(score.argmax())]
    w = np.exp(score - np.logaddexp.reduce(score))
    want = [[sum(x for x, p in zip(w, paths) if p[t] == k) for k in range(3)] for t in range(5)]
    assert np.allclose(decode.marginals(e, a, pi), want)
    assert decode.viterbi(np.zeros((4, 3)), np.zeros((3, 3)), np.zeros(3)).tolist() == [0, 0, 0, 0]


def test_transition_prior_floor_is_exact():
    m = decode.structured_prior(22)
    assert np.allclose(m.sum(1), 1) and all(m[i, 7] == 0.05 for i in range(22) if i != 7) and m[7, 8] == 0.5
    with pytest.raises(ValueError):
        decode.structured_prior(8)


def test_one_window_fall_survives_and_flicker_does_not():
    a = np.log(decode.structured_prior(20))
    pi = np.full(20, -np.log(20))

    def path(spike, strength):
        z = np.zeros((9, 20))
        z[:, 2] = 3
        z[4, 2], z[4, spike] = 0, strength
        return decode.viterbi(z - np.logaddexp.reduce(z, 1)[:, None], a, pi)[4]

    assert path(7, 12.0) == 7 and path(14, 3.0) == 2


def test_role_votes():
    names = lambda v: [r for r, _ in tracks.vote(v)]
    assert names(["resident"] * 5)[-2:] == ["unknown", "resident"] and names(["unknown"] * 9) == ["unknown"] * 9
    v = names(["resident"] * 6 + ["visitor"] * 9)
    assert v[13] == "resident" and v[14] == "visitor"  # 8 against 6 is no margin of 3, 9 against 6 is


def test_windows_count_usable_rows_and_break_at_gaps(spark):
    rows = [(1, i, i % 17 != 3, "r" if i < 20 else "a", "resident") for i in range(34)] + [(2, i if i < 15 else i + k, True, "r", "resident") for k in (5,) for i in range(30)] + [(3, i if i < 15 else i + 4, True, "r", "visitor") for i in range(30)]
    got = {r.track_id: r for r in tracks.windows(spark.createDataFrame(rows, "track_id long, frame_idx long, usable boolean, room string, role string"), ["track_id"]).collect()}
    assert got[1].end_frame - got[1].start_frame == 31 and got[1].n_rows == 30 and got[1].room == "r" and 2 not in got and got[3].start_frame == 0


def test_fall_window_labels(spark):
    w = spark.createDataFrame([(c, s) for c in range(4) for s in (0, 15, 45, 60)], "clip long, start long")
    falls = spark.createDataFrame([(0, 44, 50), (1, 0, 0)], "clip long, lo long, hi long")
    got = {(r.clip, r.start): r.label for r in labels.fall_windows(w, falls, "clip", 30).collect()}
    assert [got[0, s] for s in (0, 15, 45, 60)] == [1, 7, 7, 8] and {got[1, s] for s in (0, 15, 45, 60)} == {19} and [got[2, s] for s in (0, 15, 45, 60)] == [1, 7, 8, 8]


def test_best_covering_action(spark):
    m = spark.createDataFrame([("walk", "walking", False), ("bad", "x", True)], "label string, class string, drop boolean")
    w = spark.createDataFrame([(1, i, float(10 * i), 10.0 * i + 2) for i in range(5)], "clip long, window_id long, w_start double, w_end double")
    a = spark.createDataFrame([(1, 1, "walk", 0.8, 9.0), (1, 2, "walk", 10.81, 19.0), (1, 3, "bad", 20.0, 22.0), (1, 4, "walk", 20.5, 22.0), (1, 5, "odd", 30.0, 32.0), (1, 6, "walk", 30.2, 31.5)], "clip long, action_id long, label string, a_start double, a_end double")
    got = {r.window_id: r["class"] for r in labels.best_covering(w, a, m, "clip", 1.2, "other_idle", 7.0).collect()}
    assert got == {0: "walking", 1: "other_idle", 3: "walking", 4: "other_idle"}


def test_spans_unions_and_chains(spark):
    s = spark.createDataFrame([(1, 0, 10), (1, 5, 7), (1, 9, 20), (1, 30, 31)], "clip long, start long, end long")
    assert labels.union_length(s, ["clip"]).first().covered == 21
    box = lambda x: (float(x), 0.0, float(x) + 40, 100.0)
    rows = [(1, 0, 0, 10, box(0), box(0), 11), (1, 1, 20, 30, box(5), box(5), 11), (1, 2, 20, 60, box(9000), box(9000), 20), (1, 3, 40, 50, box(9), box(9), 11)]
    t = spark.createDataFrame(rows, "clip long, track_id long, first_frame long, last_frame long, first_box struct<x1: double, y1: double, x2: double, y2: double>, last_box struct<x1: double, y1: double, x2: double, y2: double>, n_frames long")
    assert sorted(r.track_id for r in tracks.heaviest_chain(t, ["clip"], 15.0).collect()) == [0, 1, 3]


def test_skeleton_functions(spark):
    rng = np.random.default_rng(1)
    x = rng.random((5, 17, 3)) * 50
    x[..., 2] = rng.random((5, 17)) + 0.1
    x[2] = 0
    df = spark.createDataFrame([(x.tolist(), [True, True, False, True, True])], "f array<array<array<double>>>, p array<boolean>")
    got = lambda c: np.array(df.select(c.alias("x")).first().x)
    hip, sh = (x[:, 11, :2] + x[:, 12, :2]) / 2, (x[:, 5, :2] + x[:, 6, :2]) / 2
    scale = np.linalg.norm(sh - hip, axis=1)[[0, 1, 3, 4]].mean()
    want = x.copy()
    want[..., :2] = (x[..., :2] - hip[0]) / scale
    want[2] = 0
    assert np.allclose(got(skeleton.normalised(F.col("f"))), want)
    moved = x.copy()
    moved[..., :2] = moved[..., :2] * 3 + 7
    moved[2] = 0
    df2 = spark.createDataFrame([(moved.tolist(),)], "f array<array<array<double>>>")
    assert np.allclose(np.array(df2.select(skeleton.normalised(F.col("f")).alias("x")).first().x)[..., :2], want[..., :2])
    place = np.linspace(0, 4, 9)
    lo = np.floor(place).astype(int)
    w = (place - lo)[:, None, None]
    assert np.allclose(got(skeleton.resampled(F.col("f"), 9)), (1 - w) * x[lo] + w * x[np.minimum(lo + 1, 4)])
    filled = x.copy()
    filled[2] = (x[1] + x[3]) / 2
    assert np.allclose(got(skeleton.bridged(F.col("f"), F.col("p"))), filled)
    assert np.allclose(got(skeleton.motion(F.col("f"))), np.concatenate([x[1:] - x[:-1], 0 * x[:1]]))
    assert np.allclose(got(skeleton.mirrored(skeleton.mirrored(F.col("f")))), x)


def test_readers_keep_what_they_reject(spark, tmp_path):
    (tmp_path / "P01T01C01.csv").write_text("event,start_frame,end_frame\nWalk,1,5\nstroll;6;9\n3\t2\t1\nOdd,1,2\nSit,x,2\nSit,1\n\n")
    (tmp_path / "P02T01C01.csv").write_text("1,10,20\n9,1,2\n")
    classes = spark.createDataFrame([("Walk", 0), ("Sit", 1), ("Lie", 2), ("Eat", 3)], "name string, class int")
    got = annotations.spans_from_csv(spark, str(tmp_path / "*.csv"), classes, spark.createDataFrame([("stroll", "Walk")], "alias string, name string")).collect()
    ok = sorted((r["class"], r.start, r.end) for r in got if r.reject_reason is None)
    assert ok == [(0, 1, 5), (0, 6, 9), (1, 10, 20)]
    assert sorted(r.reject_reason for r in got if r.reject_reason) == ["class out of range", "end before start", "fewer than three fields", "start or end is not a number", "unknown class"]
    (tmp_path / "a.json").write_text('{"P03T01C01": {"subset": "training", "duration": 100, "actions": [[1, 2, 5], [9, 1, 2], [0, 8, 3]]}, "P25T02C05": {"subset": "testing", "duration": 9, "actions": []}}')
    j = annotations.spans_from_json(spark, str(tmp_path / "a.json"), 4).collect()
    assert len(j) == 4 and sum(r.reject_reason is None for r in j) == 2
    (tmp_path / "clip.json").write_text('{"njts": 2, "frames": [[{"pose2d": [], "pose3d": [1, 2, 3, 4, 5, 6]}], [], [{"pose3d": [0, 0, 0, 0, 0, 0]}]]}')
    p = annotations.poses(spark, str(tmp_path / "clip.json"))
    rows = {r.frame_idx: r for r in p.collect()}
    assert rows[0].joints == [[1, 3, 5], [2, 4, 6]] and not rows[1].present and rows[0].clip == "clip"
    c = annotations.coverage(p).first()
    assert (c.n, c.detected, c.longest_gap, c.usable) == (3, 2, 1, True)


def test_upsert_keeps_the_last(spark):
    a, b = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k long, v string, s int"), spark.createDataFrame([(2, "z", 2), (3, "w", 2)], "k long, v string, s int")
    assert sorted((r.k, r.v) for r in sinks.upsert(a, b, ["k"], "s").collect()) == [(1, "x"), (2, "z"), (3, "w")]


def test_shards_and_augmentation(spark, tmp_path):
    from dayweave.sources import shards

    x = np.arange(3 * 2 * 17 * 3, dtype=np.float32).reshape(3, 2, 17, 3)
    np.savez(tmp_path / "a.npz", skeletons=x, labels=np.array([0, 7, 2]), subjects=np.array(["p1", "p1", "p2"]))
    got = {r.row: r for r in shards.shards_from_npz(spark, str(tmp_path / "*.npz"), 5).collect()}
    assert [got[i].reject_reason for i in range(3)] == [None, "label out of range", None] and got[2].subject == "p2" and got[2].shape == [2, 17, 3]
    assert np.allclose(got[1].skeleton, x[1].ravel())
    df = spark.createDataFrame([(1, x[1].ravel().tolist()), (1, x[1].ravel().tolist()), (2, x[1].ravel().tolist())], "k long, s array<float>")
    a, b, c = (r.v for r in df.select("k", shards.augmented(F.col("s"), F.col("k")).alias("v")).orderBy("k").collect())
    assert a == b != c and len(a) == x[1].size


def test_responses_are_repaired_but_never_filled_in(spark):
    from dayweave.operators import responses

    raw = [
        'Sure:\n```json\n{"claims": [{"claim_id": "", "text": " a } b ", "evidence_ref": "\'feat:meal_events:2024/01/01\'", "claimed_value": "1,800.0", "claimed_pct_change": "-12.5 %", "direction": "Decreased"}]}\n``` bye }',
        '{"claims": [{"claim_id": 7, "text": "t", "evidence_ref": "meals", "claimed_value": "many", "direction": "sideways"}]}',
        '{"claims": "none"}', '{"claims": [', "no json", None, '{"claims": []}', '{"claims": [{"text": "cut of', '{"claims": nothing}',
    ]
    got = responses.claims_of(spark.createDataFrame(list(enumerate(raw)), "k long, raw_response string")).orderBy("k").collect()
    a, b = got[0], got[1]
    assert (a.claim_id, a.text, a.evidence_ref, a.claimed_value, a.claimed_pct_change, a.direction, a.reject_reasons) == ("c1", "a } b", "feat:meal_events:2024-01-01", 1800.0, -12.5, "decrease", [])
    assert b.claim_id == "7" and b.claimed_value is None and len(b.reject_reasons) == 3
    assert [g.response_error for g in got[2:]] == ["claims are not a list", "truncated JSON", "no JSON object", "no JSON object", None, "truncated JSON", "malformed JSON"]
    strict = [r.s.error for r in spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "a": 2}',), ('{"a": NaN}',), ('{"a": 1} x',), ("[1]",)], "t string").coalesce(1).select(responses.strict_object(F.col("t")).alias("s")).collect()]
    assert strict[0] is None and all(strict[1:])


def test_recurrences_have_bounded_groups_that_grow_in_number(spark, monkeypatch):
    """The grouped Python of tracks and sequences: no group above its bound, more groups on more data."""
    from dayweave.plans import observations as O

    seen = []
    kind = type(spark.range(1).groupBy("id"))
    real = kind.applyInPandas
    monkeypatch.setattr(kind, "applyInPandas", lambda self, *a: (seen.append(self.count().agg(F.max("count"), F.count("*")).first()), real(self, *a))[1])
    for name, most in (("tracker", 10 * O.CLIP_FRAMES), ("person_slots", 10 * O.CLIP_FRAMES), ("asserted_subject", 10), ("decoded_windows", O.SEQUENCE_WINDOWS)):
        groups = []
        for sf in ("sf0.001", "sf0.01", "sf0.1"):
            seen.clear()
            O.QUERIES[name](spark, f"/root/testdata/{sf}")
            assert len(seen) == 1 and 0 < seen[0][0] <= most, (name, sf, seen)
            groups.append(seen[0][1])
        assert groups == sorted(groups) and groups[-1] > groups[0], (name, groups)
    got = O.QUERIES["decoded_windows"](spark, "/root/testdata/sf0.001")
    assert got.count() == O.val_logits(spark, "/root/testdata/sf0.001").count()
