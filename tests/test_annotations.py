"""Agreement of sources, interval joins with bad bounds, number tokens, bridged gaps, report outcomes: against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayweave.functions.skeleton import bridged
from dayweave.functions.text import number_tokens, request_fault, same_numbers, translation_fault
from dayweave.operators import labels as L
from dayweave.operators import responses as R


def cells(spans, duration, steps, n_classes):
    out = np.zeros((steps, n_classes), bool)
    at = np.arange(steps) * (duration / steps)
    for c, a, b in spans:
        if 0 <= c < n_classes:
            out[(at >= a) & (at <= b), c] = True
    return out


def test_agreement_equals_the_cells(spark):
    rng = random.Random(6)
    a, b, videos = {}, {}, {}
    for v in range(25):
        videos[v] = rng.choice([1.0, 7.5, 100.0, 333.0, 1000.25])
        spans = [(rng.randrange(-1, 5), s := rng.uniform(-5, videos[v]), s + rng.uniform(0, videos[v] / 3)) for _ in range(rng.randrange(1, 9))]
        a[v] = spans + [spans[0]]
        b[v] = [(c, s, e) if rng.random() < 0.6 else (c, s + rng.uniform(0, 3), e) for c, s, e in spans]
    c, s, e = a[3][0]
    b[3] = [(c, s, (s + e) / 2), (c, (s + e) / 2, e), *a[3][1:-1]]  # split in two, the same frames
    a[4], b[4] = [(1, 2.0, 5.0)], [(1, 9.0, 9.0)]
    del a[23], b[24]
    frame = lambda d: spark.createDataFrame([(v, c, float(s), float(e)) for v in d for c, s, e in d[v]], "video long, class int, start double, end double").repartition(3)
    v = spark.createDataFrame(list(videos.items()), "video long, duration double")
    for most in (20_000, 64):
        got = {r.video: r for r in L.agreement(frame(a), frame(b), v, "video", 4, most).collect()}
        assert set(got) == set(range(23))
        for k, r in got.items():
            steps = min(max(int(videos[k]), 1), most)
            x, y = cells(a[k], videos[k], steps, 4), cells(b[k], videos[k], steps, 4)
            assert (r.n_steps, r.cells_differing) == (steps, int((x != y).sum())) and r.agreement == pytest.approx((x == y).mean(), abs=1e-12)
    assert got[3].cells_differing == 0
    s = L.agreement_summary(L.agreement(frame(a), frame(b), v, "video", 4)).first()
    assert s.compared == 23 and 0 < s.below < 23 and s.least_agreement < s.mean_agreement < 1
    none = L.agreement_summary(L.agreement(frame(a).limit(0), frame(b), v, "video", 4)).first()
    assert (none.compared, none.mean_agreement, none.below) == (0, 0.0, 0)


def test_interval_joins_with_bad_ends_lose_and_repeat_nothing(spark):
    rng = random.Random(2)
    spans = lambda n, odd: [(i, rng.randrange(3), s := rng.uniform(0, 500), s + (1e12 if i in odd else rng.uniform(-1, 9))) for i in range(n)]
    a, b = spans(150, (3, 77)), spans(150, (5, 78, 79))
    left, right = spark.createDataFrame(a, "i long, k int, ls double, le double"), spark.createDataFrame(b, "j long, k int, rs double, re double")
    got = [(r.i, r.j) for r in L.interval_join(left, right, ["k"], ("ls", "le"), ("rs", "re"), 2.0).collect()]
    want = [(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[3] > x[2] and y[3] > y[2] and x[2] < y[3] and y[2] < x[3]]
    assert sorted(got) == sorted(want) and len(want) > 100


PAIRS = [
    ("fell -54.7 %", "rose 54.7", False), ("5%", "5", False), ("5 %", "5%", True), ("1e5", "1 5", False), ("1,810", "1810", False), ("820", "८२०", False), ("820 820", "820", False),
    ("+3 and −4", "−4 and +3", True), ("a 1.5 b 2", "2 c 1.5", True), ("7‰", "7%", False), ("none", "keine", True), ("1.5.", "1.5", True), ("x-5", "x 5", False), ("", "", True),
]


def test_number_tokens(spark):
    df = spark.createDataFrame(PAIRS, "a string, b string, same boolean").select("a", "b", "same", same_numbers(F.col("a"), F.col("b")).alias("got"), number_tokens(F.col("a")).alias("tokens"))
    rows = df.collect()
    assert [(r.a, r.b) for r in rows if r.got != r.same] == []
    assert rows[0].tokens == ["-54.7%"] and rows[3].tokens == ["1e5"] and rows[4].tokens == ["1,810"]


def test_translation_faults(spark):
    en, hi = "Walking fell to 820 s (-54.7%).", "चलना 820 s तक गिरा (-54.7 %)।"
    cases = [
        (en, hi, None), (en, hi.replace("820", "821"), "changed numbers"), (en, hi.replace("-54.7", "54.7"), "changed numbers"), (en, hi.replace("820", "८२०"), "changed numbers"), (en, en, "not in the script asked for"), (en, "", "missing or invented prose"),
        ("", "कुछ", "missing or invented prose"), ("", " ", None), (en, None, "not a text"), (en, hi + "क" * 6000, "too long"), (en, hi + "\u0007", "control characters"), (en, hi + "\t\n", None),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r.i: r.f for r in df.select("i", translation_fault(F.col("a"), F.col("b"), "summary").alias("f")).collect()}
    assert got == {i: why for i, (_, _, why) in enumerate(cases)}
    asked = spark.createDataFrame([("a" * 2001,), ("a\x00b",), (None,), ("a" * 2000,)], "t string").select(request_fault(F.col("t"), "summary").alias("f"))
    assert [r.f for r in asked.collect()] == ["too long", "control characters", "not a text", None]


def test_bridging_equals_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    rows = []
    for n in (1, 2, 7, 30):
        for share in (0.0, 0.2, 0.6, 1.0):
            x = rng.normal(size=(n, 2, 3))
            rows.append((x.tolist(), (rng.random(n) < share).tolist()))
    df = spark.createDataFrame(rows, "frames array<array<array<double>>>, present array<boolean>")
    for r in df.select("frames", "present", bridged(F.col("frames"), F.col("present")).alias("b")).collect():
        x, seen = np.array(r.frames), np.flatnonzero(r.present)
        want = x if not len(seen) else np.stack([[[np.interp(i, seen, x[seen, j, c]) for c in range(3)] for j in range(2)] for i in range(len(x))])
        assert np.allclose(np.array(r.b), want)
    long = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(20_000)), lambda i: F.array(F.array(i.cast("double")))).alias("f"), F.transform(F.sequence(F.lit(0), F.lit(20_000)), lambda i: i % 50 == 0).alias("p"))
    assert [v[0][0] for v in long.select(bridged(F.col("f"), F.col("p")).alias("b")).first().b] == pytest.approx(list(range(20_001)))


def test_outcomes_of_responses(spark):
    ok = '{"claim_id": "c1", "text": "walking was 5", "evidence_ref": "feat:walking_duration_s:2024-01-05", "claimed_value": 5, "direction": "increase"}'
    loose = ok.replace('"c1"', '" "').replace("feat:", "`feat:").replace("-05", "/05`").replace("2024-01/05`", "2024/01/05`").replace('"increase"', '"Increased"')
    broken = ok.replace("feat:", "fact:").replace("5,", '"five",')
    body = lambda claims, **more: "{" + ", ".join([f'"claims": {claims}', *(f'"{k}": "{v}"' for k, v in more.items())]) + "}"
    raws = [
        body(f"[{ok}, {loose}, {broken}]", summary="s" * 401, recommendation="r" * 300), body(f"[{', '.join([ok] * 9)}]"), '{"claims": [', body('{"a": 1}'), "no object here", body("[]", summary="fine"),
    ]
    responses = spark.createDataFrame([(1, i, r) for i, r in enumerate(raws)], "home_id long, n int, raw_response string").withColumn("day", F.lit("2024-01-05").cast("date"))
    index = spark.createDataFrame([(1, "walking_duration_s", "2024-01-05", "feature", "feat:walking_duration_s:2024-01-05", 5.0, 2.0, 1.5, 150.0, 3.0, 14)], "home_id long, feature string, day string, source string, ref string, observed double, baseline_median double, robust_z double, pct_change double, delta double, baseline_n_days long").withColumn("day", F.to_date("day"))
    got = {r.n: r for r in R.outcomes(responses, index, "home_id", "day", "n").collect()}
    counts = lambda r: (r.parse_failed, r.n_emitted, r.n_claims, r.n_repaired, r.n_dropped, r.n_faithful)
    assert counts(got[0]) == (False, 3, 2, 1, 1, 2) and got[0].rejections == ["claimed_value: not a number (got five)", "evidence_ref: pattern"]
    assert len(got[0].summary) == 400 and got[0].notes == ["summary: 401 characters, cut to 400"] and len(got[0].recommendation) == 300
    assert counts(got[1]) == (False, 6, 6, 0, 0, 6)
    assert counts(got[2]) == counts(got[4]) == (True, 0, 0, 0, 0, 0) and got[2].notes == ["response: truncated JSON"] and got[4].notes == ["response: no JSON object"]
    assert counts(got[3]) == counts(got[5]) == (False, 0, 0, 0, 0, 0) and got[3].notes == ["claims: not a list"] and (got[5].summary, got[5].notes) == ("fine", [])
    strict = {r.n: r for r in R.outcomes(responses, index, "home_id", "day", "n", salvage=False).collect()}
    assert counts(strict[0]) == (False, 3, 1, 0, 2, 1)
    s = R.run_summary(R.outcomes(responses, index, "home_id", "day", "n"), "home_id").first()
    assert (s.n_reports, s.n_emitted, s.n_claims, s.n_repaired, s.n_faithful, s.parse_failures, s.schema_rejected) == (6, 9, 8, 1, 8, 2, 1)
    assert s.unfaithful_rate == 0 and s.unusable_rate == pytest.approx(1 / 9) and s.per_report_median == 0 and s.top_causes == ["claimed_value: not a number: 1", "evidence_ref: pattern: 1"]
