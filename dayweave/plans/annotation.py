"""Annotation and behaviour-evaluation queries with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.config import ACTIVITIES, SEVERITY
from dayweave.functions.text import number_tokens, request_fault, same_numbers, slug, translation_fault
from dayweave.operators import labels as L
from dayweave.operators.reports import scenario_rollup
from dayweave.plans.behaviour import features, q_alerts
from dayweave.plans.behaviour_sql import ALERTS, SEGMENTS
from dayweave.plans.observations import _keyword_sql
from dayweave.sources import domain, sinks
from dayweave.sources.shared import scratch, staged
from dayweave.sources.state import KeyedTable

UNMAPPED, DROPPED = ("personal_hygiene", "reading"), ("cooking_food_prep",)
EXPECTED = ("fall_detected", "mobility_decline", "social_isolation", "meal_skipped", "hydration_low", "medication_missed")
ABSOLUTE = ("fall_detected", "fall_no_recovery", "prolonged_inactivity")


def actions(s: SparkSession, d: str) -> DataFrame:
    """Spans of each user: action_id, label, start and end in seconds since 1970."""
    return domain.segments(s, d).select(F.col("track_id").alias("clip"), F.col("segment_id").alias("action_id"), F.col("activity_name").alias("label"), (F.col("start_us") / 1_000_000).alias("a_start"), (F.col("end_us") / 1_000_000).alias("a_end"))


def label_map(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(a, a, a in DROPPED) for a in ACTIVITIES if a not in UNMAPPED], "label string, class string, drop boolean")


def grid(s: SparkSession, d: str) -> DataFrame:
    """Three two-second windows around the start of every span."""
    w = actions(s, d).select("clip", F.explode(F.array(*[F.struct((F.col("action_id") * 3 + k).alias("window_id"), (F.floor(F.col("a_start")) + k - 1).cast("double").alias("w_start")) for k in range(3)])).alias("w"))
    return w.select("clip", "w.window_id", "w.w_start", (F.col("w.w_start") + 2).alias("w_end"))


def videos(s: SparkSession, d: str) -> DataFrame:
    """Spans in whole minutes since each user's first: clip, class, start, end; and the length of each clip."""
    e = domain.segments(s, d)
    first = e.groupBy("track_id").agg(F.min("start_us").alias("t0"))
    at = lambda c: F.floor((F.col(c) - F.col("t0")) / 60_000_000).cast("long")
    return e.join(first.hint("shuffle_hash"), "track_id").select(F.col("track_id").alias("clip"), F.col("activity_id").cast("long").alias("class"), at("start_us").alias("start"), (at("end_us") + 30).alias("end"), F.col("segment_id"))


def lengths(s: SparkSession, d: str, v: DataFrame | None = None) -> DataFrame:
    return (videos(s, d) if v is None else v).groupBy("clip").agg(F.max("end").cast("double").alias("duration")).withColumn("n_steps", F.lit(2000).cast("long"))


def q_window_labels(s, d):
    return L.best_covering(grid(s, d), actions(s, d), label_map(s), "clip", 1.2, "other_idle", 120.0).select("clip", "window_id", "class")


def q_overlaps(s, d):
    """How many spans of the same user each window touches."""
    j = L.interval_join(grid(s, d), actions(s, d), ["clip"], ("w_start", "w_end"), ("a_start", "a_end"), 120.0)
    return j.groupBy("clip", "window_id").agg(F.count("*").alias("n"), F.round(F.sum(F.least("w_end", "a_end") - F.greatest("w_start", "a_start")), 6).alias("covered"))


def q_mapped(s, d):
    return L.mapped(actions(s, d), label_map(s), ["label"]).groupBy("class").agg(F.count("*").alias("n"))


def q_fall_windows(s, d):
    v = videos(s, d)
    w = v.select("clip", "start").distinct()
    falls = v.filter("clip % 3 <> 2").groupBy("clip").agg(F.when(F.first("clip") % 3 == 0, F.min(F.when(F.col("class") == 7, F.col("start")))).otherwise(F.lit(0)).cast("long").alias("lo"), F.when(F.first("clip") % 3 == 0, F.max(F.when(F.col("class") == 7, F.col("end")))).otherwise(F.lit(0)).cast("long").alias("hi"))
    return L.fall_windows(w, falls, "clip", 30)


def q_steps(s, d):
    return L.step_labels(videos(s, d).drop("segment_id"), lengths(s, d), "clip").groupBy("clip", "class").agg(F.count("*").alias("n_steps"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


def q_annotated(s, d):
    """Windows of four steps, every two, of which half is annotated with one class."""
    steps = L.step_labels(videos(s, d).drop("segment_id"), lengths(s, d), "clip", closed=True)
    w = lengths(s, d).select("clip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_steps") - 4, F.lit(2).cast("long"))).alias("start"))
    return L.annotated_windows(steps, w, "clip", 4)


def q_coarse_steps(s, d):
    steps = L.step_labels(videos(s, d).drop("segment_id"), lengths(s, d), "clip")
    m = s.createDataFrame([(i, i // 5) for i in range(20)], "class long, coarse int")
    return L.to_coarse(steps, m, ["clip", "step"]).groupBy("clip", "coarse").agg(F.count("*").alias("n_steps"))


def q_union(s, d):
    return L.union_length(videos(s, d), ["clip"])


def q_class_frames(s, d):
    c = L.class_frames(videos(s, d))
    return c.select("class", "frames", "instances", F.round("share", 6).alias("share"), F.round("imbalance", 6).alias("imbalance"))


def q_cross_check(s, d):
    v = videos(s, d)
    a = v.filter("clip % 10 <> 1").select("clip", "class", "start", "end")
    b = v.filter("clip % 9 <> 0 and segment_id % 10 <> 0").select("clip", "class", "start", "end")
    return L.cross_check(a, b, "clip")


def _sources(s, d):
    """Two annotation sources, and the lengths of their clips: the second source lacks some spans, has others split in two, and ends some a few frames early."""
    v = staged(videos(s, d), "videos")
    a = v.filter("clip % 10 <> 1").select("clip", "class", "start", "end")
    span = lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    early, cut = F.col("end") - F.when(F.col("segment_id") % 7 == 0, 5).otherwise(0), F.col("start") + 12
    parts = F.when(F.col("segment_id") % 3 == 0, F.array(span(F.col("start"), cut), span(cut, F.col("end")))).otherwise(F.array(span(F.col("start"), early)))
    b = v.filter("clip % 9 <> 0 and segment_id % 10 <> 0").select("clip", "class", F.explode(parts).alias("p")).select("clip", "class", "p.*")
    return a, b, lengths(s, d, v).select("clip", "duration")


def q_agreement(s, d):
    r = L.agreement(*_sources(s, d), "clip", 20)
    return r.select("clip", "n_steps", "cells_differing", F.round("agreement", 9).alias("agreement"))


def q_agreement_summary(s, d):
    r = L.agreement_summary(L.agreement(*_sources(s, d), "clip", 20))
    return r.select("compared", F.round("mean_agreement", 9).alias("mean_agreement"), F.round("least_agreement", 9).alias("least_agreement"), "below")


def q_keywords(s, d):
    """Activity names described in words, mapped back by keyword rules."""
    t = actions(s, d).select("action_id", F.concat(F.lit("Someone is "), F.replace("label", F.lit("_"), F.lit(" "))).alias("text"), "label")
    k = t.select("label", L.keyword_class(F.col("text")).alias("k"), slug(F.col("text")).alias("slug"))
    return k.groupBy("label", "slug").agg(F.first("k.class").alias("class"), F.first("k.dropped").alias("dropped"), F.count("*").alias("n"))


def q_names(s, d):
    """Ids parsed from file names made of the users' numbers; every fifth name is bad."""
    v = actions(s, d).select("clip").distinct()
    name = F.format_string("clip_P%02dT%02dC%02d", (F.col("clip") % 90).cast("int"), (F.col("clip") % 7).cast("int"), (F.col("clip") % 3).cast("int"))
    text = F.when(F.col("clip") % 5 == 0, F.concat(name, F.lit("_P99T01C01"))).otherwise(name)
    crop = F.when(F.col("clip") % 4 == 0, "notes.txt").otherwise(F.format_string("%04d_c%d_%04d.jpg", F.col("clip").cast("int"), (F.col("clip") % 15).cast("int"), (F.col("clip") % 33).cast("int")))
    c = v.select("clip", L.video_id(text).alias("v"), L.crop_name(crop, ("0000",)).alias("c"))
    return c.select("clip", "v.subject", "v.take", "v.camera", "c.pid", F.col("c.camera").alias("crop_camera"), "c.frame")


def q_token_match(s, d):
    """Whether neighbouring turns of a conversation hold the same numbers."""
    t = domain.table(s, d, "conversations").select("conv_id", "turn", "text")
    j = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")), ["conv_id", "turn"])
    return j.select("conv_id", "turn", F.size(number_tokens(F.col("text"))).alias("n_numbers"), same_numbers(F.col("text"), F.col("reply")).alias("same_numbers"))


def q_translations(s, d):
    """A line of figures for each line item, and what a careless translator makes of it: every line number another kind of change."""
    i = domain.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity")
    amount = F.format_number(F.col("l_extendedprice").cast("decimal(12,2)"), 2)
    share = F.format_string("-%d.5 %%", F.round(F.col("l_discount") * 100).cast("int"))
    count = F.col("l_quantity").cast("int").cast("string")
    original = F.concat(F.lit("Walking fell "), share, F.lit(" to "), amount, F.lit(" s, +"), count, F.lit(" steps"))
    told = lambda *parts: F.concat(F.lit("चलना "), *[F.lit(p) if isinstance(p, str) else p for p in parts])
    bare = lambda c, what: F.replace(c, F.lit(what), F.lit(""))
    kind = F.pmod(F.col("l_linenumber") + F.col("l_orderkey"), F.lit(9))
    text = (
        F.when(kind == 0, told(share, " ", amount, " +", count)).when(kind == 1, told("+", count, " ; ", bare(share, " "), " ; ", amount)).when(kind == 2, told(bare(share, "-"), " ", amount, " +", count))
        .when(kind == 3, told(bare(share, " %"), " ", amount, " +", count)).when(kind == 4, told(share, " ", bare(amount, ","), " +", count)).when(kind == 5, told(share, " ", amount, " +", F.translate(count, "0123456789", "०१२३४५६७८९")))
        .when(kind == 6, F.concat(share, F.lit(" "), amount, F.lit(" +"), count)).when(kind == 7, F.lit(" \t")).otherwise(told(share, " ", amount, " +", count, "e", count, "\u0001"))
    )
    t = i.select("l_orderkey", "l_linenumber", translation_fault(original, text, "summary").alias("fault"), request_fault(text, "summary").alias("unsent"))
    return t.groupBy("l_linenumber", "fault", "unsent").agg(F.count("*").alias("n"), F.sum("l_orderkey").cast("long").alias("orders"))


def q_upsert(s, d):
    """Segments ingested twice, the second time with changes: what the table holds."""
    one = domain.segments(s, d).withColumn("seq", F.lit(1))
    two = one.filter("segment_id % 3 = 0").withColumn("room", F.lit("corrected")).withColumn("seq", F.lit(2))
    return sinks.upsert(one, two, ["segment_id"], "seq").groupBy("room").agg(F.count("*").alias("n"), F.max("seq").alias("seq"))


def q_keyed_segments(s, d):
    """Segments kept by id: ingested, corrected, the correction sent again with other rows, and older rows sent late; what the table holds."""
    t = KeyedTable(s, scratch(s, "segments"), ["segment_id"], "seq", 8)
    one = domain.segments(s, d).select("segment_id", "home_id", "room").withColumn("seq", F.lit(1))
    changed = lambda every, room, seq: one.filter(F.col("segment_id") % every == 0).withColumn("room", F.lit(room)).withColumn("seq", F.lit(seq))
    t.merge(one, 0)
    t.merge(changed(3, "corrected", 2), 1)
    t.merge(changed(2, "sent again", 9), 1)
    t.merge(changed(5, "stale", 0), 2)
    return t.read().groupBy("home_id", "room", "seq").agg(F.count("*").alias("n"), F.sum("segment_id").alias("ids"))


def q_day_states(s, d):
    """Daily features and alerts kept by key, day by day in two overlapping batches and a replay."""
    root = scratch(s, "state")
    f = KeyedTable(s, f"{root}/features", ["home_id", "day"], "day", 4)
    a = KeyedTable(s, f"{root}/alerts", ["alert_id"], "day", 4)
    both = ((f, features(s, d).select("home_id", "day", "fall_events", "mobility_index")), (a, q_alerts(s, d).select("alert_id", "home_id", "day", "severity")))
    for t, rows in both:
        rows = staged(rows, "day-state")
        t.merge(rows.filter("day < '2024-01-20'"), 0)
        t.merge(rows.filter("day >= '2024-01-15'"), 1)
        t.merge(rows.limit(0), 1)
    n = a.read().groupBy("home_id", "day").agg(F.count("*").alias("n_alerts"), F.count_if(F.col("severity") == "emergency").alias("n_emergencies"))
    return f.read().join(n, ["home_id", "day"], "left").select("home_id", "day", "fall_events", F.round("mobility_index", 6).alias("mobility_index"), F.coalesce("n_alerts", F.lit(0)).cast("long").alias("n_alerts"), F.coalesce("n_emergencies", F.lit(0)).cast("long").alias("n_emergencies"))


def q_listing(s, d):
    return sinks.alerts_since(q_alerts(s, d), "2024-01-15", 50).select("home_id", "day", "alert_id", "kind")


def q_counts(s, d):
    return sinks.table_counts({"segments": domain.segments(s, d), "days": domain.days(s, d), "features": features(s, d), "alerts": q_alerts(s, d)})


def q_lookup(s, d):
    return sinks.segments_of(domain.segments(s, d), "2024-01-10", "resident").select("segment_id", "home_id", "activity_name")


def q_scenarios(s, d):
    """Each home as a scenario with an onset: the first expected and the first alert after it, earlier ones, the worst severity."""
    a = q_alerts(s, d)
    kinds = F.array(*[F.lit(k) for k in EXPECTED])
    onset = F.lit("2024-01-20").cast("date")
    order = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    days = domain.days(s, d).groupBy("home_id").agg(F.count("*").alias("n_days"))
    e = days.withColumn("expected", F.get(kinds, (F.col("home_id") % 6).cast("int"))).join(a, "home_id", "left")
    since = F.date_diff("day", onset)
    return e.groupBy("home_id", "expected", "n_days").agg(
        F.min(F.when((F.col("kind") == F.col("expected")) & (since >= 0), since)).alias("latency_days"), F.min(F.when(since >= 0, since)).alias("any_latency_days"),
        F.count_if(since < 0).alias("before_onset"), F.max_by("severity", order[F.col("severity")]).alias("worst"), F.count_if((since < 0) & ~F.col("kind").isin(*ABSOLUTE)).alias("false_alerts"),
    )


def q_scenario_summary(s, d):
    """Recall, median latency and alerts before onset per 100 days, by expected kind."""
    r = q_scenarios(s, d).groupBy("expected").agg(F.avg(F.col("latency_days").isNotNull().cast("double")).alias("recall"), F.percentile("latency_days", F.lit(0.5)).alias("median_latency"), (100.0 * F.sum("false_alerts") / F.sum("n_days")).alias("false_per_100_days"), F.count("*").alias("n"))
    return r.select("expected", *[F.round(c, 6).alias(c) for c in ("recall", "median_latency", "false_per_100_days")], "n")


PERSONAS = ("steady", "restless", "irregular")


def q_personas(s, d):
    """Homes as scenarios of three personas, every fourth one a control: recall, latency and false alerts of each persona."""
    a = q_alerts(s, d).groupBy("home_id").agg(F.count_if(~F.col("kind").isin(*ABSOLUTE)).alias("n_relative"))
    r = q_scenarios(s, d).join(a, "home_id", "left")
    persona = F.get(F.array(*[F.lit(p) for p in PERSONAS]), (F.col("home_id") % 3).cast("int"))
    r = r.select(persona.alias("persona"), (F.col("home_id") % 4 == 1).alias("is_control"), "latency_days", F.coalesce("n_relative", F.lit(0)).alias("n_relative"), "n_days")
    return scenario_rollup(r, "persona").select("persona", *[F.round(c, 6).alias(c) for c in ("recall", "median_latency", "control_false_per_100_days")], "n_scenarios", "n_controls")


def q_strict_names(s, d):
    """Names of untrimmed and trimmed clips made of the users' numbers, in forms that the strict parsers take and in others."""
    v = actions(s, d).select("clip").distinct()
    k = lambda n: (F.col("clip") % n).cast("int")
    tsu = F.when(F.col("clip") % 3 == 0, F.format_string(" P%02dT%02dC%02d ", k(90), k(7), k(3))).otherwise(F.format_string("P%02dT%02dC%02d.mp4", k(90), k(7), k(3)))
    tsm = F.when(F.col("clip") % 4 == 0, F.format_string("Cook-Cut_p%02d_r01_v02_c03.mp4", k(90))).when(F.col("clip") % 4 == 1, F.format_string("a/b/Cook.Cut_p%02d_r%02d_v02_c%02d_pose3d.json", k(90), k(7), k(3))).otherwise(F.format_string("Walk_p%02d_r%02d_15_c%02d.mp4.npz", k(90), k(7), k(3)))
    r = v.select("clip", L.strict_video_id(tsu).alias("u"), L.trimmed_name(tsm).alias("t"))
    return r.select("clip", F.col("u.subject").alias("subject"), F.col("u.camera").alias("camera"), "t.activity", F.col("t.subject").alias("t_subject"), F.col("t.take").alias("t_take"), "t.view", F.col("t.camera").alias("t_camera"), "t.tag")


def q_own_ranges(s, d):
    """Clips with their own annotation, beside or above them, of every kind: a fall, none, turned round, not numbers, missing."""
    v = actions(s, d).select(F.col("clip").cast("int").alias("clip")).distinct()
    clips = v.select("clip", F.format_string("Home/room %d/video (%d).avi", F.col("clip") % 3, F.col("clip")).alias("path"))
    where = F.when(F.col("clip") % 2 == 0, F.format_string("Home/room %d/Annotation_files/video (%d).txt", F.col("clip") % 3, F.col("clip"))).otherwise(F.format_string("Home/video (%d).txt", F.col("clip")))
    text = F.when(F.col("clip") % 6 == 0, F.lit("0\n0\n1,2,3")).when(F.col("clip") % 6 == 1, F.concat(F.lit("\n "), F.col("clip").cast("string"), F.lit("\r\n\n"), (F.col("clip") + 40).cast("string"), F.lit("\n7"))).when(F.col("clip") % 6 == 2, F.lit("50\n9")).when(F.col("clip") % 6 == 3, F.lit("x\ny")).otherwise(F.format_string("%d.0\n%d.9", F.col("clip"), F.col("clip") + 1))
    far = v.filter("clip % 6 = 1").select(F.format_string("Home/Annotation_files/video (%d).txt", F.col("clip")).alias("path"), F.lit("1\n2").alias("text"))
    texts = v.filter("clip % 6 <> 5").select(where.alias("path"), text.alias("text")).unionByName(far)
    r = L.with_own_range(clips, texts)
    return r.select("clip", F.col("fall.lo").alias("lo"), F.col("fall.hi").alias("hi"))


QUERIES = {
    "personas": q_personas, "strict_names": q_strict_names, "own_ranges": q_own_ranges,
    "window_labels": q_window_labels, "interval_overlaps": q_overlaps, "mapped_labels": q_mapped, "fall_windows": q_fall_windows, "step_labels": q_steps, "annotated_windows": q_annotated, "coarse_steps": q_coarse_steps,
    "annotated_union": q_union, "class_frames": q_class_frames, "annotation_cross_check": q_cross_check, "annotation_agreement": q_agreement, "agreement_summary": q_agreement_summary, "keyword_classes": q_keywords, "parsed_names": q_names, "number_preservation": q_token_match, "translation_faults": q_translations,
    "segment_upsert": q_upsert, "keyed_segments": q_keyed_segments, "day_states": q_day_states, "alert_listing": q_listing, "table_counts": q_counts, "segment_lookup": q_lookup, "scenario_latency": q_scenarios, "scenario_summary": q_scenario_summary,
}

# ---- SQL ------------------------------------------------------------------------------------------------------

_ACT = f"""{SEGMENTS},
act AS (SELECT track_id AS clip, segment_id AS action_id, activity_name AS label, start_us / 1000000 AS a_start, end_us / 1000000 AS a_end FROM segments),
grid AS (SELECT clip, action_id * 3 + k AS window_id, floor(a_start) + k - 1 AS w_start, floor(a_start) + k + 1 AS w_end FROM act, range(3) r(k)),
hits AS (SELECT g.*, label, action_id, least(w_end, a_end) - greatest(w_start, a_start) AS cover FROM grid g JOIN act a ON g.clip = a.clip AND w_start < a_end AND a_start < w_end)"""
_VID = f"""{SEGMENTS},
vid AS (SELECT track_id AS clip, activity_id::BIGINT AS class, (start_us - t0) // 60000000 AS "start", (end_us - t0) // 60000000 + 30 AS "end", segment_id FROM segments JOIN (SELECT track_id, min(start_us) AS t0 FROM segments GROUP BY track_id) USING (track_id)),
len AS (SELECT clip, max("end")::DOUBLE AS duration FROM vid GROUP BY clip)"""
_STEP = lambda strict: f"""{_VID}, step AS (SELECT DISTINCT v.clip, i AS step, class FROM vid v JOIN len USING (clip), range(2000) r(i) WHERE i * (duration / 2000) {'>' if strict else '>='} "start" AND i * (duration / 2000) {'<' if strict else '<='} "end")"""
#: The cells themselves, step by step; the sweep never makes them.
_AGREE = f"""{_VID},
one AS (SELECT DISTINCT clip, class, "start", "end" FROM vid WHERE clip % 10 <> 1),
raw AS (SELECT *, segment_id % 3 = 0 AS split FROM vid WHERE clip % 9 <> 0 AND segment_id % 10 <> 0),
two AS (SELECT clip, class, "start", "end" - CASE WHEN segment_id % 7 = 0 THEN 5 ELSE 0 END AS "end" FROM raw WHERE NOT split
  UNION ALL SELECT clip, class, "start", "start" + 12 FROM raw WHERE split UNION ALL SELECT clip, class, "start" + 12, "end" FROM raw WHERE split),
st AS (SELECT clip, duration, least(greatest(floor(duration)::BIGINT, 1), 20000) AS n_steps FROM len WHERE clip IN (SELECT clip FROM one) AND clip IN (SELECT clip FROM two)),
near AS (SELECT clip, duration, n_steps, src, class, "start", "end", greatest(0, floor("start" / (duration / n_steps))::BIGINT - 1) AS lo, least(n_steps - 1, ceil("end" / (duration / n_steps))::BIGINT + 1) AS hi FROM (SELECT 1 AS src, * FROM one UNION ALL SELECT 2, * FROM two) JOIN st USING (clip) WHERE class BETWEEN 0 AND 19),
cell AS (SELECT DISTINCT clip, src, class, i FROM (SELECT *, unnest(range(lo, hi + 1)) AS i FROM near) WHERE i * (duration / n_steps) >= "start" AND i * (duration / n_steps) <= "end"),
alone AS (SELECT clip, count(*) AS n FROM (SELECT clip, class, i FROM cell GROUP BY ALL HAVING count(*) = 1) GROUP BY clip),
agree AS (SELECT clip, n_steps, coalesce(n, 0) AS cells_differing, 1 - coalesce(n, 0) / (n_steps * 20) AS agreement FROM st LEFT JOIN alone USING (clip))"""
#: Tokens by hand: the sign, the digits with their separators, the exponent, the percent sign, each looked at on its own.
_TOKENS = lambda t: rf"list_sort(list_transform(regexp_extract_all({t}, '[+\-\x{{2212}}]?\p{{Nd}}+([,.]\p{{Nd}}+)*([eE][+\-]?\p{{Nd}}+)?([\s\p{{Z}}]*[%\x{{2030}}])?'), lambda x: regexp_replace(x, '[\s\p{{Z}}]', '', 'g')))"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_SCEN = f"""{ALERTS},
n AS (SELECT home_id, count(*) AS n_days FROM days GROUP BY home_id),
e AS (SELECT n.home_id, n_days, ({list(EXPECTED)})[n.home_id % 6 + 1] AS expected, kind, severity, day - DATE '2024-01-20' AS since FROM n LEFT JOIN alerts USING (home_id)),
scen AS (SELECT home_id, expected, n_days, min(since) FILTER (WHERE kind = expected AND since >= 0) AS latency_days, min(since) FILTER (WHERE since >= 0) AS any_latency_days, count(*) FILTER (WHERE since < 0) AS before_onset,
  arg_max(severity, list_position(['info', 'advisory', 'urgent', 'emergency'], severity)) AS worst, count(*) FILTER (WHERE since < 0 AND kind NOT IN {_IN(ABSOLUTE)}) AS false_alerts FROM e GROUP BY ALL)"""
_WIN = f"WITH {_ACT}, best AS (SELECT clip, window_id, arg_max(label, (cover, -action_id)) AS label FROM hits WHERE cover >= 1.2 AND label NOT IN {_IN(UNMAPPED)} GROUP BY ALL) SELECT clip, window_id, coalesce(label, 'other_idle') AS class FROM grid LEFT JOIN best USING (clip, window_id) WHERE coalesce(label, '') NOT IN {_IN(DROPPED)}"
ORACLES = {
    "personas": f"""WITH {_SCEN}, rel AS (SELECT home_id, count(*) FILTER (WHERE kind NOT IN {_IN(ABSOLUTE)}) AS n_relative FROM alerts GROUP BY home_id),
p AS (SELECT ({list(PERSONAS)})[home_id % 3 + 1] AS persona, home_id % 4 = 1 AS is_control, latency_days, coalesce(n_relative, 0) AS n_relative, n_days FROM scen LEFT JOIN rel USING (home_id))
SELECT persona, round(coalesce(avg((latency_days IS NOT NULL)::INT) FILTER (WHERE NOT is_control), 0), 6) AS recall, round(median(latency_days) FILTER (WHERE NOT is_control), 6) AS median_latency,
  round(coalesce(100 * sum(n_relative) FILTER (WHERE is_control) / sum(n_days) FILTER (WHERE is_control), 0), 6) AS control_false_per_100_days, count(*) AS n_scenarios, count(*) FILTER (WHERE is_control) AS n_controls FROM p GROUP BY persona""",
    "strict_names": f"""WITH {SEGMENTS}, v AS (SELECT DISTINCT track_id AS clip FROM segments)
SELECT clip, CASE WHEN clip % 3 = 0 THEN (clip % 90)::INT END AS subject, CASE WHEN clip % 3 = 0 THEN (clip % 3)::INT END AS camera, CASE WHEN clip % 4 = 1 THEN 'Cook.Cut' WHEN clip % 4 > 1 THEN 'Walk' END AS activity,
  CASE WHEN clip % 4 > 0 THEN (clip % 90)::INT END AS t_subject, CASE WHEN clip % 4 > 0 THEN (clip % 7)::INT END AS t_take, CASE WHEN clip % 4 = 1 THEN 'v02' WHEN clip % 4 > 1 THEN '15' END AS view, CASE WHEN clip % 4 > 0 THEN (clip % 3)::INT END AS t_camera, CASE WHEN clip % 4 = 1 THEN 'pose3d' END AS tag FROM v""",
    "own_ranges": f"""WITH {SEGMENTS}, v AS (SELECT DISTINCT track_id::INT AS clip FROM segments)
SELECT clip, CASE clip % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 4 THEN clip END::BIGINT AS lo, CASE clip % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 4 THEN clip + 1 END::BIGINT AS hi FROM v""",
    "window_labels": _WIN,
    "interval_overlaps": f"WITH {_ACT} SELECT clip, window_id, count(*) AS n, round(sum(cover), 6) AS covered FROM hits GROUP BY ALL",
    "mapped_labels": f"WITH {_ACT} SELECT label AS class, count(*) AS n FROM act WHERE label NOT IN {_IN((*UNMAPPED, *DROPPED))} GROUP BY label",
    "fall_windows": f"""WITH {_VID}, w AS (SELECT DISTINCT clip, "start" FROM vid), f AS (SELECT clip, CASE WHEN clip % 3 = 0 THEN min("start") FILTER (WHERE class = 7) ELSE 0 END AS lo, CASE WHEN clip % 3 = 0 THEN max("end") FILTER (WHERE class = 7) ELSE 0 END AS hi FROM vid WHERE clip % 3 <> 2 GROUP BY clip),
p AS (SELECT w.*, lo, hi, ("start" - min("start") OVER (PARTITION BY clip)) / greatest(max("start") OVER (PARTITION BY clip) - min("start") OVER (PARTITION BY clip), 1e-9) AS s FROM w LEFT JOIN f USING (clip)),
o AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY abs(s - 0.5), "start") AS k FROM p)
SELECT clip, "start", CASE WHEN lo IS NOT NULL THEN CASE WHEN lo <= 0 AND hi <= 0 THEN 19 WHEN "start" + 29 >= lo AND "start" <= hi THEN 7 WHEN "start" > hi THEN 8 ELSE 1 END WHEN k = 1 OR (s >= 0.4 AND s < 0.6) THEN 7 WHEN s >= 0.6 THEN 8 ELSE 1 END AS label FROM o""",
    "step_labels": f"WITH {_STEP(True)} SELECT clip, class, count(*) AS n_steps, min(step) AS first_step, max(step) AS last_step FROM step GROUP BY ALL",
    "annotated_windows": f'WITH {_STEP(False)}, a AS (SELECT clip, 2 * k AS "start", step, class FROM step JOIN range(999) r(k) ON step >= 2 * k AND step < 2 * k + 4), s AS (SELECT clip, "start", count(DISTINCT step) AS seen FROM a GROUP BY ALL), t AS (SELECT clip, "start", class, count(*) AS n FROM a GROUP BY ALL) SELECT clip, "start", arg_max(class, (n, -class)) AS class FROM t JOIN s USING (clip, "start") WHERE seen >= 2 GROUP BY ALL HAVING max(n) >= 2',
    "coarse_steps": f"WITH {_STEP(True)} SELECT clip, (class // 5)::INT AS coarse, count(DISTINCT step) AS n_steps FROM step GROUP BY ALL",
    "annotated_union": f'WITH {_VID}, u AS (SELECT *, max("end") OVER (PARTITION BY clip ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM vid) SELECT clip, sum(greatest(0, "end" - greatest("start", coalesce(before, "start"))))::BIGINT AS covered FROM u GROUP BY clip',
    "class_frames": f'WITH {_VID}, c AS (SELECT class, sum("end" - "start")::BIGINT AS frames, count(*) AS instances FROM vid GROUP BY class) SELECT class, frames, instances, round(frames / sum(frames) OVER (), 6) AS share, round(max(frames) OVER () / greatest(frames, 1), 6) AS imbalance FROM c',
    "annotation_cross_check": f'WITH {_VID}, a AS (SELECT DISTINCT clip, class, "start", "end" FROM vid WHERE clip % 10 <> 1), b AS (SELECT DISTINCT clip, class, "start", "end" FROM vid WHERE clip % 9 <> 0 AND segment_id % 10 <> 0), k AS (SELECT clip FROM a UNION SELECT clip FROM b) SELECT clip, clip IN (SELECT clip FROM a) AS in_a, clip IN (SELECT clip FROM b) AS in_b, (SELECT count(*) FROM (SELECT * FROM a WHERE a.clip = k.clip EXCEPT SELECT * FROM b WHERE b.clip = k.clip)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b WHERE b.clip = k.clip EXCEPT SELECT * FROM a WHERE a.clip = k.clip)) AS only_b FROM k',
    "annotation_agreement": f"WITH {_AGREE} SELECT clip, n_steps, cells_differing, round(agreement, 9) AS agreement FROM agree",
    "agreement_summary": f"WITH {_AGREE} SELECT count(*) AS compared, round(avg(agreement), 9) AS mean_agreement, round(min(agreement), 9) AS least_agreement, count(*) FILTER (WHERE agreement < 0.999) AS below FROM agree",
    "keyword_classes": f"WITH {SEGMENTS}, t AS (SELECT activity_name AS label, lower('Someone is ' || replace(activity_name, '_', ' ')) AS text FROM segments), k AS (SELECT label, text, {_keyword_sql('text')} AS rule FROM t) SELECT label, regexp_replace(text, '[^a-z0-9]+', '_', 'g') AS slug, CASE WHEN rule < 0 THEN 'other_idle' ELSE ({[n or '' for _, n in L.KEYWORDS]})[rule + 1] END AS class, rule >= 0 AND ({[n is None for _, n in L.KEYWORDS]})[rule + 1] AS dropped, count(*) AS n FROM k GROUP BY ALL",
    "parsed_names": f"WITH {SEGMENTS}, v AS (SELECT DISTINCT track_id AS clip FROM segments) SELECT clip, CASE WHEN clip % 5 <> 0 THEN (clip % 90)::INT END AS subject, CASE WHEN clip % 5 <> 0 THEN (clip % 7)::INT END AS take, CASE WHEN clip % 5 <> 0 THEN (clip % 3)::INT END AS camera, CASE WHEN clip % 4 <> 0 AND clip <> 0 THEN lpad(clip::VARCHAR, greatest(4, length(clip::VARCHAR))::INT, '0') END AS pid, CASE WHEN clip % 4 <> 0 AND clip <> 0 THEN 'c' || clip % 15 END AS crop_camera, CASE WHEN clip % 4 <> 0 AND clip <> 0 THEN (clip % 33)::INT END AS frame FROM v",
    "number_preservation": rf"SELECT a.conv_id, a.turn, len({_TOKENS('a.text')})::INT AS n_numbers, {_TOKENS('a.text')} = {_TOKENS('b.text')} AS same_numbers FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
    # By the kind of change: what the rule says of it, for any figures.
    "translation_faults": """WITH t AS (SELECT l_orderkey, l_linenumber, (l_linenumber + l_orderkey) % 9 AS kind, l_extendedprice::DECIMAL(12,2) >= 1000 AS grouped FROM lineitem),
f AS (SELECT *, CASE WHEN kind IN (2, 3, 5) OR kind = 4 AND grouped THEN 'changed numbers' WHEN kind = 6 THEN 'not in the script asked for' WHEN kind = 7 THEN 'missing or invented prose' WHEN kind = 8 THEN 'control characters' END AS fault FROM t)
SELECT l_linenumber, fault, CASE WHEN kind = 8 THEN 'control characters' END AS unsent, count(*) AS n, sum(l_orderkey)::BIGINT AS orders FROM f GROUP BY ALL""",
    "segment_upsert": f"WITH {SEGMENTS} SELECT CASE WHEN segment_id % 3 = 0 THEN 'corrected' ELSE room END AS room, count(*) AS n, max(CASE WHEN segment_id % 3 = 0 THEN 2 ELSE 1 END) AS seq FROM segments GROUP BY 1",
    "keyed_segments": f"WITH {SEGMENTS} SELECT home_id, CASE WHEN segment_id % 3 = 0 THEN 'corrected' ELSE room END AS room, CASE WHEN segment_id % 3 = 0 THEN 2 ELSE 1 END AS seq, count(*) AS n, sum(segment_id)::BIGINT AS ids FROM segments GROUP BY ALL",
    "day_states": f"WITH {ALERTS}, n AS (SELECT home_id, day, count(*) AS n_alerts, count(*) FILTER (WHERE severity = 'emergency') AS n_emergencies FROM alerts GROUP BY ALL) SELECT home_id, day, fall_events, round(mobility_index, 6) AS mobility_index, coalesce(n_alerts, 0) AS n_alerts, coalesce(n_emergencies, 0) AS n_emergencies FROM features LEFT JOIN n USING (home_id, day)",
    "alert_listing": f"WITH {ALERTS} SELECT home_id, day, sha256(home_id || '|' || strftime(day, '%Y-%m-%d') || '|' || rule_name) AS alert_id, kind FROM alerts WHERE day >= DATE '2024-01-15' ORDER BY day DESC, alert_id LIMIT 50",
    "table_counts": f"""WITH {ALERTS} SELECT 'segments' AS "table", count(*) AS n_rows FROM segments UNION ALL SELECT 'days', count(*) FROM days UNION ALL SELECT 'features', count(*) FROM features UNION ALL SELECT 'alerts', count(*) FROM alerts""",
    "segment_lookup": f"WITH {SEGMENTS} SELECT segment_id, home_id, activity_name FROM segments WHERE day = DATE '2024-01-10' AND role = 'resident'",
    "scenario_latency": f"WITH {_SCEN} SELECT * FROM scen",
    "scenario_summary": f"WITH {_SCEN} SELECT expected, round(avg((latency_days IS NOT NULL)::INT), 6) AS recall, round(median(latency_days), 6) AS median_latency, round(100 * sum(false_alerts) / sum(n_days), 6) AS false_per_100_days, count(*) AS n FROM scen GROUP BY expected",
}
