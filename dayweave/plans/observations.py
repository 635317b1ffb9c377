"""Track, window and decoding queries over observations derived from events and embeddings, with SQL twins where SQL can say it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayweave.functions import skeleton
from dayweave.functions.arrays import argmax, margin, mean_of, softmax
from dayweave.operators import decode as D
from dayweave.operators import metrics as M
from dayweave.operators import tracks as T
from dayweave.operators.features import observed_hours
from dayweave.plans.evaluation import STREAMS, val_logits
from dayweave.sources.shared import staged
from dayweave.sources import annotations, domain

FPS = 15.0
KEYS = ["home_id", "track_id"]
#: A clip is so many frames of the users of one home whose ids agree up to the last two digits, ten at most; a decoded sequence is so many
#: windows of a subject at most. Groups of a recurrence are then bounded and grow in number with users, frames and windows.
CLIP_FRAMES, SEQUENCE_WINDOWS = 500, 50
CLIP = ["home_id", "party", "span"]
ROLES = ("resident", "visitor", "unknown", "resident", "resident")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person in one frame per event: frames run on per user, with a gap of ten after every forty."""
    s = domain.segments(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("track_id").orderBy("start_us", "segment_id")) - 1
    s = s.withColumn("n", n).withColumn("frame_idx", (F.col("n") + 10 * F.floor(F.col("n") / 40)).cast("long"))
    x = F.pmod(F.col("segment_id") * 31, F.lit(400)).cast("double")
    return s.select(
        "home_id", "track_id", "frame_idx", F.col("start_us").alias("time_us"), "room", "role", (F.col("activity_id") % 5 != 0).alias("usable"),
        F.get(F.array(*[F.lit(r) for r in ROLES]), (F.col("segment_id") % 5).cast("int")).alias("observed_role"),
        x.alias("x1"), F.lit(50.0).alias("y1"), (x + 40 + F.col("activity_id")).alias("x2"), (F.lit(130.0) + F.col("track_id") % 7).alias("y2"), "confidence", F.col("segment_id"),
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observations with party and span, which with home_id name the clip: at most 10 * CLIP_FRAMES rows."""
    return observations(spark, sf_dir).withColumn("party", F.floor(F.col("track_id") / 100).cast("long")).withColumn("span", F.floor(F.col("frame_idx") / CLIP_FRAMES).cast("long"))


def q_windows(s, d):
    return T.windows(observations(s, d), KEYS).withColumn("k", F.col("k").cast("long"))


def q_window_statistics(s, d):
    return T.window_statistics(observations(s, d), KEYS)


def q_spans(s, d):
    p = T.spans(observations(s, d), ["home_id"])
    return p.select("home_id", "track_id", "first_frame", "last_frame", "n_frames", F.col("first_box.x1").alias("first_x"), F.col("last_box.x1").alias("last_x"))


def _fragments(s, d) -> DataFrame:
    """Each user's frames cut into fragments of forty, as a tracker that loses people leaves them."""
    o = observations(s, d).withColumn("clip", F.col("track_id")).withColumn("track_id", F.floor(F.col("frame_idx") / 50).cast("long"))
    return T.spans(o, ["clip"])


def q_reachable(s, d):
    f = _fragments(s, d)
    return T.reachable(f, f, ["clip"], FPS).withColumn("gap_s", F.round("gap_s", 6))


def q_chain(s, d):
    return T.heaviest_chain(_fragments(s, d), ["clip"], FPS)


def q_voted(s, d):
    return T.voted_roles(observations(s, d), KEYS).select(*KEYS, "frame_idx", "role", F.round("role_confidence", 6).alias("role_confidence"))


def q_tracked(s, d):
    o = clips(s, d).select(*CLIP, "frame_idx", "x1", "y1", "x2", "y2", "confidence")
    return T.tracked(o, CLIP).groupBy(*CLIP, "track_id").agg(F.count("*").alias("n_boxes"), F.max("confirmed").alias("confirmed"))


def q_slots(s, d):
    o = clips(s, d)
    o = o.select(*CLIP, "frame_idx", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"), ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("diagonal"))
    return T.slots(o, CLIP).groupBy(*CLIP, "slot").agg(F.count("*").alias("n"))


def q_subject(s, d):
    o = clips(s, d)
    rows = o.select(*CLIP, "track_id", F.when(F.col("home_id") % 2 == 0, F.col("role")).otherwise("unknown").alias("role")).distinct()
    return T.assert_subject(rows, T.spans(o, CLIP), CLIP, FPS)


def q_carried(s, d):
    o = observations(s, d).withColumn("object", T.sampled(F.col("room"), FPS))
    return T.carried(o, KEYS, "object").select(*KEYS, "frame_idx", "object")


def q_due(s, d):
    return T.embedding_due(observations(s, d), KEYS).groupBy(*KEYS).agg(F.count_if("due").alias("n_due"))


def q_candidates(s, d):
    o = observations(s, d).withColumn("mean_score", F.col("confidence"))
    return T.enrolment_candidates(o, KEYS).select(*KEYS, "frame_idx", F.round("quality", 6).alias("quality"))


def q_hours(s, d):
    return observed_hours(observations(s, d), ["home_id"], longest_s=600.0).withColumn("observed_hours", F.round("observed_hours", 6))


def q_roles(s, d):
    return observations(s, d).groupBy("role").agg(F.round(F.count("*") / FPS, 6).alias("seconds"))


def q_iou(s, d):
    """Overlap of each box with the track's box before."""
    w = Window.partitionBy(*KEYS).orderBy("frame_idx")
    o = observations(s, d)
    a = {c: F.col(c) for c in T.BOX}
    b = {c: F.lag(c).over(w) for c in T.BOX}
    return o.select(*KEYS, "frame_idx", F.round(T.iou(a, b), 6).alias("iou")).filter("iou is not null")


def _sequences(s, d) -> DataFrame:
    """Windows with twelve classes in sequences of twenty subjects: two streams widened, fused with objects."""
    v = val_logits(s, d)
    z = F.concat(mean_of([F.col(x) for x in STREAMS]), F.slice("joint", 1, 10))
    obj = F.array(*[F.when(F.col("window_id") % k == 0, n) for k, n in ((2, "cup"), (3, "tv"), (5, "bottle"))])
    rows = v.select("subject", (F.floor(F.col("window_id") / (20 * SEQUENCE_WINDOWS)).cast("long") * 20 + F.col("subject")).alias("sequence"), "window_id", "y", (F.col("window_id") * 1_000_000).alias("start_us"), (F.col("window_id") * 1_000_000 + 30_000_000).alias("end_us"), F.when(F.col("window_id") % 50 < 25, "kitchen").otherwise("hall").alias("room"), F.array_compact(obj).alias("objects"), z.alias("z"))
    return rows.withColumn("posterior", D.fused(softmax(F.col("z")), F.col("objects"), 20)).drop("z")


def _decoded(s, d) -> DataFrame:
    """Those sequences, decoded by the structured prior."""
    return D.decoded(_sequences(s, d), ["sequence"], "window_id", "posterior", D.structured_prior(20))


def q_posteriors(s, d):
    v = val_logits(s, d)
    p = D.fused(softmax(F.concat(F.col("bone"), F.col("joint"))), F.when(F.col("window_id") % 2 == 0, F.array(F.lit("cup"), F.lit("cup"))), 20)
    return v.select("window_id", F.round(F.array_max(p), 6).alias("top"), argmax(p).alias("class"), F.round(F.get(p, 12), 6).alias("medication"), F.round(margin(p), 4).alias("margin"))


def q_decoded(s, d):
    return _decoded(s, d).select("subject", "sequence", "window_id", "smoothed", F.round("marginal", 5).alias("marginal"), "abstained", "label")


def q_decoded_segments(s, d):
    r = _decoded(s, d).withColumn("margin", margin(F.col("posterior")))
    g = D.to_segments(r, ["subject", "sequence"])
    return g.select("subject", "sequence", "activity_id", "room", "start_us", "end_us", F.round("confidence", 5).alias("confidence"), F.round("mean_logit_margin", 4).alias("mean_logit_margin"), F.array_join("supporting_objects", ",").alias("objects"), "n_windows")


def q_decode_evaluation(s, d):
    """Accuracy and fragmentation of the greedy labels and of two priors, the structured one and one fitted on the other half of the
    sequences; sequences of fewer than three windows, which no prior can smooth, are left out."""
    rows = D.long_enough(_sequences(s, d), ["sequence"], 3)
    prior = D.fitted_prior(rows.filter("sequence % 2 = 0"), 20, "sequence", "window_id")
    held = staged(rows.filter("sequence % 2 = 1"), "sequences")
    out = None
    for name, r in (("greedy", held.withColumn("pred", argmax(F.col("posterior")))), ("structured", D.decoded(held, ["sequence"], "window_id", "posterior", D.structured_prior(20)).withColumn("pred", F.col("smoothed"))), ("fitted", D.decoded(held, ["sequence"], "window_id", "posterior", prior).withColumn("pred", F.col("smoothed")))):
        one = M.scores(r.select("y", "pred")).crossJoin(M.fragmentation(r, "sequence", "window_id", "y", "pred")).withColumn("decoder", F.lit(name))  # one row each
        out = one if out is None else out.unionByName(one)
    return out.select("decoder", *[F.round(c, 6).alias(c) for c in ("top1", "mean_class", "macro_f1", "ratio")], "segments_pred", "segments_true")


COARSE = [[0, 1, 2], [3, 4], [5, 6, 7], [8, 9]]


def q_coarse(s, d):
    """Fine logits pooled to four coarse classes, scored."""
    of = F.array(*[F.lit(next(i for i, m in enumerate(COARSE) if k in m)) for k in range(10)])
    v = val_logits(s, d).withColumn("fused", mean_of([F.col(x) for x in STREAMS]))
    r = M.scores(v.select(F.get(of, F.col("y")).alias("y"), argmax(D.pooled(F.col("fused"), COARSE)).alias("pred")))
    return r.select(*[F.round(c, 6).alias(c) for c in ("top1", "mean_class", "macro_f1")], "n")


def skeletons(s, d) -> DataFrame:
    """Windows of six frames and seventeen joints, cut from embeddings; the scores of some joints are zero."""
    e = domain.table(s, d, "embeddings").filter("embedding is not null")
    x = lambda i: F.get("embedding", i).cast("double")
    frame = lambda t: F.array(*[F.array(x(k) * 100 + t * 3 + k, x(k + 17) * 100 + t * t, F.when((F.col("vec_id") + k + t) % 6 == 0, 0.0).otherwise(F.least(F.lit(1.0), F.abs(x(k + 34)) + 0.3))) for k in range(17)])
    return e.select("vec_id", F.array(*[frame(t) for t in range(6)]).alias("frames"))


def q_skeletons(s, d):
    """Derived streams of each window as sums: normalised, resampled, bones, motion, mirrored; boxes and torso of the first frame."""
    f = skeletons(s, d).withColumn("norm", skeleton.normalised(F.col("frames")))
    total = lambda c: F.round(F.aggregate(skeleton.flattened(c), F.lit(0.0), lambda a, v: a + F.abs(v)), 4)
    n, first = F.col("norm"), F.get("frames", 0)
    parents = [0, 0, 0, 1, 2, 0, 0, 5, 6, 7, 8, 5, 6, 11, 12, 13, 14]
    return f.select("vec_id", total(n).alias("normalised"), total(skeleton.resampled(n, 10)).alias("resampled"), total(skeleton.bones(n, parents)).alias("bones"), total(skeleton.motion(n)).alias("motion"), total(skeleton.mirrored(n)).alias("mirrored"), skeleton.visible(first).alias("visible"), skeleton.usable(first).alias("usable"), F.round(skeleton.torso_vertical_ratio(first), 6).alias("upright"), F.round(skeleton.box_of(first)["x1"], 4).alias("box_x1"))


def q_wire(s, d):
    """Observations written to the wire format and read back: what arrives for each user."""
    o = observations(s, d).select("track_id", "frame_idx", "role", F.col("confidence").alias("role_confidence"), F.struct("x1", "y1", "x2", "y2").alias("box"), F.array(F.array("x1", "y1", "confidence")).alias("keypoints"), (F.col("track_id") % 10).alias("home"))
    back = annotations.observations_from_wire(annotations.observations_to_wire(o, ["home"], FPS).withColumn("base_us", F.lit(0).cast("long")))
    return back.groupBy("home", "track_id").agg(F.count("*").alias("n"), F.round(F.sum("box.x1"), 1).alias("x"), F.round(F.sum("role_confidence"), 2).alias("confidence"), F.max("frame_idx").alias("last"))


QUERIES = {
    "track_windows": q_windows, "window_statistics": q_window_statistics, "track_spans": q_spans, "reachable_fragments": q_reachable, "heaviest_chain": q_chain, "voted_roles": q_voted, "tracker": q_tracked,
    "person_slots": q_slots, "asserted_subject": q_subject, "carried_objects": q_carried, "embedding_schedule": q_due, "enrolment_candidates": q_candidates, "observed_hours": q_hours, "role_durations": q_roles,
    "box_overlap": q_iou, "fused_posteriors": q_posteriors, "decoded_windows": q_decoded, "decoded_segments": q_decoded_segments, "decode_evaluation": q_decode_evaluation, "coarse_scores": q_coarse,
    "skeleton_streams": q_skeletons, "wire_round_trip": q_wire,
}

# ---- SQL ------------------------------------------------------------------------------------------------------
from dayweave.plans.behaviour_sql import SEGMENTS  # noqa: E402
from dayweave.plans.evaluation import _ARG, _FUSED, _VAL, _scores  # noqa: E402

#: Log transitions of the structured prior, from and to, as a list of lists.
_MOVES = "[" + ", ".join("[" + ", ".join(repr(float(x)) + "::DOUBLE" for x in row) + "]" for row in np.log(np.maximum(D.structured_prior(20), 1e-12))) + "]"
_POSTERIORS = f"""{_VAL},
wide AS (SELECT subject, window_id // {20 * SEQUENCE_WINDOWS} * 20 + subject AS sequence, window_id, y, window_id * 1000000 AS start_us, window_id * 1000000 + 30000000 AS end_us, CASE WHEN window_id % 50 < 25 THEN 'kitchen' ELSE 'hall' END AS room,
  list_filter([CASE WHEN window_id % 2 = 0 THEN 'cup' END, CASE WHEN window_id % 3 = 0 THEN 'tv' END, CASE WHEN window_id % 5 = 0 THEN 'bottle' END], lambda o: o IS NOT NULL) AS objects, list_concat({_FUSED}, joint) AS v FROM val),
soft AS (SELECT * EXCLUDE (v), list_transform(v, lambda x: exp(x - list_max(v)) / list_sum(list_transform(v, lambda u: exp(u - list_max(v))))) AS q FROM wide),
odds AS (SELECT * EXCLUDE (q), list_transform(range(1, 21), lambda i: ln(greatest(q[i], 1e-12)) + CASE WHEN i = 11 AND window_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN i = 10 AND window_id % 2 = 0 THEN 0.3 ELSE 0 END + CASE WHEN i = 14 AND window_id % 3 = 0 THEN 1 ELSE 0 END
  + CASE WHEN i IN (11, 13) AND window_id % 5 = 0 THEN 0.7 ELSE 0 END + CASE WHEN i = 13 AND window_id % 5 <> 0 THEN -2 ELSE 0 END) AS l FROM soft),
emitted AS MATERIALIZED (SELECT * EXCLUDE (l, p), p, list_transform(p, lambda x: ln(greatest(x, 1e-12))) AS e, row_number() OVER (PARTITION BY sequence ORDER BY window_id) AS t, count(*) OVER (PARTITION BY sequence) AS n
  FROM (SELECT *, list_transform(l, lambda x: exp(x - list_max(l)) / list_sum(list_transform(l, lambda u: exp(u - list_max(l))))) AS p FROM odds))"""


def _viterbi(name: str, rows: str, moves: str) -> str:
    """{name}_path: the best state (from 1) of every row of rows (sequence, t, n, e), by the log transitions m of moves."""
    reach = "list_transform(range(1, 21), lambda i: b.best[i] + m[i][j])"
    return f"""{name}_best AS MATERIALIZED (SELECT sequence, t, n, list_transform(e, lambda x: x - ln(20)) AS best, NULL::BIGINT[] AS came FROM {rows} WHERE t = 1
  UNION ALL SELECT r.sequence, r.t, r.n, list_transform(range(1, 21), lambda j: list_max({reach}) + r.e[j]), list_transform(range(1, 21), lambda j: list_position({reach}, list_max({reach}))::BIGINT)
  FROM {name}_best b JOIN {rows} r ON r.sequence = b.sequence AND r.t = b.t + 1, {moves}),
{name}_path AS (SELECT sequence, t, came, list_position(best, list_max(best))::BIGINT AS state FROM {name}_best WHERE t = n
  UNION ALL SELECT b.sequence, b.t, b.came, x.came[x.state] FROM {name}_path x JOIN {name}_best b ON b.sequence = x.sequence AND b.t = x.t - 1)"""


_LSE = lambda terms: f"list_max({terms}) + ln(list_sum(list_transform({terms}, lambda u: exp(u - list_max({terms})))))"
_DECODED = f"""{_POSTERIORS}, fixed AS (SELECT {_MOVES} AS m), {_viterbi('s', 'emitted', 'fixed')},
ahead AS (SELECT sequence, t, list_transform(e, lambda x: x - ln(20)) AS a FROM emitted WHERE t = 1
  UNION ALL SELECT r.sequence, r.t, list_transform(range(1, 21), lambda j: {_LSE('list_transform(range(1, 21), lambda i: f.a[i] + m[i][j])')} + r.e[j]) FROM ahead f JOIN emitted r ON r.sequence = f.sequence AND r.t = f.t + 1, fixed),
behind AS (SELECT sequence, t, e, list_transform(e, lambda x: 0::DOUBLE) AS b FROM emitted WHERE t = n
  UNION ALL SELECT r.sequence, r.t, r.e, list_transform(range(1, 21), lambda i: {_LSE('list_transform(range(1, 21), lambda j: m[i][j] + g.e[j] + g.b[j])')}) FROM behind g JOIN emitted r ON r.sequence = g.sequence AND r.t = g.t - 1, fixed),
summed AS (SELECT sequence, t, list_transform(range(1, 21), lambda i: a[i] + b[i]) AS z FROM ahead JOIN behind USING (sequence, t)),
chance AS (SELECT sequence, t, list_transform(z, lambda x: exp(x - ({_LSE('z')}))) AS q FROM summed),
sure AS (SELECT e.*, state, q[state] AS marginal, list_reverse_sort(p) AS top FROM s_path JOIN chance USING (sequence, t) JOIN emitted e USING (sequence, t)),
seen AS (SELECT *, marginal < 0.4 AND state NOT IN (8, 9) AS abstained, CASE WHEN marginal < 0.4 AND state NOT IN (8, 9) THEN 19 ELSE state - 1 END AS label, ln(greatest(top[1], 1e-12)) - ln(greatest(top[2], 1e-12)) AS margin FROM sure)"""

_OBS = f"""{SEGMENTS},
obs0 AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_us, segment_id) - 1 AS n FROM segments),
obs AS (SELECT home_id, track_id, n + 10 * (n // 40) AS frame_idx, start_us AS time_us, room, role, activity_id % 5 <> 0 AS usable, (segment_id * 31 % 400)::DOUBLE AS x1, 50::DOUBLE AS y1,
  (segment_id * 31 % 400 + 40 + activity_id)::DOUBLE AS x2, (130 + track_id % 7)::DOUBLE AS y2, confidence, segment_id FROM obs0),
cut AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY home_id, track_id ORDER BY frame_idx) > 5 THEN 1 ELSE 0 END AS c FROM obs),
runs AS (SELECT *, sum(c) OVER (PARTITION BY home_id, track_id ORDER BY frame_idx) AS run FROM cut)"""
_WIN = f"""{_OBS},
use AS (SELECT *, row_number() OVER (PARTITION BY home_id, track_id, run ORDER BY frame_idx) - 1 AS n, count(*) OVER (PARTITION BY home_id, track_id, run) AS size FROM runs WHERE usable),
member AS (SELECT u.*, k FROM use u JOIN range(1000) r(k) ON 15 * k <= n AND n < 15 * k + 30 AND 15 * k + 30 <= size),
room AS (SELECT home_id, track_id, run, k, arg_min(room, (-c, room)) AS room FROM (SELECT home_id, track_id, run, k, room, count(*) AS c FROM member WHERE room <> '' GROUP BY ALL) GROUP BY ALL)"""
_FRAG = f"""{_OBS},
frag AS (SELECT track_id AS clip, frame_idx // 50 AS t, min(frame_idx) AS a, max(frame_idx) AS z, arg_min(x1, frame_idx) AS fx1, arg_min(x2, frame_idx) AS fx2, arg_max(x1, frame_idx) AS lx1, arg_max(x2, frame_idx) AS lx2, max(y2) AS y2 FROM obs GROUP BY ALL)"""
_P20 = "list_concat(bone, joint)"
_ROLES = "(" + str(list(ROLES)) + ")[segment_id % 5 + 1]"
_VOTED = f"""{_OBS.replace("segments AS (", "RECURSIVE segments AS (", 1)},
ballot AS (SELECT *, row_number() OVER w AS rn, least(15, row_number() OVER w) AS seen FROM (SELECT home_id, track_id, frame_idx, {_ROLES} AS observed FROM obs) WINDOW w AS (PARTITION BY home_id, track_id ORDER BY frame_idx)),
tally AS (SELECT *, count(*) FILTER (WHERE observed = 'resident') OVER w AS cr, count(*) FILTER (WHERE observed = 'visitor') OVER w AS cv, min(rn) FILTER (WHERE observed = 'resident') OVER w AS fr, min(rn) FILTER (WHERE observed = 'visitor') OVER w AS fv
  FROM ballot WINDOW w AS (PARTITION BY home_id, track_id ORDER BY frame_idx ROWS 14 PRECEDING)),
lead_ AS (SELECT *, greatest(cr, cv) AS best, CASE WHEN cr > cv OR (cr = cv AND fr < fv) THEN 'resident' ELSE 'visitor' END AS leader FROM tally),
vote AS (
  SELECT home_id, track_id, frame_idx, rn, CASE WHEN best < 5 THEN 'unknown' ELSE leader END AS role, CASE WHEN best < 5 THEN 0::DOUBLE ELSE least(1::DOUBLE, best / seen) END AS sure FROM lead_ WHERE rn = 1
  UNION ALL
  SELECT l.home_id, l.track_id, l.frame_idx, l.rn, CASE WHEN best < 5 THEN 'unknown' WHEN v.role IN ('unknown', leader) OR best - CASE v.role WHEN 'resident' THEN cr ELSE cv END >= 3 THEN leader ELSE v.role END,
    CASE WHEN best < 5 THEN 0 WHEN v.role IN ('unknown', leader) OR best - CASE v.role WHEN 'resident' THEN cr ELSE cv END >= 3 THEN least(1::DOUBLE, best / seen) ELSE v.sure END
  FROM lead_ l JOIN vote v ON v.home_id = l.home_id AND v.track_id = l.track_id AND l.rn = v.rn + 1)"""


def _chains(source: str) -> str:
    """The heaviest chain of each clip of source (clip, t, a, z, fx1, fx2, lx1, lx2, y2, n), by following every chain."""
    return f"""seq AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY z, a, t) AS i FROM {source}),
chain AS (
  SELECT clip, i, n AS total, [i] AS way FROM seq
  UNION ALL
  SELECT q.clip, q.i, c.total + q.n, list_concat(c.way, [q.i]) FROM chain c JOIN seq p ON p.clip = c.clip AND p.i = c.i JOIN seq q ON q.clip = p.clip AND p.z < q.a AND abs((q.fx1 + q.fx2) / 2 - (p.lx1 + p.lx2) / 2) <= (1.5 * (q.a - p.z) / 15 + 1) * (p.y2 - 50) + 1e-9 AND abs(q.y2 - p.y2) < 1e9),
best AS (SELECT clip, arg_min(way, (-total, list_reverse(way))) AS way FROM chain GROUP BY clip),
picked AS (SELECT b.clip, s.t FROM (SELECT clip, unnest(way) AS i FROM best) b JOIN seq s ON s.clip = b.clip AND s.i = b.i)"""


def _keyword_sql(text: str) -> str:
    from dayweave.operators.labels import KEYWORDS

    def one(alternative: str) -> str:
        base, _, rest = alternative.partition("(?!")
        if not rest:
            return f"regexp_matches({text}, '{base}')"
        return f"(regexp_matches({text}, '{base}') AND NOT regexp_matches({text}, '{base}{rest[:-1]}'))"

    def parts(pattern: str) -> list[str]:
        out, depth = [""], 0
        for c in pattern:
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                out.append("")
            else:
                out[-1] += c
        return out

    return "CASE " + " ".join(f"WHEN {' OR '.join(map(one, parts(p)))} THEN {i}" for i, (p, _) in enumerate(KEYWORDS)) + " ELSE -1 END"


_SK_NORM = """sk AS (SELECT vec_id, t, k, embedding[k + 1]::DOUBLE * 100 + t * 3 + k AS x, embedding[k + 18]::DOUBLE * 100 + t * t AS y, CASE WHEN (vec_id + k + t) % 6 = 0 THEN 0::DOUBLE ELSE least(1::DOUBLE, abs(embedding[k + 35]::DOUBLE) + 0.3) END AS s FROM embeddings, range(6) a(t), range(17) b(k) WHERE embedding IS NOT NULL),
body AS (SELECT vec_id, t, count(*) FILTER (WHERE s > 0) AS seen, count(*) FILTER (WHERE s >= 0.3) AS visible, min(s) FILTER (WHERE k IN (5, 6, 11, 12)) >= 0.3 AS whole,
  avg(x) FILTER (WHERE k IN (5, 6)) AS sx, avg(y) FILTER (WHERE k IN (5, 6)) AS sy, avg(x) FILTER (WHERE k IN (11, 12)) AS hx, avg(y) FILTER (WHERE k IN (11, 12)) AS hy,
  min(x) FILTER (WHERE s >= 0.3) AS x1, max(x) FILTER (WHERE s >= 0.3) AS x2, min(y) FILTER (WHERE s >= 0.3) AS y1, max(y) FILTER (WHERE s >= 0.3) AS y2 FROM sk GROUP BY ALL),
unit AS (SELECT vec_id, arg_min(hx, t) AS ox, arg_min(hy, t) AS oy, avg(sqrt((sx - hx) ** 2 + (sy - hy) ** 2)) AS m FROM body WHERE seen > 0 GROUP BY vec_id),
n AS (SELECT sk.vec_id, t, k, CASE WHEN s > 0 THEN (x - ox) / CASE WHEN m > 1e-3 THEN m ELSE 1 END ELSE 0 END AS a, CASE WHEN s > 0 THEN (y - oy) / CASE WHEN m > 1e-3 THEN m ELSE 1 END ELSE 0 END AS b, s AS c FROM sk JOIN unit USING (vec_id)),
s_n AS (SELECT vec_id, sum(abs(a) + abs(b) + abs(c)) AS v FROM n GROUP BY 1),
s_b AS (SELECT n.vec_id, sum(abs(n.a - u.a) + abs(n.b - u.b) + abs(n.c - u.c)) AS v FROM n JOIN n u ON u.vec_id = n.vec_id AND u.t = n.t AND u.k = ([0, 0, 0, 1, 2, 0, 0, 5, 6, 7, 8, 5, 6, 11, 12, 13, 14])[n.k + 1] GROUP BY 1),
s_m AS (SELECT n.vec_id, sum(abs(u.a - n.a) + abs(u.b - n.b) + abs(u.c - n.c)) AS v FROM n JOIN n u ON u.vec_id = n.vec_id AND u.k = n.k AND u.t = n.t + 1 GROUP BY 1),
s_r AS (SELECT p.vec_id, sum(abs(p.a * (1 - w) + q.a * w) + abs(p.b * (1 - w) + q.b * w) + abs(p.c * (1 - w) + q.c * w)) AS v FROM (SELECT floor(g * 5 / 9)::INT AS lo, g * 5 / 9 - floor(g * 5 / 9) AS w FROM range(10) r(g)) r JOIN n p ON p.t = lo JOIN n q ON q.vec_id = p.vec_id AND q.k = p.k AND q.t = least(lo + 1, 5) GROUP BY 1)"""
ORACLES = {
    "track_windows": f"WITH {_WIN} SELECT home_id, track_id, run, k, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, arg_max(role, frame_idx) AS role, count(*) AS n_rows, any_value(r.room) AS room FROM member m LEFT JOIN room r USING (home_id, track_id, run, k) GROUP BY ALL",
    "window_statistics": f"WITH {_OBS}, g AS (SELECT home_id, track_id, run, count(*) AS n, count(*) FILTER (WHERE usable) AS u FROM runs GROUP BY ALL) SELECT sum(n)::BIGINT AS rows_seen, count(DISTINCT (home_id, track_id)) AS tracks_seen, sum(CASE WHEN u >= 30 THEN (u - 30) // 15 + 1 ELSE 0 END)::BIGINT AS windows_built, sum(n - u)::BIGINT AS dropped_no_pose, count(*) FILTER (WHERE u > 0 AND u < 30) AS dropped_short_track, count(*) FILTER (WHERE run > 0) AS gaps_broken FROM g",
    "track_spans": f"WITH {_OBS} SELECT home_id, track_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS n_frames, arg_min(x1, frame_idx) AS first_x, arg_max(x1, frame_idx) AS last_x FROM obs GROUP BY ALL",
    "voted_roles": f"WITH {_VOTED} SELECT home_id, track_id, frame_idx, role, round(sure, 6) AS role_confidence FROM vote",
    "heaviest_chain": f"WITH {_FRAG.replace('segments AS (', 'RECURSIVE segments AS (', 1)}, src AS (SELECT f.*, n FROM frag f JOIN (SELECT track_id AS clip, frame_idx // 50 AS t, count(*) AS n FROM obs GROUP BY ALL) USING (clip, t)), {_chains('src')} SELECT clip, t AS track_id FROM picked",
    "asserted_subject": f"""WITH {_OBS.replace('segments AS (', 'RECURSIVE segments AS (', 1)},
o AS (SELECT home_id || '|' || track_id // 100 || '|' || frame_idx // {CLIP_FRAMES} AS clip, home_id, track_id // 100 AS party, frame_idx // {CLIP_FRAMES} AS span, track_id AS t, frame_idx, x1, x2, y2, CASE WHEN home_id % 2 = 0 THEN role ELSE 'unknown' END AS role FROM obs),
known AS (SELECT clip FROM o GROUP BY clip HAVING NOT bool_or(role = 'resident')),
src AS (SELECT clip, t, min(frame_idx) AS a, max(frame_idx) AS z, arg_min(x1, frame_idx) AS fx1, arg_min(x2, frame_idx) AS fx2, arg_max(x1, frame_idx) AS lx1, arg_max(x2, frame_idx) AS lx2, any_value(y2) AS y2, count(*) AS n FROM o WHERE clip IN (SELECT clip FROM known) GROUP BY ALL),
{_chains('src')}, long AS (SELECT clip, count(*) AS len FROM picked GROUP BY clip), most AS (SELECT clip, arg_max(t, (n, -t)) AS t FROM src GROUP BY clip),
chosen AS (SELECT p.clip, p.t, 'asserted_disjoint_track_chain' AS why FROM picked p JOIN long USING (clip) WHERE len > 1 UNION ALL SELECT m.clip, m.t, 'asserted_most_present_track' FROM most m JOIN long USING (clip) WHERE len <= 1)
SELECT r.home_id, r.party, r.span, r.t AS track_id, CASE WHEN c.why IS NOT NULL THEN 'resident' ELSE r.role END AS role, coalesce((SELECT any_value(why) FROM chosen x WHERE x.clip = r.clip), 'reid_matched') AS provenance
FROM (SELECT DISTINCT clip, home_id, party, span, t, role FROM o) r LEFT JOIN chosen c ON c.clip = r.clip AND c.t = r.t""",
    "skeleton_streams": f"WITH {_SK_NORM} SELECT vec_id, round(s_n.v, 4) AS normalised, round(s_r.v, 4) AS resampled, round(s_b.v, 4) AS bones, round(s_m.v, 4) AS motion, round(s_n.v, 4) AS mirrored, visible::INT AS visible, visible >= 8 AS usable, round(CASE WHEN whole AND sqrt((sx - hx) ** 2 + (sy - hy) ** 2) >= 1e-6 THEN abs(sy - hy) / sqrt((sx - hx) ** 2 + (sy - hy) ** 2) END, 6) AS upright, round(CASE WHEN visible >= 2 AND x2 - x1 >= 2 AND y2 - y1 >= 2 THEN x1 - 0.12 * (x2 - x1) END, 4) AS box_x1 FROM s_n JOIN s_r USING (vec_id) JOIN s_b USING (vec_id) JOIN s_m USING (vec_id) JOIN body USING (vec_id) WHERE t = 0",
    "reachable_fragments": f"WITH {_FRAG} SELECT p.clip, p.t AS a, q.t AS b, round((q.a - p.z) / 15, 6) AS gap_s FROM frag p JOIN frag q ON p.clip = q.clip AND p.z < q.a AND abs((q.fx1 + q.fx2) / 2 - (p.lx1 + p.lx2) / 2) <= (1.5 * (q.a - p.z) / 15 + 1) * (p.y2 - 50) + 1e-9",
    "carried_objects": f"WITH {_OBS} SELECT home_id, track_id, frame_idx, last_value(CASE WHEN frame_idx % 15 = 0 THEN room END IGNORE NULLS) OVER (PARTITION BY home_id, track_id ORDER BY frame_idx) AS object FROM obs",
    "embedding_schedule": f"WITH {_OBS}, n AS (SELECT home_id, track_id, row_number() OVER (PARTITION BY home_id, track_id ORDER BY frame_idx) AS n FROM obs) SELECT home_id, track_id, count(*) FILTER (WHERE n <= 5 OR (n - 5) % 15 = 0) AS n_due FROM n GROUP BY ALL",
    "enrolment_candidates": f"WITH {_OBS}, q AS (SELECT home_id, track_id, frame_idx, confidence * sqrt((x2 - x1) * (y2 - y1)) AS quality FROM obs) SELECT home_id, track_id, frame_idx, round(quality, 6) AS quality FROM q QUALIFY row_number() OVER (PARTITION BY home_id, track_id ORDER BY quality DESC, frame_idx) <= 8",
    "observed_hours": f"WITH {_OBS}, g AS (SELECT home_id, (time_us - lag(time_us) OVER (PARTITION BY home_id ORDER BY time_us)) / 1000000 AS gap FROM obs) SELECT home_id, round(coalesce(sum(gap) FILTER (WHERE gap <= 600), 0) / 3600, 6) AS observed_hours FROM g GROUP BY home_id",
    "role_durations": f"WITH {_OBS} SELECT role, round(count(*) / 15, 6) AS seconds FROM obs GROUP BY role",
    "box_overlap": f"WITH {_OBS}, b AS (SELECT *, lag(x1) OVER w AS p1, lag(x2) OVER w AS p2, lag(y2) OVER w AS q2 FROM obs WINDOW w AS (PARTITION BY home_id, track_id ORDER BY frame_idx)), i AS (SELECT *, greatest(0, least(x2, p2) - greatest(x1, p1)) * (least(y2, q2) - 50) AS m FROM b WHERE p1 IS NOT NULL) SELECT home_id, track_id, frame_idx, round(m / ((x2 - x1) * (y2 - 50) + (p2 - p1) * (q2 - 50) - m), 6) AS iou FROM i",
    "decoded_windows": f"WITH RECURSIVE {_DECODED} SELECT subject, sequence, window_id, (state - 1)::INT AS smoothed, round(marginal, 5) AS marginal, abstained, label::INT AS label FROM seen",
    "decoded_segments": f"""WITH RECURSIVE {_DECODED},
mark AS (SELECT *, (lag(label) OVER w IS NULL OR lag(label) OVER w <> label OR start_us > lag(end_us) OVER w OR lag(room) OVER w IS DISTINCT FROM room)::INT AS new FROM seen WINDOW w AS (PARTITION BY subject, sequence ORDER BY start_us)),
run AS (SELECT *, sum(new) OVER (PARTITION BY subject, sequence ORDER BY start_us) AS run FROM mark)
SELECT subject, sequence, any_value(label)::INT AS activity_id, any_value(room) AS room, min(start_us) AS start_us, max(end_us) AS end_us, round(avg(marginal), 5) AS confidence, round(avg(margin), 4) AS mean_logit_margin,
  array_to_string(list_sort(list_distinct(flatten(list(objects)))), ',') AS objects, count(*) AS n_windows FROM run GROUP BY subject, sequence, run""",
    "decode_evaluation": f"""WITH RECURSIVE {_POSTERIORS},
long AS (SELECT *, count(*) OVER (PARTITION BY sequence) AS n_all FROM emitted), kept AS (SELECT * FROM long WHERE n_all >= 3),
pairs AS (SELECT y AS a, lead(y) OVER (PARTITION BY sequence ORDER BY t) AS b FROM kept WHERE sequence % 2 = 0), bigram AS (SELECT a, b, count(*) AS n FROM pairs WHERE b IS NOT NULL GROUP BY ALL),
grid AS (SELECT x.c AS a, z.c AS b, coalesce(n, 0) + 1.0 AS k FROM range(20) x(c) CROSS JOIN range(20) z(c) LEFT JOIN bigram ON a = x.c AND b = z.c),
fit AS (SELECT list(m ORDER BY a) AS m FROM (SELECT a, list(ln(k / s) ORDER BY b) AS m FROM (SELECT *, sum(k) OVER (PARTITION BY a) AS s FROM grid) GROUP BY a)),
held AS (SELECT * FROM kept WHERE sequence % 2 = 1), fixed AS (SELECT {_MOVES} AS m),
{_viterbi('s', 'held', 'fixed')}, {_viterbi('f', 'held', 'fit')},
pred AS (SELECT 'greedy' AS decoder, sequence, t, y, {_ARG.format('p')} AS pred FROM held UNION ALL SELECT 'structured', sequence, t, y, state - 1 FROM s_path JOIN held USING (sequence, t) UNION ALL SELECT 'fitted', sequence, t, y, state - 1 FROM f_path JOIN held USING (sequence, t)),
{_scores('pred', 'decoder')},
frag AS (SELECT decoder, sum(a)::BIGINT AS segments_pred, sum(b)::BIGINT AS segments_true FROM (SELECT decoder, coalesce(lag(pred) OVER w <> pred, true)::INT AS a, coalesce(lag(y) OVER w <> y, true)::INT AS b FROM pred WINDOW w AS (PARTITION BY decoder, sequence ORDER BY t)) GROUP BY decoder)
SELECT decoder, top1, mean_class, macro_f1, round(segments_pred / segments_true, 6) AS ratio, segments_pred, segments_true FROM sc JOIN frag USING (decoder)""",
    "fused_posteriors": f"""WITH {_VAL}, z AS (SELECT window_id, {_P20} AS v FROM val), s AS (SELECT window_id, list_transform(v, lambda x: exp(x - list_max(v)) / list_sum(list_transform(v, lambda u: exp(u - list_max(v))))) AS p FROM z),
f AS (SELECT window_id, list_transform(range(1, 21), lambda i: ln(greatest(p[i], 1e-12)) + CASE WHEN window_id % 2 = 0 AND i = 11 THEN 1 WHEN window_id % 2 = 0 AND i = 10 THEN 0.3 WHEN i = 13 THEN -2 ELSE 0 END) AS l FROM s),
g AS (SELECT window_id, list_transform(l, lambda x: exp(x - list_max(l)) / list_sum(list_transform(l, lambda u: exp(u - list_max(l))))) AS p FROM f), h AS (SELECT *, list_reverse_sort(p) AS r FROM g)
SELECT window_id, round(r[1], 6) AS top, {_ARG.format('p')} AS class, round(p[13], 6) AS medication, round(ln(greatest(r[1], 1e-12)) - ln(greatest(r[2], 1e-12)), 4) AS margin FROM h""",
    "coarse_scores": f"WITH {_VAL}, p0 AS (SELECT ([0, 0, 0, 1, 1, 2, 2, 2, 3, 3])[y + 1] AS y, {_FUSED} AS f FROM val), p1 AS (SELECT y, [{', '.join('ln(' + ' + '.join(f'exp(f[{i + 1}] - list_max(f))' for i in m) + ')' for m in COARSE)}] AS z FROM p0), p AS (SELECT y, {_ARG.format('z')} AS pred FROM p1), {_scores('p')} SELECT top1, mean_class, macro_f1, n FROM sc",
    "wire_round_trip": f"WITH {_OBS} SELECT track_id % 10 AS home, track_id, count(*) AS n, round(sum(x1), 1) AS x, round(sum(confidence), 2) AS confidence, max(frame_idx) AS last FROM obs GROUP BY ALL",
}
