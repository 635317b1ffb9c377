"""Corpus queries: protocols, subject maps, supervision, pose archives, audits, names, records; with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.config import ACTIVITIES
from dayweave.functions import skeleton as S
from dayweave.functions.arrays import softmax
from dayweave.operators import corpus as C
from dayweave.operators import decode as D
from dayweave.operators import reports as R
from dayweave.plans.behaviour import q_alerts
from dayweave.plans.behaviour_sql import ALERTS, SEGMENTS
from dayweave.plans.evaluation import _VAL, crops, val_logits
from dayweave.plans.observations import _OBS, observations, skeletons
from dayweave.sources import annotations, domain, sinks
from dayweave.sources.shared import staged

TAGS = {"trimmed": [0, 1, 2, 3, 4], "untrimmed": [0, 2, 4, 6, 8], "falls": [5, 6, 7, 8, 9]}
PARENTS = [0, 0, 0, 1, 2, 0, 0, 5, 6, 7, 8, 5, 6, 11, 12, 13, 14]
LEVELS = [5.0, 5.0, 4.0, 4.0, 3.0, 3.0, 3.0, 3.0, 2.5, 2.5, 2.0, 2.0, 1.0]
PATHS = ("Subject 3/Fall/{:02d}.mp4", "Subject 4/ADL/no fall {:02d}.mp4", "fall-{:02d}-cam0.mp4", "S1/cam2/Fall forward/{:02d}.avi", "walk/No Fall/fall_{:02d}.avi", "home/{:02d}_chute.avi")


def videos(s: SparkSession, d: str) -> DataFrame:
    """A video per user: clip, subject, camera, and a subset that marks some subjects wrongly."""
    v = domain.segments(s, d).select(F.col("track_id").alias("clip")).distinct().withColumn("subject", (F.col("clip") % 26).cast("int")).withColumn("camera", (F.col("clip") % 7 + 1).cast("int"))
    return v.withColumn("subset", F.when(F.col("subject").isin(*C.TRAIN_SUBJECTS) != (F.col("subject") % 9 == 0), "training").otherwise("testing"))


def q_protocols(s, d):
    return C.protocol_counts(videos(s, d))


def q_stray(s, d):
    return C.stray_subjects(videos(s, d))


def q_remapped(s, d):
    """Users who are customers get the customer's nation as their person."""
    m = domain.table(s, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("long").alias("clip"), F.concat(F.lit("person "), F.col("c_nationkey").cast("string")).alias("subject"))
    return C.remapped(videos(s, d).select("clip"), m, "clip")


def q_remap_coverage(s, d):
    return q_remapped(s, d).agg(F.round(F.avg(F.col("matched").cast("double")), 6).alias("coverage"), F.count_distinct("subject").alias("n_subjects"))


def _tagged(s, d) -> DataFrame:
    specs = s.createDataFrame(list(TAGS.items()), "tag string, classes array<int>")
    rows = val_logits(s, d).withColumn("tag", F.get(F.array(*[F.lit(t) for t in TAGS]), (F.col("window_id") % 3).cast("int")))
    return C.supervised(rows, specs, 10)


def q_masked_loss(s, d):
    """Mean loss over the classes that a window's corpus may teach, of windows with such a class."""
    r = _tagged(s, d).filter(F.get("allowed", F.col("y")))
    return r.withColumn("loss", D.masked_cross_entropy(F.col("joint"), F.col("allowed"), F.col("y"))).groupBy("tag").agg(F.round(F.avg("loss"), 6).alias("loss"), F.count("*").alias("n"))


def q_supervised_classes(s, d):
    m = s.createDataFrame([(i, i // 2) for i in range(14)], "class int, coarse int")
    return C.supervised_classes(domain.segments(s, d).select(F.col("activity_id").alias("class")), m, 10)


def poses(s, d) -> DataFrame:
    """Frames of clips of ten: clip, source, present, flat (26 numbers; by axis but in every tenth clip; every fourth clip is not upright)."""
    e = domain.table(s, d, "embeddings").filter("embedding is not null").withColumn("clip", F.floor(F.col("vec_id") / 10).cast("long"))
    scale = F.when(F.col("clip") % 4 == 0, 40.0).otherwise(1.0)
    x = [F.get("embedding", j).cast("double") * scale for j in range(13)]
    y = [F.get("embedding", 13 + j).cast("double") * scale + 10 * LEVELS[j] for j in range(13)]
    flat = F.when(F.col("clip") % 10 == 3, F.array(*[v for p in zip(x, y, strict=True) for v in p])).otherwise(F.array(*x, *y))
    return e.select("clip", F.concat(F.lit("archive "), (F.col("clip") % 2).cast("string")).alias("source"), (F.col("vec_id") % 10 >= F.col("clip") % 8).alias("present"), flat.alias("flat"), "vec_id")


def q_layout_votes(s, d):
    return C.layout_votes(poses(s, d).filter("present"))


def q_layout_verdict(s, d):
    return C.layout_verdict(C.layout_votes(poses(s, d).filter("present")), least_agreement=0.85)


def q_archive_check(s, d):
    p = poses(s, d)
    return C.archive_check(p, C.layout_votes(p.filter("present")))


def _records(s, d) -> DataFrame:
    return skeletons(s, d).select(F.concat(F.lit("backend "), (F.col("vec_id") % 2).cast("string")).alias("backend"), "vec_id", F.posexplode("frames").alias("t", "joints")).withColumn("frame", F.col("vec_id") * 6 + F.col("t"))


def q_backends(s, d):
    return C.backend_summary(_records(s, d))


def q_skeleton_windows(s, d):
    """Windows of four frames, every two, that show enough joints; the second slot's test and root-centred motion of the first window."""
    f = skeletons(s, d).withColumn("w", S.clip_windows(F.col("frames"), 4, 2, 14))
    total = lambda c: F.round(F.aggregate(S.flattened(c), F.lit(0.0), lambda a, v: a + F.abs(v)), 4)
    return f.select("vec_id", F.array_join(F.transform("w", lambda w: w["start"].cast("string")), ",").alias("starts"), S.second_person(F.col("frames"), 15, 3).alias("second"), total(S.centred(F.col("frames"), 11)).alias("centred"))


def q_clips(s, d):
    """Clips of ten frames of one joint pair each, bridged over missing frames, resampled to eight and centred."""
    e = domain.table(s, d, "embeddings").filter("embedding is not null").withColumn("clip", F.floor(F.col("vec_id") / 10).cast("long"))
    frame = F.array(*[F.array(F.get("embedding", 2 * k).cast("double"), F.get("embedding", 2 * k + 1).cast("double")) for k in range(3)])
    present = (F.col("vec_id") * 7 % 10) >= (F.col("clip") % 6)
    c = e.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("vec_id", frame.alias("f"), present.alias("p")))).alias("r")).select("clip", F.transform("r", lambda r: r["f"]).alias("frames"), F.transform("r", lambda r: r["p"]).alias("present"))
    b = C.built_clips(c, [0, 0, 1], 0, 8)
    total = lambda c: F.round(F.aggregate(S.flattened(F.col(c)), F.lit(0.0), lambda a, v: a + F.abs(v)), 4)
    return b.select("clip", "coverage", "bridged_share", "source_frames", total("joint").alias("joint"), total("bone").alias("bone"))


def q_pixel_scale(s, d):
    v = val_logits(s, d).withColumn("x", F.when(F.col("window_id") % 9 == 0, F.transform("joint", lambda x: x * 100)).otherwise(F.col("joint")))
    return C.unscaled(v, "x").groupBy("reject_reason").agg(F.count("*").alias("n"), F.round(F.max("peak"), 4).alias("peak"))


def q_resampled(s, d):
    c = observations(s, d).groupBy(F.col("track_id").alias("clip")).agg(F.count("*").alias("n_frames"))
    return C.kept_frames(c, 20.0, 12.5)


def _sided(s, d) -> DataFrame:
    return val_logits(s, d).select("y", F.when(F.col("window_id") * 7 % 11 < 3, "val").otherwise("train").alias("split"), (F.floor(F.col("window_id") / 4)).cast("long").alias("subject"))


def q_shard_audit(s, d):
    return C.shard_audit(_sided(s, d), 4)


def q_shards_written(s, d):
    """Windows that a first run has not written yet, written in shards of a hundred rows by split, read back and audited by class."""
    from dayweave.sources.shared import scratch

    rows = _sided(s, d).withColumn("clip", F.col("subject"))
    path = scratch(s, "shards")
    sinks.write_shards(rows.filter("clip % 3 = 0"), path, ["split"], 100)
    sinks.write_shards(sinks.carry_forward(rows, s.read.parquet(path), "clip", 0, 10**9, "clip").select(*rows.columns), path, ["split"], 100)
    return s.read.parquet(path).groupBy("split", "y").agg(F.count("*").alias("n"), F.count_distinct("clip").alias("clips"))


def q_dataset_profile(s, d):
    c = crops(s, d).withColumn("pid", F.col("pid") + 16 * F.floor(F.col("frame") / 200).cast("long"))
    return C.dataset_profile(c.withColumn("split", F.get(F.array(F.lit("train"), F.lit("test"), F.lit("query")), (F.col("frame") % 3).cast("int"))))


def q_paths(s, d):
    v = videos(s, d)
    name = lambda p: F.format_string(p.replace("{:02d}", "%02d"), (F.col("clip") % 100).cast("int"))
    p = v.select("clip", F.get(F.array(*[name(x) for x in PATHS]), (F.col("clip") % len(PATHS)).cast("int")).alias("path"))
    return p.select("clip", "path", C.is_fall(F.col("path")).alias("fall"), C.subject_of_path(F.col("path"), "src").alias("subject"))


def q_class_ids(s, d):
    a = domain.segments(s, d).select(F.when(F.col("segment_id") % 6 == 0, F.upper("activity_name")).otherwise(F.col("activity_name")).alias("name"), (F.col("activity_id") + 1).alias("rgb")).distinct()
    return a.select("name", "rgb", C.class_id(F.col("name"), list(ACTIVITIES)).alias("skeleton_id"), C.class_id(F.col("name"), list(ACTIVITIES), "rgb").alias("rgb_id"), C.class_name(F.col("rgb"), list(ACTIVITIES), "rgb").alias("rgb_name"), C.class_name(F.col("rgb") - 1, list(ACTIVITIES), "rgb").alias("before"))


def q_observation_faults(s, d):
    o = observations(s, d).withColumns({"x2": F.when(F.col("segment_id") % 11 == 0, F.col("x1")).otherwise(F.col("x2")), "confidence": F.when(F.col("segment_id") % 13 == 0, F.col("confidence") + 1.01).otherwise(F.col("confidence")), "role": F.col("observed_role"), "role_confidence": F.col("confidence"), "n_joints": F.when(F.col("segment_id") % 5 > 0, F.when(F.col("segment_id") % 17 == 0, 16).otherwise(17))})
    good, bad = C.validated(o.drop("observed_role"), C.observation_faults())
    rows = bad.select(F.explode("reject_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return rows.unionByName(good.agg(F.lit("valid").alias("reason"), F.count("*").alias("n")))


def q_segment_faults(s, d):
    g = domain.segments(s, d).withColumns({"end_us": F.when(F.col("segment_id") % 11 == 0, F.col("start_us")).otherwise(F.col("end_us")), "activity_id": F.when(F.col("segment_id") % 19 == 0, F.lit(22)).otherwise(F.col("activity_id"))})
    return C.validated(g, C.segment_faults())[1].select("segment_id", F.array_join("reject_reasons", ",").alias("reasons"))


def q_shard_faults(s, d):
    """Clips as shard rows, some with a label, a subject or a class that doesn't belong, or an end before its start."""
    g = domain.segments(s, d).filter("segment_id is not null")
    bad = lambda n: F.col("segment_id") % n == 0
    action = F.array(F.when(bad(17), F.lit(25)).otherwise(F.col("activity_id")).cast("long"), F.when(bad(19), F.lit(9)).otherwise(F.lit(2)).cast("long"), F.lit(5).cast("long"))
    rows = g.select("segment_id", F.when(bad(11), F.lit(-1)).otherwise(F.col("activity_id")).alias("label"), F.when(bad(13), F.lit(99).cast("long")).otherwise(F.col("home_id")).alias("subject"), F.array(action).alias("actions"))
    return C.validated(rows, C.shard_faults(22, F.array(*[F.lit(k).cast("long") for k in range(10)])))[1].select("segment_id", F.array_join("reject_reasons", ",").alias("reasons"))


def q_alert_faults(s, d):
    """Alerts, some of which lost their evidence and some whose evidence names no day."""
    a = staged(q_alerts(s, d).select("alert_id", "home_id", "day"), "alerts")
    ref = F.concat(F.lit("feat:walking_duration_s:"), F.when(F.dayofmonth("day") % 5 == 0, F.lit("yesterday")).otherwise(F.date_format("day", "yyyy-MM-dd")))
    evidence = F.when(F.col("home_id") % 4 == 0, F.array().cast("array<struct<ref: string>>")).otherwise(F.array(F.struct(ref.alias("ref"))))
    return C.validated(a.withColumn("evidence", evidence), C.alert_faults())[1].groupBy("home_id", F.array_join("reject_reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


def q_timeline(s, d):
    t = C.timeline(domain.segments(s, d), ["home_id", "day"])
    return t.select("home_id", "day", "track_id", "n_segments", "fall_segments", F.element_at("segments", 1)["t0"].alias("first"), F.aggregate("segments", F.lit(0).cast("long"), lambda a, x: a + F.round((x["t1"] - x["t0"]) * 100).cast("long")).alias("centiseconds"))


def q_segment_wire(s, d):
    """Timelines written to the wire and read back as segments."""
    t = C.timeline(domain.segments(s, d), ["home_id", "day"]).withColumn("role", F.lit("resident"))
    names = F.array(*[F.lit(a) for a in ACTIVITIES])
    t = t.withColumn("segments", F.transform("segments", lambda x: F.struct(x["t0"].alias("t0"), F.when(x["label"] == 3, x["t0"]).otherwise(x["t1"]).alias("t1"), x["label"].alias("label"), F.get(names, x["label"]).alias("name"), x["confidence"].alias("confidence"), x["room"].alias("room"))))
    back = annotations.segments_from_wire(annotations.segments_to_wire(t, ["home_id", "day"]).withColumn("base_us", F.lit(0).cast("long")))
    return back.groupBy("home_id", "day", "activity_name").agg(F.count("*").alias("n"), F.sum(F.col("end_us") - F.col("start_us")).alias("micros"), F.countDistinct("track_id").alias("tracks"))


def q_segment_order(s, d):
    """The place of each segment in its day's listing, by start and track."""
    from pyspark.sql import Window

    w = Window.partitionBy("home_id", "day").orderBy("start_us", "track_id", "segment_id")
    return domain.segments(s, d).select("segment_id", F.row_number().over(w).alias("place"))


def q_top_classes(s, d):
    r = R.top_classes(val_logits(s, d).withColumn("p", softmax(F.col("joint"))), "p", list(ACTIVITIES[:10]))
    return r.select("window_id", F.array_join(F.transform("top", lambda t: t["name"]), ",").alias("names"), F.get("top", 0)["share"].alias("share"))


def q_label_audit(s, d):
    """Per class: instances, frames, share of all frames, its coarse class; of clips the share of minutes without annotation."""
    from dayweave.operators.labels import class_frames
    from dayweave.plans.annotation import videos as spans

    c = class_frames(spans(s, d)).withColumn("coarse", (F.col("class") / 5).cast("int"))
    return c.groupBy("coarse").agg(F.count("*").alias("classes"), F.sum("frames").alias("frames"), F.sum("instances").alias("instances"), F.round(F.sum("share"), 6).alias("share"), F.round(F.max("imbalance"), 6).alias("imbalance"))


def q_annotation_gaps(s, d):
    """Mean, median and greatest share of a clip that no span covers, by subject of the official partition."""
    from dayweave.operators.labels import union_length
    from dayweave.plans.annotation import videos as spans

    v = spans(s, d)
    gap = union_length(v, ["clip"]).join(v.groupBy("clip").agg((F.max("end") - F.min("start")).alias("length")), "clip").withColumn("gap", 1 - F.col("covered") / F.col("length"))
    g = gap.withColumn("side", C.protocol_side((F.col("clip") % 26).cast("int"), F.lit(1), "CS"))
    return g.groupBy("side").agg(F.count("*").alias("n"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.round(F.median("gap"), 6).alias("median_gap"), F.round(F.max("gap"), 6).alias("most_gap"))


QUERIES = {
    "protocol_counts": q_protocols, "stray_subjects": q_stray, "remapped_subjects": q_remapped, "remap_coverage": q_remap_coverage, "masked_loss": q_masked_loss, "supervised_classes": q_supervised_classes, "layout_votes": q_layout_votes,
    "layout_verdict": q_layout_verdict, "pose_archive_check": q_archive_check, "backend_summary": q_backends, "skeleton_windows": q_skeleton_windows, "built_clips": q_clips, "pixel_scale": q_pixel_scale, "resampled_frames": q_resampled,
    "shard_audit": q_shard_audit, "shards_written": q_shards_written, "dataset_profile": q_dataset_profile, "path_classes": q_paths, "class_ids": q_class_ids, "observation_faults": q_observation_faults, "segment_faults": q_segment_faults, "shard_faults": q_shard_faults, "alert_faults": q_alert_faults,
    "track_timeline": q_timeline, "segment_wire": q_segment_wire, "segment_order": q_segment_order, "top_classes": q_top_classes, "label_audit": q_label_audit, "annotation_gaps": q_annotation_gaps,
}

# ---- SQL ------------------------------------------------------------------------------------------------------

_IN = lambda xs: "(" + ", ".join(str(x) for x in xs) + ")"
_VIDEOS = f"""{SEGMENTS},
videos AS (SELECT clip, subject, camera, CASE WHEN (subject IN {_IN(C.TRAIN_SUBJECTS)}) <> (subject % 9 = 0) THEN 'training' ELSE 'testing' END AS subset FROM (SELECT DISTINCT track_id AS clip, (track_id % 26)::INT AS subject, (track_id % 7 + 1)::INT AS camera FROM segments))"""
_CS = f"CASE WHEN subject IN {_IN(C.TRAIN_SUBJECTS)} THEN 'train' WHEN subject IN {_IN(C.TEST_SUBJECTS)} THEN 'test' ELSE 'unused' END"
_CV = lambda p: f"CASE WHEN camera IN {_IN(C.CAMERAS[p]['train'])} THEN 'train' WHEN camera IN {_IN(C.CAMERAS[p]['val'])} THEN 'val' WHEN camera IN {_IN(C.CAMERAS[p]['test'])} THEN 'test' ELSE 'unused' END"
_REMAP = f"""{_VIDEOS}, m AS (SELECT c_custkey AS clip, 'person ' || c_nationkey AS subject FROM customer WHERE c_custkey % 3 <> 0),
r AS (SELECT v.clip, coalesce(m.subject, v.clip::VARCHAR) AS subject, m.subject IS NOT NULL AS matched FROM videos v LEFT JOIN m USING (clip))"""
_ALLOW = f"({[list(v) for v in TAGS.values()]})[window_id % 3 + 1]"
_TAGGED = f"{_VAL}, t AS (SELECT *, ({list(TAGS)})[window_id % 3 + 1] AS tag, {_ALLOW} AS ok FROM val)"
_POSE = f"""e AS (SELECT vec_id, vec_id // 10 AS clip, embedding AS v, CASE WHEN vec_id // 10 % 4 = 0 THEN 40::DOUBLE ELSE 1::DOUBLE END AS sc FROM embeddings WHERE embedding IS NOT NULL),
xy AS (SELECT vec_id, clip, list_transform(range(1, 14), lambda j: v[j]::DOUBLE * sc) AS x, list_transform(range(1, 14), lambda j: v[13 + j]::DOUBLE * sc + 10 * ({LEVELS}::DOUBLE[])[j]) AS y FROM e),
poses AS (SELECT vec_id, clip, 'archive ' || clip % 2 AS source, vec_id % 10 >= clip % 8 AS present, CASE WHEN clip % 10 = 3 THEN flatten(list_transform(range(1, 14), lambda j: [x[j], y[j]])) ELSE list_concat(x, y) END AS flat FROM xy)"""


def _chain(at) -> str:
    level = ["(" + " + ".join(f"flat[{at(j)}]" for j in g) + f") / {len(g)}" for g in C.UPRIGHT]
    return " AND ".join(f"{a} > {b}" for a, b in zip(level, level[1:], strict=False))


_UP, _UPJ = _chain(lambda j: 14 + j), _chain(lambda j: 2 * j + 2)
_VOTES = f"""{_POSE},
vote0 AS (SELECT clip, round(avg(({_UP})::INT), 4) AS by_axis, round(avg(({_UPJ})::INT), 4) AS by_joint, count(*) AS n_frames FROM poses WHERE present GROUP BY clip),
votes AS (SELECT *, CASE WHEN by_axis >= by_joint THEN 'by_axis' ELSE 'by_joint' END AS winner, round(abs(by_axis - by_joint), 4) AS margin, greatest(by_axis, by_joint) >= 0.5 AND round(abs(by_axis - by_joint), 4) >= 0.2 AS decisive FROM vote0)"""
_SK = """sk AS (SELECT vec_id, t, k, embedding[k + 1]::DOUBLE * 100 + t * 3 + k AS x, embedding[k + 18]::DOUBLE * 100 + t * t AS y, CASE WHEN (vec_id + k + t) % 6 = 0 THEN 0::DOUBLE ELSE least(1::DOUBLE, abs(embedding[k + 35]::DOUBLE) + 0.3) END AS s FROM embeddings, range(6) a(t), range(17) b(k) WHERE embedding IS NOT NULL)"""
_SIDED = f"{_VAL}, s AS (SELECT y, CASE WHEN window_id * 7 % 11 < 3 THEN 'val' ELSE 'train' END AS split, window_id // 4 AS subject FROM val)"
_CLIPS = """e AS (SELECT vec_id // 10 AS clip, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY vec_id // 10) AS n, vec_id * 7 % 10 >= vec_id // 10 % 6 AS present, embedding AS v FROM embeddings WHERE embedding IS NOT NULL),
c AS (SELECT clip, any_value(n) AS n, avg(present::INT) AS coverage FROM e GROUP BY clip HAVING avg(present::INT) >= 0.6),
near AS (SELECT e.clip, e.i, coalesce(max(p.i) FILTER (WHERE p.i <= e.i), min(p.i)) AS lo, coalesce(min(p.i) FILTER (WHERE p.i >= e.i), max(p.i)) AS hi FROM e JOIN e p ON p.clip = e.clip AND p.present GROUP BY e.clip, e.i),
fill AS (SELECT r.clip, r.i, j, a.v[j] * (1 - CASE WHEN hi > lo THEN (r.i - lo) / (hi - lo) ELSE 0 END) + b.v[j] * CASE WHEN hi > lo THEN (r.i - lo) / (hi - lo) ELSE 0 END AS x FROM near r JOIN e a ON a.clip = r.clip AND a.i = r.lo JOIN e b ON b.clip = r.clip AND b.i = r.hi, range(1, 7) q(j)),
res AS (SELECT c.clip, k, p.j, p.x * (1 - (k * (n - 1) / 7 - floor(k * (n - 1) / 7))) + q.x * (k * (n - 1) / 7 - floor(k * (n - 1) / 7)) AS x FROM c CROSS JOIN range(8) g(k) JOIN fill p ON p.clip = c.clip AND p.i = floor(k * (n - 1) / 7) JOIN fill q ON q.clip = c.clip AND q.j = p.j AND q.i = least(floor(k * (n - 1) / 7) + 1, n - 1)),
mid AS (SELECT a.clip, a.k, a.j, a.x - r.x AS x FROM res a JOIN res r ON r.clip = a.clip AND r.k = a.k AND r.j = 2 - a.j % 2),
bone AS (SELECT m.clip, m.k, m.j, m.x - u.x AS x FROM mid m JOIN mid u ON u.clip = m.clip AND u.k = m.k AND u.j = CASE WHEN m.j <= 4 THEN 2 - m.j % 2 ELSE m.j - 2 END)"""
_ANN = f"""{SEGMENTS},
vid AS (SELECT track_id AS clip, activity_id::BIGINT AS class, (start_us - t0) // 60000000 AS a, (end_us - t0) // 60000000 + 30 AS z FROM segments JOIN (SELECT track_id, min(start_us) AS t0 FROM segments GROUP BY track_id) USING (track_id))"""
_NAMES = "[" + ", ".join(f"'{a}'" for a in ACTIVITIES) + "]"
_PATHS = "[" + ", ".join("'" + p.split("{")[0] + "' || lpad((clip % 100)::VARCHAR, 2, '0') || '" + p.split("}")[1] + "'" for p in PATHS) + "]"
ORACLES = {
    "protocol_counts": f"WITH {_VIDEOS}, p AS (SELECT 'CS' AS protocol, {_CS} AS side FROM videos UNION ALL SELECT 'CV1', {_CV('CV1')} FROM videos UNION ALL SELECT 'CV2', {_CV('CV2')} FROM videos) SELECT protocol, side, count(*) AS n FROM p GROUP BY ALL",
    "stray_subjects": f"WITH {_VIDEOS}, u AS (SELECT DISTINCT subject, subset FROM videos) SELECT subject, subset FROM u WHERE (SELECT max(c) FROM (SELECT count(*) AS c FROM u GROUP BY subject)) < 2 AND CASE WHEN subset = 'training' THEN subject NOT IN {_IN(C.TRAIN_SUBJECTS)} ELSE subject NOT IN {_IN(C.TEST_SUBJECTS)} END",
    "remapped_subjects": f"WITH {_REMAP} SELECT * FROM r",
    "remap_coverage": f"WITH {_REMAP} SELECT round(avg(matched::INT), 6) AS coverage, count(DISTINCT subject) AS n_subjects FROM r",
    "masked_loss": f"WITH {_TAGGED} SELECT tag, round(avg(ln(list_sum(list_transform(ok, lambda c: exp(joint[c + 1] - list_max(joint))))) + list_max(joint) - joint[y + 1]), 6) AS loss, count(*) AS n FROM t WHERE list_contains(ok, y) GROUP BY tag",
    "supervised_classes": f"WITH {SEGMENTS} SELECT c AS class, c IN (SELECT DISTINCT activity_id // 2 FROM segments WHERE activity_id < 14) AS taught FROM range(10) r(c)",
    "layout_votes": f"WITH {_VOTES} SELECT * FROM votes",
    "layout_verdict": f"WITH {_VOTES}, s AS (SELECT count(*) AS n_read, count(*) FILTER (WHERE decisive) AS n_decisive, count(*) FILTER (WHERE decisive AND winner = 'by_axis') AS n_agree FROM votes), a AS (SELECT *, round(CASE WHEN n_decisive > 0 THEN n_agree / n_decisive ELSE 0 END, 4) AS agreement FROM s) SELECT *, CASE WHEN n_decisive < 8 THEN 'too few decisive files' WHEN agreement < 0.85 THEN 'written the other way round' END AS reason, n_decisive >= 8 AND agreement >= 0.85 AS accepted FROM a",
    "pose_archive_check": f"""WITH {_VOTES}, f AS (SELECT source, clip, count(*) AS frames, count(*) FILTER (WHERE NOT present) AS missing, round(avg(CASE WHEN present THEN ({_UP})::INT END), 3) AS upright FROM poses GROUP BY ALL),
j AS (SELECT f.*, winner, margin, 1 - missing / frames AS coverage FROM f LEFT JOIN votes USING (clip)), g AS (SELECT source, count(*) AS n_files, sum(frames)::BIGINT AS total_frames, round(sum(missing) / sum(frames), 5) AS missing_share, quantile_cont(coverage, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q, count(*) FILTER (WHERE coverage < 0.6) AS n_dropped,
  round(median(upright), 3) AS upright_median, min(upright) AS upright_min, count(*) FILTER (WHERE winner = 'by_axis') AS won_by_axis, count(*) FILTER (WHERE winner = 'by_joint') AS won_by_joint, round(median(margin), 3) AS margin_median FROM j GROUP BY source)
SELECT * EXCLUDE (q), array_to_string(list_transform(q, lambda x: format('{{:.3f}}', x)), ' ') AS coverage_deciles FROM g""",
    "backend_summary": f"""WITH {_SK}, r AS (SELECT vec_id, t, count(*) FILTER (WHERE s >= 0.3) AS good, sum(s) FILTER (WHERE s >= 0.3) AS score, bool_and(s >= 0.3) FILTER (WHERE k IN (5, 6, 11, 12)) AS torso, max(x) FILTER (WHERE s >= 0.3) - min(x) FILTER (WHERE s >= 0.3) AS w, max(y) FILTER (WHERE s >= 0.3) - min(y) FILTER (WHERE s >= 0.3) AS h FROM sk GROUP BY ALL)
SELECT 'backend ' || vec_id % 2 AS backend, count(*) AS frames, count(*) AS person_records, count(*) FILTER (WHERE good > 0) AS usable_records, count(*) FILTER (WHERE good = 0) AS weak_records, round(sum(score) / sum(good), 4) AS mean_score, count(*) FILTER (WHERE torso) AS torso_complete, round(median(CASE WHEN good >= 2 AND w >= 2 AND h >= 2 THEN h * 1.24 END), 1) AS median_height FROM r GROUP BY 1""",
    "skeleton_windows": f"""WITH {_SK}, f AS (SELECT vec_id, t, count(*) FILTER (WHERE s > 0.3) >= 14 AS good, count(*) FILTER (WHERE s > 0.05) >= 15 AS many FROM sk GROUP BY ALL), w AS (SELECT f.vec_id, b AS start FROM f, (VALUES (0), (2)) v(b) WHERE t >= b AND t < b + 4 GROUP BY ALL HAVING count(*) FILTER (WHERE good) * 2 >= 4),
c AS (SELECT a.vec_id, sum(abs(a.x - r.x) + abs(a.y - r.y) + abs(a.s - r.s)) AS centred FROM sk a JOIN sk r ON r.vec_id = a.vec_id AND r.t = a.t AND r.k = 11 GROUP BY ALL), m AS (SELECT vec_id, count(*) FILTER (WHERE many) >= 3 AS second FROM f GROUP BY vec_id)
SELECT vec_id, coalesce((SELECT string_agg(start::VARCHAR, ',' ORDER BY start) FROM w WHERE w.vec_id = m.vec_id), '') AS starts, second, round(centred, 4) AS centred FROM m JOIN c USING (vec_id)""",
    "built_clips": f"WITH {_CLIPS} SELECT c.clip, round(coverage, 4) AS coverage, round(1 - round(coverage, 4), 4) AS bridged_share, n::INT AS source_frames, round((SELECT sum(abs(x)) FROM mid WHERE mid.clip = c.clip), 4) AS joint, round((SELECT sum(abs(x)) FROM bone WHERE bone.clip = c.clip), 4) AS bone FROM c",
    "pixel_scale": f"WITH {_VAL}, p AS (SELECT list_max(list_transform(joint, lambda v: abs(v))) * CASE WHEN window_id % 9 = 0 THEN 100 ELSE 1 END AS peak FROM val) SELECT CASE WHEN peak > 25 THEN 'pixel scale' END AS reject_reason, count(*) AS n, round(max(peak), 4) AS peak FROM p GROUP BY 1",
    "resampled_frames": f"WITH {_OBS}, c AS (SELECT track_id AS clip, count(*) AS n FROM obs GROUP BY 1), k AS (SELECT clip, n, unnest(range(n + 2)) AS k FROM c) SELECT clip, k::INT AS k, round_even(k * 20.0::DOUBLE / 12.5, 0)::BIGINT AS frame FROM k WHERE round_even(k * 20.0::DOUBLE / 12.5, 0) < n",
    "shard_audit": f"WITH {_SIDED}, u AS (SELECT subject::VARCHAR AS key, count(DISTINCT split) AS sides, count(*) AS n FROM s GROUP BY 1) SELECT 'class' AS kind, y::VARCHAR AS key, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'split', split, count(*) FROM s GROUP BY ALL UNION ALL SELECT 'one_sided', key, n FROM u WHERE sides = 1 UNION ALL SELECT 'tiny', key, n FROM u WHERE n < 4",
    "shards_written": f"WITH {_SIDED} SELECT split, y, count(*) AS n, count(DISTINCT subject) AS clips FROM s GROUP BY ALL",
    "dataset_profile": """WITH c AS (SELECT label::BIGINT + 16 * (vec_id // 200) AS pid, vec_id % 4 AS camera, (['train', 'test', 'query'])[vec_id % 3 + 1] AS split FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL), i AS (SELECT split, pid, count(*) AS n, count(DISTINCT camera) AS cams FROM c GROUP BY ALL), l AS (SELECT split, list_sort(list(n)) AS q, sum(n)::BIGINT AS images, count(*) AS ids, count(*) FILTER (WHERE cams >= 2) AS multi_camera FROM i GROUP BY split)
SELECT split, images, ids, q[1] AS least, q[least(ids - 1, floor(ids * 0.1)::INT) + 1] AS p10, q[least(ids - 1, floor(ids * 0.5)::INT) + 1] AS median, q[least(ids - 1, floor(ids * 0.9)::INT) + 1] AS p90, q[-1] AS most, multi_camera, (SELECT count(DISTINCT camera) FROM c WHERE c.split = l.split) AS cameras FROM l""",
    "path_classes": f"""WITH {_VIDEOS}, p AS (SELECT clip, ({_PATHS})[clip % {len(PATHS)} + 1] AS path FROM videos) SELECT clip, path, clip % 6 IN (0, 2, 3, 5) AS fall,
  CASE clip % 6 WHEN 0 THEN 'src_Subject3' WHEN 1 THEN 'src_Subject4' WHEN 2 THEN 'src_fall-' || lpad((clip % 100)::VARCHAR, 2, '0') WHEN 3 THEN 'src_S1' WHEN 4 THEN 'src_walk' ELSE 'src_home' END AS subject FROM p""",
    "class_ids": f"WITH {SEGMENTS}, a AS (SELECT DISTINCT CASE WHEN segment_id % 6 = 0 THEN upper(activity_name) ELSE activity_name END AS name, activity_id + 1 AS rgb FROM segments) SELECT name, rgb, CASE WHEN list_contains({_NAMES}, name) THEN (list_position({_NAMES}, name) - 1)::INT END AS skeleton_id, CASE WHEN list_contains({_NAMES}, name) THEN list_position({_NAMES}, name)::INT END AS rgb_id, ({_NAMES})[rgb] AS rgb_name, CASE WHEN rgb > 1 THEN ({_NAMES})[rgb - 1] END AS before FROM a",
    "observation_faults": f"""WITH {_OBS}, o AS (SELECT x1, CASE WHEN segment_id % 11 = 0 THEN x1 ELSE x2 END AS x2, confidence, CASE WHEN segment_id % 13 = 0 THEN confidence + 1.01 ELSE confidence END AS c, segment_id % 5 = 2 AS unknown, segment_id % 5 > 0 AND segment_id % 17 = 0 AS joints FROM obs),
f AS (SELECT x2 <= x1 AS box, c > 1 AS c, unknown AND confidence > 0.5 AS r, joints AS k FROM o)
SELECT * FROM (SELECT 'degenerate box' AS reason, count(*) FILTER (WHERE box) AS n FROM f UNION ALL SELECT 'confidence', count(*) FILTER (WHERE c) FROM f UNION ALL SELECT 'unknown role with confidence', count(*) FILTER (WHERE r) FROM f UNION ALL SELECT 'keypoints', count(*) FILTER (WHERE k) FROM f UNION ALL SELECT 'valid', count(*) FILTER (WHERE NOT (box OR c OR r OR k)) FROM f) WHERE n > 0 OR reason = 'valid'""",
    "shard_faults": f"WITH {SEGMENTS}, f AS (SELECT segment_id, array_to_string(list_filter([CASE WHEN segment_id % 11 = 0 OR activity_id > 21 THEN 'label out of range' END, CASE WHEN segment_id % 13 = 0 THEN 'unknown subject' END, CASE WHEN segment_id % 17 = 0 OR activity_id > 21 THEN 'class out of range' END, CASE WHEN segment_id % 19 = 0 THEN 'end before start' END], lambda x: x IS NOT NULL), ',') AS reasons FROM segments) SELECT * FROM f WHERE reasons <> ''",
    "alert_faults": f"WITH {ALERTS}, f AS (SELECT home_id, CASE WHEN home_id % 4 = 0 THEN 'no evidence' WHEN day(day) % 5 = 0 THEN 'evidence reference' END AS reasons FROM alerts) SELECT home_id, reasons, count(*) AS n FROM f WHERE reasons IS NOT NULL GROUP BY ALL",
    "segment_faults": f"WITH {SEGMENTS} SELECT segment_id, array_to_string(list_filter([CASE WHEN segment_id % 19 = 0 THEN 'activity_id' END, CASE WHEN segment_id % 11 = 0 THEN 'end before start' END], lambda x: x IS NOT NULL), ',') AS reasons FROM segments WHERE segment_id % 19 = 0 OR segment_id % 11 = 0",
    "track_timeline": f"WITH {SEGMENTS}, b AS (SELECT home_id, day, min(start_us) AS base FROM segments GROUP BY ALL) SELECT home_id, day, track_id, count(*) AS n_segments, count(*) FILTER (WHERE activity_id IN (7, 8)) AS fall_segments, ((min(start_us) - any_value(base) + 5000) // 10000) / 100 AS first, sum(round((((end_us - base + 5000) // 10000) / 100 - ((start_us - base + 5000) // 10000) / 100) * 100)::BIGINT)::BIGINT AS centiseconds FROM segments JOIN b USING (home_id, day) GROUP BY ALL",
    "segment_wire": f"WITH {SEGMENTS}, b AS (SELECT home_id, day, min(start_us) AS base FROM segments GROUP BY ALL), t AS (SELECT s.home_id, s.day, track_id, activity_name, activity_id, ((start_us - base + 5000) // 10000) / 100 AS t0, ((end_us - base + 5000) // 10000) / 100 AS t1 FROM segments s JOIN b USING (home_id, day)), n AS (SELECT *, CASE WHEN activity_id = 3 OR t1 <= t0 THEN t0 + 0.001 ELSE t1 END AS e FROM t) SELECT home_id, day, activity_name, count(*) AS n, sum(round(e * 1000000)::BIGINT - round(t0 * 1000000)::BIGINT)::BIGINT AS micros, count(DISTINCT track_id) AS tracks FROM n GROUP BY ALL",
    "segment_order": f"WITH {SEGMENTS} SELECT segment_id, row_number() OVER (PARTITION BY home_id, day ORDER BY start_us, track_id, segment_id) AS place FROM segments",
    "top_classes": f"WITH {_VAL}, p AS (SELECT window_id, unnest(joint) AS z, generate_subscripts(joint, 1) AS i FROM val), q AS (SELECT window_id, i, exp(z - max(z) OVER w) / sum(exp(z)) OVER w * exp(max(z) OVER w) AS p, row_number() OVER (PARTITION BY window_id ORDER BY z DESC, i) AS r FROM p WINDOW w AS (PARTITION BY window_id)) SELECT window_id, string_agg(({_NAMES})[i], ',' ORDER BY r) AS names, round(max(p), 4) AS share FROM q WHERE r <= 3 GROUP BY window_id",
    "label_audit": f"WITH {_ANN}, c AS (SELECT class, sum(z - a)::BIGINT AS frames, count(*) AS instances FROM vid GROUP BY class), t AS (SELECT *, frames / sum(frames) OVER () AS share, max(frames) OVER () / greatest(frames, 1) AS imbalance FROM c) SELECT (class // 5)::INT AS coarse, count(*) AS classes, sum(frames)::BIGINT AS frames, sum(instances)::BIGINT AS instances, round(sum(share), 6) AS share, round(max(imbalance), 6) AS imbalance FROM t GROUP BY 1",
    "annotation_gaps": f"WITH {_ANN}, u AS (SELECT *, max(z) OVER (PARTITION BY clip ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM vid), g AS (SELECT clip, clip % 26 AS subject, 1 - sum(greatest(0, z - greatest(a, coalesce(before, a)))) / (max(z) - min(a)) AS gap FROM u GROUP BY clip) SELECT {_CS} AS side, count(*) AS n, round(avg(gap), 6) AS mean_gap, round(median(gap), 6) AS median_gap, round(max(gap), 6) AS most_gap FROM g GROUP BY 1",
}
