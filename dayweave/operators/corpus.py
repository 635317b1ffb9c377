"""The corpus side: protocols, subject maps, supervision, pose archives, shard audits, names and paths, record validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Subjects and cameras of the official partitions.
TRAIN_SUBJECTS = (3, 4, 6, 7, 9, 12, 13, 15, 17, 19, 25)
TEST_SUBJECTS = (2, 10, 11, 14, 16, 18, 20)
CAMERAS = {"CV1": {"train": (1,), "val": (5,), "test": (2,)}, "CV2": {"train": (1, 3, 4, 6, 7), "val": (5,), "test": (2,)}}
# Thirteen pose joints in file order; levels of an upright person from the ground up, as joint places.
JOINTS = "right_ankle left_ankle right_knee left_knee right_hip left_hip right_wrist left_wrist right_elbow left_elbow right_shoulder left_shoulder head".split()
UPRIGHT = ((0, 1), (2, 3), (4, 5), (10, 11), (12,))
# Folder and file words of fall clips and of everyday clips.
FALL_WORDS = ("fall", "falls", "chute")
DAILY_WORDS = ("adl", "notfall", "not_fall", "nofall", "normal", "daily")


# ---- protocols and subjects -----------------------------------------------------------------------------------


def protocol_side(subject: Column, camera: Column, protocol: str) -> Column:
    """train, val, test or unused: by subject in the cross-subject protocol CS, by camera in the cross-view ones."""
    if protocol == "CS":
        return F.when(subject.isin(*TRAIN_SUBJECTS), "train").when(subject.isin(*TEST_SUBJECTS), "test").otherwise("unused")
    sides = CAMERAS[protocol]
    return F.when(camera.isin(*sides["train"]), "train").when(camera.isin(*sides["val"]), "val").when(camera.isin(*sides["test"]), "test").otherwise("unused")


def protocol_counts(videos: DataFrame) -> DataFrame:
    """protocol, side, n: videos (subject, camera) on each side of each protocol."""
    sides = F.array(*[F.struct(F.lit(p).alias("protocol"), protocol_side(F.col("subject"), F.col("camera"), p).alias("side")) for p in ("CS", *CAMERAS)])
    return videos.select(F.inline(sides)).groupBy("protocol", "side").agg(F.count("*").alias("n"))


def stray_subjects(videos: DataFrame) -> DataFrame:
    """subject, subset of subjects that a file marks against the official partition; none for a cross-view file, whose subjects are on
    both sides."""
    seen = videos.select("subject", F.when(F.col("subset") == "training", "training").otherwise("testing").alias("subset")).distinct()
    both = seen.groupBy("subject").agg(F.count("*").alias("sides")).agg(F.coalesce(F.max("sides"), F.lit(0)).alias("_most"))
    wrong = F.when(F.col("subset") == "training", ~F.col("subject").isin(*TRAIN_SUBJECTS)).otherwise(~F.col("subject").isin(*TEST_SUBJECTS))
    return seen.filter(wrong).join(F.broadcast(both.filter("_most < 2"))).drop("_most")  # one row


def remapped(rows: DataFrame, subject_map: DataFrame, key: str) -> DataFrame:
    """rows with subject (the map's, or the key itself where the map has none) and matched; of several entries of a key the least counts."""
    m = subject_map.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("subject").alias("subject"))
    j = rows.drop("subject").join(m, key, "left")
    return j.withColumn("matched", F.col("subject").isNotNull()).withColumn("subject", F.coalesce("subject", F.col(key).cast("string")))


def supervised(rows: DataFrame, specs: DataFrame, n_classes: int, tag: str = "tag") -> DataFrame:
    """rows with allowed (array of boolean: the classes that the row's corpus may teach); a tag without a spec fails the job.

    specs: tag, classes (array of int); one row per corpus, a small dimension table.
    """
    j = rows.join(specs.select(F.col(tag).alias("_tag"), "classes"), F.col(tag) == F.col("_tag"), "left")
    known = F.when(F.col("_tag").isNull(), F.raise_error(F.concat(F.lit("no spec for corpus "), F.coalesce(F.col(tag), F.lit("null")))).cast("array<int>")).otherwise(F.col("classes"))
    return j.withColumn("_c", known).withColumn("allowed", F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda c: F.array_contains("_c", c))).drop("_tag", "_c", "classes")


def supervised_classes(fine: DataFrame, fine_map: DataFrame, n_coarse: int) -> DataFrame:
    """class, taught: every coarse class, and whether some fine class that occurs maps to it."""
    taught = fine.select("class").distinct().join(fine_map, "class").select(F.col("coarse").cast("long").alias("coarse")).distinct()
    every = fine.sparkSession.range(n_coarse)
    return every.join(taught, every.id == taught.coarse, "left").select(F.col("id").alias("class"), F.col("coarse").isNotNull().alias("taught"))


# ---- pose archives --------------------------------------------------------------------------------------------


def upright(flat: Column, n_joints: int = len(JOINTS), by_axis: bool = True) -> Column:
    """Whether a flat 2D pose, read by axis (all x, then all y) or by joint, stands: each level lower in the image than the next."""
    y = lambda j: F.get(flat, n_joints + j if by_axis else 2 * j + 1)
    level = [sum((y(j) for j in group), F.lit(0.0)) / len(group) for group in UPRIGHT]
    ok = F.lit(True)
    for above, below in zip(level, level[1:], strict=False):
        ok = ok & (above > below)
    return ok


def layout_votes(poses: DataFrame, key: str = "clip") -> DataFrame:
    """One row per file of poses (clip, flat): share of upright frames under both readings, winner, margin, decisive."""
    score = lambda by_axis: F.round(F.avg(F.coalesce(upright(F.col("flat"), by_axis=by_axis), F.lit(False)).cast("double")), 4)
    v = poses.groupBy(key).agg(score(True).alias("by_axis"), score(False).alias("by_joint"), F.count("*").alias("n_frames"))
    best, gap = F.greatest("by_axis", "by_joint"), F.abs(F.col("by_axis") - F.col("by_joint"))
    return v.withColumn("winner", F.when(F.col("by_axis") >= F.col("by_joint"), "by_axis").otherwise("by_joint")).withColumn("margin", F.round(gap, 4)).withColumn("decisive", (best >= 0.5) & (F.round(gap, 4) >= 0.2))


def layout_verdict(votes: DataFrame, assumed: str = "by_axis", least_decisive: int = 8, least_agreement: float = 0.9) -> DataFrame:
    """One row for the archive: n_read, n_decisive, n_agree, agreement, accepted and why not."""
    s = votes.agg(F.count("*").alias("n_read"), F.count_if("decisive").alias("n_decisive"), F.count_if(F.col("decisive") & (F.col("winner") == assumed)).alias("n_agree"))
    s = s.withColumn("agreement", F.round(F.coalesce(F.try_divide("n_agree", "n_decisive"), F.lit(0.0)), 4))
    why = F.when(F.col("n_decisive") < least_decisive, "too few decisive files").when(F.col("agreement") < least_agreement, "written the other way round")
    return s.withColumn("reason", why).withColumn("accepted", F.col("reason").isNull())


def archive_check(frames: DataFrame, votes: DataFrame, least_coverage: float = 0.6, key: str = "clip") -> DataFrame:
    """One row per source of frames (source, clip, present, flat): files, frames, share without a pose, deciles of coverage, files under
    the gate, uprightness of seen frames, layout winners and the median margin. Exact medians and deciles keep a count for each distinct value, so
    values are taken to six decimals, which bounds what a source holds."""
    seen = F.when(F.col("present"), F.coalesce(upright(F.col("flat")), F.lit(False)).cast("double"))
    f = frames.groupBy("source", key).agg(F.count("*").alias("frames"), F.count_if(~F.col("present")).alias("missing"), F.round(F.avg(seen), 3).alias("upright"))
    f = f.join(votes.select(key, "winner", "margin"), key, "left").withColumn("coverage", 1 - F.col("missing") / F.col("frames"))
    s = f.groupBy("source").agg(
        F.count("*").alias("n_files"), F.sum("frames").alias("total_frames"), F.round(F.sum("missing") / F.sum("frames"), 5).alias("missing_share"), F.percentile(F.round("coverage", 6), F.array(*[F.lit(q / 10) for q in range(11)])).alias("_q"),
        F.count_if(F.col("coverage") < least_coverage).alias("n_dropped"), F.round(F.median("upright"), 3).alias("upright_median"), F.min("upright").alias("upright_min"),
        F.count_if(F.col("winner") == "by_axis").alias("won_by_axis"), F.count_if(F.col("winner") == "by_joint").alias("won_by_joint"), F.round(F.median(F.round("margin", 6)), 3).alias("margin_median"),
    )
    return s.withColumn("coverage_deciles", F.array_join(F.transform("_q", lambda q: F.format_number(q, 3)), " ")).drop("_q")


def backend_summary(records: DataFrame, by: str = "backend", least: float = 0.3) -> DataFrame:
    """One row per backend of pose records (backend, frame, joints): frames, records, usable and weak ones, mean score of good joints,
    complete torsos, median height."""
    from dayweave.functions.skeleton import LEFT_HIP, LEFT_SHOULDER, RIGHT_HIP, RIGHT_SHOULDER, box_of

    good = F.filter("joints", lambda j: F.get(j, 2) >= least)
    box = box_of(F.col("joints"))
    r = records.select(by, "frame", F.size(good).alias("n_good"), F.aggregate(good, F.lit(0.0), lambda a, j: a + F.get(j, 2)).alias("score"), F.forall(F.array(*[F.lit(k) for k in (LEFT_SHOULDER, RIGHT_SHOULDER, LEFT_HIP, RIGHT_HIP)]), lambda k: F.get(F.get("joints", k), 2) >= least).alias("torso"), (box["y2"] - box["y1"]).alias("height"))
    return r.groupBy(by).agg(F.count_distinct("frame").alias("frames"), F.count("*").alias("person_records"), F.count_if(F.col("n_good") > 0).alias("usable_records"), F.count_if(F.col("n_good") == 0).alias("weak_records"), F.round(F.coalesce(F.try_divide(F.sum("score"), F.sum("n_good")), F.lit(0.0)), 4).alias("mean_score"), F.count_if("torso").alias("torso_complete"), F.round(F.median("height"), 1).alias("median_height"))


def built_clips(frames: DataFrame, parents: list[int], root: int, n_frames: int, least: float = 0.6) -> DataFrame:
    """clip, coverage, bridged_share, joint, bone of clips (clip, present, frames) that pass the coverage gate: bridged, resampled, centred."""
    from dayweave.functions import skeleton as S

    share = F.try_divide(F.size(F.filter("present", lambda p: p)), F.size("present"))
    c = frames.withColumn("coverage", share).filter(F.col("coverage") >= least)
    c = c.withColumn("joint", S.centred(S.resampled(S.bridged(F.col("frames"), F.col("present")), n_frames), root))
    return c.select("clip", F.round("coverage", 4).alias("coverage"), F.round(1 - F.col("coverage"), 4).alias("bridged_share"), F.size("frames").alias("source_frames"), "joint", S.bones(F.col("joint"), parents).alias("bone"))


def unscaled(windows: DataFrame, values: str, limit: float = 25.0) -> DataFrame:
    """windows with peak and reject_reason where values are at pixel scale, as normalised ones never are."""
    peak = F.array_max(F.transform(values, F.abs))
    return windows.withColumn("peak", peak).withColumn("reject_reason", F.when(F.col("peak") > limit, "pixel scale"))


def kept_frames(clips: DataFrame, source_fps: float, target_fps: float) -> DataFrame:
    """clip, k, frame: the source frames kept for an exact target rate, the k-th at k * source / target, halves to even."""
    rate = min(source_fps, target_fps)
    last = F.floor((F.col("n_frames") - 1) * rate / source_fps + 1).cast("int")
    k = clips.filter("n_frames > 0").select("clip", "n_frames", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    return k.select("clip", "k", F.bround(F.col("k") * source_fps / rate).cast("long").alias("frame"), "n_frames").filter(F.col("frame") < F.col("n_frames")).drop("n_frames")


# ---- audits ---------------------------------------------------------------------------------------------------


def shard_audit(rows: DataFrame, least: int = 3) -> DataFrame:
    """kind, key, n: rows (y, split, subject) by class and split, subjects on one side only, subjects with fewer than `least` rows."""
    count = lambda kind, col: rows.groupBy(F.col(col).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    subjects = rows.groupBy(F.col("subject").cast("string").alias("key")).agg(F.count_distinct("split").alias("sides"), F.count("*").alias("n"))
    flagged = subjects.select("key", "n", F.explode(F.array_compact(F.array(F.when(F.col("sides") == 1, "one_sided"), F.when(F.col("n") < least, "tiny")))).alias("kind"))
    return count("class", "y").unionByName(count("split", "split")).unionByName(flagged.select("kind", "key", "n"))


def dataset_profile(crops: DataFrame) -> DataFrame:
    """One row per split of crops (split, pid, camera): images, ids, cameras, images per id at ranks, ids seen by two cameras or more."""
    ids = crops.groupBy("split", "pid").agg(F.count("*").alias("n"), F.count_distinct("camera").alias("cams"))
    sizes = ids.groupBy("split", "n").agg(F.count("*").alias("c"), F.count_if(F.col("cams") >= 2).alias("multi"))  # ids by how many images they have
    w = Window.partitionBy("split")  # a row for each such number
    r = sizes.withColumn("_end", F.sum("c").over(w.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("c").over(w))
    place = lambda p: F.least(F.col("_n") - 1, F.floor(F.col("_n") * p))
    at = lambda p: F.max(F.when((F.col("_end") - F.col("c") <= place(p)) & (place(p) < F.col("_end")), F.col("n")))
    s = r.groupBy("split").agg(F.sum(F.col("n") * F.col("c")).alias("images"), F.sum("c").alias("ids"), F.min("n").alias("least"), at(0.1).alias("p10"), at(0.5).alias("median"), at(0.9).alias("p90"), F.max("n").alias("most"), F.sum("multi").alias("multi_camera"))
    cams = crops.groupBy("split").agg(F.count_distinct("camera").alias("cameras"))
    return s.join(cams, "split")


# ---- names and paths ------------------------------------------------------------------------------------------


def class_id(name: Column, names: list[str], space: str = "skeleton") -> Column:
    """Place of a class name: from 0 in the skeleton space, from 1 in the rgb one; null for an unknown name."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), name)
    return F.when(at > 0, at - (0 if space == "rgb" else 1)).cast("int")


def class_name(number: Column, names: list[str], space: str = "skeleton") -> Column:
    """The inverse; null outside the space, and for the rgb space's 0, which stands for a name that was not recognised."""
    return F.get(F.array(*[F.lit(n) for n in names]), (number - (1 if space == "rgb" else 0)).cast("int"))


def _folders(path: Column) -> Column:
    return F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\s_.\-]+"), lambda w: w != "")


def is_fall(path: Column) -> Column:
    """Whether a clip shows a fall: the first folder that says so either way, everyday words first; else the file's name."""
    any_of = lambda words, of: F.arrays_overlap(words, F.array(*[F.lit(w) for w in of]))
    denied = lambda w: any_of(w, DAILY_WORDS) | (F.array_contains(w, "no") & F.array_contains(w, "fall"))
    said = F.transform(_folders(path), lambda p: F.when(denied(_words(p)), False).when(any_of(_words(p), FALL_WORDS), True))
    stem = _words(_stem(path))
    return F.coalesce(F.get(F.array_compact(said), 0), ~(F.array_contains(stem, "no") & F.array_contains(stem, "fall")) & any_of(stem, FALL_WORDS))


def subject_of_path(path: Column, source: str) -> Column:
    """Who is filmed: the first folder that is neither a fall, everyday nor camera folder; else the file's name without its camera."""
    known = [*FALL_WORDS, *DAILY_WORDS]
    kept = F.filter(_folders(path), lambda p: ~F.lower(p).isin(*known) & ~p.rlike(r"(?i)^(cam\w*|camera\s*\d*)$"))
    return F.concat(F.lit(f"{source}_"), F.coalesce(F.replace(F.get(kept, 0), F.lit(" "), F.lit("")), F.regexp_replace(_stem(path), r"(?i)[-_]?cam\w*$", "")))


# ---- records --------------------------------------------------------------------------------------------------


def observation_faults(n_joints: int = 17) -> Column:
    """Reasons why a person observation (box, confidences, role, keypoints, track_id, frame_idx) is not valid."""
    inside = lambda c: F.col(c).isNull() | ~F.col(c).between(0, 1)
    return F.array_compact(F.array(
        F.when(F.col("frame_idx").isNull() | (F.col("frame_idx") < 0), "frame_idx"), F.when(F.col("track_id").isNull() | (F.col("track_id") < 0), "track_id"),
        F.when(~F.coalesce((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False)), "degenerate box"), F.when(inside("confidence"), "confidence"), F.when(inside("role_confidence"), "role_confidence"),
        F.when((F.col("role") == "unknown") & (F.col("role_confidence") > 0.5), "unknown role with confidence"), F.when(F.col("n_joints").isNotNull() & (F.col("n_joints") != n_joints), "keypoints"),
    ))


def segment_faults(n_classes: int = 22) -> Column:
    """Reasons why an activity segment is not valid."""
    return F.array_compact(F.array(
        F.when(F.col("track_id").isNull() | (F.col("track_id") < 0), "track_id"), F.when(F.col("activity_id").isNull() | ~F.col("activity_id").between(0, n_classes - 1), "activity_id"),
        F.when(~F.coalesce(F.col("end_us") > F.col("start_us"), F.lit(False)), "end before start"), F.when(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1), "confidence"),
    ))


def shard_faults(n_classes: int, subjects: Column) -> Column:
    """Reasons why a shard row (label, subject, actions: array of class, start, end) doesn't belong to a corpus of n_classes whose subjects
    are known."""
    outside = lambda c: ~F.coalesce(c.between(0, n_classes - 1), F.lit(False))
    return F.array_compact(F.array(
        F.when(outside(F.col("label")), "label out of range"), F.when(~F.coalesce(F.array_contains(subjects, F.col("subject")), F.lit(False)), "unknown subject"),
        F.when(F.exists("actions", lambda a: outside(F.get(a, 0))), "class out of range"), F.when(F.exists("actions", lambda a: F.get(a, 2) < F.get(a, 1)), "end before start"),
    ))


def alert_faults() -> Column:
    """Reasons why an alert is not valid: no evidence, or evidence whose reference doesn't name a feature and a day."""
    return F.array_compact(F.array(F.when(F.coalesce(F.size("evidence"), F.lit(0)) < 1, "no evidence"), F.when(F.exists("evidence", lambda e: ~F.coalesce(e["ref"].rlike(r"^feat:[a-z0-9_]+:\d{4}-\d{2}-\d{2}$"), F.lit(False))), "evidence reference")))


def validated(rows: DataFrame, faults: Column) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and the others with reject_reasons."""
    r = rows.withColumn("reject_reasons", faults)
    return r.filter(F.size("reject_reasons") == 0).drop("reject_reasons"), r.filter(F.size("reject_reasons") > 0)


def timeline(segments: DataFrame, keys: list[str], falls: tuple[int, ...] = (7, 8)) -> DataFrame:
    """One row per group and track: its segments in order (offsets in seconds from the first of the group), how many, how many of falls.
    A row holds all of a track's segments in its group, so let the keys name a day or a clip."""
    first = segments.groupBy(*keys).agg(F.min("start_us").alias("_base"))
    at = lambda c: F.round((F.col(c) - F.col("_base")) / 1_000_000, 2)
    row = F.struct(at("start_us").alias("t0"), at("end_us").alias("t1"), F.col("activity_id").alias("label"), "room", F.round("confidence", 3).alias("confidence"))
    return segments.join(first, keys).groupBy(*keys, "track_id").agg(F.array_sort(F.collect_list(row)).alias("segments"), F.count("*").alias("n_segments"), F.count_if(F.col("activity_id").isin(*falls)).alias("fall_segments"))
