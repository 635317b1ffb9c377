"""Readers of annotation and wire files; every reader keeps what it rejects, with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Words that name a column of annotation files.
HEADER = "label class action activity name start end start_frame end_frame begin stop id action_index confidence score event".split()


def spans_from_json(spark: SparkSession, path: str, n_classes: int) -> DataFrame:
    """{video: {subset, duration, actions: [[class, start, end], ...]}} to video, subset, duration, class, start, end, reject_reason."""
    body = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<subset: string, duration: double, actions: array<array<double>>>>").alias("m"))
    v = body.select(F.explode("m").alias("video", "v")).select("video", "v.subset", "v.duration", F.explode_outer("v.actions").alias("a"))
    c = v.select("video", "subset", "duration", F.get("a", 0).cast("int").alias("class"), F.get("a", 1).alias("start"), F.get("a", 2).alias("end"))
    return c.withColumn("reject_reason", F.when(~F.col("class").between(0, n_classes - 1), "class out of range").when(F.col("end") < F.col("start"), "end before start"))


def spans_from_csv(spark: SparkSession, path: str, classes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Lines of class, start, end (by comma, semicolon or tab; with or without a header) to file, line, name, class, start, end,
    reject_reason. classes: name, class; aliases: alias, name. Both are small vocabularies."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(F.replace("value", F.lit("\ufeff"), F.lit("")), r"\r?\n")).alias("line", "text"))
    part = F.transform(F.filter(F.split("text", "[,;\t]"), lambda x: F.trim(x) != ""), lambda x: F.trim(x))
    rows = raw.withColumn("parts", part).filter(F.size("parts") > 0)
    first = F.row_number().over(Window.partitionBy("file").orderBy("line")) == 1
    is_header = F.exists("parts", lambda x: F.lower(x).isin(*HEADER)) & ~F.coalesce(F.get("parts", 1), F.lit("")).rlike(r"^-?\d+$")
    rows = rows.withColumn("_h", first & is_header).filter(~F.col("_h")).drop("_h")
    rows = rows.select("file", "line", F.size("parts").alias("n"), F.get("parts", 0).alias("name"), F.get("parts", 1).try_cast("double").cast("long").alias("start"), F.get("parts", 2).try_cast("double").cast("long").alias("end"))
    if aliases is not None:
        rows = rows.join(F.broadcast(aliases.toDF("_alias", "_name")), rows["name"] == F.col("_alias"), "left").withColumn("_canon", F.coalesce("_name", "name")).drop("_alias", "_name")
    else:
        rows = rows.withColumn("_canon", F.col("name"))
    j = rows.join(F.broadcast(classes.toDF("_cname", "_cid")), rows["_canon"] == F.col("_cname"), "left")
    number = F.col("name").try_cast("int")
    j = j.withColumn("class", F.coalesce(number, "_cid"))
    ids = classes.count()
    why = F.when(F.col("n") < 3, "fewer than three fields").when(F.col("class").isNull(), "unknown class").when(~F.col("class").between(0, ids - 1), "class out of range").when(F.col("start").isNull() | F.col("end").isNull(), "start or end is not a number").when(F.col("end") < F.col("start"), "end before start")
    return j.select("file", "line", "name", "class", "start", "end", why.alias("reject_reason"))


def vocabulary(spans: DataFrame) -> DataFrame:
    """name, n, example file, known: the survey of what files call their classes, whatever else is wrong with their lines."""
    known = F.col("class").isNotNull() & (F.coalesce("reject_reason", F.lit("")) != "class out of range")
    return spans.groupBy("name").agg(F.count("*").alias("n"), F.min("file").alias("example"), F.max(known).alias("known"))


def poses(spark: SparkSession, path: str) -> DataFrame:
    """Pose files {njts, frames: [[{pose3d: [...]}, ...], ...]} to clip, frame_idx, present, joints: the first detection of each frame,
    coordinates regrouped by joint (they come by axis); a frame without detection is present false and zero."""
    body = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("clip"), F.from_json("value", "njts int, frames array<array<struct<pose2d: array<double>, pose3d: array<double>>>>").alias("b"))
    f = body.select("clip", F.col("b.njts").alias("n"), F.posexplode("b.frames").alias("frame_idx", "d"))
    pose = F.get("d", 0)["pose3d"]
    joints = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.array(F.get(pose, k), F.get(pose, k + F.col("n")), F.get(pose, k + 2 * F.col("n"))))
    zero = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    present = F.size("d") > 0
    return f.select("clip", "frame_idx", present.alias("present"), F.when(present, joints).otherwise(zero).alias("joints"))


def coverage(frames: DataFrame, least: float = 0.6) -> DataFrame:
    """clip, n, detected, coverage, longest_gap, usable, reason."""
    w = Window.partitionBy("clip").orderBy("frame_idx")
    g = frames.withColumn("_i", F.sum(F.col("present").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gaps = g.groupBy("clip", "_i").agg(F.count_if(~F.col("present")).alias("gap"), F.count("*").alias("n"), F.count_if("present").alias("d"))
    s = gaps.groupBy("clip").agg(F.sum("n").alias("n"), F.sum("d").alias("detected"), F.max("gap").alias("longest_gap")).withColumn("coverage", F.col("detected") / F.col("n"))
    return s.withColumn("usable", (F.col("coverage") >= least) & (F.col("detected") > 0)).withColumn("reason", F.when(F.col("detected") == 0, "nothing detected").when(F.col("coverage") < least, "coverage too low"))


WIRE = "array<struct<i: long, t: double, people: array<struct<track_id: long, role: string, role_confidence: double, box: array<double>, kp: array<array<double>>>>>>"


def observations_from_wire(payloads: DataFrame, json_col: str = "payload", base_us: str = "base_us") -> DataFrame:
    """Compact frame JSON to one row per person: frame_idx, time_us (base plus t), track_id, role, role_confidence, box, keypoints."""
    keep = [F.col(f"`{c}`") for c in payloads.columns if c != json_col]
    f = payloads.select(*keep, F.explode(F.from_json(json_col, WIRE)).alias("f")).select(*keep, "f.i", "f.t", F.explode("f.people").alias("p"))
    box = F.struct(*[F.get("p.box", k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])
    return f.select(*keep, F.col("i").alias("frame_idx"), (F.col(base_us) + F.round(F.col("t") * 1_000_000).cast("long")).alias("time_us"), "p.track_id", "p.role", "p.role_confidence", box.alias("box"), F.col("p.kp").alias("keypoints"))


def observations_to_wire(rows: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """The inverse: one JSON text per key, frames in order, people by track."""
    person = F.struct("track_id", "role", F.round("role_confidence", 3).alias("role_confidence"), F.array(*[F.round(F.col("box")[n], 1) for n in ("x1", "y1", "x2", "y2")]).alias("box"), F.transform("keypoints", lambda j: F.transform(j, lambda x: F.round(x, 2))).alias("kp"))
    frames = rows.groupBy(*keys, "frame_idx").agg(F.array_sort(F.collect_list(person)).alias("people"))
    frame = F.struct(F.col("frame_idx").alias("i"), F.round(F.col("frame_idx") / fps, 3).alias("t"), "people")
    return frames.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(frame)), {"ignoreNullFields": "false"}).alias("payload"))


def gallery_from_json(rows: DataFrame, json_col: str = "payload") -> DataFrame:
    """{"residents": [{name, role, centroid}]} to name, role, centroid, reject_reason."""
    r = rows.select(F.explode(F.from_json(json_col, "residents array<struct<name: string, role: string, centroid: array<double>>>")["residents"]).alias("r")).select("r.*")
    return r.withColumn("reject_reason", F.when(F.coalesce("name", F.lit("")) == "", "no name").when(F.col("centroid").isNull() | (F.size("centroid") == 0), "no centroid").when(~F.col("role").isin("resident", "carer", "visitor"), "unknown role"))


TRACKS = "array<struct<track_id: long, role: string, segments: array<struct<label: int, name: string, t0: double, t1: double, confidence: double, room: string>>>>"


def segments_from_wire(payloads: DataFrame, json_col: str = "tracks", base_us: str = "base_us") -> DataFrame:
    """Per-track segment arrays to one row per segment, with absolute times; a segment without length lasts a millisecond."""
    keep = [F.col(f"`{c}`") for c in payloads.columns if c not in (json_col, base_us)]
    t = payloads.select(*keep, F.col(base_us).alias("_base"), F.explode(F.from_json(json_col, TRACKS)).alias("t"))
    s = t.select(*keep, "_base", "t.track_id", F.coalesce("t.role", F.lit("unknown")).alias("role"), F.explode("t.segments").alias("s"))
    t1 = F.when(F.col("s.t1") <= F.col("s.t0"), F.col("s.t0") + 0.001).otherwise(F.col("s.t1"))
    micro = lambda c: F.col("_base") + F.round(c * 1_000_000).cast("long")
    return s.select(*keep, F.concat(F.lit("t"), "track_id", F.lit("-"), "s.label", F.lit("-"), F.format_string("%.2f", "s.t0")).alias("segment_id"), "track_id", "role", F.col("s.label").alias("activity_id"), F.col("s.name").alias("activity_name"), micro(F.col("s.t0")).alias("start_us"), micro(t1).alias("end_us"), F.coalesce("s.confidence", F.lit(0.5)).alias("confidence"), "s.room")


def segments_to_wire(timelines: DataFrame, keys: list[str]) -> DataFrame:
    """The inverse, from timelines (keys, track_id, role, segments of t0, t1, label, name, confidence, room): one JSON text per key."""
    return timelines.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct("track_id", "role", "segments"))), {"ignoreNullFields": "false"}).alias("tracks"))


def subject_map(spark: SparkSession, path: str, id_col: str = "id", subject_col: str = "subject") -> DataFrame:
    """A CSV with a header to id_col, subject; ValueError without the two columns or without rows."""
    raw = spark.read.csv(path, header=True)
    if id_col not in raw.columns or subject_col not in raw.columns:
        raise ValueError(f"{path} lacks {id_col} or {subject_col}; it has {raw.columns}")
    found = raw.filter(F.coalesce(F.col(id_col), F.lit("")) != "").select(F.col(id_col), F.col(subject_col).alias("subject"))
    if found.isEmpty():
        raise ValueError(f"{path} has no subjects")
    return found


def split_names(spark: SparkSession, path: str) -> DataFrame:
    """Clip names listed one a line to file, name, subject, take, camera, reject_reason."""
    from dayweave.operators.labels import video_id

    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("name")).filter("name <> ''")
    v = t.withColumn("_v", video_id(F.col("name")))
    return v.select("file", "name", "_v.subject", "_v.take", "_v.camera", F.when(F.col("_v").isNull(), "no single id in the name").alias("reject_reason"))


def class_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines like "c093 Walking through a doorway" to label, text."""
    t = spark.read.text(path).select(F.regexp_extract("value", r"^(c\d{3})\s+(.+?)\s*$", 1).alias("label"), F.regexp_extract("value", r"^(c\d{3})\s+(.+?)\s*$", 2).alias("text"))
    return t.filter("label <> ''")


def gallery_to_json(gallery: DataFrame, json_col: str = "payload") -> DataFrame:
    """The inverse: name, role, centroid to one row with the text of all residents, by name. A gallery is the people of one home."""
    r = F.array_sort(F.collect_list(F.struct("name", "role", "centroid")))
    return gallery.groupBy().agg(F.to_json(F.struct(r.alias("residents")), {"ignoreNullFields": "false"}).alias(json_col))


def label_map(spark: SparkSession, path: str, classes: tuple[str, ...]) -> DataFrame:
    """A taxonomy's map, a CSV of label, class, drop, to label, class, drop (boolean), reject_reason: a label is dropped or has a known
    class. The rows without a reason are what mapped() takes."""
    raw = spark.read.csv(path, header=True).select(F.trim("label").alias("label"), F.nullif(F.trim("class"), F.lit("")).alias("class"), F.coalesce(F.lower(F.trim("drop")).isin("1", "true", "yes"), F.lit(False)).alias("drop"))
    why = F.when(F.coalesce("label", F.lit("")) == "", "no label").when(~F.col("drop") & F.col("class").isNull(), "no class").when(~F.col("drop") & ~F.col("class").isin(*classes), "unknown class")
    return raw.withColumn("reject_reason", why)
