"""Queries over files that Spark writes from the tables and reads back: archives, shards, lines, names; and splits and folds by identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.config import ACTIVITIES
from dayweave.functions.arrays import argmax
from dayweave.operators.counted import Counters
from dayweave.operators.splits import checked, partition_faults, subject_split
from dayweave.operators.tracks import adapted_centroids, windows
from dayweave.plans import annotation
from dayweave.plans.claims import ORACLES as CLAIMS
from dayweave.plans.claims import q_verified
from dayweave.plans.evaluation import _VAL, val_logits
from dayweave.sources import annotations as A
from dayweave.sources import arrays, listing, records
from dayweave.sources.domain import table
from dayweave.sources.files import write_files
from dayweave.sources.shared import scratch, staged
from dayweave.sources.sinks import byte_shards, write_byte_shards


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").filter("embedding is not null and label is not null")


def q_archives(s: SparkSession, d: str) -> DataFrame:
    """Every embedding, written into archives and read back in ranges of rows."""
    at = scratch(s, "archives")
    written = staged(arrays.write_archives(vectors(s, d).select(F.col("vec_id").cast("string").alias("name"), "label", "embedding"), at, ["name", "label", "embedding"], rows=300), "written")
    back = arrays.arrays(s, at, ["name", "label", "embedding"], part_bytes=20_000)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    out = back.select(F.col("name").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.get("embedding_shape", 0).alias("width"), F.round(total, 4).alias("total"))
    return out.crossJoin(F.broadcast(written.agg(F.sum("n_rows").alias("n_written"))))  # one row


def q_saved_logits(s: SparkSession, d: str) -> DataFrame:
    """Logits saved as compressed archives, scored as they are read: rows and hits of each class."""
    at = scratch(s, "logits")
    v = val_logits(s, d).select(F.col("y").alias("labels"), F.col("joint").alias("logits"))
    staged(arrays.write_archives(v, at, ["logits", "labels"], compressed=True), "written")
    r = arrays.saved_logits(s, at)
    return r.groupBy("label").agg(F.count("*").alias("n"), F.count_if(argmax(F.col("logits")) == F.col("label")).alias("n_right"))


def q_byte_shards(s: SparkSession, d: str) -> DataFrame:
    """Documents in shards of 200 kB at most, as written: rows, bytes, first and last id."""
    at = scratch(s, "shards")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    write_byte_shards(table(s, d, "documents").select("doc_id", "text"), at, 200_000, size, F.col("doc_id"))
    return s.read.parquet(at).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), F.sum(size).alias("n_bytes"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def q_claim_audit(s: SparkSession, d: str) -> DataFrame:
    """Every claim with its checks, dumped as JSON lines and read back by the manifest."""
    at = scratch(s, "claims")
    rows = q_verified(s, d)
    records.write_jsonl(rows, at)
    back = records.read_jsonl(s, at, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes))
    n = records.manifest(s, at).agg(F.sum("n_rows").alias("in_manifest"))
    by = back.groupBy("arm", "home_id").agg(F.count("*").alias("n"), F.count_if("faithful").alias("n_faithful"), F.count_if(F.col("injected").isNotNull()).alias("n_injected"), F.max("day").alias("last_day"))
    return by.crossJoin(F.broadcast(n))  # one row


def q_scanned_names(s: SparkSession, d: str) -> DataFrame:
    """Empty files named after suppliers, in two folders: what their names say, and why others are left out."""
    at = scratch(s, "names")
    k = F.col("s_suppkey").cast("int")
    name = (
        F.when(k % 11 == 0, F.format_string("0000_c%d_%04d.jpg", k % 6, k)).when(k % 7 == 0, F.format_string(".%04d_c1_1.jpg", k)).when(k % 5 == 0, F.format_string("%04d_c%d.txt", k, k % 6))
        .when(k % 13 == 0, F.format_string("%04d-c1.png", k)).otherwise(F.format_string("%04d_c%d_%04d.jpg", k, k % 6, k % 40))
    )
    folder = F.when(k % 2 == 0, "query/").otherwise("gallery/deep/")
    staged(write_files(table(s, d, "supplier").select(F.concat(folder, name).alias("name"), F.lit("").alias("text")), at), "touched")
    return listing.crops(listing.names(s, at))


def q_adapted(s: SparkSession, d: str) -> DataFrame:
    """A centroid for each label, started by its first vector and moved by the others that match comfortably."""
    v = vectors(s, d).select(F.col("label").alias("pid"), F.col("vec_id").alias("order"), F.col("embedding").cast("array<double>").alias("vector"))
    start = v.groupBy("pid").agg(F.min_by("vector", "order").alias("centroid"), F.min("order").alias("_o")).withColumn("n_updates", F.lit(1).cast("long"))
    rest = v.join(F.broadcast(start.select("pid", "_o")), "pid").filter("order > _o").drop("_o")  # a row a label
    out = adapted_centroids(rest, start.drop("_o"), 0.9, 1.2)
    return out.select("pid", "n_updates", "n_refused", F.round(F.get("centroid", 0), 6).alias("first"), F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def q_checked_split(s: SparkSession, d: str) -> DataFrame:
    """Subjects of the windows, a fifth held out; the split is checked before anything reads it."""
    v = val_logits(s, d)
    rows = v.join(subject_split(v).select("subject", "part"), "subject")
    return checked(rows).groupBy("part").agg(F.count_distinct("subject").alias("n_subjects"), F.count("*").alias("n"))


def q_partition_faults(s: SparkSession, d: str) -> DataFrame:
    """Subjects of the windows, some on the wrong side, against an official partition that they cover."""
    rows = val_logits(s, d).select("subject", F.when(F.col("subject") < 9, "train").otherwise("validation").alias("part"))
    return partition_faults(rows, {"train": tuple(range(10)), "validation": tuple(range(10, 20))})


def q_counted_windows(s: SparkSession, d: str) -> DataFrame:
    """Windows over observations, and what was dropped on the way, counted by the pass that wrote them."""
    e = table(s, d, "events").filter("user_id is not null and event_id is not null")
    rows = e.select(F.col("user_id").alias("track_id"), F.floor(F.col("event_id") / 40).alias("frame_idx"), F.col("event_type").alias("room"), F.lit("resident").alias("role"), (F.col("event_id") % 4 != 0).alias("usable"))
    rows = staged(rows.groupBy("track_id", "frame_idx").agg(F.min("room").alias("room"), F.min("role").alias("role"), F.max("usable").alias("usable")), "observed")
    counters = Counters()
    built = staged(windows(rows, ["track_id"], 6, 3, 60, counters), "windows")
    n = counters.read()
    return built.groupBy().agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("start_frame"), F.lit(0)).cast("long").alias("starts")).select("*", *[F.lit(n[k]).cast("long").alias(k) for k in sorted(n)])


ALIAS, CLASSES = "resting", 18


def _annotation_texts(s: SparkSession, d: str) -> DataFrame:
    """Spans of each clip as lines of a file: every third file with a header, every other one with semicolons; some lines are bad."""
    v = annotation.videos(s, d)
    name = F.when(F.col("segment_id") % 17 == 0, "juggling").when(F.col("class") == 3, ALIAS).otherwise(F.get(F.array(*[F.lit(a) for a in ACTIVITIES]), F.col("class").cast("int")))
    start = F.when(F.col("segment_id") % 19 == 0, "x").otherwise(F.col("start").cast("string"))
    end = F.when(F.col("segment_id") % 23 == 0, "-5").otherwise(F.col("end").cast("string"))
    mark = F.when(F.col("clip") % 2 == 0, ",").otherwise(";")
    line = F.when(F.col("segment_id") % 29 == 0, name).otherwise(F.concat(name, mark, start, F.lit(" "), mark, F.lit(" "), end))
    lines = v.groupBy("clip").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("t"))
    head = F.when(F.col("clip") % 3 == 0, "event,start,end\n").otherwise("")
    return lines.select(F.concat(F.lit("clips/"), F.col("clip").cast("string"), F.lit(".csv")).alias("name"), F.concat(head, "t").alias("text"))


def _csv_spans(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "csv")
    staged(write_files(_annotation_texts(s, d), at), "written")
    classes = s.createDataFrame([(a, i) for i, a in enumerate(ACTIVITIES)], "name string, class int")
    return A.spans_from_csv(s, f"{at}/clips", classes, s.createDataFrame([(ALIAS, ACTIVITIES[3])], "alias string, name string"))


def q_csv_spans(s: SparkSession, d: str) -> DataFrame:
    """Annotation files written from the spans and read back, by clip, class and reason."""
    clip = F.regexp_extract("file", r"(\d+)\.csv$", 1).cast("long")
    return _csv_spans(s, d).groupBy(clip.alias("clip"), "class", "reject_reason").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


def q_vocabulary(s: SparkSession, d: str) -> DataFrame:
    """What those files call their classes, and which names are known."""
    return A.vocabulary(_csv_spans(s, d)).select("name", "n", "known")


def q_json_spans(s: SparkSession, d: str) -> DataFrame:
    """Annotations of each home's clips as one JSON file, read back by clip and reason."""
    at = scratch(s, "json")
    v = annotation.videos(s, d)
    spans = v.groupBy("clip").agg(F.array_sort(F.collect_list(F.array("class", "start", F.when(F.col("segment_id") % 23 == 0, F.lit(-5).cast("long")).otherwise(F.col("end"))))).alias("actions"), F.max("end").cast("double").alias("duration"))
    entry = F.struct(F.col("clip").cast("string").alias("k"), F.struct(F.when(F.col("clip") % 2 == 0, "training").otherwise("testing").alias("subset"), "duration", "actions").alias("v"))
    texts = spans.groupBy((F.col("clip") % 10).alias("home")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("text"))
    staged(write_files(texts.select(F.concat(F.lit("a/"), F.col("home").cast("string"), F.lit(".json")).alias("name"), "text"), at), "written")
    r = A.spans_from_json(s, f"{at}/a", CLASSES)
    return r.groupBy(F.col("video").cast("long").alias("clip"), "subset", "duration", "reject_reason").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


def q_pose_coverage(s: SparkSession, d: str) -> DataFrame:
    """Pose files of clips of ten frames, some without a detection: coverage, gaps, and the sum of what was read."""
    at = scratch(s, "poses")
    e = vectors(s, d).withColumn("clip", F.floor(F.col("vec_id") / 10).cast("long"))
    pose = F.struct(F.array().cast("array<double>").alias("pose2d"), F.transform(F.slice("embedding", 1, 39), lambda x: F.round(x.cast("double"), 5)).alias("pose3d"))
    seen = F.col("vec_id") % 10 >= F.col("clip") % 8
    frame = F.when(seen, F.array(pose)).otherwise(F.array().cast("array<struct<pose2d: array<double>, pose3d: array<double>>>"))
    clips = e.groupBy("clip").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", frame.alias("f")))), lambda x: x["f"]).alias("frames"))
    body = F.to_json(F.struct(F.lit(13).alias("njts"), "frames"))
    staged(write_files(clips.select(F.concat(F.lit("p/"), F.col("clip").cast("string"), F.lit(".json")).alias("name"), body.alias("text")), at), "written")
    r = A.poses(s, f"{at}/p")
    total = r.groupBy("clip").agg(F.round(F.sum(F.aggregate(F.flatten("joints"), F.lit(0.0), lambda a, x: a + x)), 5).alias("total"))
    c = A.coverage(r).join(total, "clip")
    return c.select(F.col("clip").cast("long").alias("clip"), "n", "detected", F.round("coverage", 6).alias("coverage"), "longest_gap", "usable", "reason", "total")


QUERIES = {
    "csv_spans": q_csv_spans, "vocabulary": q_vocabulary, "json_spans": q_json_spans, "pose_coverage": q_pose_coverage,
    "npz_archives": q_archives, "saved_logits": q_saved_logits, "byte_shards": q_byte_shards, "claim_audit": q_claim_audit, "scanned_names": q_scanned_names, "adapted_centroids": q_adapted,
    "checked_split": q_checked_split, "partition_faults": q_partition_faults, "counted_windows": q_counted_windows,
}

# ---- SQL ------------------------------------------------------------------------------------------------------

_SUBJECTS = "u AS (SELECT subject, count(*) AS n FROM val GROUP BY subject), p AS (SELECT subject, n, CASE WHEN row_number() OVER (ORDER BY md5('split|' || subject)) <= greatest(1, floor(count(*) OVER () * 0.2)) THEN 'validation' ELSE 'train' END AS part FROM u)"
_NAMES = "(" + repr(list(ACTIVITIES)) + ")"
_CSV = f"""{annotation._VID},
line AS (SELECT clip, segment_id AS s, CASE WHEN segment_id % 17 = 0 THEN 'juggling' WHEN class = 3 THEN '{ALIAS}' ELSE {_NAMES}[class + 1] END AS name, CASE WHEN segment_id % 17 <> 0 THEN class::INT END AS known, "start" AS a, CASE WHEN segment_id % 23 = 0 THEN -5 ELSE "end" END AS z FROM vid),
spans AS (SELECT clip, name, known AS class, CASE WHEN s % 29 <> 0 AND s % 19 <> 0 THEN a END AS a, CASE WHEN s % 29 <> 0 THEN z END AS z,
  CASE WHEN s % 29 = 0 THEN 'fewer than three fields' WHEN known IS NULL THEN 'unknown class' WHEN s % 19 = 0 THEN 'start or end is not a number' WHEN z < a THEN 'end before start' END AS reject_reason FROM line)"""
ORACLES = {
    "csv_spans": f"WITH {_CSV} SELECT clip, class, reject_reason, count(*) AS n, sum(a)::BIGINT AS starts, sum(z)::BIGINT AS ends FROM spans GROUP BY ALL",
    "vocabulary": f"WITH {_CSV} SELECT name, count(*) AS n, name <> 'juggling' AS known FROM spans GROUP BY name",
    "json_spans": f"""WITH {annotation._VID}, a AS (SELECT clip, class, "start" AS a, CASE WHEN segment_id % 23 = 0 THEN -5 ELSE "end" END AS z, max("end") OVER (PARTITION BY clip)::DOUBLE AS duration FROM vid)
SELECT clip, CASE WHEN clip % 2 = 0 THEN 'training' ELSE 'testing' END AS subset, duration, CASE WHEN class >= {CLASSES} THEN 'class out of range' WHEN z < a THEN 'end before start' END AS reject_reason, count(*) AS n, sum(a)::DOUBLE AS starts, sum(z)::DOUBLE AS ends FROM a GROUP BY ALL""",
    "pose_coverage": """WITH e AS (SELECT vec_id // 10 AS clip, vec_id % 10 >= vec_id // 10 % 8 AS present, vec_id, list_sum(list_transform(embedding[:39], lambda x: round(x::DOUBLE, 5))) AS total FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
g AS (SELECT *, sum(present::INT) OVER (PARTITION BY clip ORDER BY vec_id) AS i FROM e), h AS (SELECT clip, i, count(*) FILTER (WHERE NOT present) AS gap FROM g GROUP BY ALL), m AS (SELECT clip, max(gap) AS longest_gap FROM h GROUP BY clip)
SELECT clip, count(*) AS n, count(*) FILTER (WHERE present) AS detected, round(avg(present::INT), 6) AS coverage, any_value(longest_gap) AS longest_gap, avg(present::INT) >= 0.6 AS usable, CASE WHEN NOT bool_or(present) THEN 'nothing detected' WHEN avg(present::INT) < 0.6 THEN 'coverage too low' END AS reason,
  round(coalesce(sum(total) FILTER (WHERE present), 0), 5) AS total FROM e JOIN m USING (clip) GROUP BY clip""",
    "npz_archives": "SELECT vec_id, label::INT AS label, len(embedding)::INT AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, count(*) OVER () AS n_written FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL",
    "saved_logits": f"WITH {_VAL} SELECT y AS label, count(*) AS n, count(*) FILTER (WHERE list_position(joint, list_max(joint)) - 1 = y) AS n_right FROM val GROUP BY y",
    "byte_shards": """WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS b FROM documents), m AS (SELECT coalesce(max(b), 0) AS most FROM d WHERE b <= 100000),
s AS (SELECT doc_id, b, (coalesce(sum(b) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // (200000 - (SELECT most FROM m)))::BIGINT AS shard FROM d WHERE b <= 100000
  UNION ALL SELECT doc_id, b, -row_number() OVER (ORDER BY doc_id) FROM d WHERE b > 100000)
SELECT shard, count(*) AS n, sum(b)::BIGINT AS n_bytes, min(doc_id) AS first, max(doc_id) AS last FROM s GROUP BY shard""",
    "claim_audit": f"WITH j AS ({CLAIMS['verified_claims']}) SELECT arm, home_id, count(*) AS n, count(*) FILTER (WHERE faithful) AS n_faithful, count(injected) AS n_injected, max(day) AS last_day, (SELECT count(*) FROM j) AS in_manifest FROM j GROUP BY arm, home_id",
    "scanned_names": """WITH k AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'query' ELSE 'gallery/deep' END AS folder FROM supplier),
n AS (SELECT k, folder, CASE WHEN k % 11 = 0 THEN printf('0000_c%d_%04d.jpg', k % 6, k) WHEN k % 7 = 0 THEN printf('.%04d_c1_1.jpg', k) WHEN k % 5 = 0 THEN printf('%04d_c%d.txt', k, k % 6) WHEN k % 13 = 0 THEN printf('%04d-c1.png', k) ELSE printf('%04d_c%d_%04d.jpg', k, k % 6, k % 40) END AS name,
  CASE WHEN k % 11 = 0 THEN 'zero' WHEN k % 7 = 0 THEN 'hidden' WHEN k % 5 = 0 THEN 'not an image' WHEN k % 13 = 0 THEN 'not a crop''s name' END AS odd FROM k),
m AS (SELECT folder, count(DISTINCT CASE WHEN odd = 'zero' THEN 0 WHEN odd IS NULL THEN k END) <= 900 AS market FROM n GROUP BY folder),
f AS (SELECT *, odd IS NULL OR odd = 'zero' AND NOT market AS ok FROM n JOIN m USING (folder))
SELECT folder, name, CASE WHEN ok THEN CASE WHEN odd = 'zero' THEN '0000' ELSE printf('%04d', k) END END AS pid, CASE WHEN ok THEN 'c' || (k % 6) END AS camera, CASE WHEN ok THEN (CASE WHEN odd = 'zero' THEN k ELSE k % 40 END)::INT END AS frame,
  CASE WHEN NOT ok THEN CASE WHEN odd = 'zero' THEN 'reserved id' ELSE odd END END AS reject_reason FROM f""",
    "adapted_centroids": """WITH RECURSIVE v AS (SELECT label AS pid, list_transform(embedding, lambda x: x::DOUBLE) AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
u AS (SELECT pid, k, CASE WHEN k = 0 THEN x ELSE list_transform(x, lambda e: e / sqrt(list_dot_product(x, x))) END AS x FROM v),
s AS (SELECT pid, k, x AS c, 1::BIGINT AS n, 0::BIGINT AS refused FROM u WHERE k = 0
  UNION ALL SELECT pid, k, CASE WHEN near THEN list_transform(m, lambda e: e / sqrt(list_dot_product(m, m))) ELSE c END, n + near::INT, refused + 1 - near::INT FROM (
    SELECT s.pid, s.k + 1 AS k, s.c, s.n, s.refused, 1 - list_dot_product(s.c, u.x) / sqrt(list_dot_product(s.c, s.c)) < 0.72 AS near, list_transform(list_zip(s.c, u.x), lambda p: 0.9 * p[1] + 0.1 * p[2]) AS m
    FROM s JOIN u ON u.pid = s.pid AND u.k = s.k + 1))
SELECT pid, n AS n_updates, refused AS n_refused, round(c[1], 6) AS first, round(list_sum(c), 6) AS total FROM s QUALIFY row_number() OVER (PARTITION BY pid ORDER BY k DESC) = 1""",
    "checked_split": f"WITH {_VAL}, {_SUBJECTS} SELECT part, count(*) AS n_subjects, sum(n)::BIGINT AS n FROM p GROUP BY part",
    "partition_faults": f"""WITH {_VAL}, r AS (SELECT DISTINCT subject, CASE WHEN subject < 9 THEN 'train' ELSE 'validation' END AS part, CASE WHEN subject < 10 THEN 'train' ELSE 'validation' END AS official FROM val)
SELECT subject, 'marked ' || part || ', is ' || official AS fault FROM r WHERE part <> official
UNION ALL SELECT NULL, 'not all of ' || o.side FROM (SELECT 'train' AS side UNION ALL SELECT 'validation') AS o WHERE (SELECT count(*) FROM r) = 20 AND (SELECT count(*) FILTER (WHERE part = o.side AND official = o.side) FROM r) < 10
UNION ALL SELECT NULL, 'not all of ' || o.side FROM (SELECT 'train' AS side UNION ALL SELECT 'validation') AS o WHERE (SELECT count(*) FROM r) = 20 AND (SELECT count(*) FILTER (WHERE part = o.side AND official = o.side) FROM r) = 10 AND (SELECT count(*) FILTER (WHERE part = o.side) FROM r) > 10""",
    "counted_windows": """WITH o AS (SELECT user_id AS track_id, event_id // 40 AS frame_idx, bool_or(event_id % 4 <> 0) AS usable FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, lag(frame_idx) OVER (PARTITION BY track_id ORDER BY frame_idx) AS before FROM o),
r AS (SELECT *, sum((before IS NOT NULL AND frame_idx - before > 60)::INT) OVER (PARTITION BY track_id ORDER BY frame_idx) AS run FROM c),
u AS (SELECT *, row_number() OVER (PARTITION BY track_id, run ORDER BY frame_idx) - 1 AS n, count(*) OVER (PARTITION BY track_id, run) AS a FROM r WHERE usable),
w AS (SELECT track_id, run, k, min(frame_idx) AS start_frame FROM (SELECT *, unnest(range(0, (a - 6) // 3 + 1)) AS k FROM u WHERE a >= 6) WHERE n >= 3 * k AND n < 3 * k + 6 GROUP BY ALL)
SELECT (SELECT count(*) FROM w) AS n_rows, (SELECT coalesce(sum(start_frame), 0)::BIGINT FROM w) AS starts, count(*) FILTER (WHERE NOT usable) AS dropped_no_pose, (SELECT count(*) FROM u WHERE n = 0 AND a < 6) AS dropped_short_track,
  count(*) FILTER (WHERE before IS NOT NULL AND frame_idx - before > 60) AS gaps_broken, count(*) AS rows_seen, count(*) FILTER (WHERE before IS NULL) AS tracks_seen, (SELECT count(*) FROM w) AS windows_built FROM r""",
}
