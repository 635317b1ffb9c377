"""Annotation spans: interval joins, window labels, unions, cross-checks, vocabulary maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.sources.shared import staged

#: Buckets that a row of an interval join is dealt to at most.
MOST_BUCKETS = 256
#: Spans of both sources that one task compares, about.
SPANS = 250_000


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], bucket: float) -> DataFrame:
    """Rows of left and right that share keys and overlap (strictly), as an equi-join on time buckets.

    Both sides are dealt to the buckets they touch; a pair is kept in the bucket where its overlap begins, so it appears once. Choose a
    bucket near the longer side's usual length. A row over MOST_BUCKETS long, as a bad end time makes it, is not dealt out but stands
    in one bucket for long rows, where each row of the other side also stands once: exact, and no row becomes more than MOST_BUCKETS + 2.
    Columns other than keys must differ.
    """
    place = lambda c: F.floor(F.col(c) / bucket).cast("long")
    wide = lambda s: place(s[1]) - place(s[0]) >= MOST_BUCKETS
    long_left, long_right = F.lit(-(1 << 62)), F.lit(-(1 << 62) + 1)
    dealt = lambda s: F.sequence(place(s[0]), place(s[1]))
    a = left.filter(F.col(l[1]) > F.col(l[0])).withColumn("_b", F.explode(F.when(wide(l), F.array(long_left)).otherwise(F.concat(dealt(l), F.array(long_right)))))
    b = right.filter(F.col(r[1]) > F.col(r[0])).withColumn("_b", F.explode(F.when(wide(r), F.array(long_left, long_right)).otherwise(F.concat(dealt(r), F.array(long_left)))))
    j = a.join(b, [*keys, "_b"]).filter((F.col(l[0]) < F.col(r[1])) & (F.col(r[0]) < F.col(l[1])))
    return j.filter((F.col("_b") <= long_right) | (F.col("_b") == F.floor(F.greatest(F.col(l[0]), F.col(r[0])) / bucket))).drop("_b")


def mapped(rows: DataFrame, label_map: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose label the map (on, class, drop) knows and does not drop."""
    return rows.join(label_map, on, "inner").filter(~F.col("drop")).drop("drop")


def best_covering(windows: DataFrame, actions: DataFrame, label_map: DataFrame, key: str, least: float, default: str, bucket: float) -> DataFrame:
    """windows (key, window_id, w_start, w_end) with class: of the mapped actions covering at least `least`, the one covering most, the
    first (by action_id) of equals; windows won by a dropped label go, windows won by none get the default."""
    known = actions.join(label_map, "label", "inner")
    j = interval_join(windows, known, [key], ("w_start", "w_end"), ("a_start", "a_end"), bucket)
    cover = F.least("w_end", "a_end") - F.greatest("w_start", "a_start")
    best = j.withColumn("cover", cover).filter(F.col("cover") >= least).groupBy(key, "window_id").agg(F.max_by(F.struct("class", "drop"), F.struct(F.col("cover").alias("c"), (-F.col("action_id")).alias("o"))).alias("b"))
    out = windows.join(best, [key, "window_id"], "left").filter(F.col("b").isNull() | ~F.col("b.drop"))
    return out.withColumn("class", F.coalesce("b.class", F.lit(default))).drop("b")


def fall_windows(windows: DataFrame, falls: DataFrame, key: str, length: int) -> DataFrame:
    """windows (key, start) with label. With a fall range (lo, hi) of the clip: 7 where they overlap, 8 after, 1 before, 19 if the range is
    (0, 0). Without: by the place of the window's middle among the clip's, 7 in the middle (always for the nearest), 8 after, 1 before."""
    j = windows.join(falls, key, "left")
    w = Window.partitionBy(key)
    first, last = F.min("start").over(w), F.max("start").over(w)
    share = (F.col("start") - first) / F.greatest(last - first, F.lit(1e-9))
    j = j.withColumn("_f", share)
    order = F.row_number().over(w.orderBy(F.abs(F.col("_f") - 0.5), "start"))
    placed = F.when((order == 1) | ((F.col("_f") >= 0.4) & (F.col("_f") < 0.6)), 7).when(F.col("_f") >= 0.6, 8).otherwise(1)
    ranged = F.when((F.col("lo") <= 0) & (F.col("hi") <= 0), 19).when((F.col("start") + length - 1 >= F.col("lo")) & (F.col("start") <= F.col("hi")), 7).when(F.col("start") > F.col("hi"), 8).otherwise(1)
    return j.withColumn("label", F.when(F.col("lo").isNotNull(), ranged).otherwise(placed)).drop("_f", "lo", "hi")


def step_labels(spans: DataFrame, videos: DataFrame, key: str, n_steps: str = "n_steps", closed: bool = False) -> DataFrame:
    """key, step, class: the steps at step * duration / n_steps that lie within a span; strictly, or bounds included if closed.

    The first and last step of a span follow from its bounds, so spans are expanded directly and nothing is compared.
    """
    j = spans.join(videos.select(key, "duration", n_steps), key)
    scale = F.col("duration") / F.col(n_steps)
    guess_lo, guess_hi = F.floor(F.col("start") / scale).cast("long"), F.ceil(F.col("end") / scale).cast("long")
    inside = lambda i: (i * scale >= F.col("start")) & (i * scale <= F.col("end")) if closed else (i * scale > F.col("start")) & (i * scale < F.col("end"))
    steps = F.filter(F.sequence(F.greatest(F.lit(0).cast("long"), guess_lo), F.least(F.col(n_steps) - 1, guess_hi).cast("long")), inside)
    some = j.filter(F.greatest(F.lit(0).cast("long"), guess_lo) <= F.least(F.col(n_steps) - 1, guess_hi))
    return some.select(key, F.explode(steps).alias("step"), "class").distinct()


def annotated_windows(steps: DataFrame, windows: DataFrame, key: str, length: int) -> DataFrame:
    """windows (key, start) with class: at least half of the steps annotated, and one class (the lowest of equals) on half of them.

    Windows are never dealt out by step: a stretch of `length` steps is met by the windows that start in it and in the one before, so each
    step stands in two stretches and each window in one. Both sides are shuffled and merged, as the planner's estimate of exploded
    windows is that of the few rows they come from, and a broadcast by it would hold them all in the driver.
    """
    own = Window.partitionBy(key, "step").orderBy("class")
    s = steps.select(key, "step", "class", (F.row_number().over(own) == 1).alias("_own"))  # one row a step counts it as seen
    at = F.floor(F.col("step") / length)
    s = s.withColumn("_at", F.explode(F.array(at, at - 1)))
    w = windows.select(key, F.col("start"), F.floor(F.col("start") / length).alias("_at"))
    met = w.hint("merge").join(s, [key, "_at"]).filter(F.col("step").between(F.col("start"), F.col("start") + length - 1))
    each = met.groupBy(key, "start", "class").agg(F.count("*").alias("n"), F.count_if("_own").alias("seen"))
    top = each.groupBy(key, "start").agg(F.max_by("class", F.struct("n", (-F.col("class")).alias("c"))).alias("class"), F.max("n").alias("n"), F.sum("seen").alias("seen"))
    return top.filter((F.col("seen") >= 0.5 * length) & (F.col("n") >= 0.5 * length)).select(key, "start", "class")


def union_length(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, covered: length of the union of spans."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(before, F.col(start))))
    return spans.withColumn("_l", own).groupBy(*keys).agg(F.sum("_l").alias("covered"))


def class_frames(spans: DataFrame) -> DataFrame:
    """class, frames, instances, share and the imbalance to the largest class."""
    c = spans.groupBy("class").agg(F.sum(F.col("end") - F.col("start")).alias("frames"), F.count("*").alias("instances"))
    every = Window.partitionBy()  # one row per class
    return c.withColumn("share", F.col("frames") / F.sum("frames").over(every)).withColumn("imbalance", F.max("frames").over(every) / F.greatest("frames", F.lit(1)))


def cross_check(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row per video of either source (key, class, start, end): which have it, spans that only one has."""
    packed = lambda df, name: df.groupBy(key).agg(F.collect_set(F.struct("class", "start", "end")).alias(name))
    j = packed(a, "_a").join(packed(b, "_b"), key, "full")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<struct<class: long, start: long, end: long>>"))
    return j.select(key, F.col("_a").isNotNull().alias("in_a"), F.col("_b").isNotNull().alias("in_b"), F.size(F.array_except(empty("_a"), empty("_b"))).alias("only_a"), F.size(F.array_except(empty("_b"), empty("_a"))).alias("only_b"))


def to_coarse(steps: DataFrame, fine_map: DataFrame, keys: list[str]) -> DataFrame:
    """Fine labels to coarse ones: a coarse class holds where any of its members does; a fine class without a map fails the job."""
    j = steps.join(fine_map, "class", "left")
    checked = F.when(F.col("coarse").isNull(), F.raise_error(F.concat(F.lit("no coarse class for "), F.col("class").cast("string"))).cast("int")).otherwise(F.col("coarse"))
    return j.select(*keys, checked.alias("coarse")).distinct()


# Patterns of activity descriptions in order, the first that fits decides; None drops the row.
KEYWORDS = (
    (r"\bsitting down\b|\bsitting in\b.*\bbed\b$", "sitting_down"),
    (r"\bstanding up\b|\bgetting up\b", "standing_up"),
    (r"\bfall|\bfalling\b|\btripping\b", "falling"),
    (r"\blying\b|\blaying\b|\bawakening\b|\bwaking\b|\basleep\b|\bnap\b", "lying_down"),
    (r"\bsitting\b|\bsit\b", "sitting"),
    (r"\bstanding\b(?! up)", "standing"),
    (r"\bwalk|\brunning\b|\bjogging\b", "walking"),
    (r"\breaching\b|\bbending\b|\bcrouching\b|\bkneeling\b|\bstretching\b", "bending_reaching"),
    (r"\beating\b|\bsnack|\bsandwich\b|\bmeal\b", "eating"),
    (r"\bdrink|\bpouring\b.*\b(glass|cup|water)\b|\bglass of\b", "drinking"),
    (r"\bcook|\bstove\b|\bfood\b.*\bprepar|\bkitchen\b.*\bprepar", "cooking_food_prep"),
    (r"\bmedicine\b|\bmedication\b|\bpill\b", "taking_medication"),
    (r"\btelevision\b|\btv\b|\bwatching something\b", "watching_tv"),
    (r"\bbook\b|\breading\b|\bmagazine\b|\bnotebook\b", "reading"),
    (r"\bphone\b|\btexting\b", "using_phone"),
    (r"\blaughing\b|\bsmiling\b|\btalking\b|\bhugging\b(?!.*\bpillow\b)", "interacting_with_person"),
    (r"\btidying\b|\bcleaning\b|\bwashing\b(?!.*\b(face|hands|themselves)\b)|\bvacuum|\bbroom\b|\blaundry\b|\bdishes\b|\bmopping\b|\bdusting\b|\bfixing\b", "cleaning_housework"),
    (r"\bgrooming\b|\bhair\b|\bteeth\b|\bbrushing\b|\btowel\b|\bwashing\b.*\b(face|hands|themselves)\b|\bdressing\b|\bundressing\b|\bshoes\b|\bclothes\b", "personal_hygiene"),
    (r"\bcamera\b|\btaking a picture\b|\bphotograph", None),
    (r"\bsneezing\b|\bcoughing\b", None),
)


def keyword_class(text: Column, rules=KEYWORDS, fallback: str = "other_idle") -> Column:
    """struct of class, dropped, rule (the pattern that decided; null for the fallback, which wants review)."""
    low, out = F.lower(text), F.struct(F.lit(fallback).alias("class"), F.lit(False).alias("dropped"), F.lit(None).cast("string").alias("rule"))
    for pattern, name in reversed(rules):
        out = F.when(low.rlike(pattern), F.struct(F.lit(name).cast("string").alias("class"), F.lit(name is None).alias("dropped"), F.lit(pattern).alias("rule"))).otherwise(out)
    return out


def video_id(text: Column) -> Column:
    """struct of subject, take, camera from a text that names exactly one P00T00C00; null for none or several."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(P\d{2}T\d{2}C\d{2})"), 1))
    part = lambda k: F.substring(F.get(found, 0), k, 2).cast("int")
    return F.when(F.size(found) == 1, F.struct(part(2).alias("subject"), part(5).alias("take"), part(8).alias("camera")))


def strict_video_id(text: Column) -> Column:
    """struct of subject, take, camera from a text that is one P00T00C00 and nothing else but white space around it; null for any other."""
    whole = F.trim(text)
    part = lambda k: F.substring(whole, k, 2).cast("int")
    return F.when(whole.rlike(r"^P\d{2}T\d{2}C\d{2}$"), F.struct(part(2).alias("subject"), part(5).alias("take"), part(8).alias("camera")))


TRIMMED = r"^([A-Za-z.]+)_p(\d{2})_r(\d{2})_([a-z]?\d{2})_c(\d{2})(?:_([A-Za-z0-9+.]+))?$"


def trimmed_name(name: Column) -> Column:
    """struct of activity, subject, take, view, camera, tag (null without one) from names of trimmed clips like Cook.Cut_p03_r00_v02_c03,
    whatever folder and however many known extensions; null for any other."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(\.(mp4|json|npz|npy|avi|png|jpg|csv|txt))+$", "")
    part = lambda k: F.regexp_extract(stem, TRIMMED, k)
    found = F.struct(part(1).alias("activity"), part(2).cast("int").alias("subject"), part(3).cast("int").alias("take"), part(4).alias("view"), part(5).cast("int").alias("camera"), F.nullif(part(6), F.lit("")).alias("tag"))
    return F.when(stem.rlike(TRIMMED), found)


def fall_range(text: Column) -> Column:
    """struct of lo and hi from a clip's own annotation, whose first two lines that aren't blank are the fall's first and last frame; (0, 0)
    says that there is none. Null where there is no text, fewer lines, no numbers, or the end comes before the start: not known, which is
    not the same as no fall, so such clips are to be left out."""
    head = F.slice(F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 2)
    lo, hi = (F.get(head, i).try_cast("double").cast("long") for i in (0, 1))
    nothing = F.struct(F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    return F.when(lo.isNull() | hi.isNull(), None).when((lo <= 0) & (hi <= 0), nothing).when(hi < lo, None).otherwise(F.struct(lo.alias("lo"), hi.alias("hi")))


def with_own_range(clips: DataFrame, texts: DataFrame) -> DataFrame:
    """clips (path) with fall (fall_range of the nearest annotation): texts (path, text) named like the clip, in its folder or the one
    above, or in a folder Annotation_files of either; the nearest wins. Without one, fall is null."""
    stem = lambda p: F.regexp_replace(F.regexp_extract(p, r"([^/]*)$", 1), r"\.[^.]*$", "")
    folder = lambda p: F.regexp_replace(p, r"/?[^/]*$", "")
    up = lambda p: F.when(p.contains("/"), folder(p)).otherwise(F.lit(""))
    inside = lambda p, name: F.when(p == "", F.lit(name)).otherwise(F.concat(p, F.lit(f"/{name}")))
    here = folder(F.col("path"))
    c = clips.withColumn("_stem", stem(F.col("path"))).withColumn("_places", F.array(inside(here, "Annotation_files"), here, inside(up(here), "Annotation_files"), up(here)))
    asked = c.select("path", "_stem", F.posexplode("_places").alias("_k", "_folder"))
    t = texts.select(stem(F.col("path")).alias("_stem"), folder(F.col("path")).alias("_folder"), F.col("text").alias("_text"))
    best = asked.join(t, ["_stem", "_folder"]).groupBy("path").agg(F.min_by("_text", "_k").alias("_text"))
    return clips.join(best, "path", "left").withColumn("fall", fall_range(F.col("_text"))).drop("_text")


def crop_name(name: Column, reserved: tuple[str, ...] = ()) -> Column:
    """struct of pid, camera, frame from names like 0043_c12_0033.jpg; null for other files, hidden ones and reserved ids."""
    ok = name.rlike(r"^[^.].*\.(jpg|jpeg|png)$") & name.rlike(r"^[^_]+_c[^_]*_")
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    frame = F.coalesce(F.get(parts, 2).try_cast("int"), F.lit(0))
    kept = ok & (F.size(parts) >= 3) & ~F.get(parts, 0).isin(*reserved) if reserved else ok & (F.size(parts) >= 3)
    return F.when(kept, F.struct(F.get(parts, 0).alias("pid"), F.get(parts, 1).alias("camera"), frame.alias("frame")))


def agreement(a: DataFrame, b: DataFrame, videos: DataFrame, key: str, n_classes: int, most_steps: int = 20_000, spans_a_task: int = SPANS) -> DataFrame:
    """Step-level agreement of two sources of spans (key, class, start, end): key, n_steps, cells_differing and agreement, a row for each
    video of videos (key, duration) that both sources have.

    A step stands at step * duration / n_steps, with n_steps the duration in whole frames, at most most_steps; a class holds at a step
    that lies within one of its spans, bounds included, and a cell is a step of a class. No step is expanded: each span becomes a rise at
    its first step and a fall after its last one, a running sum over the places where anything changes tells which source holds between
    two of them, and the stretches where only one does are added up. Rises and falls at one place are summed before they are ordered.
    Classes out of range and spans without a step count for nothing; spans that overlap, touch or repeat count once. Whole clips are dealt
    to as many tasks as hold about spans_a_task spans each, so there are more tasks, not larger ones, for more spans.
    """
    side = lambda spans, own: spans.select(key, "class", "start", "end", F.lit(own).alias("_a"), F.lit(1 - own).alias("_b"))
    spans = side(a, 1).unionByName(side(b, 0))
    both = spans.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"), F.count("*").alias("_spans")).filter("_a = 1 and _b = 1").select(key, "_spans")
    clips = staged(videos.select(key, "duration").join(both, key), "clips").withColumn("n_steps", F.least(F.greatest(F.floor("duration").cast("long"), F.lit(1)), F.lit(most_steps).cast("long")))
    size = F.col("duration") / F.col("n_steps")
    at = lambda step: step * size
    total, cores = clips.agg(F.sum("_spans")).first()[0] or 0, a.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-total // spans_a_task), min(cores, total // 1000))
    # A task holds its clips, which are short, and the spans pass by unsorted.
    j = spans.filter(F.col("class").between(0, n_classes - 1)).repartition(n, key).join(clips.drop("_spans").repartition(n, key).hint("shuffle_hash"), key)
    guess_lo, guess_hi = F.ceil(F.col("start") / size).cast("long"), F.floor(F.col("end") / size).cast("long")
    # Quotients may round across a bound; the products decide.
    lo = F.when(at(guess_lo - 1) >= F.col("start"), guess_lo - 1).when(at(guess_lo) < F.col("start"), guess_lo + 1).otherwise(guess_lo)
    hi = F.when(at(guess_hi + 1) <= F.col("end"), guess_hi + 1).when(at(guess_hi) > F.col("end"), guess_hi - 1).otherwise(guess_hi)
    j = j.select(key, "class", "_a", "_b", F.greatest(lo, F.lit(0).cast("long")).alias("lo"), F.least(hi, F.col("n_steps") - 1).alias("hi")).filter("lo <= hi")
    move = lambda place, by: F.struct(place.alias("place"), (F.col("_a") * by).alias("_a"), (F.col("_b") * by).alias("_b"))
    moves = j.select(key, "class", F.explode(F.array(move(F.col("lo"), 1), move(F.col("hi") + 1, -1))).alias("e")).select(key, "class", "e.*")
    moves = moves.groupBy(key, "class", "place").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    w = Window.partitionBy(key, "class").orderBy("place")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    apart = (F.sum("_a").over(so_far) > 0) != (F.sum("_b").over(so_far) > 0)
    stretch = moves.select(key, F.when(apart, F.lead("place").over(w) - F.col("place")).otherwise(0).alias("_n"))  # nothing holds after the last place
    differ = stretch.groupBy(key).agg(F.sum("_n").alias("_n"))
    out = clips.join(differ, key, "left").select(key, "n_steps", F.coalesce("_n", F.lit(0)).cast("long").alias("cells_differing"))
    return out.withColumn("agreement", 1 - F.col("cells_differing") / (F.col("n_steps") * n_classes))


def agreement_summary(videos: DataFrame, least: float = 0.999) -> DataFrame:
    """Of the rows of agreement: how many, their mean and least agreement, how many lie below least."""
    return videos.agg(F.count("*").alias("compared"), F.coalesce(F.avg("agreement"), F.lit(0.0)).alias("mean_agreement"), F.coalesce(F.min("agreement"), F.lit(0.0)).alias("least_agreement"), F.count_if(F.col("agreement") < least).alias("below"))
