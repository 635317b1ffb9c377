"""Person tracks: windows over usable poses, association, role votes, slots, chains of fragments."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dayweave.operators.counted import Counters

BOX = ("x1", "y1", "x2", "y2")
UNKNOWN = "unknown"
#: Distances that are the reach itself count as within it, in whatever order its factors round.
HAIR = 1e-9


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union; 0 unless the boxes overlap."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(w * h / (area(a) + area(b) - w * h))


def runs(rows: DataFrame, keys: list[str], order: str = "frame_idx", most_gap: int = 5) -> DataFrame:
    """rows with run: a new one where the step from the row before exceeds most_gap."""
    w = Window.partitionBy(*keys).orderBy(order)
    cut = F.when(F.col(order) - F.lag(order).over(w) > most_gap, 1).otherwise(0)
    return rows.withColumn("_c", cut).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def windows(rows: DataFrame, keys: list[str], length: int = 30, stride: int = 15, most_gap: int = 5, counters: Counters | None = None) -> DataFrame:
    """Windows of `length` usable rows, every `stride` of them, within runs: keys, run, k, start and end frame, role (the last row's),
    room (the most frequent, the first by name of equals), n_rows. Runs break on all rows, windows count usable ones only.

    With counters, the pass that builds the windows also counts what window_statistics counts by a scan of its own."""
    counted = counters.on if counters else lambda df, **_: df
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    steps = counted(
        runs(rows, keys, most_gap=most_gap).withColumn("_first", F.lag("frame_idx").over(w).isNull()).withColumn("_broken", F.col("frame_idx") - F.lag("frame_idx").over(w) > most_gap),
        rows_seen=F.count("*"), dropped_no_pose=F.count_if(~F.col("usable")), tracks_seen=F.count_if("_first"), gaps_broken=F.count_if("_broken"),
    )
    u = steps.filter("usable").drop("_first", "_broken")
    w = Window.partitionBy(*keys, "run").orderBy("frame_idx")
    u = u.withColumn("_n", F.row_number().over(w) - 1).withColumn("_all", F.count("*").over(Window.partitionBy(*keys, "run")))
    u = counted(u, dropped_short_track=F.count_if((F.col("_n") == 0) & (F.col("_all") < length)))
    last = F.least(F.floor(F.col("_n") / stride), F.floor((F.col("_all") - length) / stride))
    first = F.greatest(F.lit(0), F.floor((F.col("_n") - length) / stride) + 1)
    member = u.filter(F.col("_all") >= length).filter(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    room = F.mode(F.when(F.col("room") != "", F.col("room")), deterministic=True)
    out = member.groupBy(*keys, "run", "k").agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.max_by("role", "frame_idx").alias("role"), F.count("*").alias("n_rows"), room.alias("room"))
    return counted(out, windows_built=F.count("*"))


def window_statistics(rows: DataFrame, keys: list[str], length: int = 30, stride: int = 15, most_gap: int = 5) -> DataFrame:
    """One row of counts: frames, tracks, windows built, rows dropped without a pose, runs too short, gaps broken."""
    r = runs(rows, keys, most_gap=most_gap).groupBy(*keys, "run").agg(F.count("*").alias("n"), F.count_if("usable").alias("u"))
    built = F.when(F.col("u") >= length, F.floor((F.col("u") - length) / stride) + 1).otherwise(0)
    return r.groupBy().agg(F.sum("n").alias("rows_seen"), F.count_distinct(*keys).alias("tracks_seen"), F.sum(built).alias("windows_built"), F.sum(F.col("n") - F.col("u")).alias("dropped_no_pose"), F.count_if((F.col("u") > 0) & (F.col("u") < length)).alias("dropped_short_track"), F.count_if(F.col("run") > 0).alias("gaps_broken"))


def spans(rows: DataFrame, keys: list[str], track: str = "track_id") -> DataFrame:
    """First and last frame, first and last box, number of frames of every track."""
    box = F.struct(*BOX)
    return rows.groupBy(*keys, track).agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.min_by(box, "frame_idx").alias("first_box"), F.max_by(box, "frame_idx").alias("last_box"), F.count("*").alias("n_frames"))


def reachable(earlier: DataFrame, later: DataFrame, keys: list[str], fps: float, pace: float = 1.5, slack: float = 1.0) -> DataFrame:
    """Pairs (a, b) of tracks of one clip, a ending before b begins, that one walking person could be: distance in body heights."""
    a = earlier.select(*keys, F.col("track_id").alias("a"), F.col("last_frame").alias("_e"), F.col("last_box").alias("_p"))
    b = later.select(*keys, F.col("track_id").alias("b"), F.col("first_frame").alias("_s"), F.col("first_box").alias("_q"))
    gap = (F.col("_s") - F.col("_e")) / fps
    mid = lambda c, x, y: (F.col(c)[x] + F.col(c)[y]) / 2
    far = F.hypot(mid("_q", "x1", "x2") - mid("_p", "x1", "x2"), mid("_q", "y1", "y2") - mid("_p", "y1", "y2"))
    tall = F.greatest(F.lit(1.0), F.col("_p")["y2"] - F.col("_p")["y1"])
    return a.join(b, keys).filter((F.col("_e") < F.col("_s")) & (far <= (pace * gap + slack) * tall + HAIR)).select(*keys, "a", "b", gap.alias("gap_s"))


def heaviest_chain(track_spans: DataFrame, keys: list[str], fps: float, pace: float = 1.5, slack: float = 1.0) -> DataFrame:
    """keys, track_id: of each clip the tracks of the chain with most frames, each reachable from the one before.

    A clip's tracks are few; they are one group. Ties keep the chain that ends first.
    """
    kinds = ", ".join(f"`{k}` {t}" for k, t in track_spans.dtypes if k in [*keys, "track_id"])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["last_frame", "first_frame", "track_id"], kind="stable").reset_index(drop=True)
        first, last, weight = (pdf[c].to_numpy() for c in ("first_frame", "last_frame", "n_frames"))
        begin, end = (np.array([[b[k] for k in BOX] for b in pdf[c]], float) for c in ("first_box", "last_box"))
        centre = lambda b: np.stack([(b[:, 0] + b[:, 2]) / 2, (b[:, 1] + b[:, 3]) / 2], 1)
        tall = np.maximum(1.0, end[:, 3] - end[:, 1])
        total, back = weight.astype(float).copy(), np.full(len(pdf), -1)
        for i in range(len(pdf)):
            gap = (first[i] - last[:i]) / fps
            ok = (last[:i] < first[i]) & (np.hypot(*(centre(begin[i : i + 1]) - centre(end[:i])).T) <= (pace * gap + slack) * tall[:i] + HAIR)
            if ok.any():
                gain = np.where(ok, total[:i], -np.inf)
                j = int(gain.argmax())
                if gain[j] > 0:
                    total[i], back[i] = weight[i] + gain[j], j
        at, kept = int(total.argmax()), []
        while at >= 0:
            kept.append(at)
            at = back[at]
        return pdf.loc[sorted(kept), [*keys, "track_id"]]

    return track_spans.groupBy(*keys).applyInPandas(chain, kinds)


def assert_subject(segments: DataFrame, track_spans: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """segments with role resident for the asserted tracks of clips in which nobody was recognised, and provenance."""
    known = segments.groupBy(*keys).agg(F.max((F.col("role") == "resident").cast("int")).alias("_known"))
    cands = track_spans.join(segments.select(*keys, "track_id").distinct(), [*keys, "track_id"]).join(known.filter("_known = 0"), keys).drop("_known")
    chain = heaviest_chain(cands, keys, fps)
    long = chain.groupBy(*keys).agg(F.count("*").alias("_len"))
    most = cands.groupBy(*keys).agg(F.max_by("track_id", F.struct("n_frames", (-F.col("track_id")).alias("t"))).alias("track_id"))
    chosen = chain.join(long.filter("_len > 1"), keys).select(*keys, "track_id", F.lit("asserted_disjoint_track_chain").alias("_why")).unionByName(most.join(long.filter("_len <= 1"), keys).select(*keys, "track_id", F.lit("asserted_most_present_track").alias("_why")))
    why = chosen.groupBy(*keys).agg(F.first("_why").alias("provenance"))
    out = segments.join(chosen, [*keys, "track_id"], "left").withColumn("role", F.when(F.col("_why").isNotNull(), "resident").otherwise(F.col("role"))).drop("_why")
    return out.join(why, keys, "left").withColumn("provenance", F.coalesce("provenance", F.lit("reid_matched")))


# ---- recurrences: one clip or track in order of frames --------------------------------------------------------


class Vote:
    """A running vote with hysteresis: the leader of the last votes, if it has enough and, against an incumbent, a margin."""

    def __init__(self, window: int = 15, least: int = 5, margin: int = 3):
        self.window, self.least, self.margin = window, least, margin
        self.recent: list[str] = []
        self.role, self.sure = UNKNOWN, 0.0

    def take(self, observed: str) -> tuple[str, float]:
        """Role and confidence after one more vote."""
        self.recent = [*self.recent, observed][-self.window :]
        tally: dict[str, int] = {}
        for r in self.recent:
            if r != UNKNOWN:
                tally[r] = tally.get(r, 0) + 1
        best = max(tally.values(), default=0)
        if best < self.least:
            self.role, self.sure = UNKNOWN, 0.0
        else:
            leader = next(r for r in tally if tally[r] == best)
            if self.role in (UNKNOWN, leader) or best - tally.get(self.role, 0) >= self.margin:
                self.role, self.sure = leader, min(1.0, best / len(self.recent))
        return self.role, self.sure


def vote(observed: list[str], window: int = 15, least: int = 5, margin: int = 3) -> list[tuple[str, float]]:
    """Role and confidence after each vote."""
    running = Vote(window, least, margin)
    return [running.take(o) for o in observed]


def voted_roles(rows: DataFrame, keys: list[str], observed: str = "observed_role", window: int = 15, least: int = 5, margin: int = 3) -> DataFrame:
    """rows with role and role_confidence by windowed vote with hysteresis, per track in order of frames.

    Rows are sorted by track and frame; the votes of the last window and the role go along from batch to batch, so a track may last for ever.
    """
    cols = [c for c in rows.columns if c not in ("role", "role_confidence")]
    r = rows.select(*cols).withColumn(observed, F.coalesce(observed, F.lit(UNKNOWN)))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in r.schema) + ", role string, role_confidence double"
    at = [r.columns.index(k) for k in keys]
    what = r.columns.index(observed)

    def run(batches):
        track = running = None
        for rb in batches:
            found = []
            for *key, seen in zip(*(rb.column(i).to_pylist() for i in at), rb.column(what).to_pylist(), strict=True):
                if running is None or key != track:
                    track, running = key, Vote(window, least, margin)
                found.append(running.take(seen))
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*rb.schema.names, "role", "role_confidence"])

    return r.repartition(*keys).sortWithinPartitions(*keys, "frame_idx").mapInArrow(run, kind)


class Tracker:
    """Association of boxes frame by frame: weak boxes extend tracks, only strong ones start them; positions coast on the last velocity."""

    def __init__(self, low=0.10, high=0.35, least_iou=0.3, min_hits=3, coast=10, max_age=30, max_age_confirmed=300):
        self.low, self.high, self.least_iou, self.min_hits, self.coast, self.ages = low, high, least_iou, min_hits, coast, (max_age, max_age_confirmed)
        self.tracks: list[dict] = []
        self.next_id = 0

    def _pairs(self, wanted: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in wanted and boxes of all pairs that overlap from left to right: boxes are in order of x1, and of those that begin
        before the wanted one ends, those count that begin at most the widest box's width before it."""
        order = np.argsort(boxes[:, 0], kind="stable")
        x1 = boxes[order, 0]
        widest = max(float((boxes[:, 2] - boxes[:, 0]).max()), 0.0)
        # The subtraction may round: a hair more is looked at, the overlap itself decides.
        lo = np.searchsorted(x1, wanted[:, 0] - widest - 1e-6 * (np.abs(wanted[:, 0]) + widest), "left")
        n = np.maximum(np.searchsorted(x1, wanted[:, 2], "left") - lo, 0)
        a = np.repeat(np.arange(len(wanted)), n)
        return a, order[np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + lo[a]]

    @staticmethod
    def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of boxes row by row."""
        w = np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0])
        h = np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1])
        area = lambda b: (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        met = w * h
        return np.where((w <= 0) | (h <= 0), 0.0, met / np.maximum(area(a) + area(b) - met, 1e-12))

    def _scores(self, tracks: list[dict], boxes: np.ndarray) -> dict[int, list[tuple[float, int]]]:
        """Of each track (by place) the boxes that it overlaps enough, where it was or where it would be by now, the best first and the
        first of equals. Only boxes that overlap at all are compared."""
        was = np.array([t["box"] for t in tracks])
        ahead = was + np.tile(np.array([t["velocity"] for t in tracks]), 2) * np.array([max(1, min(t["age"], self.coast)) for t in tracks])[:, None]
        found = [(a, b, self._iou(w[a], boxes[b])) for w in (was, ahead) for a, b in (self._pairs(w, boxes),)]
        a, b, score = (np.concatenate(x) for x in zip(*found, strict=True))
        kept = score > self.least_iou
        a, b, score = a[kept], b[kept], score[kept]
        order = np.lexsort((b, -score, a))
        out: dict[int, list[tuple[float, int]]] = {}
        for i, s, j in zip(a[order].tolist(), score[order].tolist(), b[order].tolist(), strict=True):
            out.setdefault(i, []).append((s, j))
        return out

    def step(self, boxes: np.ndarray, confidence: np.ndarray) -> np.ndarray:
        """Track id of each box of the next frame, -1 for none; ids count although their track may not be confirmed yet."""
        out = np.full(len(boxes), -1)
        free = confidence >= self.low
        for t in self.tracks:
            t["age"] += 1
        if self.tracks and free.any():
            tracks = sorted(self.tracks, key=lambda t: (t["hits"] < self.min_hits, t["age"], -t["hits"]))
            usable = np.flatnonzero(free)
            near = self._scores(tracks, boxes[usable])
            taken, pairs = [False] * len(usable), []
            for i in range(len(tracks)):
                j = next((j for _, j in near.get(i, ()) if not taken[j]), None)
                if j is not None:
                    taken[j] = True
                    pairs.append((tracks[i], int(usable[j])))
            if pairs:
                met = boxes[[j for _, j in pairs]]
                was = np.array([t["box"] for t, _ in pairs])
                moved = (met[:, :2] + met[:, 2:] - was[:, :2] - was[:, 2:]) / 2 / np.array([max(1, t["age"]) for t, _ in pairs])[:, None]
                for k, (t, j) in enumerate(pairs):
                    t.update(velocity=moved[k], box=met[k], hits=t["hits"] + 1, age=0)
                    out[j], free[j] = t["id"], False
        for j in np.flatnonzero(free & (confidence >= self.high)):
            self.tracks.append({"id": self.next_id, "box": boxes[j], "velocity": np.zeros(2), "hits": 1, "age": 0})
            out[j] = self.next_id
            self.next_id += 1
        self.tracks = [t for t in self.tracks if t["age"] <= self.ages[t["hits"] >= self.min_hits]]
        return out

    def follow(self, frames: np.ndarray, boxes: np.ndarray, confidence: np.ndarray, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Track ids and whether confirmed of boxes in order of frames, after frame `last`; frames without boxes count towards ages."""
        ids, sure = np.full(len(frames), -1), np.zeros(len(frames), bool)
        cuts = [0, *(np.flatnonzero(np.diff(frames)) + 1).tolist(), len(frames)] if len(frames) else [0]
        none = np.zeros((0, 4)), np.zeros(0)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            frame = int(frames[lo])
            for _ in range(min(frame - last - 1, self.ages[1] + 1) if last is not None else 0):
                self.step(*none)
            last = frame
            ids[lo:hi] = self.step(boxes[lo:hi], confidence[lo:hi])
            confirmed = self.confirmed()
            sure[lo:hi] = [i in confirmed for i in ids[lo:hi].tolist()]
        return ids, sure

    def confirmed(self) -> set[int]:
        return {t["id"] for t in self.tracks if t["age"] == 0 and t["hits"] >= self.min_hits}


def tracked(detections: DataFrame, keys: list[str], **settings) -> DataFrame:
    """detections (keys, frame_idx, x1, y1, x2, y2, confidence) with track_id and confirmed; boxes of no track are dropped.

    One clip is a group, taken frame by frame; frames without boxes count towards ages by their index.
    """
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in detections.schema) + ", track_id long, confirmed boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["frame_idx", *BOX], kind="stable")
        ids, sure = Tracker(**settings).follow(rows["frame_idx"].to_numpy(), rows[list(BOX)].to_numpy(float), rows["confidence"].to_numpy(float))
        return rows.assign(track_id=ids, confirmed=sure)[ids >= 0]

    return detections.groupBy(*keys).applyInPandas(run, kind)


def slots(detections: DataFrame, keys: list[str], n_slots: int = 2) -> DataFrame:
    """detections (keys, frame_idx, area, cx, cy, diagonal) with slot: the nearest slot of the frame before within three diagonals,
    otherwise an empty slot, larger boxes first; more boxes than slots are dropped. One clip is a group."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in detections.schema) + ", slot int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, np.ndarray] = {}
        parts = []
        for _, part in pdf.groupby("frame_idx", sort=True):
            part = part.sort_values(["area", "cx", "cy"], ascending=[False, True, True], kind="stable").head(n_slots)
            at = part[["cx", "cy"]].to_numpy(float)
            reach = 3 * np.maximum(part["diagonal"].to_numpy(float), 1e-6)
            near = sorted((float(np.hypot(*(at[i] - p))), i, s) for s, p in held.items() for i in range(len(at)))
            given: dict[int, int] = {}
            for d, i, s in near:
                if d <= reach[i] and i not in given and s not in given.values():
                    given[i] = s
            rest = sorted(set(range(n_slots)) - set(given.values()), key=lambda s: (s in held, s))
            for i in range(len(at)):
                if i not in given and rest:
                    given[i] = rest.pop(0)
            held = {s: at[i] for i, s in given.items()}
            parts.append(part.assign(slot=[given[i] for i in range(len(at))]))
        return pd.concat(parts)

    return detections.groupBy(*keys).applyInPandas(run, kind)


def adapted_centroids(observations: DataFrame, gallery: DataFrame, momentum: float = 0.9, threshold: float = 0.35, comfortable: float = 0.6) -> DataFrame:
    """gallery (pid, centroid, n_updates) after folding in the observations (pid, order, vector) of each identity, in order, with n_refused.

    Each observation is held against the centroid as it then is: only a comfortable match, at less than `comfortable` of the matching
    threshold in cosine distance, moves it (momentum of the old, the rest of the new, normalised); others are refused, as they would let
    a gallery drift onto another person. The fold needs an identity's rows in order, so they are sorted by one task; it holds one centroid
    and one Arrow batch at a time, however many there are. Observations of unknown identities and null vectors are left out; of equal
    orders the smaller vector comes first. One row an identity of the gallery.
    """
    kind = gallery.schema["pid"].dataType.simpleString()
    out = f"pid {kind}, centroid array<double>, n_updates long, n_refused long"
    first = gallery.select("pid", F.lit(0).alias("_step"), F.lit(None).cast(observations.schema["order"].dataType).alias("order"), F.col("centroid").cast("array<double>").alias("v"), F.col("n_updates").cast("long").alias("n"))
    rest = observations.filter("vector is not null").select("pid", F.lit(1).alias("_step"), "order", F.col("vector").cast("array<double>").alias("v"), F.lit(0).cast("long").alias("n"))
    rows = first.unionByName(rest).repartition("pid").sortWithinPartitions("pid", "_step", "order", "v").select("pid", "_step", "v", "n")

    pid_type = to_arrow_type(gallery.schema["pid"].dataType)

    def unit(x: np.ndarray) -> np.ndarray:
        size = np.sqrt((x * x).sum())
        return x if size < 1e-9 else x / size

    def fold(batches):
        pid = centroid = None
        n = refused = 0
        for rb in batches:
            found = []
            for who, step, v, before in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), (x.values for x in rb.column(2)), rb.column(3).to_pylist(), strict=True):
                x = v.to_numpy(zero_copy_only=False)
                if step == 0:
                    if centroid is not None:
                        found.append((pid, centroid, n, refused))
                    pid, centroid, n, refused = who, x, before, 0
                elif centroid is not None and who == pid:
                    x = unit(x)
                    size = np.sqrt((centroid * centroid).sum())
                    if 1 - float(centroid @ x) / max(size, 1e-12) < comfortable * threshold:
                        centroid, n = unit(momentum * centroid + (1 - momentum) * x), n + 1
                    else:
                        refused += 1
            if found:
                yield _identities(found, pid_type)
        if centroid is not None:
            yield _identities([(pid, centroid, n, refused)], pid_type)

    return rows.mapInArrow(fold, out)


def _identities(found: list[tuple], pid_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"pid": pa.array([f[0] for f in found], pid_type), "centroid": [f[1].tolist() for f in found], "n_updates": [f[2] for f in found], "n_refused": [f[3] for f in found]})


def embedding_due(rows: DataFrame, keys: list[str], votes: int = 5, every: int = 15) -> DataFrame:
    """rows with due: whether an embedding is computed on this confirmed row (until enough votes, then every so often)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("frame_idx"))
    return rows.withColumn("_n", n).withColumn("due", (F.col("_n") <= votes) | ((F.col("_n") - votes) % every == 0)).drop("_n")


def enrolment_candidates(rows: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """The best rows of each track by mean keypoint score times the root of the box area."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    r = rows.withColumn("quality", F.col("mean_score") * F.sqrt(F.greatest(area, F.lit(0.0))))
    return r.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("quality"), "frame_idx"))).filter(F.col("_n") <= most).drop("_n")


def sampled(value: Column, fps: float, hz: float = 1.0, order: str = "frame_idx") -> Column:
    """value on the frames that a schedule of hz looks at (every round(fps / hz) of them, at least each), null on the others; carried()
    holds a sample until the next one."""
    return F.when(F.col(order) % max(1, round(fps / hz)) == 0, value)


def carried(rows: DataFrame, keys: list[str], value: str, order: str = "frame_idx") -> DataFrame:
    """rows with value filled from the last row that had one: a sample is held until the next."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))
