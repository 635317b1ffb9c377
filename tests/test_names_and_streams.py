"""Strict names, a clip's own fall range, derived streams, augmentation, scenario roll-ups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayweave.functions import skeleton as S
from dayweave.operators import labels as L
from dayweave.operators.identity import negative_control
from dayweave.operators.reports import scenario_rollup
from dayweave.sources.shards import augmented


def test_names_are_taken_strictly(spark):
    names = ["P11T15C01", " P02T03C04\n", "xP11T15C01", "P1T15C01", "P11T15C01.mp4", "", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(L.strict_video_id(F.col("n")).alias("v")).collect()
    assert [tuple(r.v) if r.v else None for r in got] == [(11, 15, 1), (2, 3, 4), None, None, None, None, None]
    names = ["Cook.Cut_p03_r00_v02_c03.mp4", "x/Walk_p25_r12_v15_c06_pose3d.json", "Walk_p25_r12_15_c06_LCRNet2d.npz", "Walk_p25_r12_v15_c06_", "Walk_p5_r12_v15_c06", "Walk_p25_r12_v15_c06.doc", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(L.trimmed_name(F.col("n")).alias("v")).collect()
    assert [tuple(r.v) if r.v else None for r in got] == [("Cook.Cut", 3, 0, "v02", 3, None), ("Walk", 25, 12, "v15", 6, "pose3d"), ("Walk", 25, 12, "15", 6, "LCRNet2d"), None, None, None, None]


def test_fall_ranges_of_texts(spark):
    texts = ["5\n9\n1 2 3", "\n\n 5.0 \r\n\r\n9.7\n", "0\n0", "-1\n0", "9\n5", "5", "a\nb", "", None, "0\n12"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(L.fall_range(F.col("t")).alias("r")).collect()
    assert [tuple(r.r) if r.r else None for r in got] == [(5, 9), (5, 9), (0, 0), (0, 0), None, None, None, None, None, (0, 12)]
    clips = spark.createDataFrame([("a/v.avi",), ("a/b/v.avi",), ("v.avi",), ("c/w.avi",)], "path string")
    files = spark.createDataFrame([("a/v.txt", "1\n2"), ("a/Annotation_files/v.txt", "3\n4"), ("Annotation_files/v.txt", "5\n6"), ("w.txt", "bad")], "path string, text string")
    got = {r.path: tuple(r.fall) if r.fall else None for r in L.with_own_range(clips, files).collect()}
    assert got == {"a/v.avi": (3, 4), "a/b/v.avi": (3, 4), "v.avi": (5, 6), "c/w.avi": None}


def arrays_of(spark, x, expr):
    return np.array(spark.createDataFrame([(x.tolist(),)], "f array<array<array<double>>>").select(expr(F.col("f")).alias("o")).first().o)


def test_streams_and_midpoints(spark):
    x = np.random.default_rng(2).normal(size=(5, 4, 3))
    parents = [0, 0, 1, 1]
    bone = x - x[:, parents]
    step = lambda y: np.concatenate([y[1:] - y[:-1], np.zeros_like(y[:1])])
    want = {"joint": x, "bone": bone, "joint_motion": step(x), "bone_motion": step(bone)}
    for name in S.STREAMS:
        assert np.allclose(arrays_of(spark, x, lambda f, n=name: S.stream(f, n, parents)), want[name])
    with pytest.raises(ValueError):
        S.stream(F.col("f"), "velocity", parents)
    got = arrays_of(spark, x, lambda f: S.with_midpoints(f, ((0, 1), (2, 3)), 4))
    assert np.allclose(got, np.concatenate([x, (x[:, :1] + x[:, 1:2]) / 2, (x[:, 2:3] + x[:, 3:]) / 2], axis=1))
    with pytest.raises(Exception, match="expected 13 joints"):
        arrays_of(spark, x, lambda f: S.with_midpoints(f, ((0, 1),), 13))
    p = np.random.default_rng(3).normal(size=(6, 2, 17, 3))  # frames, persons, joints, channels
    row = spark.createDataFrame([(p.tolist(),)], "p array<array<array<array<double>>>>").select(S.channels_first(F.col("p")).alias("o")).first()
    assert np.allclose(np.array(row.o), p.transpose(3, 0, 2, 1))


def test_augmentation_mirrors_and_drops_whole_joints(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0.2, 1, (8, 17, 3)).astype(np.float32)
    x[:, 3] = 0  # never seen
    df = spark.createDataFrame([(k, x.ravel().tolist()) for k in range(60)], "k long, s array<float>")
    still = dict(rotate=0.0, scale=0.0, shift=0.0, noise=0.0)
    mirrored = x[:, list(S.MIRROR)] * np.array([-1, 1, 1], np.float32)
    kinds = {"same": 0, "mirrored": 0}
    for r in df.select("k", augmented(F.col("s"), F.col("k"), drop=0.0, **still).alias("v")).collect():
        v = np.array(r.v).reshape(x.shape)
        kinds["mirrored" if np.allclose(v, mirrored, atol=1e-6) else "same"] += 1
        assert np.allclose(v, mirrored, atol=1e-6) or np.allclose(v, x, atol=1e-6)
    assert min(kinds.values()) > 15
    dropped = 0
    for r in df.select("k", augmented(F.col("s"), F.col("k"), drop=0.2, flip=0.0).alias("v")).collect():
        v = np.array(r.v).reshape(x.shape)
        gone = (v == 0).all((0, 2))
        assert gone[3] and np.allclose(v[:, ~gone, 2], x[:, ~gone, 2])
        dropped += int(gone.sum()) - 1
    assert 100 < dropped < 300


def test_scenario_rollups(spark):
    rows = [("a", False, 3, 9, 10), ("a", False, None, 9, 10), ("a", True, None, 2, 40), ("b", False, 5, 1, 10), ("c", True, None, 0, 0)]
    got = {r.persona: r for r in scenario_rollup(spark.createDataFrame(rows, "persona string, is_control boolean, latency_days int, n_relative long, n_days long"), "persona").collect()}
    assert (got["a"].recall, got["a"].median_latency, got["a"].control_false_per_100_days) == (0.5, 3, 5.0)
    assert (got["b"].recall, got["b"].median_latency, got["b"].control_false_per_100_days, got["b"].n_controls) == (1.0, 5, 0.0, 0)
    assert (got["c"].recall, got["c"].median_latency, got["c"].control_false_per_100_days) == (0.0, None, 0.0)


def test_the_control_keeps_lengths_and_loses_identity(spark):
    df = spark.createDataFrame([(i, [float(x) for x in range(8)]) for i in range(50)], "frame long, vector array<double>")
    turned = [r.vector for r in negative_control(df).collect()]
    assert all(sorted(v) == list(map(float, range(8))) for v in turned) and len({tuple(v) for v in turned}) == 8


# ---- association and slots, by plain loops ---------------------------------------------------------------------


def plain_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def plain_tracks(frames, low=0.10, high=0.35, least=0.3, hits=3, coast=10, ages=(30, 300)):
    """frames: frame index to a list of (box, confidence); a list of (frame, box, id, confirmed)."""
    tracks, made, out = [], 0, []
    for f in range(min(frames), max(frames) + 1):
        boxes = sorted(frames.get(f, []))
        given = [None] * len(boxes)
        for t in tracks:
            t["age"] += 1
        for t in sorted(tracks, key=lambda t: (t["hits"] < hits, t["age"], -t["hits"])):
            best, score = None, least
            for i, (box, sure) in enumerate(boxes):
                if given[i] is not None or sure < low:
                    continue
                k = max(1, min(t["age"], coast))
                ahead = [t["box"][j] + t["v"][j % 2] * k for j in range(4)]
                s = max(plain_iou(t["box"], box), plain_iou(ahead, box))
                if s > score:
                    best, score = i, s
            if best is not None:
                box = boxes[best][0]
                t["v"] = [((box[j] + box[j + 2]) - (t["box"][j] + t["box"][j + 2])) / 2 / max(1, t["age"]) for j in range(2)]
                t.update(box=box, hits=t["hits"] + 1, age=0)
                given[best] = t["id"]
        for i, (box, sure) in enumerate(boxes):
            if given[i] is None and sure >= high:
                tracks.append({"id": made, "box": box, "v": [0.0, 0.0], "hits": 1, "age": 0})
                given[i] = made
                made += 1
        tracks = [t for t in tracks if t["age"] <= ages[t["hits"] >= hits]]
        sure_ids = {t["id"] for t in tracks if t["age"] == 0 and t["hits"] >= hits}
        out += [(f, box, given[i], given[i] in sure_ids) for i, (box, _) in enumerate(boxes) if given[i] is not None]
    return out


def test_tracks_equal_a_plain_loop(spark):
    from dayweave.operators.tracks import tracked

    rng = np.random.default_rng(12)
    clips = {}
    for clip in range(4):
        frames = {}
        for person in range(3):
            speed = rng.normal(0, 3)
            for f in range(80):
                if rng.random() < 0.75 and not 30 + 5 * person <= f < 48:
                    x = 120.0 * person + speed * f
                    box = np.round(np.array([x, 20.0, x + 60, 160.0]) + rng.normal(0, 2, 4), 3)
                    frames.setdefault(f, []).append((tuple(box.tolist()), float(rng.choice([0.05, 0.2, 0.8]))))
        clips[clip] = frames
    rows = [(c, f, *box, sure) for c in clips for f in clips[c] for box, sure in clips[c][f]]
    df = spark.createDataFrame(rows, "clip long, frame_idx long, x1 double, y1 double, x2 double, y2 double, confidence double").repartition(3)
    got = sorted((r.clip, r.frame_idx, (r.x1, r.y1, r.x2, r.y2), r.track_id, r.confirmed) for r in tracked(df, ["clip"]).collect())
    want = sorted((c, f, box, i, sure) for c in clips for f, box, i, sure in plain_tracks(clips[c]))
    assert got == want and len({(c, i) for c, _, _, i, _ in got}) > 12


def test_slots_equal_a_plain_loop(spark):
    from dayweave.operators.tracks import slots

    rng = np.random.default_rng(7)
    rows = [(c, f, round(float(rng.uniform(1, 9)), 3), float(rng.choice([10, 60, 200]) + rng.normal(0, 2)), float(rng.normal(50, 3)), float(rng.choice([2.0, 12.0]))) for c in range(3) for f in range(40) for _ in range(rng.integers(0, 4))]
    kind = "clip long, frame_idx long, area double, cx double, cy double, diagonal double"
    got = sorted((r.clip, r.frame_idx, r.area, r.slot) for r in slots(spark.createDataFrame(rows, kind).repartition(4), ["clip"]).collect())
    want = []
    for c in range(3):
        held = {}
        for f in sorted({r[1] for r in rows if r[0] == c}):
            boxes = sorted((r for r in rows if r[:2] == (c, f)), key=lambda r: (-r[2], r[3], r[4]))[:2]
            pairs = sorted((np.hypot(b[3] - held[s][0], b[4] - held[s][1]), i, s) for i, b in enumerate(boxes) for s in held)
            slot = {}
            for d, i, s in pairs:
                if d <= 3 * boxes[i][5] and i not in slot and s not in slot.values():
                    slot[i] = s
            for i in range(len(boxes)):
                if i not in slot:
                    free = [s for s in (0, 1) if s not in slot.values()]
                    slot[i] = min(free, key=lambda s: (s in held, s))
            held = {slot[i]: (b[3], b[4]) for i, b in enumerate(boxes)}
            want += [(c, f, b[2], slot[i]) for i, b in enumerate(boxes)]
    assert got == sorted(want) and {g[3] for g in got} == {0, 1}
