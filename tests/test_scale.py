"""What grows with the tables: windows that no broadcast holds, galleries met in one pass, trackers over many boxes."""

import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from dayweave.operators import labels as L
from dayweave.operators.identity import nearest_two
from dayweave.operators import tracks as T
from dayweave.operators.features import seconds
from dayweave.operators.tracks import Tracker


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_annotated_windows_are_merged_and_right(spark):
    rng = random.Random(3)
    steps = {(c, rng.randrange(60), rng.randrange(3)) for c in range(4) for _ in range(70)}
    for length, stride in ((4, 2), (5, 1), (3, 4), (1, 1)):
        w = spark.range(4).select(F.col("id").alias("clip"), F.explode(F.sequence(F.lit(-3).cast("long"), F.lit(62).cast("long"), F.lit(stride).cast("long"))).alias("start"))
        got = L.annotated_windows(spark.createDataFrame(sorted(steps), "clip long, step long, class long"), w, "clip", length)
        want = set()
        for c in range(4):
            for start in range(-3, 63, stride):
                inside = [(s, k) for d, s, k in steps if d == c and start <= s < start + length]
                counts = Counter(k for _, k in inside)
                best = max(counts, key=lambda k: (counts[k], -k), default=None)
                if best is not None and len({s for s, _ in inside}) >= length / 2 and counts[best] >= length / 2:
                    want.add((c, start, best))
        assert {tuple(r) for r in got.collect()} == want
        assert "BroadcastHashJoin" not in plan_of(got)


def test_galleries_pass_by_without_writing_probes(spark):
    rng = random.Random(5)
    unit = lambda v: [x / math.hypot(*v) for x in v]
    gallery = [(i, unit([rng.gauss(0, 1) for _ in range(4)])) for i in range(60)]
    gallery += [(i + 100, v) for i, v in gallery[:30]]  # copies: ties go to the smaller id
    probes = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(900)]
    g = spark.createDataFrame(gallery, "pid long, centroid array<double>")
    p = spark.createDataFrame(probes, "frame long, vector array<double>")
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    for chunk_bytes, block_bytes in ((2000, 1), (1 << 20, 200), (1 << 25, 1 << 25)):
        got = {r.frame: r for r in nearest_two(p, g, block_bytes=block_bytes, chunk_bytes=chunk_bytes).collect()}
        for k, v in probes:
            d = sorted((1 - sum(a * b for a, b in zip(unit(v), c)), i) for i, c in gallery)
            best, second = (x for x in d[:2])
            assert abs(got[k].best - best[0]) < 1e-12 and abs(got[k].gap - (second[0] - best[0])) < 1e-12
            assert got[k].who == min(i for x, i in d if x - best[0] < 1e-12)
    assert len(set(os.listdir(folder)) - before) == 3  # the gallery of each call
    odd = spark.createDataFrame([(0, None), (1, [1.0, 0.0]), (2, [1.0, None, 0.0, 0.0]), (3, [float("nan"), 0.0, 0.0, 0.0]), (4, [0.0] * 4)], "frame long, vector array<double>")
    got = {r.frame: r for r in nearest_two(odd, g).collect()}
    assert all(got[k].best is None and got[k].who == 0 for k in range(3)) and math.isnan(got[3].best) and got[4].best == 1 and got[4].who == 0


def test_profiles_rank_distances_by_ranges(spark):
    from dayweave.operators import identity as I

    rng = random.Random(6)
    rows = [(part, float(rng.choice([rng.random(), 0.25])), rng.random() < 0.5) for part, n in (("genuine", 501), ("impostor", 700), ("one", 1), (None, 4)) for _ in range(n)]
    rows += [("impostor", None, None)] * 30 + [("none", None, False)] * 2 + [("odd", x, True) for x in (0.5, 0.25, math.nan)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    d = spark.createDataFrame(rows, "part string, best double, correct boolean").repartition(3)
    df = I.profile(d.mapInArrow(count, d.schema))
    got = {r.part: r for r in df.collect()}
    assert seen.value == len(rows)  # pairs are met once
    assert "percentile" not in plan_of(df)  # which holds all distances of a part in one task
    want = {r.part: r for r in d.groupBy("part").agg(F.count("*").alias("n"), F.avg("best").alias("mean"), F.percentile("best", F.array(*map(F.lit, (0.05, 0.5, 0.95)))).alias("q")).collect()}
    assert got.keys() == want.keys()
    for part, w in want.items():
        g = got[part]
        assert g.n == w.n and repr([g.p05, g.median, g.p95]) == repr(w.q or [None] * 3) and (g.mean == w.mean or abs(g.mean - w.mean) < 1e-12 or math.isnan(w.mean))


def test_single_precision_decides_no_distance(spark, monkeypatch):
    from dayweave.operators import identity as I

    # Centroids closer to each other than single precision tells apart; long ones and one that it cannot hold.
    rng = np.random.default_rng(4)
    base, v = rng.normal(size=(8, 16)), rng.normal(size=(300, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = np.concatenate([base + k * 1e-8 * rng.normal(size=base.shape) for k in range(40)])
    unit = v / np.sqrt(I._summed(v, v))[:, None]
    for scale, kinds in ((1.0, {"float32"}), (1e6, {"float32"}), (1e200, {"float64"})):
        seen, block = set(), I._Chunk._block
        monkeypatch.setattr(I._Chunk, "_block", lambda self, mine, found, *a: (seen.add(str(found.dtype)), block(self, mine, found, *a)))
        for wide in (7, 2048):
            monkeypatch.setattr(I, "WIDE", wide)
            chunk = I._Chunk()
            column = lambda x: pa.array(list(x), pa.list_(pa.float64()))
            chunk.take(pa.array([{"frame": i} for i in range(len(v))]), column(v))
            chunk.meet(pa.array(range(len(near))), column(near * scale), lambda width: 100)
            d = np.stack([1 - I._summed(unit, np.broadcast_to(g, unit.shape)) for g in near * scale], 1)
            order = np.argsort(d, axis=1, kind="stable")[:, :2]
            assert (chunk.who == order).all() and (chunk.d == np.take_along_axis(d, order, 1)).all()
        monkeypatch.undo()
        assert seen == kinds


def test_trackers_compare_only_boxes_that_may_overlap():
    x = np.arange(2000) * 100.0
    boxes = np.stack([x, x * 0, x + 40, x * 0 + 80], 1)
    t = Tracker()
    assert t.step(boxes, np.full(2000, 0.9)).tolist() == list(range(2000))
    met = t._pairs(boxes, boxes + 0.5)
    assert len(met[0]) <= 2 * len(boxes) and set(zip(*map(list, met), strict=True)) >= {(i, i) for i in range(2000)}
    assert t.step((boxes + 0.5)[::-1], np.full(2000, 0.9)).tolist() == list(range(2000))[::-1]


def test_fragments_at_the_reach_itself_are_within_it(spark):
    # Eleven frames at 15 a second and a pace of 1.5 reach 2.1 heights: 168 for a box 80 tall.
    box = "struct<x1: double, y1: double, x2: double, y2: double>"
    rows = [(1, t, a, z, (x, 50.0, x + 40, 130.0), (x, 50.0, x + 40, 130.0), n) for t, a, z, x, n in ((0, 0, 39, 0.0, 40), (1, 50, 89, 168.0, 40), (2, 50, 89, 168.5, 41))]
    f = spark.createDataFrame(rows, f"clip long, track_id long, first_frame long, last_frame long, first_box {box}, last_box {box}, n_frames long")
    assert {(r.a, r.b) for r in T.reachable(f, f, ["clip"], 15.0).collect()} == {(0, 1)}
    assert {r.track_id for r in T.heaviest_chain(f, ["clip"], 15.0).collect()} == {0, 1}


def test_durations_add_up_alike_in_any_order(spark):
    rng = random.Random(2)
    d = [round(rng.uniform(1, 600), 2) for _ in range(3000)]
    sums = [spark.createDataFrame([(x,) for x in order], "d double").coalesce(1).agg(seconds(F.col("d")).alias("s")).first().s for order in (d, sorted(d), sorted(d, reverse=True))]
    assert sums == [sum(round(x * 100) for x in d) / 100] * 3


def test_sql_of_long_ids_and_half_centiseconds():
    from dayweave.plans.annotation import ORACLES as A
    from dayweave.plans.corpus import ORACLES as C

    assert "greatest(4, length(clip::VARCHAR))" in A["parsed_names"]
    for name in ("track_timeline", "segment_wire"):
        assert "+ 5000) // 10000) / 100" in C[name] and "/ 1000000, 2)" not in C[name]


def test_agreement_deals_clips_to_tasks_by_their_spans(spark):
    rows = [(c, c % 3, float(s), s + 3.0) for c in range(40) for s in range(0, 100, 4)]
    a, b = (spark.createDataFrame(r, "clip long, class int, start double, end double") for r in (rows, rows[: len(rows) // 2]))
    videos = spark.createDataFrame([(c, 100.0) for c in range(50)], "clip long, duration double")
    whole = L.agreement(a, b, videos, "clip", 3)
    dealt = L.agreement(a, b, videos, "clip", 3, spans_a_task=50)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, dealt.collect())) == [(c, 100, 0, 1.0) for c in range(20)]
    plan = plan_of(dealt)
    assert "REPARTITION_BY_NUM" in plan and "ShuffledHashJoin" in plan
    # 1,000 spans of clips that both have, 50 a task.
    assert "hashpartitioning(clip" in plan and ", 20), REPARTITION_BY_NUM" in plan


def test_tracks_of_long_histories_are_followed_to_their_end(spark, tmp_path):
    import duckdb

    from dayweave.plans.streams import ORACLES, QUERIES

    events = {1: 450, 51: 330, 101: 2, 2: 321, 52: 7}  # frames run up to 559
    at = "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id as int))"
    rows = spark.createDataFrame([(u, i) for u, n in events.items() for i in range(n)], "user_id long, id long")
    rows.selectExpr("user_id * 1000 + id as event_id", f"{at} as ts", "user_id", "'view' as event_type", "1.5 as value", """'{"k": 3}' as props""").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r.camera, r.n, r.n_confirmed, r.n_tracks) for r in QUERIES["streaming_tracks"](spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(duck.execute(f"SELECT camera, n, n_confirmed, n_tracks FROM ({ORACLES['streaming_tracks']})").fetchall())
    assert got == [(1, 782, 776, 3), (2, 328, 324, 2)]
