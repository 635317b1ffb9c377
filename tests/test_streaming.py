"""The streaming path gives what the batch path gives."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayweave.operators.alerts import alerts
from dayweave.operators.baseline import with_baselines, with_drift, with_sustained
from dayweave.operators.decode import marginals, structured_prior
from dayweave.operators.features import daily_features
from dayweave.operators.tracks import tracked, windows
from dayweave.plans.behaviour import features
from dayweave.sources import domain
from dayweave.streaming import daily, decoding, tracking

SF = "/root/testdata/sf0.01"


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_scored_days_equal_batch(spark, tmp_path):
    f = features(spark, SF).filter("home_id < 3").withColumn("home_id", F.col("home_id").cast("long"))
    f.filter("day < '2024-01-16'").coalesce(1).write.parquet(str(tmp_path / "days/part=1"))
    f.filter("day >= '2024-01-16'").coalesce(1).write.parquet(str(tmp_path / "days/part=2"))
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "days"))
    got = {(r.home_id, r.day): r for r in drain(daily.score_days(stream), "scored").collect()}
    want = with_sustained(with_drift(with_baselines(f))).collect()
    assert len(got) == len(want) == 90 and not any(r.late for r in got.values())
    kept = lambda df: sorted((a.home_id, a.day, a.rule_name, a.severity, a.rule_expression, [(e.ref, round(e.robust_z, 6), round(e.delta, 6), e.baseline_n_days) for e in a.evidence]) for a in df.collect())
    raised = kept(alerts(spark.table("scored").filter("not late")))
    assert raised == kept(alerts(with_sustained(with_drift(with_baselines(f))))) and raised
    for w in want:
        g = got[(w.home_id, w.day)]
        assert g.n_days == w.n_days and g.declined == w.declined and (g.z is None) == (w.z is None)
        assert g.reported == pytest.approx(w.reported, abs=1e-9) and g.carried == pytest.approx(w.carried, abs=1e-9)
        if w.z is not None:
            assert g.z == pytest.approx(w.z, abs=1e-9)


def test_closed_days_equal_batch(spark, tmp_path):
    s = domain.segments(spark, SF).filter("home_id = 1 and day < '2024-01-12'").select(*[f.split()[0] for f in daily.SEGMENT.split(", ")])
    s = s.select(*[F.col(f.name).cast(f.dataType) for f in daily.T._parse_datatype_string(daily.SEGMENT).fields])
    for k, (a, b) in enumerate((("2024-01-01", "2024-01-05"), ("2024-01-04", "2024-01-09"), ("2024-01-09", "2024-01-12"))):  # the fourth comes twice
        s.filter(F.col("day").between(a, b) & (F.col("day") < b)).coalesce(1).write.parquet(str(tmp_path / f"seg/{k}"))
    stream = spark.readStream.schema(daily.SEGMENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "seg"))
    q = daily.write_daily_features(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    days = s.groupBy("home_id", "day").agg(F.count_distinct(F.floor(F.col("start_us") / 3_600_000_000)).cast("double").alias("observed_hours"), F.least(F.lit(1.0), F.count("*") / 20).alias("tracking_coverage"))
    want = daily_features(s, days)
    cols = [c for c in want.columns]
    a = {r.day: r for r in got.select(*cols).collect()}
    b = {r.day: r for r in want.select(*cols).collect()}
    assert len(a) >= 6 and all(all(a[d][c] == pytest.approx(b[d][c], abs=1e-6) if isinstance(b[d][c], float) else a[d][c] == b[d][c] for c in cols) for d in a)


def test_windows_equal_batch(spark, tmp_path):
    rows = [(t, i + (20 if i > 50 else 0), (i + t) % 4 != 0, "r", "resident") for t in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, "track_id long, frame_idx long, usable boolean, room string, role string")
    df.filter("frame_idx < 70").coalesce(1).write.parquet(str(tmp_path / "w/1"))
    df.filter("frame_idx >= 70").coalesce(1).write.parquet(str(tmp_path / "w/2"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "w"))
    got = sorted((r.track_id, r.start_frame, r.end_frame) for r in drain(tracking.window_stream(stream), "windows").collect())
    assert got == sorted((r.track_id, r.start_frame, r.end_frame) for r in windows(df, ["track_id"]).collect()) and got


def test_tracker_keeps_ids_over_triggers(spark, tmp_path):
    rows = [(0, i, 10.0 + 2 * i, 10.0, 50.0 + 2 * i, 90.0, 0.9) for i in range(20)] + [(0, i, 300.0, 10.0, 340.0, 90.0, 0.9) for i in range(20)]
    df = spark.createDataFrame(rows, "camera long, frame_idx long, x1 double, y1 double, x2 double, y2 double, confidence double")
    df.filter("frame_idx < 9").coalesce(1).write.parquet(str(tmp_path / "t/1"))
    df.filter("frame_idx >= 9").coalesce(1).write.parquet(str(tmp_path / "t/2"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "t"))
    with tracking.typed_state(spark):
        got = drain(tracking.track_stream(stream), "tracks").groupBy("track_id").count().collect()
    assert sorted((r.track_id, r["count"]) for r in got) == [(0, 20), (1, 20)]


def test_late_days_raise_no_alert(spark, tmp_path):
    f = features(spark, SF).filter("home_id = 1").withColumn("home_id", F.col("home_id").cast("long")).withColumn("fall_events", F.lit(1.0))
    f.filter("day >= '2024-01-16'").coalesce(1).write.parquet(str(tmp_path / "days/part=1"))
    f.filter("day < '2024-01-16'").coalesce(1).write.parquet(str(tmp_path / "days/part=2"))
    read = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    found = drain(daily.alert_stream(read.parquet(str(tmp_path / "days"))), "late_alerts")
    first = f.agg(F.min("day")).first()[0]
    days = {r.day for r in found.filter("kind = 'fall_detected'").collect()}
    assert days and (min(days).isoformat() >= "2024-01-16" or min(days) == first)


def test_lagged_labels_are_the_marginals_of_what_is_known(spark, tmp_path):
    rng, lag, n = np.random.default_rng(5), 3, 23
    steps = [*range(12), *range(20, 31)]  # a gap after the twelfth
    post = {t: rng.dirichlet(np.ones(20) * 0.3, n) for t in range(3)}
    df = spark.createDataFrame([(t, s, post[t][i].tolist()) for t in post for i, s in enumerate(steps)], "track_id long, step long, posterior array<double>")
    df.filter("step < 7").coalesce(1).write.parquet(str(tmp_path / "l/1"))
    df.filter("step >= 7").coalesce(1).write.parquet(str(tmp_path / "l/2"))
    prior = structured_prior(20)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "l"))
    got = {(r.track_id, r.step): r for r in drain(decoding.lagged_labels(stream, prior, lag), "lagged").collect()}
    move, start = np.log(np.maximum(prior, 1e-12)), np.full(20, -np.log(20))
    want = {}
    for t, p in post.items():
        e = np.log(np.maximum(p, 1e-12))
        for a, b in ((0, 12), (12, n)):
            for i in range(a, b if b == 12 else b - lag):  # the last windows are still held
                want[t, steps[i]] = marginals(e[a : min(b, i + lag + 1)], move, start)[i - a]
    assert set(got) == set(want)
    for k, m in want.items():
        assert got[k].state == m.argmax() and got[k].marginal == pytest.approx(m.max(), abs=1e-9)
        assert got[k].abstained == (m.max() < 0.4 and m.argmax() not in (7, 8)) and got[k].label == (19 if got[k].abstained else got[k].state)


def test_state_of_silent_tracks_expires(spark, tmp_path):
    prior = structured_prior(20)
    post = np.full(20, 0.02)
    post[3] = 0.62
    at = lambda t, s: (t, s, post.tolist(), datetime.datetime(2024, 1, 1, t) + datetime.timedelta(seconds=s))
    for k, rows in enumerate(([at(0, 0), at(0, 1)], [at(9, 0)], [at(9, 1)])):  # the second part moves the watermark past the first track
        spark.createDataFrame(rows, "track_id long, step long, posterior array<double>, event_time timestamp").coalesce(1).write.parquet(str(tmp_path / f"e/{k}"))
    schema = spark.read.parquet(str(tmp_path / "e/0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "e")).withWatermark("event_time", "1 minute")
    got = drain(decoding.lagged_labels(stream, prior, 3), "expired").collect()
    assert sorted((r.track_id, r.step, r.label) for r in got) == [(0, 0, 3), (0, 1, 3)]


BOXES = "camera long, frame_idx long, x1 double, y1 double, x2 double, y2 double, confidence double"


def walking(camera, frames, x=10.0):
    return [(camera, i, x + 2 * i, 10.0, x + 40 + 2 * i, 90.0, 0.9) for i in frames]


def test_tracks_of_the_stream_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for camera in range(3):
        for person in range(4):
            seen = [i for i in range(60) if rng.random() < 0.8 and not 20 + person <= i < 34]
            rows += [(camera, i, *(np.array([90.0 * person + i, 5.0, 90.0 * person + 50 + i, 90.0]) + rng.normal(0, 1.5, 4)).tolist(), float(rng.choice([0.2, 0.9]))) for i in seen]
    df = spark.createDataFrame(rows, BOXES)
    for k, (a, b) in enumerate(((0, 7), (7, 30), (30, 60))):
        df.filter(f"frame_idx >= {a} and frame_idx < {b}").coalesce(1).write.parquet(str(tmp_path / f"b/{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "b"))
    with tracking.typed_state(spark):
        got = drain(tracking.track_stream(stream), "batch_tracks")
    cols = [f.split()[0] for f in tracking.TRACKED_BOX.split(", ")]
    want = tracked(df, ["camera"]).select(*cols)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.collect())) and want.count() > 300


def test_state_of_silent_cameras_is_cleared_by_timers(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    timed = lambda rows, hour: [(*r, start + datetime.timedelta(hours=hour, seconds=r[1])) for r in rows]
    arrivals = [timed(walking(0, range(5)) + walking(1, range(5)), 0), timed(walking(1, range(5, 9)), 5), timed(walking(1, range(9, 12)), 5), timed(walking(0, range(20, 24)), 5) + timed(walking(1, range(12, 15)), 5)]
    stream_of = lambda n: spark.readStream.schema(f"{BOXES}, event_time timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "e")).withWatermark("event_time", "1 minute")
    def run(k, processor=None):
        spark.createDataFrame(arrivals[k], f"{BOXES}, event_time timestamp").coalesce(1).write.parquet(str(tmp_path / f"e/{k}"))
        with tracking.typed_state(spark):
            q = tracking.track_stream(stream_of(k)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination()
    held = lambda: sorted(r.key.camera for r in spark.read.format("statestore").option("stateVarName", "camera").load(str(tmp_path / "ck")).collect())
    run(0)
    assert held() == [0, 1]
    run(1)
    run(2)
    assert held() == [1]  # camera 0 was silent for five hours
    run(3)
    ids = {(r.camera, r.frame_idx): r.track_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {ids[1, i] for i in range(15)} == {0}  # one id over four runs
    assert ids[0, 0] == ids[0, 20] == 0 and held() == [0, 1]


class OtherTracker(tracking.CameraTracker):
    """As after a release: other attributes, more methods; the state's variables are the same."""

    def __init__(self, idle_ms, ttl_ms, settings):
        super().__init__(idle_ms, ttl_ms, settings)
        self.release = 2


def test_checkpoints_survive_a_changed_class(spark, tmp_path, monkeypatch):
    for k, frames in enumerate((range(6), range(6, 12))):
        spark.createDataFrame(walking(0, frames), BOXES).coalesce(1).write.parquet(str(tmp_path / f"c/{k}"))
        if k:
            monkeypatch.setattr(tracking, "CameraTracker", OtherTracker)
        stream = spark.readStream.schema(BOXES).option("recursiveFileLookup", "true").parquet(str(tmp_path / "c"))
        with tracking.typed_state(spark):
            q = tracking.track_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 12 and {r.track_id for r in rows} == {0} and sum(r.confirmed for r in rows) == 10
    with pytest.raises(ValueError):
        tracking.track_stream(stream.withColumn("event_time", F.current_timestamp()), ttl_ms=5)


def test_late_days_join_the_history(spark, tmp_path):
    f = features(spark, SF).filter("home_id < 4").withColumn("home_id", F.col("home_id").cast("long"))
    gone = (F.dayofmonth("day") + F.col("home_id")) % 3 == 0
    early = f.filter("day < '2024-01-20'")
    for k, part in enumerate((early.filter(~gone), early.filter(gone), early.filter(gone).filter("home_id = 2"), f.filter("day >= '2024-01-20'"))):  # the third comes again
        part.coalesce(1).write.parquet(str(tmp_path / f"days/{k}"))
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "days"))
    q = daily.write_scored(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    late = spark.read.parquet(str(tmp_path / "out/late")).collect()
    n = early.filter(gone).count() + early.filter(gone).filter("home_id = 2").count()
    first = {r.home_id: r[1] for r in early.filter(~gone).groupBy("home_id").agg(F.max("day")).collect()}
    assert len(late) == n - sum(r.day > first[r.home_id] for r in early.filter(gone).collect()) and all(set(r.reported) == {0.0} for r in late)
    want = {(r.home_id, r.day): r for r in with_baselines(f).collect()}
    got = spark.read.parquet(str(tmp_path / "out/scored")).filter("day >= '2024-01-20'").collect()
    assert len(got) == f.filter("day >= '2024-01-20'").count() > 0
    for r in got:
        w = want[r.home_id, r.day]
        assert r.n_days == w.n_days and (r.z is None) == (w.z is None) and (r.z is None or r.z == pytest.approx(w.z, abs=1e-9))
