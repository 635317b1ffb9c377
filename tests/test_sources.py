"""Files as sources and sinks, keyed state, positions over all rows, and the checks around splits."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayweave.operators.counted import Counters
from dayweave.operators.order import placed
from dayweave.operators.splits import DegenerateSplit, Leak, checked, partition_faults, subject_split
from dayweave.operators.tracks import adapted_centroids, window_statistics, windows
from dayweave.sources import annotations, arrays, listing, records
from dayweave.sources.sinks import byte_shards, write_byte_shards
from dayweave.sources.state import ConcurrentWrite, KeyedTable

# ---- keyed state -------------------------------------------------------------------------------------------------


def test_keyed_table_merges_batches_once(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["id"], "seq", 4)
    rows = lambda *r: spark.createDataFrame(list(r), "id long, value string, seq long")
    with pytest.raises(ValueError):
        t.read()
    assert t.merge(rows(*[(i, "a", 1) for i in range(40)], (None, "null", 1)), 0)
    before = {p.name for p in (tmp_path / "t/data").iterdir()}
    assert t.merge(rows((3, "b", 2), (3, "late", 0), (4, "same", 1), (5, "older", 0), (99, "new", 1)), 1)
    assert not t.merge(rows((3, "again", 9)), 1) and not t.merge(rows((3, "again", 9)), 0)
    assert t.merge(rows((3, "other writer", 3)), 0, "other")
    got = {r.id: r.value for r in t.read().collect()}
    assert got == {**{i: "a" for i in range(40)}, None: "null", 3: "other writer", 4: "same", 99: "new"}
    assert {r.id: r.value for r in t.read(0).collect()} == {**{i: "a" for i in range(40)}, None: "null"}
    assert before <= {p.name for p in (tmp_path / "t/data").iterdir()}
    places = [json.loads((tmp_path / f"t/versions/{v:012d}.json").read_text())["places"] for v in (1, 2)]
    assert sum(places[0][b] != places[1][b] for b in places[0]) == 1  # one key, one bucket
    with pytest.raises(ValueError):
        t.read(7)
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "t"), ["id"], "seq", 8).merge(rows((1, "x", 5)), 9)
    assert t.merge(rows().limit(0), 5) and t.read().count() == 42


def test_keyed_table_takes_new_columns_and_survives_failures(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path / "t"), ["a", "b"], "seq", 2)
    t.merge(spark.createDataFrame([(1, "x", 1)], "a long, b string, seq long"), 0)
    with monkeypatch.context() as m:
        m.setattr(t, "_publish", lambda manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            t.merge(spark.createDataFrame([(1, "x", 2)], "a long, b string, seq long"), 1)
    assert [r.seq for r in t.read().collect()] == [1]
    assert t.merge(spark.createDataFrame([(1, "y", 2, 0.5)], "a long, b string, seq long, extra double"), 1)
    assert sorted((r.b, r.seq, r.extra) for r in t.read().collect()) == [("x", 1, None), ("y", 2, 0.5)]
    with pytest.raises(ConcurrentWrite):
        t._publish(t._manifest())
    assert t.vacuum(1) >= 1 and t.versions() == [1]
    assert sorted(r.b for r in t.read().collect()) == ["x", "y"]


def test_keyed_table_as_a_sink(spark, tmp_path):
    schema = "id long, value string, seq long"
    for k, rows in enumerate(([(1, "a", 1), (2, "a", 1)], [(2, "b", 2), (3, "b", 1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    t = KeyedTable(spark, str(tmp_path / "t"), ["id"], "seq", 2)
    for _ in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = t.sink(stream, str(tmp_path / "ck"))
        q.processAllAvailable()
        q.stop()
    assert {r.id: r.value for r in t.read().collect()} == {1: "a", 2: "b", 3: "b"} and len(t.versions()) == 2


# ---- archives ----------------------------------------------------------------------------------------------------


def test_archives_are_read_by_ranges_of_rows(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(1000, 5, 3)).astype(np.float16)
    y = np.arange(1000) % 20
    np.savez(tmp_path / "one.npz", skeletons=x, labels=y, subjects=np.array([f"s{i}é" for i in range(1000)]), flags=y > 3, raw=np.array([b"ab", b"c"] * 500))
    np.savez_compressed(tmp_path / "two.npz", skeletons=x[:100], labels=y[:100])
    (tmp_path / "notes.txt").write_text("not an archive")
    df = arrays.arrays(spark, str(tmp_path), ["skeletons", "labels", "subjects", "flags", "raw"], part_bytes=5000)
    assert df.rdd.getNumPartitions() > 8
    rows = {(r.archive, r.row): r for r in df.collect()}
    assert len(rows) == 1100
    for name, n in (("one.npz", 1000), ("two.npz", 100)):
        for i in (0, 1, 63, n - 1):
            r = rows[name, i]
            assert np.array_equal(np.array(r.skeletons, np.float16), x[i].ravel()) and r.skeletons_shape == [5, 3] and r.labels == i % 20
    assert rows["one.npz", 7].subjects == "s7é" and rows["one.npz", 7].flags is True and rows["one.npz", 7].raw == "c" and rows["two.npz", 7].subjects is None
    assert arrays.arrays(spark, str(tmp_path / "two.npz"), ["labels"]).count() == 100
    np.savez(tmp_path / "three.npz", skeletons=x, labels=y[:5])
    with pytest.raises(Exception, match="differ in length"):
        arrays.arrays(spark, str(tmp_path), ["skeletons", "labels"]).count()


def test_written_archives_come_back(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"), F.array(F.col("id") * 0.5, F.lit(1.0)).alias("v")).repartition(3)
    for compressed in (False, True):
        at = str(tmp_path / f"c{compressed}")
        m = arrays.write_archives(df, at, ["k", "name", "v"], compressed, rows=128).collect()
        assert sum(r.n_rows for r in m) == 1000 and max(r.n_rows for r in m) == 128 and all(os.path.getsize(f"{at}/{r.file}") == r.n_bytes for r in m)
        back = arrays.arrays(spark, at, ["k", "name", "v"], part_bytes=1500)
        assert sorted((r.k, r.name, r.v) for r in back.collect()) == [(i, f"n{i}", [i * 0.5, 1.0]) for i in range(1000)]
    with pytest.raises(Exception, match="arrays of one length"):
        arrays.write_archives(spark.sql("SELECT array(1.0D) v UNION ALL SELECT array(1.0D, 2.0D)").coalesce(1), str(tmp_path / "bad"), ["v"]).collect()
    at = str(tmp_path / "logits")
    arrays.write_archives(spark.sql("SELECT array(0.1D, 0.9D) logits, 1 labels"), at, ["logits", "labels"]).collect()
    assert [(r.logits, r.label) for r in arrays.saved_logits(spark, at).collect()] == [([0.1, 0.9], 1)]


# ---- names -------------------------------------------------------------------------------------------------------


def test_names_are_listed_and_parsed(spark, tmp_path):
    for name in ("train/0001_c2_0007.jpg", "train/0000_c1_1.jpg", "train/-1_c1_1.jpg", "train/.0002_c1_1.jpg", "train/a.txt", "train/0003_x1_1.png", "train/0004_c1_x.png", "test/deep/er/0005_c1_1.jpeg", "P01T02C03.mp4", "P01T02C03_P09T02C03.mp4"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"xy")
    found = listing.names(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 3
    assert {(r.folder, r.name, r.bytes) for r in found.collect()} == {(os.path.dirname(n), os.path.basename(n), 2) for n in ("train/0001_c2_0007.jpg", "train/0000_c1_1.jpg", "train/-1_c1_1.jpg", "train/.0002_c1_1.jpg", "train/a.txt", "train/0003_x1_1.png", "train/0004_c1_x.png", "test/deep/er/0005_c1_1.jpeg", "P01T02C03.mp4", "P01T02C03_P09T02C03.mp4")}
    crops = {r.name: r for r in listing.crops(found.filter("folder <> ''")).collect()}
    assert {n: r.reject_reason for n, r in crops.items()} == {
        "0001_c2_0007.jpg": None, "0000_c1_1.jpg": "reserved id", "-1_c1_1.jpg": "reserved id", ".0002_c1_1.jpg": "hidden", "a.txt": "not an image", "0003_x1_1.png": "not a crop's name", "0004_c1_x.png": None, "0005_c1_1.jpeg": None,
    }
    assert (crops["0001_c2_0007.jpg"].pid, crops["0001_c2_0007.jpg"].camera, crops["0001_c2_0007.jpg"].frame) == ("0001", "c2", 7) and crops["0004_c1_x.png"].frame == 0
    other = listing.crops(found.filter("name = '0000_c1_1.jpg'"), F.lit("msmt")).collect()
    assert [(r.pid, r.reject_reason) for r in other] == [("0000", None)]
    v = {r.name: (r.subject, r.take, r.camera, r.reject_reason) for r in listing.videos(found.filter("folder = ''")).collect()}
    assert v == {"P01T02C03.mp4": (1, 2, 3, None), "P01T02C03_P09T02C03.mp4": (None, None, None, "no single id in the name")}
    many = spark.range(1000).select(F.lit("big").alias("folder"), F.format_string("%04d_c1_1.jpg", "id").alias("name"), F.lit(0).cast("long").alias("bytes"))
    assert listing.crops(many).filter("reject_reason is null").count() == 1000  # so many ids are of the layout where 0000 is a person
    assert listing.names(spark, str(tmp_path / "nowhere")).count() == 0


def test_text_sources(spark, tmp_path):
    (tmp_path / "split.txt").write_text("P02T01C07\n\nclip_P03T02C01.mp4\nno id here\n")
    got = [(r.name, r.subject, r.take, r.camera, r.reject_reason) for r in annotations.split_names(spark, str(tmp_path / "split.txt")).collect()]
    assert got == [("P02T01C07", 2, 1, 7, None), ("clip_P03T02C01.mp4", 3, 2, 1, None), ("no id here", None, None, None, "no single id in the name")]
    (tmp_path / "map.csv").write_text("id,subject\nA1,s1\n,s2\nB2,s3\n")
    assert sorted(map(tuple, annotations.subject_map(spark, str(tmp_path / "map.csv")).collect())) == [("A1", "s1"), ("B2", "s3")]
    (tmp_path / "bad.csv").write_text("id,name\nA1,s1\n")
    (tmp_path / "empty.csv").write_text("id,subject\n")
    for name in ("bad.csv", "empty.csv"):
        with pytest.raises(ValueError):
            annotations.subject_map(spark, str(tmp_path / name))
    (tmp_path / "classes.txt").write_text("c093 Walking through a doorway \nsomething else\nc001 Holding some clothes\n")
    assert sorted(map(tuple, annotations.class_lines(spark, str(tmp_path / "classes.txt")).collect())) == [("c001", "Holding some clothes"), ("c093", "Walking through a doorway")]
    (tmp_path / "labels.csv").write_text("label,class,drop\nwalk,walking,\nphoto,,yes\nodd,nowhere,no\n")
    m = {r.label: (r["class"], r.drop, r.reject_reason) for r in annotations.label_map(spark, str(tmp_path / "labels.csv"), ("walking", "eating")).collect()}
    assert m == {"walk": ("walking", False, None), "photo": (None, True, None), "odd": ("nowhere", False, "unknown class")}
    g = spark.createDataFrame([(json.dumps({"residents": [{"name": "a", "role": "resident", "centroid": [1.0, 0.0]}, {"name": "", "role": "carer", "centroid": [1.0]}, {"name": "b", "role": "cat", "centroid": [1.0]}, {"name": "c", "role": "carer", "centroid": []}]}),)], "payload string")
    read = annotations.gallery_from_json(g)
    assert [(r.name, r.reject_reason) for r in read.collect()] == [("a", None), ("", "no name"), ("b", "unknown role"), ("c", "no centroid")]
    back = annotations.gallery_from_json(annotations.gallery_to_json(read.filter("reject_reason is null")))
    assert [(r.name, r.role, r.centroid, r.reject_reason) for r in back.collect()] == [("a", "resident", [1.0, 0.0], None)]
    spans = spark.createDataFrame([("walk", "f1", 3, None), ("walk", "f0", 3, "end before start"), ("jog", "f2", None, "fewer than three fields"), ("99", "f1", 99, "class out of range")], "name string, file string, class int, reject_reason string")
    assert sorted((r.name, r.n, r.example, r.known) for r in annotations.vocabulary(spans).collect()) == [("99", 1, "f1", False), ("jog", 1, "f2", False), ("walk", 2, "f0", True)]


# ---- lines -------------------------------------------------------------------------------------------------------


def test_lines_and_their_manifest(spark, tmp_path):
    at = str(tmp_path / "out")
    df = spark.range(50).select("id", F.when(F.col("id") % 2 == 0, "é\n\"x\"").alias("t"), F.lit("2024-01-02").cast("date").alias("day")).repartition(4)
    records.write_jsonl(df, at)
    lines = [json.loads(x) for f in os.listdir(at) if f.endswith(".jsonl") for x in open(f"{at}/{f}", encoding="utf-8")]
    assert sorted((x["id"], x["t"], x["day"]) for x in lines) == [(i, "é\n\"x\"" if i % 2 == 0 else None, "2024-01-02") for i in range(50)]
    assert records.manifest(spark, at).agg(F.sum("n_rows")).first()[0] == 50 and sum(r.n_bytes for r in records.manifest(spark, at).collect()) == sum(os.path.getsize(f"{at}/{f}") for f in os.listdir(at) if f.endswith(".jsonl"))
    broken = df.select(F.when(F.col("id") == 49, F.raise_error(F.lit("broken row")).cast("long")).otherwise(F.col("id")).alias("id"), "t", "day")
    before = sorted(os.listdir(at))
    with pytest.raises(Exception, match="broken row"):
        records.write_jsonl(broken, at)
    assert sorted(os.listdir(at)) == before  # a failed job leaves nothing
    records.write_jsonl(df.filter("id < 5"), at)
    assert records.read_jsonl(spark, at, "id long, t string, day date").count() == 55
    records.write_jsonl(df.filter("id < 3"), at, "overwrite")
    assert sorted(r.id for r in records.read_jsonl(spark, at, "id long, t string, day date").collect()) == [0, 1, 2]
    assert records.manifest(spark, at).agg(F.sum("n_rows")).first()[0] == 3


def test_markdown(spark):
    df = spark.createDataFrame([("a|b", 1, 0.12345), (None, None, None)], "name string, n long, share double")
    assert records.markdown(df) == "| name | n | share |\n| --- | ---: | ---: |\n| a\\|b | 1 | 0.123 |\n| n/a | n/a | n/a |\n"
    with pytest.raises(ValueError):
        records.markdown(spark.range(101))


# ---- positions, shards, splits, counters -----------------------------------------------------------------------


def test_places_over_all_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("w")).repartition(7)
    rows = sorted(placed(df, F.col("k"), sizes={"before": F.col("w"), "half": F.col("w") / 2}).collect(), key=lambda r: r.k)
    total = 0
    for i, r in enumerate(rows):
        assert r.place == i and r.before == total == 2 * r.half
        total += r.w
    assert placed(df.limit(0), F.col("k")).count() == 0
    ties = spark.range(300).select(F.lit(1).alias("k"))
    assert sorted(r.place for r in placed(ties, F.col("k")).collect()) == list(range(300))


def test_shards_keep_to_the_budget(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 400)) if i % 97 else 900 if i % 2 else 1500) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, size long").repartition(5)
    found = [sorted((r.shard, r.id) for r in byte_shards(df.repartition(n), 1000, F.col("size"), F.col("id")).collect()) for n in (2, 9)]
    assert found[0] == found[1]  # reruns give equal shards
    size, held = dict(rows), {}
    for shard, i in found[0]:
        held.setdefault(shard, []).append(i)
    assert sorted(i for ids in held.values() for i in ids) == list(range(2000))
    for shard, ids in held.items():
        assert sum(size[i] for i in ids) <= 1000 or len(ids) == 1
    usual = [s for s in held if s >= 0]
    assert np.mean([sum(size[i] for i in held[s]) for s in usual]) > 500
    write_byte_shards(df, str(tmp_path / "s"), 1000, F.col("size"), F.col("id"))
    assert all(len([f for f in os.listdir(tmp_path / f"s/shard={s}") if f.endswith(".parquet")]) == 1 for s in held)


def test_splits_that_leak_or_are_empty_fail(spark):
    rows = spark.range(400).select((F.col("id") % 40).alias("subject"))
    s = subject_split(rows)
    assert s.count() == 40 and s.filter("part = 'validation'").count() == 8 and s.agg(F.sum("n")).first()[0] == 400
    joined = rows.join(s.select("subject", "part"), "subject")
    assert checked(joined) is joined
    with pytest.raises(DegenerateSplit, match="validation"):
        checked(joined.filter("part = 'train'"))
    with pytest.raises(Leak, match="3 subjects"):
        checked(joined.unionByName(joined.filter("part = 'train'").select("subject").distinct().limit(3).withColumn("part", F.lit("validation"))))
    assert subject_split(spark.createDataFrame([(1,)], "subject long")).first().part == "validation"
    official = {"train": (1, 2), "validation": (3, 4)}
    rows_of = lambda *r: spark.createDataFrame(list(r), "subject long, part string")
    faults = lambda *r: sorted((x.subject or 0, x.fault) for x in partition_faults(rows_of(*r), official).collect())
    right = [(1, "train"), (2, "train"), (3, "validation"), (4, "validation")]
    assert faults(*right) == [] and faults(*right[:3]) == [] and faults((9, "train"), *right) == []
    assert faults((1, "validation")) == [(1, "marked validation, is train")]
    assert faults((1, "validation"), *right[1:]) == [(0, "not all of train"), (0, "not all of validation"), (1, "marked validation, is train")]


def test_counters_equal_a_scan(spark):
    rows = [(t, i + (20 if i > 50 else 0), (i + t) % 4 != 0, "r" if i % 3 else "q", "resident") for t in range(5) for i in range(10 + 40 * t)]
    df = spark.createDataFrame(rows, "track_id long, frame_idx long, usable boolean, room string, role string").repartition(4)
    counters = Counters()
    n = windows(df, ["track_id"], counters=counters).count()
    want = window_statistics(df, ["track_id"]).first().asDict()
    assert counters.read() == want and want["windows_built"] == n > 0 and want["dropped_short_track"] and want["gaps_broken"]


def plain_adapted(rows, start, momentum, limit):
    unit = lambda x: x / np.linalg.norm(x) if np.linalg.norm(x) >= 1e-9 else x
    c, n, refused = np.array(start, float), 1, 0
    for v in rows:
        x = unit(np.array(v, float))
        if 1 - c @ x / np.linalg.norm(c) < limit:
            c, n = unit(momentum * c + (1 - momentum) * x), n + 1
        else:
            refused += 1
    return c, n, refused


def test_adapted_centroids_equal_a_plain_loop(spark):
    rng = np.random.default_rng(9)
    start = {p: rng.normal(size=6) / 2 for p in range(4)}
    seen = {p: [start[p] + rng.normal(size=6) * 0.4 for _ in range(60)] for p in range(3)}
    seen[2] = [*seen[2], *[start[2] * 0 + 1.0] * 15_000]  # one identity with many rows
    obs = [(p, i, v.tolist()) for p in seen for i, v in enumerate(seen[p])] + [(77, 0, [1.0] * 6), (0, 999, None)]
    gallery = spark.createDataFrame([(p, start[p].tolist(), 1) for p in start], "pid int, centroid array<double>, n_updates long")
    got = {r.pid: r for r in adapted_centroids(spark.createDataFrame(obs, "pid int, order long, vector array<double>").repartition(5), gallery, 0.9, 0.5).collect()}
    assert set(got) == set(start)
    for p in start:
        c, n, refused = plain_adapted(seen.get(p, []), start[p], 0.9, 0.3)
        assert (got[p].n_updates, got[p].n_refused) == (n, refused) and got[p].centroid == pytest.approx(c.tolist(), abs=1e-9)
    assert got[3].n_updates == 1 and sum(r.n_refused for r in got.values()) > 0
