"""Operators 11, 12 and 13 against plain versions."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dayweave.llm import clusters, pii, resampling

SF = "/root/testdata/sf0.001"

# ---- 11: centroids ---------------------------------------------------------------------------------------------


def plain_lloyd(rows, k, rounds, dims, seed=2):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    points = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        near = [min(range(len(points)), key=lambda c: (far(v, points[c]), c)) for _, v in kept]
        if turn < rounds:
            groups = [[v for (_, v), n in zip(kept, near) if n == c] for c in range(len(points))]
            points = [[sum(x) // len(g) for x in zip(*g)] if g else p for g, p in zip(groups, points)]
    inertia = Counter()
    for (_, v), n in zip(kept, near):
        inertia[n] += far(v, points[n])
    return [(i, n, far(v, points[n]), inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, points[n])).encode()).hexdigest()) for (i, v), n in zip(kept, near)]


def vectors(rng, n, dims, spread):
    middles = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    return [[x + rng.gauss(0, spread) for x in rng.choice(middles)] for _ in range(n)]


@pytest.mark.parametrize("scale_up", [1, 40_000])
def test_clusters_equal_plain_rounds(spark, scale_up):
    rng = random.Random(scale_up)
    rows = list(enumerate([[x * scale_up for x in v] for v in vectors(rng, 700, 4, 0.2)]))
    rows += [(9001, None), (9002, []), (9003, [1.0] * 3), (9004, [1.0] * 5), (9005, [1.0, None, 0.0, 0.0]), (9006, [float("nan"), 0.0, 0.0, 0.0]), (9007, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.25] * 4), (5, rows[5][1]), (5, [-3.0, 0.5, -0.001, 2.0])]
    rows += [(10_000 + i, [0.5, -0.5, 0.25, 0.0]) for i in range(40)]  # ties and copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("distance", F.lit("mine")).withColumn("id", F.lit(1)).repartition(3)
    got = [tuple(r) for r in clusters.clustered(df, k=9, rounds=4, dims=4).collect()]
    assert sorted(got, key=str) == sorted(plain_lloyd(rows, 9, 4, 4), key=str)
    assert len({r[1] for r in got}) > 3


def test_clusters_of_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    none = clusters.clustered(spark.createDataFrame([(1, [1.0]), (2, None)], kind), dims=4)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    few = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])]
    assert sorted(map(tuple, clusters.clustered(spark.createDataFrame(few, kind), dims=2).collect())) == sorted(plain_lloyd(few, 40, 5, 2))
    with pytest.raises(ValueError):
        clusters.clustered(spark.createDataFrame(few, kind).withColumnRenamed("vec_id", "cluster"), id_col="cluster")
    with pytest.raises(ValueError, match="64 bits"):
        clusters.integers(np.array([1e300]))


def test_only_expired_vectors_are_scanned_again():
    rng = random.Random(1)
    x = clusters.integers(np.array(vectors(rng, 500, 8, 0.05)))
    points = x[:6].tolist()
    drift, heaps, popped = [0.0] * 6, clusters.Heaps([[] for _ in range(6)]), []
    rows = list(range(500))
    for _ in range(8):
        now = clusters.Centroids(points, drift)
        near, keys = now.scan(x[rows])
        heaps.push(rows, near.tolist(), keys.tolist())
        heaps = clusters.Heaps.read(*heaps.packed())
        assert (heaps.owners() == now.distances(x).argmin(1)).all()
        new = [(x[heaps.owners() == c].sum(0) // max(1, (heaps.owners() == c).sum())).tolist() if (heaps.owners() == c).any() else points[c] for c in range(6)]
        drift, points = clusters.drifted(drift, points, new), new
        rows, _ = heaps.expired(drift)
        popped.append(len(rows))
    assert popped[-1] < 100 and sum(popped) < 8 * 500 / 2


def test_distances_stay_exact_beyond_doubles():
    x = np.array([[1 << 27, -(1 << 27)], [3, 5]], np.int32)
    now = clusters.Centroids([[-(1 << 27), 1 << 27], [1, 1]], [0.0, 0.0])
    assert now.distances(x).tolist() == [[2 << 56, (2**27 - 1) ** 2 + (2**27 + 1) ** 2], [(2**27 + 3) ** 2 + (2**27 - 5) ** 2, 20]]


# ---- 12: personal data -----------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and plain_luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(BASE).index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


PII = [
    "", "nothing", "a@b.c_d@e.f@g.h", "x@@y.z a@.b a@b. a@b.c.", "1.2.3.4.5 256.1.1.1 0001.000255.3.4 1.2.3", "+1 (718) 555-1498 and +49 30 1234567 +1 +12 345", "4571475004921503 4571-4750 0492-1503 4571475004921504",
    "+4571475004921503", "é😀 bosbt.42@mail8.example.com über 42.144.35.254", "1" * 30 + "@" + "a" * 30 + ".b", "card 4111 1111 1111 1111 1", "000000000000 0000-0000-0000",
]


@pytest.mark.parametrize("text", PII)
def test_base_spans_equal_the_plain_expressions(text):
    assert [f"{k}:{a}:{b}" for a, b, k in pii.base_spans(text)] == plain_base(text)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a0149@.-+ ()_é%", max_size=60))
def test_base_spans_equal_the_plain_expressions_on_any_text(text):
    assert [f"{k}:{a}:{b}" for a, b, k in pii.base_spans(text)] == plain_base(text)


def found(text):
    return {(s.kind, text[s.first : s.end]) for s in pii.detected(text)}


def test_check_sums():
    assert pii.mod97("GB82WEST12345698765432") and pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")
    assert pii.luhn("4571475004921503") and not pii.luhn("4571475004921504")


def test_added_kinds_need_a_check_sum_or_words():
    assert found("pay to DE89 3704 0044 0532 0130 00 THE rest") == {("iban", "DE89 3704 0044 0532 0130 00")}
    assert found("GB82WEST12345698765432") == {("iban", "GB82WEST12345698765432")}
    assert found("DE89 3704 0044 0532 0130 01") == set()
    assert found("social security 536-90-4399") == {("ssn", "536-90-4399")}
    assert found("order 536-90-4399, part 666-90-4399") == set()
    assert found("call (718) 555-1498 today") == {("national_phone", "(718) 555-1498")}
    assert found("rows 718 555 1498 of") == set()
    assert found("2001:db8:85a3::8a2e:370:7334") == {("ipv6", "2001:db8:85a3::8a2e:370:7334")}
    assert found("at 10:30:45 or a::b") == set()
    assert found("carte 4571.4750.0492.1503") == {("spaced_card", "4571.4750.0492.1503")}


def test_words_move_scores():
    score = {kind: [s.score for s in pii.detected(f"{word} 42.144.35.254")] for kind, word in (("for", "server"), ("none", "x"), ("against", "version"))}
    assert score == {"for": [1.0], "none": [0.7], "against": [0.4]}


def test_long_texts_take_linear_time():
    for text in ("a" * 3_000_000, "1" * 1_000_000, "1." * 500_000, "a@" * 500_000, "+1" + " " * 1_000_000, "+1 " * 300_000, ":" * 500_000, "AB12" * 200_000, "718 555 " * 100_000):
        began = time.time()
        pii.detected(text)
        assert time.time() - began < 20


def test_personal_data_query(spark):
    from dayweave.llm.queries import QUERIES

    texts = dict(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    rows = QUERIES["op12_pii"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_base(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}
    assert sum(r.n_email for r in rows) > 0


def test_personal_data_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "mail a@b.cd or a@b.cd"), (3, "mail a@b.cd or a@b.cd"), (None, "x")], "doc_id long, text string").withColumn("pii", F.lit(7))
    got = [(r.doc_id, r.pii) for r in pii.personal_data(df).collect()]
    assert [(i, len(s)) for i, s in got] == [(1, 0), (2, 0), (3, 2), (3, 2), (None, 0)]
    assert [r.text for r in pii.redacted(df).collect()] == [None, "", "mail <email> or <email>", "mail <email> or <email>", "x"]
    assert pii.personal_data(df.limit(0)).count() == 0


# ---- 13: importance resampling ---------------------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def plain_runs(text):
    w = WORD.findall(lower(text))
    return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resampling(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_runs(text)[1])
    for text in target:
        t.update(plain_runs(text)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)]
    rows = []
    for i, text in docs:
        n, runs = plain_runs(text)
        weight = sum(gain[b] for b in runs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    for place, r in enumerate(able[: 5 * len(able) // 100]):
        r[5] = place + 1
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("segment", [1 << 20, 7])
def test_hashed_runs_equal_plain_ones(monkeypatch, segment):
    monkeypatch.setattr(resampling, "SEGMENT", segment)
    rng = random.Random(3)
    for text in ["", " ", "One", "a_b", "ÄÖ Straße 12x", *(" ".join(rng.choice(["A", "bc", "déf", "9", "--", " "]) for _ in range(rng.randrange(60))) for _ in range(60))]:
        parts = list(resampling.hashed_runs(text.encode()))
        n, runs = plain_runs(text)
        assert sum(p[0] for p in parts) == n
        assert Counter(c % 10_000 for p in parts for c in p[1]) == Counter(runs)


def test_resampling_equals_the_plain_version(spark):
    rng = random.Random(8)
    words = ["alpha", "Beta", "gamma", "d3lta", "épsilon", "zeta"]
    docs = [(i, " ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(rng.randrange(80)))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, "- ! -"), (403, docs[7][1]), (404, "one " * 5000), (None, "null id " * 20), (405, "copy of all " * 10), (405, "copy of all " * 10), (405, "another of that id " * 10)]
    target = ["alpha1 beta2 gamma3 d3lta4"] * 5 + ["épsilon zeta", None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("mine")).withColumn("score", F.lit(0)).repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in resampling.resampled(df, bench).collect()]
    assert sorted(got, key=str) == sorted(plain_resampling(docs, target), key=str)
    assert sum(r[5] is not None for r in got) >= 15
    assert resampling.resampled(df.limit(0), bench).count() == 0
    assert sorted(map(tuple, resampling.resampled(df, bench.limit(0)).collect()), key=str) == sorted(plain_resampling(docs, []), key=str)


def test_ties_over_several_ranges_are_ranked_apart(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(20).alias("n_words"), F.lit(1).alias("n_features"), F.lit(2).alias("weight"), (F.col("id") % 3).alias("score")).repartition(6)
    got = {r.doc_id: r.rank for r in resampling.ranked(rows, percent=50).collect()}
    order = sorted(range(3000), key=lambda i: (-(i % 3), i))
    assert got == {i: p + 1 if p < 1500 else None for p, i in enumerate(order)}


def test_resampling_query(spark):
    from dayweave.llm.queries import QUERIES

    docs = list(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted((i, m, w, s, k) for i, _, m, w, s, k in plain_resampling(docs, target))
    assert sorted(map(tuple, QUERIES["op13_resampling"](spark, SF).collect())) == want
