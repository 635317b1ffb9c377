"""Nearest centroids against brute force, whatever the size of a block."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dayweave.operators.identity import nearest_two


@pytest.mark.parametrize("block_bytes", [50, 150, 1 << 20])
def test_nearest_two_is_the_same_for_every_block_size(spark, block_bytes):
    rng = random.Random(1)
    gallery = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(9)]
    gallery = [(i, [x / math.hypot(*v) for x in v]) for i, v in gallery if any(v)] + [(20, gallery[0][1] if any(gallery[0][1]) else [1.0, 0.0, 0.0])]
    gallery = [(i, [x / math.hypot(*v) for x in v]) for i, v in gallery]
    probes = [(k, [rng.gauss(0, 1) for _ in range(3)]) for k in range(200)]
    g = spark.createDataFrame(gallery, "pid long, centroid array<double>")
    p = spark.createDataFrame(probes, "frame long, vector array<double>").repartition(5)
    got = {r.frame: r for r in nearest_two(p, g, block_bytes=block_bytes).collect()}
    assert len(got) == len(probes)
    for k, v in probes:
        unit = [x / math.hypot(*v) for x in v]
        d = sorted((round(1 - sum(a * b for a, b in zip(unit, c)), 9), i) for i, c in gallery)
        assert (round(got[k].best, 9), got[k].who) == d[0] and abs(got[k].gap - (d[1][0] - d[0][0])) < 1e-6
    one = nearest_two(p.limit(3), g.filter("pid = 20"), block_bytes=block_bytes).collect()
    assert all(r.gap == math.inf and r.who == 20 for r in one)
    assert nearest_two(p.limit(3), g.limit(0), block_bytes=block_bytes).filter(F.col("who").isNull()).count() == 3
