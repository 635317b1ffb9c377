"""Skeleton shards in numpy's archive format, and their augmentation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.functions.skeleton import MIRROR
from dayweave.sources.arrays import arrays


def shards_from_npz(spark: SparkSession, path: str, n_classes: int) -> DataFrame:
    """Arrays skeletons, labels and, if there, subjects and datasets of the archives at path (a file, a folder or a pattern), in ranges
    of rows; labels out of range carry a reason."""
    a = arrays(spark, path, ["skeletons", "labels", "subjects", "datasets"])
    label = F.col("labels").cast("int")
    why = F.when(~F.coalesce(label.between(0, n_classes - 1), F.lit(False)), "label out of range")
    return a.select(F.col("archive").alias("shard"), "row", label.alias("label"), F.col("subjects").alias("subject"), F.col("datasets").alias("dataset"), F.col("skeletons_shape").alias("shape"), F.col("skeletons").cast("array<float>").alias("skeleton"), why.alias("reject_reason"))


def augmented(skeleton: Column, key: Column, joints: int = 17, seed: int = 0, rotate: float = 0.2, scale: float = 0.1, shift: float = 0.1, noise: float = 0.01, drop: float = 0.05, flip: float = 0.5) -> Column:
    """A flat skeleton (frames of joints of x, y, score) mirrored, turned, scaled, moved, jittered, with joints dropped: the same for the
    same seed and key. Mirroring exchanges left and right joints too. A dropped joint is gone from all frames, as behind furniture; what
    is not seen is zero, and stays so. Scores are never changed but by dropping."""
    partner = list(MIRROR) if joints == len(MIRROR) else None

    @F.pandas_udf("array<float>")
    def vary(xs: pd.Series, keys: pd.Series) -> pd.Series:
        out = []
        for x, k in zip(xs, keys, strict=True):
            rng = np.random.default_rng([seed, int(k)])
            s = np.array(x, np.float32).reshape(-1, joints, 3)
            if partner is not None and rng.random() < flip:
                s = s[:, partner]
                s[..., 0] *= -1
            a = rng.uniform(-rotate, rotate)
            turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
            s[..., :2] = s[..., :2] @ turn.T * rng.uniform(1 - scale, 1 + scale) + rng.uniform(-shift, shift, 2) + rng.normal(0, noise, s[..., :2].shape)
            s[:, rng.random(joints) < drop] = 0
            s[s[..., 2] <= 0] = 0
            out.append(s.ravel())
        return pd.Series(out)

    return vary(skeleton, key)
