"""Sequence decoding: calibrated and fused posteriors, Viterbi and smoothed marginals, abstention, segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.functions.arrays import let, logsumexp, softmax
from dayweave.operators.metrics import transition_counts

FALLING, FALLEN, TAKING_MEDICATION, IDLE = 7, 8, 12, 19
# Log-odds that a seen object adds to classes.
OBJECT_PRIORS = {
    "pill_bottle": {12: 2.0}, "bottle": {10: 0.7, 12: 0.7}, "cup": {10: 1.0, 9: 0.3}, "bowl": {9: 1.0, 11: 0.5}, "dining table": {9: 0.7, 11: 0.3}, "tv": {13: 1.0},
    "book": {14: 1.5}, "cell phone": {15: 1.5}, "couch": {2: 0.3, 13: 0.3}, "bed": {3: 0.7}, "person": {18: 1.5},
}
MEDICATION_OBJECTS, MEDICATION_ABSENT = ("pill_bottle", "bottle"), -2.0


def fused(posterior: Column, objects: Column, n_classes: int) -> Column:
    """The posterior with the log-odds of the objects seen (an array of names, each counted once), renormalised."""
    rows = {name: [add.get(c, 0.0) for c in range(n_classes)] for name, add in OBJECT_PRIORS.items()}
    table = F.create_map(*[x for n, r in rows.items() for x in (F.lit(n), F.array(*[F.lit(v) for v in r]))])
    start = F.transform(posterior, lambda p: F.log(F.greatest(p, F.lit(1e-12))))
    seen = F.filter(F.array_distinct(F.coalesce(objects, F.array().cast("array<string>"))), lambda o: o.isin(*rows))

    def combined(known: Column) -> Column:
        added = F.aggregate(known, start, lambda z, o: F.zip_with(z, table[o], lambda a, b: a + b))
        without = ~F.exists(known, lambda o: o.isin(*MEDICATION_OBJECTS))
        return let(without, lambda w: F.transform(added, lambda z, i: F.when(w & (i == TAKING_MEDICATION), z + MEDICATION_ABSENT).otherwise(z)))

    return softmax(let(seen, combined))


def with_floor(a: np.ndarray, floor: float) -> np.ndarray:
    """Each row's chance of falling is at least floor, exactly; the rest of the row keeps its proportions."""
    a = np.array(a, float)
    low = a[:, FALLING] < floor
    low[FALLING] = False
    rest = a.copy()
    rest[:, FALLING] = 0
    a[low] = rest[low] * ((1 - floor) / rest[low].sum(1, keepdims=True))
    a[low, FALLING] = floor
    return a


def structured_prior(n: int, stay: float = 0.90, floor: float = 0.05) -> np.ndarray:
    """Transition prior: states stay; a fall lasts about one window and leads to the floor, lying or standing up."""
    if n < 9:
        raise ValueError("the prior needs at least nine classes")
    a = np.full((n, n), (1 - stay) / (n - 1))
    np.fill_diagonal(a, stay)
    a[FALLING] = 0.02 / (n - 4)
    a[FALLING, [FALLING, FALLEN, 3, 4]] = 0.28, 0.50, 0.10, 0.10
    return with_floor(a, floor)


def fitted_prior(rows: DataFrame, n_classes: int, sequence: str, order: str, y: str = "y", alpha: float = 1.0) -> np.ndarray:
    """Transition prior counted from labelled sequences (training ones only), Laplace-smoothed; n_classes squared numbers."""
    found = transition_counts(rows, n_classes, sequence, order, y, alpha).collect()
    out = np.zeros((n_classes, n_classes))
    for r in found:
        out[r["from"], r["to"]] = r["probability"]
    return out


def long_enough(rows: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """The rows of sequences of at least `least` windows: a prior smooths nothing that has no neighbours."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return rows.join(n, keys, "left_semi")


def viterbi(emission: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The most likely path of log-probabilities; the first of equals."""
    best, came = start + emission[0], np.zeros(emission.shape, int)
    for t in range(1, len(emission)):
        reach = best[:, None] + move
        came[t] = reach.argmax(0)
        best = reach.max(0) + emission[t]
    path = [int(best.argmax())]
    for t in range(len(emission) - 1, 0, -1):
        path.append(int(came[t, path[-1]]))
    return np.array(path[::-1])


def marginals(emission: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Smoothed state probabilities at each step, in log space throughout."""
    total = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    ahead, behind = np.empty(emission.shape), np.zeros(emission.shape)
    ahead[0] = start + emission[0]
    for t in range(1, len(emission)):
        ahead[t] = total(ahead[t - 1][:, None] + move, 0) + emission[t]
    for t in range(len(emission) - 2, -1, -1):
        behind[t] = total(move + emission[t + 1] + behind[t + 1], 1)
    both = ahead + behind
    return np.exp(both - total(both, 1)[:, None])


def decoded(rows: DataFrame, keys: list[str], order: str, posterior: str, transition: np.ndarray, least: float = 0.40, idle: int = IDLE, exempt: tuple[int, ...] = (FALLING, FALLEN)) -> DataFrame:
    """rows with smoothed (Viterbi state), marginal, abstained and label (idle where abstained), per sequence in order.

    A sequence is one group, for which the recurrence needs all steps; the transition matrix is n_classes squared.
    """
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", smoothed int, marginal double, abstained boolean, label int"
    move = np.log(np.maximum(transition, 1e-12))
    start = np.full(len(move), -np.log(len(move)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        e = np.log(np.maximum(np.stack(pdf[posterior].to_numpy()).astype(float), 1e-12))
        path = viterbi(e, move, start)
        sure = marginals(e, move, start)[np.arange(len(path)), path]
        quiet = (sure < least) & ~np.isin(path, exempt)
        return pdf.assign(smoothed=path.astype("int32"), marginal=sure, abstained=quiet, label=np.where(quiet, idle, path).astype("int32"))

    return rows.groupBy(*keys).applyInPandas(run, kind)


def to_segments(rows: DataFrame, keys: list[str], least_windows: int = 1) -> DataFrame:
    """Consecutive windows (start_us, end_us, label, room, marginal, margin, objects) of one label and room that touch, as segments:
    start, end, mean confidence within [0, 1], mean margin, objects, number of windows."""
    w = Window.partitionBy(*keys).orderBy("start_us")
    new = F.lag("label").over(w).isNull() | (F.lag("label").over(w) != F.col("label")) | (F.col("start_us") > F.lag("end_us").over(w)) | ~F.lag("room").over(w).eqNullSafe(F.col("room"))
    r = rows.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = r.groupBy(*keys, "_run").agg(
        F.first("label").alias("activity_id"), F.first("room").alias("room"), F.min("start_us").alias("start_us"), F.max_by("end_us", "start_us").alias("end_us"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("marginal"))).alias("confidence"), F.avg("margin").alias("mean_logit_margin"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("objects")))).alias("supporting_objects"), F.count("*").alias("n_windows"),
    )
    return s.filter(F.col("n_windows") >= least_windows).drop("_run")


def pooled(logits: Column, members: list[list[int]]) -> Column:
    """Fine logits to coarse ones: log-sum-exp over each coarse class's members."""

    def one(z: Column, at: list[int]) -> Column:
        return logsumexp(F.array(*[F.get(z, i) for i in at]))

    return let(logits, lambda v: F.array(*[one(v, m) for m in members]))


def masked_cross_entropy(logits: Column, allowed: Column, y: Column) -> Column:
    """Negative log-likelihood of y among the allowed classes (array of boolean); fails the job if y is not allowed."""
    kept = F.filter(F.zip_with(logits, allowed, lambda z, a: F.when(a, z)), lambda z: z.isNotNull())
    return F.when(F.get(allowed, y), logsumexp(kept) - F.get(logits, y)).otherwise(F.raise_error(F.lit("the target class is masked")).cast("double"))
