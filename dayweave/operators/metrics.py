"""Classification, ranking and calibration metrics as aggregations."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.functions.arrays import adjusted, argmax, log_of_mean_probabilities, mean_of
from dayweave.operators.order import placed


def confusion(rows: DataFrame, by: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    return rows.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def per_class(conf: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, support, recall and f1 of every class that occurs as label or prediction."""
    cell = conf.select(*by, F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit("y").alias("side")), F.struct(F.col("pred").alias("c"), F.lit("p").alias("side")))).alias("s"), "y", "pred", "n")
    hit = F.col("y") == F.col("pred")
    side = F.col("s.side")
    out = cell.groupBy(*by, F.col("s.c").alias("class")).agg(
        F.coalesce(F.sum(F.when(hit & (side == "y"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(~hit & (side == "p"), F.col("n"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~hit & (side == "y"), F.col("n"))), F.lit(0)).alias("fn"),
    )
    support = F.col("tp") + F.col("fn")
    return out.withColumn("support", support).withColumn("recall", F.when(support > 0, F.col("tp") / support)).withColumn("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))


def scores(rows: DataFrame, by: list[str] | None = None, y: str = "y", pred: str = "pred", min_support: int = 50) -> DataFrame:
    """top1, mean_class (recall over classes with support), macro_f1 over classes that occur at all, macro_f1_present over classes with
    support, macro_f1_supported over classes with at least min_support; per group of by."""
    by = by or []
    c = per_class(confusion(rows, by, y, pred), by)
    return c.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("top1"),
        F.avg("recall").alias("mean_class"),
        F.avg("f1").alias("macro_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1_present"),
        F.avg(F.when(F.col("support") >= min_support, F.col("f1"))).alias("macro_f1_supported"),
        F.sum("support").alias("n"),
    )


def class_counts(rows: DataFrame, n_classes: int, y: str = "y") -> DataFrame:
    """class, n (at least 1), prior: every class of the space, seen or not."""
    spark = rows.sparkSession
    seen = rows.groupBy(F.col(y).cast("long").alias("class")).agg(F.count("*").alias("n"))
    all_ = spark.range(n_classes).withColumnRenamed("id", "class").join(seen, "class", "left").select("class", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("n"))
    return all_.withColumn("prior", F.col("n") / F.sum("n").over(Window.partitionBy()))  # n_classes rows


def log_prior(rows: DataFrame, n_classes: int, y: str = "y") -> DataFrame:
    """One row with log_prior, an array over the classes: small enough to broadcast whatever the input."""
    return class_counts(rows, n_classes, y).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("class", F.log("prior").alias("p")))), lambda s: s["p"]).alias("log_prior"))


def effective_weights(rows: DataFrame, n_classes: int, y: str = "y", beta: float = 0.9999) -> DataFrame:
    """class, n, weight (mean 1 over all classes, unseen as one), sampler_weight (over seen classes, sums to their number)."""
    c = class_counts(rows, n_classes, y).join(rows.groupBy(F.col(y).cast("long").alias("class")).agg(F.count("*").alias("seen")), "class", "left")
    raw = (1 - beta) / (1 - F.pow(F.lit(beta), F.col("n")))
    every = Window.partitionBy()
    seen = F.when(F.col("seen") > 0, raw)
    return c.select("class", F.coalesce("seen", F.lit(0)).alias("n"), (raw / F.avg(raw).over(every)).alias("weight"), F.coalesce(seen / F.sum(seen).over(every) * F.count(seen).over(every), F.lit(0.0)).alias("sampler_weight"))


def subsets(streams: list[str]) -> list[tuple[str, ...]]:
    return [c for k in range(1, len(streams) + 1) for c in combinations(sorted(streams), k)]


def subset_scores(rows: DataFrame, streams: list[str], y: str = "y", min_support: int = 50) -> DataFrame:
    """Scores of every set of streams (columns of logits) under both ways of combining; rows are widened in place, then counted."""
    options = F.array(*[
        F.struct(F.lit("+".join(c)).alias("streams"), F.lit(mode).alias("mode"), argmax(f([F.col(s) for s in c])).alias("pred"))
        for c in subsets(streams) for mode, f in (("logit", mean_of), ("prob", log_of_mean_probabilities))
    ])
    return scores(rows.select(F.col(y).alias("y"), F.inline(options)), ["streams", "mode"], min_support=min_support)


def tau_sweep(rows: DataFrame, logits: str, n_classes: int, taus: list[float], temperatures: tuple[float, ...] = (1.0,), y: str = "y", min_support: int = 50) -> DataFrame:
    """Scores of logits less tau times the log-prior, for every tau and temperature."""
    with_prior = rows.crossJoin(F.broadcast(log_prior(rows, n_classes, y)))  # one row of n_classes numbers
    options = F.array(*[F.struct(F.lit(float(t)).alias("tau"), F.lit(float(k)).alias("temperature"), argmax(adjusted(F.transform(F.col(logits), lambda x: x / float(k)), F.col("log_prior"), float(t))).alias("pred")) for t in taus for k in temperatures])
    return scores(with_prior.select(F.col(y).alias("y"), F.inline(options)), ["tau", "temperature"], min_support=min_support)


def best_temperature(rows: DataFrame, logits: str, y: str = "y", low: int = 25, high: int = 500) -> DataFrame:
    """The temperature of the grid (hundredths from low to high) with the least mean negative log-likelihood, the first of equals."""
    grid = np.arange(low, high + 1)
    # Rows are never multiplied: a task sums the losses of some rows at all temperatures at once and sends one sum for each.
    known = rows.select(F.col(y).cast("int").alias("y"), F.col(logits).cast("array<double>").alias("z")).filter("y >= 0 and y < size(z) and not exists(z, x -> x is null)")

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(grid)), 0
        for rb in batches:
            at, sizes = rb.column(0).to_numpy(), np.diff(rb.column(1).offsets.to_numpy())
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                z = rb.column(1).take(pa.array(own)).flatten().to_numpy().reshape(-1, size)
                z = z - z.max(1, keepdims=True)
                for i in range(0, len(own), 256):
                    some, mine = z[i : i + 256], at[own[i : i + 256]]
                    whole = np.exp(some[:, :, None] / (grid / 100)).sum(1)
                    chance = np.exp(some[np.arange(len(some)), mine][:, None] / (grid / 100)) / whole
                    total += np.round(-np.log(np.maximum(chance, 1e-12)), 12).sum(0)
            n += len(at)
        yield pa.RecordBatch.from_pydict({"t": grid, "total": total, "n": np.full(len(grid), n)})

    means = known.mapInArrow(losses, "t long, total double, n long").groupBy("t").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("nll"))
    return means.groupBy().agg((F.min_by("t", F.struct("nll", "t")) / 100).alias("temperature"), F.min("nll").alias("nll"))


def transition_counts(rows: DataFrame, n_classes: int, sequence: str, order: str, y: str = "y", alpha: float = 1.0) -> DataFrame:
    """from, to, probability: Laplace-smoothed bigrams within sequences; each row of the matrix sums to 1."""
    spark = rows.sparkSession
    w = Window.partitionBy(sequence).orderBy(order)
    seen = rows.withColumn("to", F.lead(y).over(w)).filter("to is not null").groupBy(F.col(y).cast("long").alias("from"), F.col("to").cast("long").alias("to")).agg(F.count("*").alias("n"))
    grid = spark.range(n_classes).select(F.col("id").alias("from"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_classes - 1).cast("long"))).alias("to"))
    c = grid.join(seen, ["from", "to"], "left").withColumn("c", F.coalesce("n", F.lit(0)) + alpha)
    return c.select("from", "to", (F.col("c") / F.sum("c").over(Window.partitionBy("from"))).alias("probability"))


def fragmentation(rows: DataFrame, sequence: str, order: str, y: str = "y", pred: str = "pred") -> DataFrame:
    """Runs of equal labels, predicted and true, over all sequences."""
    w = Window.partitionBy(sequence).orderBy(order)
    new = lambda c: F.when(F.lag(c).over(w).isNull() | (F.lag(c).over(w) != F.col(c)), 1).otherwise(0)
    runs = rows.select(sequence, new(pred).alias("p"), new(y).alias("t"))
    s = runs.groupBy().agg(F.sum("p").alias("segments_pred"), F.sum("t").alias("segments_true"), F.count_distinct(sequence).alias("n_sequences"))
    return s.withColumn("per_sequence", F.col("segments_pred") / F.greatest("n_sequences", F.lit(1))).withColumn("ratio", F.col("segments_pred") / F.greatest("segments_true", F.lit(1)))


def running_totals(rows: DataFrame, order: str, totals: list[str], by: list[str] | None = None, descending: bool = True, buckets: int | None = None) -> DataFrame:
    """rows with cum_<c> for each of totals: sums up to and including the row, in the order of a column whose values are distinct.

    Sums run over all groups at once, range by range, and each group's start is taken off; the number of ranges is that of shuffle
    partitions (or buckets), so it follows the cluster and no task sees all rows.
    """
    by = by or []
    sort = F.col(order).desc() if descending else F.col(order).asc()
    out = placed(rows, *[F.col(c) for c in by], sort, place="_k", sizes={f"cum_{c}": F.col(c) for c in totals}, ranges=buckets).drop("_k")
    if by:
        starts = out.groupBy(*by).agg(*[F.min(f"cum_{c}").alias(f"_s_{c}") for c in totals]).select(*[F.col(c).alias(f"_by_{c}") for c in by], *[f"_s_{c}" for c in totals])
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        out = out.join(starts, same)
    start = lambda c: F.col(f"_s_{c}") if by else F.lit(0)
    return out.select(*by, *[c for c in rows.columns if c not in by], *[(F.col(f"cum_{c}") - start(c) + F.col(c)).alias(f"cum_{c}") for c in totals])


def auroc_by_rank(rows: DataFrame, score: str, target: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve without averaging ties: rows of one score are ranked by a column of distinct values instead."""
    by = by or []
    pos = F.when(F.col(target) == 1, 1).otherwise(0)
    own = rows.select(*by, F.col(score).alias("score"), F.col(order).alias("_o"), pos.alias("pos"))
    # Places over all groups; a group's ranks are its places less its first one, however many rows share a score.
    p = placed(own, *[F.col(c) for c in by], F.col("score"), F.col("_o"), place="_k")
    g = p.groupBy(*by).agg((F.sum(F.when(F.col("pos") == 1, F.col("_k")).cast("decimal(38,0)")).cast("double") - F.sum("pos") * (F.min("_k") - 1)).alias("_ranks"), F.sum("pos").alias("n_pos"), F.sum(1 - F.col("pos")).alias("n_neg"))
    area = (F.col("_ranks") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))
    return g.select(*by, F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), F.lit(float("nan"))).otherwise(area).alias("auroc"), "n_pos", "n_neg")


def by_score(rows: DataFrame, score: str, target: str, by: list[str] | None = None) -> DataFrame:
    """pos and neg counts of each distinct score."""
    return rows.groupBy(*(by or []), F.col(score).alias("score")).agg(F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) != 1).alias("neg"))


def auroc(rows: DataFrame, score: str, target: str, by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Area under the ROC curve with ties counted half: the share of (positive, negative) pairs in order. NaN without both classes."""
    by = by or []
    t = running_totals(by_score(rows, score, target, by), "score", ["neg"], by, descending=False, buckets=buckets)
    pairs = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2))
    s = t.groupBy(*by).agg(pairs.alias("_p"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return s.select(*by, F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), F.lit(float("nan"))).otherwise(F.col("_p") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"), "n_pos", "n_neg")


def auprc(rows: DataFrame, score: str, target: str) -> DataFrame:
    """Areas by trapezoid over distinct scores, from the highest down: under precision over recall, and under the ROC curve."""
    t = running_totals(by_score(rows, score, target), "score", ["pos", "neg"])
    # A point's predecessor is known from its own counts, so no second pass in order is needed.
    p0, n0 = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    precision0 = F.when(p0 + n0 > 0, p0 / (p0 + n0)).otherwise(precision)
    s = t.groupBy().agg(F.sum(F.col("pos") * (precision + precision0) / 2).alias("_pr"), F.sum(F.col("neg") * (F.col("cum_pos") + p0) / 2).alias("_roc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return s.select((F.col("_pr") / F.greatest("n_pos", F.lit(1))).alias("auprc"), (F.col("_roc") / F.greatest(F.col("n_pos") * F.col("n_neg"), F.lit(1))).alias("auroc"), (F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))).alias("positive_rate"))


def fall_operating_point(rows: DataFrame, score: str, target: str, window_s: float = 2.0, per_hour: float = 1.0) -> DataFrame:
    """The threshold (scores to four decimals) with the best sensitivity at no more than per_hour false alarms an hour of negatives, the
    lowest of equals; if none keeps the budget, the highest score, with feasible false."""
    rounded = rows.withColumn("_s", F.round(score, 4))
    # at a threshold: rows whose exact score is at least it; a score that was rounded down still counts, one rounded up does not
    exact = rows.select(F.col(score).alias("score"), (F.col(target) == 1).cast("long").alias("pos"), (F.col(target) != 1).cast("long").alias("neg"), F.lit(0).alias("is_threshold"))
    marks = rounded.select("_s").distinct().select(F.col("_s").alias("score"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"), F.lit(1).alias("is_threshold"))
    both = exact.unionByName(marks).groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("is_threshold").alias("is_threshold"))
    t = running_totals(both, "score", ["pos", "neg"]).filter("is_threshold = 1")
    n = both.groupBy().agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.max("score").alias("_top"))
    t = t.crossJoin(F.broadcast(n))  # one row
    rate = F.col("cum_neg") / (F.col("n_neg") * window_s / 3600)
    best = t.select(F.struct((rate <= per_hour).alias("feasible"), F.when(rate <= per_hour, F.col("cum_pos")).otherwise(-F.col("cum_neg")).alias("_k"), (-F.col("score")).alias("_t")).alias("k"), F.struct(F.col("score").alias("threshold"), (F.col("cum_pos") / F.col("n_pos")).alias("sensitivity"), rate.alias("false_alarms_per_hour"), (1 - F.col("cum_neg") / F.col("n_neg")).alias("specificity"), (F.col("n_neg") * window_s / 3600).alias("monitored_hours"), (rate <= per_hour).alias("feasible")).alias("v"))
    return best.groupBy().agg(F.max_by("v", "k").alias("v")).select("v.*")


def weighted_sample(rows: DataFrame, weight: str, n: int | None, key: Column) -> DataFrame:
    """About n rows (as many as there are, without n) with replacement, each as often as its share of the weights: the whole part for certain, the rest by the hash of key."""
    from dayweave.functions.text import uniform

    total = rows.agg((F.sum(weight) / (F.count("*") if n is None else F.lit(n))).alias("_total"))
    share = F.col(weight) / F.col("_total")
    times = (F.floor(share) + F.when(uniform(key) < share - F.floor(share), 1).otherwise(0)).cast("int")
    r = rows.crossJoin(F.broadcast(total)).withColumn("_times", times).drop("_total")  # one row
    return r.filter("_times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")
