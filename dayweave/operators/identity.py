"""Open-set identity: protocol, centroids, nearest two, thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from dayweave.functions.arrays import normalised
from dayweave.operators.metrics import auroc
from dayweave.operators.order import placed
from dayweave.sources.shared import staged

#: Bytes of centroids that are compared at once; bytes of probes that one task holds.
BLOCK_BYTES, CHUNK_BYTES = 32 << 20, 32 << 20
#: Cells of one block of products, centroids in it at most, and how far products of unit vectors in another order of summing may lie from
#: those in order.
CELLS, WIDE, CLOSE = 1 << 19, 1 << 10, 1e-9


def open_set_split(crops: DataFrame, n_enrolled: int, n_impostor_ids: int, enrol_per_id: int = 4, max_genuine: int = 10, max_impostor: int = 4, seed: str = "0") -> DataFrame:
    """crops (pid, camera, frame, ...) with part: enrolment, genuine or impostor; crops of no part are dropped.

    Of each id one camera is chosen (first by hash) that has enough crops and leaves other cameras to probe from; the first n_enrolled
    such ids by hash are enrolled, the next ids by hash are impostors. All choices rank by a hash, so reruns and engines agree.
    """
    h = lambda *cs: F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in cs]))
    cams = crops.groupBy("pid", "camera").agg(F.count("*").alias("n"))
    cams = cams.withColumn("cams", F.count("*").over(Window.partitionBy("pid"))).filter((F.col("n") >= enrol_per_id) & (F.col("cams") >= 2))
    chosen = cams.groupBy("pid").agg(F.min_by("camera", h("pid", "camera")).alias("enrol_camera"))
    enrolled = chosen.orderBy(h("pid")).limit(n_enrolled).withColumn("enrolled", F.lit(True))
    others = crops.select("pid").distinct().join(enrolled, "pid", "left_anti").orderBy(h("pid")).limit(n_impostor_ids)
    ids = enrolled.unionByName(others.select("pid", F.lit(None).cast(chosen.schema["enrol_camera"].dataType).alias("enrol_camera"), F.lit(False).alias("enrolled")))
    c = crops.join(ids.select("pid", "enrol_camera", "enrolled"), "pid")
    kind = F.when(~F.col("enrolled"), "impostor").when(F.col("camera") == F.col("enrol_camera"), "enrolment").otherwise("genuine")
    c = c.withColumn("part", kind)
    c = c.withColumn("_k", F.row_number().over(Window.partitionBy("pid", "part").orderBy(h("pid", "frame"))))
    most = F.when(F.col("part") == "enrolment", enrol_per_id).when(F.col("part") == "genuine", max_genuine).otherwise(max_impostor)
    return c.filter(F.col("_k") <= most).drop("_k", "enrolled", "enrol_camera")


def whole_protocol(crops: DataFrame, enrolled_share: float = 0.5, enrol_per_id: int = 4, seed: str = "0") -> DataFrame:
    """All crops with part, as in open_set_split but without limits: a share of the eligible ids (by hash) is enrolled with every crop of
    the chosen camera and probed with every other crop; every crop of the other ids is an impostor."""
    h = lambda *cs: F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in cs]))
    cams = crops.groupBy("pid", "camera").agg(F.count("*").alias("n"))
    cams = cams.groupBy("pid").agg(F.count("*").alias("cams"), F.min_by("camera", F.when(F.col("n") >= enrol_per_id, h("pid", "camera"))).alias("enrol_camera"))
    drawn = F.conv(F.substring(h("pid"), 1, 8), 16, 10).cast("double") / 4294967296.0 < enrolled_share
    chosen = cams.select("pid", F.when((F.col("cams") >= 2) & drawn, F.col("enrol_camera")).alias("enrol_camera"))
    kind = F.when(F.col("enrol_camera").isNull(), "impostor").when(F.col("camera") == F.col("enrol_camera"), "enrolment").otherwise("genuine")
    return crops.join(chosen, "pid").withColumn("part", kind).drop("enrol_camera")


def leaks(split: DataFrame) -> DataFrame:
    """What must be empty: ids both enrolled and impostor, crops both enrolled and probed, cameras both enrolled from and probed."""
    e, g, i = (split.filter(F.col("part") == p) for p in ("enrolment", "genuine", "impostor"))
    found = lambda name, a, b, cols: a.select(*cols).intersect(b.select(*cols)).select(F.lit(name).alias("leak"), F.concat_ws("|", *cols).alias("key"))
    return found("enrolled_impostor", e, i, ["pid"]).unionByName(found("enrolment_probe", e, g, ["pid", "frame"])).unionByName(found("camera", e, g, ["pid", "camera"]))


def centroids(crops: DataFrame, vector: str = "vector") -> DataFrame:
    """pid, centroid (mean of normalised vectors, normalised), n_updates. Sums by position, so that vectors never gather."""
    x = crops.select("pid", F.posexplode(normalised(F.col(vector))).alias("i", "x")).groupBy("pid", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return x.groupBy("pid").agg(F.max("n").alias("n_updates"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("pid", "n_updates", normalised(F.transform("v", lambda s: s["x"])).alias("centroid"))


def nearest_two(probes: DataFrame, gallery: DataFrame, vector: str = "vector", block_bytes: int = BLOCK_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """probes with best (cosine distance), who and gap (to the second best; infinite in a gallery of one). Ties go to the smaller id.

    Probes are dealt to chunks by hash, of about chunk_bytes at most, and the gallery is sent to every chunk. A task takes in its chunk
    of probes and lets the gallery, which comes in order of ids, pass by in blocks of block_bytes: nothing is written between blocks, no
    task holds more than a chunk and a block, nothing goes through the driver. A block's matrix product tells which centroids may enter
    a probe's best two; those are summed again in order of positions. All pairs are compared, which is quadratic by nature. An empty
    gallery leaves best and who null; a vector of another length or with nulls has null distances, all the same.
    """
    spark = probes.sparkSession
    g = staged(gallery.select("pid", F.col("centroid").cast("array<double>").alias("centroid")), "gallery")
    size, wide = probes.agg(F.count("*"), F.max(F.size(vector))).first()
    cores, held = spark.sparkContext.defaultParallelism, size * (64 + 16 * max(0, wide or 0))
    n = max(1, -(-held // chunk_bytes), min(cores, size // 256))
    n = n if n < cores else -(-n // cores) * cores  # no round leaves cores idle
    row = F.struct(*[F.col(f"`{c}`") for c in probes.columns])
    pid = gallery.schema["pid"].dataType.simpleString()
    p = probes.select(F.pmod(F.xxhash64(F.struct(*probes.columns)), F.lit(n)).cast("int").alias("_c"), F.lit(0).alias("_k"), F.lit(None).cast(pid).alias("_pid"), F.col(vector).cast("array<double>").alias("_v"), row.alias("_row"))
    every = g.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_c"), F.lit(1).alias("_k"), F.col("pid").alias("_pid"), F.col("centroid").alias("_v"), F.lit(None).cast(p.schema["_row"].dataType).alias("_row"))
    rows = p.unionByName(every).repartitionById(n, "_c").sortWithinPartitions("_c", "_k", "_pid")
    found = F.struct(F.lit(0.0).alias("best"), F.lit(None).cast(pid).alias("who"), F.lit(0.0).alias("gap"))
    out = probes.limit(0).select(row.alias("_row"), found.alias("_t")).select("_row.*", "_t.*").schema
    for f in out.fields:
        f.nullable = True
    arrow, per_block = to_arrow_schema(out), lambda width: max(1, block_bytes // (24 + 8 * width))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = at = None
        for rb in batches:
            keys = np.stack([rb.column(0).to_numpy(zero_copy_only=False), rb.column(1).to_numpy(zero_copy_only=False)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)] if len(keys) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part, (c, k) = rb.slice(lo, hi - lo), keys[lo]
                if c != at:
                    if chunk:
                        yield from chunk.rows(arrow)
                    chunk, at = _Chunk(), c
                if k == 0:
                    chunk.take(part.column(4), part.column(3))
                else:
                    chunk.meet(part.column(2), part.column(3), per_block)
        if chunk:
            yield from chunk.rows(arrow)

    return rows.mapInArrow(meet, out)


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise dot products, summed in order of positions."""
    s = np.zeros(len(a))
    for i in range(a.shape[1]):
        s += a[:, i] * b[:, i]
    return s


def _vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as a matrix, and which of its rows had `width` numbers; the other rows are zero."""
    sizes = np.diff(column.offsets.to_numpy())
    values, starts = column.values, column.offsets.to_numpy()[:-1]
    numbers, absent = values.to_numpy(zero_copy_only=False).astype(float), values.is_null().to_numpy(zero_copy_only=False)
    fits = (sizes == width) & ~column.is_null().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    if width:
        place = starts[fits][:, None] + np.arange(width)
        out[fits] = numbers[place]
        fits[fits] = ~absent[place].any(1)
    return out, fits


class _Chunk:
    """Probes of one chunk and the best two of each so far."""

    def __init__(self):
        self.parts, self.columns, self.v = [], [], None

    def take(self, rows: pa.Array, vectors: pa.Array) -> None:
        self.parts.append(rows)
        self.columns.append(vectors)

    def _start(self, width: int) -> None:
        found = [_vectors(c, width) for c in self.columns]
        self.columns = []
        self.v, self.fits = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        with np.errstate(all="ignore"):
            self.v /= np.maximum(np.sqrt(_summed(self.v, self.v)), 1e-12)[:, None]
        self.sure, self.v32 = self.fits & np.isfinite(self.v).all(1), self.v.astype(np.float32)
        self.d, self.who = np.full((len(self.v), 2), np.inf), np.full((len(self.v), 2), -1)
        self.n, self.pids = 0, []

    def meet(self, pids: pa.Array, centroids: pa.Array, per_block) -> None:
        if not self.parts:
            return
        if self.v is None:
            widths = np.diff(centroids.offsets.to_numpy())
            self._start(int(widths[0]) if len(widths) else 0)
        g, fits = _vectors(centroids, self.v.shape[1])
        ok = fits & np.isfinite(g).all(1)
        self.pids.append(pids)
        step = per_block(g.shape[1])
        for lo in range(0, len(g), step):
            cols = np.flatnonzero(ok[lo : lo + step]) + lo
            for first in range(0, len(cols), WIDE):
                some = cols[first : first + WIDE]
                self._pass(g[some], self.n + some)
        self.n += len(g)

    def _pass(self, g: np.ndarray, places: np.ndarray) -> None:
        """All probes against some centroids, with products in single precision where their error is known to be small."""
        most = max(float(np.abs(g).max(initial=0)), 1e-300)
        long = most * float(np.sqrt(_summed(g / most, g / most)).max())
        single = long < 1e15
        slack = CLOSE * max(1.0, long) + (single and (g.shape[1] + 4) * 2.0**-23 * long)
        v, h = (self.v32, g.astype(np.float32)) if single else (self.v, g)
        tall = max(1, CELLS // len(g))
        for top in range(0, len(v), tall):
            mine = np.flatnonzero(self.sure[top : top + tall]) + top
            if len(mine):
                whole = len(mine) == mine[-1] + 1 - mine[0]
                self._block(mine, (v[mine[0] : mine[-1] + 1] if whole else v[mine]) @ h.T, slack, g, places)

    def _block(self, mine: np.ndarray, near: np.ndarray, slack: float, g: np.ndarray, places: np.ndarray) -> None:
        """The best two of some probes, from products that lie within slack of the true ones."""
        bound = self.d[mine, 1]
        new = np.isinf(bound)
        if len(g) > 1 and new.any():
            bound[new] = 1 - np.partition(near[new], -2, axis=1)[:, -2].astype(float) + slack
        least = np.nextafter((1 - bound - slack).astype(near.dtype), -np.inf, dtype=near.dtype)
        r, c = np.divmod(np.flatnonzero(near >= least[:, None]), len(g))
        if not len(r):
            return
        touched, r = np.unique(r, return_inverse=True)
        rows = mine[touched]
        # The best two so far stand before the block's, whose ids are greater.
        row = np.concatenate([np.arange(len(rows)), np.arange(len(rows)), r])
        d = np.concatenate([self.d[rows, 0], self.d[rows, 1], 1 - _summed(self.v[rows[r]], g[c])])
        who = np.concatenate([self.who[rows, 0], self.who[rows, 1], places[c]])
        order = np.lexsort((np.where(who < 0, np.iinfo(np.int64).max, who), d, row))
        first = np.searchsorted(row[order], np.arange(len(rows)))
        for k in range(2):
            self.d[rows, k], self.who[rows, k] = d[order[first + k]], who[order[first + k]]

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        if self.v is None:  # an empty gallery
            self._start(0)
            best, who, gap = (np.full(len(self.v), np.nan) for _ in range(3))
            known, gap[:] = np.zeros(len(self.v), bool), np.inf
            taken = pa.nulls(len(self.v), schema.field("who").type)
        else:
            best, gap = self.d[:, 0].copy(), np.full(len(self.v), np.inf)
            two = self.who[:, 1] >= 0
            gap[two] = self.d[two, 1] - self.d[two, 0]
            none = self.who[:, 0] < 0
            best[none], known = np.nan, self.fits
            gap[none & self.fits & (self.n > 1)] = np.nan
            taken = pa.concat_arrays(self.pids).take(pa.array(np.where(none, 0, self.who[:, 0])))
        at = 0
        for part in self.parts:
            s = slice(at, at + len(part))
            at += len(part)
            found = [pa.array(best[s], pa.float64(), mask=~known[s]), taken[s], pa.array(gap[s], pa.float64())]
            yield pa.RecordBatch.from_arrays([*part.flatten(), *found], names=schema.names)


def distances(split: DataFrame, vector: str = "vector", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """pid, frame, part, best, who, gap, correct for genuine and impostor probes of a split."""
    gallery = centroids(split.filter("part = 'enrolment'"), vector)
    probes = split.filter("part <> 'enrolment'").select("pid", "frame", "part", vector)
    return nearest_two(probes, gallery, vector, block_bytes).select("pid", "frame", "part", "best", "who", "gap", (F.col("who") == F.col("pid")).alias("correct"))


def operating_point(d: DataFrame, threshold: float) -> DataFrame:
    """far, frr, tar, dir_rank1 at a threshold; a distance below it is accepted."""
    return _rates(d.withColumn("_in", F.col("best") < threshold)).withColumn("threshold", F.lit(float(threshold)))


def _rates(d: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    g, i, ok = F.col("part") == "genuine", F.col("part") == "impostor", F.col("_in").cast("double")
    s = d.groupBy(*by).agg(F.avg(F.when(i, ok)).alias("far"), F.avg(F.when(g, ok)).alias("tar"), F.avg(F.when(g, (F.col("_in") & F.col("correct")).cast("double"))).alias("dir_rank1"))
    return s.withColumn("frr", 1 - F.col("tar"))


def sweep(d: DataFrame, n_points: int = 512) -> DataFrame:
    """k, threshold, far, tar, frr, dir_rank1 for n_points thresholds over the range of distances.

    Each distance falls between two thresholds; the counts there are summed up in order, n_points rows in all. The distances are written
    once, as their ends come first.
    """
    d = staged(d.select("part", "best", "correct"), "distances")
    ends = d.agg(F.min("best").alias("lo"), F.max("best").alias("hi"))
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))
    ends = ends.select((F.col("lo") - 0.02 * span).alias("t0"), (((F.col("hi") + 0.02 * span) - (F.col("lo") - 0.02 * span)) / (n_points - 1)).alias("dt"))
    r = d.crossJoin(F.broadcast(ends))  # one row
    at = lambda k: F.col("t0") + k * F.col("dt")
    guess = F.greatest(F.lit(0), F.floor((F.col("best") - F.col("t0")) / F.col("dt")).cast("int") - 1)
    r = r.withColumn("_g", guess).withColumn("_k", F.col("_g") + sum((F.when(at(F.col("_g") + j) <= F.col("best"), 1).otherwise(0) for j in range(4)), F.lit(0)))
    counts = r.groupBy(F.col("_k").alias("k")).agg(F.count_if(F.col("part") == "genuine").alias("g"), F.count_if(F.col("part") == "impostor").alias("i"), F.count_if((F.col("part") == "genuine") & F.col("correct")).alias("c"))
    points = d.sparkSession.range(n_points).select(F.col("id").cast("int").alias("k")).join(counts, "k", "left").crossJoin(F.broadcast(ends))
    all_, upto = Window.partitionBy(), Window.partitionBy().orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # n_points rows
    share = lambda c, of: F.coalesce(F.sum(c).over(upto), F.lit(0)) / F.sum(of).over(all_)
    return points.select("k", at(F.col("k")).alias("threshold"), share("i", "i").alias("far"), share("g", "g").alias("tar"), share("c", "g").alias("dir_rank1")).withColumn("frr", 1 - F.col("tar"))


def fit_threshold(points: DataFrame, target_far: float = 0.01) -> DataFrame:
    """Of the thresholds within the false-accept budget the one with most true accepts, the lowest of equals; none within: the strictest."""
    ok = F.col("far") <= target_far
    key = F.when(ok, F.struct(F.lit(1).alias("a"), F.col("tar").alias("b"), (-F.col("threshold")).alias("c"))).otherwise(F.struct(F.lit(0).alias("a"), (-F.col("far")).alias("b"), (-F.col("threshold")).alias("c")))
    return points.groupBy().agg(F.max_by(F.struct("threshold", "far", "tar", "frr", "dir_rank1", ok.alias("feasible")), key).alias("p")).select("p.*")


def equal_error(points: DataFrame) -> DataFrame:
    """Where false accepts and false rejects cross: eer and its threshold, the lowest of equals."""
    key = F.struct(F.round(F.abs(F.col("far") - F.col("frr")), 12).alias("a"), F.col("threshold").alias("t"))
    return points.groupBy().agg(F.min_by(F.struct(((F.col("far") + F.col("frr")) / 2).alias("eer"), F.col("threshold")), key).alias("p")).select("p.*")


def profile(d: DataFrame) -> DataFrame:
    """part, n, rank1 (genuine), mean and quantiles (between the two nearest distances in order) of the best distance.

    A part's distances are ranked by ranges, so that no task takes in a whole part. They are written once, as ranges are drawn first.
    """
    d = staged(d.select("part", "best", "correct"), "distances")
    s = d.groupBy("part").agg(F.count("*").alias("n"), F.avg(F.when(F.col("part") == "genuine", F.col("correct").cast("double"))).alias("rank1"), F.avg("best").alias("mean"))
    r = placed(d.filter("best is not null").select("part", "best"), F.col("part"), F.col("best"), place="_k")
    ends = r.groupBy("part").agg(F.min("_k").alias("_first"), F.count("*").alias("_n")).withColumnRenamed("part", "_part")
    r = r.join(F.broadcast(ends), F.col("part").eqNullSafe(F.col("_part")))  # a row a part
    own, picked, between = F.col("_k") - F.col("_first"), [], []
    for name, share in (("p05", 0.05), ("median", 0.5), ("p95", 0.95)):
        at, lo, hi = F.lit(share) * (F.col("_n") - 1), F.col(f"_{name}0"), F.col(f"_{name}1")
        picked += [F.max(F.when(own == end(at), F.col("best"))).alias(f"_{name}{i}") for i, end in enumerate((F.floor, F.ceil))]
        between.append(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(name))
    q = r.groupBy("_part", "_n").agg(*picked).select("_part", *between)
    return s.join(F.broadcast(q), F.col("part").eqNullSafe(F.col("_part")), "left").select("part", "n", "rank1", "mean", "p05", "median", "p95")


def separation(d: DataFrame) -> DataFrame:
    """AUROC of genuine against impostor distances; smaller is more genuine."""
    return auroc(d.select((-F.col("best")).alias("s"), (F.col("part") == "genuine").cast("int").alias("t")), "s", "t")


def split_halves(split: DataFrame, seed: str = "half") -> DataFrame:
    """split with half: fit or test, by identity; enrolled and impostor ids are halved apart."""
    ids = split.select("pid", F.when(F.col("part") == "impostor", "impostor").otherwise("enrolled").alias("side")).distinct()
    r = placed(ids, F.col("side"), F.md5(F.concat_ws("|", F.lit(seed), F.col("pid").cast("string"))), F.col("pid"), place="_r")
    r = r.join(F.broadcast(r.groupBy("side").agg(F.min("_r").alias("_first"), F.count("*").alias("_n"))), "side")  # two sides
    half = F.when(F.col("_r") - F.col("_first") < F.greatest(F.lit(1), F.floor(F.col("_n") / 2)), "fit").otherwise("test")
    return split.join(r.select("pid", half.alias("half")), "pid")


def negative_control(crops: DataFrame, vector: str = "vector", key: str = "frame") -> DataFrame:
    """crops with vectors that know nothing of identity: each one turned by as many places as a hash of its key says, so lengths and
    distributions stay and what made one person's vectors alike is gone. A protocol under which they do well flatters any embedding."""
    n = F.size(vector)
    by = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("long"), n.cast("long")).cast("int")
    return crops.withColumn(vector, F.concat(F.slice(vector, by + 1, n), F.slice(vector, F.lit(1), by)))


def control_gap(real: DataFrame, control: DataFrame, least_gap: float = 0.1) -> DataFrame:
    """One row from the distances of both: their AUROC, the gap, and ok where the gap is large enough to trust the protocol."""
    a, b = (separation(d).select(F.col("auroc").alias(name)) for d, name in ((real, "auroc"), (control, "control_auroc")))
    return a.crossJoin(b).withColumn("gap", F.col("auroc") - F.col("control_auroc")).withColumn("ok", F.col("gap") >= least_gap)  # one row each
