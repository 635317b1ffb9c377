"""Centroid clustering with heap-ordered bounds.

Lloyd's rounds in whole numbers. Vectors lie packed in blocks; in every block each cluster keeps a heap of its vectors, ordered by the gap
between the distances to the second-nearest and the nearest centroid when the vector was last scanned. A cluster's drift (how far its own
and the fastest other centroid have moved) accumulates, and gaps are stored with the drift at the time of the scan added, so a round
only compares heap tops with the cluster's drift: what lies above it cannot have changed its centroid. Vectors whose gap has expired are
popped, scanned exactly against all centroids and pushed again.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayweave.llm.common import bucketed, staged, table

CENTROIDS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
#: Vectors packed in a block, and bytes of vectors in one bucket of blocks (a task reads one bucket, block by block).
BLOCK_ROWS, BUCKET_BYTES, MOST_BUCKETS = 1024, 64 << 20, 65_536
#: Components beyond this have squared distances that no 64-bit integer holds.
MOST = 1 << 27
#: Gaps are read as this much smaller, relatively, than computed, so that rounding never hides an expired one.
SLACK = 1e-9

_STATE = "block long, keys binary, rows binary, sizes array<int>, moved array<struct<cluster: int, sums: array<bigint>>>"
_STATE_ARROW = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("rows", pa.binary()), ("sizes", pa.list_(pa.int32())), ("moved", pa.list_(pa.struct([("cluster", pa.int32()), ("sums", pa.list_(pa.int64()))])))])


def whole(vector: Column, dims: int = DIMS) -> Column:
    """True for arrays of exactly dims components, none of them null or not finite; null for null."""
    return (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x); ValueError for components whose squared distances would not fit."""
    with np.errstate(over="ignore"):
        out = np.floor(values * scale)
    if len(out) and np.abs(out).max() > MOST:
        raise ValueError(f"a component lies beyond {MOST}: its squared distances don't fit in 64 bits")
    return out.astype(np.int32)


class Centroids:
    """The centroids of one round, and each cluster's accumulated drift."""

    def __init__(self, points: list[list[int]], drift: list[float]):
        self.points, self.drift = np.array(points, np.int64), drift

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Exact squared distances of the rows of x to all centroids."""
        top = int(max(np.abs(x).max(initial=0), np.abs(self.points).max(initial=0)))
        if 4 * top * top * x.shape[1] < 1 << 53:  # all terms are whole numbers that a double holds
            a, c = x.astype(np.float64), self.points.astype(np.float64)
            return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
        return np.stack([((x.astype(np.int64) - c) ** 2).sum(1) for c in self.points], 1)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid (the smaller number of equals) of each row, and its gap, offset by the cluster's drift."""
        d = self.distances(x)
        near = d.argmin(1)
        rows = np.arange(len(x))
        first = np.sqrt(d[rows, near].astype(np.float64))
        if d.shape[1] == 1:
            return near, np.full(len(x), np.inf)
        d[rows, near] = np.iinfo(np.int64).max
        second = np.sqrt(d.min(1).astype(np.float64))
        offset = np.array(self.drift)[near]
        return near, second - first + offset - SLACK * (first + second + offset + 1)


class Heaps:
    """The heaps of one block, a list of (offset gap, row) for each cluster."""

    def __init__(self, heaps: list[list[tuple[float, int]]]):
        self.heaps = heaps

    @classmethod
    def read(cls, keys: bytes, rows: bytes, sizes: list[int]) -> Heaps:
        held = list(zip(np.frombuffer(keys, np.float64).tolist(), np.frombuffer(rows, np.int32).tolist(), strict=True))
        ends = np.cumsum(sizes).tolist()
        return cls([held[e - n : e] for e, n in zip(ends, sizes, strict=True)])

    def packed(self) -> tuple[bytes, bytes, list[int]]:
        flat = [x for h in self.heaps for x in h]
        return np.array([k for k, _ in flat], np.float64).tobytes(), np.array([r for _, r in flat], np.int32).tobytes(), [len(h) for h in self.heaps]

    def expired(self, drift: list[float]) -> tuple[list[int], list[int]]:
        """Pops every row whose gap its cluster's drift has used up: rows and the clusters they leave."""
        rows, left = [], []
        for cluster, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[cluster]:
                rows.append(heapq.heappop(heap)[1])
                left.append(cluster)
        return rows, left

    def push(self, rows: list[int], clusters: list[int], keys: list[float]) -> None:
        for row, cluster, key in zip(rows, clusters, keys, strict=True):
            heapq.heappush(self.heaps[cluster], (key, row))

    def owners(self) -> np.ndarray:
        """The cluster of each row."""
        out = np.zeros(sum(map(len, self.heaps)), np.int32)
        for cluster, heap in enumerate(self.heaps):
            out[[r for _, r in heap]] = cluster
        return out


def _vectors(raw: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{width}").reshape(n, -1)


def _pack(dims: int, scale: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for rb in batches:
            x = integers(rb.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)
            for at in range(0, len(x), BLOCK_ROWS):
                some = x[at : at + BLOCK_ROWS]
                width = 1 if np.abs(some).max() < 128 else 2 if np.abs(some).max() < 1 << 15 else 4
                ids = rb.column(0).slice(at, len(some))
                listed = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + made], pa.int64()), listed.cast(schema.field("ids").type), pa.array([width], pa.int32()), pa.array([some.astype(f"<i{width}").tobytes()], pa.binary())], schema=schema)
                made += 1

    return run


def _moves(x: np.ndarray, rows: list[int], left: list[int] | None, near: np.ndarray, k: int) -> list[dict]:
    """What the sums (and, last, the number) of vectors of each cluster change by."""
    ones = np.concatenate([x[rows].astype(np.int64), np.ones((len(rows), 1), np.int64)], 1)
    total = np.zeros((k, ones.shape[1]), np.int64)
    if left is None:
        np.add.at(total, near, ones)
    else:
        went = np.flatnonzero(np.array(left, np.int64) != near)
        np.add.at(total, near[went], ones[went])
        np.add.at(total, np.array(left, np.int64)[went], -ones[went])
    return [{"cluster": int(c), "sums": total[c]} for c in np.flatnonzero(total.any(1))]


def _advance(shared):
    """Assigns the blocks' vectors to the centroids of this round; the first round has no heaps yet and scans all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Centroids = shared.value
        k = len(now.points)
        for rb in batches:
            out = {f.name: [] for f in _STATE_ARROW}
            for r in rb.to_pylist():
                x = _vectors(r["x"], r["width"], r["n"])
                if r.get("sizes") is None:
                    rows, left, heaps = list(range(r["n"])), None, Heaps([[] for _ in range(k)])
                else:
                    heaps = Heaps.read(r["keys"], r["rows"], r["sizes"])
                    rows, left = heaps.expired(now.drift)
                near, keys = now.scan(x[rows])
                heaps.push(rows, near.tolist(), keys.tolist())
                held = heaps.packed()
                for name, value in zip(out, (r["block"], *held, _moves(x, rows, left, near, k)), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _STATE_ARROW], schema=_STATE_ARROW)

    return run


def _members(shared, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Centroids = shared.value
        for rb in batches:
            listed = rb.column(0)
            for i, r in enumerate(rb.drop_columns(["ids"]).to_pylist()):
                x = _vectors(r["x"], r["width"], r["n"])
                cluster = Heaps.read(r["keys"], r["rows"], r["sizes"]).owners()
                distance = ((x.astype(np.int64) - now.points[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([listed[i].values, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], schema=schema)

    return run


def first_centroids(vectors: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """Of columns (id, v) the k vectors with the least hash of seed:id, null ids last; rows that share an id go by their components."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(hashed.asc_nulls_last(), "v").limit(k).select("v").collect()
    return [integers(np.array(r.v, np.float64), scale).tolist() for r in rows]


def clustered(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """id_col, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 for every whole vector of df.

    Vectors that are null, of another length, or have a null or non-finite component are left out. The k whole vectors with the least hash
    of their id start; fewer vectors are as many clusters, none no rows. Equal distances go to the smaller number. A null id is clustered
    but starts only after all others; repeated rows are vectors of their own. Other columns are ignored. ValueError if id_col has the name
    of an output, or (in a task) if a component is beyond 2**27 after scaling.

    Vectors are packed and moved once, into a table bucketed by block; a round reads them beside the heaps (12 bytes a vector), which it
    writes anew, without an exchange. What reaches the driver is k * (dims + 1) sums a round.
    """
    if id_col in ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"):
        raise ValueError(f"the id column cannot be named {id_col}")
    spark = df.sparkSession
    vectors = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).filter(whole(F.col("v"), dims)).select("id", F.col("v").cast("array<double>").alias("v"))
    points = first_centroids(vectors, k, seed, scale)
    kind = vectors.schema["id"].dataType
    out_kind = T.StructType([T.StructField(id_col, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    named = T.StructType([*out_kind.fields, T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    if not points:
        return spark.createDataFrame([], named)
    size = df.count() * dims * 4
    buckets = min(MOST_BUCKETS, max(1, min(spark.sparkContext.defaultParallelism, size >> 20), -(-size // BUCKET_BYTES)))  # a small table makes no use of a large cluster
    id_arrow = _arrow(kind)
    packed_arrow = pa.schema([("block", pa.int64()), ("ids", pa.list_(id_arrow)), ("width", pa.int32()), ("x", pa.binary())])
    packed_kind = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("width", T.IntegerType()), T.StructField("x", T.BinaryType())])
    blocks = bucketed(vectors.mapInArrow(_pack(dims, scale, packed_arrow), packed_kind).repartition(buckets, "block"), "cluster-blocks", "block", buckets)
    read = [F.col("block"), F.size("ids").alias("n"), F.col("width"), F.col("x")]
    sums, drift, state = [[0] * (dims + 1) for _ in points], [0.0] * len(points), None
    for turn in range(rounds + 1):
        shared = spark.sparkContext.broadcast(Centroids(points, drift))
        asked = blocks.select(*read) if state is None else blocks.select(*read).join(state.select("block", "keys", "rows", "sizes").hint("shuffle_hash"), "block")
        state = bucketed(asked.mapInArrow(_advance(shared), _STATE), "cluster-heaps", "block", buckets)
        if turn == rounds:
            break
        parts = state.select(F.explode("moved").alias("m")).select("m.cluster", F.posexplode("m.sums").alias("at", "by"))
        for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("by").cast("decimal(38,0)")).alias("by")).toLocalIterator():
            sums[r.cluster][r["at"]] += int(r.by)
        new = [[s // total[-1] for s in total[:-1]] if total[-1] else old for old, total in zip(points, sums, strict=True)]
        drift, points = drifted(drift, points, new), new
    return _with_totals(blocks, state, points, id_col, out_kind, shared).select(*named.names)


def drifted(drift: list[float], old: list[list[int]], new: list[list[int]]) -> list[float]:
    """Each cluster's drift after a move: its own step and the longest step of another, a little more than computed."""
    steps = [math.sqrt(sum((a - b) ** 2 for a, b in zip(o, n, strict=True))) * (1 + SLACK) for o, n in zip(old, new, strict=True)]
    order = sorted(range(len(steps)), key=steps.__getitem__)
    other = lambda c: steps[order[-1] if order[-1] != c else order[-2]] if len(steps) > 1 else 0.0
    return [(d + steps[c] + other(c)) * (1 + SLACK) for c, d in enumerate(drift)]


def _with_totals(blocks: DataFrame, state: DataFrame, points: list[list[int]], id_col: str, kind: T.StructType, shared) -> DataFrame:
    spark = blocks.sparkSession
    schema = pa.schema([(id_col, _arrow(kind[0].dataType)), ("cluster", pa.int32()), ("distance", pa.int64())])
    both = blocks.select("ids", "block", F.size("ids").alias("n"), "width", "x").join(state.select("block", "keys", "rows", "sizes").hint("shuffle_hash"), "block").select("ids", "block", "n", "width", "x", "keys", "rows", "sizes")
    rows = staged(both.mapInArrow(_members(shared, schema), kind), "cluster-members")
    inertia = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row a cluster
    digest = lambda p: hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()
    totals = spark.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), digest(p)) for c, p in enumerate(points)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(totals), "cluster")


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind, timezone="UTC") if isinstance(kind, T.TimestampType) else to_arrow_type(kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every whole vector of embeddings."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _oracle(k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """Lloyd's rounds without bounds, a few statements for each."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, x) - 1 AS k, x AS c FROM v ORDER BY k LIMIT {k})",
    ]
    for turn in range(rounds + 1):
        parts.append(f"a{turn} AS MATERIALIZED (SELECT r, min({{'d': d, 'k': k}}) AS best FROM (SELECT r, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{turn}) GROUP BY r)")
        if turn < rounds:
            parts.append(f"s{turn} AS MATERIALIZED (SELECT k, i, sum(y) AS s, count(*) AS n FROM (SELECT best.k AS k, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{turn} JOIN v USING (r)) GROUP BY k, i)")
            parts.append(f"c{turn + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, old.c) AS c FROM c{turn} AS old LEFT JOIN (SELECT k, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{turn} GROUP BY k) AS m USING (k))")
    last = rounds
    return f"""WITH {", ".join(parts)}
SELECT vec_id, best.k::INT AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.k)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c, lambda e: e::VARCHAR), ',')) AS centroid_sha256
FROM a{last} JOIN v USING (r) JOIN c{last} ON k = best.k"""


ORACLE = _oracle()
