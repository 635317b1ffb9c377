"""SimHash near-duplicates with covering locality-sensitive hashing.

Each of the 64 bit positions is given a non-zero vector of r + 1 bits; table v (one for each non-zero v) compares the positions whose
vector has an odd inner product with v. At most r differing positions span at most r dimensions, so some v is orthogonal to all of
them: that table sees no difference, and every pair within radius r meets there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.llm.common import staged, table, utf8_column
from dayweave.llm.graph import components

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Distinct fingerprints of one bucket that a task compares at once; larger buckets are split by a second covering.
BUCKET_LIMIT = 2048
_EDGES = "a long, b long, mask long, fingerprint long, rep long"
_EDGE_SCHEMA = pa.schema([(n, pa.int64()) for n in ("a", "b", "mask", "fingerprint", "rep")])


def covering_masks(radius: int, bits: int = (1 << 64) - 1) -> list[int]:
    """Bit masks within `bits` of which, for every set of at most `radius` positions, one avoids the set."""
    places = [i for i in range(64) if bits >> i & 1]
    top = (1 << radius + 1) - 1
    code = {p: 1 + k % top for k, p in enumerate(places)}
    return [sum(1 << p for p in places if (code[p] & v).bit_count() & 1) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text as an unsigned integer."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z, and space with 0x09 to 0x0D
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashed = np.array([xxhash.xxh64_intdigest(g, seed) for g in grams], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 1 << 14):
        ones += np.unpackbits(hashed[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashed), bitorder="little").tobytes(), "little")


def simhash(text: Column) -> Column:
    """Fingerprints as signed 64-bit integers; null counts as empty."""
    return F.arrow_udf(_simhash, "long")(text)


def _simhash(texts: pa.Array) -> pa.Array:
    return pa.array([_signed(fingerprint(t)) for t in utf8_column(texts)], pa.int64())


def _forest(fps: np.ndarray, reps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that join what lies within the radius of each other, one for each member but the first of a group."""
    left = np.argsort(reps, kind="stable")
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= radius
            if near.any():
                met = left[near]
                left = left[~near]
                front.extend(met)
                yield from ((int(reps[x]), int(reps[y])) for y in met)


def _linker(radius: int, limit: int | None):
    """For rows sorted by bucket: links within each bucket; the rows of a bucket over the limit pass on instead."""

    def out(edges: list, over: list[np.ndarray]) -> pa.RecordBatch:
        a = np.array(edges, np.int64).reshape(-1, 2)
        rest = np.concatenate(over, axis=1) if over else np.zeros((3, 0), np.int64)
        null = lambda x, before, after: pa.array(np.concatenate([np.zeros(before, np.int64), x, np.zeros(after, np.int64)]), mask=np.concatenate([np.ones(before, bool), np.zeros(len(x), bool), np.ones(after, bool)]))
        return pa.RecordBatch.from_arrays([*(null(a[:, i], 0, rest.shape[1]) for i in (0, 1)), *(null(rest[i], len(a), 0) for i in range(3))], schema=_EDGE_SCHEMA)

    def run(batches):
        held: list[np.ndarray] = []
        size, key, flowing = 0, None, False
        for rb in batches:
            m, k, f, r = (rb.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(m):
                continue
            edges, over = [], []
            cut = np.flatnonzero((m[1:] != m[:-1]) | (k[1:] != k[:-1])) + 1
            bounds = np.concatenate([[0], cut, [len(m)]])
            rows = np.stack([m, f, r])
            for i in np.flatnonzero((np.diff(bounds) > 1) | (np.arange(len(bounds) - 1) == 0) | (np.arange(len(bounds) - 1) == len(bounds) - 2)).tolist():
                a, b = bounds[i], bounds[i + 1]
                if (m[a], k[a]) != key:
                    if size > 1 and not flowing:
                        all_ = np.concatenate(held, axis=1)
                        edges.extend(_forest(all_[1].view(np.uint64), all_[2], radius))
                    held, size, key, flowing = [], 0, (m[a], k[a]), False
                held.append(rows[:, a:b])
                size += b - a
                if flowing or limit and size > limit:
                    over.extend(held)
                    held, flowing = [], True
            if edges or over:
                yield out(edges, over)
        if size > 1 and not flowing:
            all_ = np.concatenate(held, axis=1)
            yield out(list(_forest(all_[1].view(np.uint64), all_[2], radius)), [])

    return run


def links(reps: DataFrame, radius: int = RADIUS, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) between representatives whose fingerprints differ in at most `radius` bits, enough to connect all such pairs.

    reps has one row per distinct fingerprint (fingerprint, rep). Tables are shuffled by masked bits; a bucket is compared in one task
    up to `limit` rows. The rows of larger buckets are dealt again by a covering of the bits that their mask leaves out: they agree in
    half of the bits already and then in half of the rest, which bounds the second buckets at 2**16 distinct rows.
    """
    masks = covering_masks(radius)
    dealt = reps.select(F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("t"), "fingerprint", "rep").select("t.mask", "t.key", "fingerprint", "rep")
    met = staged(dealt.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_linker(radius, limit), _EDGES), "simhash-links")
    found = met.filter("a is not null").select("a", "b")
    over = met.filter("fingerprint is not null").select("mask", "fingerprint", "rep")
    if over.isEmpty():
        return found
    inner = F.array(*[F.array(*[F.lit(_signed(x)) for x in covering_masks(radius, ~m & (1 << 64) - 1)]) for m in masks])
    again = (
        over.withColumn("mine", F.element_at(inner, F.col("mask").cast("int") + 1))
        .withColumn("outer", F.element_at(F.array(*[F.lit(_signed(m)) for m in masks]), F.col("mask").cast("int") + 1))
        .select("mask", "fingerprint", "rep", F.col("fingerprint").bitwiseAND(F.col("outer")).alias("key"), F.posexplode("mine").alias("second", "bits"))
        .select((F.col("mask") * 1000 + F.col("second")).alias("mask"), F.xxhash64("key", F.col("fingerprint").bitwiseAND(F.col("bits"))).alias("key"), "fingerprint", "rep")
    )
    return found.unionByName(again.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_linker(radius, None), _EDGES).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per document: id_col, fingerprint (long), component_id (the smallest id reachable over links, itself included).

    Equal fingerprints are linked and count once from there on, so copies never multiply. Null, empty and wordless texts have fingerprint
    zero and are linked like any other. Rows that share an id are one node. A row with a null id keeps its fingerprint and gets the
    component of the ids that share it, null if there are none. An empty table gives no rows; other columns are ignored.
    """
    marked = staged(docs.select(F.col(f"`{id_col}`").alias(id_col), simhash(F.col(f"`{text_col}`")).alias("fingerprint")), "simhash")
    ids = marked.filter(F.col(f"`{id_col}`").isNotNull())
    reps = staged(ids.groupBy("fingerprint").agg(F.min(f"`{id_col}`").cast("long").alias("rep")), "simhash-reps")
    shared = ids.groupBy(F.col(f"`{id_col}`").cast("long").alias("b")).agg(F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high")).filter("low <> high").select("b")
    same = ids.join(shared, ids[id_col] == shared.b).join(reps, "fingerprint").select(F.col("rep").alias("a"), "b")
    found = components(links(reps, radius, limit).unionByName(same))
    named = reps.join(found, reps.rep == found.node, "left").select("fingerprint", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(named, "fingerprint", "left").select(id_col, "fingerprint", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
