"""What several operators share: staged tables, byte-level word scanning, stable hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes scanned at a time, so that the temporary arrays of a scan stay small whatever a text's length.
SEGMENT_BYTES = 1 << 20
#: Text bytes that one block of documents gathers before it is processed.
BLOCK_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); local sessions without one get a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        found = tempfile.mkdtemp(prefix="dayweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, a written table's shuffle files go when its write ends: nothing reads them again, and the disk of a job is then its
    largest write and not the sum of all."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Like staged, as a table bucketed by a column, which later joins on that column read without an exchange."""
    unique = uuid.uuid4().hex
    saved = f"{name.replace('-', '_')}_{unique}"
    with shuffles_freed(df.sparkSession):
        df.write.format("parquet").bucketBy(buckets, column).option("path", f"{shared_dir(df.sparkSession)}/{name}-{unique}").saveAsTable(saved)
    return df.sparkSession.table(saved)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def unused(df: DataFrame, stem: str) -> str:
    """stem, with underscores added until no column of df begins with it: a prefix for columns of an operator's own."""
    while any(c.lower().startswith(stem) for c in df.columns):
        stem += "_"
    return stem


def keyed_by(df: DataFrame, *names: str) -> list[Column]:
    """The named columns, quoted, whatever other columns df has."""
    return [F.col(f"`{n}`") for n in names]


# ---- words of bytes -------------------------------------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POWER = U64(0x9E3779B97F4A7C15)
_powers = np.ones(1, U64)


def _power_table(n: int) -> np.ndarray:
    """Powers of the word-hash base, grown by doubling."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * _POWER)])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def scan_words(buf: np.ndarray, word_byte: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the maximal runs of bytes with word_byte[b]; fold maps bytes before hashing.

    Scans SEGMENT_BYTES at a time, cut between words; a single longer word is one segment.
    """
    starts, ends, hashes, at, n = [], [], [], 0, len(buf)
    while at < n:
        stop = min(n, at + SEGMENT_BYTES)
        inside = word_byte[buf[at:stop]]
        while stop < n and inside[-1]:
            gaps = np.flatnonzero(~inside)
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
                inside = inside[: stop - at]
            else:
                more = min(n, stop + SEGMENT_BYTES)
                inside = np.concatenate([inside, word_byte[buf[stop:more]]])
                stop = more
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            size = e - s
            held = buf[at:stop][inside]
            held = held if fold is None else fold[held]
            first = np.cumsum(size) - size
            place = np.arange(len(held), dtype=np.int64) - np.repeat(first, size)
            code = _BYTE_CODE[held] * _power_table(int(size.max()))[place]
            hashes.append(mix(np.add.reduceat(code, first) + size.astype(U64)))
            starts.append(s + at)
            ends.append(e + at)
        at = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def window_hashes(words: np.ndarray, k: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """A hash of every k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * U64(seed) + words[j : j + n]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - span : w - span + len(x) - w + 1]) if span < w else out


def anchors(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions chosen by winnowing: in every run of w values the (rightmost) least one."""
    if len(grams) < w or not len(grams):
        return np.zeros(0, np.int64)
    low = sliding_min(grams, w)
    chosen = np.zeros(len(grams), bool)
    left = np.ones(len(low), bool)
    for j in range(w - 1, -1, -1):
        hit = left & (grams[j : j + len(low)] == low)
        chosen[np.flatnonzero(hit) + j] = True
        left &= ~hit
        if not left.any():
            break
    return np.flatnonzero(chosen)


#: ASCII white space, space and 0x09 to 0x0D, ends a word; every other byte belongs to one.
SPACE_WORDS = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: Letters and digits of ASCII and every byte of a longer code point belong to a word.
ALNUM_WORDS = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: A-Z to a-z.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def utf8_column(values: pa.Array) -> list[bytes]:
    """The texts as bytes; null as empty."""
    return [b"" if x is None else x for x in values.cast(pa.large_binary()).to_pylist()]
