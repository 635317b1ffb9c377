"""Target-distribution importance resampling over hashed word n-grams.

Words come from bytes: a 256-byte table lower-cases A-Z and blanks separators, bytes.split gives the words. A word's CRC-32 is the seed for
the word after it, so the hash of a run of words grows by one call a word. Counters reduce each partition to its buckets before anything
moves; the log-ratio of the smoothed bucket shares of target and source weighs every document, and Gumbel noise from a hash of
its id turns the greatest scores into a sample without replacement.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dayweave.llm.common import staged, table

BUCKETS, LONGEST, SEED = 10_000, 3, 42
#: Share of the documents with LEAST_WORDS words or more that is drawn, in hundredths.
PERCENT, LEAST_WORDS = 5, 20
#: Bytes whose words are held at a time, whatever a text's length.
SEGMENT = 1 << 20

#: A-Z to a-z; digits, letters and all bytes of longer code points are themselves; the rest is blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def hashed_runs(text: bytes, longest: int = LONGEST) -> Iterator[tuple[int, list[int]]]:
    """For each segment of a text its number of words and the CRC-32 of every run of 1 to longest words that ends in it."""
    text, at, before = text.translate(WORD_BYTES), 0, []
    while at < len(text):
        cut = text.find(b" ", at + SEGMENT)
        new = text[at : cut if cut >= 0 else len(text)].split()
        at = cut if cut >= 0 else len(text)
        words = before + new
        spaced = [b" " + w for w in words]
        codes, out = list(map(crc32, words)), []
        for n in range(longest):  # codes[i] is the hash of the run of n + 1 words that begins at word i
            if n:
                codes = list(map(crc32, spaced[n:], codes))
            out += codes[max(len(before) - n, 0) :]
        yield len(new), out
        before = words[-(longest - 1) :] if longest > 1 else []


def _buckets(codes: list[int]) -> np.ndarray:
    return np.array(codes, np.uint32) % BUCKETS


def _texts(column: pa.Array) -> Iterator[bytes]:
    for i in range(len(column)):
        yield column[i].as_py() or b""


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[int] = Counter()
    for rb in batches:
        for text in _texts(rb.column(0)):
            for _, codes in hashed_runs(text):
                found.update(_buckets(codes).tolist())
    yield pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.int32()), pa.array(list(found.values()), pa.int64())], names=["bucket", "n"])


def bucket_counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features in each bucket, over all texts of df: at most BUCKETS rows a task move, and BUCKETS rows reach the driver."""
    rows = df.select(F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(_tally, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of target and source, for each bucket."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: str, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of the hash of seed:key."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """id_col, n_words, n_features, weight and score (long), a row for each row of docs; texts go no further than the task that reads them."""
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("_key"), F.col(f"`{text_col}`").cast("binary").alias("_text"))
    kind = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight", "score"))])
    schema = to_arrow_schema(kind)
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            words, features, weights = [], [], []
            for text in _texts(rb.column(2)):
                n = m = weight = 0
                for count, codes in hashed_runs(text):
                    n, m, weight = n + count, m + len(codes), weight + int(shared.value[_buckets(codes)].sum())
                words.append(n)
                features.append(m)
                weights.append(weight)
            scores = [w + noise(k, seed) for w, k in zip(weights, rb.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rb.column(0).cast(schema[0].type), *(pa.array(x, pa.int64()) for x in (words, features, weights, scores))], schema=schema)

    return rows.mapInArrow(run, kind)


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id") -> DataFrame:
    """rows of scored with rank: 1, 2, ... for the drawn ones by falling score, then rising id (null first); null for all others.

    Ranges of (score, id) are sorted apart and numbered within; the sizes of the ranges before are added, so no task orders all rows,
    however many share a score.
    """
    spark = rows.sparkSession
    able = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col(f"`{id_col}`").asc_nulls_first(), F.col("n_features").asc(), F.col("weight").asc()]
    placed = rows.filter(able).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = staged(placed, "resampling-ranks").withColumn("_range", F.shiftright("_place", 33)).withColumn("_row", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted((r["_range"], r["count"]) for r in placed.groupBy("_range").count().collect())  # a row a range
    draw = percent * sum(n for _, n in sizes) // 100
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    starts = spark.createDataFrame(starts, "_range long, _before long")
    rank = F.col("_before") + F.col("_row") + 1
    drawn = placed.join(F.broadcast(starts), "_range").withColumn("rank", F.when(rank <= draw, rank))
    names = [F.col(f"`{c}`") for c in rows.columns]
    return drawn.select(*names, "rank").unionByName(rows.filter(~able).select(*names, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """id_col, n_words, n_features, weight, score and rank for every row of docs, the drawn ones ranked.

    Null texts have no words, no features and weight 0; a null id is hashed as an empty one; repeated rows are documents of their own,
    with equal weights and neighbouring ranks. An empty table of documents gives no rows; an empty target leaves the shares of the source
    alone to tell. Other columns are ignored; ValueError if id_col has the name of an output. docs is read twice and never moved.
    """
    if id_col in ("n_words", "n_features", "weight", "score", "rank"):
        raise ValueError(f"the id column cannot be named {id_col}")
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    return ranked(staged(scored(docs, gain, id_col, text_col, seed), "resampling-scores"), percent, least_words, id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document against all of the benchmark."""
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
