"""Keyed upserts, sharded tables, listings and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.operators.order import placed


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by order: what repeated upserts leave."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """stored with incoming written over it; of one key the later row stays."""
    return latest(stored.unionByName(incoming, allowMissingColumns=True), keys, order)


def write_shards(df: DataFrame, path: str, partition_by: list[str], rows_per_file: int, mode: str = "append") -> None:
    """Parquet shards by partition columns, rolled at a row budget."""
    df.write.mode(mode).partitionBy(*partition_by).option("maxRecordsPerFile", rows_per_file).parquet(path)


def byte_shards(df: DataFrame, budget: int, size: Column, *order: Column) -> DataFrame:
    """df with shard (long), so that no shard's sizes sum to more than budget bytes: known before anything is written, equal in every run.

    A shard is a stretch of the order, cut where the running sum passes a multiple of the budget less the largest row. Rows of over half
    the budget have shards of their own, numbered -1, -2, ... by the order; only such a shard can exceed the budget.
    """
    rows = df.withColumn("_bytes", size.cast("long"))
    wide = F.col("_bytes") > budget // 2
    most = rows.filter(~wide).agg(F.max("_bytes")).first()[0] or 0
    usual = placed(rows.filter(~wide), *order, place="_place", sizes={"_before": F.col("_bytes")})
    usual = usual.withColumn("shard", F.floor(F.col("_before") / (budget - most)).cast("long")).drop("_place", "_before", "_bytes")
    alone = placed(rows.filter(wide), *order, place="_place").withColumn("shard", -1 - F.col("_place")).drop("_place", "_bytes")
    return usual.unionByName(alone)


def write_byte_shards(df: DataFrame, path: str, budget: int, size: Column, *order: Column, mode: str = "errorifexists") -> None:
    """Parquet below path, a folder shard=<n> with one file for each of byte_shards."""
    shards = byte_shards(df, budget, size, *order)
    shards.repartition("shard").write.mode(mode).partitionBy("shard").parquet(path)


def carry_forward(candidates: DataFrame, written: DataFrame, key: str, start: int | None = None, end: int | None = None, order: str | None = None) -> DataFrame:
    """Candidates that were not written before; with start and end, those whose order lies in that slice."""
    c = candidates if start is None else candidates.filter(F.col(order).between(start, end))
    return c.join(written.select(key).distinct(), key, "left_anti")


def alerts_since(alerts: DataFrame, since: str | None, limit: int) -> DataFrame:
    """The newest alerts (a top-k listing): by day, then id."""
    a = alerts if since is None else alerts.filter(F.col("day") >= F.lit(since).cast("date"))
    return a.orderBy(F.desc("day"), "alert_id").limit(limit)


def segments_of(segments: DataFrame, day: str, role: str) -> DataFrame:
    return segments.filter((F.col("day") == F.lit(day).cast("date")) & (F.col("role") == role))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.groupBy().agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows") for name, df in tables.items()])
