"""Splits by subject that cannot leak, and the errors that say so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayweave.operators.order import placed


class DegenerateSplit(ValueError):
    """A side of a split has no rows."""


class Leak(ValueError):
    """A subject stands on both sides of a split."""


def subject_split(rows: DataFrame, subject: str = "subject", share: float = 0.2, seed: str = "split") -> DataFrame:
    """A row a subject: n and part, validation for a share of the subjects by hash, at least one, else train. Null is a subject like any other."""
    key = F.coalesce(F.col(f"`{subject}`").cast("string"), F.lit(""))
    s = rows.groupBy(F.col(f"`{subject}`").alias(subject)).agg(F.count("*").alias("n"))
    ranked = placed(s, F.md5(F.concat(F.lit(f"{seed}|"), key)), key, place="_place")
    held = F.greatest(F.lit(1), F.floor(F.lit(s.count()) * share))
    return ranked.withColumn("part", F.when(F.col("_place") < held, "validation").otherwise("train")).drop("_place")


def checked(rows: DataFrame, part: str = "part", subject: str = "subject", sides: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """rows as they are; DegenerateSplit if a side has none, Leak (naming some) if a subject has rows of two sides. One aggregation."""
    s = rows.groupBy(F.col(f"`{subject}`").cast("string").alias("s")).agg(F.collect_set(F.col(f"`{part}`")).alias("parts"), *[F.count_if(F.col(f"`{part}`") == side).alias(f"n{i}") for i, side in enumerate(sides)])
    some = s.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(sides))], F.count_if(F.size("parts") > 1).alias("leaks"), F.min(F.when(F.size("parts") > 1, F.coalesce("s", F.lit("null")))).alias("example")).first()
    empty = [side for i, side in enumerate(sides) if not some[f"n{i}"]]
    if empty:
        raise DegenerateSplit(f"no rows in {', '.join(empty)}")
    if some.leaks:
        raise Leak(f"{some.leaks} subjects on more than one side, such as {some.example}")
    return rows


def partition_faults(rows: DataFrame, official: dict[str, tuple], part: str = "part", subject: str = "subject") -> DataFrame:
    """subject, fault of a split against the official one (side to its subjects): a subject on another side than its own; and, only where
    the rows cover every official subject, a side that isn't whole (subject null). No rows, if all is as it should be."""
    seen = rows.select(F.col(f"`{subject}`").alias("subject"), F.col(f"`{part}`").alias("part")).distinct()
    table = rows.sparkSession.createDataFrame([(s, side) for side, found in official.items() for s in found], f"subject {seen.schema['subject'].dataType.simpleString()}, official string")
    listed = f"array<{seen.schema['subject'].dataType.simpleString()}>"
    both = seen.join(F.broadcast(table), "subject", "left")  # the official subjects are some dozens
    stray = both.filter(F.col("official").isNotNull() & (F.col("part") != F.col("official")) & F.col("part").isin(*official)).select("subject", F.concat(F.lit("marked "), "part", F.lit(", is "), "official").alias("fault"))
    known = both.filter(F.col("official").isNotNull())
    whole = F.size(F.collect_set("subject")) == sum(map(len, official.values()))
    mine = lambda side: F.array_sort(F.collect_set(F.when(F.col("part") == side, F.col("subject"))))
    wrong = F.array_compact(F.array(*[F.when(mine(side) != F.array(*[F.lit(s) for s in sorted(found)]).cast(listed), F.lit(side)) for side, found in official.items()]))
    sides = known.agg(F.when(whole, wrong).alias("w")).select(F.explode("w").alias("side"))
    return stray.unionByName(sides.select(F.lit(None).cast(seen.schema["subject"].dataType).alias("subject"), F.concat(F.lit("not all of "), "side").alias("fault")))
