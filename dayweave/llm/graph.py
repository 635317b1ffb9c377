"""Connected components over links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayweave.llm.common import staged


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): every node of links (a, b), with the smallest node that it is connected to.

    Each round joins every node's larger neighbours to its smallest one and then every node's smaller neighbours likewise; rounds grow
    with the logarithm of the longest chain. Minima are taken by partial aggregation and written out, so that a hub's links never gather in
    one task: Spark splits a frequent key of a join whose other side is a written table, not of one with an aggregation. Links to oneself and repeated links do no harm; no links, no rows.
    """
    pairs = staged(links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before = None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "components-least")
        large = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = staged(large, "components-large")
        small_least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "components-least")
        small = large.join(small_least.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        pairs = staged(small, "components")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links are not settled after {most_rounds} rounds")
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
