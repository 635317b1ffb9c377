"""Positions and running sums over all rows of a frame, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.sources.shared import staged


def placed(df: DataFrame, *order: Column, place: str = "place", sizes: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """df with place (0, 1, ... by order over all rows) and, for each of sizes, a column of that name: the sum over all earlier rows.

    Rows are dealt to ranges, sorted and numbered within, and written; the counts (and sums) of the ranges before are then added: one row
    a range reaches the driver. There are as many ranges as shuffle partitions unless `ranges` says otherwise. Ranges may split equal rows, so order should end in something that tells them apart if their places matter.
    """
    own, sizes = "_place", sizes or {}
    while any(c.startswith(own) for c in df.columns):
        own += "_"
    kinds = dict(df.select(*[c.alias(n) for n, c in sizes.items()]).dtypes) if sizes else {}
    rows = df
    for i, (name, c) in enumerate(sizes.items()):
        rows = rows.withColumn(f"{own}size{i}", c.cast("double" if kinds[name] in ("double", "float") else "long"))
    rows = rows.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order).withColumn(f"{own}at", F.monotonically_increasing_id())
    rows = staged(rows, "placed").withColumn(f"{own}range", F.shiftright(f"{own}at", 33)).withColumn(f"{own}row", F.col(f"{own}at").bitwiseAND(F.lit((1 << 33) - 1)))
    totals = [F.coalesce(F.sum(f"{own}size{i}"), F.lit(0)).alias(f"s{i}") for i in range(len(sizes))]
    found = sorted(tuple(r) for r in rows.groupBy(f"{own}range").agg(F.count("*").alias("n"), *totals).collect())
    starts, so_far = [], [0] * (1 + len(sizes))
    for part, *amounts in found:
        starts.append((part, *so_far))
        so_far = [a + b for a, b in zip(so_far, amounts, strict=True)]
    kind = lambda n: "double" if kinds[n] in ("double", "float") else "long"
    fixed = [(r[0], r[1], *(float(v) if kind(n) == "double" else v for v, n in zip(r[2:], sizes, strict=True))) for r in starts]
    ahead = df.sparkSession.createDataFrame(fixed, ", ".join([f"{own}range long", f"{own}n long", *(f"{own}s{i} {kind(n)}" for i, n in enumerate(sizes))]))
    out = rows.join(F.broadcast(ahead), f"{own}range").withColumn(place, F.col(f"{own}n") + F.col(f"{own}row"))
    w = Window.partitionBy(f"{own}range").orderBy(f"{own}row").rowsBetween(Window.unboundedPreceding, -1)  # one range, as one task sorted it
    for i, name in enumerate(sizes):
        out = out.withColumn(name, F.col(f"{own}s{i}") + F.coalesce(F.sum(f"{own}size{i}").over(w), F.lit(0)))
    return out.drop(*[f"{own}{c}" for c in ("at", "range", "row", "n")], *[f"{own}{c}{i}" for c in ("size", "s") for i in range(len(sizes))])
