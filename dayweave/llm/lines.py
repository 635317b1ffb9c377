"""Line dedup by content-defined chunks.

A rolling hash over the hashes of the last two lines chooses chunk ends, so that the same lines are cut alike wherever they stand in a
document. Chunks of several lines that occur again anywhere are compared byte by byte, and all but the first occurrence are removed.
The query and the pipeline use `without_repeated_passages`, which cuts at local minima, so that no chunk of a longer text has one line, and
compares long lines by themselves too; `without_repeated_chunks` cuts at multiples and leaves chunks of one line alone. Built-in functions
throughout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.functions.arrays import let
from dayweave.llm.common import staged, table, unused

#: A chunk ends where the rolling hash is a multiple of this: the mean number of lines of a chunk.
MEAN_LINES = 3
#: Weight of the line before in the rolling hash.
WEIGHT = 1_000_003
#: Words from which a line is a passage by itself (the window of operators 3 and 7).
LONG_LINE = 13
SPACE = " \t\n\x0b\x0c\r"


def line_hash(line: Column) -> Column:
    """28 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _unit(lines: Column, begin: Column, n: Column) -> Column:
    """Struct of k (first line), n_lines and chunk (the lines joined)."""
    return F.struct(begin.alias("k"), n.alias("n_lines"), F.array_join(F.slice(lines, begin + 1, n), "\n").alias("chunk"))


def _chunks(lines: Column, ends: Column) -> Column:
    """The chunks of two lines or more that are not blank; ends has the index of each chunk's last line."""

    def one(end, j):
        before = F.coalesce(F.get(ends, j - 1), F.lit(-1))
        return _unit(lines, before + 1, end - before)

    return F.filter(F.transform(ends, one), lambda c: (c["n_lines"] > 1) & (F.btrim(c["chunk"], F.lit(SPACE)) != ""))


def _at_multiples(df: DataFrame, mean_lines: int) -> DataFrame:
    """df with _units: the chunks that end where the rolling hash is a multiple of mean_lines."""
    df = df.withColumn("_lines", F.split("_text", "\n", -1))
    df = df.withColumn("_hashes", F.transform("_lines", line_hash))
    h, last = F.col("_hashes"), F.size("_lines") - 1
    rolled = F.transform(h, lambda x, i: F.when((i == last) | ((x + WEIGHT * F.coalesce(F.get(h, i - 1), F.lit(0))) % mean_lines == 0), i))
    df = df.withColumn("_ends", F.array_compact(rolled))
    return df.withColumn("_units", _chunks(F.col("_lines"), F.col("_ends")))


def _at_minima(df: DataFrame) -> DataFrame:
    """df with _units: chunks of two lines or more, and each long line.

    A chunk ends where the rolling hash is less than at the line before and no greater than at the next one, neither at the first line nor
    at the last but one: two neighbours cannot both be ends, so a text of two lines or more has no chunk of one line.
    """
    df = df.withColumn("_lines", F.split("_text", "\n", -1))
    df = df.withColumn("_hashes", F.transform("_lines", line_hash))
    # A large odd factor and a prime spread the sum, whose order would otherwise be that of the line before.
    h = F.col("_hashes")
    df = df.withColumn("_rolled", F.transform(h, lambda x, i: ((x + WEIGHT * F.coalesce(F.get(h, i - 1), F.lit(0))) % 2147483647) * 1103515245 % 2147483647))
    r, lines, last = F.col("_rolled"), F.col("_lines"), F.size("_lines") - 1
    valley = lambda x, i: (i > 0) & (i < last - 1) & (x < F.get(r, i - 1)) & (x <= F.get(r, i + 1))
    df = df.withColumn("_ends", F.array_compact(F.transform(r, lambda x, i: F.when((i == last) | F.coalesce(valley(x, i), F.lit(False)), i))))
    long = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("k"), F.lit(1).alias("n_lines"), x.alias("chunk"))), lambda c: (F.length(c["chunk"]) >= 2 * LONG_LINE - 1) & (F.size(F.split(F.btrim(c["chunk"], F.lit(SPACE)), f"[{SPACE}]+")) >= LONG_LINE))
    return df.withColumn("_units", F.concat(_chunks(lines, F.col("_ends")), long))


def _repeats(keyed: DataFrame, units: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """_id, _row, k and n_lines of the units of keyed (_id, _row, _text) that occur before.

    Hashes find the units worth comparing; the texts that hold one are then moved once to cut those units out, and these are compared byte
    by byte.
    """
    # Written tables on the other side of a join leave Spark free to split a frequent key's rows; an aggregation there would not. The hints
    # keep one plan at every size. Outer explodes: for an inner one Spark infers a filter on the array and so cuts the text anew.
    hashed = F.transform("_units", lambda u: F.struct(u["k"].alias("k"), u["n_lines"].alias("n_lines"), F.xxhash64(u["chunk"]).alias("h")))
    all_units = staged(units(keyed).select("_id", "_row", F.explode_outer(hashed).alias("u")).filter("u is not null").select("_id", "_row", "u.*"), "line-units")
    often = staged(all_units.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "line-often")
    asked = all_units.join(often.hint("merge"), "h", "left_semi").groupBy(F.col("_id").alias("a_id"), F.col("_row").alias("a_row")).agg(F.collect_set(F.struct("k", "n_lines", "h")).alias("_asked"))
    asked = staged(asked, "line-asked")
    found = keyed.join(asked.hint("merge"), keyed["_id"].eqNullSafe(asked["a_id"]) & (keyed["_row"] == asked["a_row"]))
    cut = let(F.split("_text", "\n", -1), lambda lines: F.transform("_asked", lambda u: F.struct(u["h"].alias("h"), _unit(lines, u["k"], u["n_lines"]).alias("u"))))
    met = staged(found.select("_id", "_row", F.explode_outer(cut).alias("c")).select("_id", "_row", "c.h", "c.u.*"), "line-chunks")
    first = met.groupBy("h", "chunk").agg(F.min(F.struct("_id", "_row", "k")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = staged(first.select("h", "chunk", "first.*").toDF("h", "chunk", "f_id", "f_row", "f_k"), "line-first")
    return met.join(first.hint("merge"), ["h", "chunk"]).filter(~(F.col("_id").eqNullSafe(F.col("f_id")) & (F.col("_row") == F.col("f_row")) & (F.col("k") == F.col("f_k"))))


def _without(docs: DataFrame, id_col: str, text_col: str, units: Callable[[DataFrame], DataFrame]) -> DataFrame:
    raw = F.col(f"`{text_col}`")
    row = F.xxhash64(F.col(f"`{id_col}`"), raw)
    keyed = docs.select(F.col(f"`{id_col}`").alias("_id"), row.alias("_row"), raw.alias("_text")).filter("_text is not null")
    gone = _repeats(keyed, units).groupBy(F.col("_id").alias("g_id"), F.col("_row").alias("g_row")).agg(F.collect_set(F.struct("k", "n_lines")).alias("_gone"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines", "n_removed_long_lines")]
    own = unused(docs, "_cut")
    my_row, my_lines, my_stay, g_id, g_row, my_gone = (f"{own}{c}" for c in ("row", "lines", "stay", "g_id", "g_row", "gone"))
    gone = gone.toDF(g_id, g_row, my_gone)
    marked = docs.select(*[F.col(f"`{c}`") for c in names], row.alias(my_row))
    joined = marked.join(gone.hint("merge"), marked[f"`{id_col}`"].eqNullSafe(gone[g_id]) & (marked[my_row] == gone[g_row]), "left").drop(g_id, g_row, my_row)
    cut = joined.withColumn(my_lines, F.split(raw, "\n", -1))
    lines, some = F.col(my_lines), F.col(my_gone).isNotNull()
    # array_except hashes: linear in the lines of a text.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.flatten(F.transform(my_gone, lambda g: F.sequence(g["k"], g["k"] + g["n_lines"] - 1))))
    cut = cut.withColumn(my_stay, F.when(some, stay))
    text = F.when(some, F.array_join(F.transform(my_stay, lambda i: F.get(lines, i)), "\n")).otherwise(raw)
    columns = [text.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in names]
    n = F.coalesce(F.size(my_lines), F.lit(0)).cast("long")
    removed = F.when(some, n - F.size(my_stay)).otherwise(F.lit(0)).cast("long")
    chunks = F.filter(my_gone, lambda g: g["n_lines"] > 1)
    by_chunk = F.size(F.array_distinct(F.flatten(F.transform(chunks, lambda g: F.sequence(g["k"], g["k"] + g["n_lines"] - 1)))))
    alone = F.when(some, removed - by_chunk).otherwise(F.lit(0)).cast("long")
    return cut.select(*columns, n.alias("n_lines"), removed.alias("n_removed_lines"), alone.alias("n_removed_long_lines"))


def without_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean_lines: int = MEAN_LINES) -> DataFrame:
    """docs with text_col shortened, and n_lines, n_removed_lines and n_removed_long_lines (long; columns of these names are replaced); the
    last is 0 here.

    The occurrence with the smallest id, then the earliest in its document, stays (null ids come first). Only chunks of two lines or
    more with a character other than white space are compared. Rows that agree in id and text (by 64 bits of hash) are one document and treated alike. Null
    text stays null, with no lines; a text whose chunks all go becomes empty. Only hashes are moved to find repeats; texts are moved once
    to compare them and once to apply the result, by keys that Spark can split when skewed.
    """
    return _without(docs, id_col, text_col, lambda df: _at_multiples(df, mean_lines))


def without_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs like without_repeated_chunks, but nothing is left alone for standing in a chunk of one line or at the edge of a chunk.

    A line goes if its chunk (two lines or more) or, from LONG_LINE words on, the line itself occurs before. Every distinct line stays
    where it first occurs. Shorter repeated lines stay unless all of their chunk repeats. n_removed_long_lines counts the removed lines that
    no repeated chunk holds: those that only the comparison of single lines found.
    """
    return _without(docs, id_col, text_col, _at_minima)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document."""
    return without_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed_lines", "n_removed_long_lines", "text")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM d WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l),
x AS (SELECT *, (h + {WEIGHT} * coalesce(lag(h) OVER w, 0)) % 2147483647 * 1103515245 % 2147483647 AS x FROM h WINDOW w AS (PARTITION BY r ORDER BY i)),
b AS (SELECT *, i = n OR (i > 1 AND i < n - 1 AND x < lag(x) OVER w AND x <= lead(x) OVER w) AS ends FROM x WINDOW w AS (PARTITION BY r ORDER BY i)),
c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b),
u AS (SELECT r, doc_id, min(i) AS a, max(i) AS z, string_agg(line, chr(10) ORDER BY i) AS unit FROM c GROUP BY r, doc_id, k HAVING count(*) > 1
  UNION ALL SELECT r, doc_id, i, i, line FROM l WHERE len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\x0C\\r]+')) >= {LONG_LINE}),
o AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id NULLS FIRST, a) > 1 AS again FROM u WHERE regexp_matches(unit, '[^ \\t\\n\\x0B\\x0C\\r]')),
g AS (SELECT r, i, true AS gone, bool_or(chunk) AS chunk FROM (SELECT r, unnest(range(a, z + 1)) AS i, z > a AS chunk FROM o WHERE again) GROUP BY r, i)
SELECT d.doc_id, count(l.i) AS n_lines, count(g.gone) AS n_removed_lines, count(g.gone) FILTER (WHERE NOT g.chunk) AS n_removed_long_lines,
  CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE gone IS NULL), '') END AS text
FROM d LEFT JOIN l USING (r) LEFT JOIN g ON g.r = l.r AND g.i = l.i GROUP BY d.r, d.doc_id
"""
#: SQL of without_repeated_chunks.
CHUNKS_ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l),
b AS (SELECT *, (h + {WEIGHT} * coalesce(lag(h) OVER w, 0)) % {MEAN_LINES} = 0 OR lead(i) OVER w IS NULL AS ends FROM h WINDOW w AS (PARTITION BY r ORDER BY i)),
c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b),
g AS (SELECT r, doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM c GROUP BY r, doc_id, k),
m AS (SELECT *, n > 1 AND regexp_matches(chunk, '[^ \\t\\n\\x0B\\x0C\\r]') AND row_number() OVER (PARTITION BY chunk, n > 1 ORDER BY doc_id, k) > 1 AS gone FROM g)
SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_lines, coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS n_removed_lines,
  CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') END AS text
FROM d LEFT JOIN m USING (r) GROUP BY r, d.doc_id
"""
