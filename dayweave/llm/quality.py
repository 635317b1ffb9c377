"""Quality rules: a threshold table compiled into one Spark projection of length, symbol, stop-word and line ratios.

Only built-in functions; one narrow pass, nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.llm.common import table, unused

#: Frequent function words of English, French, German and Spanish, as written within a sentence.
STOP_WORDS = (
    "the of and to in is that for on with as by at from this be are was it or an not "
    "le la les de des du et en un une que qui dans pour par sur est au avec il elle "
    "der die das und ist von zu den dem im mit auf ein eine nicht sich für "
    "el los las del y se por con una al es su"
).split()
#: Measure, least and greatest value that is kept (None: unbounded).
THRESHOLDS = (
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.1),
    ("stop_word_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.5),
)
SPACES = r"[\x20\x09-\x0D]+"


def counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words and n_repeat_words (long).

    Null counts as empty: all zero. A line counts if it has a word. Columns of these names are replaced. Three-word windows are compared
    by 64-bit hashes within their own text.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")
    others = [F.col(f"`{c}`") for c in df.columns if c not in names]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = unused(df, "_own")
    words = F.array_remove(F.split(text, SPACES), "").alias(f"{own}words")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "").alias(f"{own}lines")
    one = df.select(*others, words, lines, (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"))
    w, held = F.col(f"{own}words"), F.col(f"{own}lines")
    grams = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))).alias(f"{own}grams")
    two = one.select(
        *others,
        "n_symbols",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(held).cast("long").alias("n_lines"),
        (F.size(held) - F.size(F.array_distinct(held))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        grams,
    )
    g = F.col(f"{own}grams")
    placed = F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias(f"{own}placed")
    three = two.select("*", placed)
    p = F.col(f"{own}placed")
    again = F.sort_array(F.filter(F.transform(p, lambda x, k: F.when((x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]), x["i"])), lambda i: i.isNotNull()))
    four = three.select("*", again.alias(f"{own}again"))
    r = F.col(f"{own}again")
    covered = F.aggregate(F.transform(r, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(r, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return four.select(*others, *names[:6], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def measures() -> dict[str, Column]:
    """The ratios that thresholds may name, from the columns of counts."""
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": part("word_chars", "n_words"),
        "symbol_ratio": part("n_symbols", "n_words"),
        "stop_word_ratio": part("n_stop_words", "n_words"),
        "dup_line_ratio": part("n_dup_lines", "n_lines"),
        "repeat_word_ratio": part("n_repeat_words", "n_words"),
    }


def compiled(thresholds=THRESHOLDS) -> Column:
    """Names of the rules that fail, as one array expression."""
    found = measures()
    broken = []
    for name, least, most in thresholds:
        if least is not None:
            broken.append(F.when(found[name] < least, f"{name} < {least:g}"))
        if most is not None:
            broken.append(F.when(found[name] > most, f"{name} > {most:g}"))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def assessed(df: DataFrame, text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """df with the counts, base_failed, failed_rules (names) and kept. Repeated rows are judged alike; an empty table stays empty."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts(df, text_col).withColumn("base_failed", base).withColumn("failed_rules", compiled(thresholds)).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return assessed(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *names)


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
c AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT k, count(DISTINCT i + o) AS n FROM c, (VALUES (0), (1), (2)) AS s(o) GROUP BY k),
l AS (SELECT k, count(*) AS n, count(DISTINCT line) AS n_distinct FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(l.n - l.n_distinct, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0) AS n_lines,
    len(list_filter(ws, lambda x: x IN ({_STOPS}))) AS n_stop_words
  FROM w LEFT JOIN r USING (k) LEFT JOIN l USING (k)
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 14 AND n_symbols / greatest(n_words, 1) <= 0.1
    AND n_stop_words / greatest(n_words, 1) >= 0.01 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept
FROM b
"""
