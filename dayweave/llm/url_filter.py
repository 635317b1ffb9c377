"""URL filters: host and path rules, then a character language-model ratio.

Two variable-order Markov models, one of accepted and one of rejected URLs, give each character a probability from its last three
characters, falling back to shorter contexts by the evidence each has (Witten-Bell). A URL's mean log-likelihood difference is held
against a threshold calibrated on URLs that were kept out of the counts. Accepted and rejected URLs are those that the rules decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.llm.common import table, unused

#: Rule list: (host and path, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Characters of the models: 0 is the start, 1 any other byte, then these; upper case counts as lower case, digits as one character.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_?=&#%:+~,;@!"
ORDER = 3
SIZE = len(ALPHABET) + 2
#: Every fifth URL by hash calibrates, the others are counted; scores are binned this finely between -BOUND and BOUND.
FOLDS, BINS, BOUND = 5, 4000, 20.0

_SYMBOL = np.ones(256, np.int64)
for _i, _c in enumerate(ALPHABET):
    _SYMBOL[ord(_c)] = _i + 2
    _SYMBOL[ord(_c.upper())] = _i + 2
for _c in "123456789":
    _SYMBOL[ord(_c)] = _SYMBOL[ord("0")]


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host_col: Column, path_col: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    name, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):  # a longer rule is asked first
        domain, _, rest = text.partition("/")
        fits = ((host_col == domain) | host_col.endswith(f".{domain}")) & path_col.startswith(f"/{rest}")
        name, says = F.when(fits, text).otherwise(name), F.when(fits, verdict).otherwise(says)
    return name, says


def _codes(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Context-and-character codes of all URLs, and the URL of each."""
    sizes = np.array([len(u) for u in urls], np.int64)
    padded = np.zeros(int(sizes.sum()) + ORDER * len(urls), np.int64)
    owner = np.repeat(np.arange(len(urls)), sizes)
    at = np.arange(int(sizes.sum())) + ORDER * (owner + 1)
    padded[at] = _SYMBOL[np.frombuffer(b"".join(urls), np.uint8)]
    code = np.zeros(len(at), np.int64)
    for back in range(ORDER, -1, -1):
        code = code * SIZE + padded[at - back]
    return code, owner


def _bytes(urls: pa.Array) -> list[bytes]:
    return [b"" if u is None else u for u in urls.cast(pa.binary()).to_pylist()]


def _count(batches):
    for rb in batches:
        labels = np.array([x == "allow" for x in rb.column(1).to_pylist()], bool)
        code, owner = _codes(_bytes(rb.column(0)))
        both, n = np.unique(code * 2 + labels[owner], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(n)], names=["code", "n"])


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Witten-Bell log-probabilities for every context of ORDER characters; counts[context..., character]."""
    p = np.full(SIZE, 1 / SIZE)
    for order in range(ORDER + 1):
        n = counts.reshape(-1, *[SIZE] * (order + 1)).sum(0)
        total, kinds = n.sum(-1, keepdims=True), (n > 0).sum(-1, keepdims=True)
        kinds = np.where(total > 0, kinds, 1)
        p = (n + kinds * p) / (total + kinds)
    return np.log(p)


def score_with(shared) -> Column:
    @F.arrow_udf("double")
    def score(urls: pa.Array) -> pa.Array:
        ratio = shared.value
        texts = _bytes(urls)
        code, owner = _codes(texts)
        total = np.bincount(owner, weights=ratio[code], minlength=len(texts))
        return pa.array(total / np.maximum(1, [len(t) for t in texts]), pa.float64())

    return score


def judged(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule, score (mean log-likelihood difference, above 0 likelier accepted) and verdict.

    Counts are gathered over all URLs that a rule decides (but the calibrating fifth) and summed by Spark; the models are dense tables
    of SIZE**4 numbers, 16.4 MB as floats (at most twice as many counts, 65.6 MB as doubles, in the driver) whatever the input. The threshold is the bin that best separates the calibrating URLs (mean of both
    rates; the middle of the best stretch). Without accepted or without rejected URLs every other URL is allowed. Null and odd URLs
    have empty host and path, no rule, and the score of their characters (0 if none). Columns of these names are replaced.
    """
    url = F.col(f"`{url_col}`")
    df = pages.withColumn("host", host(url)).withColumn("path", path(url))
    name, says = rule(F.col("host"), F.col("path"), rules)
    df = df.withColumn("rule", name)
    rules_say = f"{unused(df, '_rules')}say"
    df = df.withColumn(rules_say, says)
    spark = pages.sparkSession
    fold = F.pmod(F.xxhash64(url), F.lit(FOLDS))
    known = df.filter(F.col(rules_say).isNotNull()).select(url.alias("url"), F.col(rules_say).alias("says"), fold.alias("fold"))
    rows = known.filter("fold <> 0").select("url", "says").mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * SIZE ** (ORDER + 1))
    counts[rows["code"].to_numpy()] = rows["n"].to_numpy()
    counts = counts.reshape(-1, 2)
    both = counts.any(0).all()
    ratio = (log_probabilities(counts[:, 1].reshape(*[SIZE] * (ORDER + 1))) - log_probabilities(counts[:, 0].reshape(*[SIZE] * (ORDER + 1)))).astype(np.float32).ravel() if both else np.zeros(SIZE ** (ORDER + 1), np.float32)
    score = score_with(spark.sparkContext.broadcast(ratio))
    threshold = calibrated(known.filter("fold = 0").select("says", score("url").alias("score"))) if both else -BOUND
    return df.withColumn("score", score(url)).withColumn("verdict", F.coalesce(rules_say, F.when(F.col("score") >= threshold, "allow").otherwise("block"))).drop(rules_say)


def calibrated(scored: DataFrame) -> float:
    """The threshold with the best mean of accepted above it and rejected below it; 0 without both kinds."""
    bin_ = F.floor((F.least(F.greatest("score", F.lit(-BOUND)), F.lit(BOUND)) + BOUND) / (2 * BOUND) * (BINS - 1)).alias("bin")
    found = scored.groupBy(bin_, "says").count().collect()  # at most BINS rows of each kind
    n = {k: np.zeros(BINS) for k in ("allow", "block")}
    for r in found:
        n[r["says"]][r["bin"]] += r["count"]
    if not (n["allow"].any() and n["block"].any()):
        return 0.0
    below = lambda k: np.concatenate([[0], np.cumsum(n[k]) / n[k].sum()])
    good = below("block") - below("allow")
    best = np.flatnonzero(good == good.max())
    return float((best[0] + best[-1]) / 2 / (BINS - 1) * 2 * BOUND - BOUND)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every page's URL."""
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
