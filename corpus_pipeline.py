"""A corpus pipeline of five operators; each stage is written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.llm import byte_bpe, lines, simhash, toxicity, winnowing
from dayweave.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject, unchanged. Null and empty texts are scored as empty; equal texts score alike, so
    ties and repeated rows stay or go together; columns named like the score are not touched."""
    net = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.scorer(spark, net)(F.col("text")) < 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines and long lines that occur before; n_chars follows the text.

    Rows that agree in id and text are one document and are cut alike; null texts stay null, with their n_chars. Of equal chunks the one
    with the smallest id stays, null ids first, then the earliest in its document.
    """
    out = lines.without_repeated_passages(docs)
    return out.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; documents without an id stay.

    Rows that share an id are one document of the groups and stay or go together. Of those that agree in text too, the one whose other
    columns are least stays (nulls come first); rows of one id with different texts all stay.
    """
    stay = simhash.near_duplicates(docs).filter("doc_id = component_id").select("doc_id").distinct()
    rest = F.min(F.struct(*[f"`{c}`" for c in docs.columns if c not in ("doc_id", "text")]))
    known = docs.filter("doc_id is not null").join(stay, "doc_id", "left_semi").groupBy("doc_id", "text").agg(rest.alias("_rest")).select("doc_id", "text", "_rest.*")
    return known.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows, unchanged, repeated rows included. Null and
    wordless texts stay."""
    found = winnowing.contamination(docs, table(spark, sf_dir, "benchmark"), into="_contamination")
    return found.filter(~winnowing.verdict(F.col("_contamination"))[1]).select(*docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document, repeated rows included: token counts, and digests of the ids and of the decoded bytes; null counts as empty."""
    import public_tokenizers

    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenized),
]

#: Trained scores, XXH64 and token merges are beyond SQL; tests hold run()'s rows against a plain chain of the five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
