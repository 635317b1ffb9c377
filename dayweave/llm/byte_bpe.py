"""Byte-level BPE encoding and decoding: the tokenizers library over Arrow batches.

The tokenizer is built from a rank file. Bytes are mapped to printable characters (the byte table), every match of the split
pattern is merged on its own, and equal pieces of a batch are merged once. Decoding reverses the byte table, so that a character
whose bytes are split over several tokens comes back whole once its tokens are joined.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from dayweave.llm.common import table


#: Distinct pieces that a worker remembers between batches, and the longest that it keeps.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64


def byte_table() -> list[str]:
    """The character for each byte: printable Latin-1 bytes are themselves, the others follow from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


class ByteBpe:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, rank_file: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a task for each core
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        chars = byte_table()
        name = lambda token: "".join(chars[b] for b in token)
        merges = [(name(t[:i]), name(t[i:])) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = regex.compile(pattern).findall
        back = {c: b for b, c in enumerate(chars)}
        named = self.tokenizer.get_vocab()
        self.bytes_of = [b""] * (max(named.values()) + 1)
        for token, i in named.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        self.size_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.split(t) for t in texts]
        new = list({p for ps in pieces for p in ps} - self.known.keys())
        fresh = {p: np.array(e.ids, "<u4").tobytes() for at in range(0, len(new), 20_000) for p, e in zip(new[at : at + 20_000], self.tokenizer.encode_batch_fast(new[at : at + 20_000], add_special_tokens=False), strict=True)}
        if len(self.known) + len(fresh) > REMEMBERED:
            kept, self.known = self.known, {}
            known = kept | fresh
        else:
            self.known.update((p, i) for p, i in fresh.items() if len(p) <= REMEMBERED_CHARS)
            known = self.known | fresh if len(fresh) and max(map(len, fresh)) > REMEMBERED_CHARS else self.known
        of = known.__getitem__
        return [b"".join(map(of, ps)) for ps in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def char_offsets(self, ids: np.ndarray, text: bytes) -> np.ndarray:
        """First character of each token, and the text's length: a character split over tokens belongs to each of them."""
        ends = np.concatenate([[0], np.cumsum(self.size_of[ids])])
        lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(lead)])
        starts = before[ends]
        inside = (ends < len(text)) & ~np.concatenate([lead, [True]])[np.minimum(ends, len(text))]
        return starts - inside


@lru_cache(maxsize=4)
def bpe(rank_file: str, pattern: str) -> ByteBpe:
    return ByteBpe(rank_file, pattern)


def _in_parts(rb: pa.RecordBatch, text_col: str) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of a batch with about 4 MB of text each."""
    values = rb.column(rb.schema.get_field_index(text_col)).to_pylist()
    at = held = 0
    for i, t in enumerate(values):
        held += len(t or "")
        if held >= 4_000_000 or i + 1 == len(values):
            yield at, i + 1, [t or "" for t in values[at : i + 1]]
            at, held = i + 1, 0


def encode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """df with ids (array<int>), n_tokens and, if asked for, char_starts (array<int>, one more entry than ids).

    Null and empty texts have no ids. Repeated rows are encoded alike. No shuffle; any input column stays, so df must not have
    columns of these three names (raises ValueError).
    """
    added = "ids array<int>, n_tokens long" + (", char_starts array<int>" if with_offsets else "")
    if clash := {"ids", "n_tokens", "char_starts"} & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    out = df.sparkSession.createDataFrame([], added).schema
    schema = to_arrow_schema(type(df.schema)([*df.schema.fields, *out.fields]))

    def run(batches):
        coder = bpe(rank_file, pattern)
        for rb in batches:
            for a, b, texts in _in_parts(rb, text_col):
                coded = [np.frombuffer(x, "<u4") for x in coder.encode(texts)]
                cols = {n: rb.column(i).slice(a, b - a) for i, n in enumerate(rb.schema.names)}
                cols |= {"ids": pa.array([x.astype(np.int32) for x in coded], pa.list_(pa.int32())), "n_tokens": [len(x) for x in coded]}
                if with_offsets:
                    cols["char_starts"] = pa.array([coder.char_offsets(x, t.encode()).astype(np.int32) for x, t in zip(coded, texts, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in (cols[n] for n in schema.names)], names=schema.names)

    return df.mapInArrow(run, type(df.schema)([*df.schema.fields, *out.fields]))


def decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """df with decoded (binary): the bytes of the ids; null ids decode to no bytes; an id outside the vocabulary fails the job."""

    @F.pandas_udf("binary")
    def back(ids):
        coder = bpe(rank_file, pattern)
        return ids.map(lambda x: b"" if x is None else coder.decode(np.asarray(x)))

    return df.withColumn("decoded", back(F.col(f"`{ids_col}`")))


def round_trip(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256: encodes and decodes within one pass, so that ids don't travel.

    Null texts count as empty (no tokens, the hash of no bytes). Repeated rows give repeated rows. Other columns are ignored.
    """
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        coder = bpe(rank_file, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for rb in batches:
            for a, b, texts in _in_parts(rb, "text"):
                coded = coder.encode(texts)
                back = [coder.decode(np.frombuffer(x, "<u4")) for x in coded]
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array(map(sha, coded), pa.string()), pa.array(map(sha, back), pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every whole text of documents."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


__all__ = ["ByteBpe", "byte_table", "decode", "encode", "query", "round_trip"]
