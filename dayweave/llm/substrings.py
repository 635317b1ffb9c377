"""Substring dedup by level-wise doubling.

Windows of 4 words are looked up first, and only where all of them are repeated in another document are windows of about twice the length
tried, up to the length asked for or until no candidate survives. Of the windows of one level, those are looked up that hold the least
hash of a window of the next length (winnowing: every copy of the longer window has the same least hash, so nothing is lost; at 4 words it
looks up 0.40 windows a word instead of 1).

Texts are written once, in blocks, as a table bucketed by groups of blocks; what moves after that are hashes and answers. A group sends the
window hashes of its blocks packed by hash range, and the range's task answers which of them another document has (on the way up), or,
with one bit each, a document with a smaller id (at the last level).
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.llm.common import BLOCK_BYTES, SPACE_WORDS, U64, bucketed, scan_words, sliding_min, staged, table, utf8_column, window_hashes

WINDOW, SHORTEST = 13, 4
#: Bytes of text for each hash range up to MANY_RANGES of them; beyond, ranges grow in number and in size with the root of the input.
RANGE_BYTES, MANY_RANGES = 16 << 20, 4096
#: Blocks of a group, bytes of hashes that a group packs at a time, and bytes of text for each bucket.
GROUP_BLOCKS, PACK_BYTES, BUCKET_BYTES, MOST_BUCKETS = 8, 32 << 20, 32 << 20, 65_536
SECOND = 0x9FB21C651E98DF25
NONE = U64(0xFFFFFFFFFFFFFFFF)
#: Bits dropped of hashes that are asked for, and of those answered, on the way up: chance hits there cost a look-up and change nothing.
ASK_DROPS, ANSWER_DROPS = U64(16), U64(28)

_BLOCK = "grp long, seq int, ids binary, nulls binary, sizes binary, text binary"
_PACKED = "shard long, grp long, blocks binary, keys binary, more binary, least binary"
_ANSWER = "grp long, shard long, blocks binary, data binary"
_DONE = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in ddl.split(", "))])


def levels(window: int = WINDOW, shortest: int = SHORTEST) -> list[int]:
    """Window lengths, each at most twice the one before: halves of the last, rounded up, down to `shortest` or less."""
    out = [window]
    while out[0] > shortest:
        out.insert(0, -(-out[0] // 2))
    return out


def ranges(text_bytes: int, range_bytes: int = RANGE_BYTES) -> int:
    """Hash ranges for so much text. Rows of packed hashes are groups times ranges: at 50 GB of text some 1,000 hashes a row, at 100 TB 20."""
    units = max(1, -(-text_bytes // range_bytes))
    return min(units, math.isqrt(units * MANY_RANGES))


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _opened(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: the high bytes of small or close numbers are all alike."""
    return _squeeze(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(_opened(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=U64(0)))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, U64), dtype=U64)


class Block:
    """Documents of a block with their words hashed."""

    def __init__(self, r: dict):
        self.ids = np.frombuffer(r["ids"], np.int64)
        self.nulls = np.unpackbits(np.frombuffer(r["nulls"], np.uint8))[: len(self.ids)].astype(bool)
        self.text = _opened(r["text"])
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(r["sizes"], np.int64) + 1)])
        s, _, self.h = scan_words(np.frombuffer(self.text, np.uint8), SPACE_WORDS)
        self.owner = (np.searchsorted(self.starts, s, "right") - 1).astype(np.int32)
        self.n_words = np.bincount(self.owner, minlength=len(self.ids)).astype(np.int64)
        self.first = np.cumsum(self.n_words) - self.n_words

    def whole(self, length: int) -> np.ndarray:
        """For every window of that length, whether it lies within one document that has an id."""
        n = max(0, len(self.h) - length + 1)
        return (self.owner[:n] == self.owner[length - 1 :]) & ~self.nulls[self.owner[:n]]

    def least(self, length: int, longer: int) -> np.ndarray:
        """For every window of the longer length the least hash of the shorter windows in it."""
        grams = window_hashes(self.h, length)
        return sliding_min(grams, longer - length + 1) if len(self.h) >= longer else np.zeros(0, U64)

    def candidates(self, steps: list[int], k: int, known: np.ndarray | None) -> np.ndarray:
        """Windows of level k that may be repeated, by the answers of the level before."""
        ok = self.whole(steps[k])
        if k and len(ok):
            at = np.flatnonzero(ok)
            ok[at] = _among(self.least(steps[k - 1], steps[k])[at] >> ANSWER_DROPS, known)
        return ok


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which x are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _runs(x: np.ndarray, n: int) -> np.ndarray:
    """Where n flags in a row are set."""
    count = np.concatenate([[0], np.cumsum(x)])
    return count[n:] - count[:-n] == n


class Entries:
    """The distinct windows that a block asks for at level k: sorted keys with the least and greatest id of the documents that have each."""

    def __init__(self, b: Block, steps: list[int], k: int, known: np.ndarray | None):
        ok = b.candidates(steps, k, known)
        if k + 1 == len(steps):
            self.at = np.flatnonzero(ok)
            key = window_hashes(b.h, steps[k])[self.at]
            more = (window_hashes(b.h, steps[k], SECOND)[self.at] >> U64(32)).astype(np.uint32)
        else:
            longer = b.whole(steps[k + 1])
            if k and len(longer):
                longer &= _runs(ok, steps[k + 1] - steps[k] + 1)
            low = b.least(steps[k], steps[k + 1])
            new = longer.copy()
            new[1:] &= (low[1:] != low[:-1]) | (b.owner[1 : len(low)] != b.owner[: max(0, len(low) - 1)]) | ~longer[:-1]
            self.at = np.flatnonzero(new)
            key, more = low[self.at] >> ASK_DROPS << ASK_DROPS, np.zeros(len(self.at), np.uint32)
        order = np.lexsort((more, key))
        key, more, ids = key[order], more[order], b.ids[b.owner[self.at]][order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
        begin = np.flatnonzero(new)
        self.key, self.more = key[begin], more[begin]
        self.least = np.minimum.reduceat(ids, begin) if len(begin) else ids
        self.most = np.maximum.reduceat(ids, begin) if len(begin) else ids
        self.group = np.empty(len(self.at), np.int64)
        self.group[order] = np.cumsum(new) - 1

    def cuts(self, shards: int) -> np.ndarray:
        """Where each hash range begins among the keys."""
        bounds = np.array([(k << 64) // shards for k in range(1, shards)], U64)
        return np.concatenate([[0], np.searchsorted(self.key, bounds, "left"), [len(self.key)]])


class Packer:
    """Rows of packed keys, one for each hash range, of a group's blocks."""

    def __init__(self, shards: int, last: bool):
        self.shards, self.last, self.held, self.size = shards, last, [], 0

    def add(self, seq: int, entries: Entries) -> None:
        self.held.append((seq, entries, entries.cuts(self.shards)))
        self.size += 24 * len(entries.key)

    def rows(self, grp: int):
        held, self.held, self.size = self.held, [], 0
        if not held:
            return
        counts = np.stack([np.diff(cuts) for *_, cuts in held])
        for k in np.flatnonzero(counts.sum(0)).tolist():
            parts = [(seq, e, slice(cuts[k], cuts[k + 1])) for seq, e, cuts in held if cuts[k] < cuts[k + 1]]
            blocks = np.array([(seq, cut.stop - cut.start) for seq, _, cut in parts], np.int32)
            row = {"shard": k, "grp": grp, "blocks": blocks.tobytes(), "keys": _packed_keys(np.concatenate([e.key[cut] >> (U64(0) if self.last else ASK_DROPS) for _, e, cut in parts]))}
            if self.last:
                yield row | {"more": _pack(np.concatenate([e.more[cut] for _, e, cut in parts])), "least": _pack(np.concatenate([e.least[cut] for _, e, cut in parts]))}
            else:
                yield row | {"more": _squeeze(np.packbits(np.concatenate([e.least[cut] != e.most[cut] for _, e, cut in parts])).tobytes())}


def _batch(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in schema.names}, schema=schema)


def _gathered(rows, schema: pa.Schema, most: int = 16 << 20):
    """Batches of about `most` bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + sum(len(v) for v in r.values() if isinstance(v, bytes | str))
        if size >= most or len(held) >= 20_000:
            yield _batch(schema, held)
            held, size = [], 0
    if held:
        yield _batch(schema, held)


def _to_blocks(batches):
    def block(ids, texts):
        nulls = np.array([i is None for i in ids])
        return {"ids": np.array([i or 0 for i in ids], np.int64).tobytes(), "nulls": np.packbits(nulls).tobytes(), "sizes": np.array([len(t) for t in texts], np.int64).tobytes(), "text": _squeeze(b"\n".join(texts))}

    def blocks():
        ids, texts, size = [], [], 0
        for rb in batches:
            for i, t in zip(rb.column(0).to_pylist(), utf8_column(rb.column(1)), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t) + 1
                if size >= BLOCK_BYTES:
                    yield block(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield block(ids, texts)

    def numbered():
        for n, b in enumerate(blocks()):
            if n % GROUP_BLOCKS == 0:
                grp = uuid.uuid4().int >> 65
            yield b | {"grp": grp, "seq": n % GROUP_BLOCKS}

    yield from _gathered(numbered(), _schema(_BLOCK))


def _known(answers: list[dict] | None) -> np.ndarray:
    return np.unique(np.concatenate([_unpacked_keys(a["data"]) for a in answers])) if answers else np.zeros(0, U64)


def _ask(steps: list[int], k: int, shards: int):
    """For blocks with the answers of the level before: packed keys of level k."""
    last = k + 1 == len(steps)

    def rows(batches):
        packer, grp, known = Packer(shards, last), None, None
        for rb in batches:
            for r in rb.to_pylist():
                if r["grp"] != grp:
                    yield from packer.rows(grp)
                    grp, known = r["grp"], _known(r.get("before"))
                packer.add(r["seq"], Entries(Block(r), steps, k, known))
                if packer.size >= PACK_BYTES:
                    yield from packer.rows(grp)
        yield from packer.rows(grp)

    return lambda batches: _gathered(rows(batches), _schema(_PACKED))


def _answer(last: bool):
    """For packed rows sorted by shard: the repeated keys of each, or at the last level a bit for each of its keys."""

    def shard_rows(shard: int, rows: list[dict]):
        keys = [_unpacked_keys(r["keys"]) for r in rows]
        sizes = np.array([len(k) for k in keys])
        key = np.concatenate(keys)
        if last:
            more, least = np.concatenate([_unpack(r["more"], np.uint32) for r in rows]), np.concatenate([_unpack(r["least"], np.int64) for r in rows])
        else:
            more, least = np.zeros(len(key), np.uint32), np.concatenate([np.unpackbits(np.frombuffer(_opened(r["more"]), np.uint8))[:n] for r, n in zip(rows, sizes.tolist(), strict=True)])
        order = np.lexsort((more, key))
        new = np.ones(len(key), bool)
        new[1:] = (np.diff(key[order]) != 0) | (np.diff(more[order]) != 0)
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        bit = np.empty(len(key), bool)
        if last:
            bit[order] = np.minimum.reduceat(least[order], begin)[group] < least[order]
        else:
            bit[order] = ((np.diff(begin, append=len(key)) > 1) | (np.maximum.reduceat(least[order], begin) > 0))[group]
        ends = np.cumsum(sizes)
        for r, own, a, b in zip(rows, keys, (ends - sizes).tolist(), ends.tolist(), strict=True):
            found = bit[a:b]
            if found.any():
                yield {"grp": r["grp"], "shard": shard, "blocks": r["blocks"] if last else None, "data": _squeeze(np.packbits(found).tobytes()) if last else _packed_keys(np.unique(own[found] >> (ANSWER_DROPS - ASK_DROPS)))}

    def rows(batches):
        held, shard = [], None
        for rb in batches:
            for r in rb.to_pylist():
                if held and r["shard"] != shard:
                    yield from shard_rows(shard, held)
                    held = []
                shard = r["shard"]
                held.append(r)
        if held:
            yield from shard_rows(shard, held)

    return lambda batches: _gathered(rows(batches), _schema(_ANSWER))


def _marked(seq: int, cuts: np.ndarray, n: int, answers: list[dict]) -> np.ndarray:
    """The bits that answer a block's keys at the last level."""
    out = np.zeros(n, bool)
    for a in answers:
        blocks = np.frombuffer(a["blocks"], np.int32).reshape(-1, 2)
        mine = np.flatnonzero(blocks[:, 0] == seq)
        if len(mine):
            begin = int(blocks[: mine[0], 1].sum())
            out[cuts[a["shard"]] : cuts[a["shard"] + 1]] = np.unpackbits(np.frombuffer(_opened(a["data"]), np.uint8))[begin : begin + int(blocks[mine[0], 1])]
    return out


def _finish(steps: list[int], shards: int, with_text: bool):
    """For blocks with the answers of the last two levels: one row per document."""

    def rows(batches):
        grp, known = None, None
        for rb in batches:
            for r in rb.to_pylist():
                if r["grp"] != grp:
                    grp, known = r["grp"], _known(r.get("before"))
                b = Block(r)
                e = Entries(b, steps, len(steps) - 1, known)
                bit = _marked(r["seq"], e.cuts(shards), len(e.key), r["answers"] or [])
                at = e.at[bit[e.group] | (b.ids[b.owner[e.at]] > e.least[e.group])]
                yield from documents(b, _covered(len(b.h), at, steps[-1]))

    def documents(b: Block, gone: np.ndarray):
        removed = np.bincount(b.owner[gone], minlength=len(b.ids))
        for d in range(len(b.ids)):
            words = b.text[b.starts[d] : b.starts[d + 1] - 1].split()
            if removed[d]:
                f = b.first[d]
                words = [w for w, g in zip(words, gone[f : f + b.n_words[d]].tolist(), strict=True) if not g]
            kept = b" ".join(words)
            yield {"doc_id": None if b.nulls[d] else int(b.ids[d]), "n_words": int(b.n_words[d]), "n_removed": int(removed[d]), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept.decode() if with_text else None}

    return lambda batches: _gathered(rows(batches), _schema(_DONE))


def _covered(n: int, at: np.ndarray, length: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:n]) > 0


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, with_text, kept (the words left, joined by spaces).

    A word goes if a window of `window` words over it also starts in a document with a smaller id. Windows are compared by 96 bits of
    hash. Ids are integers; rows that share an id don't remove each other's words and repeated rows are treated alike. Rows with a null id are neither
    compared nor cut. Null and short texts lose nothing. Other columns are ignored; an empty table gives no rows.
    """
    steps = levels(window)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards, buckets = ranges(size, range_bytes), min(MOST_BUCKETS, max(1, -(-size // BUCKET_BYTES)))
    blocks = bucketed(rows.mapInArrow(_to_blocks, _BLOCK), "substring-blocks", "grp", buckets)
    asked, before, answers = blocks, None, None
    for k in range(len(steps)):
        last = k + 1 == len(steps)
        packed = asked.mapInArrow(_ask(steps, k, shards), _PACKED)
        found = packed.repartition("shard").sortWithinPartitions("shard").mapInArrow(_answer(last), _ANSWER)
        # Written out, so that the join takes the buckets' partitioning and leaves the texts where they are.
        answers = staged(found.groupBy("grp").agg(F.collect_list(F.struct("shard", "blocks", "data")).alias("answers" if last else "before")), "substring-answers")
        if not last:
            before, answers = answers, None
            if before.isEmpty():
                break
            asked = blocks.join(before.hint("merge"), "grp")
    final = blocks if before is None else blocks.join(before.hint("merge"), "grp", "left")
    final = final.join(answers.hint("merge"), "grp", "left") if answers is not None else final.withColumn("answers", F.lit(None).cast("array<struct<shard: bigint, blocks: binary, data: binary>>"))
    return final.mapInArrow(_finish(steps, shards, with_text), _DONE).select(F.col("doc_id").alias(id_col), "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document."""
    return without_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT k, doc_id, i, array_to_string(ws[i : i + 12], ' ') AS win FROM (SELECT k, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
v AS (SELECT k, i FROM (SELECT k, doc_id, i, min(doc_id) OVER (PARTITION BY win) AS low FROM g) WHERE low < doc_id),
x AS (SELECT DISTINCT k, i + o AS p FROM v, range(13) AS s(o)),
p AS (SELECT k, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
r AS (SELECT k, count(x.p) AS n_removed, string_agg(word, ' ' ORDER BY p.p) FILTER (WHERE x.p IS NULL) AS kept FROM p LEFT JOIN x USING (k, p) GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (k)
"""
