"""Benchmark decontamination by winnowing.

Of every run of W consecutive K-word hashes the least is kept (the rightmost of equals), in benchmark items and in documents alike,
so every shared span of K + W - 1 = 13 words or more shares a kept hash. Kept hashes of documents are joined with those of the items;
each hit is extended to the 13-word windows around it, which are looked up among the items' and compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.llm.common import ALNUM_WORDS, BLOCK_BYTES, LOWER, U64, anchors, scan_words, staged, table, utf8_column, window_hashes

WINDOW = 13
GRAM = 5
#: UTF-8 bytes of distinct benchmark texts and their ids that one broadcast may stand for; a larger benchmark is handled in several blocks.
BLOCK_LIMIT = 16 << 20

FOUND = "struct<n_words: bigint, spans: array<struct<first: int, last: int>>, items: array<string>>"
_SPAN = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


class Table:
    """The distinct windows of one length: sorted hashes, the place of one occurrence, and the texts that have each."""

    def __init__(self, keys: np.ndarray, at: np.ndarray, owner: np.ndarray):
        order = np.lexsort((owner, keys))
        keys, at, owner = keys[order], at[order], owner[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        pair = new.copy()
        pair[1:] |= owner[1:] != owner[:-1]
        self.keys, self.at, self.owners = keys[new], at[new].astype(np.int32), owner[pair].astype(np.int32)
        self.begin = np.append(np.flatnonzero(new[pair]), len(self.owners)).astype(np.int32)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """For each key its place among the distinct windows, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, place, -1)


class Items:
    """The fingerprints of a block of benchmark texts, each with the ids of its items.

    Every distinct window is held once, however often it occurs in an item or how many items have it, so looking up a document is linear
    in its words. Arrays only: about six bytes for each byte of text.
    """

    def __init__(self, rows: list[tuple[list[str | None], bytes]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.names = [n for n, _ in rows]
        text = b"\n".join(t for _, t in rows)
        s, e, h = scan_words(np.frombuffer(text, np.uint8), ALNUM_WORDS, LOWER)
        owner, n_words, first = _owners([t for _, t in rows], s)
        self.plain, self.place = _plain(text, s, e)
        long = n_words[owner] >= window if len(owner) else np.zeros(0, bool)
        self.marks, self.tables = np.zeros(0, U64), {}
        if long.any():
            at = np.flatnonzero(long[: len(h) - window + 1] & (owner[: len(h) - window + 1] == owner[window - 1 :]))
            self.tables[window] = Table(window_hashes(h, window)[at], at, owner[at])
            self.marks = np.unique(_winnowed(h, owner, window, gram)[1])
        for n in np.unique(n_words[(n_words > 0) & (n_words < window)]).tolist():
            short = np.flatnonzero(n_words == n)
            self.tables[n] = Table(window_hashes(h, n)[first[short]], first[short], short)

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
        """Words of each text, a flag for each word of all texts (hit or not), the benchmark texts found in each text."""
        text = b"\n".join(texts)
        s, e, h = scan_words(np.frombuffer(text, np.uint8), ALNUM_WORDS, LOWER)
        owner, n_words, first = _owners(texts, s)
        edge, items = np.zeros(len(h) + 1, np.int64), [set() for _ in texts]
        for n, table in self.tables.items():
            m = len(h) - n + 1
            if m <= 0:
                continue
            inside = owner[:m] == owner[n - 1 :]
            if n == self.window:
                at, grams = _winnowed(h, owner, n, self.gram)
                at = at[np.isin(grams, self.marks)]
                near = np.zeros(len(h) + 1, np.int64)
                np.add.at(near, np.maximum(at - (n - self.gram), 0), 1)
                np.add.at(near, at + 1, -1)
                inside &= np.cumsum(near)[:m] > 0  # the windows that a hit can be extended to
            at = np.flatnonzero(inside)
            which = table.lookup(window_hashes(h, n)[at])
            at, which = at[which >= 0], which[which >= 0]
            for doc in np.unique(owner[at]).tolist():
                a, b = np.searchsorted(owner[at], [doc, doc + 1])
                begin, end = first[doc], first[doc] + n_words[doc]
                plain, place = _plain(text, s[begin:end], e[begin:end])
                same = [plain[place[i - begin] : place[i - begin + n] - 1] == self.plain[self.place[j] : self.place[j + n] - 1] for i, j in zip(at[a:b].tolist(), table.at[which[a:b]].tolist(), strict=True)]
                there, known = at[a:b][same], np.unique(which[a:b][same])
                np.add.at(edge, there, 1)
                np.add.at(edge, there + n, -1)
                for j in known.tolist():
                    items[doc].update(table.owners[table.begin[j] : table.begin[j + 1]].tolist())
        return n_words, np.cumsum(edge[:-1]) > 0, items


def _owners(texts: list[bytes], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of texts joined by a line feed: the text of each word; the number of words and the first word of each text."""
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(begins, starts, "right") - 1
    n_words = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    return owner, n_words, np.cumsum(n_words) - n_words


def _plain(text: bytes, s: np.ndarray, e: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words in lower case with one space between, and where each begins (one more for the end)."""
    plain = b" ".join([text[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]).lower()
    return plain, np.concatenate([[0], np.cumsum(e - s + 1)]).astype(np.int32 if len(plain) < 1 << 31 else np.int64)


def _winnowed(h: np.ndarray, owner: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the kept grams: of every run within one text the least."""
    grams = window_hashes(h, gram)
    grams[owner[: len(grams)] != owner[gram - 1 :][: len(grams)]] = U64(0xFFFFFFFFFFFFFFFF)
    at = anchors(grams, window - gram + 1)
    return at, grams[at]


def blocks_of(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def item_blocks(rows: Iterator, limit: int) -> Iterator[list[tuple[list[str | None], bytes]]]:
    """Rows (item, text), equal texts together, in blocks of at most limit bytes of text and ids, or of one longer text; one empty block
    if there are none. A text whose ids don't fit goes on in the next block."""
    held, size = [], 0
    for item, text in rows:
        again = bool(held) and held[-1][1] == text
        cost = len(item or "") + (0 if again else len(text))
        if held and size + cost > limit:
            yield held
            held, size, again, cost = [], 0, False, len(item or "") + len(text)
        if again:
            held[-1][0].append(item)
        else:
            held.append(([item], bytes(text)))
        size += cost
    yield held


def _finder(shared) -> Column:
    @F.arrow_udf(FOUND)
    def found(texts: pa.Array) -> pa.Array:
        items: Items = shared.value
        counts, spans, names = [], [], []
        for part in blocks_of(utf8_column(texts)):
            n_words, hit, inside = items.find(part)
            first = np.cumsum(n_words) - n_words
            for doc, (at, n) in enumerate(zip(first.tolist(), n_words.tolist(), strict=True)):
                if inside[doc]:
                    edge = np.diff(np.concatenate([[False], hit[at : at + n], [False]]).astype(np.int8))
                    spans.append([{"first": a, "last": b - 1} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)])
                    names.append(sorted({n for j in inside[doc] for n in items.names[j]} - {None}))
                else:
                    spans.append([])
                    names.append([])
            counts.append(n_words)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(spans, _SPAN), pa.array(names, pa.list_(pa.string()))], names=["n_words", "spans", "items"])

    return found


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", into: str = "contamination", block_limit: int = BLOCK_LIMIT) -> DataFrame:
    """docs with a struct column `into`: n_words, spans (first and last word of each hit stretch), items (ids as strings, sorted).

    One narrow pass over docs when the benchmark's distinct texts and ids fit in block_limit. A larger benchmark is dealt into blocks by
    running bytes; each further block is a pass that writes only the texts with hits, by their digest, and these are joined with the last
    pass. Null or wordless texts have no words and hit nothing; an item without words has no windows; items with a null id mark words but
    are not listed; repeated rows give repeated rows; an empty benchmark hits nothing. A column that is already named `into` is replaced.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").cast("binary").alias("text")).filter("text is not null").orderBy("text", "item")
    blocks = item_blocks(((r.item, r.text) for r in rows.toLocalIterator()), block_limit)
    text, docs, parts, block = F.col(f"`{text_col}`"), docs.drop(into), [], next(blocks)
    own = "_winnow"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    digest, known, spans, items = (f"{own}{c}" for c in ("digest", "known", "spans", "items"))
    for further in blocks:
        found = _finder(spark.sparkContext.broadcast(Items(block)))
        hits = docs.select(F.sha2(text.cast("binary"), 256).alias(digest), found(text).alias("f")).filter("size(f.spans) > 0")
        parts.append(staged(hits.groupBy(digest).agg(F.first("f").alias("f")), "winnow"))
        block = further
    out = docs.withColumn(into, _finder(spark.sparkContext.broadcast(Items(block)))(text))
    if not parts:
        return out
    hits = parts[0]
    for more in parts[1:]:
        hits = hits.unionByName(more)
    hits = staged(hits.groupBy(digest).agg(F.collect_list("f.spans").alias(spans), F.collect_list("f.items").alias(items)), "winnow")
    last = F.col(f"`{into}`")
    merged = lambda more, mine: F.array_sort(F.array_distinct(F.concat(F.flatten(F.coalesce(F.col(more), F.array())), last[mine])))
    out = out.withColumn(known, F.sha2(text.cast("binary"), 256)).join(hits.hint("merge"), F.col(known) == F.col(digest), "left")
    both = F.struct(last["n_words"].alias("n_words"), merged(spans, "spans").alias("spans"), merged(items, "items").alias("items"))
    return out.withColumn(into, F.when(F.col(digest).isNotNull(), both).otherwise(last)).drop(digest, known, spans, items)


def verdict(found: Column) -> tuple[Column, Column]:
    """Hit words and whether they are a twentieth of the words or more."""
    whole = F.aggregate(found.spans, F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1)
    apart = F.size(F.array_distinct(F.flatten(F.transform(found.spans, lambda s: F.sequence(s["first"], s["last"])))))
    tidy = F.forall(F.transform(found.spans, lambda s, i: F.when(i == 0, True).otherwise(F.get(found.spans, i - 1)["last"] < s["first"])), lambda x: x)
    n_hit = F.when(F.size(found.spans) == 0, 0).when(tidy, whole).otherwise(apart).cast("long")
    return n_hit, (n_hit > 0) & (20 * n_hit >= found.n_words)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document against every benchmark item."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit, bad = verdict(F.col("contamination"))
    c = F.col("contamination")
    return found.select("doc_id", c.n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), bad.alias("contaminated"))
