"""Operators 1, 2, 3, 5, 6 and 7 against brute force and on odd input."""

import base64
import hashlib
import json
import random
import re
import sys
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from dayweave.llm import byte_bpe, chat, lines, quality, substrings, winnowing

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "\n", "a", "é", "日本語 text", "🙂🙂👨‍👩‍👧", "x" * 5000, "aaaa aaaaa  aaaaaa", "\u0085\u00a0\u2003 b", "it's they'LL we'd", "1234567 8９ ½²", "<|endoftext|>", "\x00\x01 \x7f", "a\r\n\r\n b\t", "ﬁ İ ß ΣΑΣ"]


def docs_df(spark, texts, ids=None, extra=False):
    rows = [(i, t) for i, t in zip(ids or range(len(texts)), texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumn("n_words", F.lit("mine")).withColumn("score", F.lit(1)).withColumn("h", F.lit(2)) if extra else df


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(reference):
    coder, rng = byte_bpe.ByteBpe(RANKS, P.PATTERN), random.Random(1)
    some = [chr(c) for c in range(1, 0x3000)] + [chr(rng.randrange(0x3000, 0x20000)) for _ in range(3000)]
    some = [c for c in some if not 0xD800 <= ord(c) < 0xE000]
    texts = ODD + ["".join(rng.choice(["a", "aa", "b", " ", "é", "1", "'s", "\n", "the", "日"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [f"a{c}b {c}1 {c}{c} .{c}" for c in some]
    for text, got in zip(texts, coder.encode(texts)):
        ids = np.frombuffer(got, "<u4")
        assert ids.tolist() == reference.encode_ordinary(text), repr(text)
        assert coder.decode(ids) == text.encode()


def test_bpe_offsets_point_at_characters():
    coder = byte_bpe.ByteBpe(RANKS, P.PATTERN)
    for text in ODD:
        raw = text.encode()
        ids = np.frombuffer(coder.encode([text])[0], "<u4")
        at = coder.char_offsets(ids, raw)
        pos = 0
        for i, s in zip(ids.tolist(), at.tolist()):
            assert raw[:pos].decode(errors="ignore") == text[:s]
            pos += len(coder.bytes_of[i])
        assert at[-1] == len(text)


def test_bpe_frames(spark, reference):
    df = docs_df(spark, [*ODD, None, None], extra=True)
    out = {r.doc_id: r for r in byte_bpe.round_trip(df, RANKS, P.PATTERN).collect()}
    for i, t in enumerate([*ODD, "", ""]):
        ids = reference.encode_ordinary(t)
        assert out[i].n_tokens == len(ids) and out[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    coded = byte_bpe.decode(byte_bpe.encode(df.select("doc_id", "text"), RANKS, P.PATTERN, with_offsets=True), RANKS, P.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in coded.collect())
    assert byte_bpe.round_trip(df.limit(0), RANKS, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(df.withColumn("ids", F.lit(1)), RANKS, P.PATTERN)


def test_chat_round_trip_and_mask(spark):
    nasty = ["", "plain", "<|turn|>user\nx<|end|>\n", "a\\b\\\\<[INST] [/INST]</s><<SYS>>", "\\n\n\\", "é🙂<"]
    rows = [(c, t, r, nasty[(c + t) % len(nasty)]) for c in range(6) for t, r in enumerate(["system", "user", "assistant", "us\ner<|", "assistant"])]
    rows += [(7, 0, "user", None), (7, 0, "assistant", "tie"), (8, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    f = chat.formatted(chat.from_struct(chat.conversations(df), ["turns"]))
    assert all(chat.parse(r.formatted) == [(t.role, t.text) for t in r.turns] for r in f.collect())
    got = {r.conv_id: r for r in f.select("conv_id", chat.read_back(F.col("formatted"), F.col("loss_spans")).alias("r")).select("conv_id", "r.*").collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        said = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256, got[c].n_turns) == (len(said), hashlib.sha256(said.encode()).hexdigest(), len(turns))
    with pytest.raises(ValueError):
        chat.from_struct(spark.createDataFrame([(1, "x")], "id long, strange string"), ["strange"])


def test_chat_layouts(spark):
    pair = [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]}, "messages"), ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations"),
        ({"instruction": "q", "output": "a"}, "instruction"), ({"output": "a", "input": "", "instruction": "q"}, "instruction_input"), ({"prompt": "q", "completion": "a"}, "prompt"),
        ({"prompt": {"text": "q"}, "response": {"text": "a"}}, "nested_prompt"), ({"question": "q", "answer": "a"}, "question"),
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r, _ in records] + [("{}",), ("not json",), (None,)], "j string").coalesce(1)
    out = [r.r for r in df.select(chat.from_json_records(F.col("j")).alias("r")).collect()]
    for (_, name), got in zip(records, out):
        assert got.layout == name and [t.asDict() for t in got.turns] == pair
    assert out[-3].fingerprint and out[-3].turns is None and out[-2].fingerprint is None and out[-1].fingerprint is None
    nested = spark.createDataFrame([(("q",), ("a",))], "prompt struct<text: string>, response struct<text: string>")
    assert [t.asDict() for t in chat.from_struct(nested, ["prompt", "response"]).first().turns] == pair


def test_odd_json_records_do_not_fail_the_job(spark):
    odd = [
        '{"turns":[{"order":1,"role":"a","text":"x"},{"order":"2","role":"b","text":"y"}]}', '{"conversations":[{"from":{},"value":"x"},{"from":"human","value":"q"}]}', '{"prompt":"\\ud800","completion":"x"}',
        '{"turns":[{"order":2,"role":"b","text":"y"},{"order":null,"role":null,"text":7},{"order":1.5,"role":["r"],"text":{"k":1}}]}', '{"messages":[{"role":"a"},{"content":"x"}]}', '{"\\ud800":1}', '{"messages":[]}', '[1]', "", '{"prompt":{},"completion":"x"}',
    ]
    out = [r.r for r in spark.createDataFrame([(o,) for o in odd], "j string").coalesce(1).select(chat.from_json_records(F.col("j")).alias("r")).collect()]
    assert [r.layout for r in out] == [None, None, "prompt", None, "messages", None, None, None, None, None]
    assert out[2].turns[0].text == "\ufffd" and [(t.role, t.text) for t in out[4].turns] == [("a", ""), ("", "x")]
    numbers = spark.createDataFrame([('{"turns":[{"order":2,"role":"b","text":"y"},{"order":null,"role":null,"text":7},{"order":1.5,"role":"r","text":null}]}',)], "j string")
    assert [(t.role, t.text) for t in numbers.select(chat.from_json_records(F.col("j")).alias("r")).first().r.turns] == [("", "7"), ("r", ""), ("b", "y")]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_contamination(texts, items):
    known = {}
    for j, t in items:
        w = WORD.findall(lower(t))
        for i in range(max(1, len(w) - 12) if w else 0):
            known.setdefault(tuple(w[i : i + 13]), set()).add(j)
    out = []
    for t in texts:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit.update(range(i, i + n))
                    found |= known[tuple(w[i : i + n])]
        ids = ",".join(sorted(str(j) for j in found if j is not None))
        out.append((len(w), len(hit), len([j for j in found if j is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_contamination_equals_brute_force(spark, limit):
    rng = random.Random(limit)
    vocab = ["Alpha", "beta", "gámma", "d1", "e", "É", "x9"]
    gen = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "!"]) for _ in range(n))
    items = [(j, gen(rng.choice([1, 3, 12, 13, 14, 20, 40]) if j else 20)) for j in range(25)] + [(90, None), (91, "..."), (92, "a " * 30), (3, "only short"), (None, gen(15))]
    items = [(j, t) for j, t in items if not t or len(t.split()) != 1]
    texts = [gen(rng.randrange(120)) for _ in range(60)]
    texts += [gen(10) + " " + rng.choice([t for _, t in items if t])[:200].upper() + ";" + gen(30) for _ in range(40)] + ["a " * 100, "", None, "Only   SHORT", items[0][1], "... !!"]
    df = docs_df(spark, texts, extra=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = winnowing.contamination(df, bench, block_limit=limit)
    n_hit, bad = winnowing.verdict(F.col("contamination"))
    c = F.col("contamination")
    got = {r.doc_id: tuple(r)[1:] for r in found.select("doc_id", c.n_words, n_hit, F.size(c["items"]), F.sha2(F.array_join(c["items"], ","), 256), bad).collect()}
    for i, want in enumerate(brute_contamination(texts, items)):
        assert got[i] == want, (i, texts[i])
    assert winnowing.contamination(df, bench.limit(0)).agg(F.sum(F.size("contamination.spans"))).first()[0] == 0
    assert winnowing.contamination(df.limit(0), bench).count() == 0


def test_an_item_across_neighbouring_rows_hits_both(spark):
    """A page stored as two rows, cut through a benchmark passage: both rows lie on one alignment of the item."""
    item = [f"w{i}" for i in range(60)]
    texts = [" ".join(["p", "q", *item[:30]]), " ".join([*item[30:], "r", "s"]), "nothing here"]
    assert all(len(found) == 1 for found in winnowing.Items([(["7"], " ".join(item).encode())]).find([t.encode() for t in texts])[2][:2])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = winnowing.contamination(df, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    n_hit, bad = winnowing.verdict(F.col("contamination"))
    c = F.col("contamination")
    got = [tuple(r) for r in found.orderBy("doc_id").select(c.n_words, n_hit, F.size(c["items"]), F.sha2(F.array_join(c["items"], ","), 256), bad).collect()]
    assert got == brute_contamination(texts, [(7, " ".join(item))]) and [g[1] for g in got] == [30, 30, 0]


def test_contaminated_documents_go_from_the_pipeline(spark, tmp_path):
    rng = random.Random(3)
    item = [(j, " ".join(f"i{j}w{i}" for i in range(20))) for j in range(4)]
    filler = lambda n: " ".join(f"f{rng.randrange(999)}" for _ in range(n))
    texts = [f"{filler(n)} {rng.choice(item)[1]} {filler(n)}" for n in range(10, 400, 30)] + [filler(50), "", None]
    spark.createDataFrame(item, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_df(spark, texts).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).select(*corpus_pipeline.COLUMNS)
    want = [i for i, found in enumerate(brute_contamination(texts, item)) if not found[4]]
    got = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(r for r in map(tuple, docs.collect()) if r[0] in want) and 3 < len(want) < len(texts)


def test_equal_items_are_one_text_of_a_block(spark, monkeypatch):
    """A benchmark of one text under 10,000 ids: every block keeps to the limit and every id is found."""
    item = " ".join(f"w{i}" for i in range(20))
    sizes, real = [], winnowing.Items.__init__
    monkeypatch.setattr(winnowing.Items, "__init__", lambda self, rows: (sizes.append(sum(len(t) + sum(len(n) for n in names) for names, t in rows)), real(self, rows))[1])
    df = docs_df(spark, [item + " and more", "nothing here", None, "x " + item])
    bench = spark.range(10_000).select(F.col("id").alias("item_id"), F.lit(item).alias("text"))
    found = winnowing.contamination(df.withColumn("_winnowdigest", F.lit("mine")), bench, block_limit=20_000)
    assert len(sizes) == 2 and max(sizes) <= 20_000
    got = {r.doc_id: sorted(map(int, r.contamination["items"])) for r in found.collect()}
    assert got == {0: list(range(10_000)), 1: [], 2: [], 3: list(range(10_000))}
    assert [sum(len(t) for _, t in b) for b in winnowing.item_blocks(iter([("a", b"xx"), ("b", b"yyy"), ("c", b"zzzzzzz"), (None, b"v")]), 7)] == [5, 7, 1]
    assert [n for n, _ in next(winnowing.item_blocks(iter([("a", b"xx"), ("b", b"xx"), ("c", b"y")]), 50))] == [["a", "b"], ["c"]]


def test_a_million_equal_words_are_linear():
    """Time and memory grow with the words of document and item, not with their product."""
    import resource
    import time

    items = winnowing.Items([(["1"], b"a " * 2000), (["2"], b"a b " * 500), (["3"], b"a a")])
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    n_words, hit, found = items.find([b"a " * 1_000_000, b"b a " * 100, b"b b"])
    assert n_words.tolist() == [1_000_000, 200, 2] and hit[:1_000_000].all() and hit[1_000_000:1_000_200].all() and not hit[1_000_200:].any()
    assert found == [{0, 2}, {1}, set()]
    assert time.time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(zip(w, w[1:], w[2:]))
    cover = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    n = max(1, len(w))
    chars, sym, stop = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in quality.STOP_WORDS for x in w)
    ok = 2 <= chars / n <= 14 and sym / n <= 0.1 and stop / n >= 0.01 and (len(ls) - len(set(ls))) / max(1, len(ls)) <= 0.5
    return len(w), chars, sym, len(ls) - len(set(ls)), len(cover), base, ok and not base


def test_quality_equals_brute_force(spark):
    rng = random.Random(5)
    make = lambda: "".join(rng.choice(["the ", "word ", "a b c ", "é🙂 ", "#", "\n", "\t", "same line\n", "of\x0b", "long" * 5 + " "]) for _ in range(rng.randrange(300)))
    texts = [make() for _ in range(150)] + ["", None, " \n ", "a a a", "a a a a", "x " * 2000, "no\u00a0break the " * 60, "y" * 100_000]
    out = quality.assessed(docs_df(spark, texts, extra=True)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_quality(t), repr(t)[:80]


def test_quality_and_lines_stay_native(spark):
    df = docs_df(spark, ["a\nb", "a\nb\nc"])
    for out in (quality.assessed(df), lines.without_repeated_chunks(df), lines.without_repeated_passages(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow(?!U)", plan)


def test_lines_equal_sql(spark):
    rng = random.Random(9)
    pool = [f"line {i} é" for i in range(12)] + ["", " ", "\t"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 30))) for _ in range(120)] + ["", None, "\n\n\n", "one", "x\n" * 3000, "a\r\nb\r\na\r\nb"]
    ids = list(range(len(texts)))
    df = docs_df(spark, texts, ids)
    documents = df.toPandas()  # noqa: F841  the SQL's table
    want = sorted(map(tuple, duckdb.sql(lines.CHUNKS_ORACLE).fetchall()), key=str)
    got = [tuple(r) for r in lines.without_repeated_chunks(df.withColumn("k", F.lit(1)).withColumn("n_lines", F.lit("mine"))).select("doc_id", "n_lines", "n_removed_lines", "text").collect()]
    assert sorted(got, key=str) == want and any(r[2] for r in got)
    # repeated rows are one document, rows without an id are not lost
    twice = docs_df(spark, ["p\nq\nr\ns\nt\nu"] * 2 + [None, "p\nq\nr\ns\nt\nu"], [1, 1, None, 2])
    out = sorted(((r.doc_id, r.n_removed_lines, r.text) for r in lines.without_repeated_chunks(twice).collect()), key=str)
    assert len(out) == 4 and [o for o in out if o[0] == 1][0] == [o for o in out if o[0] == 1][1]
    assert lines.without_repeated_chunks(df.limit(0)).count() == 0


def test_many_chunks_of_one_text_are_linear(spark):
    import time

    long = "\n".join(f"line {i}" for i in range(300_000))
    began = time.time()
    out = {r.doc_id: r for r in lines.without_repeated_chunks(docs_df(spark, [long, long + "\nend"])).collect()}
    assert out[0].text == long and out[1].n_removed_lines > 100_000 and time.time() - began < 120


def brute_passages(texts, ids):
    """Texts without the lines that stand in a chunk, or are a long line, that occurs before; units in order of id and first line."""
    white = " \t\n\x0b\x0c\r"
    units = []
    for d, t in zip(ids, texts):
        ls = t.split("\n") if t is not None else []
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in ls]
        r = [(h[i] + lines.WEIGHT * (h[i - 1] if i else 0)) % 2147483647 * 1103515245 % 2147483647 for i in range(len(h))]
        begin = 0
        for i in range(len(ls)):
            if i == len(ls) - 1 or 0 < i < len(ls) - 2 and r[i] < r[i - 1] and r[i] <= r[i + 1]:
                assert i > begin or len(ls) == 1
                if i > begin and "\n".join(ls[begin : i + 1]).strip(white):
                    units.append((d, begin, ls[begin : i + 1]))
                begin = i + 1
            if len(re.findall(r"[^\x20\x09-\x0D]+", ls[i])) >= lines.LONG_LINE:
                units.append((d, i, [ls[i]]))
    seen, gone, chunked = set(), {d: set() for d in ids}, {d: set() for d in ids}
    for d, k, chunk in sorted(units, key=lambda u: u[:2]):
        if (len(chunk), "\n".join(chunk)) in seen:
            gone[d] |= set(range(k, k + len(chunk)))
            chunked[d] |= set(range(k, k + len(chunk))) if len(chunk) > 1 else set()
        seen.add((len(chunk), "\n".join(chunk)))
    return [(d, len(t.split("\n")) if t is not None else 0, len(gone[d]), len(gone[d] - chunked[d]), t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])) for d, t in zip(ids, texts)]


def test_passages_equal_brute_force(spark):
    rng = random.Random(10)
    pool = [f"line {i} é" for i in range(12)] + ["", " ", "\t"] + [" ".join(f"w{rng.randrange(9)}" for _ in range(n)) for n in (12, 13, 14, 60, 60)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 30))) for _ in range(150)] + ["", None, "\n\n\n", "one", "x\n" * 3000, "a\r\nb\r\na\r\nb"]
    ids = list(range(len(texts)))
    df = docs_df(spark, texts, ids)
    out = lines.without_repeated_passages(df.withColumn("k", F.lit(1)).withColumn("n_lines", F.lit("mine"))).select("doc_id", "n_lines", "n_removed_lines", "n_removed_long_lines", "text")
    want = brute_passages(texts, ids)
    assert sorted(map(tuple, out.collect())) == want
    documents = df.toPandas()  # noqa: F841  the SQL's table
    assert sorted(map(tuple, duckdb.sql(lines.ORACLE).fetchall())) == want
    assert lines.without_repeated_passages(df.limit(0)).count() == 0
    twice = docs_df(spark, ["p\nq\nr\ns\nt\nu"] * 2 + [None, "p\nq\nr\ns\nt\nu"], [1, 1, None, 2])
    assert sorted((str(r.doc_id), r.n_removed_lines, r.text) for r in lines.without_repeated_passages(twice).collect()) == [("1", 0, "p\nq\nr\ns\nt\nu")] * 2 + [("2", 6, ""), ("None", 0, None)]


def test_repeated_long_lines_and_copies_go_from_the_pipeline(spark):
    """Each of 30 long lines stands again between other lines, and each of 30 texts has an exact copy: all of that goes."""
    long = [" ".join(f"a{i}w{j}" for j in range(60)) for i in range(30)]
    texts = [f"own {i} one\nown {i} two\n{t}\nown {i} three" for i, t in enumerate(long)] + [f"{t}\nother {i}" for i, t in enumerate(long)] + ["\n".join(f"short {i} {j}" for j in range(2 + i)) for i in range(30)] * 2
    docs = docs_df(spark, texts).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).select(*corpus_pipeline.COLUMNS)
    got = {r.doc_id: r for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert all(got[i].text == t for i, t in enumerate(texts[:30])) and all(got[60 + i].text == texts[60 + i] for i in range(30))
    assert [got[30 + i].text for i in range(30)] == [f"other {i}" for i in range(30)] and all(got[90 + i].text == "" for i in range(30))
    assert all(r.n_chars == len(r.text) for r in got.values())


def brute_removed(texts, ids, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    low = {}
    for w, d in zip(words, ids):
        for i in range(len(w) - window + 1 if d is not None else 0):
            k = tuple(w[i : i + window])
            low[k] = min(low.get(k, d), d)
    out = []
    for w, d in zip(words, ids):
        gone = {j for i in range(len(w) - window + 1 if d is not None else 0) if low[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [13, 50, 5])
def test_substrings_equal_brute_force(spark, window, monkeypatch):
    rng = random.Random(window)
    vocab = [f"w{i}" for i in range(4)] + ["é"]
    passage = [rng.choice(vocab) for _ in range(90)]
    texts = []
    for _ in range(80):
        w = [rng.choice(vocab + [f"r{rng.random()}"]) for _ in range(rng.randrange(60))]
        if rng.random() < 0.6:
            a = rng.randrange(80)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + rng.randrange(5, 90)]
        texts.append(rng.choice([" ", "\n", " \t"]).join(w))
    texts += ["", None, "z " * 200, "z " * 150, texts[3], texts[3], " ".join(passage), None]
    ids = [*range(len(texts) - 4), 7, 90, -5, None]
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 700)
    df = docs_df(spark, texts, ids).withColumn("block", F.lit("mine"))
    out = substrings.without_repeats(df, window=window, with_text=True, range_bytes=2000)
    rows = out.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=str) == sorted(brute_removed(texts, ids, window), key=str)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in rows) and any(r.n_removed for r in rows)
    assert substrings.without_repeats(df.limit(0), window=window).count() == 0


if __name__ == "__main__":
    sys.exit(pytest.main([__file__]))
