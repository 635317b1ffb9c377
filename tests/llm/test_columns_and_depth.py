"""Columns named like an operator's own, deep records, long texts and many windows."""

import json
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayweave.llm import chat, lines, quality, toxicity, url_filter

OWN = "_cut _cutrow _cutlines _cutstay _cutg_id _cutg_row _cutgone _lines _stay _gone _row _id _text _units _own _ownwords _ownlines _owngrams _ownplaced _ownagain _words _grams _placed _again _rules _rulessay _says g_id g_row".split()


def with_own(df):
    return df.select("*", *[F.lit(n).alias(n) for n in OWN])


def assert_untouched(plain, got):
    """got has plain's rows, and every own column as it was."""
    assert set(OWN) <= set(got.columns)
    assert sorted(map(str, plain.collect())) == sorted(map(str, got.select(*plain.columns).collect()))
    assert all(r[n] == n for r in got.select(*[f"`{n}`" for n in OWN]).collect() for n in OWN)


@pytest.mark.parametrize("operator", [quality.assessed, lines.without_repeated_passages, lines.without_repeated_chunks])
def test_own_columns_of_text_operators_stay(spark, operator):
    text = "\n".join(f"line {i} of some words that are said and said again in this text" for i in range(9))
    df = spark.createDataFrame([(1, text), (2, text), (3, "short\nlines\n" * 4), (4, None), (5, "")], "doc_id long, text string")
    assert_untouched(operator(df), operator(with_own(df)))


def test_own_columns_of_formatting_and_urls_stay(spark):
    df = spark.createDataFrame([(1, [("user", "a < b"), ("assistant", "\\ok")]), (2, [])], "id long, turns array<struct<role: string, text: string>>")
    assert_untouched(chat.formatted(df), chat.formatted(with_own(df)))
    pages = spark.createDataFrame([(i, f"https://{h}/{i}") for i, h in enumerate(["a.com", "b.net", "x.org", "example.com", "c.net/es", "d.net/fr"])], "page_id long, url string")
    assert_untouched(url_filter.judged(pages), url_filter.judged(with_own(pages)))


def test_deep_records_have_fingerprints(spark):
    deep = '{"a":' * 2000 + "1" + "}" * 2000
    wide = "[" * 3000 + "]" * 3000
    rows = spark.createDataFrame([(1, deep), (2, wide), (3, f'{{"prompt": {wide}, "completion": "x"}}'), (4, json.dumps({"prompt": "p", "completion": "c"}))], "id long, record string")
    got = {r.id: r.r for r in rows.select("id", chat.from_json_records(F.col("record")).alias("r")).collect()}
    assert got[4].layout == "prompt" and got[1].layout is got[2].layout is got[3].layout is None
    assert chat.value_paths(json.loads('{"a":' * 500 + "[]" + "}" * 500)) == {".".join(["a"] * 500) + "[]"}
    assert chat.value_paths({"a": [{"b": 1}, {}], "c": {}, "d": []}) == {"a[].b", "a[]{}", "c{}", "d[]"}


def test_long_turns_are_parsed_in_bounded_memory():
    for body in ("x" * 20_000_000, "<|end|>\n[INST] \\" * 400_000):
        text = f"<|turn|>user\n{body.replace(chr(92), chr(92) * 2).replace('<', chr(92) + '<').replace('[', chr(92) + '[')}<|end|>\n"
        tracemalloc.start()
        turns = chat.parse(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert turns == [("user", body)] and peak < 200 << 20


def test_unescaping_is_the_same_wherever_texts_are_cut(monkeypatch):
    whole = "".join(["\\\\", "\\<", "a", "\\[", "\\n", "bc"] * 50)
    want = chat.unescape(whole, True)
    for size in range(1, 12):
        monkeypatch.setattr(chat, "_PIECE", size)
        assert chat.unescape(whole, True) == want


def test_training_looks_at_every_window(monkeypatch):
    rng = np.random.default_rng(5)
    plain = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(plain, 4000 if i < 4 else 300)) for i in range(40)]
    toxic = np.array([i % 2 for i in range(40)])
    texts = [t + " vile awful hateful slur" * 8 if y else t for t, y in zip(texts, toxic)]
    words = toxicity.Words([t.encode() for t in texts])
    seen = []
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 1)
    real = toxicity.Network.logits
    monkeypatch.setattr(toxicity.Network, "logits", lambda self, w, doc, first, size: seen.append((w.n_words, np.bincount(doc))) or real(self, w, doc, first, size))
    toxicity.train([t.encode() for t in texts], toxic)
    n_words, windows = seen[0]
    doc = toxicity.Words.windows(words)[0]
    longest = np.bincount(doc).max()
    assert windows.max() == longest > 96
