"""Operators 4, 8, 9 and 10, the graph helper and the pipeline."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from dayweave.llm import simhash, toxicity, url_filter, warc
from dayweave.llm.common import anchors, scan_words, sliding_min
from dayweave.llm.graph import components

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_masks_cover_every_small_difference():
    rng = random.Random(0)
    for bits in ((1 << 64) - 1, 0x00FF00FFFF00FF00):
        masks = simhash.covering_masks(4, bits)
        places = [i for i in range(64) if bits >> i & 1]
        for _ in range(4000):
            flips = sum(1 << p for p in rng.sample(places, rng.randrange(5)))
            assert any(m & flips == 0 for m in masks)


@pytest.mark.parametrize("limit", [2048, 3])
def test_near_duplicates_equal_brute_force(spark, limit):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "ζ"]) + str(rng.randrange(30)) for _ in range(120)) for _ in range(25)]
    texts = []
    for b in base:
        w = b.split()
        for _ in range(rng.randrange(1, 6)):
            v = list(w)
            for _ in range(rng.randrange(3)):
                v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += ["", None, " \n", "A b", "a B", "one", base[0], base[0]]
    ids = list(range(100, 100 + len(texts)))
    ids[-1], ids[-2] = None, 100
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("fingerprint", F.lit("mine")).repartition(3)
    got = [(r.doc_id, r.fingerprint & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df, limit=limit).collect()]
    fps = [brute_fingerprint(t) for t in texts]
    assert sorted((str(i), f) for i, f, _ in got) == sorted((str(i), f) for i, f in zip(ids, fps))
    known = [(i, f) for i, f in zip(ids, fps) if i is not None]
    want = brute_components({i for i, _ in known}, [(a, b) for a, x in known for b, y in known if (x ^ y).bit_count() <= 4])
    assert len(set(want.values())) < len(want)
    for i, f, c in got:
        assert c == (want[i] if i is not None else want[100])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 80)] + [(400, 400), (500, 501), (501, 500), (None, 3)] + [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == brute_components({x for p in real for x in p}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_window_helpers():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 5, 200).astype(np.uint64)
    for w in (1, 2, 7, 9):
        assert sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]
        want = {max(j for j in range(i, i + w) if x[j] == x[i : i + w].min()) for i in range(len(x) - w + 1)}
        assert set(anchors(x, w).tolist()) == want
    text = ("ab  c" * 400_000 + "z" * 1_500_000).encode()
    s, e, _ = scan_words(np.frombuffer(text, np.uint8), np.array([b != 32 for b in range(256)]))
    assert [text[a:b] for a, b in zip(s, e)] == text.split()


def test_gradients_equal_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "WINDOW", 6)
    rng = np.random.default_rng(1)
    words = toxicity.Words([b"one two three four five six seven", b"two bad three"])
    net = toxicity.Network(words.hash[:3].copy(), rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    doc, first, size = words.windows(6, 4)
    y = np.array([1.0, 0.0, 1.0])[: len(doc)]

    def loss():
        z = net.forward(net.features(words).astype(np.float64) @ net.p["wx"] + net.p["bx"], words.at[np.minimum(first[:, None] + np.arange(6), len(words.at) - 1)], np.arange(6) < size[:, None])
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    g = net.gradients(words, net.features(words), first, size, y)
    for name in ("uf", "ub", "wx", "wa", "va", "wo", "bo"):
        flat = net.p[name].reshape(-1)
        for i in rng.integers(0, flat.size, 4):
            old, h = flat[i], 1e-3
            flat[i] = old + h
            up = loss()
            flat[i] = old - h
            down = loss()
            flat[i] = old
            assert g[name].reshape(-1)[i] == pytest.approx((up - down) / 2 / h, abs=2e-4), name


def scalar_score(net, text):
    """The score of one text by loops over words, windows and units, from the parameters alone."""
    import math
    import re

    def word_hash(w):
        return int(toxicity.Words([w]).hash[0])

    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    p, H = {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    words = [w.lower() for w in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    known = net.vocabulary.tolist()

    def vector(w):
        marked, grams = b"\x01" + w + b"\x02", []
        for k in (3, 4):
            for i in range(len(marked) - k + 1):
                code = k
                for c in marked[i : i + k]:
                    code = (code * 257 + c) % 2**64
                grams.append(int(toxicity.mix(np.array([code], np.uint64))[0]) % toxicity.CHAR_BUCKETS)
        own = p["word"][known.index(word_hash(w)) + 1 if word_hash(w) in known else 0]
        return list(own) + ([sum(p["char"][g][j] for g in grams) / len(grams) for j in range(toxicity.CHAR_DIM)] if grams else [0.0] * toxicity.CHAR_DIM)

    def logit(window):
        x = [vector(w) for w in window]
        states = [[None] * len(x), [None] * len(x)]
        for d, u in enumerate((p["uf"], p["ub"])):
            h = [0.0] * H
            for t in range(len(x)) if d == 0 else reversed(range(len(x))):
                g = [p["bx"][3 * H * d + j] + sum(x[t][i] * p["wx"][i][3 * H * d + j] for i in range(len(x[t]))) for j in range(3 * H)]
                v = [sum(h[i] * u[i][j] for i in range(H)) for j in range(3 * H)]
                z, r = [sigmoid(g[j] + v[j]) for j in range(H)], [sigmoid(g[H + j] + v[H + j]) for j in range(H)]
                c = [math.tanh(g[2 * H + j] + r[j] * v[2 * H + j]) for j in range(H)]
                h = [c[j] + z[j] * (h[j] - c[j]) for j in range(H)]
                states[d][t] = h
        both = [states[0][t] + states[1][t] for t in range(len(x))]
        e = [sum(math.tanh(sum(b[i] * p["wa"][i][a] for i in range(2 * H)) + p["ba"][a]) * p["va"][a] for a in range(toxicity.ATTENTION)) for b in both]
        w = [math.exp(v - max(e)) for v in e]
        pooled = [sum(w[t] * both[t][i] for t in range(len(x))) / sum(w) for i in range(2 * H)]
        return sum(pooled[i] * p["wo"][i] for i in range(2 * H)) + p["bo"][0]

    n, L, S = len(words), toxicity.WINDOW, toxicity.STRIDE
    starts = [] if not n else [0] if n <= L else sorted({*range(0, n - L, S), n - L})
    worst = max((logit(words[i : i + L]) for i in starts), default=p["bo"][0])
    return sigmoid(max(-60, min(60, net.slope * worst + net.shift)))


def test_scores_equal_scalar_recomputation():
    rng = random.Random(5)
    say = lambda n, bad: " ".join(rng.choice(["vile", "Évil-x"] if bad and rng.random() < 0.1 else ["ma", "na", "Pel", "dor7", "日本"]) for _ in range(n)).encode()
    texts = [say(rng.randrange(5, 60), i % 3 == 0) for i in range(60)]
    net = toxicity.train(texts, np.array([i % 3 == 0 for i in range(60)], np.float32))
    some = [b"", b"one", b" . ", *texts[:4], say(32, False), say(33, True), say(90, True)]
    assert net.score(some) == pytest.approx([scalar_score(net, t) for t in some], abs=2e-3)


def test_long_labelled_texts_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LONG_BYTES", 500)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y, share: seen.append((texts, y)))
    docs = spark.createDataFrame([(i, "word " * (40 if i % 2 else 400)) for i in range(100)] + [(500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)] + [(500, 0)], "doc_id long, toxic int")
    toxicity.fitted(docs, labels)
    texts, y = seen[0]
    assert max(map(len, texts)) == 500 and any(len(t) == 500 for t, v in zip(texts, y) if not v) and not any(len(t) > 500 for t in texts) and not y.any()


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    clean = [f"{a}{b}" for a in ("ma", "to", "ri", "ke", "lu") for b in ("na", "pel", "dor", "sin")]
    rows, labels = [], []
    for i in range(700):
        bad = i % 4 == 0
        w = [rng.choice(clean) for _ in range(rng.randrange(20, 200))]
        for _ in range(3 if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["vile", "Vilest!", "vilely"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (9002, "vile " * 30_000), (None, "x")], "doc_id long, text string").withColumn("score", F.lit("mine"))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.scored(docs, toxicity.fitted(docs, lab)).collect()}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(out[i].predicted == y for i, y in held)
    assert right / len(held) > 0.95 and out[9002].predicted == 1
    assert all(0 <= r.score <= 1 for r in out.values()) and len(out) == 704
    assert toxicity.scored(docs, toxicity.fitted(docs, lab.limit(0))).count() == 704


def test_warc_round_trip(spark, tmp_path):
    pages = [(3, "http://a/x y\r\nWARC-Type: z", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (1, None, "same"), (2, "u", "same"), (9, "v", "same"), (4, "w", None), (5, "x", ""), (None, "n", "same"), (7, "big", "z" * 3_000_000), (8, "dup", "q"), (8, "dup", "q")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha", F.lit("mine")).repartition(3)
    index = warc.write(df, str(tmp_path / "a"))
    rows = warc.read(index).collect()
    assert len(rows) == len(pages) == index.count()
    by = {r.record_id: r for r in rows}
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    for i, _, html in pages:
        r = by[None if i is None else str(i)]
        assert (r.payload_bytes, r.payload_digest) == (len((html or "").encode()), digest(html))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == (html or "").encode()
    assert [by[k].record_type for k in ("1", "2", "9", "4", "5", "8")] == ["response", "revisit", "revisit", "response", "revisit", "response"]
    assert by["2"].refers_to == "1" and by["5"].refers_to == "4" and by[None].record_type == "response"
    few = warc.read(index.filter("record_id in ('3', '7')"), with_payload=False).collect()
    assert {r.record_id for r in few} == {"3", "7"}
    assert warc.read(warc.write(df.limit(0), str(tmp_path / "b"))).count() == 0
    least = warc.read(warc.write(df.filter("page_id in (1, 2, 8)"), str(tmp_path / "c"), least_bytes=5)).filter("record_type = 'revisit'").count()
    assert least == 0


def test_warc_paths_are_qualified_and_lengths_verified(spark, tmp_path):
    assert warc.qualified(spark, str(tmp_path)).startswith("file:/")
    index = warc.write(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), str(tmp_path / "q"))
    row = index.first()
    assert row.file.startswith("file:")
    path = "/" + row.file.removeprefix("file:").lstrip("/")
    wrong = warc.record("1", "u", b"abc", warc.digest(b"abc"), None, "d")
    body = gzip.decompress(wrong).replace(b"Content-Length: 3\r", b"Content-Length: 4\r")
    member = gzip.compress(body)
    with open(path, "wb") as f:
        f.write(member)
    bad = index.withColumn("length", F.lit(len(member)).cast("long"))
    with pytest.raises(Exception, match="mismatch"):
        warc.read(bad).collect()


def brute_url(u):
    if not u or "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, rule, verdict


def test_urls_equal_brute_force(spark):
    urls = ["http://A.Example.COM/en/x?q#f", "https://www.example.com/en/", "http://xwww.example.com/en/1", "http://example.com", "http://example.com/", "http://b.net/es/1", "http://net/fr/", "http://knet/fr/", "ftp://x?a/b", "no scheme", "", None, "://com/", "http://a.com://b/", "http://é.com/en/\nx", "HTTP://com#/", "http://x.org/en/9", "http://x.net/en/3"]
    urls += [f"http://{h}.{t}/{p}/{i}" for i in range(60) for h, t, p in [("blog", "com", "en"), ("shop", "net", "fr"), ("news", "org", "de")]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("mine"))
    got = {r.page_id: r for r in url_filter.judged(df).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_url(u)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_filter.judged(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judged(df.filter("page_id = 9")).collect()} == {"allow"}


def test_url_verdicts_equal_plain_recomputation(spark):
    """Counts, Witten-Bell models, mean differences, threshold and verdicts by dictionaries and loops."""
    import math
    from collections import Counter, defaultdict

    rng = random.Random(8)
    urls = [f"http://{rng.choice(['blog', 'shop', 'news'])}.{t}/{rng.choice(['en', 'es', 'fr'])}/{rng.choice(['a', 'Page', 'x9-'])}{rng.randrange(999)}" for t in ("com", "net", "org") for _ in range(120)] + ["", "é://x", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in url_filter.judged(df).collect()}
    folds = {r.page_id: r.f for r in df.select("page_id", F.pmod(F.xxhash64("url"), F.lit(url_filter.FOLDS)).alias("f")).collect()}

    def symbols(u):
        names = {c: i + 2 for i, c in enumerate(url_filter.ALPHABET)}
        low = [chr(b).lower() if b < 128 else "\x00" for b in (u or "").encode()]
        return [0] * url_filter.ORDER + [names.get("0" if c in "123456789" else c, 1) for c in low]

    counts = {v: defaultdict(Counter) for v in ("allow", "block")}
    for i, u in enumerate(urls):
        verdict = brute_url(u)[3]
        if verdict and folds[i] != 0:
            s = symbols(u)
            for k in range(url_filter.ORDER, len(s)):
                for order in range(url_filter.ORDER + 1):
                    counts[verdict][order, tuple(s[k - order : k])][s[k]] += 1

    def chance(verdict, before, c):
        p = 1 / url_filter.SIZE
        for order in range(url_filter.ORDER + 1):
            seen = counts[verdict][order, tuple(before[len(before) - order :])]
            kinds = len(seen) or 1
            p = (seen[c] + kinds * p) / (sum(seen.values()) + kinds)
        return p

    def score(u):
        s = symbols(u)
        d = [math.log(chance("allow", s[k - url_filter.ORDER : k], s[k])) - math.log(chance("block", s[k - url_filter.ORDER : k], s[k])) for k in range(url_filter.ORDER, len(s))]
        return sum(d) / max(1, len(d))

    scores = [score(u) for u in urls]
    assert [got[i].score for i in range(len(urls))] == pytest.approx(scores, abs=1e-4)
    kept = {v: [x for x, (i, u) in zip(scores, enumerate(urls)) if folds[i] == 0 and brute_url(u)[3] == v] for v in ("allow", "block")}
    good = lambda t: sum(x >= t for x in kept["allow"]) / len(kept["allow"]) + sum(x < t for x in kept["block"]) / len(kept["block"])
    cuts = sorted({got[i].score for i in range(len(urls))})
    edge = max(got[i].score for i in range(len(urls)) if got[i].verdict == "block" and not brute_url(urls[i])[3])
    first = min(got[i].score for i in range(len(urls)) if got[i].verdict == "allow" and not brute_url(urls[i])[3])
    assert edge < first and good((edge + first) / 2) >= max(map(good, cuts)) - 1e-9
    assert all(r.verdict == brute_url(urls[i])[3] for i, r in got.items() if brute_url(urls[i])[3])


def test_markov_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    counts = np.zeros((url_filter.SIZE,) * 4)
    counts[tuple(rng.integers(0, url_filter.SIZE, (4, 500)))] += 1
    assert np.allclose(np.exp(url_filter.log_probabilities(counts)).sum(-1), 1)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(900, None, "en", None, None), (901, "", None, "s", 0), (None, "without an id " * 20, "en", "s", 5), (2, docs.filter("doc_id = 2").first().text, "en", "s", 1)], docs.schema)
    d = docs.unionByName(extra)
    seen = [d.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = corpus_pipeline.staged(stage(spark, d, SF), name)
        assert d.columns == docs.columns
        seen.append(d.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    assert d.filter("doc_id = 2").count() <= 1 and d.filter("doc_id is null").count() == 1
    last = corpus_pipeline.STAGES[-1][1](spark, d, SF)
    assert last.count() == seen[-1]
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_rows_of_one_id_with_different_texts_stay(spark):
    texts = [" ".join(f"{x}{i}" for i in range(60)) for x in "abc"]
    rows = [(1, texts[0], "en", "s", 3), (1, texts[1], "en", "s", 4), (1, texts[1], "en", "r", 9), (1, texts[1], "en", None, 9), (2, texts[2], "de", "s", 5), (3, texts[2], "en", "s", 5), (1, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = sorted((tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()), key=str)
    assert got == sorted((rows[i] for i in (0, 3, 4, 6)), key=str)
