"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the vector of the word, if the vocabulary has it, and the mean vector of its character 3- and 4-grams. The network
scores overlapping windows that cover the whole text; a document's score is the calibrated score of its worst window. Training is
multiple-instance: a toxic document teaches by its worst windows, a clean one by its worst and some random windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.llm.common import ALNUM_WORDS, LOWER, U64, mix, scan_words, table, utf8_column

WINDOW, STRIDE = 32, 16
WORD_DIM = CHAR_DIM = 8
HIDDEN, ATTENTION = 8, 8
CHAR_BUCKETS = 1 << 14
#: Toxic labelled documents that training may gather at most, chosen by a hash of the id; clean ones for each of them, and the bytes of all.
SAMPLE_TOXIC, CLEAN_SHARE, SAMPLE_BYTES = 800, 4, 20 << 20
#: The longest text, or stretch of one, of the sample.
LONG_BYTES = SAMPLE_BYTES // 64
#: Of the clean ones so many for each toxic one are trained on throughout, if there are as many LEAST_CLEAN. Of the others one half is searched
#: in every epoch for the worst-scoring ones, one for every HARD_SHARE toxic ones, which are trained on too; the other half calibrates, and
#: CHOOSE of those kept choose between epochs.
TRAIN_CLEAN, LEAST_CLEAN, CHOOSE, HARD_SHARE = 1.5, 400, 400, 3
EPOCHS, RATE, SEED = 6, 0.01, 7
#: Small samples are gone through more often, until so many steps are made.
LEAST_STEPS = 240
#: Shrinkage of the calibrating slope over standardised logits.
SHRINK = 0.5
FOLDS = 5
BLOCK = 4 << 20


class Words:
    """Words of a block of texts: distinct words with their bytes' n-grams, and the distinct word at each place."""

    def __init__(self, texts: list[bytes]):
        buf = np.frombuffer(b"\n".join(texts), np.uint8)
        s, e, h = scan_words(buf, ALNUM_WORDS, LOWER)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        owner = np.searchsorted(starts, s, "right") - 1
        self.n_words = np.bincount(owner, minlength=len(texts)).astype(np.int64)
        self.first = np.cumsum(self.n_words) - self.n_words
        self.hash, one, self.at = np.unique(h, return_index=True, return_inverse=True)
        size = e[one] - s[one]
        # each distinct word between two marks: ^word$
        wide = size + 2
        begin = np.cumsum(wide) - wide
        text = np.zeros(int(wide.sum()), np.uint8)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(begin + 1, size) + place] = LOWER[buf[np.repeat(s[one], size) + place]]
        text[begin], text[begin + wide - 1] = 1, 2
        codes, self.gram_count = [], np.zeros(len(one), np.int64)
        owners = []
        mine = np.repeat(np.arange(len(one)), wide)
        for k in (3, 4):
            if len(text) >= k:
                inside = mine[: len(text) - k + 1] == mine[k - 1 :]
                code = np.full(int(inside.sum()), k, U64)
                for j in range(k):
                    code = code * U64(257) + text[j : len(text) - k + 1 + j][inside]
                codes.append((mix(code) % U64(CHAR_BUCKETS)).astype(np.int64))
                owners.append(mine[: len(text) - k + 1][inside])
        grams, owned = (np.concatenate(codes), np.concatenate(owners)) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(owned, kind="stable")
        self.grams, self.gram_owner = grams[order], owned[order]
        self.gram_count = np.bincount(owned, minlength=len(one)).astype(np.int64)

    def windows(self, length: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word and number of words of every window; the last one ends with the text. No words, no window."""
        n = self.n_words
        count = np.where(n == 0, 0, np.where(n <= length, 1, -(-(n - length) // stride) + 1))
        doc = np.repeat(np.arange(len(n)), count)
        k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at = np.minimum(k * stride, np.maximum(0, n[doc] - length))
        return doc, self.first[doc] + at, np.minimum(length, n[doc])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, vocabulary: np.ndarray, rng: np.random.Generator):
        self.vocabulary = vocabulary  # sorted hashes; row 0 of the word vectors is for all other words
        wide = WORD_DIM + CHAR_DIM
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "word": draw(len(vocabulary) + 1, WORD_DIM, scale=0.05), "char": draw(CHAR_BUCKETS, CHAR_DIM, scale=0.05),
            "wx": draw(wide, 6 * HIDDEN, scale=wide**-0.5), "bx": np.zeros(6 * HIDDEN, np.float32),
            "uf": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), "ub": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
            "wa": draw(2 * HIDDEN, ATTENTION, scale=0.25), "ba": np.zeros(ATTENTION, np.float32), "va": draw(ATTENTION, scale=0.5),
            "wo": draw(2 * HIDDEN, scale=0.25), "bo": np.zeros(1, np.float32),
        }
        self.slope, self.shift = 1.0, 0.0

    def rows(self, words: Words) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(words.hash), np.int64)
        k = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[k] == words.hash, k + 1, 0)

    def features(self, words: Words) -> np.ndarray:
        """Input vectors of the distinct words."""
        chars = np.zeros((len(words.hash), CHAR_DIM), np.float32)
        if len(words.grams):
            begin = np.cumsum(words.gram_count) - words.gram_count
            some = words.gram_count > 0
            chars[some] = np.add.reduceat(self.p["char"][words.grams], begin[some], axis=0) / words.gram_count[some, None]
        return np.concatenate([self.p["word"][self.rows(words)], chars], axis=1)

    def forward(self, gates: np.ndarray, places: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of windows. gates: a row for each distinct word; places: the distinct word at each step; mask: which steps are words."""
        p, (n, steps) = self.p, places.shape
        states, kept = np.zeros((2, steps, n, HIDDEN), np.float32), []
        for d, u in enumerate((p["uf"], p["ub"])):
            h = np.zeros((n, HIDDEN), np.float32)
            mine = np.ascontiguousarray(gates[:, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)])
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                g, v = mine[places[:, t]], h @ u
                zr = _sigmoid(g[:, : 2 * HIDDEN] + v[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * v[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                if mask is not None:
                    new = np.where(mask[:, t, None], new, h)
                if keep:
                    kept.append((d, t, h, z, r, c, v[:, 2 * HIDDEN :]))
                h = new
                states[d, t] = h
        both = np.concatenate([states[0], states[1]], axis=2)  # steps, n, 2 HIDDEN
        a = np.tanh(both @ p["wa"] + p["ba"])
        e = a @ p["va"]
        if mask is not None:
            e = np.where(mask.T, e, -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * both).sum(0)
        logit = pooled @ p["wo"] + p["bo"][0]
        return (logit, (kept, both, a, w, pooled)) if keep else logit

    def logits(self, words: Words, doc: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        gates = self.features(words) @ self.p["wx"] + self.p["bx"]
        out = np.zeros(len(doc), np.float32)
        full = size == WINDOW
        for group, masked in ((np.flatnonzero(full), False), (np.flatnonzero(~full), True)):
            for k in range(0, len(group), 2048):
                at = group[k : k + 2048]
                steps = first[at, None] + np.arange(WINDOW)
                mask = np.arange(WINDOW) < size[at, None] if masked else None
                out[at] = self.forward(gates, words.at[np.where(mask, steps, first[at, None]) if masked else steps], mask)
        return out

    def worst(self, texts: list[bytes]) -> np.ndarray:
        """The highest window logit of each text; of an empty one the logit of nothing pooled."""
        words = Words(texts)
        out = np.full(len(texts), self.p["bo"][0], np.float32)
        doc, first, size = words.windows()
        if len(doc):
            logit = self.logits(words, doc, first, size)
            begin = np.flatnonzero(np.diff(doc, prepend=-1))
            out[doc[begin]] = np.maximum.reduceat(logit, begin)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(texts).astype(np.float64) + self.shift, -60, 60)))

    def gradients(self, words: Words, at: np.ndarray, first: np.ndarray, size: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        mask = np.arange(WINDOW) < size[:, None]
        places = words.at[np.where(mask, first[:, None] + np.arange(WINDOW), first[:, None])]
        distinct, back = np.unique(places, return_inverse=True)
        back = back.reshape(places.shape)
        x = at[distinct]
        gates = x @ p["wx"] + p["bx"]
        logit, (kept, both, a, w, pooled) = self.forward(gates, back, mask, keep=True)
        n = len(target)
        g = {"bo": np.zeros(1, np.float32)}
        d_logit = ((_sigmoid(logit) - target) / n).astype(np.float32)
        g["bo"][0], g["wo"] = d_logit.sum(), pooled.T @ d_logit
        d_pooled = d_logit[:, None] * p["wo"]
        d_both = w[:, :, None] * d_pooled
        d_w = (both * d_pooled).sum(2)
        d_e = w * (d_w - (w * d_w).sum(0))
        g["va"] = np.einsum("tna,tn->a", a, d_e)
        d_a = d_e[:, :, None] * p["va"] * (1 - a * a)
        g["wa"], g["ba"] = np.einsum("tnh,tna->ha", both, d_a), d_a.sum((0, 1))
        d_both += d_a @ p["wa"].T
        d_gates = np.zeros((WINDOW, n, 6 * HIDDEN), np.float32)
        g["uf"], g["ub"] = np.zeros_like(p["uf"]), np.zeros_like(p["ub"])
        flow = [np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)]
        for d, t, h, z, r, c, vn in reversed(kept):
            u, name = (p["uf"], "uf") if d == 0 else (p["ub"], "ub")
            dh = flow[d] + d_both[t, :, HIDDEN * d : HIDDEN * (d + 1)]
            live = np.where(mask[:, t, None], dh, 0)
            dc = live * (1 - z) * (1 - c * c)
            dz = live * (h - c) * z * (1 - z)
            dr = dc * vn * r * (1 - r)
            dv = np.concatenate([dz, dr, dc * r], axis=1)
            d_gates[t, :, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)] = np.concatenate([dz, dr, dc], axis=1)
            g[name] += h.T @ dv
            flow[d] = live * z + dv @ u.T + np.where(mask[:, t, None], 0, dh)
        spread = np.zeros((len(distinct), 6 * HIDDEN), np.float32)
        np.add.at(spread, back.T.ravel(), d_gates.reshape(-1, 6 * HIDDEN))
        g["wx"], g["bx"] = x.T @ spread, spread.sum(0)
        g["x"], g["distinct"] = spread @ p["wx"].T, distinct
        return g


def train(texts: list[bytes], toxic: np.ndarray, share: float | None = None) -> Network:
    """A network for labelled texts, the same for the same input. A fifth of the toxic ones and half of the clean ones not trained on
    throughout are kept to choose between epochs and to calibrate; the other half is searched for hard cases.

    share: of toxic ones among all labelled documents, where the sample is more even than they are; scores are calibrated to it.

    With one class only, or no texts, the network scores by the share of toxic labels alone.
    """
    rng = np.random.default_rng(SEED)
    toxic = np.asarray(toxic, np.float32)
    if not len(texts) or toxic.min() == toxic.max():
        net = Network(np.zeros(0, U64), rng)
        net.slope, net.shift = 0.0, float(np.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5)))
        return net
    n_toxic = int(toxic.sum())
    chance = np.where(toxic > 0, 0.8, min(0.8, 0.8 * max(LEAST_CLEAN, TRAIN_CLEAN * n_toxic) / (len(toxic) - n_toxic)))
    fit = rng.random(len(texts)) < chance
    searched = ~fit & (toxic == 0) & (rng.random(len(texts)) < 0.5)
    held = ~fit & ~searched
    if toxic[fit].min(initial=1) == toxic[fit].max(initial=0):
        fit[:], searched[:] = True, False
    if not held.any() or toxic[held].min() == toxic[held].max():
        held = fit.copy()
    check, answers = [t for t, h in zip(texts, held, strict=True) if h], toxic[held]
    fit |= searched
    texts, toxic, searched = [t for t, f in zip(texts, fit, strict=True) if f], toxic[fit], searched[fit]
    few = np.sort(np.concatenate([np.flatnonzero(answers > 0)[: CHOOSE // 2], np.flatnonzero(answers == 0)[: CHOOSE // 2]]))
    words = Words(texts)
    own = np.repeat(np.arange(len(texts)), words.n_words)
    # how many clean and toxic documents have each distinct word or n-gram
    pair = np.unique(own.astype(np.int64) * len(words.hash) + words.at)
    n = len(words.hash)
    pair_doc, pair_word = pair // n, pair % n
    docs_with = np.bincount(pair_word, minlength=n)
    odds = _log_odds(np.bincount(pair_word, weights=toxic[pair_doc], minlength=n), docs_with, toxic)
    frequent = np.flatnonzero(docs_with >= 3)
    net = Network(words.hash[frequent], rng)
    net.p["word"][1:, 0] += 0.3 * odds[frequent]
    by_word = np.cumsum(words.gram_count) - words.gram_count
    bad, seen = np.zeros(CHAR_BUCKETS), np.zeros(CHAR_BUCKETS)
    for at in range(0, len(texts), 64):  # a few documents at a time: their n-grams are many
        mine = slice(*np.searchsorted(pair_doc, [at, at + 64]))
        counts = words.gram_count[pair_word[mine]]
        gram_at = np.repeat(by_word[pair_word[mine]], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        of = np.unique(np.repeat(pair_doc[mine], counts) * CHAR_BUCKETS + words.grams[gram_at])
        seen += np.bincount(of % CHAR_BUCKETS, minlength=CHAR_BUCKETS)
        bad += np.bincount(of % CHAR_BUCKETS, weights=toxic[of // CHAR_BUCKETS], minlength=CHAR_BUCKETS)
    net.p["char"][:, 0] += 0.3 * _log_odds(bad, seen, toxic)

    doc, first, size = words.windows()
    row = net.rows(words)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step, best, best_loss = 0, None, np.inf
    epoch = 0
    while epoch < EPOCHS or step < LEAST_STEPS:
        epoch += 1
        logit = net.logits(words, doc, first, size)
        order = np.lexsort((-logit, doc))
        begin = np.flatnonzero(np.diff(doc[order], prepend=-1))
        rank = np.arange(len(doc)) - np.repeat(begin, np.diff(np.append(begin, len(doc))))
        y, pool = toxic[doc[order]] > 0, searched[doc[order]]
        hard = np.zeros(len(texts), bool)
        tops = order[(rank == 0) & pool]
        hard[doc[tops[np.argsort(-logit[tops], kind="stable")[: int(toxic.sum() / HARD_SHARE)]]]] = True
        use = order[np.where(y, rank < 2, np.where(pool, (rank == 0) & hard[doc[order]], (rank < 3) | (rng.random(len(doc)) < 0.1)))]
        rng.shuffle(use)
        features = net.features(words)
        for k in range(0, len(use), 128):
            part = use[k : k + 128]
            step += 1
            g = net.gradients(words, features, first[part], size[part], toxic[doc[part]])
            features = _step(net, words, row, g, moments, step, features)
        _, _, loss = _calibrate(net.worst([check[i] for i in few]), answers[few], share)
        if loss < best_loss:
            best, best_loss = {k: v.copy() for k, v in net.p.items()}, loss
    net.p = best
    net.slope, net.shift, _ = _calibrate(np.concatenate([net.worst(b) for b in _blocks(check)]), answers, share)
    return net


def _log_odds(bad: np.ndarray, all_: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log-odds of the toxic class by the numbers of toxic and of all documents an item is in, shrunk where there are few."""
    n_bad, n_all = toxic.sum(), len(toxic)
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((all_ - bad + 0.5) / (n_all - n_bad + 1))
    return (odds * all_ / (all_ + 4)).astype(np.float32)


def _step(net: Network, words: Words, row: np.ndarray, g: dict, moments: dict, step: int, features: np.ndarray) -> np.ndarray:
    """One Adam step; the features of the words that it touched are made anew."""
    d_x, distinct = g.pop("x"), g.pop("distinct")
    dense = dict(g)
    d_word = np.zeros_like(net.p["word"])
    np.add.at(d_word, row[distinct], d_x[:, :WORD_DIM])
    d_word[0] = 0
    counts = words.gram_count[distinct]
    begin = (np.cumsum(words.gram_count) - words.gram_count)[distinct]
    at = np.repeat(begin, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    d_char = np.zeros_like(net.p["char"])
    np.add.at(d_char, words.grams[at], np.repeat(d_x[:, WORD_DIM:] / np.maximum(1, counts)[:, None], counts, axis=0))
    dense |= {"word": d_word, "char": d_char}
    for k, d in dense.items():
        m, v = moments[k]
        m *= 0.9
        m += 0.1 * d
        v *= 0.999
        v += 0.001 * d * d
        rate = RATE * (0.3 if k in ("word", "char") else 1.0)
        net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    if step % 16 == 0:
        return net.features(words)
    return features


def _calibrate(logit: np.ndarray, toxic: np.ndarray, share: float | None) -> tuple[float, float, float]:
    """Slope and shift of a logistic fit by damped Newton steps with a little shrinkage of the slope, and its loss; the classes weigh as share says."""
    x, y = np.stack([logit.astype(np.float64), np.ones(len(logit))], axis=1), toxic.astype(np.float64)
    mine = (y.sum() + 0.5) / (len(y) + 1)
    weight = np.where(y > 0, (share or mine) / mine, (1 - (share or mine)) / (1 - mine))
    centre, scale = x[:, 0].mean(), x[:, 0].std() + 1e-6
    x[:, 0] = (x[:, 0] - centre) / scale
    cost = lambda w: float((weight * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() + 0.5 * SHRINK * w[0] ** 2)
    w = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag([SHRINK, 1e-6])
        step, length = np.linalg.solve(hess, x.T @ (weight * (q - y)) + np.array([SHRINK * w[0], 0])), 1.0
        while cost(w - length * step) > cost(w) and length > 1e-6:
            length /= 2
        w = w - length * step
        if np.abs(length * step).max() < 1e-8:
            break
    w = np.array([max(w[0], 1e-3) / scale, w[1] - max(w[0], 1e-3) / scale * centre])
    x[:, 0] = x[:, 0] * scale + centre
    q = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -40, 40))), 1e-9, 1 - 1e-9)
    return float(w[0]), float(w[1]), float(-(weight * (y * np.log(q) + (1 - y) * np.log(1 - q))).mean())


# ---- on Spark -------------------------------------------------------------------------------------------------


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, mod 5; null ids belong to no fold."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(FOLDS))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = SAMPLE_TOXIC) -> Network:
    """A network trained on at most most_toxic toxic and CLEAN_SHARE times as many clean labelled documents outside fold 0.

    The sample is chosen by a hash of the id, among labels that are 0 or 1; texts are gathered in the order of a hash, whatever their
    length, up to SAMPLE_BYTES. Of a clean text over LONG_BYTES a stretch of that length from a place chosen by hash is learned from, as its label
    holds for every part; a toxic text over LONG_BYTES is left out of the sample, as its label may not hold for a part.
    """
    key = F.col(f"`{id_col}`").cast("long")
    known = labels.select(key.alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter(fold(F.col("id")) != 0)
    n = {r.y: r["count"] for r in known.filter("y in (0, 1)").groupBy("y").count().collect()}
    share = min(0.95, max(0.001, n.get(1, 0) / max(1, sum(n.values()))))
    order = F.xxhash64("id", F.lit(SEED))
    sample = known.filter("y = 0").orderBy(order).limit(CLEAN_SHARE * most_toxic).unionByName(known.filter("y = 1").orderBy(order).limit(most_toxic))
    text = F.col("text")
    rows = docs.select(key.alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text")).filter("text is not null").join(F.broadcast(sample), "id")  # at most (1 + CLEAN_SHARE) * most_toxic rows
    begin = F.pmod(F.xxhash64("id", F.octet_length(text)), F.greatest(F.lit(1), F.octet_length(text) - LONG_BYTES)).cast("int") + 1
    rows = rows.filter((F.col("y") == 0) | (F.octet_length(text) <= LONG_BYTES)).withColumn("text", F.when(F.octet_length(text) > LONG_BYTES, F.substring(text, begin, F.lit(LONG_BYTES))).otherwise(text))
    found, held = [], 0
    for r in rows.orderBy(F.xxhash64("id", "text"), "id", "text").limit((1 + CLEAN_SHARE) * most_toxic).toLocalIterator():
        held += len(r.text)
        if held > SAMPLE_BYTES:
            break
        found.append((bytes(r.text), r.y, r.id))
    found.sort(key=lambda f: (zlib.crc32(str(f[2]).encode()), f[0]))
    return train([t for t, _, _ in found], np.array([y for _, y, _ in found], np.float32), share)


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def scorer(spark: SparkSession, net: Network):
    """A column function: text to score between 0 and 1; null counts as empty."""
    shared = spark.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [shared.value.score(b) for b in _blocks(utf8_column(texts))]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score


def scored(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """docs with score (double) and predicted (int); columns of these names are replaced. One narrow pass; repeated rows score alike."""
    return docs.withColumn("score", scorer(docs.sparkSession, net)(F.col(f"`{text_col}`"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document."""
    docs = table(spark, sf_dir, "documents")
    net = fitted(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), net).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
