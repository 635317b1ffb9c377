"""The pipeline's rows against a plain chain of its five stages."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from dayweave.llm import toxicity
from tests.llm.test_model_operators import SF, brute_components, brute_fingerprint
from tests.llm.test_text_operators import brute_contamination, brute_passages


def test_pipeline_equals_a_plain_chain(spark, tmp_path):
    rng, sf = random.Random(6), str(tmp_path)
    mixed = [(5000 + i, " ".join(rng.choice(["vile", "vilest", "ma", "na"] if i % 3 == 0 else ["ma", "na", "dor", "pel"]) + rng.choice(["", "", "s"]) for _ in range(60))) for i in range(180)]
    documents, labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    documents = documents.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in mixed] + [(6000, None, None, None, None), (6001, "", "en", "s", 0)], documents.schema))
    labels = labels.unionByName(spark.createDataFrame([(i, 1, int(i % 3 == 5000 % 3)) for i, _ in mixed], labels.schema))
    for name, df in (("documents", documents), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{sf}/{name}.parquet")
    docs = {r.doc_id: r.text for r in documents.collect()}
    net = toxicity.fitted(documents, labels)
    rejected = {i for i, t in docs.items() if net.score([(t or "").encode()])[0] >= 0.5}
    assert len(rejected & {i for i, _ in mixed if i % 3 == 5000 % 3}) > 50
    docs = {i: t for i, t in docs.items() if i not in rejected}

    ids = sorted(docs)
    shortened = {d: t for d, _, _, _, t in brute_passages([docs[i] for i in ids], ids)}
    assert any(shortened[i] != docs[i] for i in ids)

    fps = {i: brute_fingerprint(t) for i, t in shortened.items()}
    group = brute_components(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    left = [i for i in ids if group[i] == i]
    assert len(left) < len(ids)

    verdicts = brute_contamination([shortened[i] for i in left], [(r.item_id, r.text) for r in benchmark.collect()])
    clean = [i for i, v in zip(left, verdicts) if not v[4]]
    assert len(clean) < len(left)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert sorted(got) == clean
    for i in clean:
        raw = (shortened[i] or "").encode()
        assert got[i].decoded_sha256 == hashlib.sha256(raw).hexdigest()
        tokens = np.array(coder.encode_ordinary(raw.decode()), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(tokens), hashlib.sha256(tokens.tobytes()).hexdigest())
