"""Classifier and identity evaluation queries over embeddings and labels, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.functions.arrays import argmax, mean_of
from dayweave.operators import identity as I
from dayweave.operators import metrics as M
from dayweave.operators.splits import subject_split
from dayweave.sources.domain import table

K = 10
STREAMS = ["bone", "bone_motion", "joint", "joint_motion"]
TAUS = [0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5]


def val_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """window_id, y, subject and four streams of ten logits each, cut from the embeddings."""
    e = table(spark, sf_dir, "embeddings").filter("embedding is not null and label is not null")
    cut = lambda i: F.transform(F.slice("embedding", 10 * i + 1, 10), lambda x: x.cast("double") * 10)
    return e.select(F.col("vec_id").alias("window_id"), F.col("label").cast("int").alias("y"), (F.col("vec_id") % 20).alias("subject"), *[cut(i).alias(s) for i, s in enumerate(STREAMS)])


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = val_logits(spark, sf_dir)
    return v.withColumn("fused", mean_of([F.col(s) for s in STREAMS])).withColumn("pred", argmax(F.col("fused")))


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").filter("embedding is not null and label is not null")
    return e.select(F.col("label").cast("long").alias("pid"), (F.col("vec_id") % 4).alias("camera"), F.col("vec_id").alias("frame"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.open_set_split(crops(spark, sf_dir), 5, 5, 4, 10, 8)


def protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every crop of ids that grow with the table (a label within 200 vectors): half of the eligible ids enrolled, the others impostors."""
    c = crops(spark, sf_dir)
    return I.whole_protocol(c.withColumn("pid", F.col("pid") + 16 * F.floor(F.col("frame") / 200).cast("long")))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score (length share, in four decimals), target (quality) and dataset (language) of labelled documents."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select("doc_id", "lang", F.round(F.col("n_chars") / 50000, 4).alias("score"), F.col("quality").alias("target"))


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


def q_scores(s, d):
    return _r(M.scores(predicted(s, d)))


def q_per_class(s, d):
    return _r(M.per_class(M.confusion(predicted(s, d), []), []))


def q_subsets(s, d):
    return _r(M.subset_scores(val_logits(s, d), STREAMS))


def q_taus(s, d):
    return _r(M.tau_sweep(predicted(s, d), "fused", K, TAUS, (0.5, 1.0, 2.0)))


def q_weights(s, d):
    return _r(M.effective_weights(val_logits(s, d), K))


def q_weighted_sample(s, d):
    """Windows drawn with replacement so that classes count alike."""
    w = M.effective_weights(val_logits(s, d), K).select(F.col("class").cast("int").alias("y"), F.round("sampler_weight", 9).alias("w"))
    rows = val_logits(s, d).select("window_id", "y").join(F.broadcast(w), "y")  # K rows
    return M.weighted_sample(rows, "w", None, F.concat(F.lit("draw|"), F.col("window_id").cast("string"))).groupBy("window_id", "y").agg(F.count("*").alias("n_copies"))


def q_prior(s, d):
    return _r(M.class_counts(val_logits(s, d), K))


def q_transitions(s, d):
    return _r(M.transition_counts(val_logits(s, d), K, "subject", "window_id"))


def q_fragmentation(s, d):
    return _r(M.fragmentation(predicted(s, d), "subject", "window_id"))


def q_temperature(s, d):
    return _r(M.best_temperature(predicted(s, d), "fused"), 5)


def q_auroc(s, d):
    return _r(M.auroc(scored_documents(s, d), "score", "target"))


def q_auroc_by_dataset(s, d):
    """One held-out corpus at a time: the ranking quality within each."""
    return _r(M.auroc(scored_documents(s, d), "score", "target", ["lang"]))


def q_auprc(s, d):
    return _r(M.auprc(scored_documents(s, d), "score", "target"))


def q_fall_point(s, d):
    return _r(M.fall_operating_point(scored_documents(s, d), "score", "target", 60.0, 6.0))


def q_split(s, d):
    return split(s, d).drop("vector")


def q_leaks(s, d):
    return I.leaks(protocol(s, d))


def q_split_summary(s, d):
    return protocol(s, d).groupBy("part").agg(F.count("*").alias("n_crops"), F.count_distinct("pid").alias("n_ids"), (F.count("*") / F.count_distinct("pid")).alias("per_id"))


def q_distances(s, d):
    return _r(I.distances(protocol(s, d)))


def q_distances_blocks(s, d):
    """As nearest_two, with a gallery in blocks of a few centroids, one pass each."""
    return _r(I.distances(protocol(s, d), block_bytes=2000))


def q_auroc_rank(s, d):
    """One held-out corpus at a time, ties in the order of ids."""
    return _r(M.auroc_by_rank(scored_documents(s, d), "score", "target", "doc_id", ["lang"]))


def q_sweep(s, d):
    return _r(I.sweep(I.distances(protocol(s, d))))


def q_threshold(s, d):
    return _r(I.fit_threshold(I.sweep(I.distances(protocol(s, d))), 0.1))


def q_eer(s, d):
    return _r(I.equal_error(I.sweep(I.distances(protocol(s, d)))))


def q_identity_profile(s, d):
    return _r(I.profile(I.distances(protocol(s, d))))


def q_identity_auroc(s, d):
    return _r(I.separation(I.distances(protocol(s, d))))


def q_operating_point(s, d):
    """Fit on one half of the identities, report on the other."""
    halves = I.split_halves(protocol(s, d))
    far = I.fit_threshold(I.sweep(I.distances(halves.filter("half = 'fit'"))), 0.1).select("threshold")
    test = I.distances(halves.filter("half = 'test'")).crossJoin(F.broadcast(far))  # one row
    return _r(I._rates(test.withColumn("_in", F.col("best") < F.col("threshold")), ("threshold",)))


def q_subject_split(s, d):
    """Subjects held out for validation: a fifth of them by hash, at least one."""
    v = val_logits(s, d)
    return subject_split(v)


def q_control(s, d):
    """The identity protocol on vectors that know nothing of identity, beside the real ones."""
    c = crops(s, d)
    split_of = lambda rows: I.whole_protocol(rows.withColumn("pid", F.col("pid") + 16 * F.floor(F.col("frame") / 200).cast("long")))
    return _r(I.control_gap(I.distances(split_of(c)), I.distances(split_of(I.negative_control(c)))))


QUERIES = {
    "identity_control": q_control,
    "classification_scores": q_scores, "per_class": q_per_class, "stream_subsets": q_subsets, "tau_sweep": q_taus, "class_weights": q_weights, "class_prior": q_prior, "weighted_sample": q_weighted_sample, "transition_matrix": q_transitions,
    "fragmentation": q_fragmentation, "temperature": q_temperature, "auroc": q_auroc, "auroc_by_dataset": q_auroc_by_dataset, "auprc": q_auprc, "fall_operating_point": q_fall_point,
    "open_set_split": q_split, "split_leaks": q_leaks, "split_summary": q_split_summary, "nearest_two": q_distances, "nearest_two_blocks": q_distances_blocks, "auroc_by_rank": q_auroc_rank, "threshold_sweep": q_sweep, "fit_threshold": q_threshold, "equal_error": q_eer,
    "identity_profile": q_identity_profile, "identity_auroc": q_identity_auroc, "identity_operating_point": q_operating_point, "subject_split": q_subject_split,
}

# ---- SQL ------------------------------------------------------------------------------------------------------

_CUTS = ", ".join(f"list_transform(embedding[{10 * i + 1}:{10 * i + 10}], lambda x: x::DOUBLE * 10) AS {s}" for i, s in enumerate(STREAMS))
_VAL = f"val AS (SELECT vec_id AS window_id, label::INT AS y, vec_id % 20 AS subject, {_CUTS} FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)"
_ARG = "list_position({0}, list_max({0})) - 1"
_FUSED = "list_transform(range(1, 11), lambda i: (bone[i] + bone_motion[i] + joint[i] + joint_motion[i]) / 4)"
_PRED = f"{_VAL}, p AS (SELECT *, {_ARG.format('fused')} AS pred FROM (SELECT *, {_FUSED} AS fused FROM val))"


def _scores(source: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    using = f"USING ({by}, c)" if by else "USING (c)"
    return f"""yc AS (SELECT {b}y AS c, count(*) AS ny, count(*) FILTER (WHERE pred = y) AS tp FROM {source} GROUP BY ALL),
pc AS (SELECT {b}pred AS c, count(*) AS np FROM {source} GROUP BY ALL),
cl AS (SELECT {b}c AS class, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, coalesce(ny, 0) - coalesce(tp, 0) AS fn, coalesce(ny, 0) AS support FROM yc FULL JOIN pc {using}),
sc AS (SELECT {b}round(sum(tp) / sum(support), 6) AS top1, round(avg(CASE WHEN support > 0 THEN tp / support END), 6) AS mean_class, round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS macro_f1,
  round(avg(CASE WHEN support > 0 THEN 2 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1_present, round(avg(CASE WHEN support >= 50 THEN 2 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1_supported, sum(support)::BIGINT AS n FROM cl GROUP BY ALL)"""


_SOFT = lambda s: f"list_transform({s}, lambda v: exp(v - list_max({s})) / list_sum(list_transform({s}, lambda u: exp(u - list_max({s})))))"
_OPTIONS = []
for _c in M.subsets(STREAMS):
    _mean = " + ".join(f"{s}[i]" for s in _c)
    _prob = " + ".join(f"p_{s}[i]" for s in _c)
    _OPTIONS += [f"SELECT y, '{'+'.join(_c)}' AS streams, 'logit' AS mode, list_transform(range(1, 11), lambda i: ({_mean}) / {len(_c)}) AS z FROM soft", f"SELECT y, '{'+'.join(_c)}', 'prob', list_transform(range(1, 11), lambda i: ln(greatest(({_prob}) / {len(_c)}, 1e-12))) FROM soft"]
_PRIOR = "counts AS (SELECT c, greatest(1, count(y)) AS n, count(y) AS seen FROM range(10) r(c) LEFT JOIN val ON y = c GROUP BY c), prior AS (SELECT c, n, seen, n / sum(n) OVER () AS prior FROM counts)"

_DOCS = "docs AS (SELECT doc_id, lang, round(n_chars / 50000, 4) AS score, quality AS target FROM documents JOIN labels USING (doc_id))"
_ROC = "sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END)"
_CURVE = f"""{_DOCS},
s AS (SELECT score, count(*) FILTER (WHERE target = 1) AS pos, count(*) FILTER (WHERE target <> 1) AS neg FROM docs GROUP BY score),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM s WINDOW w AS (ORDER BY score DESC))"""

_H = lambda *cs: "md5('0|' || " + " || '|' || ".join(cs) + ")"
_SPLIT = f"""crops AS (SELECT label::BIGINT AS pid, vec_id % 4 AS camera, vec_id AS frame, list_transform(embedding, lambda x: x::DOUBLE) AS vector FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
cams AS (SELECT pid, camera, n FROM (SELECT pid, camera, count(*) AS n, count(*) OVER (PARTITION BY pid) AS cams FROM crops GROUP BY pid, camera) WHERE n >= 4 AND cams >= 2),
chosen AS (SELECT pid, arg_min(camera, {_H('pid', 'camera')}) AS enrol_camera FROM cams GROUP BY pid),
enrolled AS (SELECT * FROM chosen ORDER BY {_H('pid')} LIMIT 5),
others AS (SELECT DISTINCT pid FROM crops WHERE pid NOT IN (SELECT pid FROM enrolled)),
ids AS (SELECT pid, enrol_camera FROM enrolled UNION ALL (SELECT pid, NULL FROM others ORDER BY {_H('pid')} LIMIT 5)),
parts AS (SELECT c.*, CASE WHEN enrol_camera IS NULL THEN 'impostor' WHEN camera = enrol_camera THEN 'enrolment' ELSE 'genuine' END AS part FROM crops c JOIN ids USING (pid)),
split AS (SELECT pid, camera, frame, vector, part FROM (SELECT *, row_number() OVER (PARTITION BY pid, part ORDER BY {_H('pid', 'frame')}) AS k FROM parts) WHERE k <= CASE part WHEN 'enrolment' THEN 4 WHEN 'genuine' THEN 10 ELSE 8 END)"""


_PROTOCOL = f"""crops AS (SELECT label::BIGINT + 16 * (vec_id // 200) AS pid, vec_id % 4 AS camera, vec_id AS frame, list_transform(embedding, lambda x: x::DOUBLE) AS vector FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
cams AS (SELECT pid, camera, n FROM (SELECT pid, camera, count(*) AS n, count(*) OVER (PARTITION BY pid) AS cams FROM crops GROUP BY pid, camera) WHERE n >= 4 AND cams >= 2),
chosen AS (SELECT pid, arg_min(camera, {_H('pid', 'camera')}) AS enrol_camera FROM cams WHERE ('0x' || substr({_H('pid')}, 1, 8))::BIGINT / 4294967296.0 < 0.5 GROUP BY pid),
split AS (SELECT c.*, CASE WHEN enrol_camera IS NULL THEN 'impostor' WHEN camera = enrol_camera THEN 'enrolment' ELSE 'genuine' END AS part FROM crops c LEFT JOIN chosen USING (pid))"""


def _distances(split: str, name: str) -> str:
    unit = "list_transform({0}, lambda x: x / sqrt(list_dot_product({0}, {0})))"
    return f"""{name}_n AS (SELECT *, {unit.format('vector')} AS u FROM {split}),
{name}_c AS (SELECT pid, list(m ORDER BY i) AS v FROM (SELECT pid, i, avg(u[i]) AS m FROM {name}_n, range(1, 65) r(i) WHERE part = 'enrolment' GROUP BY pid, i) GROUP BY pid),
{name}_g AS (SELECT pid, {unit.format('v')} AS g FROM {name}_c),
{name}_m AS (SELECT p.pid, p.frame, p.part, g.pid AS who, 1 - list_dot_product(p.u, g.g) AS d FROM {name}_n p, {name}_g g WHERE p.part <> 'enrolment'),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY pid, frame, part ORDER BY d, who) AS k, lead(d) OVER (PARTITION BY pid, frame, part ORDER BY d, who) AS d2 FROM {name}_m),
{name} AS (SELECT pid, frame, part, d AS best, who, coalesce(d2 - d, 'inf'::DOUBLE) AS gap, who = pid AS correct FROM {name}_r WHERE k = 1)"""


def _sweep(source: str, name: str) -> str:
    return f"""{name}_e AS (SELECT lo - 0.02 * greatest(hi - lo, 1e-6) AS t0, ((hi + 0.02 * greatest(hi - lo, 1e-6)) - (lo - 0.02 * greatest(hi - lo, 1e-6))) / 511 AS dt FROM (SELECT min(best) AS lo, max(best) AS hi FROM {source})),
{name} AS (SELECT k::INT AS k, t0 + k * dt AS threshold, (count(*) FILTER (WHERE part = 'impostor' AND best < t0 + k * dt)) / count(*) FILTER (WHERE part = 'impostor') AS far, (count(*) FILTER (WHERE part = 'genuine' AND best < t0 + k * dt)) / count(*) FILTER (WHERE part = 'genuine') AS tar,
  (count(*) FILTER (WHERE part = 'genuine' AND correct AND best < t0 + k * dt)) / count(*) FILTER (WHERE part = 'genuine') AS dir_rank1 FROM {source}, {name}_e, range(512) r(k) GROUP BY k, t0, dt)"""


_D = f"{_PROTOCOL}, {_distances('split', 'd')}"
_PICK = "SELECT threshold, far, tar, 1 - tar AS frr, dir_rank1, far <= 0.1 AS feasible FROM {} ORDER BY far <= 0.1 DESC, CASE WHEN far <= 0.1 THEN -tar ELSE far END, threshold LIMIT 1"
_HALF = f"""{_PROTOCOL},
sides AS (SELECT DISTINCT pid, CASE WHEN part = 'impostor' THEN 'impostor' ELSE 'enrolled' END AS side FROM split),
half AS (SELECT pid, CASE WHEN row_number() OVER (PARTITION BY side ORDER BY md5('half|' || pid)) <= greatest(1, floor(count(*) OVER (PARTITION BY side) / 2)) THEN 'fit' ELSE 'test' END AS half FROM sides),
fit_s AS (SELECT s.* FROM split s JOIN half USING (pid) WHERE half = 'fit'), test_s AS (SELECT s.* FROM split s JOIN half USING (pid) WHERE half = 'test'),
{_distances('fit_s', 'fd')}, {_distances('test_s', 'td')}, {_sweep('fd', 'fs')}, pick AS ({_PICK.format('fs')})"""

_AUC = lambda d: f"(SELECT sum(CASE WHEN a.best < b.best THEN 1 WHEN a.best = b.best THEN 0.5 ELSE 0 END) / count(*) FROM {d} a, {d} b WHERE a.part = 'genuine' AND b.part = 'impostor')"
_TURN = "(('0x' || substr(md5(frame::VARCHAR), 1, 7))::BIGINT % 64)"
ORACLES = {
    "identity_control": f"WITH {_D}, turned AS (SELECT * EXCLUDE (vector), list_concat(vector[{_TURN} + 1:], vector[:{_TURN}]) AS vector FROM split), {_distances('turned', 'n')}, r AS (SELECT {_AUC('d')} AS a, {_AUC('n')} AS c) SELECT round(a, 6) AS auroc, round(c, 6) AS control_auroc, round(a - c, 6) AS gap, a - c >= 0.1 AS ok FROM r",
    "classification_scores": f"WITH {_PRED}, {_scores('p')} SELECT * FROM sc",
    "per_class": f"WITH {_PRED}, {_scores('p')} SELECT class::INT AS class, tp, fp, fn, support, round(CASE WHEN support > 0 THEN tp / support END, 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM cl",
    "stream_subsets": f"WITH {_VAL}, soft AS (SELECT *, {', '.join(f'{_SOFT(s)} AS p_{s}' for s in STREAMS)} FROM val), o AS (SELECT *, {_ARG.format('z')} AS pred FROM ({' UNION ALL '.join(_OPTIONS)})), {_scores('o', 'streams, mode')} SELECT * FROM sc",
    "tau_sweep": f"WITH {_PRED}, {_PRIOR}, lp AS (SELECT list(ln(prior) ORDER BY c) AS l FROM prior), o AS (SELECT y, tau, temperature, {_ARG.format('z')} AS pred FROM (SELECT y, tau, temperature, list_transform(range(1, 11), lambda i: fused[i] / temperature - tau * l[i]) AS z FROM p, lp, (SELECT unnest({TAUS}::DOUBLE[]) AS tau), (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS temperature))), {_scores('o', 'tau, temperature')} SELECT * FROM sc",
    "class_weights": f"WITH {_VAL}, {_PRIOR}, w AS (SELECT c, seen, (1 - 0.9999::DOUBLE) / (1 - pow(0.9999::DOUBLE, n)) AS raw FROM prior) SELECT c AS class, seen AS n, round(raw / avg(raw) OVER (), 6) AS weight, round(CASE WHEN seen > 0 THEN raw / sum(CASE WHEN seen > 0 THEN raw END) OVER () * sum((seen > 0)::INT) OVER () ELSE 0 END, 6) AS sampler_weight FROM w",
    "weighted_sample": f"""WITH {_VAL}, {_PRIOR}, e AS (SELECT c, seen, (1 - 0.9999::DOUBLE) / (1 - pow(0.9999::DOUBLE, n)) AS raw FROM prior),
w AS (SELECT c, round(raw / sum(CASE WHEN seen > 0 THEN raw END) OVER () * sum((seen > 0)::INT) OVER (), 9) AS w FROM e), s AS (SELECT window_id, y, w * count(*) OVER () / sum(w) OVER () AS share FROM val JOIN w ON y = c),
t AS (SELECT window_id, y, (floor(share) + (('0x' || substr(md5('draw|' || window_id), 1, 8))::BIGINT / 4294967296.0 < share - floor(share))::INT)::BIGINT AS n_copies FROM s)
SELECT * FROM t WHERE n_copies > 0""",
    "class_prior": f"WITH {_VAL}, {_PRIOR} SELECT c AS class, n, round(prior, 6) AS prior FROM prior",
    "transition_matrix": f'WITH {_VAL}, b AS (SELECT y AS f, lead(y) OVER (PARTITION BY subject ORDER BY window_id) AS t FROM val), n AS (SELECT f, t, count(*) AS n FROM b WHERE t IS NOT NULL GROUP BY ALL), g AS (SELECT a.c AS f, b.c AS t, coalesce(n, 0) + 1.0 AS k FROM range(10) a(c) CROSS JOIN range(10) b(c) LEFT JOIN n ON f = a.c AND t = b.c) SELECT f AS "from", t AS "to", round(k / sum(k) OVER (PARTITION BY f), 6) AS probability FROM g',
    "fragmentation": f"WITH {_PRED}, r AS (SELECT subject, coalesce(lag(pred) OVER w <> pred, true)::INT AS p, coalesce(lag(y) OVER w <> y, true)::INT AS t FROM p WINDOW w AS (PARTITION BY subject ORDER BY window_id)) SELECT sum(p)::BIGINT AS segments_pred, sum(t)::BIGINT AS segments_true, count(DISTINCT subject) AS n_sequences, round(sum(p) / count(DISTINCT subject), 6) AS per_sequence, round(sum(p) / sum(t), 6) AS ratio FROM r",
    "temperature": f"WITH {_PRED}, g AS (SELECT t / 100 AS t, avg(round(-ln(greatest(exp((fused[y + 1] - list_max(fused)) / (t / 100)) / list_sum(list_transform(fused, lambda v: exp((v - list_max(fused)) / (t / 100)))), 1e-12)), 12)) AS nll FROM p, range(25, 501) r(t) GROUP BY r.t) SELECT t AS temperature, round(nll, 5) AS nll FROM g ORDER BY g.nll, t LIMIT 1",
    "auroc": f"WITH {_DOCS} SELECT round({_ROC} / count(*), 6) AS auroc, count(DISTINCT a.doc_id) AS n_pos, count(DISTINCT b.doc_id) AS n_neg FROM docs a, docs b WHERE a.target = 1 AND b.target <> 1",
    "auroc_by_dataset": f"WITH {_DOCS}, n AS (SELECT lang, count(*) FILTER (WHERE target = 1) AS n_pos, count(*) FILTER (WHERE target <> 1) AS n_neg FROM docs GROUP BY lang), p AS (SELECT a.lang, {_ROC} AS s FROM docs a, docs b WHERE a.lang = b.lang AND a.target = 1 AND b.target <> 1 GROUP BY a.lang) SELECT lang, CASE WHEN n_pos * n_neg = 0 THEN 'nan'::DOUBLE ELSE round(s / (n_pos * n_neg), 6) END AS auroc, n_pos, n_neg FROM n LEFT JOIN p USING (lang)",
    "auprc": f"WITH {_CURVE} SELECT round(sum(pos * (cp / (cp + cn) + CASE WHEN cp - pos + cn - neg > 0 THEN (cp - pos) / (cp - pos + cn - neg) ELSE cp / (cp + cn) END) / 2) / max(np), 6) AS auprc, round(sum(neg * (2 * cp - pos) / 2) / max(np * nn), 6) AS auroc, round(max(np) / max(np + nn), 6) AS positive_rate FROM c",
    "fall_operating_point": f"WITH {_CURVE} SELECT score AS threshold, round(cp / np, 6) AS sensitivity, round(cn / (nn * 60 / 3600), 6) AS false_alarms_per_hour, round(1 - cn / nn, 6) AS specificity, round(nn * 60 / 3600, 6) AS monitored_hours, cn / (nn * 60 / 3600) <= 6 AS feasible FROM c ORDER BY cn / (nn * 60 / 3600) <= 6 DESC, CASE WHEN cn / (nn * 60 / 3600) <= 6 THEN -cp ELSE cn END, score LIMIT 1",
    "open_set_split": f"WITH {_SPLIT} SELECT pid, camera, frame, part FROM split",
    "split_leaks": f"WITH {_PROTOCOL} SELECT 'enrolled_impostor' AS leak, a.pid || '' AS key FROM split a JOIN split b USING (pid) WHERE a.part = 'enrolment' AND b.part = 'impostor' UNION SELECT 'camera', a.pid || '|' || a.camera FROM split a JOIN split b USING (pid, camera) WHERE a.part = 'enrolment' AND b.part = 'genuine'",
    "split_summary": f"WITH {_PROTOCOL} SELECT part, count(*) AS n_crops, count(DISTINCT pid) AS n_ids, count(*) / count(DISTINCT pid) AS per_id FROM split GROUP BY part",
    "nearest_two": f"WITH {_D} SELECT pid, frame, part, round(best, 6) AS best, who, round(gap, 6) AS gap, correct FROM d",
    "nearest_two_blocks": f"WITH {_D} SELECT pid, frame, part, round(best, 6) AS best, who, round(gap, 6) AS gap, correct FROM d",
    "auroc_by_rank": f"WITH {_DOCS}, r AS (SELECT lang, target, row_number() OVER (PARTITION BY lang ORDER BY score, doc_id) AS k FROM docs), g AS (SELECT lang, coalesce(sum(k) FILTER (WHERE target = 1), 0) AS ranks, count(*) FILTER (WHERE target = 1) AS n_pos, count(*) FILTER (WHERE target <> 1) AS n_neg FROM r GROUP BY lang) SELECT lang, CASE WHEN n_pos * n_neg = 0 THEN 'nan'::DOUBLE ELSE round((ranks - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) END AS auroc, n_pos, n_neg FROM g",
    "threshold_sweep": f"WITH {_D}, {_sweep('d', 's')} SELECT k, round(threshold, 6) AS threshold, round(far, 6) AS far, round(tar, 6) AS tar, round(dir_rank1, 6) AS dir_rank1, round(1 - tar, 6) AS frr FROM s",
    "fit_threshold": f"WITH {_D}, {_sweep('d', 's')}, pick AS ({_PICK.format('s')}) SELECT round(threshold, 6) AS threshold, round(far, 6) AS far, round(tar, 6) AS tar, round(frr, 6) AS frr, round(dir_rank1, 6) AS dir_rank1, feasible FROM pick",
    "equal_error": f"WITH {_D}, {_sweep('d', 's')} SELECT round((far + 1 - tar) / 2, 6) AS eer, round(threshold, 6) AS threshold FROM s ORDER BY round(abs(far - (1 - tar)), 12), s.threshold LIMIT 1",
    "identity_profile": f"WITH {_D} SELECT part, count(*) AS n, round(avg(CASE WHEN part = 'genuine' THEN correct::INT END), 6) AS rank1, round(avg(best), 6) AS mean, round(quantile_cont(best, 0.05), 6) AS p05, round(quantile_cont(best, 0.5), 6) AS median, round(quantile_cont(best, 0.95), 6) AS p95 FROM d GROUP BY part",
    "identity_auroc": f"WITH {_D} SELECT round(sum(CASE WHEN a.best < b.best THEN 1 WHEN a.best = b.best THEN 0.5 ELSE 0 END) / count(*), 6) AS auroc, count(DISTINCT a.frame) AS n_pos, count(DISTINCT b.frame) AS n_neg FROM d a, d b WHERE a.part = 'genuine' AND b.part = 'impostor'",
    "identity_operating_point": f"WITH {_HALF} SELECT round(threshold, 6) AS threshold, round(avg(CASE WHEN part = 'impostor' THEN (best < threshold)::INT END), 6) AS far, round(avg(CASE WHEN part = 'genuine' THEN (best < threshold)::INT END), 6) AS tar, round(avg(CASE WHEN part = 'genuine' THEN (best < threshold AND correct)::INT END), 6) AS dir_rank1, round(1 - avg(CASE WHEN part = 'genuine' THEN (best < threshold)::INT END), 6) AS frr FROM td, (SELECT threshold FROM pick) GROUP BY threshold",
    "subject_split": f"WITH {_VAL}, u AS (SELECT subject, count(*) AS n FROM val GROUP BY subject) SELECT subject, n, CASE WHEN row_number() OVER (ORDER BY md5('split|' || subject)) <= greatest(1, floor(count(*) OVER () * 0.2)) THEN 'validation' ELSE 'train' END AS part FROM u",
}
