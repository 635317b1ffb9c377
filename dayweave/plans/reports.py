"""Queries on what reports are made from, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayweave.operators import claims as C
from dayweave.operators import reports as R
from dayweave.operators.alerts import alerts
from dayweave.operators.baseline import with_baselines
from dayweave.operators.metrics import scores
from dayweave.plans.behaviour import features, scored
from dayweave.plans.behaviour_sql import ALERTS, BASELINES
from dayweave.plans.claims import _STATE, _VERIFIED, _all_verified, _state
from dayweave.plans.evaluation import _ARG, _FUSED, _PRIOR, _VAL, K, _scores, predicted
from dayweave.plans.observations import COARSE
from dayweave.sources import sinks
from dayweave.sources.shared import staged

TAUS, TEMPERATURES = [0.0, 0.25, 0.5, 0.75, 1.0], [0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0]


def q_top_deviations(s, d):
    return R.top_deviations(with_baselines(features(s, d)))


def q_withheld(s, d):
    """How many days show their deviations, are withheld as unreliable, or have no baseline."""
    from dayweave.operators.baseline import is_reliable

    f = with_baselines(features(s, d))
    why = F.when(~is_reliable(), "withheld").when(F.col("z").isNull(), "no baseline").otherwise("shown")
    return f.groupBy(why.alias("deviations")).agg(F.count("*").alias("n"))


def q_cohort(s, d):
    """The first day of homes 5 to 9, as of homes without a history, against the last baseline of homes 0 to 4."""
    f = features(s, d)
    first = f.filter("home_id >= 5").groupBy("home_id").agg(F.min("day").alias("_d"))
    days = f.join(first, "home_id").filter("day = _d").drop("_d").withColumn("cohort_id", F.col("home_id") - 5)
    r = R.against_cohort(days, R.latest_baselines(with_baselines(f.filter("home_id < 5"))))
    return r.select("home_id", "cohort_id", "day", "reference_day", F.col("baseline_days").cast("long").alias("baseline_days"), "feature", *[F.round(c, 6).alias(c) for c in ("value", "median", "z", "pct_change")], "baseline_provenance", "subject_provenance")


def q_alerting(s, d):
    st = staged(scored(s, d), "state")  # states and alerts both read it
    return R.alerting_states(st.filter("z is not null"), alerts(st))


def q_prompt_rows(s, d):
    p = R.prompt_rows(C.payload(scored(s, d)))
    first = F.from_json("template", "array<struct<evidence_ref: string, feature: string, value: double, pct: double, direction: string, observed_in_window: boolean, baseline_comparable: boolean>>")
    return p.select("home_id", "day", F.col("n_rows"), F.explode(first).alias("r")).select("home_id", "day", "n_rows", "r.*")


def q_prompts(s, d):
    """The whole prompt of each day."""
    return R.prompts(C.payload(scored(s, d)), "Report the day.")


def q_heads(s, d):
    st, a = _state(s, d)
    return R.report_heads(C.ranked(C.payload(st), a), a)


def q_agreed(s, d):
    """Claims that two verifiers pass: the other one has no verdict on every third claim and is stricter on values."""
    v = _all_verified(s, d)
    other = v.filter("substr(claim_id, 2) % 3 <> 0").select("arm", "home_id", "day", "claim_id", "ref_exists", (F.col("value_matches") & (F.coalesce("claimed_value", F.lit(0.0)) < 500)).alias("value_matches"))
    return R.agreed(v, other, ["ref_exists", "value_matches"], ["arm", "home_id", "day"]).select("arm", "home_id", "day", "claim_id", "faithful", "accepted")


def q_state_sink(s, d):
    """Daily features and alerts analysed twice, the second time with the later days only: what the tables hold."""
    f, a = features(s, d), alerts(scored(s, d)).select("home_id", "day", "alert_id")
    twice = lambda df, keys: sinks.upsert(df.withColumn("run", F.lit(1)), df.filter("day >= date'2024-01-15'").withColumn("run", F.lit(2)), keys, "run").groupBy("run").agg(F.count("*").alias("n"))
    return twice(f, ["home_id", "day"]).withColumn("table", F.lit("daily_features")).unionByName(twice(a, ["alert_id"]).withColumn("table", F.lit("alerts")))


def q_rescoring(s, d):
    """Fine, coarse by the fine winner's class and coarse by pooled logits, for every tau and temperature."""
    from dayweave.functions.arrays import adjusted, argmax
    from dayweave.operators.decode import pooled
    from dayweave.operators.metrics import log_prior

    p = predicted(s, d)
    of = F.array(*[F.lit(next(i for i, m in enumerate(COARSE) if k in m)) for k in range(K)])
    rows = p.crossJoin(F.broadcast(log_prior(p, K)))  # one row
    z = lambda tau, t: F.transform(adjusted(F.col("fused"), F.col("log_prior"), tau), lambda x: x / t)
    cells = F.array(*[F.struct(F.lit(tau).alias("tau"), F.lit(t).alias("temperature"), argmax(z(tau, t)).alias("fine"), argmax(pooled(z(tau, t), COARSE)).alias("lse")) for tau in TAUS for t in TEMPERATURES])
    r = rows.select("y", F.inline(cells)).withColumn("coarse_y", F.get(of, F.col("y")))
    by = ["tau", "temperature"]
    one = lambda name, y, pred: scores(r.select(*by, F.col(y).alias("y"), pred.alias("pred")), by).select(*by, F.round("mean_class", 6).alias(f"{name}_mean_class"), F.round("top1", 6).alias(f"{name}_top1"))
    return one("fine", "y", F.col("fine")).join(one("argmax", "coarse_y", F.get(of, F.col("fine"))), by).join(one("lse", "coarse_y", F.col("lse")), by)


def q_rescoring_check(s, d):
    """tau, moved: whether the fine scores change with temperature, which they cannot."""
    return q_rescoring(s, d).groupBy("tau").agg((F.count_distinct("fine_mean_class", "fine_top1") > 1).alias("moved"))


QUERIES = {
    "top_deviations": q_top_deviations, "deviations_withheld": q_withheld, "reference_cohort": q_cohort, "alerting_states": q_alerting, "prompt_rows": q_prompt_rows, "prompts": q_prompts, "report_heads": q_heads, "agreed_claims": q_agreed,
    "state_sink": q_state_sink, "rescoring_grid": q_rescoring, "rescoring_check": q_rescoring_check,
}

# ---- SQL ------------------------------------------------------------------------------------------------------

_OF = "([0, 0, 0, 1, 1, 2, 2, 2, 3, 3])"
_GRID = f"""{_VAL}, p AS (SELECT *, {_FUSED} AS fused FROM val), {_PRIOR}, lp AS (SELECT list(ln(prior) ORDER BY c) AS l FROM prior),
cell AS (SELECT y, tau, temperature, list_transform(range(1, 11), lambda i: (fused[i] - tau * l[i]) / temperature) AS z FROM p, lp, (SELECT unnest({TAUS}::DOUBLE[]) AS tau), (SELECT unnest({TEMPERATURES}::DOUBLE[]) AS temperature)),
fine AS (SELECT y, tau, temperature, {_ARG.format('z')} AS pred, [{', '.join('ln(' + ' + '.join(f'exp(z[{i + 1}] - list_max(z))' for i in m) + ')' for m in COARSE)}] AS c FROM cell),
am AS (SELECT {_OF}[y + 1] AS y, tau, temperature, {_OF}[pred + 1] AS pred FROM fine), ls AS (SELECT {_OF}[y + 1] AS y, tau, temperature, {_ARG.format('c')} AS pred FROM fine)"""


def _cells(source: str, name: str) -> str:
    sql = _scores(source, "tau, temperature")
    for cte in ("yc", "pc", "cl", "sc"):
        sql = sql.replace(f"{cte} AS (", f"{name}_{cte} AS (").replace(f"FROM {cte} ", f"FROM {name}_{cte} ").replace(f"JOIN {cte} ", f"JOIN {name}_{cte} ")
    return sql


_GRIDS = f"{_GRID}, {_cells('fine', 'f')}, {_cells('am', 'a')}, {_cells('ls', 'l')}, grid AS (SELECT f.tau, f.temperature, f.mean_class AS fine_mean_class, f.top1 AS fine_top1, a.mean_class AS argmax_mean_class, a.top1 AS argmax_top1, l.mean_class AS lse_mean_class, l.top1 AS lse_top1 FROM f_sc f JOIN a_sc a USING (tau, temperature) JOIN l_sc l USING (tau, temperature))"
_LAST = f"""{BASELINES}, last AS (SELECT home_id, max(day) AS day FROM scored WHERE z IS NOT NULL AND home_id < 5 GROUP BY 1), ref AS (SELECT s.home_id, s.day, s.k, s.feature, s.median, s.mad, s.n_days FROM scored s JOIN last USING (home_id, day)),
first AS (SELECT home_id, min(day) AS day FROM features WHERE home_id >= 5 GROUP BY 1), mine AS (SELECT v.* FROM vals v JOIN first USING (home_id, day)),
c AS (SELECT m.home_id, m.home_id - 5 AS cohort_id, m.day, r.day AS reference_day, r.n_days AS baseline_days, m.feature, m.value, r.median, CASE WHEN abs(m.value - r.median) < 1e-12 THEN 0 ELSE greatest(-10, least(10, 0.6745 * (m.value - r.median) / greatest(r.mad, 0.05 * abs(r.median), 1e-9))) END AS z, CASE WHEN abs(r.median) < 1e-9 THEN 0 ELSE 100 * (m.value - r.median) / r.median END AS pct_change FROM mine m JOIN ref r ON r.home_id = m.home_id - 5 AND r.k = m.k)"""
ORACLES = {
    "top_deviations": f"WITH {BASELINES}, t AS (SELECT home_id, day, feature, z, row_number() OVER (PARTITION BY home_id, day ORDER BY abs(z) DESC, k) AS rank FROM scored WHERE z IS NOT NULL AND observed_hours >= 8 AND tracking_coverage >= 0.6) SELECT home_id, day, rank, feature, round(z, 2) AS robust_z FROM t WHERE rank <= 10",
    "deviations_withheld": f"WITH {BASELINES}, g AS (SELECT home_id, day, any_value(observed_hours >= 8 AND tracking_coverage >= 0.6) AS ok, bool_or(z IS NOT NULL) AS based FROM scored GROUP BY ALL) SELECT CASE WHEN NOT ok THEN 'withheld' WHEN NOT based THEN 'no baseline' ELSE 'shown' END AS deviations, count(*) AS n FROM g GROUP BY 1",
    "reference_cohort": f"WITH {_LAST} SELECT home_id, cohort_id, day, reference_day, baseline_days, feature, round(value, 6) AS value, round(median, 6) AS median, round(z, 6) AS z, round(pct_change, 6) AS pct_change, 'reference_cohort' AS baseline_provenance, 'measured' AS subject_provenance FROM c",
    "alerting_states": f"WITH {ALERTS}, n AS (SELECT home_id, day, count(*) AS n_alerts FROM alerts GROUP BY ALL), st AS (SELECT DISTINCT home_id, day FROM scored WHERE z IS NOT NULL), s AS (SELECT home_id, day, coalesce(n_alerts, 0) AS n_alerts FROM st LEFT JOIN n USING (home_id, day)), q AS (SELECT *, row_number() OVER (ORDER BY day, home_id) AS r FROM s WHERE n_alerts = 0) SELECT * FROM s WHERE n_alerts > 0 UNION ALL SELECT home_id, day, n_alerts FROM q WHERE r <= (SELECT greatest(1, count(*)) FROM s WHERE n_alerts > 0)",
    "prompt_rows": f"WITH {_STATE} SELECT home_id, day, count(*) OVER (PARTITION BY home_id, day) AS n_rows, evidence_ref, feature, observed_value AS value, pct_change AS pct, direction, observed_in_window, baseline_comparable FROM payload",
    "prompts": f"""WITH {_STATE},
row AS (SELECT home_id, day, place, '{{"evidence_ref":"' || evidence_ref || '","feature":"' || feature || '","value":' || observed_value || ',"pct":' || coalesce(pct_change::VARCHAR, 'null') || ',"direction":' || coalesce('"' || direction || '"', 'null') || ',"observed_in_window":' || observed_in_window || ',"baseline_comparable":' || baseline_comparable || '}}' AS j FROM payload)
SELECT home_id, day, 'Report the day.' || chr(10) || chr(10) || 'FILLED TEMPLATE:' || chr(10) || '[' || string_agg(j, ',' ORDER BY place) || ']' || chr(10) || chr(10) || 'JSON:' AS prompt FROM row GROUP BY home_id, day""",
    "report_heads": f"WITH {_STATE}, v AS (SELECT home_id, day, bool_or(severity IN ('urgent', 'emergency')) AS severe FROM alerts GROUP BY ALL), n AS (SELECT home_id, day, count(*) AS n FROM ranked GROUP BY ALL) SELECT home_id, day, n || ' features reviewed for ' || strftime(day, '%Y-%m-%d') || '.' AS summary, coalesce(severe, false) AS escalate, CASE WHEN coalesce(severe, false) THEN 'Contact the resident and review recent alerts.' ELSE 'Continue routine monitoring.' END AS recommendation FROM n LEFT JOIN v USING (home_id, day)",
    "agreed_claims": f"WITH {_VERIFIED}, cv AS (SELECT arm, home_id, day, claim_id, claimed_value FROM claims UNION ALL SELECT arm, home_id, day, claim_id, claimed_value FROM corrupted) SELECT arm, home_id, day, claim_id, faithful, faithful AND (substr(claim_id, 2)::INT % 3 = 0 OR (ref_exists AND value_matches AND coalesce(claimed_value, 0) < 500)) AS accepted FROM judged JOIN cv USING (arm, home_id, day, claim_id)",
    "state_sink": f"WITH {ALERTS} SELECT CASE WHEN day >= DATE '2024-01-15' THEN 2 ELSE 1 END AS run, count(*) AS n, 'daily_features' AS \"table\" FROM features GROUP BY 1 UNION ALL SELECT CASE WHEN day >= DATE '2024-01-15' THEN 2 ELSE 1 END, count(*), 'alerts' FROM alerts GROUP BY 1",
    "rescoring_grid": f"WITH {_GRIDS} SELECT * FROM grid",
    "rescoring_check": f"WITH {_GRIDS} SELECT tau, count(DISTINCT (fine_mean_class, fine_top1)) > 1 AS moved FROM grid GROUP BY tau",
}
