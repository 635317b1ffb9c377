"""Claims about a day's state: what may be claimed, faithful and corrupted claims, and their arithmetic verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.config import TRACKED, Thresholds
from dayweave.functions.text import REF, agrees, displayed, make_ref, quotes, ref_day, ref_feature, said_direction, uniform
from dayweave.operators.baseline import direction, is_reliable, long_baselines, pct_change

# Features that a report may mention, and the kinds of corruption.
REPORTABLE = (
    "walking_duration_s mobility_index sit_to_stand_count meal_events medication_events social_interaction_duration_s visitor_count "
    "longest_inactive_block_s lying_duration_s room_transitions housework_duration_s cooking_duration_s drinking_events"
).split()
CORRUPTIONS = "fabricated_ref invented_value wrong_pct inverted_direction prose_contradiction sign_flipped_pct".split()
CLAIM = ("claim_id", "text", "evidence_ref", "claimed_value", "claimed_pct_change", "direction")


def evidence_index(scored: DataFrame, alerts: DataFrame, subject: str = "home_id") -> DataFrame:
    """One row per subject, day and feature that a claim may cite: alert evidence first, then every feature with a baseline."""
    cited = alerts.select(subject, "day", F.explode("evidence").alias("e")).select(subject, "day", F.lit(0).alias("source"), "e.feature", "e.observed", "e.baseline_median", "e.robust_z", "e.pct_change", "e.delta", F.col("e.baseline_n_days").cast("int").alias("baseline_n_days"))
    b = long_baselines(scored, subject)
    own = b.select(subject, "day", F.lit(1).alias("source"), "feature", F.col("value").alias("observed"), F.col("median").alias("baseline_median"), F.col("z").alias("robust_z"), pct_change(F.col("value"), F.col("median")).alias("pct_change"), (F.col("value") - F.col("median")).alias("delta"), F.col("n_days").cast("int").alias("baseline_n_days"))
    both = cited.unionByName(own)
    rest = F.struct(*[c for c in both.columns if c not in (subject, "day", "feature")])
    rows = both.groupBy(subject, "day", "feature").agg(F.min_by(rest, F.struct("source", "baseline_n_days")).alias("_e")).select(subject, "day", "feature", "_e.*")
    return rows.withColumn("ref", make_ref(F.col("feature"), F.col("day"))).withColumn("source", F.when(F.col("source") == 0, "alert").otherwise("feature"))


def payload(scored: DataFrame, subject: str = "home_id", config: Thresholds = Thresholds()) -> DataFrame:
    """One row per reportable feature with a baseline: rounded figures; on an unreliable day the comparison is withheld."""
    names = [n for n in REPORTABLE if n in TRACKED]
    rows = scored.filter("z is not null").select(
        subject, "day", "history_days", is_reliable(config).alias("baseline_comparable"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(i).alias("place"), F.col(n).cast("double").alias("value"), F.get("baseline", TRACKED.index(n))["median"].alias("median"), F.get("z", TRACKED.index(n)).alias("z")) for i, n in enumerate(names)])),
    )
    shown = lambda c: F.when(F.col("baseline_comparable"), c)
    delta = F.col("value") - F.col("median")
    return rows.select(
        subject, "day", "feature", "place", "history_days", "baseline_comparable", make_ref(F.col("feature"), F.col("day")).alias("evidence_ref"),
        displayed(F.col("value"), 2).alias("observed_value"), (F.abs("value") > 1e-9).alias("observed_in_window"), shown(displayed(F.col("median"), 2)).alias("baseline_median"),
        shown(displayed(delta, 2)).alias("delta"), shown(F.when(F.abs("median") > 1e-9, displayed(pct_change(F.col("value"), F.col("median")), 1))).alias("pct_change"), shown(displayed(F.col("z"), 2)).alias("robust_z"), shown(direction(delta)).alias("direction"),
    )


def ranked(rows: DataFrame, alerts: DataFrame, most: int = 6, subject: str = "home_id") -> DataFrame:
    """The first `most` payload rows of each day: alerted features, then by |z|, then what was observed."""
    cited = alerts.select(subject, "day", F.explode("evidence.feature").alias("feature")).distinct().withColumn("alerted", F.lit(True))
    r = rows.join(cited, [subject, "day", "feature"], "left").withColumn("alerted", F.coalesce("alerted", F.lit(False)))
    group = F.when(F.col("alerted"), 0).when(F.col("baseline_comparable"), 1).otherwise(2)
    within = F.when(F.col("alerted"), 0.0).when(F.col("baseline_comparable"), -F.abs(F.coalesce("robust_z", F.lit(0.0)))).otherwise(F.when(F.col("observed_in_window"), 0.0).otherwise(1.0))
    w = Window.partitionBy(subject, "day").orderBy(group, within, "place")
    return r.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def faithful_claims(rows: DataFrame, subject: str = "home_id") -> DataFrame:
    """Claims that quote ranked payload rows; on a partial day only what was observed or alerted."""
    name, value = F.replace("feature", F.lit("_"), F.lit(" ")), F.col("observed_value").cast("string")
    verb = F.when(F.col("direction") == "decrease", "showed a decrease").when(F.col("direction") == "increase", "showed an increase").otherwise("was stable at")
    text = (
        F.when(~F.col("baseline_comparable") & F.col("observed_in_window"), F.concat(name, F.lit(" was observed at "), value, F.lit(" in the window.")))
        .when(~F.col("baseline_comparable"), F.concat(name, F.lit(" was not observed in the window (value 0.0).")))
        .otherwise(F.concat(name, F.lit(" "), verb, F.lit(" at "), value, F.lit(" versus a baseline of "), F.col("baseline_median").cast("string"), F.lit(".")))
    )
    w = Window.partitionBy(subject, "day").orderBy("rank")
    kept = rows.filter(F.col("baseline_comparable") | F.col("observed_in_window") | F.col("alerted"))
    return kept.select(subject, "day", F.concat(F.lit("c"), F.row_number().over(w)).alias("claim_id"), text.alias("text"), "evidence_ref", F.col("observed_value").alias("claimed_value"), F.col("pct_change").alias("claimed_pct_change"), "direction")


def corrupted_claims(rows: DataFrame, rate: float, seed: int = 0, modes: tuple[str, ...] = tuple(CORRUPTIONS), subject: str = "home_id") -> DataFrame:
    """Claims of which a share is corrupted in a known way (column injected, null if left alone): a drill for the verifier.

    Which and how depends on a hash of seed, subject, day and claim, so reruns agree.
    """
    base = rows.withColumn("claim_id", F.concat(F.lit("c"), F.col("rank")))
    key = lambda what: F.concat_ws("|", F.lit(str(seed)), F.lit(what), F.col(subject).cast("string"), F.date_format("day", "yyyy-MM-dd"), "claim_id")
    drawn = F.when(uniform(key("rate")) < rate, F.get(F.array(*[F.lit(m) for m in modes]), F.floor(uniform(key("mode")) * len(modes)).cast("int")))
    flips = (F.col("direction") == "decrease") & (F.abs(F.col("pct_change")) > 1)
    mode = F.when((drawn == "sign_flipped_pct") & ~F.coalesce(flips, F.lit(False)), "wrong_pct").otherwise(drawn)
    m = F.coalesce(F.col("injected"), F.lit(""))
    name, value = F.replace("feature", F.lit("_"), F.lit(" ")), F.col("observed_value").cast("string")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    text = (
        F.when(m == "inverted_direction", said(name, " improved to ", value, ", a clear increase."))
        .when(m == "prose_contradiction", said(name, F.when(F.col("direction") == "decrease", " increased").otherwise(" decreased"), " markedly to ", value, "."))
        .when(m == "sign_flipped_pct", said(name, " rose by ", F.abs("pct_change").cast("string"), "% today."))
        .otherwise(said(name, " was ", value, " against a baseline of ", F.coalesce(F.col("baseline_median").cast("string"), F.lit("None")), ", a ", F.coalesce("direction", F.lit("None")), "."))
    )
    pct = F.when(m == "wrong_pct", F.coalesce(F.col("pct_change") + 47, F.lit(47.0))).when(m == "sign_flipped_pct", F.abs("pct_change")).otherwise(F.col("pct_change"))
    flipped = F.when(F.col("direction") == "increase", "decrease").otherwise("increase")
    return base.withColumn("injected", mode).select(
        subject, "day", "claim_id", text.alias("text"),
        F.when(m == "fabricated_ref", make_ref(F.lit("stair_climbing_duration_s"), F.col("day"))).otherwise(F.col("evidence_ref")).alias("evidence_ref"),
        F.when(m == "invented_value", F.col("observed_value") * 1.9 + 13).otherwise(F.col("observed_value")).alias("claimed_value"),
        pct.alias("claimed_pct_change"), F.when(m == "inverted_direction", flipped).otherwise(F.col("direction")).alias("direction"), "injected",
    )


def verify(claims: DataFrame, index: DataFrame, subject: str = "home_id", need_ref: bool = True, pct_points: float = 2.0) -> DataFrame:
    """claims with ref_exists, value_matches, pct_matches, direction_consistent, prose_quoted, faithful and notes.

    A claim is joined with the evidence its reference names for the same subject and the claim's report day; null figures are not
    judged. Without evidence the other checks fail as well, save for the prose.
    """
    e = index.select(F.col(subject).alias("_s"), F.col("day").alias("_d"), F.col("feature").alias("_f"), F.col("observed").alias("_observed"), F.col("baseline_median").alias("_median"), F.col("pct_change").alias("_pct"), F.col("delta").alias("_delta"))
    c = claims.withColumn("_feature", ref_feature(F.col("evidence_ref"))).withColumn("_day", ref_day(F.col("evidence_ref")))
    j = c.join(e, (c[subject] == e["_s"]) & (c["_day"] == e["_d"]) & (c["_feature"] == e["_f"]) & (c["day"] == e["_d"]), "left")
    has = F.col("_s").isNotNull()
    unsaid = F.coalesce(F.col("evidence_ref"), F.lit("")) == ""
    value, pct, said, claimed, actual = F.col("claimed_value"), F.col("claimed_pct_change"), said_direction(F.col("text")), F.col("direction"), direction(F.col("_delta"))
    values = value.isNull() | agrees(value, F.col("_observed"))
    pcts = pct.isNull() | ((F.abs("_median") >= 1e-9) & (F.abs(pct - F.col("_pct")) <= pct_points))
    wrong_field = claimed.isNotNull() & (claimed != actual)
    wrong_prose = said.isNotNull() & (actual != "unchanged") & (said != actual)
    at_odds = said.isNotNull() & claimed.isNotNull() & (said != claimed)
    wrong_sign = pct.isNotNull() & (F.abs(pct) > 1e-9) & (F.abs("_delta") > 1e-9) & ((pct > 0) != (F.col("_delta") > 0))
    no = lambda x: ~F.coalesce(x, F.lit(False))
    note = lambda when, text: F.when(F.coalesce(when, F.lit(False)), text)
    well_formed = F.coalesce(F.col("evidence_ref").rlike(REF), F.lit(False))
    out = j.select(
        *[c[x] for x in claims.columns],
        F.when(unsaid, not need_ref).otherwise(has).alias("ref_exists"),
        (has & values).alias("value_matches"),
        (has & pcts).alias("pct_matches"),
        (has & no(wrong_field) & no(wrong_prose) & no(at_odds) & no(wrong_sign)).alias("direction_consistent"),
        F.when(has & value.isNotNull(), quotes(F.col("text"), value)).otherwise(True).alias("prose_quoted"),
        F.array_compact(F.array(
            note(unsaid, "no evidence_ref"), note(~unsaid & ~well_formed, "malformed evidence_ref"), note(well_formed & ~has, "evidence_ref does not resolve"),
            note(has & ~values, "value mismatch"), note(has & ~pcts & (F.abs("_median") < 1e-9), "percentage of a zero baseline"), note(has & ~pcts & (F.abs("_median") >= 1e-9), "percentage mismatch"),
            note(has & wrong_field, "direction field wrong"), note(has & wrong_prose, "prose direction wrong"), note(has & at_odds, "prose and field disagree"), note(has & wrong_sign, "percentage sign wrong"),
            note(has & value.isNotNull() & ~quotes(F.col("text"), value), "prose does not quote the value"),
        )).alias("notes"),
    )
    checks = [F.coalesce(F.col(x), F.lit(False)) for x in ("ref_exists", "value_matches", "pct_matches", "direction_consistent", "prose_quoted")]
    return out.withColumn("faithful", checks[0] & checks[1] & checks[2] & checks[3] & checks[4])


def summary(verified: DataFrame, *by: str) -> DataFrame:
    """Counts per group: claims, faithful, rate, failures of each check (later checks among claims whose reference exists), Wilson bounds."""
    fails = lambda c: F.count_if(F.col("ref_exists") & ~F.col(c))
    s = verified.groupBy(*by).agg(
        F.count("*").alias("n_claims"), F.count_if("faithful").alias("n_faithful"), F.count_if(~F.col("ref_exists")).alias("bad_ref"), fails("value_matches").alias("bad_value"),
        fails("pct_matches").alias("bad_pct"), fails("direction_consistent").alias("bad_direction"), fails("prose_quoted").alias("bad_prose"),
    )
    bad = F.col("n_claims") - F.col("n_faithful")
    low, high = wilson(bad, F.col("n_claims"))
    return s.withColumn("unfaithful_rate", F.when(F.col("n_claims") > 0, bad / F.col("n_claims")).otherwise(0.0)).withColumn("rate_low", low).withColumn("rate_high", high)


def report_lines(verified: DataFrame, *by: str) -> DataFrame:
    """What a caregiver sees per group: the faithful claims in order, one a line, the number withheld, and whether all were withheld."""
    shown = F.array_sort(F.collect_list(F.when(F.col("faithful"), F.struct("claim_id", "text"))))
    g = verified.groupBy(*by).agg(shown.alias("_s"), F.count_if(~F.col("faithful")).alias("n_withheld"))
    return g.select(*by, F.array_join(F.transform("_s", lambda x: x["text"]), "\n").alias("summary"), "n_withheld", (F.size("_s") == 0).alias("nothing_shown"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of a share; NaN without observations."""
    p, spread = k / n, 1 + z * z / n
    middle = (p + z * z / (2 * n)) / spread
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / spread
    nan = F.lit(float("nan"))
    return F.when(n == 0, nan).otherwise(F.greatest(F.lit(0.0), middle - half)), F.when(n == 0, nan).otherwise(F.least(F.lit(1.0), middle + half))


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26; off by less than 1.5e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> tuple[Column, Column]:
    """z of two shares with pooled variance, and its two-sided p; NaN without observations, 0 and 1 without variance."""
    pooled = (k1 + k2) / (n1 + n2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    empty, nan = (n1 == 0) | (n2 == 0), F.lit(float("nan"))
    z = F.when(empty, nan).when(error == 0, 0.0).otherwise((k1 / n1 - k2 / n2) / error)
    return z, F.when(empty, nan).when(error == 0, 1.0).otherwise(1 - erf(F.abs(z) / 2**0.5))
