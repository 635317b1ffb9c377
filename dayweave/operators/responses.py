"""Raw model responses to claims: find the JSON object, repair its format but never its content, check the schema, assemble the report."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayweave.functions.text import REF
from dayweave.operators.claims import report_lines, verify
from dayweave.sources.shared import staged

# Accepted spellings of directions; words for no value.
DIRECTIONS = {
    "increase": "increase", "increased": "increase", "increases": "increase", "increasing": "increase", "decrease": "decrease", "decreased": "decrease", "decreases": "decrease", "decreasing": "decrease",
    "unchanged": "unchanged", "no change": "unchanged",
}
NOTHING = ("", "null", "none", "n/a", "nan")
FIELDS = "claim_id text evidence_ref claimed_value claimed_pct_change direction".split()
REPORT = "summary string, recommendation string, escalate boolean, claims array<struct<" + ", ".join(f"{f}: string" for f in FIELDS) + ">>"


def _no_duplicates(pairs: list) -> dict:
    if len({k for k, _ in pairs}) != len(pairs):
        raise ValueError("duplicate key")
    return dict(pairs)


def _refuse(word: str):
    raise ValueError(f"{word} is not JSON")


def _found(raw: str | None, strict: bool) -> dict:
    text = (raw or "").strip()
    start = 0 if strict else text.find("{")
    if start < 0 or not text:
        return {"object": None, "error": "no JSON object"}
    decoder = json.JSONDecoder(object_pairs_hook=_no_duplicates, parse_constant=_refuse) if strict else json.JSONDecoder()
    try:
        value, end = decoder.raw_decode(text, start)
    except (ValueError, RecursionError) as e:
        # A response cut off by a length limit ends inside a string or where more was due; anything else is malformed.
        cut = isinstance(e, json.JSONDecodeError) and (e.pos >= len(text) or e.msg.startswith("Unterminated string"))
        return {"object": None, "error": str(e)[:80] if strict else "truncated JSON" if cut else "malformed JSON"}
    if strict and end < len(text):
        return {"object": None, "error": "text after the object"}
    if not isinstance(value, dict):
        return {"object": None, "error": "not an object"}
    return {"object": text[start:end], "error": None}


_FOUND = "struct<object: string, error: string>"


def json_object(raw: Column) -> Column:
    """struct of object (the first JSON object in a response, whatever prose or fences are around it) and error."""

    @F.arrow_udf(_FOUND)
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([_found(t, False) for t in texts.to_pylist()], pa.struct([("object", pa.string()), ("error", pa.string())]))

    return find(raw)


def strict_object(raw: Column) -> Column:
    """The same, but the whole text must be one object without repeated keys, NaN or Infinity."""

    @F.arrow_udf(_FOUND)
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([_found(t, True) for t in texts.to_pylist()], pa.struct([("object", pa.string()), ("error", pa.string())]))

    return find(raw)


def repaired(c: Column, position: Column) -> Column:
    """A claim struct of texts with its format repaired: trimmed, unquoted, dates and directions in their usual form. Content stays."""
    cid = F.trim(c["claim_id"])
    ref = F.regexp_replace(F.regexp_replace(F.trim(c["evidence_ref"]), r"^[`'\"\s]+|[`'\"\s]+$", ""), r"(?i)^(evidence_ref\s?[:=]|ref:)\s*", "")
    low = F.lower(F.trim(c["direction"]))
    way = F.create_map(*[x for k, v in DIRECTIONS.items() for x in (F.lit(k), F.lit(v))])
    bare = lambda v: F.trim(F.regexp_replace(F.trim(v), "[,%]", ""))
    value = lambda v: F.when(~F.lower(bare(v)).isin(*NOTHING), bare(v))
    return F.struct(
        F.when(F.coalesce(cid, F.lit("")) == "", F.concat(F.lit("c"), position + 1)).otherwise(cid).alias("claim_id"), F.substring(F.trim(c["text"]), 1, 500).alias("text"),
        F.regexp_replace(ref, r":(\d{4})[/.](\d{2})[/.](\d{2})$", ":$1-$2-$3").alias("evidence_ref"), value(c["claimed_value"]).alias("claimed_value"), value(c["claimed_pct_change"]).alias("claimed_pct_change"),
        F.when(~low.isin("none", "null", ""), F.coalesce(F.try_element_at(way, low), c["direction"])).alias("direction"),
    )


def _reasons(c: Column) -> Column:
    """Why a claim struct of texts is not valid, field by field; empty if it is."""
    number = lambda f: c[f].try_cast("double")
    return F.array_compact(F.array(
        F.when(F.coalesce(F.length(c["text"]), F.lit(0)) == 0, "text: missing"), F.when(F.length(c["text"]) > 500, "text: too long"), F.when(c["evidence_ref"].isNull(), "evidence_ref: missing"), F.when(~c["evidence_ref"].rlike(REF), "evidence_ref: pattern"),
        *[F.when(c[f].isNotNull() & number(f).isNull(), F.concat(F.lit(f"{f}: not a number (got "), F.substring(c[f], 1, 60), F.lit(")"))) for f in ("claimed_value", "claimed_pct_change")],
        F.when(~c["direction"].isin("increase", "decrease", "unchanged"), "direction: not one of the three"),
    ))


def claims_of(responses: DataFrame, raw: str = "raw_response", repair: bool = True) -> DataFrame:
    """responses' keys with one row per claim: typed fields, reject_reasons (empty for a valid claim), and response_error for responses
    without claims, which keep one row without one."""
    keys = [F.col(f"`{c}`") for c in responses.columns if c != raw]
    r = responses.withColumn("_j", json_object(F.col(f"`{raw}`"))).withColumn("_r", F.from_json("_j.object", REPORT))
    error = F.coalesce(F.col("_j.error"), F.when(F.col("_r.claims").isNull(), "claims are not a list"))
    r = r.select(*keys, error.alias("response_error"), F.posexplode_outer("_r.claims").alias("_p", "_c"))
    c = repaired(F.col("_c"), F.col("_p")) if repair else F.col("_c")
    r = r.withColumn("_c", F.when(F.col("_p").isNotNull(), c))
    number = lambda f: F.col(f"_c.{f}").try_cast("double")
    why = _reasons(F.col("_c"))
    return r.select(*keys, "response_error", "_c.claim_id", "_c.text", "_c.evidence_ref", number("claimed_value").alias("claimed_value"), number("claimed_pct_change").alias("claimed_pct_change"), "_c.direction", F.when(F.col("_p").isNotNull(), why).alias("reject_reasons"))


def assembled(responses: DataFrame, index: DataFrame, *by: str) -> DataFrame:
    """One report per group: the lines of faithful claims, how many were withheld, how many the schema rejected."""
    c = claims_of(responses)
    valid = verify(c.filter("claim_id is not null and size(reject_reasons) = 0").drop("response_error", "reject_reasons"), index, by[0])
    counts = c.groupBy(*by).agg(F.count("claim_id").alias("n_claims"), F.count_if(F.size("reject_reasons") > 0).alias("n_rejected"), F.max("response_error").alias("response_error"))
    return counts.join(report_lines(valid, *by), list(by), "left")


def response_text(claims: DataFrame, *by: str) -> DataFrame:
    """by and raw_response: claims as a loosely formatted response, in fences and prose, numbers as text; to drill the readers."""
    c = F.struct(F.col("claim_id"), F.concat(F.lit("  "), "text").alias("text"), F.concat(F.lit("`"), "evidence_ref", F.lit("`")).alias("evidence_ref"), F.concat(F.col("claimed_value").cast("string"), F.lit(" ")).alias("claimed_value"), F.concat(F.col("claimed_pct_change").cast("string"), F.lit("%")).alias("claimed_pct_change"), F.initcap("direction").alias("direction"))
    body = F.to_json(F.struct(F.lit("ok {brace}").alias("summary"), F.array_sort(F.collect_list(c)).alias("claims")))
    return claims.groupBy(*by).agg(F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone }")).alias("raw_response"))


#: Claims of a response that are looked at, and the longest summary and recommendation that are shown.
MOST_CLAIMS, PROSE = 6, {"summary": 400, "recommendation": 300}


def outcomes(responses: DataFrame, index: DataFrame, *by: str, raw: str = "raw_response", salvage: bool = True, most: int = MOST_CLAIMS) -> DataFrame:
    """What became of each response (a row for each group of `by`, whose first column is the subject of index): parse_failed, n_emitted,
    n_claims (those that the schema accepts), n_repaired, n_dropped, n_faithful, rejections (the reasons of dropped claims), summary,
    recommendation, escalate and notes.

    A claim is taken as it is if it is valid, else, with salvage, repaired in its format, else dropped with the reasons that it first had.
    Prose beyond its limit is cut, with a note of how long it was, since nothing verifies prose. A response that doesn't parse, or whose
    claims are no list, says so.
    """
    r = responses.withColumn("_j", json_object(F.col(f"`{raw}`"))).withColumn("_r", F.from_json("_j.object", REPORT))
    prose = {f: F.coalesce(F.col(f"_r.{f}"), F.lit("")) for f in PROSE}
    shape = F.when(F.col("_r.claims").isNull() & F.get_json_object("_j.object", "$.claims").isNotNull(), "claims: not a list")
    long = [F.when(F.length(t) > PROSE[f], F.concat(F.lit(f"{f}: "), F.length(t).cast("string"), F.lit(f" characters, cut to {PROSE[f]}"))) for f, t in prose.items()]
    failed = F.when(F.col("_j.error").isNotNull(), F.concat(F.lit("response: "), "_j.error"))
    r = r.select(*by, F.col("_j.error").isNotNull().alias("parse_failed"), *[F.substring(t, 1, PROSE[f]).alias(f) for f, t in prose.items()], F.coalesce("_r.escalate", F.lit(False)).alias("escalate"), F.array_compact(F.array(failed, shape, *long)).alias("notes"), F.slice(F.coalesce("_r.claims", F.array().cast("array<struct<" + ", ".join(f"{f}: string" for f in FIELDS) + ">>")), 1, most).alias("_emitted"))
    r = staged(r, "responses")  # claims are verified apart from what the response says of itself
    c = r.select(*by, F.posexplode("_emitted").alias("_p", "_c"))
    c = c.withColumn("_why", F.concat(F.when(F.coalesce("_c.claim_id", F.lit("")) == "", F.array(F.lit("claim_id: missing"))).otherwise(F.array().cast("array<string>")), _reasons(F.col("_c"))))
    c = c.withColumn("_mended", repaired(F.col("_c"), F.col("_p"))) if salvage else c.withColumn("_mended", F.col("_c"))
    c = c.withColumn("_kind", F.when(F.size("_why") == 0, "valid").when(F.lit(salvage) & (F.size(_reasons(F.col("_mended"))) == 0), "repaired").otherwise("dropped"))
    c = staged(c.withColumn("_taken", F.when(F.col("_kind") == "valid", F.col("_c")).otherwise(F.col("_mended"))).select(*by, "_kind", "_why", "_taken"), "claims")
    t, number = F.col("_taken"), lambda f: F.col(f"_taken.{f}").try_cast("double").alias(f)
    checked = verify(c.filter("_kind <> 'dropped'").select(*by, t["claim_id"].alias("claim_id"), t["text"].alias("text"), t["evidence_ref"].alias("evidence_ref"), number("claimed_value"), number("claimed_pct_change"), t["direction"].alias("direction")), index, by[0])
    faithful = checked.groupBy(*by).agg(F.count_if("faithful").alias("n_faithful"))
    dropped = F.when(F.col("_kind") == "dropped", F.col("_why"))
    counts = c.groupBy(*by).agg(F.count("*").alias("n_emitted"), F.count_if(F.col("_kind") != "dropped").alias("n_claims"), F.count_if(F.col("_kind") == "repaired").alias("n_repaired"), F.count_if(F.col("_kind") == "dropped").alias("n_dropped"), F.array_sort(F.flatten(F.collect_list(dropped))).alias("rejections"))
    zero = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_emitted", "n_claims", "n_repaired", "n_dropped", "n_faithful")]
    out = r.drop("_emitted").join(counts, list(by), "left").join(faithful, list(by), "left")
    return out.select(*by, "parse_failed", *zero, F.coalesce("rejections", F.array().cast("array<string>")).alias("rejections"), *PROSE, "escalate", "notes")


def run_summary(found: DataFrame, *by: str, top: int = 4) -> DataFrame:
    """Of outcomes, a row a run: counts, the unfaithful share of scorable claims and the unusable share of emitted ones (a claim that the
    schema refuses is of no more use than a false one), the median of the reports' unfaithful shares, and the `top` causes of rejection
    ("cause: count", the more frequent first, then by name; what a cause got is left out). Shares of nothing are null."""
    rate = F.when(F.col("n_claims") > 0, (F.col("n_claims") - F.col("n_faithful")) / F.col("n_claims"))
    s = found.groupBy(*by).agg(
        F.count("*").alias("n_reports"), *[F.sum(c).alias(c) for c in ("n_emitted", "n_claims", "n_repaired", "n_faithful")], F.median(rate).alias("per_report_median"),
        F.count_if("parse_failed").alias("parse_failures"), F.sum("n_dropped").alias("schema_rejected"),
    )
    causes = found.select(*by, F.explode("rejections").alias("cause")).groupBy(*by, F.split_part("cause", F.lit(" (got "), F.lit(1)).alias("cause")).agg(F.count("*").alias("n"))
    causes = causes.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "cause"))), 1, top).alias("c")).select(*by, F.transform("c", lambda c: F.concat(c["cause"], F.lit(": "), (-c["n"]).cast("string"))).alias("top_causes"))
    share = lambda whole: F.try_divide(F.col(whole) - F.col("n_faithful"), F.col(whole))
    return s.join(causes, list(by), "left").withColumn("unfaithful_rate", share("n_claims")).withColumn("unusable_rate", share("n_emitted")).withColumn("top_causes", F.coalesce("top_causes", F.array().cast("array<string>")))
