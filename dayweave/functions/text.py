"""Numbers, references and words of direction in prose; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REF = r"^feat:([a-z0-9_]+):(\d{4}-\d{2}-\d{2})$"
#: A sign counts before a digit, a comma before exactly the next three digits, k and m (thousand, million) unless a letter or digit follows.
NUMBER = r"-?\d(?:\d|,\d{3})*(?:\.\d+)?(?:[kKmM](?![A-Za-z0-9]))?"
# Words of direction.
UP = "increase increased increases rose rise risen higher up improved improvement gained more longer greater above exceeded grew".split()
DOWN = "decrease decreased decreases fell fall fallen lower down declined decline reduced reduction less fewer shorter below dropped drop worsened deteriorated".split()


def uniform(key: Column) -> Column:
    """A number in [0, 1) that depends on the text alone."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0


def numbers(text: Column) -> Column:
    """All numbers written in a text, in order (array of double)."""

    def value(t: Column) -> Column:
        scale = F.when(F.lower(F.substring(t, -1, 1)) == "k", 1e3).when(F.lower(F.substring(t, -1, 1)) == "m", 1e6).otherwise(1.0)
        return F.regexp_replace(t, "[,kKmM]", "").cast("double") * scale

    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1), value)


def ref_feature(ref: Column) -> Column:
    return F.nullif(F.regexp_extract(ref, REF, 1), F.lit(""))


def ref_day(ref: Column) -> Column:
    return F.try_to_date(F.nullif(F.regexp_extract(ref, REF, 2), F.lit("")), "yyyy-MM-dd")


def make_ref(feature: Column, day: Column) -> Column:
    return F.concat_ws(":", F.lit("feat"), feature, F.date_format(day, "yyyy-MM-dd"))


def agrees(claimed: Column, actual: Column, relative: float = 0.02, half_step: float = 0.005, tiny: float = 1e-6) -> Column:
    """Within the relative tolerance or half a display step; near zero within 0.001."""
    return F.when(F.abs(actual) < tiny, F.abs(claimed) < 1e-3).otherwise(F.abs(claimed - actual) <= F.greatest(relative * F.abs(actual), F.lit(half_step)))


def quotes(text: Column, value: Column) -> Column:
    """Whether some number of the text agrees with value."""
    return F.exists(numbers(text), lambda n: agrees(n, value))


def said_direction(text: Column, up=tuple(UP), down=tuple(DOWN)) -> Column:
    """increase or decrease by the words used; null for neither or both."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)
    rises, falls = F.arrays_overlap(words, F.array(*[F.lit(w) for w in up])), F.arrays_overlap(words, F.array(*[F.lit(w) for w in down]))
    return F.when(rises & ~falls, "increase").when(falls & ~rises, "decrease")


def displayed(x: Column, digits: int) -> Column:
    """Rounded for display, halves upward; the margin makes engines and binary fractions agree on what is a half."""
    return F.floor(x * 10**digits + (0.5 + 1e-9)) / 10**digits


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def coerced_number(text: Column) -> Column:
    """A number from text with commas or a percent sign; null for words that mean none and for anything else."""
    return F.regexp_replace(F.trim(text), "[,%]", "").try_cast("double")


#: A number as it is written: sign, digits of any script with separators, exponent, a percent or permille sign after white space.
TOKEN = r"(?U)([+\-\u2212]?\d+(?:[,.]\d+)*(?:[eE][+\-]?\d+)?(?:\s*[%\u2030])?)"


def number_tokens(text: Column) -> Column:
    """All numbers of a text exactly as spelled but for white space within, sorted: 5 is not 5%, -5 not 5, 1,000 not 1000, 1e5 not 1 5."""
    return F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 1), lambda t: F.regexp_replace(t, r"(?U)\s+", "")))


def same_numbers(a: Column, b: Column) -> Column:
    """Whether two texts hold the same number tokens, as often."""
    return number_tokens(a) == number_tokens(b)


#: Characters that no report may hold, and the letters that a text in Devanagari must have.
CONTROL, DEVANAGARI = r"[\x00-\x08\x0B\x0C\x0E-\x1F]", r"[\u0904-\u0939\u0958-\u0961]"
#: Longest texts asked for and given back.
ASKED = {"summary": 2000, "recommendation": 1000}
ANSWERED = {"summary": 6000, "recommendation": 3000}


def request_fault(text: Column, field: str) -> Column:
    """Why a text cannot be sent to be translated; null if it can."""
    return F.when(text.isNull(), "not a text").when(F.length(text) > ASKED[field], "too long").when(text.rlike(CONTROL), "control characters")


def translation_fault(original: Column, translated: Column, field: str, script: str = DEVANAGARI) -> Column:
    """Why a translated field cannot be shown, the first reason that holds; null if it can.

    Prose may be neither missing nor invented, every number stays as spelled and as often, and prose must have a letter of the script.
    """
    some = lambda t: t.rlike(r"(?U)\S")
    return (
        F.when(translated.isNull(), "not a text").when(F.length(translated) > ANSWERED[field], "too long").when(translated.rlike(CONTROL), "control characters").when(some(translated) != some(original), "missing or invented prose")
        .when(~same_numbers(original, translated), "changed numbers").when(some(original) & ~translated.rlike(script), "not in the script asked for")
    )
