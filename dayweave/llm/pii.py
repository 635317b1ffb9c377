"""Personal data: regular expressions propose spans, validators confirm them, nearby words adjust the score.

Four base kinds (e-mail and internet addresses, payment cards, international telephone numbers) are kept whenever their form is right.
Further kinds (IBAN by mod-97, social security numbers, national telephone numbers, IPv6 and cards with other separators) are kept from a score on, which
starts at what the validator proves and rises or falls with the words around the span. Every search is linear in the text.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.llm.common import table

#: Kinds in the order that equal starts are listed in.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "ipv6", "national_phone", "spaced_card")
#: From this score on an added span is kept; a context word within CONTEXT_CHARS of a span moves its score by CONTEXT_WEIGHT, once either way.
THRESHOLD, CONTEXT_CHARS, CONTEXT_WEIGHT = 0.5, 48, 0.3
#: Words that speak for a kind, in English, German, French and Spanish, and words that speak against any.
SUPPORT = {
    "email": "mail email e-mail contact kontakt courriel correo",
    "ip": "ip host server address adresse dirección client login",
    "card": "card visa mastercard amex credit debit karte kreditkarte carte tarjeta crédito payment",
    "phone": "phone tel telephone call mobile cell fax whatsapp telefon handy mobil anruf téléphone appel portable teléfono móvil llame",
    "iban": "iban account bank transfer konto überweisung compte virement cuenta transferencia",
    "ssn": "ssn social security sozialversicherung sécurité sociale seguro",
}
SUPPORT |= {"ipv6": SUPPORT["ip"], "national_phone": SUPPORT["phone"], "spaced_card": SUPPORT["card"]}
AGAINST = frozenset("version isbn issn order invoice sku serial part build release revision rev chapter section page pages rechnung facture factura".split())
_SUPPORT = {kind: frozenset(words.split()) for kind, words in SUPPORT.items()}

SPANS = "array<struct<kind: string, first: int, end: int, score: double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits fails or fits as a whole, so only its first digit is tried; nothing that was taken is given back.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]{4}){2,7}(?:[\x20-]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}(?![0-9A-Za-z-])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:.])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]{1,2}[0-9]{2,8}){1,5}(?![0-9A-Za-z-])")
_SPACED = re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:(?:\x20{1,3}|[./_ ‑–]|\x20[-–]\x20)[0-9]{2,7}){2,4}(?![0-9A-Za-z])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


class Span(NamedTuple):
    first: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    """The check sum of payment cards: every second digit from the right doubled, digit sums added, a multiple of ten."""
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(doubled[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def mod97(iban: str) -> bool:
    """The check sum of an IBAN: its first four characters at the end, letters as two digits from ten on, remainder one."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What the base expression finds, in linear time: each @ with the characters before it, back to the last match at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        local = len(text[done:at].rstrip(_LOCAL)) + done
        found = _DOMAIN.match(text, at + 1) if local < at else None
        if found:
            yield local, found.end()
            done = found.end()
            at = text.find("@", done)
        else:
            done, at = at + 1, text.find("@", at + 1)


def _small(part: str) -> bool:
    """At most 255; however many zeros stand before."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each base kind that its validator lets pass."""
    out = [(a, b, "email") for a, b in emails(text)]
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    out += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- added kinds: each proposal gets the score that its validator proves, 0 if it fails -----------------------------


def _iban(text: str) -> tuple[float, int]:
    """Groups at the end that belong to the next words are left off until the check sum fits."""
    while True:
        bare = text.replace(" ", "").replace("-", "")
        if not 15 <= len(bare) <= 34:
            return 0.0, 0
        if mod97(bare):
            return 0.8 if text == bare or len(text) > 18 else 0.6, len(text)
        cut = max(text.rfind(" "), text.rfind("-"))
        if cut < 0:
            return 0.0, 0
        text = text[:cut]


def _ssn(text: str) -> tuple[float, int]:
    """Never given out: areas 000, 666 and from 900, group 00, serial 0000."""
    area, group, serial = text[:3], text[4:6], text[7:]
    right = text[3] == text[6] and area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
    return (0.5 if text[3] == "-" else 0.3) if right else 0.0, len(text)


def _ipv6(text: str) -> tuple[float, int]:
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return 0.0, 0
    return (0.7 if len(text) > 10 else 0.3), len(text)


def _national(text: str) -> tuple[float, int]:
    """Only a word that names a telephone lifts a national number over the threshold."""
    return (0.3 if 7 <= len(_digits(text)) <= 13 else 0.0), len(text)


def _spaced_card(text: str) -> tuple[float, int]:
    d = _digits(text)
    return (0.4 if 13 <= len(d) <= 19 and d[0] in "3456" and luhn(d) else 0.0), len(text)


PROPOSALS: tuple[tuple[str, re.Pattern, Callable[[str], tuple[float, int]]], ...] = (
    ("iban", _IBAN, _iban),
    ("ssn", _SSN, _ssn),
    ("ipv6", _IPV6, _ipv6),
    ("spaced_card", _SPACED, _spaced_card),
    ("national_phone", _NATIONAL, _national),
)


def context(text: str, first: int, end: int, kind: str) -> float:
    """What the words near a span add to its score."""
    near = f"{text[max(0, first - CONTEXT_CHARS) : first]} {text[end : end + CONTEXT_CHARS]}".lower()
    words = set(_WORD.findall(near))
    return CONTEXT_WEIGHT * (bool(words & _SUPPORT[kind]) - bool(words & AGAINST))


def detected(text: str) -> list[Span]:
    """All spans of a text by start, then kind: every base span, and added ones that reach THRESHOLD and overlap nothing kept before."""
    clip = lambda score: round(min(1.0, max(0.0, score)), 3)
    out = [Span(a, b, kind, clip(0.7 + context(text, a, b, kind))) for a, b, kind in base_spans(text)]
    taken = [(s.first, s.end) for s in out]
    for kind, pattern, proves in PROPOSALS:
        new = []
        for m in pattern.finditer(text):
            score, size = proves(m[0])
            if score and score + CONTEXT_WEIGHT >= THRESHOLD:
                new.append((m.start(), m.start() + size, score))
        for a, b, score in _apart(new, taken):
            score = clip(score + context(text, a, b, kind))
            if score >= THRESHOLD:
                out.append(Span(a, b, kind, score))
                taken.append((a, b))
    return sorted(out, key=lambda s: (s.first, KINDS.index(s.kind)))


def _apart(new: list[tuple], taken: list[tuple[int, int]]) -> list[tuple]:
    """Those of new (by start) that overlap none of taken: one walk along both."""
    if not new:
        return []
    held, at, reach, out = sorted(taken), 0, 0, []
    for span in new:
        while at < len(held) and held[at][0] < span[1]:
            reach = max(reach, held[at][1])
            at += 1
        if reach <= span[0]:
            out.append(span)
    return out


def _spans(texts: pa.Array) -> pa.Array:
    return pa.array([[{"kind": s.kind, "first": s.first, "end": s.end, "score": s.score} for s in detected(t or "")] for t in texts.to_pylist()], _SPANS)


def personal_data(df: DataFrame, text_col: str = "text", into: str = "pii") -> DataFrame:
    """df with a column `into` of spans (kind, first, end, score): code points, end exclusive, by start and then kind as in KINDS.

    One narrow pass, nothing moves. Null counts as empty and has no spans; repeated rows get equal spans; an empty table stays empty; a
    column that is already named `into` is replaced. A text of any length is searched whole, in time linear in its length.
    """
    return df.withColumn(into, F.arrow_udf(_spans, SPANS)(F.col(f"`{text_col}`")))


def redacted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with text_col in which every span is replaced by its kind in angle brackets; overlapping spans become one, named by the first.
    Null stays null."""

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            parts, at = [], 0
            for s in detected(text or ""):
                if s.first >= at:
                    parts += [text[at : s.first], f"<{s.kind}>"]
                at = max(at, s.end)
            out.append(None if text is None else "".join([*parts, text[at:]]))
        return pa.array(out, pa.string())

    return df.withColumn(text_col, masked(F.col(f"`{text_col}`")))


def listed(spans: Column) -> Column:
    """kind:first:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every whole text of documents."""
    spans = F.col("pii")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))


__all__ = ["BASE", "KINDS", "Span", "base_spans", "detected", "luhn", "mod97", "personal_data", "query", "redacted"]
