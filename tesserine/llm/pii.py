"""Personal data: patterns propose, validators confirm, context adjusts.

Each kind has a pattern that proposes spans, a base score, and, where the format has one, a
validator that a span must pass: Luhn for card numbers, the mod-97 rule for IBANs, octet
ranges for addresses, number ranges for US social security numbers.  A span that fails its
validator is dropped whatever stands beside it.  A kind may propose more than a pattern's
match: of a run of digit groups every stretch of whole groups may be a card number, and an
IBAN may end before the match does.  Words near a confirmed span then
move its score: words of the kind raise it, words that speak of samples, orders or versions
lower it.  Spans below ``threshold`` are dropped.  Of overlapping spans that remain, the higher
score stays, of equal ones the longer, then the first.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD, REACH, BOOST, DAMP = 0.5, 60, 0.25, 0.25


def luhn(digits: str) -> bool:
    """Luhn's check over the digits of a card number of 13 to 19 digits, not all alike."""
    d = [int(c) for c in digits if c.isdigit()]
    if not 13 <= len(d) <= 19 or len(set(d)) == 1:
        return False
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0


#: Lengths of IBANs by country; an unlisted country is not an IBAN.
IBAN_LENGTH = dict(
    p.split(":")
    for p in (
        "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 "
        "GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MR:27 "
        "MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20"
    ).split()
)


def iban(text: str) -> bool:
    """ISO 13616: length of the country and remainder 1 modulo 97."""
    s = re.sub(r"[ -]", "", text).upper()
    if str(len(s)) != IBAN_LENGTH.get(s[:2]):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ipv4(text: str) -> bool:
    try:
        a = ipaddress.IPv4Address(text)
    except ValueError:
        return False
    return not (a.is_unspecified or a.is_loopback or a.is_multicast or int(a) == 0xFFFFFFFF)


def ssn(text: str) -> bool:
    a, b, c = text.split("-")
    return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


def phone(text: str) -> bool:
    return 8 <= sum(c.isdigit() for c in text) <= 15


def email(text: str) -> bool:
    local, _, host = text.rpartition("@")
    return bool(local) and ".." not in text and len(local) <= 64 and all(0 < len(p) <= 63 and p[0] != "-" != p[-1] for p in host.split("."))


def cards(run: str) -> Iterator[tuple[int, int]]:
    """Stretches of whole digit groups of a run that pass Luhn's check."""
    groups = [m.span() for m in re.finditer(r"\d+", run)]
    for i, (s, _) in enumerate(groups):
        many = 0
        for a, e in groups[i : i + 19]:
            many += e - a
            if many > 19:
                break
            if many >= 13 and luhn(run[s:e]):
                yield s, e


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest start of the text, of whole groups, that is an IBAN."""
    while not iban(text):
        if (cut := max(text.rfind(" "), text.rfind("-"))) <= 0:
            return
        text = text[:cut]
    yield 0, len(text)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    valid: Callable[[str], bool] | None
    near: str
    within: Callable[[str], Iterator[tuple[int, int]]] | None = None  # the valid spans in a match; else the match itself
    sign: str = r"\d"  # what every match of the pattern holds: a text without it isn't searched for this kind


KINDS: tuple[Kind, ...] = (
    Kind("email", r"(?<![\w.+%-])[\w.+%-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![\w-])", 0.9, email, "e-?mail|mail|contact|courriel|correo|kontakt", sign="@"),
    Kind("credit_card", r"(?<![\w.-])\d(?:[ -]?\d){12,}(?![\w-]|\.\d)", 0.7, luhn, "card|visa|mastercard|amex|credit|carte|tarjeta|karte|kreditkarte", cards),
    Kind("iban", r"(?<!\w)[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{1,4}){3,8}(?!\w)", 0.8, iban, "iban|bank|account|konto|compte|cuenta|bic|swift", ibans),
    Kind("ip_address", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", 0.6, ipv4, "ip|host|server|address|adresse|dirección"),
    Kind("us_ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", 0.6, ssn, "ssn|social|security"),
    Kind("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[.-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-]|\.\d)", 0.6, phone, "phone|tel|mobile|call|fax|téléphone|telefon|teléfono|handy"),
)
AGAINST = "example|sample|dummy|test|invalid|version|order|invoice|isbn|beispiel|exemple|ejemplo"


class Finder:
    def __init__(self, kinds: tuple[Kind, ...] = KINDS, threshold: float = THRESHOLD, reach: int = REACH, boost: float = BOOST, damp: float = DAMP):
        self.kinds = [(k, re.compile(k.pattern), re.compile(rf"(?<!\w)(?:{k.near})(?!\w)", re.IGNORECASE)) for k in kinds]
        self.against = re.compile(rf"(?<!\w)(?:{AGAINST})(?!\w)", re.IGNORECASE)
        self.threshold, self.reach, self.boost, self.damp = threshold, reach, boost, damp

    @staticmethod
    def proposed(kind: Kind, pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
        at = 0
        while m := pattern.search(text, at):
            if kind.within:
                got = [(m.start() + s, m.start() + e) for s, e in kind.within(m.group())]
                yield from got
                # an IBAN may begin right behind another, or within a match that holds none from its start
                at = m.end() if kind.within is cards else got[-1][1] if got else m.start() + 1
            else:
                yield m.span()
                at = m.end()

    def find(self, text: str) -> list[tuple[str, int, int, float]]:
        """(kind, start, end, score) in characters, by start."""
        found = []
        signs = {sign: re.search(sign, text) is not None for sign in {k.sign for k, _, _ in self.kinds}}
        for kind, pattern, near in self.kinds:
            if not signs[kind.sign]:
                continue
            for s, e in self.proposed(kind, pattern, text):
                if kind.valid and not kind.valid(text[s:e]):
                    continue
                around = text[max(0, s - self.reach) : s], text[e : e + self.reach]
                score = kind.score
                if any(near.search(a) for a in around):
                    score += self.boost
                if any(self.against.search(a) for a in around):
                    score -= self.damp
                score = round(min(1.0, score), 4)
                if score >= self.threshold:
                    found.append((kind.name, s, e, score))
        kept: list[tuple[int, int, str, float]] = []  # by start, never overlapping
        for name, s, e, score in sorted(found, key=lambda f: (-f[3], f[1] - f[2], f[1], f[0])):
            at = bisect_left(kept, (s,))
            if (at == 0 or kept[at - 1][1] <= s) and (at == len(kept) or e <= kept[at][0]):
                kept.insert(at, (s, e, name, score))
        return [(name, s, e, score) for s, e, name, score in kept]


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(doc_id, kind, start, end, score, value) of every confirmed span, in characters from 0.

    Ids are integers.  Digits are those of any script, in the patterns and everywhere else.
    Null and empty texts have none; a null id is reported as null; repeated rows are reported
    repeatedly; ties between overlapping spans go by length, then place, then name of the
    kind; texts are searched whole; an empty table gives no rows; other columns are never
    looked at.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("_text")).where(F.col("_text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(**settings)
        for b in batches:
            at, got = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for f in finder.find(text):
                    at.append(i)
                    got.append((*f, text[f[1] : f[2]]))
            kind, start, end, score, value = zip(*got) if got else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(score, pa.float64()), pa.array(value, pa.string())],
                ["doc_id", "kind", "start", "end", "score", "value"],
            )

    return rows.mapInArrow(run, "doc_id long, kind string, start long, end long, score double, value string")
