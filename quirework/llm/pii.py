"""Operator 5: personal data. Patterns propose spans, checksums confirm them, nearby words move the score.

Base kinds are email, ip, card and phone as the contract defines them; each is proposed leftmost and
without overlap within its kind, then checked (parts, Luhn, number of digits), with no second try.
The method adds ``iban``: an account number that passes mod-97. Its end is where its country's length says; other ends
between 15 and 34 signs are tried after that, the longest first. A span's score begins with what its pattern and checksum
are worth, rises by ``SWAY`` where a context word of its kind stands near and falls by as much where a word stands near
that names numbers of another kind. Base spans stay whatever their score is, added ones need ``ADDED_AT_LEAST``: so a number of its
country's length is admitted unless such a word speaks against it, and one of another length only if a context word
speaks for it.

Defined results: a null text counts as empty; empty texts have no spans; rows that repeat are each
reported; an empty table gives an empty table. Extra columns are ignored, whatever their names.
Work and memory grow in proportion to a text's length: no pattern can retry within a run of characters.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame

from quirework.llm.common import carried, in_small_batches, restored

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
ADDED_AT_LEAST = 0.5
SWAY = 0.2
#: Characters on each side in which context words count.
NEAR = 40
CONTEXT = {
    "email": ("mail", "e-mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte", "transfer"),
}
#: Words that name numbers of another kind.
AGAINST = {
    "email": ("example", "noreply", "no-reply"),
    "ip": ("version", "release", "section", "chapter"),
    "card": ("isbn", "order", "tracking", "serial", "id"),
    "phone": ("isbn", "order", "tracking", "serial", "version"),
    "iban": ("isbn", "order", "part", "serial", "sku", "tracking", "version", "checksum", "license", "key"),
}
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.6}

#: Score of an account number whose length is not its country's.
UNUSUAL_IBAN = 0.4
#: Lengths in the register of ISO 13616.
IBAN_LENGTH = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _accounts(text: str):
    """(start, end, prior) of account numbers without overlap; a start that none follows leaves the next ones free."""
    floor = 0
    for start in _IBAN.finditer(text):
        found = _ACCOUNT.match(text, start.start()) if start.start() >= floor else None
        if not found:
            continue
        signs, ends = 0, []
        for place in range(found.start(), found.end()):
            signs += text[place] != " "
            after = text[place + 1 : place + 2]
            if signs >= 15 and text[place] != " " and not (after.isascii() and after.isalnum()):
                ends.append((signs != IBAN_LENGTH.get(start[0][:2]), -signs, place + 1))
        for unusual, _, end in sorted(ends):
            if mod97(text[found.start() : end].replace(" ", "")):
                score = scored("iban", UNUSUAL_IBAN if unusual else PRIOR["iban"], text, found.start(), end)
                if score >= ADDED_AT_LEAST:
                    yield found.start(), end, score
                    floor = end
                    break


def _any_word(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, words))})(?!\w)")


_FOR, _CONTRA = ({kind: _any_word(words) for kind, words in told.items()} for told in (CONTEXT, AGAINST))


def scored(kind: str, prior: float, text: str, a: int, b: int) -> float:
    """The span's score by the words near it."""
    around = f" {text[max(0, a - NEAR) : a]} {text[b : b + NEAR]} ".lower()
    return round(min(1.0, prior + SWAY * bool(_FOR[kind].search(around)) - SWAY * bool(_CONTRA[kind].search(around))), 6)


def _emails(text: str):
    """Spans of the leftmost matches: what stands before each @ decides where one begins."""
    floor = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-"):
            begin -= 1
        found = _AT.match(text, at) if begin < at else None
        if found:
            yield begin, found.end()
            floor = found.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", floor)


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of every confirmed span, by kind and start; code points, end exclusive."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    found += [
        ("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    ]
    for m in _CARD.finditer(text):
        if len(m[0]) <= 37 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return [(kind, a, b, scored(kind, PRIOR[kind], text, a, b)) for kind, a, b in found] + [
        ("iban", *account) for account in _accounts(text)
    ]


def joined(found) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in found)


SCHEMA = (
    "doc_id long, no_id boolean, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "scores array<double>"
)


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, the digest of their list, all spans and their scores."""

    def scan(batches):
        for batch in batches:
            rows = []
            for doc_id, no_id, text in zip(batch["doc_id"], batch["no_id"], batch["text"], strict=True):
                found = spans(text) if isinstance(text, str) else []
                base = [s for s in found if s[0] in BASE]
                counts = [sum(s[0] == kind for s in base) for kind in BASE]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((doc_id, no_id, *counts, digest, joined(found), [s[3] for s in found]))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return restored(carried(in_small_batches(docs), docs["text"]).mapInPandas(scan, SCHEMA))
