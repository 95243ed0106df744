"""PII: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

The base kinds (email, ip, card, phone) keep every span that passes its check. The method adds
kinds that need evidence: a span counts when its kind's score, plus ``CONTEXT_BONUS`` for a context
word within ``CONTEXT`` characters, reaches ``ACCEPT``. Offsets are code points, end exclusive.

Defined results: a null or empty text has no spans; repeated rows and null doc_ids are searched
each on their own; very long texts take time in proportion to their length.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Taken, map_columns

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "shortcard", "national")
CONTEXT, CONTEXT_BONUS, ACCEPT = 48, 0.35, 0.6
#: A kind's score by its pattern and checksum alone.
SCORE = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "shortcard": 0.4, "national": 0.3}
#: Words that make a kind likelier.
WORDS = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "address", "host", "server"), "card": ("card", "credit", "visa", "payment"), "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank"), "shortcard": ("card", "credit", "amex", "payment"), "national": ("ssn", "social", "security", "passport", "national", "tax"),
}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_BEFORE_AT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_PART = re.compile(r"\x20?([A-Z0-9]+)")
IBAN_LENGTHS = (15, 34)
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """Codes of 15 to 34 characters whose checksum holds: of the ends that a start can have, the last that passes, so words behind a code don't hide it."""
    out, reach = [], 0
    for m in _IBAN.finditer(text):
        if m.start() < reach:
            continue
        code, at, best = m[0], m.end(), None
        while len(code) <= IBAN_LENGTHS[1]:
            part = _IBAN_PART.match(text, at)
            if not part:
                break
            code, at = code + part[1], part.end()
            whole = at == len(text) or not (text[at].isascii() and text[at].isalnum())
            if whole and IBAN_LENGTHS[0] <= len(code) <= IBAN_LENGTHS[1] and mod97(code):
                best = at
        if best:
            out.append((m.start(), best))
            reach = best
    return out


def emails(text: str) -> list[tuple[int, int]]:
    """What the pattern ``[A-Za-z0-9._%+-]+@domain`` finds, from its @ signs outward, in linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _BEFORE_AT:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            end = max(end, at)  # no match can reach over this sign
            at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def _near(text: str, start: int, end: int, kind: str) -> bool:
    around = (text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower()
    found = set(re.findall(r"[a-z]+", around))
    return any(w in found for w in WORDS[kind])


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and added spans, each by kind and start."""
    base, added = [("email", *s) for s in emails(text)], []
    if not _DIGIT.search(text):
        return base, added
    base += [("ip", *s) for s in ips(text)] if "." in text else []
    cards, short = [], []
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0]) if len(m[0]) < 64 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            cards.append(("card", *m.span()))
        elif 13 <= len(digits) <= 15 and luhn(digits):
            short.append(("shortcard", *m.span()))
    base += cards
    if "+" in text:
        base += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    added += [("iban", *x) for x in ibans(text)]
    added += short
    added += [("national", *m.span()) for m in _NATIONAL.finditer(text)]
    taken = Taken([(s, e) for _, s, e in base])
    sure = [x for x in added if score(text, *x) >= ACCEPT and not taken.overlaps(x[1], x[2])]
    return base, sure


def score(text: str, kind: str, start: int, end: int) -> float:
    return min(1.0, SCORE[kind] + CONTEXT_BONUS * _near(text, start, end, kind))


def detect(documents: DataFrame) -> DataFrame:
    """One row per span: doc_id, kind, start, end, score, base."""

    def start():
        def run(cols):
            out: dict = {k: [] for k in ("doc_id", "kind", "start", "end", "score", "base")}
            for doc, text in zip(cols["doc_id"], cols["text"]):
                text = text or ""
                found = find(text)
                for is_base, spans in zip((True, False), found):
                    for kind, s, e in spans:
                        for k, v in zip(out, (doc, kind, s, e, score(text, kind, s, e), is_base)):
                            out[k].append(v)
            return out

        return run

    return map_columns(documents.select("doc_id", "text"), "doc_id long, kind string, start long, end long, score double, base boolean", start)


def _text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    order = {k: i for i, k in enumerate(BASE + ADDED)}

    def start():
        def run(cols):
            out: dict = {"doc_id": cols["doc_id"]} | {f"n_{k}": [] for k in BASE} | {"base_sha256": [], "spans": []}
            for text in cols["text"]:
                base, added = find(text or "")
                for k in BASE:
                    out[f"n_{k}"].append(sum(x[0] == k for x in base))
                out["base_sha256"].append(hashlib.sha256(_text(base).encode()).hexdigest())
                out["spans"].append(_text(sorted(base + added, key=lambda x: (order[x[0]], x[1]))))
            return out

        return run

    return map_columns(documents.select("doc_id", F.col("text")), "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string", start)
