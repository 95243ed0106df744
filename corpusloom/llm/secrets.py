"""Secret scans: the token-efficiency test.

Text of a language takes few tokens of a vocabulary; random strings take many. The base kinds
(assign, access, hex) keep every span that passes its check. The method adds ``random``: strings of
``SHORTEST`` or more key characters, with letters and digits, that take a token for fewer than
``RATIO`` characters, after leaving out known digests (hex of a digest's length), UUIDs and
identifiers (words joined by case, underscores or hyphens with at most a short number). Where a run
of key characters is readable as a whole, the stretches of its parts (between = / _ -) that pass the
same test are spans. Offsets are code points, end exclusive.

Defined results: a null or empty text has no spans; repeated rows and null doc_ids are searched
each on their own; very long texts take time in proportion to their length.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame

from .common import Taken, map_columns

BASE = ("assign", "access", "hex")
ADDED = ("random",)
SHORTEST, RATIO = 20, 2.2
#: A string counts up to here for the ratio; random strings show themselves early, and longer ones are taken in pieces.
PIECE = 256
#: Lengths in hex of common digests.
DIGESTS = (32, 40, 48, 56, 64, 96, 128)

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_HINT = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
_UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
_PART = re.compile(rf"(?P<known>(?<![0-9A-Za-z])(?:{_UUID.pattern}|{'|'.join(f'[0-9A-Fa-f]{{{n}}}' for n in DIGESTS)})(?![0-9A-Za-z]))|(?P<part>[A-Za-z0-9+]+)|[=/_-]")
_ALL_HEX = re.compile(r"[0-9A-Fa-f]+")
_JOINED = re.compile(r"[A-Za-z_/=+-]+")
_LONE = re.compile(r"(?<![a-z])[a-z](?![a-z])|(?<![A-Z])[A-Z](?![A-Za-z])")
_NUMBERS = re.compile(r"[0-9]{1,4}(?:[_/-][0-9]{1,4})*")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def is_identifier(text: str) -> bool:
    """Words of two letters or more, joined by case or separators, and short numbers at the end; three scans, whatever the text."""
    words = _JOINED.match(text)
    return bool(words) and not _LONE.search(words[0]) and (words.end() == len(text) or bool(_NUMBERS.fullmatch(text, words.end())))


def looks_random(text: str, tokens_of) -> bool:
    if not (re.search(r"[0-9]", text) and re.search(r"[A-Za-z]", text)):
        return False
    if _UUID.fullmatch(text) or (_ALL_HEX.fullmatch(text) and len(text) in DIGESTS) or is_identifier(text):
        return False
    return len(text) < RATIO * sum(len(tokens_of(text[i : i + PIECE])) for i in range(0, len(text), PIECE))


def random_stretches(text: str, tokens_of) -> list[tuple[int, int]]:
    """The stretches of a run that look random though the run as a whole doesn't: a readable key or path stands beside them."""
    if not (re.search(r"[0-9]", text) and re.search(r"[A-Za-z]", text)) or _UUID.fullmatch(text) or is_identifier(text):
        return []
    # parts between separators, joined as long as each next part is random enough; known strings part stretches
    found, held, gain, best, best_end = [], None, 0.0, 0.0, 0

    def close():
        if held is not None and best_end - held >= SHORTEST and looks_random(text[held:best_end], tokens_of):
            found.append((held, best_end))

    for m in _PART.finditer(text):
        known = m["known"] is not None
        value = RATIO * sum(len(tokens_of(m[0][i : i + PIECE])) for i in range(0, len(m[0]), PIECE)) - len(m[0])
        if known or held is None or gain + value <= 0:
            close()
            held, gain, best, best_end = None, 0.0, 0.0, 0
            if known or value <= 0 or m["part"] is None:
                continue
            held = m.start()
        gain += value
        if gain > best and (m["part"] is not None or m[0] == "="):
            best, best_end = gain, m.end()
    close()
    return found


def find(text: str, tokens_of) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans by start and kind, and added spans by start."""
    base = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINT):
        base += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [("hex", *m.span()) for m in _HEX.finditer(text)]
    base.sort(key=lambda x: (x[1], BASE.index(x[0])))
    taken = Taken([(s, e) for _, s, e in base])
    added, at, reach = [], 0, 0
    for m in _LONG.finditer(text):
        while at < len(base) and base[at][1] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start() and looks_random(m[0], tokens_of):
            added.append(("random", *m.span()))
        else:
            stretches = [(m.start() + a, m.start() + b) for a, b in random_stretches(m[0], tokens_of)]
            added += [("random", a, b) for a, b in stretches if not taken.overlaps(a, b)]
    return base, added


def _text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(documents: DataFrame, ranks_path: str, pattern: str, schema: str, rows) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # the size of one vocabulary file

    def start():
        import tiktoken

        tokens_of = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=held.value, special_tokens={}).encode_ordinary
        return lambda cols: rows(cols, tokens_of)

    return map_columns(documents.select("doc_id", "text"), schema, start)


def detect(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per span: doc_id, kind, start, end, base."""

    def rows(cols, tokens_of):
        out: dict = {k: [] for k in ("doc_id", "kind", "start", "end", "base")}
        for doc, text in zip(cols["doc_id"], cols["text"]):
            for is_base, spans in zip((True, False), find(text or "", tokens_of)):
                for x in spans:
                    for k, v in zip(out, (doc, *x, is_base)):
                        out[k].append(v)
        return out

    return _scan(documents, ranks_path, pattern, "doc_id long, kind string, start long, end long, base boolean", rows)


def digests(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    order = {k: i for i, k in enumerate(BASE + ADDED)}

    def rows(cols, tokens_of):
        out: dict = {"doc_id": cols["doc_id"]} | {f"n_{k}": [] for k in BASE} | {"base_sha256": [], "spans": []}
        for text in cols["text"]:
            base, added = find(text or "", tokens_of)
            for k in BASE:
                out[f"n_{k}"].append(sum(x[0] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(_text(base).encode()).hexdigest())
            out["spans"].append(_text(sorted(base + added, key=lambda x: (x[1], order[x[0]]))))
        return out

    return _scan(documents, ranks_path, pattern, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string", rows)
