"""BPE encoding and decoding with a pair occurrence index.

A task normalises and splits its texts as the vocabulary file says and keeps the encoding of each
piece it has met. The words that a batch brings anew are encoded together: an index maps every pair
of neighbouring symbols to all its positions in the batch; a heap gives the active ranks in
ascending order; each merge is applied at all positions of its pair, and only the lists of the
neighbouring pairs change.

Defined results: a null or empty text has no tokens and decodes to the empty text; the strings of
special tokens inside a text become those tokens, as in the tokenizers library; repeated rows and
null doc_ids are encoded each on their own.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_columns

#: Pieces whose encodings a task keeps; the store starts anew beyond it.
KEPT_PIECES = 250_000


@dataclass(frozen=True)
class Vocabulary:
    """What a tokenizer file holds: token ids, merges in order of rank, special tokens and the split pattern."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    special: dict[str, int]
    pattern: str
    end: str


def read_vocabulary(path: str) -> Vocabulary:
    """Read a BPE file of the tokenizers library whose words are lower-cased, split by a pattern and end in a suffix."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model, split = held["model"], held["pre_tokenizer"]["pretokenizers"][0]
    kinds = [n["type"] for n in held["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or held["decoder"] is not None:
        raise ValueError(f"{path}: not a word-end BPE file")
    return Vocabulary(model["vocab"], [tuple(m) for m in model["merges"]], {t["content"]: t["id"] for t in held["added_tokens"]}, split["pattern"]["Regex"], model["end_of_word_suffix"])


def byte_letters() -> dict[int, str]:
    """A printable letter for each byte: itself if it is printable Latin-1, else the next free code point from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.token = {i: t for t, i in v.ids.items()} | {i: t for t, i in v.special.items()}
        self.merge = {(v.ids[a], v.ids[b]): rank for rank, (a, b) in enumerate(v.merges)}
        self.merged = [(v.ids[a], v.ids[b], v.ids[a + b]) for a, b in v.merges]
        letters = byte_letters()
        # a byte inside a word, and 256 further the same byte at its end
        self.byte = np.array([v.ids[letters[b] + end] for end in ("", v.end) for b in range(256)])
        self.first = np.full((512, 512), -1)
        code = {int(i): c for c, i in enumerate(self.byte)}
        for (left, right), rank in self.merge.items():
            if left in code and right in code:
                self.first[code[left], code[right]] = rank
        self.words_of = regex.compile(v.pattern).findall
        self.special = v.special
        self.special_in = regex.compile("|".join(map(regex.escape, v.special))) if v.special else None
        self.starts = tuple({s[:2] for s in v.special})
        self.words: dict[str, tuple[str, str, int]] = {}
        self.pieces: dict[str, tuple[str, str, int]] = {}

    def learn(self, words: list[str]) -> None:
        """Encode new words together over their pair occurrence index."""
        data = [w.encode() for w in words]
        ends = np.cumsum([len(x) for x in data]) - 1
        codes = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.int64)
        codes[ends] += 256
        symbol = self.byte[codes].tolist()
        after, before = np.arange(1, len(codes) + 1), np.arange(-1, len(codes) - 1)
        after[ends] = before[0] = before[ends[:-1] + 1] = -1
        after, before = after.tolist(), before.tolist()
        ranks = self.first[codes[:-1], codes[1:]]
        ranks[ends[:-1]] = -1  # a pair over the end of a word
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        active, begin = np.unique(ranks[at], return_index=True)
        active = active.tolist()  # ascending, so a heap
        places = {rank: part.tolist() for rank, part in zip(active, np.split(at, begin[1:]))}
        get, merged, push = self.merge.get, self.merged, heapq.heappush
        while active:
            rank = heapq.heappop(active)
            left, right, new = merged[rank]
            for i in sorted(places.pop(rank)):
                j = after[i]
                if symbol[i] != left or j < 0 or symbol[j] != right:
                    continue  # an earlier merge took one of its symbols
                k, h = after[j], before[i]
                symbol[i], after[i], symbol[j] = new, k, -1
                if h >= 0 and (hit := get((symbol[h], new))) is not None:
                    if hit in places:
                        places[hit].append(h)
                    else:
                        places[hit] = [h]
                        push(active, hit)
                if k >= 0:
                    before[k] = i
                    if (hit := get((new, symbol[k]))) is not None:
                        if hit in places:
                            places[hit].append(i)
                        else:
                            places[hit] = [i]
                            push(active, hit)
        # what is left of each word stands in its order
        held = np.array(symbol)
        left = held >= 0
        stops, held, lo = np.cumsum(left)[ends].tolist(), held[left].tolist(), 0
        for w, hi in zip(words, stops):
            self.words[w] = self._piece(held[lo:hi])
            lo = hi

    def _piece(self, ids: list[int]) -> tuple[str, str, int]:
        return " ".join(map(str, ids)), " ".join([self.token[i] for i in ids]), len(ids)

    def _split(self, text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split, not to the pattern
            return regex.split(r"\s+", text.strip(" \t\n\r\x0b\x0c\x85"))
        return text.split()

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text, all of which ``pieces`` then holds."""
        if len(self.pieces) > KEPT_PIECES:
            self.pieces, self.words = {}, {}
        out, met = [], set()
        for text in texts:
            if self.special_in and any(s in text for s in self.starts):
                found, at = [], 0
                for m in self.special_in.finditer(text):
                    found += self._split(text[at : m.start()])
                    found.append(m[0])
                    at = m.end()
                found += self._split(text[at:])
            else:
                found = self._split(text)
            out.append(found)
            met.update(found)
        new = {p: None if p in self.special else self.words_of(unicodedata.normalize("NFC", p).replace("Σ", "σ").lower()) for p in met.difference(self.pieces)}
        unknown = {w for ws in new.values() if ws for w in ws if w not in self.words}
        if unknown:
            self.learn(list(unknown))
        for p, ws in new.items():
            if ws is None:
                self.pieces[p] = self._piece([self.special[p]])
            elif len(ws) == 1:
                self.pieces[p] = self.words[ws[0]]
            else:
                parts = [self.words[w] for w in ws]
                self.pieces[p] = " ".join([x[0] for x in parts]), " ".join([x[1] for x in parts]), sum([x[2] for x in parts])
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.token[i] for i in ids)


def _run(documents: DataFrame, vocabulary: Vocabulary, schema: str, row, columns: tuple[str, ...]) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(vocabulary)  # the size of one vocabulary file

    def start():
        encoder = Encoder(held.value)

        def run(cols):
            names = [f.strip().split(" ")[0] for f in schema.split(",")]
            out: dict = {n: [] for n in names} | {c: cols[c] for c in columns}
            texts = cols["text"]
            for at in range(0, len(texts), 512):  # so that the index of a batch stays small
                for pieces in encoder.prepare([t or "" for t in texts[at : at + 512]]):
                    for n, value in zip(names[len(columns) :], row([encoder.pieces[p] for p in pieces])):
                        out[n].append(value)
            return out

        return run

    return map_columns(documents.select(*columns, "text"), schema, start)


def digests(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def row(found):
        found = [f for f in found if f[2]]
        ids, text = " ".join([f[0] for f in found]), " ".join([f[1] for f in found])
        return sum([f[2] for f in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _run(documents, vocabulary, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row, ("doc_id",))


def encode(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, ids)."""

    def row(found):
        return sum(f[2] for f in found), [int(i) for f in found for i in f[0].split()]

    return _run(documents, vocabulary, "doc_id long, n_tokens long, ids array<int>", row, ("doc_id",))


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): tokens with a space between, as the library joins them where a file names no decoder."""
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def start():
        encoder = Encoder(held.value)
        return lambda cols: {"doc_id": cols["doc_id"], "text": [encoder.decode(i or []) for i in cols["ids"]]}

    return map_columns(encoded.select("doc_id", "ids"), "doc_id long, text string", start)
