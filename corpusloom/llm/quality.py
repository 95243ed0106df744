"""Quality rules: a linear-chain conditional random field labels lines content or boilerplate.

The labels judge documents, so every line of a labelled document takes its document's label for
training; the chain's weights average out what that gets wrong. Such chains never change their label,
so the transitions learn to stay: decoding then smooths, and a lone odd line goes with its
neighbours instead of by itself. Viterbi decoding gives each line its
label, and the share of words in content lines decides, after two plain rules, whether a document
stays.

Defined results: a null or empty text has no words, fails the plain rules and isn't kept; repeated
rows and null doc_ids are judged each on their own; without labels of both kinds all lines count as
content and the plain rules decide alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, utf8

#: Labelled documents that the field is fitted on, at most; a fixed bound, taken in the order of a hash of doc_id.
FIT_ROWS = 6_000
#: Training takes at most CHAINS chains of at most CHAIN lines from a labelled document, spread over it; decoding takes whole documents.
CHAIN, CHAINS = 64, 4
CONTENT_SHARE = 0.5
WINDOW = 8

_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"
_LOWER = re.compile(rb"[a-z\xc3-\xf4]")
FEATURES = 14


def repeated(words: list[bytes]) -> np.ndarray:
    """For each word, whether it lies in a window of WINDOW words that occurs twice or more."""
    n = len(words)
    covered = np.zeros(n, dtype=bool)
    if n <= WINDOW:
        return covered
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    if len(number) == n:
        return covered
    x = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    h = np.zeros(n - WINDOW + 1, dtype=np.uint64)
    for i in range(WINDOW):
        h = h * np.uint64(0x94D049BB133111EB) + x[i : n - WINDOW + 1 + i]
        h ^= h >> np.uint64(31)
    _, at, times = np.unique(h, return_inverse=True, return_counts=True)
    begins = np.flatnonzero(times[at] > 1)
    if len(begins):
        change = np.zeros(n + 1, dtype=np.int64)
        np.add.at(change, begins, 1)
        np.add.at(change, begins + WINDOW, -1)
        covered = np.cumsum(change[:n]) > 0
    return covered


def measure(data: bytes) -> tuple[dict, np.ndarray, np.ndarray]:
    """The plain measures of a text, and the features and word counts of its lines that have words."""
    words = data.split()
    covered = repeated(words)
    lines, seen, dup = data.split(b"\n"), set(), 0
    rows, counts, at = [], [], 0
    sums = np.concatenate([[0], np.cumsum(covered)])
    for line in lines:
        ws = line.split()
        if not ws:
            continue
        n, size = len(ws), len(line)
        again = line in seen
        dup += again
        seen.add(line)
        upper = size - len(line.translate(None, _UPPER))
        symbols = size - len(line.translate(None, _SYMBOLS))
        letters = max(1, size - n)
        rows.append((1.0, min(1.0, symbols / n), min(1.0, upper / letters * 2), min(1.0, line.count(b"!") / n), min(1.0, (size - len(line.translate(None, _DIGITS))) / letters * 3), float(again), 1 - len(set(ws)) / n, (sums[at + n] - sums[at]) / n, np.log1p(n) / 5, float(ws[-1][-1:] in b".!?"), min(1.0, line.count(b"|") / n), min(2.0, letters / n / 10), float(not _LOWER.search(line)), float(n < 3)))
        counts.append(n)
        at += n
    base = {"n_words": len(words), "word_chars": len(data.translate(None, _CONTINUED + _SPACE)), "n_symbols": len(data) - len(data.translate(None, _SYMBOLS)), "n_dup_lines": dup, "n_repeat_words": int(covered.sum())}
    return base, np.array(rows, dtype=np.float64).reshape(-1, FEATURES), np.array(counts, dtype=np.int64)


def base_fails(m: dict) -> bool:
    return m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]


@dataclass
class LineField:
    """Weights of a two-label chain: emission (features x labels) and transition (label x label); label 1 is content."""

    emission: np.ndarray
    transition: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The likeliest labels of all lines together (Viterbi)."""
        n = len(features)
        if not n:
            return np.zeros(0, dtype=np.int64)
        e = (features @ self.emission).tolist()
        (aa, ab), (ba, bb) = self.transition.tolist()
        a, b = e[0]
        back = []
        for x, y in e[1:]:
            from_a, from_b = a + aa >= b + ba, a + ab > b + bb
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = (a + aa if from_a else b + ba) + x, (a + ab if from_b else b + bb) + y
        label = 0 if a > b else 1
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return np.array(out[::-1])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(chains: list[tuple[np.ndarray, int]], steps: int = 120, l2: float = 1e-4) -> LineField:
    """Maximum likelihood by forward-backward and Adam; a chain is its features and its document's label."""
    parts = sorted(((x[i : i + CHAIN], y) for x, y in chains for i in range(0, len(x), CHAIN)), key=lambda c: -len(c[0]))
    s, width = len(parts), max(len(x) for x, _ in parts)
    X, mask, Y = np.zeros((s, width, FEATURES)), np.zeros((s, width)), np.zeros(s, dtype=np.int64)
    for i, (x, y) in enumerate(parts):
        X[i, : len(x)], mask[i, : len(x)], Y[i] = x, 1, y
    lines = mask.sum()
    going = mask.sum(axis=0).astype(int)
    gold_e = np.stack([(X * mask[..., None])[Y == k].sum(axis=(0, 1)) for k in (0, 1)], axis=1)
    gold_t = np.diag([(mask[:, 1:][Y == k]).sum() for k in (0, 1)]).astype(float)
    w, m1, m2 = np.zeros(FEATURES * 2 + 4), np.zeros(FEATURES * 2 + 4), np.zeros(FEATURES * 2 + 4)
    for step in range(1, steps + 1):
        E, T = w[: FEATURES * 2].reshape(FEATURES, 2), w[FEATURES * 2 :].reshape(2, 2)
        emit = X @ E
        alpha = [emit[:, 0]]
        total = _log_sum(alpha[0], 1)
        for t in range(1, width):  # chains go by length, so those that go on stand first
            n = going[t]
            alpha.append(_log_sum(alpha[-1][:n, :, None] + T[None], 1) + emit[:n, t])
            total[:n] = _log_sum(alpha[t], 1)
        beta = np.zeros((s, 2))
        grad_e, grad_t = np.zeros_like(E), np.zeros((2, 2))
        for t in range(width - 1, -1, -1):
            n = going[t]
            grad_e += X[:n, t].T @ np.exp(alpha[t] + beta[:n] - total[:n, None])
            if t:
                step_on = emit[:n, t] + beta[:n]
                grad_t += np.exp(alpha[t - 1][:n, :, None] + T[None] + step_on[:, None, :] - total[:n, None, None]).sum(axis=0)
                beta[:n] = _log_sum(T[None] + step_on[:, None, :], 2)
        grad = np.concatenate([(grad_e - gold_e).ravel(), (grad_t - gold_t).ravel()]) / lines + l2 * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        w = w - 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    return LineField(w[: FEATURES * 2].reshape(FEATURES, 2), w[FEATURES * 2 :].reshape(2, 2))


def stretches(features: np.ndarray) -> np.ndarray:
    """All lines of a document of up to CHAIN * CHAINS lines; of a longer one as many, in chains that lie evenly over it."""
    n = len(features)
    if n <= CHAIN * CHAINS:
        return features
    return np.concatenate([features[at : at + CHAIN] for at in np.linspace(0, n - CHAIN, CHAINS).astype(int)])


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> LineField | None:
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = documents.select("doc_id", utf8()).join(F.broadcast(chosen), "doc_id").select("utf8", "quality")

    def start():
        def run(cols):
            found = [stretches(measure(t)[1]) for t in cols["utf8"]]
            return {"quality": cols["quality"], "features": [f.ravel() for f in found]}

        return run

    got = [(np.array(r["features"]).reshape(-1, FEATURES), int(r["quality"])) for r in map_columns(sample, "quality long, features array<double>", start).collect() if r["features"]]
    return train(got) if {y for _, y in got} == {0, 1} else None


def judge(documents: DataFrame, field: LineField | None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def start():
        def run(cols):
            out: dict = {"doc_id": cols["doc_id"]} | {n: [] for n in (*names, "base_failed", "kept", "content_share")}
            for text in cols["utf8"]:
                m, features, counts = measure(text)
                label = field.decode(features) if field else np.ones(len(counts))
                share = float((label * counts).sum() / counts.sum()) if len(counts) else 0.0
                failed = base_fails(m)
                for n in names:
                    out[n].append(m[n])
                out["base_failed"].append(failed), out["kept"].append(not failed and share >= CONTENT_SHARE), out["content_share"].append(share)
            return out

        return run

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, content_share double"
    return map_columns(documents.select("doc_id", utf8()), schema, start)
