"""Toxicity: cumulative-link ordinal regression over sparse text features.

Features are words and stems whose occurrence in a document goes with the flag or against it (a
likelihood ratio of at least ``EVIDENCE``); their counts saturate at ``MOST``. The labels hold a flag
and no severity, so grades are derived: 0 for unflagged rows, and 1 to ``grades`` for flagged ones,
cut at the quantiles of how often terms that the flag singles out occur in them. Those terms come
from the other half of the labelled rows, so that no row is graded by what it taught itself.
One weight vector is shared by all thresholds: P(grade >= k) = sigmoid(w.x - cut_k). The sum of
these probabilities over k is the expected severity.

Defined results: a null or empty text has no features and scores as such; a null doc_id is scored
like any other; repeated rows are scored each on its own; with no flagged or no unflagged labels
there is nothing to learn and every severity is 0; other columns pass ``reject`` untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, cut, give_back, map_columns, utf8

#: Labelled rows that the model is fitted on, at most; a fixed bound, taken in the order of a hash of doc_id.
FIT_ROWS = 20_000
#: Terms kept as features, at most: the strongest. It bounds the model; weaker terms tell less than chance would.
FEATURES = 4_096
#: A feature must occur in so many fitted documents.
MIN_DOCUMENTS = 4
#: The likelihood ratio (twice its logarithm) of occurrence and flag that a feature needs; 6.6 has a chance of 1 %.
EVIDENCE = 6.6
#: A feature's count goes no higher, so that long texts don't add up what says little.
MOST = 3
PREFIXES = (4, 5, 6)
GRADES = 3


def terms(word: bytes) -> list[bytes]:
    """The word without its outer punctuation, and its leading letters (endings vary, stems tell)."""
    core = word.strip(b".,;:!?\"'()[]|*#$%&")
    try:
        letters = core.decode()
    except UnicodeDecodeError:
        letters = core.decode("latin-1")
    return [core, *(b"^" + letters[:n].encode() for n in PREFIXES if len(letters) >= n)] if core else []


@dataclass
class OrdinalModel:
    """``P(grade >= k) = sigmoid(sum of weights - cuts[k-1])``; no weights means that nothing was learnt."""

    weights: dict[bytes, float] = field(default_factory=dict)
    cuts: list[float] = field(default_factory=list)

    def at_least(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(score[:, None] - np.array(self.cuts)[None, :], -40, 40)))


class _Features(dict):
    """word -> the features that it counts for; filled as words are met."""

    def __init__(self, index: dict[bytes, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        got = self[word] = tuple(self.index[t] for t in terms(word) if t in self.index)
        return got

    def of(self, text: bytes) -> dict[int, int]:
        """Saturated counts of the features of a text."""
        if len(self) > 150_000:
            self.clear()
        total: Counter = Counter()
        for hit in filter(None, map(self.__getitem__, text.lower().split())):
            total.update(hit)
        return {i: min(n, MOST) for i, n in total.items()}


def _likelihood_ratio(bad: Column, n: Column, all_bad: int, total: int) -> Column:
    """Twice the log likelihood ratio of a table of two by two: documents with the term and without, flagged and not."""
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    rest, clean = F.lit(total) - n, total - all_bad
    return 2 * (part(bad, n * all_bad / total) + part(n - bad, n * clean / total) + part(F.lit(all_bad) - bad, rest * all_bad / total) + part(rest - (F.lit(all_bad) - bad), rest * clean / total))


def _ordinal_fit(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grade: np.ndarray, width: int, l2: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the cumulative-link likelihood; cuts stay ordered as a first cut plus positive gaps."""
    n, top = len(grade), int(grade.max())
    w, first, gaps = np.zeros(width), np.array([1.0]), np.zeros(top - 1)
    state = [np.zeros(width + top), np.zeros(width + top)]
    for step in range(1, steps + 1):
        cuts = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        score = np.bincount(rows, weights=vals * w[cols], minlength=n)
        upper = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -40, 40)))
        p = np.concatenate([np.ones((n, 1)), upper, np.zeros((n, 1))], axis=1)
        slope = p * (1 - p)
        at = np.arange(n)
        mass = np.maximum(p[at, grade] - p[at, grade + 1], 1e-12)
        d_score = -(slope[at, grade] - slope[at, grade + 1]) / mass / n
        d_cut = np.zeros((n, top + 2))
        d_cut[at, grade] += slope[at, grade] / mass / n
        d_cut[at, grade + 1] -= slope[at, grade + 1] / mass / n
        d_cut = d_cut[:, 1 : top + 1].sum(axis=0)
        grad = np.concatenate([np.bincount(cols, weights=vals * d_score[rows], minlength=width) + l2 * w / 10, [d_cut.sum()], [d_cut[k + 1 :].sum() * np.exp(gaps[k]) for k in range(top - 1)]])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad**2
        move = 0.05 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
        w, first, gaps = w - move[:width], first - move[width : width + 1], gaps - move[width + 1 :]
    return w, np.concatenate([first, first + np.cumsum(np.exp(gaps))])


def fit(documents: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS, features: int = FEATURES, grades: int = GRADES) -> OrdinalModel:
    """Fit on at most ``rows`` labelled documents; only counts of at most ``features`` terms reach the driver."""
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    half = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).cast("long")
    sample = cut(documents.select("doc_id", utf8()).join(F.broadcast(chosen), "doc_id").select("utf8", "toxic", half.alias("half")))

    def distinct():
        def run(cols):
            out: dict = {"term": [], "toxic": [], "half": []}
            for text, toxic, part in zip(cols["utf8"], cols["toxic"], cols["half"]):
                seen = {t for w in set(text.lower().split()) for t in terms(w)}
                out["term"] += seen
                out["toxic"] += [toxic] * len(seen)
                out["half"] += [part] * len(seen)
            return out

        return run

    totals = {r["half"]: (int(r["n"]), int(r["bad"])) for r in sample.groupBy("half").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).collect()}
    n, bad = (sum(t[i] for t in totals.values()) for i in (0, 1))
    if not 0 < bad < n:
        return OrdinalModel()
    by_half = [c for h in (0, 1) for c in (F.sum(F.when(F.col("half") == h, F.col("toxic")).otherwise(0)).alias(f"bad{h}"), F.count_if(F.col("half") == h).alias(f"n{h}"))]
    seen = map_columns(sample, "term binary, toxic long, half long", distinct).groupBy("term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"), *by_half).where(F.col("n") >= MIN_DOCUMENTS)
    told = seen.withColumn("evidence", _likelihood_ratio(F.col("bad"), F.col("n"), bad, n)).where(F.col("evidence") >= EVIDENCE)
    best = told.orderBy(F.desc("evidence"), "term").limit(features).collect()
    index = {bytes(r["term"]): i for i, r in enumerate(best)}
    if not index:
        return OrdinalModel()

    def counted():
        found = _Features(index)

        def run(cols):
            got = [found.of(t) for t in cols["utf8"]]
            return {"toxic": cols["toxic"], "half": cols["half"], "at": [list(c) for c in got], "times": [list(c.values()) for c in got]}

        return run

    rows_ = map_columns(sample, "toxic long, half long, at array<int>, times array<int>", counted).collect()
    lens = np.array([len(r["at"]) for r in rows_])
    toxic, side = np.array([r["toxic"] for r in rows_]), np.array([r["half"] for r in rows_])
    r, c = np.repeat(np.arange(len(rows_)), lens), np.array([i for x in rows_ for i in x["at"]], dtype=np.int64)
    v = np.array([i for x in rows_ for i in x["times"]], dtype=np.float64)
    heavy = np.zeros(len(rows_))
    for h in (0, 1):
        others, flagged = totals.get(1 - h, (0, 0))
        telling = np.array([others > 0 and x[f"bad{1 - h}"] >= 2 and x[f"bad{1 - h}"] * others >= 2 * x[f"n{1 - h}"] * flagged for x in best])
        heavy += (side == h) * np.bincount(r, weights=v * telling[c], minlength=len(rows_))
    inner = np.unique(np.quantile(heavy[toxic == 1], np.arange(1, grades) / grades))
    grade = np.where(toxic == 1, 1 + np.searchsorted(inner, heavy, side="left"), 0)
    grade = np.searchsorted(np.unique(grade), grade)
    w, cuts = _ordinal_fit(r, c, v, grade, len(index))
    return OrdinalModel({t: float(w[i]) for t, i in index.items()}, [float(x) for x in cuts])


def _scorer(model: OrdinalModel):
    """A function from texts (as UTF-8) to the sums of their weights; made once a task."""
    names = list(model.weights)
    weights = np.array([model.weights[t] for t in names])
    found = _Features({t: i for i, t in enumerate(names)})

    def total(texts: list[bytes]) -> np.ndarray:
        got = [found.of(t) for t in texts]
        owner = np.repeat(np.arange(len(got)), [len(c) for c in got])
        at = np.fromiter((i for c in got for i in c), dtype=np.int64, count=len(owner))
        times = np.fromiter((k for c in got for k in c.values()), dtype=np.float64, count=len(owner))
        return np.bincount(owner, weights=weights[at] * times, minlength=len(got))

    return total


def score(documents: DataFrame, model: OrdinalModel, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``columns``, severity, p_toxic, grade (the likeliest), rejected (P(grade >= 1) >= 0.5)."""
    if not model.weights:
        return documents.select(*columns, F.lit(0.0).alias("severity"), F.lit(0.0).alias("p_toxic"), F.lit(0).alias("grade"), F.lit(False).alias("rejected"))
    fields = {f.name: f.dataType.simpleString().replace("bigint", "long") for f in documents.select(*columns).schema}

    def start():
        total = _scorer(model)

        def run(cols):
            upper = model.at_least(total(cols["utf8"]))
            exact = -np.diff(np.concatenate([np.ones((len(upper), 1)), upper, np.zeros((len(upper), 1))], axis=1), axis=1)
            return {c: cols[c] for c in columns} | {"severity": upper.sum(axis=1), "p_toxic": upper[:, 0], "grade": exact.argmax(axis=1), "rejected": upper[:, 0] >= 0.5}

        return run

    schema = ", ".join([*(f"{k} {v}" for k, v in fields.items()), "severity double, p_toxic double, grade int, rejected boolean"])
    return map_columns(documents.select(*columns, utf8()), schema, start)


def reject(documents: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of ``documents`` that the model doesn't reject, with all their columns."""
    if not model.weights:
        return documents
    first = model.cuts[0]

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        total = _scorer(model)
        for texts in batches:
            yield pd.Series(np.concatenate([total([bytes(t) for t in texts.iloc[at : at + ROWS_AT_ONCE]]) < first for at in range(0, len(texts), ROWS_AT_ONCE)] or [np.zeros(0, dtype=bool)]))
        total = None
        give_back()

    return documents.where(clean(utf8()))
