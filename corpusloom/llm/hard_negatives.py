"""Hard negatives from an inverted multi-index.

Two codebooks, one for each half of the components, are fitted on a bounded sample (``SAMPLE`` rows by
a hash of their id); every row is filed under its nearest codeword in either half, so that pairs of
codewords form cells. The rows lie in parts; each keeps the radius of every codeword among its own rows.
For an anchor a codeword's half-score is at most its product with the anchor's half plus the radius times
that half's length; a heap visits pairs of codewords by the sum of these bounds, the multi-sequence way.
A visit ends when the next bound is below what every window still needs: all rows that could be among
its first have then been scored, exactly. So the index decides the order and the end, never the result.

A first search finds each anchor's positives, a second one the negatives inside their windows.

Edges: see ``vectors.whole_numbers`` for nulls, repeated ids and odd lengths; labels outside 0 to 9 stay
labels of their own; anchors without a positive give no row; a positive without a fitting negative gives
none; equal scores go to the smaller id; an empty table gives none.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.blocks import BLOCK_ROWS, matrix, meet, pack, pack_queries

from .common import cut
from .vectors import above, best_of, products, whole_numbers

#: Rows on which the codebooks are fitted, codewords of each half, rounds of fitting.
SAMPLE, CODEWORDS, ROUNDS = 8_192, 32, 8
POSITIVES, NEGATIVES = 5, 10
#: The window of a negative's score in hundredths of its positive's.
LOW, HIGH = 30, 90
#: Rows that a visit scores before it first looks at its windows; twice as many each time.
FIRST_VISIT = 128


def codebook(half: np.ndarray, n: int = CODEWORDS) -> np.ndarray:
    """Up to ``n`` centres by k-means from evenly spread rows in the order of their first components."""
    if not half.size:
        return np.zeros((1, half.shape[1]))
    distinct = np.unique(half, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(n, len(distinct))).astype(int)]
    for _ in range(ROUNDS):
        of = nearest(half, centres)
        sums, sizes = np.zeros_like(centres), np.bincount(of, minlength=len(centres))
        np.add.at(sums, of, half)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def nearest(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * half @ centres.T, axis=1)


def halves(v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves in doubles; components past ``width`` belong to the second."""
    v = np.pad(v, ((0, 0), (0, max(0, width - v.shape[1])))).astype(np.float64)
    return v[:, : width // 2], v[:, width // 2 :]


def fit(rows: DataFrame, sample: int = SAMPLE) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of components and the two codebooks."""
    some = rows.select("v").orderBy(F.xxhash64("vec_id")).limit(sample).toArrow()
    v = matrix(some["v"], np.int64)
    width = v.shape[1]
    first, second = halves(v, width)
    return width, codebook(first), codebook(second)


def filed(table: pa.Table, width: int, books: tuple[np.ndarray, np.ndarray]) -> dict:
    """A part of the index: its rows by cell, the codewords they use and their radii."""
    v = matrix(table["v"], np.int64)
    both = halves(v, width)
    books = [np.pad(b, ((0, 0), (0, h.shape[1] - b.shape[1]))) for b, h in zip(books, both)]
    codes = [nearest(h, b) for h, b in zip(both, books)]
    radii = []
    for h, b, of in zip(both, books, codes):
        r = np.zeros(len(b))
        np.maximum.at(r, of, np.sqrt(((h - b[of]) ** 2).sum(1)))
        radii.append(r)
    order = np.lexsort((codes[1], codes[0]))
    cells = (codes[0] * len(books[1]) + codes[1])[order]
    return {"block": table.take(pa.array(order)), "cells": cells.tolist(), "radii1": radii[0].tolist(), "radii2": radii[1].tolist()}


class Part:
    """A part of the index, ready for visits."""

    def __init__(self, block: dict, width: int, books: tuple[np.ndarray, np.ndarray]):
        table = block["block"]
        self.ids, self.labels, self.v = table["vec_id"].to_numpy(), table["label"].to_numpy(), matrix(table["v"], np.int64)
        cells, n = np.array(block["cells"], dtype=np.int64), len(books[1])
        names, begins = np.unique(cells, return_index=True)
        self.spans = {divmod(int(c), n): (int(b), int(e)) for c, b, e in zip(names, begins, [*begins[1:], len(cells)])}
        wide = max(width, self.v.shape[1])
        self.width, self.books = width, books
        self.used = [np.unique(names // n), np.unique(names % n)]
        self.radii = [np.array(block["radii1"])[self.used[0]], np.array(block["radii2"])[self.used[1]]]
        self.wide = wide

    def bounds(self, anchors: np.ndarray) -> list[np.ndarray]:
        """For either half the greatest half-score of each anchor with a row under each codeword."""
        anchors = np.pad(anchors, ((0, 0), (0, max(0, self.wide - anchors.shape[1]))))
        out = []
        for half, book, used, radius in zip(halves(anchors, self.width), self.books, self.used, self.radii):
            words = np.pad(book[used], ((0, 0), (0, max(0, half.shape[1] - book.shape[1]))))
            out.append(half @ words.T + np.sqrt((half**2).sum(1))[:, None] * radius)
        return out

    def visit(self, first: np.ndarray, second: np.ndarray):
        """Yield places of rows with a bound on all that come later, in growing batches; a heap over both sorted lists gives the cells."""
        one, two = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        u, v = first[one].tolist(), second[two].tolist()
        one, two = self.used[0][one].tolist(), self.used[1][two].tolist()
        heap, found, many, most = [(-(u[0] + v[0]), 0, 0)], [], 0, FIRST_VISIT
        while heap:
            _, i, j = heapq.heappop(heap)
            if j == 0 and i + 1 < len(u):  # a row of cells begins when the one above it has
                heapq.heappush(heap, (-(u[i + 1] + v[0]), i + 1, 0))
            if j + 1 < len(v):
                heapq.heappush(heap, (-(u[i] + v[j + 1]), i, j + 1))
            span = self.spans.get((one[i], two[j]))
            if span:
                found.append(span)
                many += span[1] - span[0]
                if many >= most and heap:
                    yield np.concatenate([np.arange(*s) for s in found]), above(-heap[0][0])
                    found, many, most = [], 0, 2 * most
        if found:
            yield np.concatenate([np.arange(*s) for s in found]), -np.inf


class Visits:
    """Visits of the anchors of one search, with the best rows of each window so far. A window: row, low, high, k; ``same`` says whose label counts."""

    KEPT = 65_536

    def __init__(self, width: int, books: tuple[np.ndarray, np.ndarray], same: bool, k: int):
        self.width, self.books, self.same, self.k, self.kept = width, books, same, k, {}

    def windows(self, queries: pa.Table) -> list[list[tuple[int, float, float]]]:
        """(positive id, least, greatest score) of each anchor."""
        if self.same:
            return [[(0, -np.inf, np.inf)]] * queries.num_rows
        pairs = zip(queries["positive_ids"].to_pylist(), queries["positive_scores"].to_pylist())
        return [[(i, -(-LOW * s // 100), HIGH * s // 100) for i, s in zip(ids, scores)] for ids, scores in pairs]

    def add(self, number: int, queries: pa.Table, block: dict):
        if number not in self.kept:
            if sum(len(x) for x in self.kept.values()) + queries.num_rows > self.KEPT:
                yield from self.rest()
            none = np.array([], dtype=np.int64)
            self.kept[number] = [[(none, none)] * len(w) for w in self.windows(queries)]
        part = Part(block, self.width, self.books)
        ids, labels, v = queries["vec_id"].to_numpy(), queries["label"].to_numpy(), matrix(queries["v"], np.int64)
        self.names = getattr(self, "names", {}) | {number: (ids, queries)}
        first, second = part.bounds(v)
        for n, windows in enumerate(self.windows(queries)):
            best = self.kept[number][n]
            for places, bound in part.visit(first[n], second[n]):
                fits = (part.labels[places] == labels[n]) == self.same
                fits &= part.ids[places] != ids[n]
                places = places[fits]
                scores = products(v[n : n + 1], part.v[places])[0].astype(np.int64)
                done = True
                for w, (_, low, high) in enumerate(windows):
                    inside = (scores >= low) & (scores <= high)
                    if inside.any():
                        best[w] = self.merge(best[w], part.ids[places][inside], scores[inside])
                    full = len(best[w][0]) == self.k
                    done &= bound < (max(low, int(best[w][1][-1])) if full else low)
                if done:
                    break

    def merge(self, old: tuple[np.ndarray, np.ndarray], ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, scores = np.concatenate([old[0], ids]), np.concatenate([old[1], scores])
        first = best_of(np.zeros(len(ids), dtype=np.int8), ids, scores, self.k)
        return ids[first], scores[first]

    def rest(self):
        for number, kept in self.kept.items():
            ids, queries = self.names[number]
            rows = [(int(ids[n]), p, i, s) for n, (windows, best) in enumerate(zip(self.windows(queries), kept)) for (p, _, _), (found, scores) in zip(windows, best) for i, s in zip(found.tolist(), scores.tolist())]
            if rows:
                yield dict(zip(("anchor_id", "positive_id", "vec_id", "score"), map(list, zip(*rows))))
        self.kept, self.names = {}, {}


RESULT = "anchor_id long, positive_id long, vec_id long, score long"


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows (vec_id, label, v) of whole numbers, one of each id."""
    n = rows.count()
    width, *books = fit(rows, sample)
    books = tuple(books)
    few = min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // 1024))
    index = cut(pack(rows.select("vec_id", "label", "v").repartition(max(1, -(-n // BLOCK_ROWS), few)), lambda t: filed(t, width, books), "cells array<long>, radii1 array<double>, radii2 array<double>"))
    asked = rows.where(anchors).select("vec_id", "label", "v")
    found = meet(pack_queries(asked), index, lambda: Visits(width, books, True, positives), RESULT)
    first = cut(_first(found, ["anchor_id"], positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    pairs = F.array_sort(F.collect_list(F.struct("positive_id", "positive_score")))  # ``positives`` at most
    listed = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(pairs.alias("pairs")).select("vec_id", F.col("pairs.positive_id").alias("positive_ids"), F.col("pairs.positive_score").alias("positive_scores"))
    wanted = pack_queries(asked.join(listed.hint("merge"), "vec_id"))
    within = meet(wanted, index, lambda: Visits(width, books, False, negatives), RESULT)
    ranked = _first(within, ["anchor_id", "positive_id"], negatives)
    joined = ranked.join(first.hint("merge"), ["anchor_id", "positive_id"])
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def prepared(table: DataFrame) -> DataFrame:
    """``embeddings`` as rows for ``mine``: whole numbers, the label moved on by one where the id is divisible by 7."""
    rows = whole_numbers(table, "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return cut(rows.select("vec_id", label.cast("long").alias("label"), "v"))
