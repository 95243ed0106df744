"""Exact search for the largest inner products by norm buckets.

Candidates are sorted by length and parted into buckets whose shortest vector has at least 0.9 of the
longest one's length. For a query that knows some k scores already, the least of them divided by its own
length and the bucket's greatest is a local cosine threshold: above 1 the bucket is left out; where it is
high, candidates must lie in a feasible range of the query's largest coordinates, found in sorted
coordinate lists; else only those long enough are taken. What is left is verified by exact products.

Queries (a stated set) meet all buckets in blocks; a first threshold comes from the ``HEAD`` longest
vectors, which are searched again with the rest, and tasks raise it as they go. Neither can lose a row:
pruning asks for a bound strictly below k scores that exist.

Edges: see ``vectors.whole_numbers`` for nulls, repeated ids and odd lengths; vectors of zeros score 0;
equal scores go to the smaller id; fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.blocks import BLOCK_ROWS, first_k, matrix, meet, pack, pack_queries

from .common import cut
from .vectors import best_of, products, whole_numbers

K = 5
#: A bucket's shortest vector against its longest.
RATIO = 0.9
#: Longest vectors that give the first thresholds.
HEAD = 1024
#: From this local cosine threshold on sorted coordinates are tried, on so many of the query's largest ones, and used if they leave at most this share.
COORDINATES_FROM, FOCUS, SHARE = 0.6, 4, 0.5
#: Queries whose products with a bucket are held at once.
AT_ONCE = 256
RESULT = "query_id long, vec_id long, score long"


def bucket_ends(table: pa.Table) -> list[int]:
    """Where a run of rows, longest first, is parted into buckets."""
    lengths, ends, begin = table["length"].to_numpy(), [], 0
    while begin < len(lengths):
        if lengths[begin] == 0:
            break
        begin += int(np.searchsorted(-lengths[begin:], -RATIO * lengths[begin], side="right"))
        ends.append(begin)
    return ends


class Bucket:
    """A bucket's vectors, longest first, with its sorted coordinates as they are asked for."""

    def __init__(self, table: pa.Table):
        self.ids, self.v, self.lengths = table["vec_id"].to_numpy(), matrix(table["v"], np.int64), table["length"].to_numpy()
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            unit = self.v[:, f] / np.maximum(self.lengths, 1e-300)
            order = np.argsort(unit, kind="stable")
            self.lists[f] = order, unit[order]
        return self.lists[f]

    def in_ranges(self, unit: np.ndarray, threshold: float) -> np.ndarray | None:
        """Rows whose coordinates allow the cosine ``threshold`` with the unit vector; None where that leaves too many."""
        width = min(len(unit), self.v.shape[1])
        focus = np.argsort(-np.abs(unit[:width]))[:FOCUS]
        ranges = []
        for f in focus:
            q = float(unit[f])
            spread = float(np.sqrt(max(0.0, 1 - q * q) * max(0.0, 1 - threshold * threshold)))
            order, values = self.sorted_coordinate(int(f))
            # angles: the coordinate's lies within the threshold's of the query's, which may take in the axis itself
            low = 0 if q <= -threshold else int(np.searchsorted(values, q * threshold - spread - 1e-9))
            high = len(values) if q >= threshold else int(np.searchsorted(values, q * threshold + spread + 1e-9, side="right"))
            ranges.append((low, high, order))
        ranges.sort(key=lambda r: r[1] - r[0])
        if not ranges or ranges[0][1] - ranges[0][0] > SHARE * len(self.ids):
            return None
        votes = np.zeros(len(self.ids), dtype=np.int8)
        for low, high, order in ranges:
            votes[order[low:high]] += 1
        return np.flatnonzero(votes == len(ranges))


class Search:
    """Keeps the ``k`` best rows of every query that a task has met."""

    #: Queries whose rows are kept; beyond it they are given out and begun anew.
    KEPT = 65_536

    def __init__(self, k: int):
        self.k, self.best, self.query_ids = k, {}, {}

    def add(self, number: int, queries: pa.Table, block: dict):
        if number not in self.best:
            if sum(map(len, self.query_ids.values())) + queries.num_rows > self.KEPT:
                yield from self.rest()
            self.query_ids[number] = queries["vec_id"].to_numpy()
            none = np.array([], dtype=np.int64)
            self.best[number] = none, none, none, np.array([np.nan if x is None else x for x in queries["floor"].to_pylist()], dtype=np.float64)
        if number not in getattr(self, "known", {}):
            self.known = {number: (matrix(queries["v"], np.int64), queries["length"].to_numpy())}
        self.meet(number, *self.known[number], Bucket(block["block"]))

    def meet(self, number: int, vectors: np.ndarray, lengths: np.ndarray, bucket: Bucket) -> None:
        ids, (rows, found, scores, floor) = self.query_ids[number], self.best[number]
        top = bucket.lengths[0] * lengths
        ratio = np.divide(floor, top, out=np.full_like(top, -np.inf), where=top > 0)
        # a product of length 0 is 0: it can be left out only where more is known
        threshold = np.where(np.isnan(floor), -np.inf, np.where(top > 0, ratio, np.where(floor > 0, np.inf, -np.inf)))
        alive = np.flatnonzero(threshold <= 1 + 1e-9)
        by_length, new = [], []
        for i in alive:
            if threshold[i] >= COORDINATES_FROM:
                near = bucket.in_ranges(vectors[i] / lengths[i], min(1.0, float(threshold[i]) * (1 - 1e-9)))
                if near is not None:
                    if len(near):
                        got = products(vectors[i : i + 1], bucket.v[near])[0]
                        keep = (got >= floor[i]) & (bucket.ids[near] != ids[i])
                        new.append((np.full(int(keep.sum()), i), bucket.ids[near][keep], got[keep].astype(np.int64)))
                    continue
            by_length.append(i)
        for at in range(0, len(by_length), AT_ONCE):
            some = np.array(by_length[at : at + AT_ONCE])
            needed = np.where(floor[some] > 0, floor[some] / np.maximum(lengths[some], 1e-300), 0.0)
            enough = int(np.searchsorted(-bucket.lengths, -float(np.nan_to_num(needed, nan=0.0).min()) * (1 - 1e-9), side="right"))
            by_id = np.argsort(bucket.ids[:enough], kind="stable")
            got = products(vectors[some], bucket.v[by_id])
            own = ids[some][:, None] == bucket.ids[by_id][None, :]
            if got.dtype == np.float64:
                got[own] = -np.inf
                i, j = first_k(got, self.k)
            else:  # longs that a double can't hold
                i, j = np.nonzero(~own)
                first = best_of(i, bucket.ids[by_id][j], got[i, j], self.k)
                i, j = i[first], j[first]
            new.append((some[i], bucket.ids[by_id][j], got[i, j].astype(np.int64)))
        if new:
            rows, found, scores = (np.concatenate([old, *(x[n] for x in new)]) for n, old in enumerate((rows, found, scores)))
            first = best_of(rows, found, scores, self.k)
            rows, found, scores = rows[first], found[first], scores[first]
            full = np.flatnonzero(np.bincount(rows, minlength=len(ids)) == self.k)
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, rows, scores)
            floor = floor.copy()
            floor[full] = np.fmax(floor[full], least[full].astype(np.float64))
            self.best[number] = rows, found, scores, floor

    def rest(self):
        for number, (rows, found, scores, _) in self.best.items():
            if len(rows):
                yield {"query_id": self.query_ids[number][rows], "vec_id": found, "score": scores}
        self.best, self.query_ids, self.known = {}, {}, {}


def top(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each query with their rank; Spark cuts each task's rows before they are shuffled."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(table: DataFrame, asked: Column, k: int = K, head: int = HEAD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of (vec_id, embedding) for which ``asked`` holds the ``k`` other rows of the largest products."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    rows = cut(whole_numbers(table).withColumn("length", length))
    spark, n = rows.sparkSession, rows.count()
    queries = rows.where(asked)
    floorless = pack_queries(queries.select("vec_id", "v", "length", F.lit(None).cast("long").alias("floor")))
    longest = cut(pack(rows.orderBy(F.desc("length"), "vec_id").limit(head).coalesce(1).sortWithinPartitions(F.desc("length"), "vec_id"), ends=bucket_ends))
    floors = top(meet(floorless, longest, lambda: Search(k), RESULT), k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    known = pack_queries(queries.join(floors.hint("merge"), "vec_id", "left").select("vec_id", "v", "length", "floor"))
    parts = max(1, -(-n // BLOCK_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // 1024)))
    buckets = cut(pack(rows.repartitionByRange(parts, F.desc("length"), F.col("vec_id")).sortWithinPartitions(F.desc("length"), "vec_id"), ends=bucket_ends))
    found = top(meet(known, buckets, lambda: Search(k), RESULT), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
