"""Vectors of whole numbers and their exact inner products, for the searches over ``embeddings``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = np.iinfo(np.int64)


def whole_numbers(table: DataFrame, *others: str) -> DataFrame:
    """(vec_id, others, v): each component x as floor(256 * x), a long; beyond a long's range it is held at its end.

    Rows with a null id, a null vector or a null or non-finite component are left out, as are rows with
    a null among ``others``. Of several rows with one id the least counts. Vectors may differ in length;
    what a shorter one lacks counts as zero.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    usable = table.select(F.col("vec_id").cast("long").alias("vec_id"), *others, "embedding").dropna().where(~bad)
    v = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    return usable.select("vec_id", *others, v.alias("v")).groupBy("vec_id").agg(F.min(F.struct(*others, "v")).alias("_row")).select("vec_id", "_row.*")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``: in doubles where no sum leaves their whole numbers, else in longs, else in Python's integers, held at a long's ends."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))
    most = max(1, width) * _most(a) * _most(b)
    if most < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    if most <= LONG.max:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -LONG.max, LONG.max).astype(np.int64)


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


#: Bounds are doubles, products exact: a bound counts as a little larger than it came out.
def above(bound):
    return bound + np.abs(bound) * 1e-9 + 1e-6


def best_of(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` entries of each row number, by score and then by the smaller id."""
    order = np.lexsort((ids, -scores, rows))
    sorted_rows = rows[order]
    begins = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]]) if len(order) else np.array([], dtype=np.int64)
    sizes = np.diff(np.r_[begins, len(order)])
    return order[np.arange(len(order)) - np.repeat(begins, sizes) < k]
