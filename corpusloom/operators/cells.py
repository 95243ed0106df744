"""Approximate cosine search over a stored table of cells.

Centres come from k-means on a bounded sample; every vector is filed in its ``COPIES`` nearest cells, so
that a query near a border finds it in one of few cells. The table is partitioned by cell: a search lists
the files of the cells that its queries probe and no others. It first compares short codes (one signed
byte a component), then reads the vectors of the best candidates and ranks them exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators import tables
from corpusloom.operators.blocks import first_k, matrix, meet, one_array, pack

CELLS, COPIES, SAMPLE, SEED = 64, 3, 20_000, 3
#: Candidates of the first pass for each wanted row.
CANDIDATES = 4


def fit_centres(vectors: DataFrame, cells: int, vector: str = "text_embedding", sample: int = SAMPLE, seed: int = SEED) -> np.ndarray:
    """Centres by k-means over a bounded sample of the vectors, by cosine."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    chosen = tables.cut(vectors.where(F.exists(vector, lambda x: x != 0)).select(vector).orderBy(F.xxhash64(vector)).limit(sample))  # zeros have no direction
    if chosen.isEmpty():
        return np.zeros((1, 1))
    model = KMeans(k=cells, seed=seed, featuresCol="features", distanceMeasure="cosine").fit(chosen.select(array_to_vector(F.col(vector)).alias("features")))
    return np.array(model.clusterCenters())


def assign_cells(rows: DataFrame, centres: np.ndarray, n: int, vector: str) -> DataFrame:
    """``rows`` with the ``n`` nearest ``cells`` of each vector, nearest first."""

    @F.pandas_udf("array<int>")
    def nearest(vs: pd.Series) -> pd.Series:
        C = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
        return vs.map(lambda v: None if v is None else np.argsort(-(C @ np.asarray(v, dtype=np.float64)), kind="stable")[:n].astype(np.int32))

    return rows.withColumn("cells", nearest(F.col(vector)))


def _code(vector: str):
    @F.pandas_udf("binary")
    def code(vs: pd.Series) -> pd.Series:
        def one(v):
            x = np.asarray(v, dtype=np.float64)
            most = np.abs(x).max(initial=0)
            return np.round(x * (127 / most) if most else x).astype(np.int8).tobytes()

        return vs.map(lambda v: None if v is None else one(v))

    return code(F.col(vector))


def write_cells(vectors: DataFrame, root: str, cells: int = CELLS, copies: int = COPIES, id_: str = "id", vector: str = "text_embedding") -> None:
    """Write the index of (id, vector) under ``root``; rows without a vector are left out."""
    spark, usable = vectors.sparkSession, vectors.where(F.col(vector).isNotNull()).select(F.col(id_).alias("id"), F.col(vector).alias("vector"))
    centres = fit_centres(usable, cells, "vector")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{root}/centres")
    filed = assign_cells(usable, centres, copies, "vector").withColumn("code", _code("vector"))
    # the vector stands once, in the nearest cell; the code in every one
    each = filed.select("id", "vector", "code", "cells", F.posexplode("cells").alias("nth", "cell"))
    each = each.select("id", F.when(F.col("nth") == 0, F.col("vector")).alias("vector"), "code", F.col("cells")[0].alias("home"), "cell")
    each.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{root}/cells")


class _FirstPass:
    """The ``k`` best rows of each block to every query that probes its cell, by their codes."""

    #: Queries whose scores with a block are held at once.
    AT_ONCE = 64

    def __init__(self, k: int):
        self.k = k

    def add(self, number: int, queries: pa.Table, block: dict):
        table = block["block"]
        codes = [np.frombuffer(c, dtype=np.int8) for c in table["code"].to_pylist()]
        X, Q = np.zeros((len(codes), max(map(len, codes))), dtype=np.float64), matrix(queries["q"])
        for n, c in enumerate(codes):
            X[n, : len(c)] = c
        width = max(X.shape[1], Q.shape[1])
        X, Q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (X, Q))
        X = (X / np.maximum(np.linalg.norm(X, axis=1, keepdims=True), 1e-300)).T
        names, ids, homes = one_array(queries["query_id"]), one_array(table["id"]), one_array(table["home"])
        for at in range(0, len(Q), self.AT_ONCE):
            s = Q[at : at + self.AT_ONCE] @ X
            i, j = first_k(s, self.k)
            yield {"query_id": names.take(pa.array(at + i)), "id": ids.take(pa.array(j)), "home": homes.take(pa.array(j)), "s": s[i, j]}

    def rest(self):
        yield from ()


def by_cell(table: pa.Table) -> list[int]:
    return (np.flatnonzero(np.diff(table["cell"].to_numpy())) + 1).tolist()


def one_cell(part: pa.Table) -> dict:
    return {"cell": part["cell"][0].as_py()}


def search_cells(queries: DataFrame, root: str, k: int, nprobe: int | None = None, candidates: int = CANDIDATES) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` rows of greatest cosine that the ``nprobe`` nearest cells of each query hold; a quarter of all cells if it isn't given."""
    spark = queries.sparkSession
    centres = np.array([r["centre"] for r in spark.read.parquet(f"{root}/centres").orderBy("cell").collect()])  # as many as there are cells
    stored = spark.read.parquet(f"{root}/cells")
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").alias("q"))
    probes = tables.cut(assign_cells(asked, centres, nprobe or -(-len(centres) // 4), "q").select("query_id", "q", F.explode("cells").alias("cell")))
    wanted = [r[0] for r in probes.select("cell").distinct().collect()]
    probing = tables.cut(pack(probes.repartition("cell").sortWithinPartitions("cell", "query_id"), one_cell, "cell int", by_cell))
    blocks = pack(stored.where(F.col("cell").isin(wanted)).select("id", "code", "home", F.col("cell").cast("int").alias("cell")), one_cell, "cell int", by_cell)
    kinds = dict(queries.dtypes)["query_id"], dict(stored.dtypes)["id"]
    first = meet(probing, blocks, lambda: _FirstPass(k * candidates), f"query_id {kinds[0]}, id {kinds[1]}, home int, s double", written=False, keys=["cell"])
    once = first.groupBy("query_id", "id", "home").agg(F.max("s").alias("s"))
    best = tables.cut(once.withColumn("_nth", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("s"), "id"))).where(F.col("_nth") <= k * candidates).select("query_id", "id", "home"))
    homes = [r[0] for r in best.select("home").distinct().collect()]
    vectors = stored.where(F.col("cell").isin(homes) & F.col("vector").isNotNull()).select("id", "vector")
    near = vectors.join(best.hint(tables.strategy(best)), "id").join(asked.hint("merge"), "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    lengths = F.sqrt(dot(F.col("q"), F.col("q")) * dot(F.col("vector"), F.col("vector")))
    scored = near.select("query_id", "id", F.round(F.when(lengths > 0, dot(F.col("q"), F.col("vector")) / lengths).otherwise(0.0), 9).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the share of the exact rows that a search found."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")).hint("merge"), ["query_id", "id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))

