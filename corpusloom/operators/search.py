"""Retrieval for tables of queries: exact and approximate vectors, BM25, and their fusion."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from corpusloom.functions.text import is_blank, tokens
from corpusloom.operators import postings, tables
from corpusloom.operators.blocks import matrix, meet, one_array, pack, pack_queries
from corpusloom.operators.conversation import last_user_message
from corpusloom.operators.cells import assign_cells, by_cell, fit_centres, one_cell
from corpusloom.operators.postings import K1, B

RRF_K = 100
#: Queries whose scores with a block are held at once.
AT_ONCE = 64


def top(ranked: DataFrame, k: int, *order: Column, by: list[str] = ("query_id",)) -> DataFrame:
    """The first ``k`` rows of each query, numbered by ``rank``."""
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


# --- vectors


def hash_vector(found: list[str], width: int) -> np.ndarray:
    """Signed token counts in hashed places, of length 1."""
    v = np.zeros(width, dtype=np.float64)
    for t in found:
        h = zlib.crc32(t.encode())
        v[h % width] += 1 if (h >> 16) & 1 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32)


def embed(rows: DataFrame, text: str = "text", fn=None, width: int = 256, out: str = "text_embedding") -> DataFrame:
    """``rows`` with a vector of ``text``: by ``fn`` (a Series of texts to a Series of lists), or hashed tokens."""

    @F.pandas_udf(ArrayType(FloatType()))
    def own(found: pd.Series) -> pd.Series:
        return found.map(lambda t: hash_vector(list(t), width))

    @F.pandas_udf(ArrayType(FloatType()))
    def given(texts: pd.Series) -> pd.Series:
        return fn(texts)

    return rows.withColumn(out, given(F.col(text)) if fn else own(tokens(F.col(text))))


class _Nearest:
    """The ``k`` nearest rows of each block to every query, but for those below the ``k``-th score that the task has met for it."""

    #: Queries whose best scores are kept at once, and pairs whose scores are computed at once.
    KEPT, PAIRS = 65_536, 4_096
    #: More than single-precision scores of unit vectors can be off.
    OFF = 1e-4

    def __init__(self, k: int, metric: str):
        self.k, self.metric, self.best = k, metric, {}

    def _exact(self, Q: np.ndarray, X: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        parts = [np.einsum("ij,ij->i", Q[i[n : n + self.PAIRS]], X[j[n : n + self.PAIRS]]) for n in range(0, len(i), self.PAIRS)]
        return np.concatenate([np.zeros(0), *parts])

    def add(self, number: int, queries: pa.Table, block: dict):
        ids, X, Q = one_array(block["block"]["id"]), matrix(block["block"]["v"]), matrix(queries["embedding"])
        names = one_array(queries["query_id"])
        by_id = pc.sort_indices(ids).to_numpy()
        width = max(X.shape[1], Q.shape[1])
        X, Q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (X[by_id], Q))
        if number not in self.best:
            if sum(map(len, self.best.values())) + len(Q) > self.KEPT:
                self.best = {}
            self.best[number] = np.full((len(Q), self.k), -np.inf)
        best, off = self.best[number], 0.0
        if self.metric == "cosine":
            X, Q = (np.divide(m, length, out=np.zeros_like(m), where=~(length <= 0)) for m in (X, Q) for length in [np.linalg.norm(m, axis=1, keepdims=True)])
            rough, off = X.astype(np.float32).T, self.OFF
        else:
            squares = (X**2).sum(1)[None, :]
        for at in range(0, len(Q), AT_ONCE):
            some, kept = Q[at : at + AT_ONCE], best[at : at + AT_ONCE]
            s = some.astype(np.float32) @ rough if off else -((some**2).sum(1)[:, None] - 2 * some @ X.T + squares)
            edge = kept.min(axis=1) if self.k else np.full(len(some), np.inf)
            if s.shape[1] > self.k and not (edge > -np.inf).all():
                low = np.where(np.isnan(s), -np.inf, s)
                edge = np.maximum(edge, np.partition(low, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k])
            i, j = np.nonzero(s >= (edge - 2 * off - 1e-9)[:, None])
            found = np.nan_to_num(np.round(self._exact(some, X, i, j) if off else s[i, j], 9), nan=-np.inf)
            order = np.lexsort((j, -found, i))
            i, j, found = i[order], j[order], found[order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            few = (nth < self.k) & (found > -np.inf)
            i, j, found, nth = i[few], j[few], found[few], nth[few]
            new = np.full(kept.shape, -np.inf)
            new[i, nth] = found
            kept[:] = -np.sort(-np.concatenate([kept, new], axis=1), axis=1)[:, : self.k]
            if self.k:
                held = found >= kept[i, -1]
                i, j, found = i[held], j[held], found[held]
            yield {"query_id": names.take(pa.array(at + i)), "id": ids.take(pa.array(by_id[j])), "s": found}

    def rest(self):
        yield from ()


def _nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str, id_: str, vector: str) -> DataFrame:
    """Query blocks meet vector blocks, each of which gives its ``k`` best; one read of the vectors, whatever the number of queries."""
    asked = pack_queries(queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding"))
    stored = pack(vectors.where(F.col(vector).isNotNull()).select(F.col(id_).alias("id"), F.col(vector).alias("v")))
    found = meet(asked, stored, lambda: _Nearest(k, metric), f"query_id {dict(queries.dtypes)['query_id']}, id {dict(vectors.dtypes)[id_]}, s double", written=False)
    return top(found, k, F.desc("s"), F.col("id"))


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, id_: str = "id", vector: str = "text_embedding") -> DataFrame:
    """(query_id, id, score, rank) by exact cosine; queries (query_id, embedding) without a vector give nothing."""
    return _nearest(queries, vectors, k, "cosine", id_, vector).withColumnRenamed("s", "score")


def l2_topk(queries: DataFrame, vectors: DataFrame, k: int, id_: str = "id", vector: str = "text_embedding") -> DataFrame:
    """(query_id, id, distance, rank) by squared Euclidean distance."""
    return _nearest(queries, vectors, k, "l2", id_, vector).select("query_id", "id", (-F.col("s")).alias("distance"), "rank")


def build_cells(vectors: DataFrame, cells: int, vector: str = "text_embedding", sample: int = 20_000, seed: int = 3):
    """``vectors`` with the cell of every row, and the centres; ``cells.write_cells`` stores such an index."""
    centres = fit_centres(vectors, cells, vector, sample, seed)
    return assign_cells(vectors, centres, 1, vector).withColumn("cell", F.col("cells")[0]).drop("cells"), centres


def approx_cosine_topk(queries: DataFrame, celled: DataFrame, centres: np.ndarray, k: int, nprobe: int = 10, id_: str = "id", vector: str = "text_embedding") -> DataFrame:
    """Cosine top-k among the rows of each query's ``nprobe`` nearest cells."""
    probes = assign_cells(queries.where(F.col("embedding").isNotNull()), centres, nprobe, "embedding").select("query_id", "embedding", F.explode("cells").alias("cell"))
    asked = tables.cut(pack(probes.repartition("cell").sortWithinPartitions("cell"), one_cell, "cell int", by_cell))
    stored = pack(celled.where(F.col("cell").isNotNull()).select(F.col(id_).alias("id"), F.col(vector).alias("v"), "cell").sortWithinPartitions("cell"), one_cell, "cell int", by_cell)
    found = meet(asked, stored, lambda: _Nearest(k, "cosine"), f"query_id {dict(queries.dtypes)['query_id']}, id {dict(celled.dtypes)[id_]}, s double", written=False, keys=["cell"])
    return top(found, k, F.desc("s"), F.col("id")).withColumnRenamed("s", "score")


# --- BM25


def build_postings(rows: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """(term, id, tf, dl).

    Texts are dealt by their ids and counted where they lie: a shuffle of texts is a fraction of one of their postings.
    """
    dealt = rows.select(F.col(id_).alias("id"), F.col(text).alias("t")).repartition("id")
    counted = dealt.select("id", tokens(F.col("t")).alias("t")).select("id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    return counted.groupBy("term", "id", "dl").agg(F.count("*").alias("tf")).select("term", "id", "tf", "dl")


def bm25_topk(queries: DataFrame, rows: DataFrame, k: int, id_: str = "id", text: str = "text", k1: float = K1, b: float = B, drop_ratio: float = 0.0) -> DataFrame:
    """(query_id, id, score, rank) over rows with unique ids: one tokenisation into ranges of asked terms, which are then searched; ``postings.build`` keeps such ranges for further searches."""
    terms = tables.cut(postings.query_terms(queries).select("term").distinct())
    return postings.search(queries, tables.cut(postings.build(rows, id_, text, terms)), k, k1, b, drop_ratio)


# --- fusion


def rrf_fuse(rankings: list[DataFrame], limit: int, k: int = RRF_K, by: list[str] = ("query_id",), key: str = "id") -> DataFrame:
    """Reciprocal-rank fusion of rankings (…by, key, rank): (…by, key, rrf_score, rank)."""
    every = None
    for r in rankings:
        part = r.select(*by, key, "rank")
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy(*by, key).agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("rrf_score"))
    return top(fused, limit, F.desc("rrf_score"), F.col(key), by=by)


def hybrid_search(queries: DataFrame, chunks: DataFrame, limit: int, *, per_list: int | None = None, where: Column | None = None, by: str = "query_id") -> DataFrame:
    """Dense, text and metadata rankings of each query text, cut at ``per_list`` and fused per ``by`` (several texts can share a request)."""
    seen = chunks if where is None else chunks.where(where)
    per = per_list or limit
    lists = []
    if "embedding" in queries.columns and "text_embedding" in chunks.columns:
        lists.append(cosine_topk(queries, seen, per))
    asked = queries.where(~is_blank(F.col("text")))
    lists.append(bm25_topk(asked, seen, per))
    if "metadata" in chunks.columns:
        lists.append(bm25_topk(asked, seen, per, text="metadata"))
    if by != "query_id":
        names = queries.select("query_id", by).distinct()
        lists = [r.join(names.hint("merge"), "query_id") for r in lists]
    return rrf_fuse(lists, limit, by=[by])


def search_partitions(queries: DataFrame, chunks: DataFrame, partitions: list[str], limit: int, per_partition: int | None = None) -> DataFrame:
    """One text ranking in each partition, fused by score over all of them."""
    found = None
    for p in partitions:
        part = bm25_topk(queries, chunks.where(F.col("partition") == p), per_partition or limit).withColumn("partition", F.lit(p))
        found = part if found is None else found.unionByName(part)
    fused = found.groupBy("query_id", "id").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("rrf_score"), F.max("score").alias("score"))
    return top(fused, limit, F.desc("rrf_score"), F.desc("score"), F.col("id"))


def dense_fusion(queries: DataFrame, vectors: DataFrame, limit: int = 10, by: str = "request_id", per_list: int | None = None) -> DataFrame:
    """Requests of several embedded queries, by their vectors alone: a ranking for each query, fused per request."""
    ranked = cosine_topk(queries, vectors, per_list or limit).join(queries.select("query_id", by).distinct().hint("merge"), "query_id")
    return rrf_fuse([ranked], limit, by=[by])


def search_collections(queries: DataFrame, chunks: DataFrame, collections: list[str], first: int, final: int) -> DataFrame:
    """``first`` fused hits in each collection, then the ``final`` best over all by a second fusion: (query_id, id, rrf_score, rank)."""
    lists = [hybrid_search(queries, chunks.where(F.col("collection") == c), first) for c in collections]
    return rrf_fuse(lists, final)


def dispatch(queries: DataFrame, chunks: DataFrame, limit: int, search=None) -> DataFrame:
    """Queries (query_id, text, partition): ranked by ``search`` where there is a text; without one, the first chunks of the wanted partition; without either, nothing."""
    columns = ("query_id", "id", "score", "rank")
    blank = is_blank(F.col("text"))
    ranked = (search or bm25_topk)(queries.where(~blank).select("query_id", "text"), chunks, limit).select(*columns)
    heads = chunks.where("chunk_index = 0").select("partition", "id").withColumn("rank", F.row_number().over(W.partitionBy("partition").orderBy("id"))).where(F.col("rank") <= limit)
    listed = queries.where(blank & F.col("partition").isNotNull()).select("query_id", "partition").join(heads.hint("merge"), "partition").select("query_id", "id", F.lit(0.0).alias("score"), "rank")
    return ranked.unionByName(listed)


def first_query(texts: Column) -> Column:
    """The first text that isn't blank."""
    return F.element_at(F.filter(texts, lambda t: ~is_blank(t)), 1)


def answered_with_fallback(queries: DataFrame, hits: DataFrame, again) -> DataFrame:
    """``hits``, and ``again(queries without a hit)`` for the others."""
    left = queries.join(hits.select("query_id").distinct().hint("merge"), "query_id", "left_anti")
    return hits.unionByName(again(left), allowMissingColumns=True)


def expanded_where_thin(queries: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """Variants of queries that have fewer than max(3, limit / 2) hits."""
    counts = queries.join(hits.groupBy("query_id").count().hint("merge"), "query_id", "left").where(F.coalesce("count", F.lit(0)) < max(3, limit // 2))
    return counts.select("query_id", F.explode(F.array("text", F.concat("text", F.lit(" example")), F.concat("text", F.lit(" usage")))).alias("text"))


def refined(queries: DataFrame, hits: DataFrame, chunks: DataFrame, limit: int, partitions: list[str], more: list[str]) -> DataFrame:
    """``hits`` (query_id, id, score) and, for queries with too few, those of a second search: the query and its variants over ``partitions`` and ``more``; each row once with its best score, the first ``limit`` by ``rank``."""
    variants = tables.cut(expanded_where_thin(queries, hits, limit).withColumn("asked", F.col("query_id")).withColumn("query_id", F.concat_ws("/", "asked", F.xxhash64("text"))))
    again = search_partitions(variants.select("query_id", "text"), chunks, list(dict.fromkeys([*partitions, *more])), limit)
    named = again.join(variants.select("query_id", "asked").distinct().hint("merge"), "query_id").select(F.col("asked").alias("query_id"), "id", "score")
    best = hits.select("query_id", "id", "score").unionByName(named).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return top(best, limit, F.desc("score"), F.col("id"))


def search_conversations(messages: DataFrame, chunks: DataFrame, limit: int = 10, embed_text=None, **options) -> DataFrame:
    """(query_id, id, rrf_score, rank): the last user message of each conversation as the query of a hybrid search; ``embed_text`` gives (query_id, text) a vector."""
    asked = last_user_message(messages).withColumnRenamed("conv_id", "query_id")
    return hybrid_search(embed_text(asked) if embed_text else asked, chunks, limit, **options)


def legacy_score(distance: Column) -> Column:
    return F.when(distance <= 1, 1 - distance).otherwise(F.lit(0.0))


def dedupe_first(hits: DataFrame, order: Column, key: list[str] = ("source", "chunk_index")) -> DataFrame:
    return hits.withColumn("_nth", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("_nth = 1").drop("_nth")


def dedupe_best(hits: DataFrame, key: list[str] = ("id",), distance: str = "distance") -> DataFrame:
    return hits.groupBy(*key).agg(F.min_by(F.struct("*"), F.struct(distance, *hits.columns)).alias("_best")).select("_best.*")
