"""Sharding by proportional stratified interleaving.

Rows get a seeded shuffle key and are ranked by it within their source; sorted by the fractional
rank (rank - 1/2) / size of the source they interleave so that every stretch holds the sources in
proportion. Equal cuts of that order are the shards, so ``rows`` is the law: row counts differ by
one at most. Ranks are counted in range partitions with offsets between them, so no source, however
large, meets in one task.

Defined results: a null text has no bytes and the checksum 0; a null source counts with the empty
one; repeated rows and null doc_ids take a place each; an empty table gives no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

SHARDS = 40
SEED = 20_250


def _ranked(rows: DataFrame, order: list[str], within: list[str], rank: str, size: str) -> DataFrame:
    """``rows`` with their ``rank`` from 1 by ``order``, whose first columns are ``within``, among the ``size`` rows that agree in those."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part", *within).agg(F.count("*").alias("here"))  # a few rows for each range partition
    before = W.partitionBy(*within).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("part", *within, F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(W.partitionBy(*within)).alias(size))
    local = dealt.withColumn("local", F.row_number().over(W.partitionBy("part", *within).orderBy(*order)))
    # the rows of a large group lie in many parts, so no key is hot
    return local.join(offsets.hint("merge"), ["part", *within]).withColumn(rank, F.col("before") + F.col("local")).drop("part", "before", "local")


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def assign(documents: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and source per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    small = cut(documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), _size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(F.lit(seed), "doc_id", text).alias("draw")))
    placed = _ranked(small, ["source", "draw", "doc_id"], ["source"], "rank", "n").withColumn("place", (F.col("rank") - 0.5) / F.col("n")).drop("rank", "n")
    total = small.count()
    # one group for the whole order, and a constant that leads it
    at = _ranked(placed.withColumn("all", F.lit(0)), ["all", "place", "source", "draw", "doc_id"], ["all"], "position", "rows")
    at = at.withColumn("position", F.col("position") - 1)
    shard = F.expr(f"position * {shards} div {max(1, total)}")
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return at.withColumn("shard", shard).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), (F.col("position") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source")
