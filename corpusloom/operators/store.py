"""Collections of chunks as partitioned Parquet snapshots: writing, upserts, deletes, look-ups, catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pyspark.sql.utils import AnalysisException

from corpusloom.functions.filters import visible_to
from corpusloom.operators import tables
from corpusloom.operators.metadata import members

KEY = ("source", "chunk_index")


def chunk_id(source: Column, chunk_index: Column) -> Column:
    """An id that a chunk keeps from run to run."""
    return F.xxhash64(source, chunk_index)


def prepare_rows(chunks: DataFrame) -> DataFrame:
    """Ids, default groups and questions for chunks to store."""
    have = set(chunks.columns)
    group = F.coalesce(F.col("security_group"), F.array(F.lit("public"))) if "security_group" in have else F.array(F.lit("public"))
    questions = F.coalesce(F.col("benchmark_questions"), F.lit("[]")) if "benchmark_questions" in have else F.lit("[]")
    partition = F.coalesce(F.col("partition"), F.lit("default")) if "partition" in have else F.lit("default")
    return chunks.withColumns({"id": chunk_id(F.col("source"), F.col("chunk_index")), "security_group": group, "benchmark_questions": questions, "partition": partition})


def upsert(existing: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """``existing`` with every row of ``incoming`` in the place of its key; of several the last by ``order``, or without it the greatest by its columns."""
    by = [F.desc(order)] if order else [F.desc(c) for c in incoming.columns]
    last = incoming.withColumn("_nth", F.row_number().over(W.partitionBy(*KEY).orderBy(*by))).where("_nth = 1").drop("_nth")
    return existing.join(last.select(*KEY).hint("merge"), list(KEY), "left_anti").unionByName(last.select(*existing.columns))


def upsert_counts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(inserted, updated, total)."""
    flags = incoming.select(*KEY).distinct().join(existing.select(*KEY, F.lit(True).alias("old")).hint("merge"), list(KEY), "left")
    return flags.agg(F.count_if(F.col("old").isNull()).alias("inserted"), F.count_if(F.col("old")).alias("updated"), F.count("*").alias("total"))


def new_sources(documents: DataFrame, existing: DataFrame) -> DataFrame:
    """Documents whose source isn't stored."""
    return documents.join(existing.select("source").distinct().hint("merge"), "source", "left_anti")


def exists(keys: DataFrame, chunks: DataFrame) -> DataFrame:
    return keys.join(chunks.select(*KEY, F.lit(True).alias("_old")).distinct().hint("merge"), list(KEY), "left").withColumn("stored", F.coalesce("_old", F.lit(False))).drop("_old")


def get_chunk(chunks: DataFrame, id_: int, roles: list[str]) -> DataFrame:
    return chunks.where((F.col("id") == id_) & visible_to(roles))


def get_document(chunks: DataFrame, document_id: str, roles: list[str], limit: int = 10_000) -> DataFrame:
    return chunks.where((F.col("document_id") == document_id) & visible_to(roles)).orderBy("chunk_index").limit(limit)


def delete_chunks(chunks: DataFrame, ids: DataFrame, roles: list[str]) -> tuple[DataFrame, DataFrame]:
    """What is left, and (id, found): only chunks that the roles see are deleted."""
    seen = chunks.where(visible_to(roles)).select("id").join(ids.hint("merge"), "id", "left_semi").distinct()
    return chunks.join(seen.hint("merge"), "id", "left_anti"), ids.join(seen.withColumn("_hit", F.lit(True)).hint("merge"), "id", "left").select("id", F.coalesce("_hit", F.lit(False)).alias("found"))


def delete_documents(chunks: DataFrame, documents: DataFrame, roles: list[str]) -> tuple[DataFrame, DataFrame]:
    """What is left, and (document_id, deleted) counts."""
    gone = chunks.where(visible_to(roles)).join(documents.select("document_id").distinct().hint("merge"), "document_id", "left_semi")
    return chunks.join(gone.select("id").hint("merge"), "id", "left_anti"), gone.groupBy("document_id").agg(F.count("*").alias("deleted"))


def write_collection(chunks: DataFrame, path: str, recreate: bool = False) -> None:
    chunks.write.partitionBy("partition").mode("overwrite" if recreate else "errorifexists").parquet(path)


def load_collection(spark: SparkSession, path: str, partition: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if partition is None else df.where(F.col("partition") == partition)


def write_snapshot(chunks: DataFrame, root: str) -> str:
    """Write a new version under ``root`` and point to it; readers of the old one aren't disturbed."""
    name = uuid.uuid4().hex
    chunks.write.partitionBy("partition").parquet(f"{root}/{name}")
    chunks.sparkSession.createDataFrame([(name,)], "version string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{root}/versions")
    return name


def current_version(spark: SparkSession, root: str) -> str:
    """The name of the newest snapshot: one small table is read."""
    return spark.read.parquet(f"{root}/versions").orderBy(F.desc("at")).first()["version"]


def load_version(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{version}")


def load_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return load_version(spark, root, current_version(spark, root))


# --- collections in key buckets


class Conflict(RuntimeError):
    """Another writer has moved the collection on."""


#: Buckets of a collection; its sources are dealt to them by a hash.
BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("source"), F.lit(buckets)).cast("int")


def _claim(spark: SparkSession, root: str, version: int, buckets: int) -> None:
    """Take a version number, which only one writer can."""
    try:
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("errorifexists").parquet(f"{root}/versions/version={version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise Conflict(f"version {version} is taken") from e


def bucket_version(spark: SparkSession, root: str) -> tuple[int, int]:
    """The newest version of a bucketed collection and its number of buckets: one small table is read."""
    return tuple(spark.read.parquet(f"{root}/versions").agg(F.max(F.struct(F.col("version").cast("int"), "buckets")).alias("v")).select("v.*").first())


def create_buckets(chunks: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Write a collection by the bucket of its source, as version 1; a large bucket may have several files."""
    _claim(chunks.sparkSession, root, 1, buckets)
    chunks.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{root}/rows")


def load_buckets(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/rows").drop("bucket")


def upsert_buckets(incoming: DataFrame, root: str, order: str | None = None, seen: int | None = None) -> tuple[int, list[int]]:
    """Upsert into the buckets that ``incoming`` touches, and leave all other files as they are: the new version and those buckets.

    The version is claimed after the new rows are made and before any is put in place, so of two writers
    that began from one version the second gets ``Conflict`` and changes nothing; so does a caller whose
    ``seen`` version is no longer the newest. An update that fails halfway is run again.
    """
    spark = incoming.sparkSession
    version, buckets = bucket_version(spark, root)
    if seen is not None and seen != version:
        raise Conflict(f"version {seen} was read, {version} is stored")
    rows = tables.cut(incoming.withColumn("bucket", _bucket(buckets)))
    touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())  # as many as there are buckets
    if not touched:
        return version, touched
    stored = spark.read.parquet(f"{root}/rows").where(F.col("bucket").isin(touched))
    try:
        new = tables.cut(upsert(stored, rows, order))
    except Exception as e:  # files that another writer replaced can't be read any more
        if bucket_version(spark, root)[0] != version:
            raise Conflict(f"version {version} was replaced") from e
        raise
    _claim(spark, root, version + 1, buckets)
    new.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root}/rows")
    return version + 1, touched


def create_partition(spark: SparkSession, root: str, name: str) -> bool:
    """Name a partition of the collection at ``root``, which may stay empty; False if it is there already."""
    try:
        spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("errorifexists").parquet(f"{root}.partitions/partition={name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        return False
    return True


def partitions(spark: SparkSession, root: str) -> DataFrame:
    """(name) of the partitions that were created or hold rows."""
    found = None
    for path, column in ((f"{root}.partitions", "name"), (root, "partition")):
        try:
            some = spark.read.parquet(path).select(F.col(column).cast("string").alias("name"))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            continue
        found = some if found is None else found.unionByName(some)
    return spark.createDataFrame([], "name string") if found is None else found.distinct()


def describe_collections(chunks: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue rows with chunk, document and partition counts and the roles that their chunks ask for; no level means public."""
    counts = chunks.groupBy("collection").agg(F.count("*").alias("num_chunks"), F.countDistinct("document_id").alias("num_documents"), F.countDistinct("partition").alias("num_partitions"))
    roles = chunks.select("collection", F.explode("security_group").alias("g")).distinct().groupBy("collection").agg(F.array_sort(F.collect_list("g")).alias("required_roles"))
    joined = catalogue.join(counts.hint("merge"), "collection", "left").join(roles.hint("merge"), "collection", "left")
    return joined.withColumn("access_level", F.coalesce("access_level", F.lit("public"))).fillna(0, ["num_chunks", "num_documents", "num_partitions"])


def entity_counts(chunks: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Rows of each collection and, under a null name, of all; -1 for collections (``unreadable``) that can't be read."""
    counts = chunks.rollup("collection").agg(F.count("*").alias("entities"))
    return counts if unreadable is None else counts.unionByName(unreadable.select("collection", F.lit(-1).cast("long").alias("entities")))


def pipeline_catalogue(configs: DataFrame) -> DataFrame:
    """(name, description, metadata_schema, chunk_size, embedding_model, llm_model) of JSON configurations, by name."""
    get = lambda path, default: F.coalesce(F.get_json_object("config", path), F.lit(default))
    return configs.select("name", get("$.description", "").alias("description"), get("$.metadata_schema", "{}").alias("metadata_schema"), get("$.chunk_size", "0").cast("int").alias("chunk_size"), get("$.embedding_model", "").alias("embedding_model"), get("$.llm_model", "").alias("llm_model")).orderBy("name")


def collection_config(catalogue: DataFrame) -> DataFrame:
    """(collection, config): the stored configuration under either key, with this collection's name; null when it can't be read."""
    raw = F.coalesce(F.get_json_object("description", "$.collection_config"), F.get_json_object("description", "$.collection_config_json"))
    kept = F.map_filter(members(raw), lambda k, v: k != "collection_name")
    named = F.map_concat(kept, F.create_map(F.lit("collection_name"), F.parse_json(F.to_json(F.col("collection").cast("variant")))))
    return catalogue.select("collection", F.when(F.size(members(raw)) > 0, F.to_json(named)).alias("config"))
