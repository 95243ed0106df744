"""Files to documents, record files to texts, stages kept on disk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# The fields of each kind of record, the label of each in the text, and the source they are filed under.
RECORDS = {
    "learn": ({"Subject": "subject", "Description": "description", "URL": "url"}, "tags", "learn.json"),
    "docs": ({"Subject": "subject", "Description": "description", "Path": "path"}, "tags", "docs.json"),
    "qa": ({"Question": "question", "Answer": "answer", "Context": "context"}, "users", "qa.json"),
}


def discover_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, modificationTime, length, content) of a file, a folder and all below it, or a list; nothing for a missing path."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_documents(spark: SparkSession, paths: str | list[str], groups: tuple[str, ...] = ("public",)) -> DataFrame:
    """A row per file: document_id (a digest of its source, the same in every run), source, content, security_group."""
    files = discover_files(spark, paths)
    return files.select(F.sha2("path", 256).alias("document_id"), F.col("path").alias("source"), "content", F.array(*map(F.lit, groups)).alias("security_group"))


def read_json_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(text, metadata) of the records of a JSON array file."""
    labels, listed, source = RECORDS[kind]
    fields = [*labels.values(), *(["time"] if kind == "qa" else [])]
    rows = spark.read.schema(", ".join([*(f"`{f}` string" for f in fields), f"`{listed}` array<string>"])).json(path, multiLine=True)
    text = F.concat_ws("\n\n", *[F.concat(F.lit(f"{n}: "), F.coalesce(f, F.lit(""))) for n, f in labels.items()])
    meta = F.struct(*[F.coalesce(f, F.lit("")).alias(f) for f in fields], F.coalesce(listed, F.array().cast("array<string>")).alias(listed), F.lit(kind).alias("data_type"), F.lit(source).alias("source"))
    return rows.select(text.alias("text"), F.to_json(meta).alias("metadata"))


def checkpoint_stage(documents: DataFrame, path: str, stage: Callable[[DataFrame], DataFrame], key: str = "document_id") -> DataFrame:
    """``stage`` over the documents that ``path`` doesn't hold yet, added there; gives all that it holds."""
    spark = documents.sparkSession
    try:
        done = spark.read.parquet(path)
        todo = documents.join(done.select(key).hint("merge"), key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        todo = documents
    stage(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def ingest_stages(documents: DataFrame, convert: Callable[[DataFrame], DataFrame], extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Raw rows go through both stages; rows with Markdown skip the first, rows with metadata the second."""
    converted = documents.where("markdown is not null").unionByName(convert(documents.where("markdown is null")), allowMissingColumns=True)
    return converted.where("metadata is not null").unionByName(extract(converted.where("metadata is null")), allowMissingColumns=True)


def preview(documents: DataFrame, convert: Callable[[DataFrame], DataFrame], extract: Callable[[DataFrame], DataFrame], chunk: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What an ingest would store, chunk by chunk; nothing is written."""
    return chunk(ingest_stages(documents, convert, extract).withColumnRenamed("markdown", "text").where("text is not null"))
