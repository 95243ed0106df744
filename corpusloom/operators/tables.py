"""Intermediate tables in the cluster's shared folder, and joins whose strategy follows measured bytes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the cluster's ``spark.checkpoint.dir``; where it is unset the warehouse, or on a single machine a temporary folder."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):  # driver and tasks are one process here
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
        return spark.sparkContext.getCheckpointDir()
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/corpusloom-intermediate"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there: no recomputation, no lost blocks."""
    return cut_at(df)[0]


#: How tables are written whose rows can be megabytes: Parquet asks for the size of a row group at every row first, not after 100, and ends it at 8 MB, so neither a writer nor a reader's batch, which never crosses a row group, holds more than that and a row.
WIDE_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1}

#: Spark's setting to delete an execution's shuffle files when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``cut``, with the path, so that ``forget`` can delete what a later round replaces.

    Later steps read the written table, so the shuffle files behind it go at once, not when the driver next collects garbage.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/corpusloom-{uuid.uuid4().hex}"
    given = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.options(**WIDE_ROWS).parquet(path)
    finally:
        if given is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, given)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of an Arrow batch, which the executor and its worker both hold; a single longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit on an Arrow batch to ``BATCH_BYTES``, so that no task holds its whole partition of long rows at once; a limit given with a unit such as ``8m`` is the user's and stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(key).removesuffix("b")
    if given.isdigit() and int(given) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


#: Measured bytes of a table that may be broadcast.
BROADCAST_BYTES = 16 << 20


def _width(column: Column, kind: DataType) -> Column:
    """Bytes that a value holds, with some for its place."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, MapType):
        return _width(F.map_keys(column), ArrayType(kind.keyType)) + _width(F.map_values(column), ArrayType(kind.valueType))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType | BinaryType | StructType | MapType | ArrayType):
            return F.aggregate(F.coalesce(column, F.array().cast(kind)), F.lit(16).cast("long"), lambda total, x: total + _width(x, kind.elementType))
        return F.coalesce(F.size(column), F.lit(0)) * 8 + 16
    return F.lit(8)


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and bytes of all its values, by one pass over it."""
    return tuple(map(int, df.agg(F.count("*"), F.coalesce(F.sum(sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16)).cast("long")), F.lit(0))).first()))


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all values of ``df``."""
    return measured(df)[1]


def strategy(few: DataFrame) -> str:
    """The join hint for a written table, by its measured bytes."""
    return "broadcast" if measured_bytes(few) <= BROADCAST_BYTES else "merge"


def join_few(big: DataFrame, few: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join ``big`` with rows whose bytes are measured first: broadcast up to ``BROADCAST_BYTES``, else a sort-merge join, which spills."""
    few = cut(few)
    return big.join(few.hint(strategy(few)), on, how)


def dealt_out(rows: DataFrame) -> DataFrame:
    """``rows`` of fewer files than there are cores in as many partitions as cores: a small file is often a single block, which one task would read and work on alone."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 0 < len(rows.inputFiles()) < cores else rows


def unused(name: str, columns: list[str]) -> str:
    """``name``, longer if ``columns`` has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
