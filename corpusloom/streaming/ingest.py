"""Structured Streaming: documents into a collection as they come, and questions answered from one."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from corpusloom.operators import postings
from corpusloom.operators.chunking import chunk_text
from corpusloom.operators.store import current_version, load_version, prepare_rows
from corpusloom.operators.tables import unused

#: Where Spark keeps the keys of a stateful query: on disk, not in the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


#: Groups of sources that the state of a stream is kept by. A call into state costs milliseconds, so a batch pays for the groups it touches and not for each of its sources. Checkpoints hold these groups, so a stream that has begun can't change their number.
SOURCE_GROUPS = 1024


class FirstOfSource(StatefulProcessor):
    """Lets a source's first document pass and none after it; the state of a group of sources is which of them came."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "sources array<string>")

    def _known(self) -> set[str]:
        held = self.seen.get()
        return set() if held is None else set(held[0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        known, first = self._known(), None
        for batch in rows:
            new = batch.loc[~batch["source"].isin(known), self.columns]
            if len(new):
                # of several in one batch the least id, whatever their order
                first = (new if first is None else pd.concat([first, new])).sort_values("document_id", kind="stable").drop_duplicates("source")
        if first is not None:
            self.seen.update((sorted(known.union(first["source"])),))
            yield first

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        self.seen.update((sorted(self._known().union(initial["source"])),))

    def close(self) -> None:
        pass


def first_of_each_source(documents: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Streamed ``documents`` whose source neither came before nor is among ``stored`` (source); what came is kept as state, by groups of sources, so nothing stored is read after the first batch and a batch reads the state of the groups it touches."""
    name = unused("group", documents.columns)
    group = F.pmod(F.xxhash64("source"), F.lit(SOURCE_GROUPS)).alias(name)
    initial = None if stored is None else stored.where("source is not null").select("source").distinct().select("source", group).groupBy(name)
    processor = FirstOfSource(documents.columns)
    return documents.where("source is not null").select("*", group).groupBy(name).transformWithStateInPandas(processor, documents.schema, "Append", "None", initial)


def stream_ingest(documents: DataFrame, collection: str, checkpoint: str, **chunking) -> StreamingQuery:
    """Chunk streamed documents (document_id, source, text) and add those whose source isn't stored.

    Which sources came is keyed state; those that the collection held before the stream first started are
    its initial state. Each batch writes folders of its own under ``collection`` (columns ``ingest`` and
    ``partition``), which it overwrites if it is run again, so repeated files, late files and restarts add
    nothing twice. Documents without a source or a text are left out.
    """
    spark = documents.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    stream = f"{zlib.crc32(checkpoint.encode()):08x}"

    def add(batch: DataFrame, epoch: int) -> None:
        rows = prepare_rows(chunk_text(batch.where("text is not null"), **chunking)).withColumn("ingest", F.lit(f"{stream}-{epoch}"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest", "partition").parquet(collection)

    stored = _stored(spark, collection)
    if stored is not None and "ingest" in stored.columns:  # its own folders are in its state, or written again
        stored = stored.where(~F.col("ingest").startswith(f"{stream}-"))
    fresh = first_of_each_source(documents, stored)
    return fresh.writeStream.foreachBatch(add).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class KeptIndex:
    """Postings of the newest snapshot under ``root``, opened once and again only when its version changes. Made postings stay beside their snapshot."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.version, self.index, self.opened = spark, root, None, None, 0

    def now(self) -> DataFrame:
        version = current_version(self.spark, self.root)
        if version != self.version:
            path = f"{self.root}/postings/{version}"
            if _stored(self.spark, path) is None:
                postings.write(load_version(self.spark, self.root, version), path)
            self.version, self.index, self.opened = version, self.spark.read.parquet(path), self.opened + 1
        return self.index


def stream_search(questions: DataFrame, root: str, answers: str, checkpoint: str, k: int = 10, search: Callable = postings.search) -> StreamingQuery:
    """Answer streamed questions (query_id, text) from the newest snapshot under ``root``.

    A batch reads one small version row; postings are opened anew when it has changed. Each batch has a
    folder of its own under ``answers`` (column ``epoch``), which it overwrites if it is run again, and
    tells the version it answered from.
    """
    kept = KeptIndex(questions.sparkSession, root)

    def answer(batch: DataFrame, epoch: int) -> None:
        index = kept.now()
        search(batch, index, k).withColumn("version", F.lit(kept.version)).write.mode("overwrite").parquet(f"{answers}/epoch={epoch}")

    query = questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.kept = kept
    return query
