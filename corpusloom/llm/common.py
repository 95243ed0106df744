"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from bisect import bisect_left
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.tables import BROADCAST_BYTES, cut, cut_at, forget, join_few, measured_bytes, shared_folder, small_batches, strategy, unused  # noqa: F401


def utf8(column: str = "text") -> Column:
    """The text as UTF-8 bytes, empty where it is null; ``bytes.lower`` and ``bytes.split`` are ASCII-only, as the contracts ask."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias("utf8")


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
}


#: Rows of an Arrow batch that become Python objects at once, so that a worker's memory follows these and not the batch.
ROWS_AT_ONCE = 500


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers are used again and would keep the most that any of their tasks held."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # of the GNU C library only
        ctypes.CDLL(None).malloc_trim(0)


def map_columns(df: DataFrame, schema: str, start: Callable[[], Callable[[dict], dict]], at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """Run ``start()(columns) -> columns`` over Arrow batches, ``at_once`` rows each; ``start`` runs once a task, so its closures can hold caches."""
    small_batches(df.sparkSession)
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    names, types = [n for n, _ in fields], [ARROW[t] for _, t in fields]

    def run(batches):
        rows = start()
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                out = rows({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], names=names)
        rows = batch = part = out = None
        give_back()

    return df.mapInArrow(run, schema)


class Taken:
    """Spans, to be asked whether one of them overlaps another span, by a search in their sorted starts."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.reach = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))

    def overlaps(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.reach[before - 1] > start


#: Edges that one task of a component round takes.
EDGES_PER_TASK = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (u, v) reach, for nodes that have any; large-star and small-star rounds."""
    spark = edges.sparkSession
    edges, path = cut_at(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    # rounds never add edges; as many tasks as these need keep the rounds' files few
    parts = max(1, -(-edges.count() // EDGES_PER_TASK))
    edges, last = edges.coalesce(parts), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least.hint("merge"), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).coalesce(parts).distinct()
        before = path
        edges, path = cut_at(small.coalesce(parts))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        forget(spark, before)
        if now == last:
            return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = now
