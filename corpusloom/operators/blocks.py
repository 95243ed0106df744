"""Rows as binary blocks, so that a table of queries meets a table of vectors block by block, in tasks of bounded memory.

A block is one row that holds an Arrow stream. Query blocks that are small by their measured bytes are
broadcast to the blocks of the other side; beyond that both sides are dealt to a grid of (query part,
block group) keys, so that no key is hot and each side is copied as often as the other has parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import tables

#: Rows and bytes at which a block ends.
BLOCK_ROWS, BLOCK_BYTES = 8_192, 8 << 20
#: Rows of a query block.
QUERY_ROWS = 8_192
#: Blocks that meet a query part under one key of the grid.
GROUP = 16


def to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def one_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def matrix(column: pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    """The lists of ``column`` as rows; shorter ones end in zeros."""
    lists = one_array(column)
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(kind)
    out = np.zeros((len(sizes), width), dtype=kind)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def pack(rows: DataFrame, index: Callable[[pa.Table], dict] | None = None, schema: str = "", ends: Callable[[pa.Table], list[int]] | None = None, most: int = BLOCK_ROWS) -> DataFrame:
    """(number, block) with up to ``most`` rows of a partition each, in their order.

    ``ends`` gives places at which a table must be parted further; ``index`` adds the columns of ``schema`` and may replace ``block``.
    """
    tables.small_batches(rows.sparkSession)
    schema = "number long, block binary" + (f", {schema}" if schema else "")
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, held, bytes_held, many = 0, [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal at, held, bytes_held, many
            whole = pa.Table.from_batches(held)
            stops = sorted({*(ends(whole) if ends else []), whole.num_rows})
            for begin, stop in zip([0, *stops], stops):
                if begin < stop:
                    part = whole.slice(begin, stop - begin)
                    extra = index(part) if index else {}
                    row = {"number": (TaskContext.get().partitionId() << 32) + at, "block": None} | extra
                    row["block"] = to_bytes(row["block"] if row["block"] is not None else part)
                    at += 1
                    yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in shape], schema=shape)
            held, bytes_held, many = [], 0, 0

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - many)
                held.append(part)
                many, bytes_held = many + part.num_rows, bytes_held + part.nbytes
                batch = batch.slice(part.num_rows)
                if many >= most or bytes_held >= BLOCK_BYTES:
                    yield from out()
        if many:
            yield from out()

    return rows.mapInArrow(run, schema)


def pack_queries(queries: DataFrame, most: int = QUERY_ROWS) -> DataFrame:
    """The written blocks of a query table, dealt out evenly by a count of its rows."""
    return tables.cut(pack(queries.repartition(max(1, -(-queries.count() // most))), most=most))


def _block(row: pa.RecordBatch) -> dict:
    return row.to_pylist()[0] | {"block": from_bytes(row.column("block")[0].as_py())}


def meet(queries: DataFrame, blocks: DataFrame, start: Callable[[], object], schema: str, read: Callable[[pa.RecordBatch], object] = _block, written: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Every written query block with every block, or with those of equal ``keys``: ``start()`` gives a task an object with ``add(number, queries, block)`` and ``rest()``, both yielding columns of ``schema``; ``read`` makes a block of its row."""
    rows, size = tables.measured(queries)
    parts, how, on = max(1, min(rows, -(-size // max(1, tables.BROADCAST_BYTES)))), "broadcast" if size <= tables.BROADCAST_BYTES else "merge", [*(keys or ["_part"])]
    if how == "merge" and not written:
        blocks = tables.cut(blocks)
    asked = queries.select(*(keys or [F.pmod(F.xxhash64("number"), F.lit(parts)).cast("int").alias("_part")]), F.col("number").alias("_asking"), F.col("block").alias("_asked"))
    dealt = blocks if keys else blocks.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    if how == "merge":
        groups = max(1, -(-blocks.select("number").count() // GROUP))
        dealt = dealt.withColumn("_group", F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int"))
        asked, on = asked.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))), [*on, "_group"]
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, known, number = start(), None, None

        def shown(found):
            for columns in found:
                yield pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in shape], schema=shape)

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                asking = row.column("_asking")[0].as_py()
                if asking != number:
                    number, known = asking, from_bytes(row.column("_asked")[0].as_py())
                yield from shown(state.add(number, known, read(row.drop_columns(["_asking", "_asked"]))))
        yield from shown(state.rest())

    return dealt.join(asked.hint(how), on).drop(*on).mapInArrow(run, schema)


def first_k(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` greatest finite scores of each row; of equal ones those with the lowest columns."""
    n = scores.shape[1]
    if n > k:
        edge = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
        above = scores > edge
        equal = scores == edge
        keep = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    else:
        keep = np.ones(scores.shape, dtype=bool)
    return np.nonzero(keep & (scores > -np.inf))
