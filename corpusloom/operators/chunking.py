"""Overlapping chunks of documents, and documents put together again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Fixed values: (size, overlap) of the two named pipelines.
PRESETS = {"standard": (2000, 200), "academic": (10000, 500)}


def boundary(window: str, least: int) -> int:
    """How much of a full window a chunk takes: up to its last paragraph break, else past its last full stop, else to its last space; all of it if none lies late enough."""
    marks = (("\n\n", 1, 0), (". ", least + 1, 1), (" ", least + 1, 0))
    ends = ((window.rfind(mark), first, more) for mark, first, more in marks)
    return next((at + more for at, first, more in ends if at >= first), len(window))


def spans(text: str, size: int, overlap: int, paragraphs: bool, least: int) -> Iterator[tuple[int, int]]:
    """(begin, stop) of the chunks in order; the last one reaches the end of the text."""
    begin, total = 0, len(text)
    while begin + size < total:
        took = boundary(text[begin : begin + size], least) if paragraphs else size
        yield begin, begin + took
        begin += max(took - overlap, 0) or took
        if begin >= total - least:
            break
    if begin < total:
        yield begin, total


def cut_points(text: str, size: int, overlap: int, paragraphs: bool, least: int) -> list[str]:
    """The chunks of one text, trimmed; short ones before the last are appended to their predecessor."""
    if not text.strip():
        return []
    if len(text) <= size:
        return [text]
    found: list[str] = []
    for begin, stop in spans(text, size, overlap, paragraphs, least):
        piece = text[begin:stop].strip()
        if found and len(piece) < least and stop < len(text):
            found[-1] += " " + piece
        else:
            found.append(piece)
    return [p for p in found if p]


def chunk_text(documents: DataFrame, chunk_size: int = 1000, overlap: int = 200, preserve_paragraphs: bool = True, min_chunk_size: int = 100, text: str = "text", strategy: str = "naive") -> DataFrame:
    """Every document column but ``text``, and (chunk_index, text) for each chunk; blank texts give none. There is one strategy, which stands in for any unknown name."""
    if chunk_size <= 0 or overlap < 0 or min_chunk_size <= 0:
        raise ValueError("chunk_size and min_chunk_size must be positive, overlap not negative")

    @F.pandas_udf(ArrayType(StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut_points(t or "", chunk_size, overlap, preserve_paragraphs, min_chunk_size))

    rest = [c for c in documents.columns if c != text]
    return documents.select(*rest, F.posexplode(cut(F.col(text))).alias("chunk_index", "text"))


def shared(before: str, after: str, most: int) -> int:
    """The length of the longest end of ``before`` that ``after`` starts with, up to ``most``, in time linear in it."""
    head, tail = after[:most], before[-most:] if most else ""
    borders, size = [0] * len(head), 0
    for i in range(1, len(head)):
        while size and head[i] != head[size]:
            size = borders[size - 1]
        size += head[i] == head[size]
        borders[i] = size
    size = 0
    for c in tail:
        while size and (size == len(head) or c != head[size]):
            size = borders[size - 1]
        size += bool(head) and c == head[size]
    return size


def join_trimmed(texts: list[str], separator: str, most: int, least: int) -> str:
    """Texts in order, each without what its predecessor ended with; ``separator`` stands where fewer than ``least`` characters are shared."""
    out = list(texts[:1])
    for before, after in zip(texts, texts[1:]):
        n = shared(before, after, most)
        out.append(after[n:] if n >= least else separator + after)
    return "".join(out)


def reassemble(chunks: DataFrame, by: list[str] = ("document_id",), separator: str = "\n", trim: int = 0, least: int = 8) -> DataFrame:
    """Chunks by index joined with ``separator``; the first chunk's metadata and groups, where there are any.

    With ``trim``, the overlap that the chunks were cut with, neighbours are joined without what they
    share, if that is ``least`` characters or more.
    """
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    if trim:

        @F.pandas_udf("string")
        def trimmed(lists: pd.Series) -> pd.Series:
            return lists.map(lambda texts: join_trimmed([t or "" for t in texts], separator, trim, least))

        firsts = [F.min_by(c, "chunk_index").alias(c) for c in ("source", "metadata", "security_group", "benchmark_questions") if c in chunks.columns]
        grouped = chunks.groupBy(*by).agg(parts.alias("_parts"), F.count("*").alias("n_chunks"), *firsts)
        return grouped.select(*by, trimmed(F.transform("_parts", lambda p: p["text"])).alias("text"), "n_chunks", *[c for c in grouped.columns if c not in (*by, "_parts", "n_chunks")])
    firsts = [F.min_by(c, "chunk_index").alias(c) for c in ("source", "metadata", "security_group", "benchmark_questions") if c in chunks.columns]
    return chunks.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["text"]), separator).alias("text"), F.count("*").alias("n_chunks"), *firsts)
