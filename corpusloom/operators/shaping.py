"""From hits to documents, citations and contexts; corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.filters import meta


def _ordered(*fields: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*fields)))


def consolidate_by_document(hits: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """One row per query and document: its chunks' texts by index, joined by line feeds, and the best score."""
    parts = F.transform(_ordered("chunk_index", "text"), lambda c: c["text"])
    return hits.groupBy(*by, "document_id").agg(F.array_join(parts, "\n").alias("text"), F.min("source").alias("source"), F.min_by("metadata", "chunk_index").alias("metadata"), F.max("rrf_score").alias("best_score"), F.count("*").alias("n_chunks"))


def consolidate_rich(hits: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """As ``consolidate_by_document`` with rules between non-empty texts, and sorted distinct unions of keywords, unique words and authors."""
    authors = F.coalesce(meta("author", "array<string>"), F.array(meta("author")))
    lists = {"keywords": meta("keywords", "array<string>"), "unique_words": meta("unique_words", "array<string>"), "authors": authors}
    union = lambda c: F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(c)), lambda x: x.isNotNull())))
    parts = F.filter(F.transform(_ordered("chunk_index", "text"), lambda c: c["text"]), lambda t: t != "")
    grouped = hits.groupBy(*by, "document_id").agg(F.array_join(parts, "\n\n---\n\n").alias("text"), *[union(c).alias(n) for n, c in lists.items()], F.min("distance").alias("min_distance"), F.max("rrf_score").alias("max_score"))
    return grouped.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("max_score"), "document_id")))


def consolidate_by_source(hits: DataFrame, by: tuple[str, ...] = ("query_id",), ascending: bool = False) -> DataFrame:
    """One row per source with chunk_index 0, ordered by its best distance or score; unknown ones last."""
    best = F.min("distance") if ascending else F.max("rrf_score")
    parts = F.transform(_ordered("chunk_index", "text"), lambda c: c["text"])
    grouped = hits.groupBy(*by, "source").agg(F.array_join(parts, "\n").alias("text"), best.alias("best")).withColumn("chunk_index", F.lit(0))
    order = F.asc_nulls_last("best") if ascending else F.desc_nulls_last("best")
    return grouped.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(order, "source")))


def group_rank(hits: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Hits once each, sources by their best score, chunks by index inside: ``position`` from 1."""
    once = hits.groupBy(*by, "id").agg(F.max_by(F.struct("source", "chunk_index", "text", "rrf_score"), "rrf_score").alias("h")).select(*by, "id", "h.*")
    best = once.withColumn("source_best", F.max("rrf_score").over(W.partitionBy(*by, "source")))
    return best.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("source_best"), "source", "chunk_index", "id")))


def combine_by_source(hits: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    return hits.groupBy(*by, "source").agg(_ordered("chunk_index", "id").alias("chunks"))


def author_text() -> Column:
    return F.coalesce(F.array_join(meta("author", "array<string>"), ", "), meta("author"))


def metadata_summary(chunks: DataFrame) -> DataFrame:
    first = chunks.groupBy("document_id").agg(F.min_by("metadata", "chunk_index").alias("metadata"))
    unknown = F.lit("Unknown")
    return first.select("document_id", F.coalesce(meta("title"), unknown).alias("title"), F.coalesce(author_text(), unknown).alias("authors"), F.coalesce(meta("date"), unknown).alias("date"))


def render_markdown(text: Column, source: Column, include_text: bool = True) -> Column:
    """Title, authors, date, source, every other non-empty metadata key in title case, and the text after a rule."""
    named = ("title", "author", "date")
    bold = lambda label, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"**{label}:** "), value))
    entries = F.map_entries(F.from_json("metadata", "map<string,string>"))
    other = F.filter(entries, lambda e: ~e["key"].isin(*named) & e["value"].isNotNull() & ~e["value"].isin("", "[]", "{}", "0", "false"))
    shown = F.transform(other, lambda e: F.concat(F.lit("**"), F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" "))), F.lit(":** "), F.when(e["value"].startswith("["), F.concat(F.lit("`"), F.array_join(F.from_json(e["value"], "array<string>"), "`, `"), F.lit("`"))).otherwise(e["value"])))
    lines = [F.when(meta("title") != "", F.concat(F.lit("### "), meta("title"))), bold("Authors", author_text()), bold("Date", meta("date")), F.when(source != "", F.concat(F.lit("**Source:** `"), source, F.lit("`"))), F.when(F.size(shown) > 0, F.array_join(shown, "\n"))]
    return F.concat_ws("\n", *lines, *([F.when(text != "", F.concat(F.lit("\n---\n"), text))] if include_text else []))


def build_citations(documents: DataFrame, now: Column) -> DataFrame:
    """source, rendered document and metadata of consolidated documents; ``now`` stands where a date is missing."""
    details = F.struct(F.coalesce(meta("title"), F.col("source")).alias("title"), author_text().alias("author"), F.coalesce(meta("date"), now.cast("string")).alias("date"))
    return documents.select("query_id", "document_id", "source", render_markdown(F.col("text"), F.col("source")).alias("document"), details.alias("details"), "best_score")


def cite_once(citations: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """A document's first citation in each session."""
    return citations.withColumn("_nth", F.row_number().over(W.partitionBy(session, "document_id").orderBy(order))).where("_nth = 1").drop("_nth")


def context_block(documents: DataFrame, most: int = 6, chars: int = 4000, limit: int | None = None) -> DataFrame:
    """Each query's first ``most`` documents by ``rank``, ``chars`` characters each, joined by blank lines and cut to ``limit``."""
    first = documents.where(F.col("rank") <= most).select("query_id", "rank", F.substring("text", 1, chars).alias("text"))
    joined = F.array_join(F.transform(_ordered("rank", "text"), lambda c: c["text"]), "\n\n")
    return first.groupBy("query_id").agg((joined if limit is None else F.substring(joined, 1, limit)).alias("context"))


def ingest_statistics(files: DataFrame) -> DataFrame:
    """Totals over (status, n_chunks, seconds, bytes) rows."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return files.agg(F.count("*").alias("total"), of("processed"), of("skipped"), of("failed"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"), F.sum("seconds").alias("seconds"), F.sum("bytes").alias("bytes"))


def histogram(values: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin from 1, n, low, high): equal widths from the least to the greatest value."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    if low is None:
        return values.select(F.lit(1).alias("bin"), F.lit(0).cast("long").alias("n")).where("false")
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((F.col(column) - low) / width).cast("int") + 1, F.lit(bins))
    return values.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def top_topics(chunks: DataFrame, k: int, key: str = "keywords") -> DataFrame:
    """The ``k`` keywords of most documents."""
    pairs = chunks.select("document_id", F.explode(meta(key, "array<string>")).alias("topic")).distinct()
    return pairs.groupBy("topic").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "topic").limit(k)


def topic_sketches(chunks: DataFrame, by: list[str] = (), key: str = "keywords", lg: int = 12) -> DataFrame:
    """(…by, topic, documents): a mergeable sketch of the documents of each topic, to be kept for each day or partition and put together later; ``lg`` 12 errs by about 2 % (one standard deviation)."""
    pairs = chunks.select(*by, "document_id", F.explode(meta(key, "array<string>")).alias("topic"))
    return pairs.groupBy(*by, "topic").agg(F.hll_sketch_agg("document_id", lg).alias("documents"))


def topics_from_sketches(sketches: DataFrame, k: int) -> DataFrame:
    """The ``k`` topics of most documents, by the union of their sketches."""
    counted = sketches.groupBy("topic").agg(F.hll_sketch_estimate(F.hll_union_agg("documents", True)).alias("documents"))
    return counted.orderBy(F.desc("documents"), "topic").limit(k)


def frequent_sketches(chunks: DataFrame, by: list[str], key: str = "keywords", capacity: int = 4096) -> DataFrame:
    """(…by, frequent, n): a heavy-hitter sketch of the topics of first chunks, ``capacity`` counters each; a topic's count is off by at most about 3.5 n / capacity."""
    topics = chunks.where("chunk_index = 0").select(*by, F.explode(F.array_distinct(meta(key, "array<string>"))).alias("topic"))
    return topics.groupBy(*by).agg(F.expr(f"approx_top_k_accumulate(topic, {capacity})").alias("frequent"), F.count("topic").alias("n"))


def frequent_topics(sketches: DataFrame, k: int, capacity: int = 4096) -> DataFrame:
    """(topic, documents) of the ``k`` heaviest topics over all sketches."""
    merged = sketches.agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(frequent, {capacity}), {k})").alias("top"))
    return merged.select(F.inline("top")).toDF("topic", "documents")


def distinct_estimate(chunks: DataFrame, found: Column, lg: int = 12) -> DataFrame:
    """As ``documents_on``, by a sketch: no document id is shuffled."""
    return chunks.where(found).agg(F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg("document_id", lg)), F.lit(0)).alias("documents"))


def documents_on(chunks: DataFrame, found: Column) -> DataFrame:
    return chunks.where(found).agg(F.countDistinct("document_id").alias("documents"))


def documents_by_author(chunks: DataFrame) -> DataFrame:
    authors = F.coalesce(meta("author", "array<string>"), F.array(meta("author")))
    pairs = chunks.select("source", "document_id", F.explode(authors).alias("author")).distinct()
    return pairs.groupBy("author").agg(F.countDistinct("document_id").alias("documents"), F.array_sort(F.collect_set("source")).alias("sources"))
