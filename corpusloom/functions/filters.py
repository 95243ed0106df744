"""Predicates over chunks and their JSON metadata. Callers may also pass any Spark Column or SQL predicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The columns a search gives back.
DEFAULT_COLUMNS = ("id", "document_id", "source", "chunk_index", "text", "metadata", "security_group", "partition")


def all_of(filters: list[Column | str | None]) -> Column:
    """The conjunction; strings count in parentheses, blank ones don't count, none at all is true."""
    kept = [F.expr(f"({f})") if isinstance(f, str) else f for f in filters if f is not None and (not isinstance(f, str) or f.strip())]
    return reduce(lambda a, b: a & b, kept, F.lit(True))


def meta(key: str, kind: str = "string", column: str = "metadata") -> Column:
    """A flat metadata key by type, whatever characters it has; arrays are read as JSON."""
    if any(c in key for c in "'?\\"):  # JSON paths can't name these
        value = F.try_element_at(F.from_json(column, "map<string,variant>"), F.lit(key))
        raw = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))
    else:
        raw = F.get_json_object(column, f"$['{key}']")
    return F.from_json(raw, kind) if kind.startswith("array") else raw.cast(kind)


def meta_contains(key: str, value, kind: str = "array<string>") -> Column:
    return F.coalesce(F.array_contains(meta(key, kind), value), F.lit(False))


def meta_contains_any(key: str, values: list, kind: str = "array<string>") -> Column:
    return F.coalesce(F.arrays_overlap(meta(key, kind), F.array(*map(F.lit, values))), F.lit(False))


def meta_contains_all(key: str, values: list, kind: str = "array<string>") -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, values)), meta(key, kind))) == 0, F.lit(False)) & meta(key, kind).isNotNull()


def meta_between(key: str, low, high, kind: str = "double") -> Column:
    return F.coalesce(meta(key, kind).between(low, high), F.lit(False))


def meta_like(key: str, part: str) -> Column:
    """A fuzzy match: the value has ``part`` somewhere."""
    return F.coalesce(F.contains(meta(key), F.lit(part)), F.lit(False))


def visible_to(roles: list[str], column: str = "security_group") -> Column:
    """Row security: no role sees nothing."""
    return F.coalesce(F.arrays_overlap(column, F.array(*map(F.lit, roles)).cast("array<string>")), F.lit(False))


def with_fallback(name: str, default=None, column: str = "metadata") -> Column:
    return F.coalesce(F.col(name), meta(name, column=column), F.lit(default))


def filter_chunks(chunks: DataFrame, roles: list[str], filters: list[Column | str] = (), *, partitions: list[str] | None = None, heads: bool = False, limit: int = 100) -> DataFrame:
    """Filtering without ranking: distance 1, score 0, in the order of id."""
    wanted = [visible_to(roles), *filters, *([F.col("partition").isin(partitions)] if partitions else []), *([F.col("chunk_index") == 0] if heads else [])]
    return chunks.where(all_of(wanted)).select(*DEFAULT_COLUMNS, F.lit(1.0).alias("distance"), F.lit(0.0).alias("score")).orderBy("id").limit(limit)


def filter_partitions(chunks: DataFrame, roles: list[str], partitions: list[str], filters: list[Column | str] = (), *, per_partition: int = 100, limit: int = 100) -> DataFrame:
    """Filtering over named partitions: at most ``per_partition`` chunks of each by id, each (source, chunk_index) once, ``limit`` in all."""
    found = chunks.where(all_of([visible_to(roles), F.col("partition").isin(partitions), *filters]))
    some = found.withColumn("_nth", F.row_number().over(W.partitionBy("partition").orderBy("id"))).where(F.col("_nth") <= per_partition)
    once = some.withColumn("_nth", F.row_number().over(W.partitionBy("source", "chunk_index").orderBy("id"))).where("_nth = 1")
    return once.select(*DEFAULT_COLUMNS, F.lit(1.0).alias("distance"), F.lit(0.0).alias("score")).orderBy("id").limit(limit)


def browse(collections: DataFrame, words: str = "", access: str | None = None) -> DataFrame:
    """Collections with ``words`` in their name or description, case aside, and of an access level."""
    low = words.lower()
    found = F.contains(F.lower("name"), F.lit(low)) | F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit(low))
    return collections.where(found & (F.lit(access is None) | (F.col("access_level") == access)))


def normalise_requests(requests: DataFrame, default_collection: str | None = None) -> DataFrame:
    """(collection, texts, filters) rows: default collection, trimmed filters without blanks, and ``error`` for bad rows."""
    named = F.coalesce(F.nullif(F.trim("collection"), F.lit("")), F.lit(default_collection))
    clean = F.filter(F.transform("filters", lambda f: F.trim(f)), lambda f: f.isNotNull() & (f != ""))
    bad = F.coalesce(F.exists("texts", lambda t: t.isNull()), F.lit(False))
    error = F.when(named.isNull(), "collection is required").when(F.col("texts").isNull() | (F.size("texts") == 0), "texts are required").when(bad, "texts must be strings")
    return requests.withColumn("error", error).withColumn("collection", named).withColumn("filters", F.coalesce(clean, F.array().cast("array<string>")))
