"""Documents to Markdown, and the images that are written into it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusloom.operators import tables

# An inline image, and the extensions of its kinds.
IMAGE = r"(?i)!\[([^\]]*)\]\((data:image/([a-zA-Z0-9.+-]+);base64,([A-Za-z0-9+/=\s]+))\)"

#: Keys under which one description meets the places that it stands in, where descriptions are too many to be broadcast.
SALTS = 32

EXTENSIONS = {"jpeg": "jpg", "jpg": "jpg", "pjpeg": "jpg", "svg+xml": "svg", "svg": "svg", "tiff": "tiff", "tif": "tiff", "": "png"}


def convert(documents: DataFrame, fn: Callable[[pd.Series], pd.Series], content: str = "content") -> DataFrame:
    """``markdown`` by ``fn`` where it is missing, a row at a time where a batch fails; ``error`` says what failed."""

    @F.pandas_udf(StructType([StructField("markdown", StringType()), StructField("error", StringType())]))
    def run(values: pd.Series) -> pd.DataFrame:
        def one(v):
            try:
                return fn(pd.Series([v])).iloc[0], None
            except Exception as e:  # noqa: BLE001  a failure is counted, not fatal
                return None, f"{type(e).__name__}: {e}"

        try:
            return pd.DataFrame({"markdown": fn(values).to_numpy(), "error": None}, dtype=object)
        except Exception:  # noqa: BLE001
            return pd.DataFrame([one(v) for v in values], columns=["markdown", "error"], dtype=object)

    have = documents if "markdown" in documents.columns else documents.withColumn("markdown", F.lit(None).cast("string"))
    todo = have.where("markdown is null").withColumn("_done", run(F.col(content))).withColumns({"markdown": F.col("_done.markdown"), "error": F.col("_done.error")}).drop("_done")
    return have.where("markdown is not null").withColumn("error", F.lit(None).cast("string")).unionByName(todo)


def extension(subtype: Column) -> Column:
    low = F.lower(F.coalesce(subtype, F.lit("")))
    known = F.create_map(*[F.lit(x) for kind in EXTENSIONS.items() for x in kind])
    return F.coalesce(F.try_element_at(known, low), low)


def extract_images(documents: DataFrame, markdown: str = "markdown", key: str = "document_id") -> DataFrame:
    """(key, position, ext, bytes, hash) for every inline image."""
    tags = documents.select(key, F.posexplode(F.regexp_extract_all(F.col(markdown), F.lit(IMAGE), F.lit(0))).alias("position", "tag"))
    data = F.unbase64(F.regexp_replace(F.regexp_extract("tag", IMAGE, 4), r"\s", ""))
    return tags.select(key, "position", extension(F.regexp_extract("tag", IMAGE, 3)).alias("ext"), data.alias("bytes")).withColumn("hash", F.sha2("bytes", 256))


def distinct_images(images: DataFrame) -> DataFrame:
    return images.select("hash", "ext", "bytes").dropDuplicates(["hash"])


def describe_images(images: DataFrame, fn: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """(hash, description): by ``fn`` over the bytes, or the kind and size."""
    if fn is None:
        return images.select("hash", F.format_string("[Image (%s), %d bytes]", "ext", F.length("bytes")).alias("description"))
    run = F.pandas_udf(lambda b: fn(b), StringType())
    return images.select("hash", run(F.col("bytes")).alias("description"))


def replace_images(documents: DataFrame, descriptions: DataFrame, markdown: str = "markdown", key: str = "document_id") -> DataFrame:
    """Image tags become ``*description*``; those without one stay."""
    split = F.split(F.col(markdown), IMAGE, -1)
    tags = F.regexp_extract_all(F.col(markdown), F.lit(IMAGE), F.lit(0))
    has = documents.where(F.size(tags) > 0)
    parts = has.select(key, F.posexplode(F.arrays_zip(split.alias("before"), F.concat(tags, F.array(F.lit(""))).alias("tag"))).alias("position", "p")).select(key, "position", "p.before", "p.tag")
    hashed = parts.withColumn("hash", F.when(F.col("tag") != "", F.sha2(F.unbase64(F.regexp_replace(F.regexp_extract("tag", IMAGE, 4), r"\s", "")), 256)))
    # an image that many documents share is no hot key: descriptions are broadcast, or met under as many keys as there are partitions
    described = tables.cut(descriptions)
    if tables.strategy(described) == "broadcast":
        named = hashed.join(described.hint("broadcast"), "hash", "left")
    else:
        salts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salted = hashed.withColumn("_salt", F.when(F.col("hash").isNotNull(), F.pmod(F.xxhash64(key, "position"), F.lit(min(salts, SALTS)))).cast("int"))
        named = salted.join(described.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(min(salts, SALTS) - 1)))).hint("merge"), ["hash", "_salt"], "left")
    shown = F.concat("before", F.when(F.col("description").isNotNull(), F.concat(F.lit("*"), F.col("description"), F.lit("*"))).otherwise(F.col("tag")))
    whole = named.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", shown.alias("s")))), lambda c: c["s"]), "").alias("_new"))
    return documents.join(whole.hint("merge"), key, "left").withColumn(markdown, F.coalesce("_new", markdown)).drop("_new")
