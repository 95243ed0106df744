"""Retrieval quality: questions with one expected source, placements, and the usual measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import is_blank

CUTOFFS = (1, 5, 10, 25, 50, 100)


def question_set(chunks: DataFrame) -> DataFrame:
    """(source, question) from the stored questions of first chunks with a source and a text."""
    heads = chunks.where((F.col("chunk_index") == 0) & ~is_blank(F.col("source")) & ~is_blank(F.col("text")))
    return heads.select("source", F.explode(F.from_json("benchmark_questions", "array<string>")).alias("question")).where(~is_blank(F.col("question")))


def skipped(chunks: DataFrame) -> DataFrame:
    """How many first chunks have no source, no text or no questions."""
    heads = chunks.where("chunk_index = 0")
    none = F.coalesce(F.size(F.from_json("benchmark_questions", "array<string>")), F.lit(0)) <= 0
    return heads.agg(F.count_if(is_blank(F.col("source"))).alias("no_source"), F.count_if(is_blank(F.col("text"))).alias("no_text"), F.count_if(none).alias("no_questions"), F.count("*").alias("heads"))


def placements(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, placement): the first rank whose source is the expected one; null if none."""
    found = questions.select("query_id", F.col("expected_source").alias("source")).join(hits.select("query_id", "source", "rank").hint("merge"), ["query_id", "source"]).groupBy("query_id").agg(F.min("rank").alias("placement"))
    return questions.select("query_id").join(found.hint("merge"), "query_id", "left")


def metrics(placed: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(metric, k, value). With one relevant document recall, precision and hit rate at k are the same number."""
    p = F.col("placement")
    zero = F.lit(0.0)
    plain = {"mrr": F.avg(F.coalesce(1 / p, zero)), "mean_placement": F.coalesce(F.avg(p), zero), "median_placement": F.coalesce(F.median(p), zero), "std_placement": F.coalesce(F.stddev_samp(p), zero), "found": F.count(p).cast("double"), "not_found": F.count_if(p.isNull()).cast("double")}
    at_k = {}
    for k in cutoffs:
        inside = p.isNotNull() & (p <= k)
        hit = F.avg(F.when(inside, 1.0).otherwise(0.0))
        at_k |= {("recall", k): hit, ("precision", k): hit, ("hit_rate", k): hit, ("ndcg", k): F.avg(F.when(inside, 1 / F.log2(p + 1)).otherwise(0.0)), ("percent_in_top", k): 100 * hit}
    wide = placed.agg(*[v.alias(n) for n, v in plain.items()], *[v.alias(f"{n}@{k}") for (n, k), v in at_k.items()])
    rows = [F.struct(F.lit(n).alias("metric"), F.lit(0).alias("k"), F.col(n).alias("value")) for n in plain] + [F.struct(F.lit(n).alias("metric"), F.lit(k).alias("k"), F.col(f"`{n}@{k}`").alias("value")) for n, k in at_k]
    return wide.select(F.inline(F.array(*rows)))


def placement_histogram(placed: DataFrame) -> DataFrame:
    return placed.where("placement is not null").groupBy("placement").agg(F.count("*").alias("n"))


def save_run(measured: DataFrame, placed: DataFrame, root: str, run: str) -> None:
    """Write an evaluation run as JSON lines under ``root``: a line for each metric, its cut-offs as string keys, and one for the histogram of placements. A run that is there already stays."""
    histogram = placement_histogram(placed).select(F.lit("placement_distribution").alias("metric"), F.col("placement").alias("k"), F.col("n").cast("double").alias("value"))
    values = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("k").cast("string").alias("k"), "value"))))
    both = measured.select("metric", "k", "value").unionByName(histogram).groupBy("metric").agg(values.alias("values"))
    both.coalesce(1).write.mode("errorifexists").json(f"{root}/run={run}")


def load_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run, metric, k, value) of all saved runs."""
    saved = spark.read.schema("metric string, values map<string,double>, run string").json(root)
    return saved.select("run", "metric", F.explode("values").alias("k", "value")).withColumn("k", F.col("k").cast("int"))


def results_json(measured: DataFrame) -> DataFrame:
    """One JSON object per metric, with the cut-offs as string keys."""
    return measured.groupBy("metric").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("k").cast("string").alias("k"), "value"))))).alias("values"))
