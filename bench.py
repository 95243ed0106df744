"""Time the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS say where and with how many cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from corpusloom.plans import kept
from corpusloom.plans import queries as own

HEADLINE = ["b3_bm25", "b2_postings", "v2_cosine_topk", "r2_hybrid_search", "a1_consolidate_by_document", "k1_chunk_text", "e8_metrics", "u1_upsert", "s8_describe_collections", "a12_top_topics", "f8_metadata_filters", "h5_conversation_search"]
KEPT = ["b3_kept_postings", "v3_stored_cells", "u1_upsert_buckets", "j4_visible_by_sets"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = {n: own.QUERIES[n] for n in HEADLINE} | {n: kept.QUERIES[n] for n in KEPT}
    try:
        from corpusloom.llm import queries as llm

        wanted |= llm.QUERIES
    except ImportError:
        pass
    own.QUERIES["a9_ingest_statistics"](spark, sf_dir).collect()  # starts the engine
    took = {}
    for name, query in wanted.items():
        began = time.time()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "seconds for the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
