"""A cleaning pipeline over documents: each stage reads what its predecessor wrote."""

from __future__ import annotations

import public_tokenizers

from corpusloom.llm import bpe, decontamination, line_dedup, ngram_join, toxicity
from corpusloom.llm.common import cut


def drop_toxic(spark, docs, sf_dir):
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark, docs, sf_dir):
    return line_dedup.dedup(docs)


#: Unless a contract says otherwise, near duplicates share 0.8 of their five-word shingles.
NEAR = {"per_cent": 80, "words": 5}


def keep_one_of_each_group(spark, docs, sf_dir):
    return ngram_join.keep_one(docs, **NEAR)


def drop_contaminated(spark, docs, sf_dir):
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark, docs, sf_dir):
    return bpe.encode(docs, bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: The first stage is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply STAGES to the documents of ``sf_dir``; every stage but the last is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
