"""Every operator and stage takes odd and empty tables and columns with clashing names."""

import public_tokenizers
import pytest

import corpus_pipeline
from corpusloom.llm import bpe, decontamination, fill_in_middle, language_model, line_dedup, ngram_join, pii, quality, secrets, sharding, toxicity


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (7, 0, 1), (None, 1, 1), (5, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "seven grey geese fly north beyond cold rivers and quiet hills"), (1, None), (2, ""), (None, "x")], "item_id long, text string")


def runs(labels, benchmark):
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return {
        "decontamination": lambda d: decontamination.report(d, benchmark), "language_model": language_model.fit_and_score, "sharding": sharding.assign, "bpe": lambda d: bpe.digests(d, vocabulary),
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)), "ngram_join": ngram_join.join, "quality": lambda d: quality.judge(d, quality.fit(d, labels)), "pii": pii.digests,
        "secrets": lambda d: secrets.digests(d, ranks, public_tokenizers.PATTERN), "line_dedup": line_dedup.report, "fill_in_middle": fill_in_middle.digests,
    }


NAMES = ["decontamination", "language_model", "sharding", "bpe", "toxicity", "ngram_join", "quality", "pii", "secrets", "line_dedup", "fill_in_middle"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_each_give_a_row(odd, labels, benchmark, name):
    assert runs(labels, benchmark)[name](odd).count() == odd.count()


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(none, labels, benchmark, name):
    assert runs(labels, benchmark)[name](none).count() == 0


def test_stages_keep_columns(odd, none, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(docs.sparkSession, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.dtypes == docs.dtypes
            assert out.count() <= docs.count()
