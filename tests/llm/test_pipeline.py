"""The whole pipeline against a brute-force version of its stages."""

import random

import public_tokenizers
from test_methods import brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import line_dedup, toxicity


def brute_texts(texts):
    """Texts without the lines that have an equal or near earlier one; documents without a word left go."""
    seen, left = [], {}
    for d in sorted(texts):
        kept, any_dropped = [], False
        for line in texts[d].split("\n"):
            w = line.encode().lower().split()
            drop = bool(w) and any(o == w or (len(o) >= 5 and len(w) >= 5 and line_dedup.within_one(o, w)) for o in seen)
            if w:
                seen.append(w)
            any_dropped |= drop
            if not drop:
                kept.append(line)
        text = "\n".join(kept) if any_dropped else texts[d]
        if not any_dropped or text.split():
            left[d] = text
    return left


def test_run_equals_brute_force(make, spark, tmp_path):
    r = random.Random(12)
    word = lambda: f"w{r.randrange(3000)}"
    item = " ".join(f"item{i}" for i in range(20))
    texts = {}
    for d in range(40):
        texts[d] = "\n".join(" ".join(word() for _ in range(r.randint(6, 40))) for _ in range(r.randint(1, 4)))
    texts[40], texts[41] = texts[3], texts[4] + "\nown words at the end of it"
    words = " ".join(word() for _ in range(60)).split(" ")
    texts[42], texts[43] = " ".join(words), " ".join([*words, "two", "more"])
    texts[44], texts[45] = f"before {item} after", "\n".join([item, "and other words"])
    make(list(texts.items())).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = brute_texts(texts)
    root = brute_components(left, 80, 5)
    left = {d: t for d, t in left.items() if root[d][1] == d and item not in t}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {x["doc_id"]: list(x["ids"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {d: library.encode(t, add_special_tokens=False).ids for d, t in left.items()}
    assert 40 not in got and 43 not in got and 44 not in got and 42 in got


def test_what_the_labels_teach_takes_effect(make, spark, tmp_path):
    """What the fitted model rejects, labelled or not, goes before any later stage sees it; the rest is as brute force has it."""
    r = random.Random(4)
    bad = [f"vile{i}" for i in range(6)]
    texts, toxic = {}, {}
    for d in range(240):
        words = [f"w{r.randrange(4000)}" for _ in range(50)]
        toxic[d] = int(d % 3 == 0)
        for _ in range(6 * toxic[d]):
            words.insert(r.randrange(len(words)), r.choice(bad))
        texts[d] = " ".join(words)
    # 240 repeats a clean text and goes; 241 has the clean words of a toxic one, which is gone by then, and stays
    texts[240], toxic[240] = texts[1], 0
    texts[241], toxic[241] = "only clean words here and " + " ".join(w for w in texts[0].split() if w not in bad), 0
    make(list(texts.items())).write.parquet(f"{tmp_path}/documents.parquet")
    labelled = [(d, 1, toxic[d]) for d in texts if d % 4]
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    documents, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    judged = {x["doc_id"]: x["rejected"] for x in toxicity.score(documents, toxicity.fit(documents, labels)).collect()}
    # a random word can go with the flag by chance, so a clean text may be lost: one of 162 here; the bound is that of the held-out tests
    assert all(judged[d] for d in texts if toxic[d]) and sum(judged[d] == bool(toxic[d]) for d in texts) >= 0.97 * len(texts)
    left = brute_texts({d: t for d, t in texts.items() if not judged[d]})
    root = brute_components(left, 80, 5)
    got = {x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert got == {d for d in left if root[d][1] == d}
    assert 240 not in got and 241 in got and 0 not in got
