"""What is written and used again: postings, cells, buckets, sketches, streams, saved runs; and the pieces around them."""

import glob
import json
import math
import os
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import filters as fl
from corpusloom.operators import access, blocks, cells, chunking, evaluation, metadata, postings, search, shaping, store, tables
from corpusloom.streaming import ingest


@pytest.fixture(params=["broadcast", "merge"])
def how(request, monkeypatch):
    if request.param == "merge":
        monkeypatch.setattr(tables, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(blocks, "GROUP", 1)


def plain_bm25(queries, rows, k):
    tokens = {i: (t or "").lower().split() for i, t in rows}
    n, mean = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = Counter(w for t in tokens.values() for w in set(t))
    out = []
    for q, text in queries:
        scored = []
        for i, t in tokens.items():
            tf = Counter(t)
            s = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in set(text.split()) if tf[w])
            if s:
                scored.append((-round(s, 6), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def texts(n, seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [(i, " ".join(rnd.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rnd.randrange(30)))) for i in range(n)]


@pytest.mark.parametrize("ids", ["long", "string"])
def test_postings_like_plain_scores(spark, how, tmp_path, ids):
    name = (lambda i: f"d{i:04d}") if ids == "string" else int
    rows = [(name(i), t) for i, t in texts(400)] + [(name(900), None), (name(901), ""), (name(902), "w1 " * 500), *[(name(i), "w5 w6 w7") for i in range(903, 930)]]
    asked = [(1, "w1 w2 w59"), (2, "w5 w6 w7"), (3, "nowhere"), (4, ""), (5, " ".join(f"w{i}" for i in range(60)))]
    docs, queries = spark.createDataFrame(rows, f"id {ids}, text string").repartition(6), spark.createDataFrame(asked, "query_id int, text string")
    want = plain_bm25(asked, rows, 7)
    postings.build(docs).write.parquet(f"{tmp_path}/kept")
    for found in (search.bm25_topk(queries, docs, 7), postings.search(queries, spark.read.parquet(f"{tmp_path}/kept"), 7)):
        got = sorted(tuple(r) for r in found.select("query_id", "id", "score", "rank").collect())
        assert [(q, i, r) for q, i, _, r in got] == [(q, i, r) for q, i, _, r in want]
        assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want))


def test_ranges_that_cannot_reach_the_top_are_skipped(spark):
    """Most ranges hold only rows that score little; they are met and not scored."""
    rows = [(i, "common " * (9 if i < 20 else 1) + "filler " * 9) for i in range(800)]
    index = tables.cut(postings.build(spark.createDataFrame(rows, "id long, text string").orderBy("id").coalesce(1).repartition(40, F.expr("id div 20"))))
    asked = spark.createDataFrame([(1, "common")], "query_id int, text string")
    one_task = index.coalesce(1)
    counted = postings.skipped(asked, one_task, 5).first()
    assert counted["met"] == index.count() and counted["skipped"] >= counted["met"] // 2
    assert {r["id"] for r in postings.search(asked, one_task, 5).collect()} <= set(range(20))


def test_search_of_nothing(spark):
    docs, none = spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([], "query_id int, text string")
    assert search.bm25_topk(none, docs, 3).count() == 0
    assert search.bm25_topk(spark.createDataFrame([(1, "a")], "query_id int, text string"), docs.where("false"), 3).count() == 0


def test_nearest_by_blocks(spark, how):
    """Copies of one vector for a third of the rows, null vectors, string ids, and more queries than rows of a block."""
    rnd = random.Random(1)
    rows = [(f"v{i:03d}", [1.0, 2.0] if i % 3 == 0 else [rnd.random(), rnd.random()]) for i in range(300)] + [("none", None), ("zero", [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id string, text_embedding array<float>").repartition(5)
    asked = [(q, [rnd.random(), rnd.random()]) for q in range(40)] + [(99, [1.0, 2.0]), (100, None)]
    queries = spark.createDataFrame(asked, "query_id int, embedding array<float>")
    f32 = lambda v: [float(pd.Series([x], dtype="float32")[0]) for x in v]
    cos = lambda a, b: 0.0 if not any(a) or not any(b) else round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 9)
    want = {q: [i for _, i in sorted((-cos(f32(v), f32(w)), i) for i, w in rows if w)[:6]] for q, v in asked if v}
    got = {}
    for r in search.cosine_topk(queries, vectors, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == want
    assert [r["id"] for r in search.l2_topk(queries, vectors, 4).where("query_id = 99").orderBy("rank").collect()] == ["v000", "v003", "v006", "v009"]


def test_stored_cells(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(12)]) for i in range(600)] + [(700, None), (701, [0.0] * 12)]
    vectors = spark.createDataFrame(rows, "id long, text_embedding array<float>")
    cells.write_cells(vectors, f"{tmp_path}/i", 16)
    asked = vectors.where("id < 20").select(F.col("id").alias("query_id"), F.col("text_embedding").alias("embedding"))
    exact = search.cosine_topk(asked, vectors, 10)
    found = cells.search_cells(asked, f"{tmp_path}/i", 10).cache()
    assert found.groupBy("query_id", "id").count().where("count > 1").count() == 0
    assert cells.recall(found, exact).first()["recall"] >= 0.9
    assert cells.recall(cells.search_cells(asked, f"{tmp_path}/i", 10, nprobe=16), exact).first()["recall"] >= 0.99
    one = cells.search_cells(asked.where("query_id = 3"), f"{tmp_path}/i", 1, nprobe=1)
    assert one.first()["id"] == 3


# --- collections


def files_of(root):
    return {p: (os.path.getmtime(p), os.path.getsize(p)) for p in glob.glob(f"{root}/rows/bucket=*/*.parquet")}


def test_upsert_leaves_untouched_buckets_alone(spark, tmp_path):
    root = f"{tmp_path}/c"
    schema = "source string, chunk_index int, text string"
    store.create_buckets(spark.createDataFrame([(f"s{i}", c, "old") for i in range(60) for c in range(2)], schema), root, 8)
    before = files_of(root)
    version, touched = store.upsert_buckets(spark.createDataFrame([("s7", 0, "new"), ("s7", 5, "added"), ("s7", 0, "late")], schema), root, seen=1)
    assert version == 2 and len(touched) == 1 and store.bucket_version(spark, root) == (2, 8)
    after = files_of(root)
    changed = {p for p in before if after.get(p) != before[p]}
    assert changed and all(f"bucket={touched[0]}/" in p for p in changed)
    rows = {(r["source"], r["chunk_index"]): r["text"] for r in store.load_buckets(spark, root).collect()}
    assert len(rows) == 121 and rows["s7", 0] == "new" and rows["s7", 1] == "old" and rows["s7", 5] == "added"
    assert store.upsert_buckets(spark.createDataFrame([], schema), root) == (2, [])


def test_two_writers_conflict(spark, tmp_path, monkeypatch):
    root, schema = f"{tmp_path}/c", "source string, chunk_index int, text string"
    store.create_buckets(spark.createDataFrame([("a", 0, "old")], schema), root, 4)
    with pytest.raises(store.Conflict):
        store.create_buckets(spark.createDataFrame([("a", 0, "other")], schema), root, 4)
    change = spark.createDataFrame([("a", 0, "mine")], schema)
    real = store.upsert

    def slow(*args):  # another writer ends while this one works
        monkeypatch.setattr(store, "upsert", real)
        store.upsert_buckets(spark.createDataFrame([("a", 0, "theirs")], schema), root)
        return real(*args)

    monkeypatch.setattr(store, "upsert", slow)
    with pytest.raises(store.Conflict):
        store.upsert_buckets(change, root)
    assert [r["text"] for r in store.load_buckets(spark, root).collect()] == ["theirs"]
    with pytest.raises(store.Conflict):
        store.upsert_buckets(change, root, seen=1)
    assert store.upsert_buckets(change, root, seen=2)[0] == 3


def test_partitions_and_saved_runs(spark, tmp_path):
    assert store.partitions(spark, f"{tmp_path}/none").count() == 0
    assert store.create_partition(spark, f"{tmp_path}/none", "p") and not store.create_partition(spark, f"{tmp_path}/none", "p")
    assert [r["name"] for r in store.partitions(spark, f"{tmp_path}/none").collect()] == ["p"]
    placed = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "query_id int, placement int")
    evaluation.save_run(evaluation.metrics(placed), placed, f"{tmp_path}/runs", "a")
    evaluation.save_run(evaluation.metrics(placed.where("query_id = 1")), placed.where("query_id = 1"), f"{tmp_path}/runs", "b")
    got = {(r["run"], r["metric"], r["k"]): r["value"] for r in evaluation.load_runs(spark, f"{tmp_path}/runs").collect()}
    assert got["a", "recall", 1] == pytest.approx(1 / 3) and got["b", "mrr", 0] == 1 and got["a", "placement_distribution", 3] == 1
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        evaluation.save_run(evaluation.metrics(placed), placed, f"{tmp_path}/runs", "a")
    lines = [json.loads(x) for p in glob.glob(f"{tmp_path}/runs/run=a/*.json") for x in open(p)]
    assert all(isinstance(k, str) for x in lines for k in x["values"])


def test_visible_sets(spark):
    users = spark.createDataFrame([("u", ["a", "b"]), ("v", []), ("w", ["c"])], "user string, roles array<string>")
    chunks = spark.createDataFrame([(1, ["a", "x"]), (2, ["x", "a", "a"]), (3, ["b"]), (4, []), (5, None), (6, [None, "c"])], "id int, security_group array<string>")
    sets = access.group_sets(chunks)
    assert sets.count() == 3 and {r["n"] for r in sets.collect()} == {1, 2}
    assert {r["user"]: r["n"] for r in access.visible_counts(users, chunks).collect()} == {"u": 3, "w": 1}
    seen = access.visible_sets(users, sets).join(chunks.select("id", access.set_number(F.col("security_group")).alias("set")), "set").select("user", "id")
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, access.visible_chunks(users, chunks).collect()))


def test_sketches_stay_within_their_bounds(spark):
    rnd = random.Random(4)
    rows = [(str(i), 0, json.dumps({"keywords": [f"t{min(int(rnd.paretovariate(0.7)), 3000)}", "all"]}), i % 4) for i in range(20_000)]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_index int, metadata string, part int")
    exact = Counter(t for r in rows for t in set(json.loads(r[2])["keywords"]))
    for r in shaping.topics_from_sketches(shaping.topic_sketches(chunks, ["part"]), 5000).collect():
        assert abs(r["documents"] - exact[r["topic"]]) <= max(2, 0.1 * exact[r["topic"]])
    small = shaping.frequent_topics(shaping.frequent_sketches(chunks, ["part"], capacity=1024), 10, 1024).collect()
    assert {r["topic"] for r in small} >= {t for t, n in exact.most_common(5)}
    assert all(abs(r["documents"] - exact[r["topic"]]) <= 3.5 * 2 * len(rows) / 1024 for r in small)
    assert abs(shaping.distinct_estimate(chunks, F.lit(True)).first()[0] - 20_000) <= 0.1 * 20_000
    assert shaping.distinct_estimate(chunks, F.lit(False)).first()[0] == 0


# --- chunks, extraction, filters


def test_shared_ends():
    rnd = random.Random(5)
    for _ in range(3000):
        a, b, most = ("".join(rnd.choices("ab", k=rnd.randrange(12))) for _ in range(2)), None, rnd.randrange(13)
        a, b = a
        want = max(n for n in range(min(len(a), len(b), most) + 1) if a.endswith(b[:n]))
        assert chunking.shared(a, b, most) == want
    assert chunking.shared("a" * 100_000, "a" * 100_000, 100_000) == 100_000


def test_reassemble_without_overlap(spark):
    rnd = random.Random(6)
    whole = [(i, "".join(rnd.choices("abcdef", k=n))) for i, n in enumerate([0, 1, 99, 100, 101, 950, 3000])]
    docs = spark.createDataFrame(whole, "document_id int, text string")
    chunks = chunking.chunk_text(docs, 100, 30, min_chunk_size=10)
    got = {r["document_id"]: r["text"] for r in chunking.reassemble(chunks, trim=30).collect()}
    assert got == {i: t for i, t in whole if t}
    kept = spark.createDataFrame([(1, 0, "one two", "m0"), (1, 1, "three", "m1"), (1, 2, None, "m2")], "document_id int, chunk_index int, text string, metadata string")
    row = chunking.reassemble(kept, trim=10).first()
    assert row["text"] == "one two\nthree\n" and row["metadata"] == "m0" and row["n_chunks"] == 3


def test_extract_asks_bad_rows_again(spark, tmp_path):
    schema = {"type": "object", "properties": {"n": {"type": "integer", "maximum": 5}}, "required": ["n"]}

    def answer(prompts):
        def one(p):
            text, _, wrong = p.partition("\nThe last answer broke these rules: ")
            word = text.rpartition("\n")[2]
            with open(f"{tmp_path}/asked", "a") as out:
                out.write(f"{word}\n")
            return {"good": '{"n": 1}', "late": '{"n": 2}' if wrong == "n: maximum" else '{"n": 9}', "never": "no"}.get(word, "{}")

        return prompts.map(one)

    docs = spark.createDataFrame([("1", "good"), ("2", "late"), ("3", "never"), ("4", None)], "document_id string, text string").coalesce(1)
    good, bad = metadata.extract(docs, schema, answer, tries=3, strict=False)
    assert sorted((r["document_id"], r["metadata"], r["attempts"]) for r in good.collect()) == [("1", '{"n": 1}', 1), ("2", '{"n": 2}', 2)]
    assert sorted((r["document_id"], r["attempts"], r["broken"]) for r in bad.collect()) == [("3", 3, ["unreadable"]), ("4", 3, ["n: required"])]
    good.count(), bad.count()
    assert Counter(open(f"{tmp_path}/asked").read().split("\n")) >= Counter({"good": 1, "late": 2, "never": 3})
    assert Counter(open(f"{tmp_path}/asked").read().split("\n"))["good"] == 1
    none, errors = metadata.extract(docs.where("false"), schema, answer)
    assert none.count() == 0 and errors.count() == 0


def test_odd_metadata_keys(spark):
    keys = ["a.b", "a b", "it's", 'say "x"', "back\\slash", "why?", "plain"]
    rows = spark.createDataFrame([(json.dumps({k: f"v{n}" for n, k in enumerate(keys)} | {"list's": ["p", "q"]}),), (None,), ("{}",), ("[1]",)], "metadata string")
    got = rows.select(*[fl.meta(k).alias(f"c{n}") for n, k in enumerate(keys)], fl.meta_contains("list's", "q").alias("has")).collect()
    assert list(got[0]) == [f"v{n}" for n in range(len(keys))] + [True]
    assert all(x is None for r in got[1:] for x in list(r)[:-1])


def test_filter_examples_run(spark):
    schema = {"type": "object", "properties": {"author": {"type": "array"}, "date": {"type": "integer"}, "keywords": {"type": "array"}, "it's": {"type": "string"}, "ok": {"type": "boolean"}, "x": {"type": "object"}}}
    rows = spark.createDataFrame([(json.dumps({"author": ["John Doe"], "date": 2021, "keywords": ["neural networks", "optimization"], "it's": "value", "ok": True, "x": {}}),)], "metadata string")
    found = {(r["property"], r["example"]): r["matches"] for r in metadata.example_matches(metadata.filter_examples(spark, schema), rows).collect()}
    per = Counter(p for p, _ in found)
    assert per == {"author": 5, "date": 4, "keywords": 6, "it's": 2, "ok": 1, "x": 1, "*": 1}
    assert sum(n for (p, _), n in found.items() if p == "date") == 2
    assert sum(n for (p, e), n in found.items() if p == "keywords" and "size(" in e and "neural" in e) == 1
    assert sum(n for (p, _), n in found.items() if p in ("it's", "ok", "x")) == 4


# --- streams


def test_ingest_restarts_in_the_middle(spark, tmp_path, monkeypatch):
    schema = "document_id string, source string, text string"

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        docs = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ingest.stream_ingest(docs, f"{tmp_path}/col", f"{tmp_path}/check").awaitTermination()

    def stored():
        return sorted((r["source"], r["document_id"]) for r in spark.read.parquet(f"{tmp_path}/col").collect())

    store.write_collection(store.prepare_rows(spark.createDataFrame([("0", "s0", "was there", 0)], f"{schema}, chunk_index int")).withColumn("ingest", F.lit("before")), f"{tmp_path}/old")
    spark.read.parquet(f"{tmp_path}/old").write.partitionBy("ingest", "partition").parquet(f"{tmp_path}/col")
    put("a", [("1", "s1", "one"), ("2", "s2", "two"), ("9", "s0", "again"), ("5", None, "no source"), ("6", "s6", None)])
    run()
    assert stored() == [("s0", "0"), ("s1", "1"), ("s2", "2")]
    put("b", [("3", "s3", "three"), ("1", "s1", "one")])
    real, calls = ingest.prepare_rows, []

    def fails(rows):
        calls.append(1)
        raise RuntimeError("lost in the middle")

    monkeypatch.setattr(ingest, "prepare_rows", fails)
    with pytest.raises(Exception, match="lost in the middle"):
        run()
    monkeypatch.setattr(ingest, "prepare_rows", real)
    put("a2", [("1", "s1", "one"), ("2", "s2", "two")])  # a repeated file
    put("c", [("4", "s2", "late"), ("7", "s7", "seven"), ("8", "s7", "seven too")])
    run()
    assert calls and stored() == [("s0", "0"), ("s1", "1"), ("s2", "2"), ("s3", "3"), ("s7", "7")]
    run()
    assert len(stored()) == 5


def test_search_stream_follows_the_snapshot(spark, tmp_path):
    rows = lambda *texts: spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "id long, text string, partition string")
    ask = lambda n, text: spark.createDataFrame([(n, text)], "query_id int, text string").coalesce(1).write.parquet(f"{tmp_path}/q/{n}")
    root, opened = f"{tmp_path}/store", []

    def run():
        asked = spark.readStream.schema("query_id int, text string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/q")
        query = ingest.stream_search(asked, root, f"{tmp_path}/out", f"{tmp_path}/check", 2)
        query.awaitTermination()
        opened.append(query.kept.opened)

    first = store.write_snapshot(rows("alpha", "beta"), root)
    ask(1, "alpha"), ask(2, "beta")
    run()
    second = store.write_snapshot(rows("gamma", "alpha alpha"), root)
    ask(3, "alpha")
    run()
    got = {r["query_id"]: (r["id"], r["version"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: (0, first), 2: (1, first), 3: (1, second)}
    assert opened == [1, 1]  # two batches, one opening
