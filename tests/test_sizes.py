"""What a task holds, sends or reads for a step, on inputs where a larger table would show."""

import glob
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from corpusloom.operators import blocks, cells, conversion, postings, search, tables
from corpusloom.plans import queries as own

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_groups_of_wide_rows_are_bounded(spark, tmp_path):
    rows = spark.range(60, numPartitions=1).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(50_000)), lambda i: F.hash(i, "id").cast("string")), " ").alias("text"))
    for at, write in (("cut", lambda: tables.cut_at(rows)[1]), ("kept", lambda: postings.write(rows, f"{tmp_path}/kept") or f"{tmp_path}/kept")):
        groups = [pq.ParquetFile(p).metadata.row_group(i).total_byte_size for p in glob.glob(f"{write()}/*.parquet") for i in range(pq.ParquetFile(p).metadata.num_row_groups)]
        assert len(groups) > 1 and max(groups) < 24 << 20, (at, groups)


def _peak(state, queries: pa.Table, block: dict) -> int:
    tracemalloc.start()
    for _ in state.add(0, queries, block):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_scores_of_few_queries_are_held_at_once():
    r = np.random.default_rng(0)
    lists = lambda n: pa.array(list(r.normal(size=(n, 8)).astype(np.float32)), pa.list_(pa.float32()))
    asked, ids = lists(4_096), pa.array(range(8_192), pa.int64())
    block = pa.table({"id": ids, "v": lists(8_192)})
    for metric in ("cosine", "l2"):
        assert _peak(search._Nearest(10, metric), pa.table({"query_id": ids[:4_096], "embedding": asked}), {"block": block}) < 64 << 20
    codes = pa.table({"id": ids, "home": pa.array([0] * 8_192, pa.int32()), "code": pa.array([bytes(8)] * 8_192, pa.binary())})
    assert _peak(cells._FirstPass(10), pa.table({"query_id": ids[:4_096], "q": asked}), {"block": codes}) < 64 << 20


def test_nearest_over_blocks_like_brute_force():
    r = np.random.default_rng(1)
    X = (np.round(r.normal(size=(900, 6)) * 8) / 8).astype(np.float32)
    X[::9] = X[4]  # many equal rows
    X[5], X[7, 2] = 0, np.nan
    table = lambda at, name, m: pa.table({name: pa.array(at, pa.int64()), "embedding" if name == "query_id" else "v": pa.array(list(m), pa.list_(pa.float32()))})
    for metric in ("cosine", "l2"):
        state, found = search._Nearest(5, metric), []
        for at in range(0, 900, 300):
            for rows in state.add(0, table(range(100), "query_id", X[:100]), {"block": table(range(at, at + 300), "id", X[at : at + 300])}):
                found += zip(rows["query_id"].to_pylist(), (-rows["s"]).tolist(), rows["id"].to_pylist())
        x = X.astype(np.float64)
        n = np.linalg.norm(x, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            s = np.where(n[:100, None] * n == 0, 0, x[:100] @ x.T / (n[:100, None] * n)) if metric == "cosine" else -((x[:100, None] - x) ** 2).sum(2)
        for q in range(100):
            best = sorted((-round(v, 9) + 0.0, i) for i, v in enumerate(s[q]) if not np.isnan(v))[:5]
            got = sorted((round(a, 7) + 0.0, i) for b, a, i in found if b == q)[:5]
            assert [i for _, i in got] == [i for _, i in sorted((round(v, 7) + 0.0, i) for v, i in best)], (metric, q)


def test_probed_cells_meet_as_blocks(spark):
    v, q = own._vectors(spark, SF)
    celled, centres = search.build_cells(v, 16)
    found = search.approx_cosine_topk(q, celled, centres, 10)
    assert "MapInArrow" in plan(found) and "zip_with" not in plan(found)
    assert {r["id"] for r in found.where("rank = 1").collect()} == {r["query_id"] for r in q.collect()}


def test_a_shared_image_is_no_hot_key(spark, monkeypatch):
    docs = own._with_image(spark, SF)
    run = lambda: conversion.replace_images(docs, conversion.describe_images(conversion.distinct_images(conversion.extract_images(docs))))
    few = run()
    assert "BroadcastHashJoin [hash" in plan(few)
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 0)
    many = run()
    assert "_salt" in plan(many)
    assert sorted(few.collect()) == sorted(many.collect())


def test_postings_are_counted_where_texts_lie(spark):
    found = plan(search.build_postings(own.documents(spark, SF)))
    assert "hashpartitioning(id" in found and "hashpartitioning(term" not in found


def test_hits_are_sent_to_the_chunks(spark):
    found = plan(own._hits(spark, SF))
    assert "BroadcastHashJoin" in found and "SortMergeJoin" not in found


def test_rows_of_light_terms_alone_are_not_scored(spark):
    names = [str(i) for i in range(200)]
    lists = pa.array([["common"] + (["rare"] if i < 3 else [n]) for i, n in enumerate(names)])
    one = postings._range(pa.array(range(200), pa.int64()), lists, None)
    other = postings._range(pa.array(range(200, 400), pa.int64()), pa.array([["common", "x" + n] for n in names]), None)
    third = postings._range(pa.array(range(400, 600), pa.int64()), pa.array([["common", "mid" if i == 0 else "x" + n] for i, n in enumerate(names)]), None)
    shape = postings.blocks.arrow_schema("number long, n long, tokens long, ids array<long>, dls array<int>, terms array<string>, counts array<int>, most array<int>, least array<int>, rows array<int>, tfs array<int>")
    row = lambda r: pa.RecordBatch.from_arrays([pa.array([({"number": 0} | r)[f.name]], f.type) for f in shape], schema=shape)
    asked = pa.table({"query_id": pa.array([1]), "terms": pa.array([["common", "mid", "rare"]]), "idfs": pa.array([[0.1, 1.0, 5.0]])})
    scored = []

    class Counted(postings.Scores):
        @staticmethod
        def _sums(at, by, rows, weights, ends, counts, least):
            scored.append(sum(counts[t] for t in at))
            return postings.Scores._sums(at, by, rows, weights, ends, counts, least)

    state = Counted(3, 2.0, 1.2, 0.75)
    for r in (one, other, third):
        list(state.add(7, asked, row(r)))
    assert sum(scored) <= 203 + 1
    assert [i for _, i in state.best[7][0]] == [0, 1, 2]


def test_blocks_meet_large_query_tables_in_few_parts(spark, monkeypatch):
    rows = spark.range(400).select("id", F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("v"))
    asked = blocks.pack(rows.select(F.col("id").alias("query_id"), F.col("v").alias("embedding")).repartition(40))
    size = tables.measured_bytes(asked)
    monkeypatch.setattr(tables, "BROADCAST_BYTES", size // 3)
    met = blocks.meet(tables.cut(asked), tables.cut(blocks.pack(rows)), lambda: search._Nearest(2, "l2"), "query_id long, id long, s double")
    assert max(map(int, re.findall(r"pmod\(xxhash64\(number#\d+L?, 42\), (\d+)\)", plan(met)))) <= 4
    assert met.where("query_id = id and s > -1e-9").count() == 400


def test_ingest_state_is_called_for_groups_of_sources(spark, tmp_path):
    """state was asked and written for every source; and of several documents of a source in one batch the least id came first only within an Arrow batch."""
    import pandas as pd

    from corpusloom.streaming import ingest

    class State:
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls, self.held = self.calls + 1, value

    one = ingest.FirstOfSource(["document_id", "source"])
    one.seen = State()
    one.handleInitialState((0,), pd.DataFrame({"source": ["s0", "s1"]}), None)
    parts = [pd.DataFrame({"document_id": [f"{b}{i:03}" for i in range(2, 500)], "source": [f"s{i}" for i in range(2, 500)]}) for b in "ba"]
    got = pd.concat(one.handleInputRows((0,), iter([*parts, pd.DataFrame({"document_id": ["0"], "source": ["s1"]})]), None))
    assert sorted(got["document_id"]) == [f"a{i:03}" for i in range(2, 500)] and one.seen.calls == 4
    assert not list(one.handleInputRows((0,), iter(parts), None)) and len(one.seen.held[0]) == 500

    docs = spark.range(300).selectExpr("cast(id as string) as document_id", "concat('s', id % 200) as source", "'some words' as text")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    for check in ("c1", "c2"):
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        ingest.stream_ingest(stream, f"{tmp_path}/col", f"{tmp_path}/{check}").awaitTermination()
    stored = spark.read.parquet(f"{tmp_path}/col")
    assert stored.count() == 200 and stored.select("source").distinct().count() == 200


def test_bpe_asks_only_for_pairs_that_merges_make():
    """op4_bpe: words were indexed pair by pair in Python, and each token of a document was looked up by itself; now only pairs that a merge makes are asked for one by one."""
    import public_tokenizers

    from corpusloom.llm import bpe

    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

    one = bpe.Encoder(bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    one.merge = Counted(one.merge)
    words = [f"{a}{b}aaaa{b}" for a in "abcdefgh" for b in "xyz"]
    one.prepare([" ".join(words), words[0]])
    merges = sum(len(w) - one.pieces[w][2] for w in words)
    assert len(one.pieces) == len(words) and 0 < one.merge.asked <= 2 * merges
    assert all(n == len(ids.split()) and tokens.replace(" ", "") == f"{w}</w>" for w, (ids, tokens, n) in one.pieces.items())


def test_dropped_lines_are_sent_as_few_bytes(spark):
    """op10_line_dedup: 32 measured bytes for each dropped line made the texts of a half-gigabyte table be shuffled to their lists."""
    from corpusloom.llm import line_dedup

    lists = spark.range(2000).selectExpr("id as doc_id", "transform(sequence(0, 39), x -> struct(cast(x as int) as line, x % 3 = 0 as near)) as drops")
    small = tables.measured_bytes(line_dedup.packed(lists))
    assert small * 8 < tables.measured_bytes(lists)
    texts = spark.createDataFrame([(i, "\n".join(f"w{k}" for k in range(50))) for i in range(3)], "doc_id long, text string")
    kept = line_dedup.apply(texts, lists.where("doc_id < 2")).orderBy("doc_id").collect()
    assert [r["text"].split("\n")[0] for r in kept] == ["w40", "w40", "w0"] and [len(r["text"].split("\n")) for r in kept] == [10, 10, 50]


def _range_row(first: int, lists: list[list[str]]) -> pa.RecordBatch:
    shape = blocks.arrow_schema("number long, n long, tokens long, ids array<long>, dls array<int>, terms array<string>, counts array<int>, most array<int>, least array<int>, rows array<int>, tfs array<int>")
    one = {"number": first} | postings._range(pa.array(range(first, first + len(lists)), pa.int64()), pa.array(lists), None)
    return pa.RecordBatch.from_arrays([pa.array([one[f.name]], f.type) for f in shape], schema=shape)


def test_few_rows_are_scored_exactly(monkeypatch):
    """Common words in all rows: only rows near a query's k-th score are looked up, and the best are those of brute force."""
    r, k = np.random.default_rng(2), 3
    words = [f"w{i}" for i in range(400)]
    share = 1 / (np.arange(400) + 1.0)
    lists = [[*r.choice(words, size=int(r.integers(20, 60)), p=share / share.sum())] for _ in range(3_000)]
    mean, df = np.mean([len(x) for x in lists]), {w: sum(w in x for x in map(set, lists)) for w in words}
    idf = {w: float(np.log1p((3_000 - n + 0.5) / (n + 0.5))) for w, n in df.items() if n}
    asked = [sorted({*r.choice(words, size=25, p=share / share.sum())} & idf.keys(), key=lambda w: (idf[w], w)) for _ in range(40)]
    rare = [max(idf[w] for w in q) for q in asked]
    queries = pa.table({"query_id": pa.array(range(40)), "terms": pa.array(asked), "idfs": pa.array([[idf[w] for w in q] for q in asked]), "least": pa.array(rare)})
    ranges = [_range_row(at, lists[at : at + 1_000]) for at in range(0, 3_000, 1_000)]
    seeds = postings.Seeds(k, mean, 1.2, 0.75)
    for one in ranges:
        list(seeds.add(0, queries, one))
    floor = seeds.best[0][:, k - 1]
    looked, whole = [], postings._Met.looked_up
    monkeypatch.setattr(postings._Met, "looked_up", lambda self, rows, *rest: looked.append(len(rows)) or whole(self, rows, *rest))
    state = postings.Scores(k, mean, 1.2, 0.75)
    for one in ranges:
        list(state.add(0, queries.append_column("floor", pa.array(floor - 2e-6)), one))
    counts = [{w: x.count(w) for w in set(x)} for x in lists]
    for q, terms in enumerate(asked):
        scores = [round(sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in terms if w in c), 6) for x, c in zip(lists, counts)]
        best = sorted((-s, i) for i, s in enumerate(scores))[:k]
        assert [i for _, i in state.best[0][q]] == [i for _, i in best] and floor[q] <= -best[-1][0] + 2e-6
    assert sum(looked) < 40 * 3_000 // 20


def test_ranges_are_not_shuffled_for_many_queries(spark, monkeypatch):
    """Queries beyond the limit of what is sent meet the ranges part by part; no range is copied for a part of them."""
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} common") for i in range(300)], "id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} common {i}") for i in range(40)], "query_id int, text string")
    want = sorted(search.bm25_topk(asked, docs, 4).collect())
    plans, whole, packed = [], blocks.meet, blocks.pack_queries
    monkeypatch.setattr(blocks, "pack_queries", lambda queries: packed(queries, most=4))
    monkeypatch.setattr(blocks, "meet", lambda *given, **more: plans.append(plan(df := whole(*given, **more))) or df)
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 6_000)
    got = sorted(search.bm25_topk(asked, docs, 4).collect())
    assert got == want and len(got) == 160
    assert len(plans) > 2 and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)


def test_queries_of_the_same_terms_are_searched_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} common") for i in range(100)], "id long, text string")
    asked = spark.createDataFrame([(i, f"w{i % 3} Common, common other{i}") for i in range(60)], "query_id int, text string")
    sizes, whole = [], blocks.pack_queries
    monkeypatch.setattr(blocks, "pack_queries", lambda queries: sizes.append(queries.count()) or whole(queries))
    got = {}
    for q, i, rank in sorted((r["query_id"], r["id"], r["rank"]) for r in search.bm25_topk(asked, docs, 4).collect()):
        got.setdefault(q, []).append(i)
    assert set(sizes) == {3} and len(got) == 60
    assert all(got[q] == got[q % 3] and len(got[q]) == 4 for q in got)
