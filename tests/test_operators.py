import base64
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import filters as fl
from corpusloom.functions import text as tx
from corpusloom.operators import access, chunking, conversation, conversion, evaluation, metadata, mining, search, shaping, store
from corpusloom.sources import files
from corpusloom.streaming import ingest


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_")).select(column.alias("x")).first()["x"]


# --- chunking


def test_chunks_of_short_and_blank_texts():
    assert chunking.cut_points("Short text", 100, 10, True, 5) == ["Short text"]
    assert chunking.cut_points("  padded ", 100, 10, True, 5) == ["  padded "]
    assert chunking.cut_points(" \n\t", 100, 10, True, 5) == []


def test_chunk_boundaries():
    text = "a" * 40 + "\n\n" + "b" * 100
    assert chunking.cut_points(text, 60, 0, True, 10)[0] == "a" * 40
    text = "x" * 30 + ". " + "y" * 100
    assert chunking.cut_points(text, 60, 0, True, 10)[0] == "x" * 30 + "."
    assert [len(c) for c in chunking.cut_points("z" * 3000, 1000, 200, True, 100)] == [1000, 1000, 1000, 600]


def test_short_piece_joins_the_one_before():
    text = "a" * 50 + "\n\nbb\n\n" + "c" * 100
    assert chunking.cut_points(text, 55, 0, True, 20)[0] == "a" * 50 + " bb"


def test_chunk_size_holds(spark):
    df = spark.createDataFrame([("d", "word " * 1000), ("e", None)], "document_id string, text string")
    got = chunking.chunk_text(df, 300, 50).collect()
    assert {r["document_id"] for r in got} == {"d"} and [r["chunk_index"] for r in got] == list(range(len(got)))
    assert max(len(r["text"]) for r in got) <= 300
    with pytest.raises(ValueError):
        chunking.chunk_text(df, 0)


# --- text


def test_cleaning(spark):
    assert one(spark, tx.join_paragraph_lines(F.lit("a\r\nb , c\n\nd"))) == "a b, c\n\nd"
    assert one(spark, tx.truncate_marked(F.lit("abc   def"), 5)) == "abc\n\n[truncated]"
    assert one(spark, tx.split_groups(F.lit("a, b  c,,"))) == ["a", "b", "c"]
    assert one(spark, tx.parse_groups(F.lit('["x","y"]'))) == ["x", "y"]
    assert one(spark, tx.parse_groups(F.lit('"x"'))) == ["x"] and one(spark, tx.parse_groups(F.lit(" "))) == ["public"]
    assert one(spark, tx.parse_questions(F.lit('```json\n["a?", "b?"]\n```'), 1)) == ["a?"]
    assert one(spark, tx.parse_questions(F.lit("1. what?\nno\nwhy?"), 5)) == ["1. what?", "why?"]
    assert one(spark, tx.html_text(F.lit("<p>a &amp; b</p><script>x</script><div>c</div>"))) == "a & b\nc"
    assert one(spark, tx.snippet(F.lit("x" * 400 + " needle"), F.array(F.lit("absent"), F.lit("needle")))).endswith("needle")


# --- conversion


def test_images_round(spark):
    tag = lambda kind, data: f"![i](data:image/{kind};base64,{base64.b64encode(data).decode()})"
    docs = spark.createDataFrame([("a", f"x {tag('JPEG', b'one')} y {tag('svg+xml', b'two')}{tag('jpg', b'one')}"), ("b", "none"), ("c", None)], "document_id string, markdown string")
    images = conversion.extract_images(docs)
    assert sorted(r["ext"] for r in images.collect()) == ["jpg", "jpg", "svg"]
    unique = conversion.distinct_images(images)
    assert unique.count() == 2
    only = conversion.describe_images(unique.where("ext = 'jpg'"))
    got = {r["document_id"]: r["markdown"] for r in conversion.replace_images(docs, only).collect()}
    assert got == {"a": f"x *[Image (jpg), 3 bytes]* y {tag('svg+xml', b'two')}*[Image (jpg), 3 bytes]*", "b": "none", "c": None}


def test_convert_counts_failures(spark):
    def up(s):
        if (s == "bad").any():
            raise ValueError("no")
        return s.str.upper()

    got = {r["content"]: (r["markdown"], r["error"]) for r in conversion.convert(spark.createDataFrame([("ok",), ("bad",)], "content string"), up).collect()}
    assert got["ok"] == ("OK", None) and got["bad"][0] is None and "no" in got["bad"][1]


# --- metadata

SCHEMA = {"type": "object", "properties": {"title": {"type": "string", "maxLength": 5}, "tags": {"type": "array", "maxItems": 2}, "year": {"type": "integer", "minimum": 1900}, "kind": {"type": "string", "enum": ["a", "b"]}}, "required": ["title", "tags"]}


@pytest.mark.parametrize("given, want", [({"title": "T", "tags": "x", "extra": 1}, {"title": "T", "tags": ["x"]}), ({"tags": None}, {"title": "Unknown", "tags": []}), ({"title": 3, "tags": ["p"], "year": 2000}, {"title": "3", "tags": ["p"], "year": 2000})])
def test_enforce(spark, given, want):
    assert json.loads(one(spark, metadata.enforce(F.lit(json.dumps(given)), SCHEMA))) == want


def test_violations(spark):
    bad = json.dumps({"title": "too long", "tags": ["1", "2", "3"], "year": 1800, "kind": "c"})
    assert one(spark, metadata.violations(F.lit(bad), SCHEMA)) == ["title: maxLength", "tags: maxItems", "year: minimum", "kind: enum"]
    assert one(spark, metadata.violations(F.lit('{"title": "t", "tags": []}'), SCHEMA)) == []
    assert one(spark, metadata.violations(F.lit('{"title": "t", "tags": [], "year": "x"}'), SCHEMA)) == ["year: type"]


def test_json_reading(spark):
    assert json.loads(one(spark, metadata.coerce_json(F.lit('```json\n{"a": 1}\n```')))) == {"a": 1}
    assert json.loads(one(spark, metadata.coerce_json(F.lit('so {"a": 1} yes')))) == {"a": 1}
    assert one(spark, metadata.coerce_json(F.lit("nothing"))) is None
    assert one(spark, metadata.sanitize(F.lit("[1]"))) == "{}"
    assert json.loads(one(spark, metadata.override(F.lit('{"a": "1", "b": "2"}'), F.lit('{"b": "3"}')))) == {"a": "1", "b": "3"}
    with pytest.raises(ValueError):
        metadata.check_schema({"type": "array"})
    assert metadata.filter_examples(spark, SCHEMA).count() == 11


# --- search and fusion


def test_rrf_ties_and_empty_ranking(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 10, 2)], "query_id int, id int, rank int")
    got = search.rrf_fuse([a, b, a.where("false")], 10).orderBy("rank").collect()
    assert [r["id"] for r in got] == [10, 20] and got[0]["rrf_score"] == pytest.approx(1 / 101 + 1 / 102)


def test_vectors_without_embedding_are_skipped(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 0.1])], "id int, text_embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id int, embedding array<float>")
    assert [(r["query_id"], r["id"]) for r in search.cosine_topk(q, v, 2).orderBy("rank").collect()] == [(7, 1), (7, 4)]
    assert [r["id"] for r in search.l2_topk(q, v, 3).orderBy("rank").collect()] == [1, 4, 2]


def test_approximate_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("text_embedding"))
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("text_embedding").alias("embedding"))
    celled, centres = search.build_cells(v, 12)
    near = {(r[0], r[1]) for r in search.approx_cosine_topk(q, celled, centres, 10).select("query_id", "id").collect()}
    exact = {(r[0], r[1]) for r in search.cosine_topk(q, v, 10).select("query_id", "id").collect()}
    assert len(near & exact) >= 0.9 * len(exact)


def test_embedding_is_deterministic_and_unit(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "text string")
    got = [np.array(r["text_embedding"]) for r in search.embed(df).collect()]
    assert np.linalg.norm(got[0]) == pytest.approx(1, abs=1e-6) and not got[1].any() and not got[2].any()
    own = search.embed(df, fn=lambda s: pd.Series([[1.0]] * len(s))).collect()
    assert own[0]["text_embedding"] == [1.0]


def test_bm25_on_an_empty_table(spark):
    q = spark.createDataFrame([(1, "a")], "query_id int, text string")
    assert search.bm25_topk(q, spark.createDataFrame([], "id int, text string"), 5).count() == 0


def test_request_helpers(spark):
    assert one(spark, search.first_query(F.array(F.lit(" "), F.lit("b")))) == "b"
    assert one(spark, search.legacy_score(F.lit(0.25))) == 0.75 and one(spark, search.legacy_score(F.lit(2.0))) == 0.0
    r = spark.createDataFrame([(None, ["t"], [" a ", ""]), ("c", [], None), ("c", ["x", None], None)], "collection string, texts array<string>, filters array<string>")
    got = fl.normalise_requests(r, "main").collect()
    assert (got[0]["collection"], got[0]["filters"], got[0]["error"]) == ("main", ["a"], None)
    assert got[1]["error"] == "texts are required" and got[2]["error"] == "texts must be strings"
    assert search.dedupe_best(spark.createDataFrame([(1, 0.5, "x"), (1, 0.2, "y")], "id int, distance double, t string")).first()["t"] == "y"


# --- shaping, evaluation, access


def test_security_of_nobody(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, []), (3, None)], "id int, security_group array<string>")
    assert df.where(fl.visible_to([])).count() == 0 and df.where(fl.visible_to(["a", "b"])).count() == 1


def test_groups(spark):
    g = lambda level, groups: one(spark, access.effective_groups(F.lit(level), groups, F.lit("me")))
    assert g("private", F.array(F.lit("x"))) == ["me"] and g("group_only", F.array(F.lit("x"), F.lit("me"))) == ["x", "me"] and g("admin", F.array(F.lit("x"))) == ["admin", "me"]
    users = spark.createDataFrame([("u", ["a"]), ("v", [])], "user string, roles array<string>")
    cols = spark.createDataFrame([("c", ["a", "b"]), ("d", [])], "collection string, security_group array<string>")
    assert [tuple(r) for r in access.may_write(users, cols).collect()] == [("u", "c")]
    assert access.required_roles(spark.createDataFrame([("a",)], "role string"), cols).first()["roles"] == ["a"]


def test_metrics_by_hand(spark):
    placed = spark.createDataFrame([(1, 1), (2, 3), (3, None), (4, 100)], "query_id int, placement int")
    got = {(r["metric"], r["k"]): r["value"] for r in evaluation.metrics(placed).collect()}
    assert got["mrr", 0] == pytest.approx((1 + 1 / 3 + 0.01) / 4) and got["recall", 5] == 0.5 and got["hit_rate", 100] == 0.75
    assert got["ndcg", 5] == pytest.approx((1 + 1 / 2) / 4) and got["found", 0] == 3 and got["median_placement", 0] == 3
    none = {r["metric"]: r["value"] for r in evaluation.metrics(placed.where("placement is null")).where("k = 0").collect()}
    assert none["mrr"] == 0 and none["std_placement"] == 0
    assert evaluation.placement_histogram(placed).count() == 3 and evaluation.results_json(evaluation.metrics(placed)).count() == 11


def test_citations_once(spark):
    c = spark.createDataFrame([(1, 0, "d"), (1, 1, "d"), (2, 0, "d")], "conv_id int, turn int, document_id string")
    assert shaping.cite_once(c).count() == 2
    assert shaping.histogram(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").first()["n"] == 2


# --- mining, conversations


def test_mining(spark):
    assert one(spark, mining.function_names(F.lit("def my_fn and call(x) process"))) == ["my_fn", "call", "process"]
    assert one(spark, mining.code_patterns(F.lit("use `a` and f(x)"))) == ["a", "f(x)"]
    assert one(spark, mining.classify_query(F.lit("How to fix an ERROR"))) == "debugging"
    hits = spark.createDataFrame([("q", 1, "function f_a(x)\nimport os\nexample", "s", 0), ("q", 2, "the cause; a fix to avoid", "t", 1)], "query_id string, rank int, text string, source string, chunk_index int").withColumn("function_name", F.lit("g"))
    api = mining.api_relations(hits).first()
    assert api["related_functions"] == ["f_a(x"] and api["dependencies"] == ["import os"] and len(api["usage_examples"]) == 1
    debug = mining.debug_context(hits).first()
    assert debug["likely_causes"] == debug["solutions"] == debug["prevention_tips"] == ["the cause; a fix to avoid"] and debug["related_issues"][0] == "s (chunk 0)"


def test_message_forms(spark):
    rows = [(1, "user", '"hi \\"x\\""'), (2, "user", '[{"type": "text", "text": "t"}, {"type": "image_url", "image_url": {"url": "u"}}]'), (3, "user", None), (4, "robot", '"x"'), (5, "user", '[{"type": "odd"}]'), (6, "user", "12")]
    got = {r["turn"]: r for r in conversation.normalise_messages(spark.createDataFrame(rows, "turn int, role string, content string")).collect()}
    assert got[1]["parts"][0]["text"] == 'hi "x"' and [p["url"] for p in got[2]["parts"]] == [None, "u"] and got[3]["parts"] == []
    assert [got[i]["error"] for i in range(1, 7)] == [None, None, None, "unknown role", "unknown part", "unreadable content"]


def test_routing(spark):
    a = spark.createDataFrame([(1, 'x {"selected": "zz", "fallbacks": ["b", "a", "c"], "queries": ["p", " ", "q", "r", "s"]}', "Q"), (2, "no", "Q")], "conv_id int, answer string, question string")
    got = {r["conv_id"]: r for r in conversation.route(a, ["a", "b", "c"]).collect()}
    assert (got[1]["selected"], got[1]["fallbacks"], got[1]["queries"]) == ("a", ["b", "c"], ["p", "q", "r"]) and got[2]["queries"] == ["Q"]


# --- store, sources, streams


def test_upsert_takes_the_last_of_a_batch(spark):
    old = spark.createDataFrame([("d", 0, "old"), ("e", 0, "same")], "source string, chunk_index int, text string")
    new = spark.createDataFrame([("d", 0, "first", 1), ("d", 0, "last", 2), ("f", 0, "new", 3)], "source string, chunk_index int, text string, n int")
    assert sorted(r["text"] for r in store.upsert(old, new, "n").collect()) == ["last", "new", "same"]
    c = store.upsert_counts(old, new).first()
    assert (c["inserted"], c["updated"]) == (1, 1)


def test_collections_on_disk(spark, tmp_path):
    rows = store.prepare_rows(spark.createDataFrame([("d", 0, "t", "p"), ("e", 0, "u", None)], "source string, chunk_index int, text string, partition string"))
    store.write_collection(rows, f"{tmp_path}/c")
    assert store.load_collection(spark, f"{tmp_path}/c", "p").count() == 1 and store.load_collection(spark, f"{tmp_path}/c").count() == 2
    store.write_snapshot(rows, f"{tmp_path}/s"), store.write_snapshot(rows.where("partition = 'p'"), f"{tmp_path}/s")
    assert store.load_snapshot(spark, f"{tmp_path}/s").count() == 1
    left, found = store.delete_chunks(rows, rows.select("id").limit(1), ["public"])
    assert left.count() == 1 and found.first()["found"]
    assert store.delete_chunks(rows, rows.select("id"), [])[0].count() == 2
    cat = spark.createDataFrame([("a", '{"collection_config_json": {"collection_name": "old", "chunk_size": 5}}'), ("b", "broken")], "collection string, description string")
    got = {r["collection"]: r["config"] for r in store.collection_config(cat).collect()}
    assert json.loads(got["a"]) == {"collection_name": "a", "chunk_size": 5} and got["b"] is None
    assert store.pipeline_catalogue(spark.createDataFrame([("n", '{"chunk_size": 9}')], "name string, config string")).first()["chunk_size"] == 9


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("a")
    (tmp_path / "in" / "deep" / "b.txt").write_text("b")
    docs = files.read_documents(spark, f"{tmp_path}/in")
    assert docs.count() == 2 and docs.select("document_id").distinct().count() == 2 and files.discover_files(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "qa.json").write_text(json.dumps([{"question": "q", "answer": "a", "users": ["u"]}]))
    got = files.read_json_records(spark, f"{tmp_path}/qa.json", "qa").first()
    assert got["text"] == "Question: q\n\nAnswer: a\n\nContext: " and json.loads(got["metadata"])["users"] == ["u"]
    ran = []
    stage = lambda df: ran.append(df.count()) or df
    files.checkpoint_stage(docs, f"{tmp_path}/stage", stage)
    assert files.checkpoint_stage(docs, f"{tmp_path}/stage", stage).count() == 2 and ran == [2, 0]


def test_streams_equal_batches(spark, tmp_path):
    docs = spark.createDataFrame([("1", "s1", "alpha beta"), ("2", "s2", "gamma")], "document_id string, source string, text string")
    docs.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    for check in ("c1", "c2"):  # the second run meets only stored sources
        ingest.stream_ingest(stream(), f"{tmp_path}/col", f"{tmp_path}/{check}").awaitTermination()
    stored = spark.read.parquet(f"{tmp_path}/col")
    assert sorted(r["text"] for r in stored.collect()) == ["alpha beta", "gamma"]
    spark.createDataFrame([(1, "beta")], "query_id int, text string").write.parquet(f"{tmp_path}/q")
    asked = spark.readStream.schema("query_id int, text string").parquet(f"{tmp_path}/q")
    store.write_snapshot(stored, f"{tmp_path}/store")
    ingest.stream_search(asked, f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/c3").awaitTermination()
    batch = search.bm25_topk(spark.read.parquet(f"{tmp_path}/q"), stored, 10)
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [r["id"] for r in batch.collect()]


def test_expected_source_is_the_first_of_all_holders(spark, tmp_path):
    from corpusloom.plans import queries

    item, brief = "one two three four five six seven eight nine ten", "zeta eta"
    # the first holder is long, so over 100 shorter ones rank before it; its item is joined to other characters
    texts = [(1, f"none {brief}"), (2, "filler words " * 2000 + f"x{item}y"), *[(i, item) for i in range(3, 153)]]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, brief), (3, "held by no document of them all here at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["query_id"]: r["expected_source"] for r in queries._expected(spark, str(tmp_path)).collect()}
    assert got == {1: "2", 2: "1", 3: "-1"}
