"""Registered queries that each apply one operator to the given tables, with the same results in SQL."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.functions import filters as fl
from corpusloom.functions import text as tx
from corpusloom.operators import access, chunking, conversation, conversion, evaluation, metadata, mining, search, shaping, store
from corpusloom.plans import queries as own
from corpusloom.plans.queries import CHUNKS, TOKENS, _bm25_sql, _vectors, chunks, documents, questions, table
from corpusloom.sources import files

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _rrf_sql(lists: str, k: int, by: str = "query_id") -> str:
    return f"SELECT {by}, id, rrf_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY rrf_score DESC, id) AS rank FROM (SELECT {by}, id, round(sum(1 / (100 + rank)), 9) AS rrf_score FROM ({lists}) GROUP BY ALL)) WHERE rank <= {k}"


def _top_sql(rows: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({rows})) WHERE rank <= {k}"


_COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9)"
_ALL_COS = f"SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0"

# --- vectors and fusion


@query(f"WITH c AS ({_top_sql(_ALL_COS, 10)}), l AS (SELECT query_id // 200 AS request_id, id, rank FROM c) {_rrf_sql('SELECT * FROM l', 10, 'request_id')}")
def v5_dense_fusion(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return search.dense_fusion(q.withColumn("request_id", F.expr("query_id div 200")), v)


@query(f"SELECT query_id, id, round(score, 6) AS score, rank FROM ({_top_sql(_ALL_COS, 10)})")
def v3_approx_in_every_cell(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    celled, centres = search.build_cells(v, 12)
    return search.approx_cosine_topk(q, celled, centres, 10, nprobe=12).withColumn("score", F.round("score", 6))


_EMBEDDED = "ed AS (SELECT doc_id AS id, text, lang, '{\"lang\":\"' || lang || '\"}' AS metadata, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id), q AS (SELECT item_id AS query_id, text, embedding FROM benchmark LEFT JOIN embeddings ON vec_id = item_id)"
_DENSE = f"SELECT a.query_id, b.id, {_COS} AS score FROM q a, ed b WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL"


def _embedded(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("text_embedding"))
    docs = documents(spark, sf_dir).join(v.hint("merge"), "id", "left").withColumn("metadata", F.to_json(F.struct("lang")))
    asked = questions(spark, sf_dir).join(v.select(F.col("id").alias("query_id"), F.col("text_embedding").alias("embedding")).hint("merge"), "query_id", "left")
    return asked, docs


@query(f"WITH {_EMBEDDED}, {_bm25_sql('ed', 'text', 10, '_t')}, {_bm25_sql('ed', 'metadata', 10, '_m')}, hits_d AS ({_top_sql(_DENSE, 10)}) {_rrf_sql('SELECT * FROM hits_d UNION ALL SELECT * FROM hits_t UNION ALL SELECT * FROM hits_m', 10)}")
def r2_three_rankings(spark, sf_dir):
    return search.hybrid_search(*_embedded(spark, sf_dir), 10)


@query(f"WITH q AS (SELECT item_id AS query_id, text FROM benchmark), dd AS (SELECT doc_id AS id, text, lang FROM documents), {_bm25_sql('dd', 'text', 10, '_e', 'lang = ' + chr(39) + 'en' + chr(39))}, {_bm25_sql('dd', 'text', 10, '_f', 'lang = ' + chr(39) + 'fr' + chr(39))}, a AS ({_rrf_sql('SELECT * FROM hits_e', 10)}), b AS ({_rrf_sql('SELECT * FROM hits_f', 10)}) {_rrf_sql('SELECT * FROM a UNION ALL SELECT * FROM b', 5)}")
def r6_search_collections(spark, sf_dir):
    return search.search_collections(questions(spark, sf_dir), documents(spark, sf_dir).withColumn("collection", F.col("lang")), ["en", "fr"], 10, 5)


_MIXED = "m AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN text WHEN item_id % 3 = 1 THEN ' ' END AS text, CASE WHEN item_id % 2 = 0 THEN 'fr' END AS part FROM benchmark), q AS (SELECT query_id, text FROM m WHERE regexp_matches(coalesce(text, ''), '\\S'))"


@query(f"WITH {_MIXED}, {CHUNKS}, {_bm25_sql('chunks', 'text', 5)}, h AS (SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY id) AS rank FROM chunks WHERE chunk_index = 0) SELECT query_id, id, score, rank FROM hits UNION ALL SELECT m.query_id, h.id, 0.0 AS score, h.rank FROM m JOIN h ON h.lang = m.part WHERE h.rank <= 5 AND m.query_id NOT IN (SELECT query_id FROM q)")
def r7_dispatch(spark, sf_dir):
    n = F.col("query_id")
    asked = questions(spark, sf_dir).select("query_id", F.when(n % 3 == 0, F.col("text")).when(n % 3 == 1, F.lit(" ")).alias("text"), F.when(n % 2 == 0, F.lit("fr")).alias("partition"))
    return search.dispatch(asked, chunks(spark, sf_dir), 5)


@query("SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN text ELSE 'second' END AS text FROM benchmark")
def r8_first_query(spark, sf_dir):
    q = questions(spark, sf_dir)
    return q.select("query_id", search.first_query(F.array(F.when(F.col("query_id") % 2 == 0, F.col("text")).otherwise(F.lit(" \n")), F.lit("second"))).alias("text"))


@query("SELECT event_id, CASE WHEN value / 50 <= 1 THEN round(1 - value / 50, 9) ELSE 0 END AS score FROM events")
def r11_legacy_score(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(search.legacy_score(F.col("value") / 50), 9).alias("score"))


@query(f"""WITH q AS (SELECT item_id AS query_id, text FROM benchmark), d AS (SELECT doc_id AS id, {TOKENS.format('text')} AS t FROM documents),
 st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d), qt AS (SELECT DISTINCT query_id, unnest({TOKENS.format('text')}) AS term FROM q),
 p AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
 w AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, st GROUP BY term, n),
 kept AS (SELECT query_id, term, idf FROM (SELECT query_id, term, idf, percent_rank() OVER (PARTITION BY query_id ORDER BY idf, term) AS share FROM qt JOIN w USING (term)) WHERE share >= 0.2)
 {_top_sql('SELECT query_id, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM p JOIN kept USING (term), st GROUP BY query_id, id', 10)}""")
def b5_drop_ratio(spark, sf_dir):
    return search.bm25_topk(questions(spark, sf_dir), documents(spark, sf_dir), 10, drop_ratio=0.2)


# --- filters


@query(f"WITH {CHUNKS} SELECT id, source, 1.0 AS distance, 0.0 AS score FROM chunks WHERE lang IN ('de', 'fr') AND src = 'src3' ORDER BY id LIMIT 100")
def f10_filter_chunks(spark, sf_dir):
    return fl.filter_chunks(chunks(spark, sf_dir), ["de", "fr"], [fl.meta_contains("author", "src3")]).select("id", "source", "distance", "score")


@query(f"WITH {CHUNKS}, s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY id) AS r FROM chunks WHERE lang IN ('en', 'es')) SELECT id, source, lang AS \"partition\" FROM s WHERE r <= 40 ORDER BY id LIMIT 60")
def f12_filter_partitions(spark, sf_dir):
    return fl.filter_partitions(chunks(spark, sf_dir), ["en", "es", "de"], ["en", "es"], per_partition=40, limit=60).select("id", "source", "partition")


@query(f"WITH {CHUNKS} SELECT id, text FROM chunks WHERE id = 20000000 AND lang IN ('en', 'de', 'fr', 'es') UNION ALL SELECT id, text FROM chunks WHERE id = 30000000 AND lang = 'none'")
def f13_get_chunk(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return store.get_chunk(c, 20_000_000, ["en", "de", "fr", "es"]).unionByName(store.get_chunk(c, 30_000_000, ["none"])).select("id", "text")


@query(f"WITH {CHUNKS} SELECT id, chunk_index, text FROM chunks WHERE document_id = '7' AND lang IN ('en', 'de', 'fr', 'es')")
def f14_get_document(spark, sf_dir):
    return store.get_document(chunks(spark, sf_dir), "7", ["en", "de", "fr", "es"]).select("id", "chunk_index", "text")


@query("SELECT DISTINCT source AS name FROM documents WHERE (contains(source, 'rc1') OR contains('of ' || lang, 'fr')) AND lang <> 'en'")
def f17_browse(spark, sf_dir):
    c = documents(spark, sf_dir).select(F.col("author").alias("name"), F.concat(F.lit("OF "), F.upper("lang")).alias("description"), F.when(F.col("lang") == "en", "private").otherwise("public").alias("access_level")).distinct()
    return fl.browse(c, "Rc1", "public").unionByName(fl.browse(c, "FR", "public")).select("name").distinct()


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN lang WHEN doc_id % 3 = 0 THEN source ELSE 'none' END AS given FROM documents")
def f18_with_fallback(spark, sf_dir):
    meta = F.when(F.col("id") % 3 == 0, F.to_json(F.struct(F.col("author").alias("given"))))
    return documents(spark, sf_dir).withColumn("metadata", meta).withColumn("given", F.when(F.col("id") % 2 == 0, F.col("lang"))).select("id", fl.with_fallback("given", "none").alias("given"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'texts are required' WHEN doc_id % 4 = 1 THEN 'texts must be strings' END AS error, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'all' END AS collection, lang || '=1' AS filters FROM documents")
def f19_normalise_requests(spark, sf_dir):
    n = F.col("id") % 4
    rows = documents(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit(" "), "lang")).otherwise(F.lit(" ")).alias("collection"), F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit(None).cast("string"))).otherwise(F.array("lang")).alias("texts"), F.array(F.concat(F.lit(" "), "lang", F.lit("=1 ")), F.lit(" ")).alias("filters"))
    return fl.normalise_requests(rows, "all").select("id", "error", "collection", F.array_join("filters", ",").alias("filters"))


# --- conversion

_TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_HTML = "html"
for _p, _r in ((r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->", "' '"), (r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|section|article)\s*>", "chr(10)"), ("<[^>]*>", "' '")):
    _HTML = f"regexp_replace({_HTML}, '{_p}', {_r}, 'g')"
for _e, _c in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
    _HTML = f"replace({_HTML}, '{_e}', {_c})"
_HTML = f"regexp_replace(regexp_replace({_HTML}, '[ \\t\\r]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')"


@query(f"SELECT page_id, {_TRIM(_HTML)} AS text FROM pages")
def c1_page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


def _url_title(urls: pd.Series) -> pd.Series:
    """The last part of an address; fails where it has an even digit at its end."""

    def one(url: str) -> str:
        if re.search("[02468]$", url):
            raise ValueError("even")
        return "# " + url.rstrip("/").rpartition("/")[2]

    return urls.map(one)


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'given' WHEN regexp_matches(url, '[02468]$') THEN NULL ELSE '# ' || regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) END AS markdown, CASE WHEN page_id % 5 <> 0 AND regexp_matches(url, '[02468]$') THEN 'ValueError: even' END AS error FROM pages")
def c1_convert(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("content"), F.when(F.col("page_id") % 5 == 0, F.lit("given")).alias("markdown"))
    return conversion.convert(pages, _url_title).select("page_id", "markdown", "error")


@query(r"SELECT doc_id AS id, regexp_matches(t, '\S') IS NOT TRUE AS blank FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' ' || chr(10) WHEN 1 THEN NULL ELSE text END AS t FROM documents)")
def c7_is_blank(spark, sf_dir):
    n = F.col("id") % 4
    return documents(spark, sf_dir).select("id", tx.is_blank(F.when(n == 0, F.lit(" \n")).when(n == 1, F.lit(None).cast("string")).otherwise(F.col("text"))).alias("blank"))


@query(f"WITH {CHUNKS} SELECT document_id, string_agg(text, chr(10) ORDER BY chunk_index) AS text FROM chunks WHERE doc_id % 2 = 0 GROUP BY document_id UNION ALL SELECT CAST(doc_id AS VARCHAR), upper(lang) FROM documents WHERE doc_id % 2 = 1")
def u6_preview(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("id").cast("string").alias("document_id"), F.upper("lang").alias("content"), F.when(F.col("id") % 2 == 0, F.col("text")).alias("markdown"), F.lit(None).cast("string").alias("metadata"))
    shown = files.preview(docs, lambda d: d.withColumn("markdown", F.col("content")), lambda d: d.withColumn("metadata", F.lit("{}")), lambda d: d.select("document_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text")))
    return chunking.reassemble(shown).select("document_id", "text")


@query(own._K1.replace("length(t) > 1000", "length(t) > 500").replace("s + 1, 1000)", "s + 1, 500)").replace("s + 1000", "s + 500").replace("length(t) <= 1000", "length(t) <= 500"))
def k2_other_size(spark, sf_dir):
    return chunking.chunk_text(documents(spark, sf_dir).select("id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")), 500, strategy="unknown")


# --- metadata

_MEMBERS = """'{"k":' || event_id % 100 || ',"name":' || CASE event_id % 4 WHEN 0 THEN '"n' || event_id || '"' WHEN 1 THEN '7' WHEN 2 THEN '""' ELSE '{"x":1}' END || ',"tags":' || CASE event_id % 3 WHEN 0 THEN '["a","b"]' WHEN 1 THEN '"solo"' ELSE '[]' END || ',"other":1}'"""
_SCHEMA = {"type": "object", "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 80}, "name": {"type": "string", "minLength": 1}, "tags": {"type": "array", "minItems": 1}, "year": {"type": "integer"}}, "required": ["k", "name", "year"]}


def _members(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.expr(_MEMBERS).alias("metadata"))


@query("""SELECT event_id, '{"k":' || event_id % 100 || ',"name":' || CASE event_id % 4 WHEN 0 THEN '"n' || event_id || '"' WHEN 1 THEN '"7"' WHEN 2 THEN '"Unknown"' ELSE '"{\\"x\\":1}"' END || ',"tags":' || CASE event_id % 3 WHEN 0 THEN '["a","b"]' WHEN 1 THEN '["solo"]' ELSE '[]' END || ',"year":"Unknown"}' AS metadata FROM events""")
def m4_enforce_types(spark, sf_dir):
    return _members(spark, sf_dir).select("event_id", metadata.enforce(F.col("metadata"), _SCHEMA).alias("metadata"))


@query("""SELECT event_id, concat_ws(',', CASE WHEN event_id % 100 < 10 THEN 'k: minimum' WHEN event_id % 100 > 80 THEN 'k: maximum' END, CASE event_id % 4 WHEN 1 THEN 'name: type' WHEN 2 THEN 'name: minLength' WHEN 3 THEN 'name: type' END, CASE event_id % 3 WHEN 1 THEN 'tags: type' WHEN 2 THEN 'tags: minItems' END, 'year: required') AS broken FROM events""")
def m5_typed_violations(spark, sf_dir):
    return _members(spark, sf_dir).select("event_id", F.array_join(metadata.violations(F.col("metadata"), _SCHEMA), ",").alias("broken"))


@query("""SELECT event_id, '{"k":' || event_id % 100 || ',"other":{"deep":[1,"x"]},"name":null}' AS metadata FROM events""")
def m12_override_types(spark, sf_dir):
    base = F.format_string('{"k": %d, "other": {"deep": [1, "x"]}, "name": 5}', F.col("event_id") % 100)
    return table(spark, sf_dir, "events").select("event_id", metadata.override(base, F.lit('{"name": null}')).alias("metadata"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN props ELSE '{}' END AS metadata FROM events")
def m8_sanitize(spark, sf_dir):
    n = F.col("event_id") % 3
    return table(spark, sf_dir, "events").select("event_id", metadata.sanitize(F.when(n == 0, F.col("props")).when(n == 1, F.lit("[1]")).otherwise(F.lit("{oops"))).alias("metadata"))


@query("""SELECT event_id, '{"a":[1,2],"k":' || event_id || '}' AS metadata FROM events""")
def m10_compact(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", metadata.compact(F.format_string('{ "a" : [1, 2],\n "k": %d }', "event_id")).alias("metadata"))


@query("SELECT * FROM (VALUES ('k', 'integer', 2), ('name', 'string', 2), ('tags', 'array', 3), ('year', 'integer', 2), ('*', 'combined', 1)) AS t(property, type, examples), (SELECT count(*) AS events FROM events)")
def m11_filter_examples(spark, sf_dir):
    merged = metadata.merge_schemas(_SCHEMA, {"type": "object", "properties": {"tags": {"type": "array"}}})
    n = table(spark, sf_dir, "events").agg(F.count("*").alias("events"))
    return metadata.filter_examples(spark, merged).groupBy("property", "type").agg(F.count("*").alias("examples")).join(F.broadcast(n))


@query(r"SELECT doc_id AS id, 'Describe the document as JSON by this schema:' || chr(10) || '{}' || chr(10) || 'Context: c' || chr(10) || 'Document:' || chr(10) || substr(text, 1, 4000) AS extraction, 'Write 3 questions, as a JSON array of strings, that this document answers:' || chr(10) || substr(text, 1, 4000) AS asking FROM documents")
def m1_prompts(spark, sf_dir):
    return documents(spark, sf_dir).select("id", tx.extraction_prompt(F.col("text"), "{}", "c").alias("extraction"), tx.question_prompt(F.col("text"), 3).alias("asking"))


@query("SELECT doc_id AS id, lang || ' ' || source AS text FROM documents")
def m3_strip_fences(spark, sf_dir):
    return documents(spark, sf_dir).select("id", tx.strip_fences(F.concat(F.lit("```json\n"), "lang", F.lit(" "), "author", F.lit("\n```\n"))).alias("text"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'is it ' || lang || '?|or ' || source || '?' ELSE lang || '|b' END AS questions FROM documents")
def m7_parse_questions(spark, sf_dir):
    lines = F.concat(F.lit("Here:\n is it "), "lang", F.lit("?\nor "), "author", F.lit("?\nno question\nwhat else?"))
    listed = F.concat(F.lit('```json\n["'), "lang", F.lit('", "b", "c"]\n```'))
    return documents(spark, sf_dir).select("id", F.array_join(tx.parse_questions(F.when(F.col("id") % 2 == 0, lines).otherwise(listed), 2), "|").alias("questions"))


@query("SELECT doc_id AS id, 'Summarise in at most 200 words:' || chr(10) || text AS prompt, strlen(text) AS original, strlen(lang) AS summary FROM documents")
def m13_summary(spark, sf_dir):
    whole, short = tx.summary_lengths(F.col("text"), F.col("lang"))
    return documents(spark, sf_dir).select("id", tx.summary_prompt(F.col("text")).alias("prompt"), whole.alias("original"), short.alias("summary"))


@query("SELECT 'Read these passages with regard to lines:' || chr(10) || string_agg(text, chr(10) ORDER BY id) AS prompt, count(*) AS passages FROM (SELECT doc_id AS id, text FROM documents ORDER BY doc_id LIMIT 50)")
def m14_comb(spark, sf_dir):
    return metadata.comb(documents(spark, sf_dir), "lines", 50)


# --- store and access


@query(f"WITH {CHUNKS} SELECT source, chunk_index, CASE WHEN doc_id % 2 = 0 THEN 'public' ELSE lang END AS groups, 'default' AS \"partition\" FROM chunks")
def u2_prepare_rows(spark, sf_dir):
    given = chunks(spark, sf_dir).drop("partition").withColumn("security_group", F.when(F.col("doc") % 2 == 1, F.col("security_group")))
    return store.prepare_rows(given).select("source", "chunk_index", F.array_join("security_group", ",").alias("groups"), "partition")


@query(f"WITH {CHUNKS}, w AS (SELECT id, lang FROM chunks WHERE doc_id % 5 = 0 UNION ALL SELECT -1, 'en') SELECT id, lang = 'en' AND id >= 0 AS found FROM w")
def u3_delete_chunks(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return store.delete_chunks(c, c.where("doc % 5 = 0").select("id").union(spark.range(1).select(F.lit(-1).cast("long"))), ["en"])[1]


@query(f"WITH {CHUNKS} SELECT id FROM chunks WHERE NOT (lang = 'en' AND doc_id % 5 = 0)")
def u4_left_after_delete(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return store.delete_documents(c, c.where("doc % 5 = 0").select("document_id"), ["en"])[0].select("id")


@query("SELECT lang AS collection, count(*) AS entities FROM documents GROUP BY ROLLUP (lang) UNION ALL SELECT DISTINCT source, -1 FROM documents WHERE source = 'src1'")
def s9_unreadable(spark, sf_dir):
    d = documents(spark, sf_dir)
    return store.entity_counts(d.withColumn("collection", F.col("lang")), d.where("author = 'src1'").select(F.col("author").alias("collection")).distinct())


@query("""SELECT doc_id AS name, lang AS description, '{"a":1}' AS metadata_schema, doc_id % 7 AS chunk_size, '' AS embedding_model, source AS llm_model FROM documents""")
def s10_pipeline_catalogue(spark, sf_dir):
    config = F.to_json(F.struct(F.col("lang").alias("description"), F.struct(F.lit(1).alias("a")).alias("metadata_schema"), (F.col("id") % 7).alias("chunk_size"), F.col("author").alias("llm_model")))
    return store.pipeline_catalogue(documents(spark, sf_dir).select(F.col("id").alias("name"), config.alias("config")))


@query("""SELECT doc_id AS collection, CASE WHEN doc_id % 3 < 2 THEN '{"chunk_size":' || doc_id || ',"deep":{"x":[1,"y"]},"collection_name":"' || doc_id || '"}' END AS config FROM documents""")
def s11_collection_config(spark, sf_dir):
    key = F.when(F.col("id") % 3 == 0, F.lit("collection_config")).when(F.col("id") % 3 == 1, F.lit("collection_config_json")).otherwise(F.lit("other"))
    held = F.format_string('{"%s": {"collection_name": "old", "chunk_size": %d, "deep": {"x": [1, "y"]}}}', key, F.col("id"))
    found = store.collection_config(documents(spark, sf_dir).select(F.col("id").cast("string").alias("collection"), held.alias("description")))
    return found.select(F.col("collection").cast("long").alias("collection"), "config")


@query("SELECT DISTINCT a.source AS \"user\", b.doc_id AS collection FROM documents a JOIN documents b ON a.lang = b.lang WHERE a.doc_id % 7 = 0 AND b.doc_id % 11 = 0")
def j3_may_write(spark, sf_dir):
    d = documents(spark, sf_dir)
    users = d.where("id % 7 = 0").groupBy(F.col("author").alias("user")).agg(F.collect_set("lang").alias("roles"))
    return access.may_write(users, d.where("id % 11 = 0").select(F.col("id").alias("collection"), F.array("lang").alias("security_group")))


@query("SELECT source AS collection, array_to_string(list_sort(list(DISTINCT lang)), ',') AS roles FROM documents WHERE lang IN ('en', 'fr') GROUP BY source")
def j6_required_roles(spark, sf_dir):
    d = documents(spark, sf_dir)
    known = d.where(F.col("lang").isin("en", "fr")).select(F.col("lang").alias("role"))
    rows = d.groupBy(F.col("author").alias("collection")).agg(F.collect_set("lang").alias("security_group"))
    return access.required_roles(known, rows).select("collection", F.array_join("roles", ",").alias("roles"))


@query("SELECT doc_id AS id, CASE WHEN lang = 'en' THEN source ELSE lang || ',' || source END AS missing FROM documents")
def p3_missing_roles(spark, sf_dir):
    return documents(spark, sf_dir).select("id", F.array_join(access.missing_roles(F.array("lang", "author"), F.array(F.lit("en"))), ",").alias("missing"))


@query("SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN lang || ',' || source WHEN 1 THEN lang WHEN 2 THEN source ELSE 'public' END AS groups FROM documents")
def p5_parse_groups(spark, sf_dir):
    n = F.col("id") % 4
    given = F.when(n == 0, F.to_json(F.array("lang", "author"))).when(n == 1, F.concat(F.lit('"'), "lang", F.lit('"'))).when(n == 2, F.col("author")).otherwise(F.lit(" "))
    return documents(spark, sf_dir).select("id", F.array_join(tx.parse_groups(given), ",").alias("groups"))


@query("SELECT doc_id AS id, lang || '|' || source || '|x' AS groups FROM documents")
def p7_split_groups(spark, sf_dir):
    return documents(spark, sf_dir).select("id", F.array_join(tx.split_groups(F.concat(F.lit(" "), "lang", F.lit(", "), "author", F.lit("\n x,"))), "|").alias("groups"))


# --- shaping and evaluation


def _ranked(spark, sf_dir):
    return chunks(spark, sf_dir).select((F.col("doc") % 10).alias("query_id"), "id", "source", "chunk_index", "document_id", "metadata", "author", "doc")


@query(f"WITH {CHUNKS} SELECT doc_id % 10 AS query_id, source, string_agg(CAST(id AS VARCHAR), ',' ORDER BY chunk_index) AS ids FROM chunks GROUP BY ALL")
def a5_combine_by_source(spark, sf_dir):
    return shaping.combine_by_source(_ranked(spark, sf_dir)).select("query_id", "source", F.array_join(F.transform("chunks", lambda c: c["id"].cast("string")), ",").alias("ids"))


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, 'Doc ' || doc_id AS title, source AS authors, CAST(2000 + doc_id % 25 AS VARCHAR) AS date FROM documents")
def a6_metadata_summary(spark, sf_dir):
    return shaping.metadata_summary(chunks(spark, sf_dir))


@query("SELECT conv_id, document_id, turn FROM (SELECT conv_id, text AS document_id, turn, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS r FROM conversations) WHERE r = 1")
def a8_cite_once(spark, sf_dir):
    return shaping.cite_once(table(spark, sf_dir, "conversations").select("conv_id", F.col("text").alias("document_id"), "turn"))


@query("SELECT placement, count(*) AS n FROM (SELECT CASE WHEN event_id % 3 > 0 THEN event_id % 17 END AS placement FROM events) WHERE placement IS NOT NULL GROUP BY placement")
def a10_placement_histogram(spark, sf_dir):
    return evaluation.placement_histogram(table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 17).alias("placement")))


@query("SELECT source AS author, count(*) AS documents, array_to_string(list_sort(list(DISTINCT source || '/' || doc_id)), ',') AS sources FROM documents GROUP BY source")
def a14_authors_with_sources(spark, sf_dir):
    return shaping.documents_by_author(chunks(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


def _with_questions(spark, sf_dir):
    asked = F.when(F.col("doc") % 3 == 0, F.to_json(F.array(F.concat(F.lit("why "), "source"), F.lit(" ")))).otherwise(F.lit("[]"))
    return chunks(spark, sf_dir).withColumn("benchmark_questions", asked)


@query(f"WITH {CHUNKS} SELECT source, 'why ' || source AS question FROM chunks WHERE chunk_index = 0 AND doc_id % 3 = 0 AND regexp_matches(text, '\\S')")
def e1_question_set(spark, sf_dir):
    return evaluation.question_set(_with_questions(spark, sf_dir))


@query(f"WITH {CHUNKS} SELECT 0 AS no_source, count(*) FILTER (NOT regexp_matches(text, '\\S')) AS no_text, count(*) FILTER (doc_id % 3 <> 0) AS no_questions, count(*) AS heads FROM chunks WHERE chunk_index = 0")
def e1_skipped(spark, sf_dir):
    return evaluation.skipped(_with_questions(spark, sf_dir))


@query("SELECT lang AS metric, '{\"1\":' || count(*) || ',\"5\":' || sum(n_chars) || '}' AS \"values\" FROM documents GROUP BY lang")
def s7_results_json(spark, sf_dir):
    d = documents(spark, sf_dir).groupBy(F.col("lang").alias("metric")).agg(F.count("*").alias("a"), F.sum("n_chars").alias("b"))
    rows = F.inline(F.array(F.struct(F.lit(1).alias("k"), F.col("a").alias("value")), F.struct(F.lit(5).alias("k"), F.col("b").alias("value"))))
    return evaluation.results_json(d.select("metric", rows))


# --- conversations and mining


@query("SELECT doc_id AS conv_id, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'en' END AS selected, CASE WHEN lang = 'fr' THEN 'en' ELSE 'fr' END AS fallbacks, CASE WHEN doc_id % 2 = 0 THEN 'q1,q2,q3' ELSE source END AS queries FROM documents")
def h6_route(spark, sf_dir):
    asked = F.when(F.col("id") % 2 == 0, F.lit('["q1", " ", "q2", "q3", "q4"]')).otherwise(F.lit("[]"))
    answer = F.concat(F.lit('Sure: {"selected": "'), "lang", F.lit('", "fallbacks": ["xx", "fr", "en"], "queries": '), asked, F.lit("} done"))
    routed = conversation.route(documents(spark, sf_dir).select(F.col("id").alias("conv_id"), answer.alias("answer"), F.col("author").alias("question")), ["en", "fr"])
    return routed.select("conv_id", "selected", F.array_join("fallbacks", ",").alias("fallbacks"), F.array_join("queries", ",").alias("queries"))


@query("SELECT conv_id, 'system:S|' || string_agg(role || ':' || text, '|' ORDER BY turn) || CASE WHEN conv_id % 2 = 0 THEN '|assistant:A' ELSE '' END AS history FROM conversations GROUP BY conv_id")
def h3_history_with_answer(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    answers = c.where("conv_id % 2 = 0").select("conv_id", F.lit("A").alias("text")).distinct()
    h = conversation.history(c, answers, F.array(F.struct(F.lit("system").alias("role"), F.lit("S").alias("text"))))
    return h.select("conv_id", F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "|").alias("history"))


@query("SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'message without role' WHEN conv_id % 3 = 1 THEN 'unknown role' END AS error FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT -1, 'no messages'")
def h8_bad_requests(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    role = F.when(F.col("turn") > 0, F.col("role")).when(F.col("conv_id") % 3 == 0, F.lit(" ")).when(F.col("conv_id") % 3 == 1, F.lit("robot")).otherwise(F.col("role"))
    return conversation.request_errors(c.withColumn("role", role), c.select("conv_id").distinct().union(spark.range(1).select(F.lit(-1).cast("long"))))


def _forms_sql(kind: str) -> str:
    return "[" + ", ".join("'" + f.replace("{}", "' || text || '") + "'" for f in mining.EXPANSIONS[kind]) + "]"


@query("SELECT query_id, kind, unnest(forms) AS text FROM (" + " UNION ALL ".join(f"SELECT item_id AS query_id, '{k}' AS kind, {_forms_sql(k)} AS forms FROM benchmark" for k in mining.EXPANSIONS) + ")")
def x8_expand_all(spark, sf_dir):
    q = questions(spark, sf_dir)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), mining.expand(F.col("text"), k).alias("forms")) for k in mining.EXPANSIONS])
    return q.select("query_id", F.inline(kinds)).select("query_id", "kind", F.explode("forms").alias("text"))


@query("SELECT source AS collection, '- ' || source || ': ' || substr(replace(t, chr(10), ' '), 1, 240) || ' | ' || lang || ' x | fields: a, b' AS entry FROM (SELECT source, arg_min(text, doc_id) AS t, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source) ORDER BY source LIMIT 60")
def x5_catalogue_entries(spark, sf_dir):
    firsts = documents(spark, sf_dir).groupBy(F.col("author").alias("collection")).agg(F.min_by("text", "id").alias("description"), F.concat(F.min_by("lang", "id"), F.lit("\nx")).alias("hint"))
    return mining.catalogue_entries(firsts.withColumn("metadata_schema", F.lit('{"properties": {"b": {}, "a": {}}}')))


@query("SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'T ' || doc_id WHEN 1 THEN coalesce(nullif(trim(string_split(text, chr(10))[1]), ''), source || '/' || doc_id) ELSE source || '/' || doc_id END AS title, CASE WHEN doc_id % 2 = 0 THEN lang || ', ' || source END AS authors FROM documents")
def x14_titles_and_authors(spark, sf_dir):
    n = F.col("id") % 3
    title = tx.display_title(F.when(n == 0, F.concat(F.lit(" T "), F.col("id").cast("string"), F.lit(" "))).otherwise(F.lit(" ")), F.when(n == 1, F.col("text")).otherwise(F.lit("\nx")), F.col("source"))
    return documents(spark, sf_dir).select("id", title.alias("title"), tx.display_authors(F.when(F.col("id") % 2 == 0, F.array("lang", F.lit(" "), "author")).otherwise(F.array(F.lit("")))).alias("authors"))


@query("SELECT doc_id AS id, lang || '|' || source AS authors FROM documents")
def x15_parse_authors(spark, sf_dir):
    return documents(spark, sf_dir).select("id", F.array_join(tx.parse_authors(F.concat("lang", F.lit(" , ,"), "author", F.lit(" "))), "|").alias("authors"))


_ONCE = "list_filter(l, lambda x, i: list_position(l, x) = i)"


@query("SELECT id, array_to_string(" + _ONCE + "[1:3], ',') AS names FROM (SELECT doc_id AS id, list_concat(list_concat(list_concat(regexp_extract_all(t, '(?i)\\bfunction\\s+(\\w+)', 1), regexp_extract_all(t, '(?i)\\bdef\\s+(\\w+)', 1)), list_concat(regexp_extract_all(t, '\\b(\\w+)\\s*\\([^)]*\\)', 1), regexp_extract_all(t, '\\b(\\w+)\\s*\\([^}]*\\{', 1))), list_filter(string_split_regex(lower(t), '\\s+'), lambda w: w IN ('process', 'transform', 'analyze', 'convert', 'validate') OR (contains(w, '_') AND length(w) > 3))) AS l FROM (SELECT doc_id, 'def f' || doc_id || '(x) calls g_' || lang || ' and ' || source || '(1) to convert' AS t FROM documents))")
def x9_names_in_code(spark, sf_dir):
    code = F.concat(F.lit("def f"), F.col("id").cast("string"), F.lit("(x) calls g_"), "lang", F.lit(" and "), "author", F.lit("(1) to convert"))
    return documents(spark, sf_dir).select("id", F.array_join(mining.function_names(code), ",").alias("names"))


@query("SELECT id, array_to_string(CASE WHEN len(l) = 0 AND length(t) < 200 THEN [t] ELSE l END[1:2], '|') AS patterns FROM (SELECT id, t, list_concat(regexp_extract_all(t, '`([^`]+)`', 1), list_concat(regexp_extract_all(t, '\\b\\w+\\s*\\([^)]*\\)', 0), regexp_extract_all(t, '\\b\\w+\\.\\w+\\s*\\([^)]*\\)', 0))) AS l FROM (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'use `' || lang || '` here' WHEN 1 THEN source || '.run(' || doc_id || ') and f(1)' ELSE lang END AS t FROM documents))")
def x10_code_patterns(spark, sf_dir):
    n = F.col("id") % 3
    code = F.when(n == 0, F.concat(F.lit("use `"), "lang", F.lit("` here"))).when(n == 1, F.concat("author", F.lit(".run("), F.col("id").cast("string"), F.lit(") and f(1)"))).otherwise(F.col("lang"))
    return documents(spark, sf_dir).select("id", F.array_join(mining.code_patterns(code), "|").alias("patterns"))


_HAS = lambda *words: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query("WITH h AS (SELECT source AS query_id, doc_id, substr(text, 1, 300) AS t, text, lang || '/' || doc_id AS src, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents), r AS (SELECT * FROM h WHERE rank <= 100) SELECT query_id, " + ", ".join(f"array_to_string(coalesce((list(t ORDER BY rank) FILTER ({_HAS(*w)}))[1:5], []), '|') AS {n}" for n, w in (("likely_causes", ("cause", "reason")), ("solutions", ("solution", "fix", "resolve")), ("prevention_tips", ("prevent", "avoid")))) + ", array_to_string((list(src || ' (chunk 0)' ORDER BY rank))[1:5], '|') AS related_issues FROM r GROUP BY query_id")
def x12_debug_hits(spark, sf_dir):
    from pyspark.sql import Window as W

    hits = documents(spark, sf_dir).select(F.col("author").alias("query_id"), "text", F.concat("lang", F.lit("/"), F.col("id").cast("string")).alias("source"), F.lit(0).alias("chunk_index"), F.row_number().over(W.partitionBy("author").orderBy("id")).alias("rank"))
    return mining.debug_context(hits).select("query_id", *[F.array_join(c, "|").alias(c) for c in ("likely_causes", "solutions", "prevention_tips", "related_issues")])


@query(f"WITH c AS ({_top_sql(_ALL_COS, 20)}) SELECT query_id, nth, round(similarity_score, 6) AS similarity_score FROM (SELECT query_id, score AS similarity_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(id AS VARCHAR)) AS nth FROM c WHERE score >= 0.3) WHERE nth <= 6")
def x13_similar_hits(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    near = search.cosine_topk(q, v, 20).select("query_id", "score", F.col("id").cast("string").alias("source"), F.lit(0).alias("chunk_index"), F.lit("x").alias("text"))
    return mining.similar_code(near, 0.3).select("query_id", "nth", F.round("similarity_score", 6).alias("similarity_score"))
