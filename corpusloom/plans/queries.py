"""The registered queries of the retrieval engine, over the given tables, with the same results in SQL.

Chunks are the lines of ``documents``; their metadata, groups and partitions come from its columns.
Questions are the ``benchmark`` items.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import filters as fl
from corpusloom.functions import text as tx
from corpusloom.operators import access, chunking, conversation, conversion, evaluation, metadata, mining, search, shaping, store, tables

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("source"), "text", "lang", F.col("source").alias("author"), "n_chars")


def chunks(spark, sf_dir):
    docs = documents(spark, sf_dir)
    meta = F.to_json(F.struct(F.concat(F.lit("Doc "), F.col("id").cast("string")).alias("title"), F.array("author").alias("author"), (F.lit(2000) + F.col("id") % 25).alias("date"), F.array("lang", "author").alias("keywords")))
    # in a step of its own: beside a generator the struct would lose its field names
    docs = docs.withColumn("metadata", meta)
    return docs.select(F.col("id").alias("doc"), "source", "lang", "author", "metadata", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text")).select((F.col("doc") * 10000000 + F.col("chunk_index")).alias("id"), F.col("doc").cast("string").alias("document_id"), "source", F.col("chunk_index").cast("long").alias("chunk_index"), "text", "metadata", F.array("lang").alias("security_group"), F.lit("[]").alias("benchmark_questions"), F.col("lang").alias("partition"), "doc", "author")


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_META = """'{"title":"Doc ' || doc_id || '","author":["' || src || '"],"date":' || (2000 + doc_id % 25) || ',"keywords":["' || lang || '","' || src || '"]}'"""
CHUNKS = f"""chunks AS (SELECT doc_id * 10000000 + i - 1 AS id, CAST(doc_id AS VARCHAR) AS document_id, src || '/' || doc_id AS source, i - 1 AS chunk_index, lines[i] AS text, {_META} AS metadata, lang, src, doc_id
  FROM (SELECT doc_id, lang, source AS src, string_split(text, chr(10)) AS lines FROM documents), UNNEST(range(1, len(lines) + 1)) AS t(i))"""
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
ASKED = "q AS (SELECT item_id AS query_id, text FROM benchmark)"


def _bm25_sql(rows: str, text: str, k: int, tag: str = "", where: str = "true") -> str:
    """CTEs that end in hits{tag}(query_id, id, score, rank)."""
    return f"""qt{tag} AS (SELECT DISTINCT query_id, unnest({TOKENS.format('text')}) AS term FROM q),
 d{tag} AS (SELECT id, {TOKENS.format(text)} AS t FROM {rows} WHERE {where}),
 st{tag} AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d{tag}),
 p{tag} AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM d{tag}) WHERE term IN (SELECT term FROM qt{tag}) GROUP BY ALL),
 w{tag} AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p{tag}, st{tag} GROUP BY term, n),
 s{tag} AS (SELECT query_id, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM p{tag} JOIN qt{tag} USING (term) JOIN w{tag} USING (term), st{tag} GROUP BY query_id, id),
 hits{tag} AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s{tag}) WHERE rank <= {k})"""


# --- full-text search

DOC_ROWS = "dd AS (SELECT doc_id AS id, text FROM documents)"


@query(f"WITH {ASKED}, {DOC_ROWS}, {_bm25_sql('dd', 'text', 10)} SELECT query_id, id, score, rank FROM hits")
def b3_bm25(spark, sf_dir):
    return search.bm25_topk(questions(spark, sf_dir), documents(spark, sf_dir), 10)


@query(rf"SELECT term, id, count(*) AS tf, dl FROM (SELECT doc_id AS id, len(t) AS dl, unnest(t) AS term FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)) GROUP BY ALL")
def b2_postings(spark, sf_dir):
    return search.build_postings(documents(spark, sf_dir))


@query(rf"SELECT doc_id AS id, len({TOKENS.format('text')}) AS n_tokens, len(list_distinct({TOKENS.format('text')})) AS n_terms FROM documents")
def b1_tokens(spark, sf_dir):
    t = tx.tokens(F.col("text"))
    return documents(spark, sf_dir).select("id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_terms"))


_LANG_Q = "q AS (SELECT item_id AS query_id, 'src' || item_id % 20 || ' ' || 'fr' AS text FROM benchmark)"


def _meta_questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"), F.lit(" fr")).alias("text"))


@query(f"WITH {_LANG_Q}, {CHUNKS}, heads AS (SELECT id, metadata FROM chunks WHERE chunk_index = 0), {_bm25_sql('heads', 'metadata', 10)} SELECT query_id, id, score, rank FROM hits")
def b4_metadata_bm25(spark, sf_dir):
    heads = chunks(spark, sf_dir).where("chunk_index = 0").select("id", "metadata")
    return search.bm25_topk(_meta_questions(spark, sf_dir), heads, 10, text="metadata")


@query()
def b5_bm25_drop_ratio(spark, sf_dir):
    return search.bm25_topk(questions(spark, sf_dir), documents(spark, sf_dir), 10, drop_ratio=0.2)


# --- vectors


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("text_embedding"))
    return v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("text_embedding").alias("embedding"))


_COSINE = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9)"


@query(f"SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COSINE} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE rank <= 10")
def v2_cosine_topk(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return search.cosine_topk(q, v, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("SELECT query_id, id, round(distance, 5) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE rank <= 10")
def v4_l2_topk(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return search.l2_topk(q, v, 10).select("query_id", "id", F.abs(F.round("distance", 5)).alias("distance"), "rank")


@query()
def v3_approx_cosine(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    celled, centres = search.build_cells(v, 16)
    return search.approx_cosine_topk(q, celled, centres, 10)


@query()
def v1_embed(spark, sf_dir):
    return search.embed(documents(spark, sf_dir)).select("id", "text_embedding")


# --- fusion

_RRF = "SELECT query_id, id, rrf_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS rank FROM (SELECT query_id, id, round(sum(1 / (100 + rank)), 9) AS rrf_score FROM ({lists}) GROUP BY ALL)) WHERE rank <= {k}"


@query(f"WITH {ASKED}, {CHUNKS}, {_bm25_sql('chunks', 'text', 10, '_t')}, {_bm25_sql('chunks', 'metadata', 10, '_m')} " + _RRF.format(lists="SELECT * FROM hits_t UNION ALL SELECT * FROM hits_m", k=10))
def r2_hybrid_search(spark, sf_dir):
    return search.hybrid_search(questions(spark, sf_dir), chunks(spark, sf_dir), 10)


@query(f"WITH {ASKED}, {CHUNKS}, {_bm25_sql('chunks', 'text', 10, '_t', _w := 'lang IN (' + chr(39) + 'en' + chr(39) + ', ' + chr(39) + 'fr' + chr(39) + ')')}, {_bm25_sql('chunks', 'metadata', 10, '_m', _w)} " + _RRF.format(lists="SELECT * FROM hits_t UNION ALL SELECT * FROM hits_m", k=100))
def r4_hybrid_under_security(spark, sf_dir):
    return search.hybrid_search(questions(spark, sf_dir), chunks(spark, sf_dir), 100, per_list=10, where=fl.visible_to(["en", "fr"]))


@query(f"WITH {ASKED}, {CHUNKS}, {_bm25_sql('chunks', 'text', 10, '_t')}, {_bm25_sql('chunks', 'metadata', 10, '_m')}, l AS (SELECT query_id // 4 AS query_id, id, rank FROM (SELECT * FROM hits_t UNION ALL SELECT * FROM hits_m)) " + _RRF.format(lists="SELECT * FROM l", k=10).replace("query_id", "request_id").replace("SELECT * FROM l", "SELECT query_id AS request_id, id, rank FROM l"))
def r3_requests_of_several_texts(spark, sf_dir):
    q = questions(spark, sf_dir).withColumn("request_id", F.expr("query_id div 4"))
    return search.hybrid_search(q, chunks(spark, sf_dir), 10, by="request_id").select("request_id", "id", "rrf_score", "rank")


@query(f"WITH {ASKED}, {CHUNKS}, {_bm25_sql('chunks', 'text', 5, '_e', 'lang = ' + chr(39) + 'en' + chr(39))}, {_bm25_sql('chunks', 'text', 5, '_f', 'lang = ' + chr(39) + 'fr' + chr(39))} SELECT query_id, id, rrf_score, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, score DESC, id) AS rank FROM (SELECT query_id, id, round(sum(1 / (100 + rank)), 9) AS rrf_score, max(score) AS score FROM (SELECT * FROM hits_e UNION ALL SELECT * FROM hits_f) GROUP BY query_id, id)) WHERE rank <= 5")
def r5_search_partitions(spark, sf_dir):
    return search.search_partitions(questions(spark, sf_dir), chunks(spark, sf_dir), ["en", "fr"], 5)


_DE = chr(39) + "de" + chr(39)
_EN = chr(39) + "en" + chr(39)


@query(f"WITH {ASKED}, {CHUNKS}, {_bm25_sql('chunks', 'text', 3, '_a', f'lang = {_DE}')}, {_bm25_sql('chunks', 'text', 3, '_b', f'lang = {_EN}')} SELECT * FROM hits_a UNION ALL SELECT * FROM hits_b WHERE query_id NOT IN (SELECT query_id FROM hits_a)")
def r9_fallback_collection(spark, sf_dir):
    c, q = chunks(spark, sf_dir), questions(spark, sf_dir)
    return search.answered_with_fallback(q, search.bm25_topk(q, c.where("partition = 'de'"), 3), lambda left: search.bm25_topk(left, c.where("partition = 'en'"), 3))


@query(f"WITH {ASKED}, {CHUNKS}, {_bm25_sql('chunks', 'text', 10, '', f'lang = {_DE}')}, n AS (SELECT q.query_id, q.text, count(h.id) AS c FROM q LEFT JOIN hits h USING (query_id) GROUP BY ALL) SELECT query_id, unnest([text, text || ' example', text || ' usage']) AS text FROM n WHERE c < 5")
def r10_expand_thin_queries(spark, sf_dir):
    q = questions(spark, sf_dir)
    return search.expanded_where_thin(q, search.bm25_topk(q, chunks(spark, sf_dir).where("partition = 'de'"), 10), 10)


@query("SELECT id, author, lang FROM (SELECT doc_id AS id, source AS author, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def d1_dedupe_first(spark, sf_dir):
    return search.dedupe_first(documents(spark, sf_dir), F.col("id"), ["author", "lang"]).select("id", "author", "lang")


@query("SELECT author, arg_min(id, (n_chars, id)) AS id, min(n_chars) AS n_chars FROM (SELECT source AS author, doc_id AS id, n_chars FROM documents) GROUP BY author")
def d2_dedupe_best(spark, sf_dir):
    d = documents(spark, sf_dir)
    return search.dedupe_best(d.select("author", "id", "n_chars"), key=["author"], distance="n_chars")


# --- filters and access


@query(f"WITH {CHUNKS} SELECT id, source, chunk_index FROM chunks WHERE lang IN ('en', 'de') AND (2000 + doc_id % 25) BETWEEN 2005 AND 2015 AND src IN ('src1', 'src2', 'src3') AND chunk_index = 0")
def f8_metadata_filters(spark, sf_dir):
    where = fl.all_of([fl.visible_to(["en", "de"]), fl.meta_between("date", 2005, 2015), fl.meta_contains_any("keywords", ["src1", "src2", "src3"]), "chunk_index = 0", " "])
    return chunks(spark, sf_dir).where(where).select("id", "source", "chunk_index")


@query(f"WITH {CHUNKS} SELECT id FROM chunks WHERE lang = 'fr' AND src = 'src4' AND doc_id::VARCHAR LIKE '%4%'")
def f7_contains_all_and_like(spark, sf_dir):
    where = fl.all_of([fl.meta_contains_all("keywords", ["fr", "src4"]), fl.meta_like("title", "4"), fl.meta_contains("author", "src4")])
    return chunks(spark, sf_dir).where(where).select("id")


@query(f"WITH {CHUNKS} SELECT id, source, 1.0 AS distance, 0.0 AS score FROM chunks WHERE lang = 'es' AND chunk_index = 0 ORDER BY id LIMIT 100")
def f11_filter_heads(spark, sf_dir):
    return fl.filter_chunks(chunks(spark, sf_dir), ["es"], heads=True).select("id", "source", "distance", "score")


@query(f"WITH {CHUNKS}, u AS (SELECT * FROM (VALUES ('ann', 'en'), ('ann', 'de'), ('bob', 'fr')) AS t(u, g)) SELECT u AS \"user\", count(*) AS n FROM chunks JOIN u ON g = lang GROUP BY u")
def j4_visible_chunks_of_users(spark, sf_dir):
    users = spark.createDataFrame([("ann", ["en", "de"]), ("bob", ["fr"]), ("eve", [])], "user string, roles array<string>")
    return access.visible_chunks(users, chunks(spark, sf_dir)).groupBy("user").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'public,' || source WHEN 1 THEN source WHEN 2 THEN lang || ',' || source ELSE 'admin,' || source END AS groups, CASE WHEN doc_id % 8 = 6 THEN false ELSE true END AS valid FROM documents")
def p1_effective_groups(spark, sf_dir):
    d = documents(spark, sf_dir)
    level = F.element_at(F.array(*map(F.lit, ["public", "private", "group_only", "admin"])), (F.col("id") % 4 + 1).cast("int"))
    given = F.when(F.col("id") % 8 == 6, F.array().cast("array<string>")).otherwise(F.array("lang"))
    return d.select("id", F.array_join(access.effective_groups(level, F.array("lang"), F.col("author")), ",").alias("groups"), access.groups_are_given(level, given).alias("valid"))


@query("SELECT source AS \"user\", array_to_string(list_sort(list(DISTINCT lang)), ',') AS roles FROM documents GROUP BY source")
def p4_users_with_roles(spark, sf_dir):
    grants = documents(spark, sf_dir).select(F.col("author").alias("user"), F.col("lang").alias("role"))
    return access.users_with_roles(grants).select("user", F.array_join("roles", ",").alias("roles"))


# --- chunking and cleaning


_LAST_OF = lambda mark, n: f"(CASE WHEN contains(w, {mark}) THEN length(w) - strpos(reverse(w), reverse({mark})) - {n} + 1 ELSE -1 END)"
_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_K1 = f"""WITH RECURSIVE d AS (SELECT doc_id AS id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents),
 r AS (SELECT id, t, 0::BIGINT AS s, []::VARCHAR[] AS c, false AS done FROM d WHERE length(t) > 1000
  UNION ALL
  SELECT id, t, nx AS s, CASE WHEN tail THEN c || [{_STRIP('substr(t, s + 1)')}] ELSE
    (CASE WHEN len(c) > 0 AND length(piece) < 100 THEN c[:len(c) - 1] || [c[len(c)] || ' ' || piece] ELSE c || [piece] END)
    || (CASE WHEN nx >= total - 100 AND nx < total THEN [{_STRIP('substr(t, nx + 1)')}] ELSE []::VARCHAR[] END) END AS c, tail OR nx >= total - 100 AS done
  FROM (SELECT *, {_STRIP('substr(t, s + 1, stop - s)')} AS piece, CASE WHEN stop - 200 > s THEN stop - 200 ELSE stop END AS nx
   FROM (SELECT *, CASE WHEN para > 0 THEN s + para WHEN sentence > 100 THEN s + sentence + 1 WHEN word > 100 THEN s + word ELSE s + 1000 END AS stop
    FROM (SELECT *, {_LAST_OF('chr(10) || chr(10)', 2)} AS para, {_LAST_OF("'. '", 2)} AS sentence, {_LAST_OF("' '", 1)} AS word
     FROM (SELECT *, substr(t, s + 1, 1000) AS w, length(t) AS total, s + 1000 >= length(t) AS tail FROM r WHERE NOT done))))),
 a AS (SELECT id, list_filter(c, lambda x: x <> '') AS c FROM r WHERE done UNION ALL SELECT id, [t] FROM d WHERE length(t) <= 1000 AND regexp_matches(t, '\\S'))
SELECT id, i - 1 AS chunk_index, c[i] AS text FROM a, UNNEST(range(1, len(c) + 1)) AS u(i)"""


@query(_K1)
def k1_chunk_text(spark, sf_dir):
    return chunking.chunk_text(documents(spark, sf_dir).select("id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")))


@query("SELECT doc_id AS id, CASE WHEN length(text) <= 1000 THEN 1 ELSE greatest(1, (length(text) - 200) // 800 + 1) END AS n FROM documents")
def k3_chunk_estimate(spark, sf_dir):
    return documents(spark, sf_dir).select("id", tx.chunk_estimate(F.col("text")).alias("n"))


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, text, len(string_split(text, chr(10))) AS n_chunks FROM documents")
def k5_reassemble(spark, sf_dir):
    return chunking.reassemble(chunks(spark, sf_dir)).select("document_id", "text", "n_chunks")


@query(r"SELECT doc_id AS id, regexp_replace(replace(text, chr(10), ' '), ' +([.,;:!?])', '\1', 'g') AS text FROM documents")
def c2_paragraph_lines(spark, sf_dir):
    return documents(spark, sf_dir).select("id", tx.join_paragraph_lines(F.col("text")).alias("text"))


@query()
def c1_html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


def _with_image(spark, sf_dir):
    data = F.base64(F.substring("lang", 1, 2).cast("binary"))
    return documents(spark, sf_dir).select(F.col("id").alias("document_id"), F.concat("text", F.lit(" ![a](data:image/jpeg;base64,"), data, F.lit(") end")).alias("markdown"))


@query("SELECT doc_id AS document_id, text || ' *[Image (jpg), 2 bytes]* end' AS markdown FROM documents")
def c6_replace_images(spark, sf_dir):
    docs = _with_image(spark, sf_dir)
    return conversion.replace_images(docs, conversion.describe_images(conversion.distinct_images(conversion.extract_images(docs))))


@query("SELECT doc_id AS document_id, 'jpg' AS ext, sha256(lang) AS hash FROM documents")
def c3_extract_images(spark, sf_dir):
    return conversion.extract_images(_with_image(spark, sf_dir)).select("document_id", "ext", "hash")


# --- shaping


def _hits(spark, sf_dir, k=10):
    c = chunks(spark, sf_dir)
    hits = search.hybrid_search(questions(spark, sf_dir), c, k)
    return tables.join_few(c, hits, "id").select("id", *hits.columns[:1], *hits.columns[2:], *c.columns[1:])


_HITS = f"WITH {ASKED}, {CHUNKS}, {_bm25_sql('chunks', 'text', 10, '_t')}, {_bm25_sql('chunks', 'metadata', 10, '_m')}, f AS ({_RRF.format(lists='SELECT * FROM hits_t UNION ALL SELECT * FROM hits_m', k=10)}), h AS (SELECT * FROM f JOIN chunks USING (id))"


@query(f"{_HITS} SELECT query_id, document_id, string_agg(text, chr(10) ORDER BY chunk_index) AS text, count(*) AS n_chunks, max(rrf_score) AS best_score FROM h GROUP BY query_id, document_id")
def a1_consolidate_by_document(spark, sf_dir):
    return shaping.consolidate_by_document(_hits(spark, sf_dir)).select("query_id", "document_id", "text", "n_chunks", "best_score")


@query(f"{_HITS} SELECT query_id, document_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_index) FILTER (text <> '') AS text, array_to_string(list_sort([any_value(lang), any_value(src)]), ',') AS keywords, any_value(src) AS authors, row_number() OVER (PARTITION BY query_id ORDER BY max(rrf_score) DESC, document_id) AS rank FROM h GROUP BY query_id, document_id")
def a2_consolidate_rich(spark, sf_dir):
    rich = shaping.consolidate_rich(_hits(spark, sf_dir).withColumn("distance", 1 - F.col("rrf_score")))
    return rich.select("query_id", "document_id", "text", F.array_join("keywords", ",").alias("keywords"), F.array_join("authors", ",").alias("authors"), "rank")


@query(f"{_HITS} SELECT query_id, source, max(rrf_score) AS best, row_number() OVER (PARTITION BY query_id ORDER BY max(rrf_score) DESC, source) AS rank FROM h GROUP BY query_id, source")
def a3_consolidate_by_source(spark, sf_dir):
    return shaping.consolidate_by_source(_hits(spark, sf_dir)).select("query_id", "source", "best", "rank")


@query(f"{_HITS} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, source, chunk_index, id) AS position FROM (SELECT *, max(rrf_score) OVER (PARTITION BY query_id, source) AS b FROM h)")
def a4_group_rank(spark, sf_dir):
    return shaping.group_rank(_hits(spark, sf_dir)).select("query_id", "id", "position")


@query(f"{_HITS} SELECT query_id, document_id, any_value(source) AS source, 'Doc ' || document_id AS title, any_value(src) AS author, CAST(2000 + any_value(doc_id) % 25 AS VARCHAR) AS date, '### Doc ' || document_id || chr(10) || '**Authors:** ' || any_value(src) || chr(10) || '**Date:** ' || (2000 + any_value(doc_id) % 25) || chr(10) || '**Source:** `' || any_value(source) || '`' || chr(10) || '**Keywords:** `' || any_value(lang) || '`, `' || any_value(src) || '`' || CASE WHEN string_agg(text, chr(10) ORDER BY chunk_index) <> '' THEN chr(10) || chr(10) || '---' || chr(10) || string_agg(text, chr(10) ORDER BY chunk_index) ELSE '' END AS document FROM h GROUP BY query_id, document_id")
def a7_citations(spark, sf_dir):
    cited = shaping.build_citations(shaping.consolidate_by_document(_hits(spark, sf_dir)), F.lit("2020-01-01"))
    return cited.select("query_id", "document_id", "source", "details.title", "details.author", "details.date", "document")


@query("SELECT count(*) AS total, count(*) FILTER (doc_id % 10 > 1) AS processed, count(*) FILTER (doc_id % 10 = 0) AS skipped, count(*) FILTER (doc_id % 10 = 1) AS failed, sum(len(string_split(text, chr(10)))) AS chunks, sum(strlen(text)) AS bytes FROM documents")
def a9_ingest_statistics(spark, sf_dir):
    status = F.when(F.col("id") % 10 == 0, "skipped").when(F.col("id") % 10 == 1, "failed").otherwise("processed")
    return shaping.ingest_statistics(documents(spark, sf_dir).select(status.alias("status"), F.size(F.split("text", "\n")).alias("n_chunks"), F.lit(0.0).alias("seconds"), F.octet_length("text").alias("bytes"))).drop("seconds")


@query("SELECT least(20, CAST(floor((value - lo) / ((hi - lo) / 20)) AS INT) + 1) AS bin, count(*) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1")
def a11_histogram(spark, sf_dir):
    return shaping.histogram(table(spark, sf_dir, "events"), "value")


@query("SELECT topic, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest([lang, source]) AS topic FROM documents) GROUP BY topic ORDER BY documents DESC, topic LIMIT 10")
def a12_top_topics(spark, sf_dir):
    return shaping.top_topics(chunks(spark, sf_dir), 10)


@query(f"WITH {CHUNKS} SELECT count(DISTINCT document_id) AS documents FROM chunks WHERE contains(lower(text), 'license')")
def a13_documents_on_topic(spark, sf_dir):
    return shaping.documents_on(chunks(spark, sf_dir), F.contains(F.lower("text"), F.lit("license")))


@query("SELECT source AS author, count(*) AS documents FROM documents GROUP BY source")
def a14_documents_by_author(spark, sf_dir):
    return shaping.documents_by_author(chunks(spark, sf_dir)).select("author", "documents")


@query(f"{_HITS} , g AS (SELECT query_id, document_id, string_agg(text, chr(10) ORDER BY chunk_index) AS text, max(rrf_score) AS s FROM h GROUP BY query_id, document_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, document_id) AS rank FROM g) SELECT query_id, substr(string_agg(substr(text, 1, 4000), chr(10) || chr(10) ORDER BY rank), 1, 12000) AS context FROM r WHERE rank <= 6 GROUP BY query_id")
def x4_context_block(spark, sf_dir):
    grouped = shaping.consolidate_by_document(_hits(spark, sf_dir))
    ranked = search.top(grouped, 6, F.desc("best_score"), F.col("document_id"))
    return shaping.context_block(ranked, limit=12000)


# --- evaluation

_EXPECTED = "e AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), x AS (SELECT b.item_id AS query_id, coalesce(min(doc_id), -1) AS doc FROM benchmark b LEFT JOIN e USING (item_id) GROUP BY 1)"


#: Words in a row by which items and the documents that may hold them meet.
_RUN = 5


def _expected(spark, sf_dir):
    """The first of all documents that hold each item, found by a run of its inner words and then in full."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    docs = documents(spark, sf_dir).select("id", "text")
    # an item's first and last words can be parts of words in a document, those between can't
    words = F.split("item", r"\s+")
    traced = b.where(F.size(words) >= _RUN + 2).select("item_id", "item", F.xxhash64(F.slice(words, 2, _RUN)).alias("run"))
    starts = F.when(F.size("words") >= _RUN, F.sequence(F.lit(1), F.size("words") - _RUN + 1)).otherwise(F.array().cast("array<int>"))
    split = docs.where("text is not null").select("id", F.split("text", r"\s+").alias("words"))
    runs = split.select("id", F.explode(F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, _RUN)))).alias("run"))
    pairs = tables.join_few(runs, traced.select("item_id", "run"), "run").select("id", "item_id").distinct()
    # texts stay where they lie as long as what is asked of them is small
    held = tables.join_few(tables.join_few(docs, pairs, "id"), b, "item_id").where(F.contains("text", "item")).select("item_id", "id")
    # items of too few words for a run are tried on every document
    brief = b.where(F.size(words) < _RUN + 2)
    if brief.count():
        held = held.unionByName(docs.crossJoin(brief).where(F.contains("text", "item")).select("item_id", "id"))
    first = held.groupBy(F.col("item_id").alias("query_id")).agg(F.min("id").alias("doc"))
    return b.select(F.col("item_id").alias("query_id")).join(first.hint("merge"), "query_id", "left").select("query_id", F.coalesce("doc", F.lit(-1)).cast("string").alias("expected_source"))


def _placed(spark, sf_dir):
    hits = search.bm25_topk(questions(spark, sf_dir), documents(spark, sf_dir), 100).withColumn("source", F.col("id").cast("string"))
    return evaluation.placements(_expected(spark, sf_dir), hits)


_PLACED = f"WITH {ASKED}, {DOC_ROWS}, {_bm25_sql('dd', 'text', 100)}, {_EXPECTED}, pl AS (SELECT x.query_id, min(rank) AS placement FROM x LEFT JOIN hits ON hits.query_id = x.query_id AND hits.id = x.doc GROUP BY x.query_id)"


@query(f"{_PLACED} SELECT query_id, placement FROM pl")
def e2_placements(spark, sf_dir):
    return _placed(spark, sf_dir)


_PLAIN = [("mrr", "avg(coalesce(1 / placement, 0))"), ("mean_placement", "coalesce(avg(placement), 0)"), ("median_placement", "coalesce(median(placement), 0)"), ("std_placement", "coalesce(stddev_samp(placement), 0)"), ("found", "count(placement)"), ("not_found", "count(*) - count(placement)")]
_HIT = "avg(CASE WHEN placement <= k THEN 1 ELSE 0 END)"
_AT_K = [("recall", _HIT), ("precision", _HIT), ("hit_rate", _HIT), ("ndcg", "avg(CASE WHEN placement <= k THEN 1 / log2(placement + 1) ELSE 0 END)"), ("percent_in_top", f"100 * {_HIT}")]


@query(f"{_PLACED}, ks AS (SELECT unnest([1, 5, 10, 25, 50, 100]) AS k) " + " UNION ALL ".join([f"SELECT '{n}' AS metric, 0 AS k, round(CAST({v} AS DOUBLE), 6) AS value FROM pl" for n, v in _PLAIN] + [f"SELECT '{n}' AS metric, k, round(CAST({v} AS DOUBLE), 6) AS value FROM pl, ks GROUP BY k" for n, v in _AT_K]))
def e8_metrics(spark, sf_dir):
    return evaluation.metrics(_placed(spark, sf_dir)).select("metric", "k", F.round("value", 6).alias("value"))


# --- store

_EXISTING, _INCOMING = "e AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0)", "i AS (SELECT doc_id, upper(lang) AS text FROM documents WHERE doc_id % 2 = 0)"


def _two(spark, sf_dir):
    rows = documents(spark, sf_dir).select("source", F.lit(0).alias("chunk_index"), "text", "id", "lang")
    return rows.where("id % 3 <> 0").drop("lang"), rows.where("id % 2 = 0").withColumn("text", F.upper("lang")).drop("lang")


@query(f"WITH {_EXISTING}, {_INCOMING} SELECT doc_id AS id, text FROM e WHERE doc_id NOT IN (SELECT doc_id FROM i) UNION ALL SELECT doc_id, text FROM i")
def u1_upsert(spark, sf_dir):
    old, new = _two(spark, sf_dir)
    return store.upsert(old, new).select("id", "text")


@query(f"WITH {_EXISTING}, {_INCOMING} SELECT count(*) FILTER (e.doc_id IS NULL) AS inserted, count(e.doc_id) AS updated, count(*) AS total FROM i LEFT JOIN e USING (doc_id)")
def u1_upsert_counts(spark, sf_dir):
    return store.upsert_counts(*_two(spark, sf_dir))


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 = 0")
def j2_new_sources(spark, sf_dir):
    old, new = _two(spark, sf_dir)
    return store.new_sources(new, old).select("id")


@query("SELECT doc_id AS id, doc_id % 3 <> 0 AS stored FROM documents WHERE doc_id % 2 = 0")
def f15_exists(spark, sf_dir):
    old, new = _two(spark, sf_dir)
    return store.exists(new, old).select("id", "stored")


@query(f"WITH {CHUNKS} SELECT document_id, count(*) AS deleted FROM chunks WHERE lang = 'en' AND doc_id % 5 = 0 GROUP BY document_id")
def u4_delete_documents(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return store.delete_documents(c, c.where("doc % 5 = 0").select("document_id"), ["en"])[1]


@query(f"WITH {CHUNKS} SELECT lang AS collection, 'public' AS access_level, count(*) AS num_chunks, count(DISTINCT document_id) AS num_documents, count(DISTINCT src) AS num_partitions, lang AS required_roles FROM chunks GROUP BY lang")
def s8_describe_collections(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("collection", F.col("partition")).withColumn("partition", F.col("author"))
    catalogue = documents(spark, sf_dir).select(F.col("lang").alias("collection")).distinct().withColumn("access_level", F.lit(None).cast("string"))
    return store.describe_collections(c, catalogue).withColumn("required_roles", F.array_join("required_roles", ","))


@query(f"WITH {CHUNKS} SELECT lang AS collection, count(*) AS entities FROM chunks GROUP BY ROLLUP (lang)")
def s9_entity_counts(spark, sf_dir):
    return store.entity_counts(chunks(spark, sf_dir).withColumn("collection", F.col("partition")))


# --- metadata

_EVENT_SCHEMA = {"type": "object", "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 80}, "name": {"type": "string"}, "tags": {"type": "array"}}, "required": ["k", "name"]}


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, 'Unknown' AS name FROM events""")
def m4_enforce_schema(spark, sf_dir):
    out = metadata.enforce(F.col("props"), _EVENT_SCHEMA)
    return table(spark, sf_dir, "events").withColumn("o", out).select("event_id", F.get_json_object("o", "$.k").alias("k"), F.get_json_object("o", "$.name").alias("name"))


@query("""SELECT event_id, CASE WHEN k < 10 THEN 'k: minimum,' WHEN k > 80 THEN 'k: maximum,' ELSE '' END || 'name: required' AS broken FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)""")
def m5_violations(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.array_join(metadata.violations(F.col("props"), _EVENT_SCHEMA), ",").alias("broken"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, event_type AS kind FROM events""")
def m12_override(spark, sf_dir):
    out = metadata.override(F.col("props"), F.to_json(F.struct(F.col("event_type").alias("kind"))))
    return table(spark, sf_dir, "events").withColumn("o", out).select("event_id", F.get_json_object("o", "$.k").alias("k"), F.get_json_object("o", "$.kind").alias("kind"))


@query("""SELECT event_id, props AS object FROM events""")
def m2_coerce_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", metadata.coerce_json(F.concat(F.lit("Here: "), "props", F.lit(" ."))).alias("object"))


# --- conversations


@query("SELECT conv_id, coalesce(trim(arg_max(text, turn) FILTER (role = 'user')), '') AS text FROM conversations GROUP BY conv_id")
def h2_last_user_message(spark, sf_dir):
    return conversation.last_user_message(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS history FROM conversations GROUP BY conv_id")
def h3_history(spark, sf_dir):
    h = conversation.history(table(spark, sf_dir, "conversations"))
    return h.select("conv_id", F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "|").alias("history"))


@query("WITH s AS (SELECT conv_id, arg_min(role, turn) = 'system' AS sys FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN sys THEN turn ELSE turn + 1 END AS turn, role, CASE WHEN sys AND turn = 0 THEN 'P' ELSE text END AS text FROM conversations JOIN s USING (conv_id) UNION ALL SELECT conv_id, 0, 'system', 'P' FROM s WHERE NOT sys")
def h4_system_prompt(spark, sf_dir):
    return conversation.with_system_prompt(table(spark, sf_dir, "conversations"), "P")


@query("SELECT conv_id, sum(strlen(text) // 4 + 4) AS tokens FROM conversations GROUP BY conv_id")
def h7_token_estimate(spark, sf_dir):
    return conversation.token_estimate(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, CASE WHEN count(*) FILTER (trim(role) = '') > 0 THEN 'message without role' WHEN count(*) FILTER (role NOT IN ('system', 'user', 'assistant', 'tool')) > 0 THEN 'unknown role' END AS error FROM conversations GROUP BY conv_id")
def h8_request_errors(spark, sf_dir):
    return conversation.request_errors(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, 1 AS n_parts, text, CAST(NULL AS VARCHAR) AS error FROM conversations")
def h1_normalise_messages(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").withColumn("content", F.to_json(F.array("text"))).withColumn("content", F.expr("substring(content, 2, length(content) - 2)"))
    return conversation.normalise_messages(m).select("conv_id", "turn", F.size("parts").alias("n_parts"), F.col("parts")[0]["text"].alias("text"), "error")


_LAST = "q AS (SELECT conv_id AS query_id, coalesce(trim(arg_max(text, turn) FILTER (role = 'user')), '') AS text FROM conversations GROUP BY conv_id)"


@query(f"WITH {_LAST}, {DOC_ROWS}, {_bm25_sql('dd', 'text', 5)} SELECT query_id, id, round(score, 4) AS score, rank FROM hits")
def h5_conversation_search(spark, sf_dir):
    asked = conversation.last_user_message(table(spark, sf_dir, "conversations")).withColumnRenamed("conv_id", "query_id")
    return search.bm25_topk(asked, documents(spark, sf_dir), 5).withColumn("score", F.round("score", 4))


# --- text mining

_CLASS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(l, '{w}')" for w in words) + f" THEN '{n}'" for n, words in mining.CLASS_WORDS.items()) + " ELSE 'general' END"


@query(f"SELECT conv_id, turn, {_CLASS} AS query_type FROM (SELECT conv_id, turn, lower(text) AS l FROM conversations)")
def x6_classify_query(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", mining.classify_query(F.col("text")).alias("query_type"))


_CONF = "CASE query_type " + " ".join(f"WHEN '{n}' THEN {p[3]}" for n, p in mining.PLANS.items()) + " END"
_FORMS = "CASE query_type " + " ".join(f"WHEN '{n}' THEN [" + ", ".join("'" + f.replace("{}", "' || text || '") + "'" for f in p[1]) + "]" for n, p in mining.PLANS.items()) + " END"


@query(f"SELECT query_id, query_type, {_CONF} AS confidence, array_to_string({_FORMS}, '|') AS queries FROM (SELECT item_id AS query_id, text, {_CLASS} AS query_type FROM (SELECT *, lower(text) AS l FROM benchmark))")
def x7_plan_query(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    return mining.plan_query(q).select("query_id", "query_type", "confidence", F.array_join("queries", "|").alias("queries"))


@query("SELECT item_id AS query_id, unnest(['error ' || text, 'problem ' || text, 'issue ' || text, 'debug ' || text, 'fix ' || text, 'similar errors to ' || text, 'prevent ' || text]) AS text FROM benchmark")
def x8_expand_errors(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(mining.expand(F.col("text"), "error")).alias("text"))


@query("""WITH p AS (SELECT doc_id, text, list_min(list_filter([strpos(lower(text), 'password'), strpos(lower(text), 'license')], lambda x: x > 0)) AS found FROM documents) SELECT doc_id AS id, regexp_replace(substr(text, greatest(0, coalesce(found, 1) - 151) + 1, 300), '^\\s+|\\s+$', '', 'g') AS snippet FROM p""".replace("\\\\", "\\"))
def x1_snippet(spark, sf_dir):
    return documents(spark, sf_dir).select("id", tx.snippet(F.col("text"), F.array(F.lit("password"), F.lit("License"))).alias("snippet"))


@query(r"SELECT doc_id AS id, CASE WHEN length(text) > 500 THEN regexp_replace(substr(text, 1, 500), '\s+$', '') || chr(10) || chr(10) || '[truncated]' ELSE text END AS text FROM documents")
def x3_truncate(spark, sf_dir):
    return documents(spark, sf_dir).select("id", tx.truncate_marked(F.col("text"), 500).alias("text"))


@query("SELECT doc_id AS id, coalesce(nullif(trim(string_split(text, chr(10))[1]), ''), source || '/' || doc_id) AS title FROM documents")
def x14_display_title(spark, sf_dir):
    return documents(spark, sf_dir).select("id", tx.display_title(F.lit(None).cast("string"), F.col("text"), F.col("source")).alias("title"))


@query()
def x9_function_names(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", mining.function_names(F.col("text")).alias("names"), mining.code_patterns(F.col("text")).alias("patterns"))


@query()
def x11_api_relations(spark, sf_dir):
    return mining.api_relations(_hits(spark, sf_dir).withColumn("function_name", F.lit("")))


@query()
def x12_debug_context(spark, sf_dir):
    return mining.debug_context(_hits(spark, sf_dir))


@query()
def x13_similar_code(spark, sf_dir):
    docs = search.embed(documents(spark, sf_dir))
    q = docs.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("text_embedding").alias("embedding"))
    near = tables.join_few(docs.select("id", "source", "text", F.lit(0).alias("chunk_index")), search.cosine_topk(q, docs, 20), "id")
    return mining.similar_code(near)
