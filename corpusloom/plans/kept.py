"""Registered queries of what is written and used again: kept indexes, bucketed collections, sketches, streams, saved runs, and extraction with a function."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.functions import filters as fl
from corpusloom.operators import access, cells, chunking, conversation, evaluation, metadata, mining, postings, search, shaping, store, tables
from corpusloom.plans import queries as own
from corpusloom.plans.queries import ASKED, CHUNKS, DOC_ROWS, _bm25_sql, _vectors, chunks, documents, questions, table
from corpusloom.streaming import ingest

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _folder(spark) -> str:
    """A folder of this call alone in the shared one."""
    return f"{tables.shared_folder(spark)}/kept-{uuid.uuid4().hex}"


# --- kept indexes


@query(own.ORACLE["b3_bm25"])
def b3_kept_postings(spark, sf_dir):
    """All postings of the documents are written; the search reads them."""
    root = _folder(spark)
    postings.write(documents(spark, sf_dir), root)
    return postings.search(questions(spark, sf_dir), spark.read.parquet(root), 10)


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def v3_stored_recall(spark, sf_dir):
    """A quarter of the stored cells is probed; at least 0.9 of the exact first ten must be among the found."""
    v, q = _vectors(spark, sf_dir)
    root = _folder(spark)
    cells.write_cells(v, root)
    found = cells.recall(cells.search_cells(q, root, 10), search.cosine_topk(q, v, 10))
    return found.select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query()
def v3_stored_cells(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    root = _folder(spark)
    cells.write_cells(v, root)
    return cells.search_cells(q, root, 10)


@query(f"WITH {own._LAST}, {CHUNKS}, {_bm25_sql('chunks', 'text', 5, '_t')}, {_bm25_sql('chunks', 'metadata', 5, '_m')} " + own._RRF.format(lists="SELECT * FROM hits_t UNION ALL SELECT * FROM hits_m", k=5))
def h5_conversation_hybrid(spark, sf_dir):
    return search.search_conversations(table(spark, sf_dir, "conversations"), chunks(spark, sf_dir), 5)


_TWO = lambda tag: f"SELECT * FROM hits_{tag}"
_MERGED = "SELECT query_id, id, round(sum(1 / (100 + rank)), 9) AS rrf, max(score) AS score FROM ({}) GROUP BY query_id, id"


@query(
    f"WITH q AS (SELECT item_id AS query_id, text FROM benchmark), {DOC_ROWS.replace('text FROM', 'text, lang FROM')}, {_bm25_sql('dd', 'text', 10, '_a', 'lang = ' + chr(39) + 'es' + chr(39))},"
    " thin AS (SELECT q.query_id, q.text, count(h.id) AS c FROM q LEFT JOIN hits_a h ON h.query_id = q.query_id AND h.rank <= 4 GROUP BY ALL),"
    " q2 AS (SELECT query_id AS asked, unnest([1, 2, 3]) AS n, text FROM thin WHERE c < 5),"
    " q3 AS (SELECT asked * 10 + n AS query_id, asked, CASE n WHEN 1 THEN text WHEN 2 THEN text || ' example' ELSE text || ' usage' END AS text FROM q2),"
    f" {_bm25_sql('dd', 'text', 10, '_b', 'lang = ' + chr(39) + 'es' + chr(39)).replace('FROM q)', 'FROM q3)')}, {_bm25_sql('dd', 'text', 10, '_c', 'lang = ' + chr(39) + 'fr' + chr(39)).replace('FROM q)', 'FROM q3)')},"
    f" m AS ({_MERGED.format(_TWO('b') + ' UNION ALL ' + _TWO('c'))}), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, score DESC, id) AS k FROM m) WHERE k <= 10),"
    " both_ AS (SELECT query_id, id, score FROM hits_a WHERE rank <= 4 UNION ALL SELECT asked, id, score FROM r JOIN q3 USING (query_id)),"
    " best AS (SELECT query_id, id, max(score) AS score FROM both_ GROUP BY ALL)"
    " SELECT query_id, id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM best) WHERE k <= 10"
)
def r10_second_search(spark, sf_dir):
    """Questions with fewer than five hits in one partition are searched again, with variants, in that and another one."""
    d = documents(spark, sf_dir).withColumn("partition", F.col("lang"))
    q = questions(spark, sf_dir)
    hits = tables.cut(search.bm25_topk(q, d.where("partition = 'es'"), 4))
    return search.refined(q, hits, d, 10, ["es"], ["fr"]).select("query_id", "id", F.round("score", 4).alias("score"))


# --- collections


@query(own.ORACLE["u1_upsert"])
def u1_upsert_buckets(spark, sf_dir):
    """A stored collection takes an upsert in the buckets that it touches."""
    old, new = own._two(spark, sf_dir)
    root = _folder(spark)
    store.create_buckets(old, root)
    store.upsert_buckets(new, root, seen=1)
    return store.load_buckets(spark, root).select("id", "text")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE text END AS text FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")
def u5_crawl_again(spark, sf_dir):
    """A crawl that is run twice stores each source once: the second run finds nothing new."""
    old, new = own._two(spark, sf_dir)
    root = _folder(spark)
    store.create_buckets(old, root)
    for _ in range(2):
        fresh = store.new_sources(new, store.load_buckets(spark, root))
        store.upsert_buckets(fresh, root)
    store.upsert_buckets(new, root)
    return store.load_buckets(spark, root).select("id", "text")


@query("SELECT lang AS name, count(*) AS chunks FROM documents GROUP BY lang UNION ALL SELECT 'spare', 0")
def s6_partitions(spark, sf_dir):
    """Partitions that hold rows and one that was created and is empty; creating it again changes nothing."""
    root = _folder(spark)
    store.write_collection(documents(spark, sf_dir).select("id", F.col("lang").alias("partition")), root)
    made = [store.create_partition(spark, root, "spare") for _ in range(2)]
    if made != [True, False]:
        raise RuntimeError(f"partition made: {made}")
    counts = store.load_collection(spark, root).groupBy(F.col("partition").alias("name")).agg(F.count("*").alias("chunks"))
    return store.partitions(spark, root).join(counts.hint("merge"), "name", "left").fillna(0, ["chunks"])


_METRICS = own.ORACLE["e8_metrics"]


@query(f"SELECT 'r1' AS run, metric, k, value FROM ({_METRICS}) UNION ALL SELECT 'r1', 'placement_distribution', placement, CAST(count(*) AS DOUBLE) FROM ({own.ORACLE['e2_placements']}) WHERE placement IS NOT NULL GROUP BY placement")
def s7_saved_run(spark, sf_dir):
    """A scored run, saved as JSON and read again."""
    root, placed = _folder(spark), tables.cut(own._placed(spark, sf_dir))
    evaluation.save_run(evaluation.metrics(placed), placed, root, "r1")
    return evaluation.load_runs(spark, root).withColumn("value", F.round("value", 6))


@query("WITH u AS (SELECT DISTINCT source AS u, lang FROM documents), n AS (SELECT lang, sum(len(string_split(text, chr(10)))) AS n FROM documents GROUP BY lang) SELECT u AS \"user\", CAST(sum(n) AS BIGINT) AS n FROM u JOIN n USING (lang) GROUP BY u")
def j4_visible_by_sets(spark, sf_dir):
    """How many chunks every source's readers see, by sets of groups."""
    users = access.users_with_roles(documents(spark, sf_dir).select(F.col("author").alias("user"), F.col("lang").alias("role")))
    return access.visible_counts(users, chunks(spark, sf_dir))


# --- sketches


@query("SELECT topic, true AS close FROM (SELECT DISTINCT unnest([lang, source]) AS topic FROM documents)")
def a12_topics_by_sketches(spark, sf_dir):
    """Sketches of the documents of each topic, one a partition, put together: within 8 % (five standard deviations) of the exact counts."""
    c = chunks(spark, sf_dir)
    kept = tables.cut(shaping.topic_sketches(c, ["partition"]))
    exact = shaping.top_topics(c, 1000).withColumnRenamed("documents", "exact")
    return shaping.topics_from_sketches(kept, 1000).join(exact.hint("merge"), "topic").select("topic", (F.abs(F.col("documents") - F.col("exact")) <= 0.08 * F.col("exact")).alias("close"))


@query("SELECT topic, count(*) AS documents FROM (SELECT unnest([lang, source]) AS topic FROM documents) GROUP BY topic")
def a12_frequent_topics(spark, sf_dir):
    """Heavy hitters from one sketch a partition; exact here, as there are fewer topics than counters."""
    kept = tables.cut(shaping.frequent_sketches(chunks(spark, sf_dir), ["partition"]))
    return shaping.frequent_topics(kept, 1000)


@query("SELECT true AS close")
def a13_documents_by_sketch(spark, sf_dir):
    c, found = chunks(spark, sf_dir), F.contains(F.lower("text"), F.lit("license"))
    exact = shaping.documents_on(c, found).first()[0]
    return shaping.distinct_estimate(c, found).select((F.abs(F.col("documents") - exact) <= 0.08 * exact).alias("close"))


# --- chunks put together


@query(r"SELECT doc_id AS id, regexp_replace(text, '\s+', '_', 'g') AS text FROM documents")
def k5_reassemble_trimmed(spark, sf_dir):
    """Overlapping chunks give the text again; it has no white space that cuts could drop."""
    whole = documents(spark, sf_dir).select("id", F.regexp_replace("text", r"\s+", "_").alias("text"))
    cut = chunking.chunk_text(whole, 1000, 200)
    return chunking.reassemble(cut, ["id"], trim=200).select("id", "text")


# --- extraction with a function

_SCHEMA = {"type": "object", "properties": {"size": {"type": "integer", "minimum": 0}, "title": {"type": "string"}, "tags": {"type": "array"}}, "required": ["size", "title", "tags"]}


def _model(prompts: pd.Series) -> pd.Series:
    """A stand-in for a model: answers by the length of the text, of 7 lengths one never and two only when told what was wrong."""

    def one(prompt: str) -> str:
        asked, _, wrong = prompt.partition("\nThe last answer broke these rules: ")
        size = len(asked.partition("\nDocument:\n")[2])
        if size % 7 == 0 or (size % 7 == 1 and not wrong):
            return "I can't read this."
        value = json.dumps("many" if size % 7 == 2 and not wrong else size)
        return f'Here you are:\n```json\n{{"size": {value}, "title": "t{size}", "more": 1}}\n```'

    return prompts.map(one)


def _extracted(spark, sf_dir):
    docs = documents(spark, sf_dir).select("id", F.regexp_replace("text", "\nThe last", " The last").alias("text"))
    return metadata.extract(docs, _SCHEMA, _model, key="id", tries=3)


_SIZES = "s AS (SELECT doc_id AS id, least(length(text), 4000) AS n FROM documents)"


@query(f"WITH {_SIZES} SELECT id, n AS size, 't' || n AS title, '[]' AS tags, CASE WHEN n % 7 IN (1, 2) THEN 2 ELSE 1 END AS attempts FROM s WHERE n % 7 <> 0")
def m2_extract(spark, sf_dir):
    good, _ = _extracted(spark, sf_dir)
    get = lambda key: F.get_json_object("metadata", f"$.{key}")
    return good.select("id", get("size").cast("long").alias("size"), get("title").alias("title"), get("tags").alias("tags"), "attempts")


@query(f"WITH {_SIZES} SELECT id, 3 AS attempts, 'unreadable' AS broken FROM s WHERE n % 7 = 0")
def m5_extract_errors(spark, sf_dir):
    _, bad = _extracted(spark, sf_dir)
    return bad.select("id", "attempts", F.array_join("broken", ",").alias("broken"))


# --- filters

_EXAMPLES = {"type": "object", "properties": {"keywords": {"type": "array"}, "title": {"type": "string"}, "date": {"type": "integer"}, "author": {"type": "array"}}}
_HOLDS = ["lang = 'en'", "lang = 'en' OR src = 'src1'", "lang = 'en' AND src = 'src1'", "doc_id = 4", "'Doc ' || doc_id LIKE '%Doc 4%'", "y BETWEEN 2003 AND 2009", "y IN (2003, 2009)"]


@query("WITH c AS (SELECT doc_id, lang, source AS src, 2000 + doc_id % 25 AS y, len(string_split(text, chr(10))) AS n FROM documents) " + " UNION ALL ".join(f"SELECT '{p}' AS property, {k} AS nth, CAST(coalesce(sum(n) FILTER ({h}), 0) AS BIGINT) AS matches FROM c" for p, k, h in [("keywords", 1, _HOLDS[0]), ("keywords", 2, _HOLDS[1]), ("keywords", 3, _HOLDS[2]), ("title", 1, _HOLDS[3]), ("title", 2, _HOLDS[4]), ("date", 1, _HOLDS[5]), ("date", 2, _HOLDS[6]), ("author", 1, "src = 'src2'"), ("author", 2, "src IN ('src2', 'src3')"), ("author", 3, "false"), ("*", 1, f"{_HOLDS[0]} AND {_HOLDS[3]} AND {_HOLDS[5]}")]))
def m11_example_matches(spark, sf_dir):
    """How many chunks each example predicate holds for, its values taken from the data."""
    values = {"keywords": ["en", "src1"], "title": ["Doc 4"], "date": [2003, 2009], "author": ["src2", "src3"]}
    found = metadata.example_matches(metadata.filter_examples(spark, _EXAMPLES, values), chunks(spark, sf_dir))
    numbered = [(r["property"], r["matches"]) for r in found.collect()]  # a few for each property
    nth = [(p, 1 + sum(q == p for q, _ in numbered[:i]), m) for i, (p, m) in enumerate(numbered)]
    return spark.createDataFrame(nth, "property string, nth int, matches long")


@query("SELECT doc_id AS id, lang AS dotted, source AS quoted, doc_id AS blank FROM documents WHERE lang IN ('en', 'fr')")
def f4_odd_keys(spark, sf_dir):
    """Metadata keys with dots, blanks and quotes."""
    d = documents(spark, sf_dir).withColumn("metadata", F.to_json(F.create_map(F.lit("a.b"), "lang", F.lit("it's"), "author", F.lit("a b"), F.col("id").cast("string"))))
    seen = d.where(fl.all_of([fl.meta("a.b").isin("en", "fr")]))
    return seen.select("id", fl.meta("a.b").alias("dotted"), fl.meta("it's").alias("quoted"), fl.meta("a b", "long").alias("blank"))


# --- streams


def _stream(spark, sf_dir, name: str, folder: str):
    """A given table as a stream of files."""
    rows = table(spark, sf_dir, name)
    rows.repartition(4).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)


@query(r"SELECT CAST(doc_id AS VARCHAR) AS document_id, 1 AS n_chunks FROM documents WHERE regexp_matches(text, '\S')")
def t1_stream_ingest(spark, sf_dir):
    """Documents that come file by file, twice over: a second stream over the same files adds nothing."""
    root = _folder(spark)
    docs = _stream(spark, sf_dir, "documents", f"{root}/in").select(F.col("doc_id").cast("string").alias("document_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("source"), "text")
    for run in ("a", "b"):
        ingest.stream_ingest(docs, f"{root}/collection", f"{root}/check-{run}", chunk_size=10**9).awaitTermination()
    return store.load_collection(spark, f"{root}/collection").groupBy("document_id").agg(F.count("*").alias("n_chunks"))


@query(own.ORACLE["b3_bm25"])
def t2_stream_search(spark, sf_dir):
    """Questions that come as a stream, answered from a snapshot's kept postings."""
    root = _folder(spark)
    store.write_snapshot(documents(spark, sf_dir).withColumn("partition", F.col("lang")), f"{root}/store")
    asked = _stream(spark, sf_dir, "benchmark", f"{root}/in").select(F.col("item_id").alias("query_id"), "text")
    ingest.stream_search(asked, f"{root}/store", f"{root}/out", f"{root}/check").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("query_id", "id", "score", "rank")


# --- forms of operators that other queries leave out

_NAMED = r"h AS (SELECT doc_id % 50 AS query_id, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS rank, 'f' || doc_id % 50 % 7 || '(x' AS name, 'def f' || doc_id % 7 || '(x), usage' || chr(10) || ' import m' || doc_id % 3 || chr(10) || text AS text FROM documents)"


@query(
    rf"WITH {_NAMED}, f AS (SELECT * FROM h WHERE rank <= 100), w AS (SELECT query_id, rank, name, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM f),"
    r" n AS (SELECT query_id, rank, i, name, regexp_replace(coalesce(w[i + 1], ''), '^[(),]+|[(),]+$', '', 'g') AS fn FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w) WHERE w[i] IN ('function', 'def')),"
    " names AS (SELECT query_id, fn, min((rank, i)) AS place FROM n WHERE fn <> '' AND fn <> name GROUP BY ALL), rel AS (SELECT query_id, array_to_string(list(fn ORDER BY place)[1:10], '|') AS related FROM names GROUP BY query_id),"
    " l AS (SELECT query_id, rank, i, trim(ls[i]) AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS ls FROM f))),"
    " dep AS (SELECT query_id, array_to_string(list(line ORDER BY place)[1:10], '|') AS dependencies FROM (SELECT query_id, line, min((rank, i)) AS place FROM l WHERE starts_with(line, 'import ') OR starts_with(line, 'from ') GROUP BY ALL) GROUP BY query_id),"
    " t AS (SELECT query_id, array_to_string((list(substr(text, 1, 500) ORDER BY rank) FILTER (contains(lower(text), 'example') OR contains(lower(text), 'usage')))[1:5], '|') AS examples, substr(string_agg(substr(text, 1, 1000), ' ' ORDER BY rank), 1, 2000) AS documentation FROM f GROUP BY query_id)"
    " SELECT query_id, coalesce(related, '') AS related, coalesce(dependencies, '') AS dependencies, coalesce(examples, '') AS examples, documentation FROM t LEFT JOIN rel USING (query_id) LEFT JOIN dep USING (query_id)"
)
def x11_named_relations(spark, sf_dir):
    """Relations of named functions: the asked name isn't among those beside it."""
    d = documents(spark, sf_dir)
    text = F.concat(F.lit("def f"), (F.col("id") % 7).cast("string"), F.lit("(x), usage\n import m"), (F.col("id") % 3).cast("string"), F.lit("\n"), "text")
    hits = d.select((F.col("id") % 50).alias("query_id"), F.col("id").alias("of"), text.alias("text"))
    ranked = search.top(hits, 100, F.col("of")).withColumn("function_name", F.concat(F.lit("f"), (F.col("query_id") % 7).cast("string"), F.lit("(x")))
    found = mining.api_relations(ranked)
    return found.select("query_id", F.array_join("related_functions", "|").alias("related"), F.array_join("dependencies", "|").alias("dependencies"), F.array_join("usage_examples", "|").alias("examples"), "documentation")


@query(f"{own._HITS} SELECT query_id, source, round(min(1 - rrf_score), 6) AS best, row_number() OVER (PARTITION BY query_id ORDER BY min(1 - rrf_score), source) AS rank FROM h GROUP BY query_id, source")
def a3_consolidate_ascending(spark, sf_dir):
    """Sources by their least distance."""
    near = own._hits(spark, sf_dir).withColumn("distance", 1 - F.col("rrf_score"))
    return shaping.consolidate_by_source(near, ascending=True).select("query_id", "source", F.round("best", 6).alias("best"), "rank")


@query(f"{own._HITS} SELECT query_id, document_id, array_to_string(list_sort(list_distinct(list('c' || chunk_index % 3) || ['w'])), ',') AS words FROM h GROUP BY query_id, document_id")
def a2_unique_words(spark, sf_dir):
    """The union of the unique words of a document's chunks."""
    words = F.to_json(F.struct(F.array(F.lit("w"), F.concat(F.lit("c"), (F.col("chunk_index") % 3).cast("string"))).alias("unique_words")))
    rich = shaping.consolidate_rich(own._hits(spark, sf_dir).withColumn("metadata", words).withColumn("distance", F.lit(0.0)))
    return rich.select("query_id", "document_id", F.array_join("unique_words", ",").alias("words"))


@query(
    "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'text,image_url' WHEN 1 THEN 'text' WHEN 2 THEN '' ELSE 'text,audio' END AS kinds, CASE turn % 4 WHEN 2 THEN NULL ELSE text END AS text,"
    " CASE turn % 4 WHEN 0 THEN 'http://x/' || role END AS url, CASE WHEN turn % 7 = 6 THEN 'unknown role' WHEN turn % 4 = 3 THEN 'unknown part' END AS error FROM conversations"
)
def h1_message_parts(spark, sf_dir):
    """Contents as lists of parts, strings and null, unknown roles and unknown parts."""
    m = table(spark, sf_dir, "conversations")
    kind = F.col("turn") % 4
    said, none = F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.lit(None).cast("string")
    image = F.struct(F.lit("image_url").alias("type"), F.struct(F.concat(F.lit("http://x/"), "role").alias("url")).alias("image_url"))
    listed = lambda *parts: F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(p) for p in parts]), F.lit("]"))
    alone = F.to_json(F.array("text"))
    content = F.when(kind == 0, listed(said, image)).when(kind == 1, F.substring(alone, F.lit(2), F.length(alone) - 2)).when(kind == 2, none).otherwise(listed(said, F.struct(F.lit("audio").alias("type"))))
    role = F.when(F.col("turn") % 7 == 6, F.lit("robot")).otherwise(F.col("role"))
    found = conversation.normalise_messages(m.withColumn("content", content).withColumn("role", role))
    return found.select("conv_id", "turn", F.array_join("parts.type", ",").alias("kinds"), F.get("parts", F.lit(0))["text"].alias("text"), F.get("parts", F.lit(1))["url"].alias("url"), "error")
