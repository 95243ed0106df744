"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, decontamination, fill_in_middle, hard_negatives, language_model, line_dedup, ngram_join, norm_search, pii, quality, secrets, sharding, toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark, sf_dir):
    """Benchmark items in every document."""
    return decontamination.report(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op2_language_model(spark, sf_dir):
    """Log-likelihood of every document."""
    return language_model.fit_and_score(_t(spark, sf_dir, "documents"))


def op3_sharding(spark, sf_dir):
    """Shard and slot of every document."""
    return sharding.assign(_t(spark, sf_dir, "documents"))


def op4_bpe(spark, sf_dir):
    """Token digests of every document."""
    return bpe.digests(_t(spark, sf_dir, "documents"), bpe.read_vocabulary(WORD_BPE))


def op5_toxicity(spark, sf_dir):
    """Severity of every document."""
    docs = _t(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _t(spark, sf_dir, "labels")))


def op6_ngram_join(spark, sf_dir):
    """Component of every document."""
    return ngram_join.join(_t(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    """Line measures and the verdict on every document."""
    docs = _t(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, _t(spark, sf_dir, "labels")))


def op8_pii(spark, sf_dir):
    """Personal data in every document."""
    return pii.digests(_t(spark, sf_dir, "documents"))


def op9_secrets(spark, sf_dir):
    """Secrets in every document."""
    return secrets.digests(_t(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_line_dedup(spark, sf_dir):
    """Dropped lines of every document."""
    return line_dedup.report(_t(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark, sf_dir):
    """Cut, order and digests of every document."""
    return fill_in_middle.digests(_t(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector, among all."""
    return hard_negatives.mine(hard_negatives.prepared(_t(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op13_norm_search(spark, sf_dir):
    """The five largest products of every fiftieth vector, among all."""
    return norm_search.search(_t(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_language_model, op3_sharding, op4_bpe, op5_toxicity, op6_ngram_join, op7_quality, op8_pii, op9_secrets, op10_line_dedup, op11_fill_in_middle, op12_hard_negatives, op13_norm_search)}
#: Words of a text as the contracts have them: ASCII letters lower-cased, split at ASCII white space.
_WORDS = r"list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Vectors as whole numbers, and their product.
_WHOLE = "SELECT vec_id, {}list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {}embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_DOT = "list_sum(list_transform(list_zip({0}.v, {1}.v), lambda z: z[1] * z[2]))::BIGINT"

ORACLE = {
    "op6_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS sh FROM w)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 90 * (x.n + y.n - i)),
 e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
 r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT u AS doc_id, min(v) AS m FROM r GROUP BY u) USING (doc_id)""",
    "op10_line_dedup": f"""WITH l AS (SELECT doc_id, i - 1 AS line, lines[i] AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), UNNEST(range(1, len(lines) + 1)) AS t(i)),
 k AS (SELECT *, array_to_string(ws, ' ') AS key, (doc_id, line) AS place FROM (SELECT *, {_WORDS.format("raw")} AS ws FROM l) WHERE len(ws) > 0),
 f AS (SELECT key, min(place) AS first, any_value(ws) AS ws FROM k GROUP BY key),
 long AS (SELECT * FROM f WHERE len(ws) >= 5),
 v AS (SELECT first, p, array_to_string(ws[1:p] || ws[p + 2:], ' ') AS rest FROM long, UNNEST(range(0, len(ws))) AS t(p)),
 near AS (SELECT v.first FROM v JOIN (SELECT rest, p, min(first) AS m FROM v GROUP BY rest, p) g ON g.rest = v.rest AND g.p = v.p WHERE m < v.first
  UNION SELECT greatest(v.first, long.first) FROM v JOIN long ON long.key = v.rest),
 d AS (SELECT k.doc_id, k.line, k.place = f.first AS only_near FROM k JOIN f USING (key) WHERE k.place <> f.first OR f.first IN (SELECT first FROM near))
SELECT l.doc_id, count(*) AS n_lines, count(d.line) AS n_dropped, count(*) FILTER (only_near) AS n_near, sha256(coalesce(string_agg(raw, chr(10) ORDER BY l.line) FILTER (d.line IS NULL), '')) AS kept_sha256
 FROM l LEFT JOIN d ON d.doc_id = l.doc_id AND d.line = l.line GROUP BY l.doc_id""",
    "op11_fill_in_middle": r"""WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS us, sha256('1:' || doc_id) AS h FROM documents),
 n AS (SELECT *, len(us) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
 c AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
 p AS (SELECT *, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars, sha256(t) AS restored_sha256,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256 FROM p""",
    "op12_hard_negatives": f"""WITH v AS ({_WHOLE.format("(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, ", "label IS NOT NULL AND ")}),
 s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, {_DOT.format("a", "c")} AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
 r AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10""",
    "op13_norm_search": f"""WITH v AS ({_WHOLE.format("", "")}),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, {_DOT.format("q", "c")} AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
}
