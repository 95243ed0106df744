"""What hits and questions say about code: query classes, expansions, names, patterns, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words that tell a query's class; the first class with one wins.
CLASS_WORDS = {
    "api_lookup": ("function", "method", "api", "class", "object", "def "),
    "debugging": ("error", "problem", "issue", "bug", "fail", "crash", "debug"),
    "code_generation": ("example", "sample", "template", "how to", "write", "create"),
    "explanation": ("explain", "what is", "how does", "understand", "learn"),
}
# For each class the partitions, query forms, needs and confidence of its plan.
PLANS = {
    "api_lookup": (("docs", "api_reference", "code_examples"), ("{}", "{} function", "{} usage"), ("examples", "api_relations"), 0.8),
    "debugging": (("help", "chats", "troubleshooting"), ("{}", "fix {}", "solve {}"), ("chats", "examples", "debug_info"), 0.7),
    "code_generation": (("code_examples", "docs", "tutorials"), ("{}", "{} example", "how to {}"), ("examples", "similar_code"), 0.6),
    "explanation": (("docs", "help", "explain", "tutorials"), ("{}", "explain {}", "{} tutorial"), ("examples",), 0.8),
    "general": (("docs", "help", "explain"), ("{}", "What is {}?"), ("examples",), 0.5),
}
# Query forms of the special searches.
EXPANSIONS = {
    "code_function": ("{}", "function {}", "def {}", "function definition {}"),
    "code_class": ("{}", "class {}", "class definition {}", "object {}"),
    "api": ("function {}", "API {}", "{} usage", "{} parameters", "{} return value", "{} dependencies", "{} example"),
    "error": ("error {}", "problem {}", "issue {}", "debug {}", "fix {}", "similar errors to {}", "prevent {}"),
    "concept": ("explain {}", "what is {}", "{} definition", "{} syntax", "{} usage", "{} example", "how to use {}", "{} tutorial"),
    "concept_beginner": ("{} for beginners",),
    "concept_advanced": ("advanced {}",),
}
# Patterns of function names and of code, and verbs that count as names.
NAME_PATTERNS = (r"(?i)\bfunction\s+(\w+)", r"(?i)\bdef\s+(\w+)", r"\b(\w+)\s*\([^)]*\)", r"\b(\w+)\s*\([^}]*\{")
CODE_PATTERNS = (r"`([^`]+)`", r"(?s)```.*?```", r"\b\w+\s*\([^)]*\)", r"\b\w+\.\w+\s*\([^)]*\)")
NAME_WORDS = ("process", "transform", "analyze", "convert", "validate")


def classify_query(text: Column) -> Column:
    low, out = F.lower(text), None
    for name, words in CLASS_WORDS.items():
        found = F.lit(False)
        for w in words:
            found = found | F.contains(low, F.lit(w))
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise("general")


def _filled(forms: tuple[str, ...], text: Column) -> Column:
    return F.array(*[F.concat(F.lit(f.split("{}")[0]), text, F.lit(f.split("{}")[1])) for f in forms])


def plan_query(queries: DataFrame) -> DataFrame:
    """Each query with its class, partitions, expanded queries, needs and confidence."""
    kind, text = F.col("query_type"), F.col("text")
    pick = lambda make: F.coalesce(*[F.when(kind == n, make(p)) for n, p in PLANS.items()])
    typed = queries.withColumn("query_type", classify_query(text))
    return typed.withColumns({"partitions": pick(lambda p: F.array(*map(F.lit, p[0]))), "queries": pick(lambda p: _filled(p[1], text)), "needs": pick(lambda p: F.array(*map(F.lit, p[2]))), "confidence": pick(lambda p: F.lit(p[3]))})


def expand(text: Column, kind: str) -> Column:
    return _filled(EXPANSIONS[kind], text)


def function_names(text: Column, most: int = 3) -> Column:
    """Names after function or def, names of calls, verbs and words with an underscore; in order of the rules, each once."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in NAME_PATTERNS]
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w.isin(*NAME_WORDS) | (F.contains(w, F.lit("_")) & (F.length(w) > 3)))
    return F.slice(F.array_distinct(F.concat(*found, words)), 1, most)


def code_patterns(text: Column, most: int = 2) -> Column:
    """Spans in backticks, fenced blocks and calls; a short text without any stands for itself."""
    spans = F.regexp_extract_all(text, F.lit(CODE_PATTERNS[0]), F.lit(1))
    rest = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in CODE_PATTERNS[1:]]
    found = F.transform(F.concat(spans, *rest), lambda p: F.regexp_replace(p, r"^`+|`+$", ""))
    return F.slice(F.when((F.size(found) == 0) & (F.length(text) < 200), F.array(text)).otherwise(found), 1, most)


def _capped(value: Column, order: str, most: int, when: Column | None = None) -> Column:
    kept = F.struct(F.col(order).alias("o"), value.alias("v"))
    return F.transform(F.slice(F.array_sort(F.collect_list(F.when(when, kept) if when is not None else kept)), 1, most), lambda s: s["v"])


def api_relations(hits: DataFrame, name: str = "function_name") -> DataFrame:
    """Per query: functions named beside it, import lines, usage examples and documentation from its hits (query_id, rank, text, and the name asked for)."""
    low = F.lower("text")
    # words stand in a column of their own: inside the loop over places they would be split again for each
    first = hits.where(F.col("rank") <= 100).withColumn("_words", F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != ""))
    words = F.col("_words")
    after = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.coalesce(F.try_element_at(words, i), F.lit("")).isin("function", "def")), lambda i: F.regexp_replace(F.coalesce(F.try_element_at(words, i + 1), F.lit("")), r"^[(),]+|[(),]+$", ""))
    named = F.filter(after, lambda w: (w != "") & (w != F.col(name)))
    lines = F.filter(F.transform(F.split(F.col("text"), "\n"), lambda x: F.trim(x)), lambda x: x.startswith("import ") | x.startswith("from "))
    flat = lambda c: F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", c.alias("v")))), lambda s: s["v"]))), 1, 10)
    docs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, 1000).alias("v")))), lambda s: s["v"]), " ")
    usage = F.contains(low, F.lit("example")) | F.contains(low, F.lit("usage"))
    return first.groupBy("query_id").agg(flat(named).alias("related_functions"), flat(lines).alias("dependencies"), _capped(F.substring("text", 1, 500), "rank", 5, usage).alias("usage_examples"), F.substring(docs, 1, 2000).alias("documentation"))


def debug_context(hits: DataFrame) -> DataFrame:
    """Per query: hits that name causes, solutions and prevention (300 characters, five each), and related chunks."""
    low = F.lower("text")
    has = lambda *words: F.array_contains(F.array(*[F.contains(low, F.lit(w)) for w in words]), True)
    text = F.substring("text", 1, 300)
    related = F.concat(F.col("source"), F.lit(" (chunk "), F.col("chunk_index").cast("string"), F.lit(")"))
    return hits.where(F.col("rank") <= 100).groupBy("query_id").agg(_capped(text, "rank", 5, has("cause", "reason")).alias("likely_causes"), _capped(text, "rank", 5, has("solution", "fix", "resolve")).alias("solutions"), _capped(text, "rank", 5, has("prevent", "avoid")).alias("prevention_tips"), _capped(related, "rank", 5).alias("related_issues"))


def similar_code(hits: DataFrame, least: float = 0.7, most: int = 6) -> DataFrame:
    """Hits of a cosine search (query_id, score, source, chunk_index, text) that are similar enough."""
    ranked = hits.where(F.col("score") >= least).withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "source", "chunk_index")))
    return ranked.where(F.col("nth") <= most).select("query_id", "nth", F.substring("text", 1, 2000).alias("pattern_code"), F.concat(F.lit("Source: "), F.col("source"), F.lit(", Chunk: "), F.col("chunk_index").cast("string")).alias("context"), F.col("score").alias("similarity_score"))


def catalogue_entries(collections: DataFrame, most: int = 60, width: int = 240) -> DataFrame:
    """(collection, entry) of the first ``most`` collections by name: name, description and hint on one line each, and the metadata's fields."""
    short = lambda c: F.substring(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), 1, width)
    fields = F.array_join(F.array_sort(F.map_keys(F.from_json(F.get_json_object("metadata_schema", "$.properties"), "map<string,string>"))), ", ")
    entry = F.concat(F.lit("- "), F.col("collection"), F.lit(": "), short(F.col("description")), F.lit(" | "), short(F.col("hint")), F.lit(" | fields: "), F.coalesce(fields, F.lit("")))
    return collections.select("collection", entry.alias("entry")).orderBy("collection").limit(most)
