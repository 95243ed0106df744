"""JSON metadata: reading what a model answered, enforcing and checking a JSON Schema, filters to go with it."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import extraction_prompt, strip_fences
from corpusloom.operators import tables


def check_schema(schema: dict) -> None:
    if schema.get("type") != "object" or not isinstance(schema.get("properties"), dict) or not isinstance(schema.get("required", []), list):
        raise ValueError("a metadata schema is an object with properties and a list of required ones")


def merge_schemas(a: dict, b: dict) -> dict:
    return {"type": "object", "properties": a["properties"] | b["properties"], "required": a.get("required", []) + b.get("required", [])}


def coerce_json(answer: Column) -> Column:
    """The JSON object of an answer: all of it, without a fence, or between its outer braces; null if there is none."""
    plain = strip_fences(answer)
    inner = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    good = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{"), F.trim(c))
    return F.coalesce(good(plain), good(inner))


def sanitize(metadata: Column) -> Column:
    """Metadata that isn't an object becomes the empty one."""
    return F.when(F.try_parse_json(metadata).isNotNull() & F.trim(metadata).startswith("{"), metadata).otherwise(F.lit("{}"))


def _field(metadata: Column, key: str) -> Column:
    """A key's value with its JSON type."""
    if "'" in key or "\\" in key:  # paths can't name these
        return F.try_element_at(F.from_json(metadata, "map<string,variant>"), F.lit(key))
    return F.try_variant_get(F.try_parse_json(metadata), f"$['{key}']", "variant")


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def enforce(metadata: Column, schema: dict) -> Column:
    """Only the schema's keys, in its order; missing required ones as "Unknown" or []; scalars in array places as lists; strings where strings are asked for; all else as it is."""
    check_schema(schema)
    required = set(schema.get("required", []))
    members = []
    for key, spec in schema["properties"].items():
        value = _field(metadata, key)
        raw, kind = F.to_json(value), F.schema_of_variant(value)
        empty = raw.isNull() | raw.isin("null", '""', "[]")
        if spec.get("type") == "array":
            shown = F.when(empty | (raw == '"Unknown"'), F.lit("[]")).when(kind.startswith("ARRAY"), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]")))
            shown = shown if key in required else F.when(raw.isNotNull(), shown)
        else:
            text = F.when(kind.isNull() | kind.isin("STRING", "VOID"), raw).otherwise(_quoted(raw)) if spec.get("type") in (None, "string") else raw
            shown = F.when(empty, F.lit('"Unknown"')).otherwise(text) if key in required else text
        members.append(F.concat(F.lit(json.dumps(key) + ":"), shown))
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def violations(metadata: Column, schema: dict) -> Column:
    """The names of broken rules, as ``key: rule``; an empty list for valid rows. Types are those of the JSON values; null counts as missing."""
    check_schema(schema)
    broken = []

    def rule(key: str, name: str, holds: Column) -> None:
        broken.append(F.when(~F.coalesce(holds, F.lit(True)), F.lit(f"{key}: {name}")))

    for key, spec in schema["properties"].items():
        value = _field(metadata, key)
        kind = F.nullif(F.schema_of_variant(value), F.lit("VOID"))
        wanted = spec.get("type")
        if key in schema.get("required", []):
            broken.append(F.when(kind.isNull(), F.lit(f"{key}: required")))
        whole = kind == "BIGINT"
        numeric = whole | kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        holds = {"string": kind == "STRING", "integer": whole, "number": numeric, "float": numeric, "boolean": kind == "BOOLEAN", "array": kind.startswith("ARRAY"), "object": kind.startswith("OBJECT")}
        if wanted in holds:
            rule(key, "type", holds[wanted])
        number = F.when(numeric, F.try_variant_get(value, "$", "double"))
        text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        items = F.size(F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")))
        sizes = {"minimum": number >= spec.get("minimum"), "maximum": number <= spec.get("maximum"), "minItems": items >= spec.get("minItems"), "maxItems": items <= spec.get("maxItems"), "maxLength": F.length(text) <= spec.get("maxLength"), "minLength": F.length(text) >= spec.get("minLength")}
        for name, fits in sizes.items():
            if name in spec:
                rule(key, name, F.when(kind.isNotNull(), fits))
        if "pattern" in spec:
            rule(key, "pattern", text.rlike(spec["pattern"]))
        if spec.get("format") == "date":
            rule(key, "format", text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull())
        if "enum" in spec:
            rule(key, "enum", F.to_json(value).isin(*[json.dumps(v, ensure_ascii=False) for v in spec["enum"]]))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def compact(metadata: Column) -> Column:
    """Metadata as JSON without white space between its parts; null where it isn't JSON."""
    return F.to_json(F.try_parse_json(metadata))


#: Well-known fields and the type for which they get examples of their own.
KNOWN_FIELDS = {"author": ("array",), "date": ("integer", "number"), "keywords": ("array",), "unique_words": ("array",), "title": ("string",), "description": ("string",)}


def _path(key: str) -> str:
    if any(c in key for c in "'?\\"):  # JSON paths can't name these
        return f"CAST(try_element_at(from_json(metadata, 'map<string,variant>'), {_literal(key)}) AS STRING)"
    return f"get_json_object(metadata, \"$['{key}']\")"


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array_examples(path: str, one: str, some: list[str]) -> list[str]:
    """Contains one, any of some, all of them."""
    listed, array = f"from_json({path}, 'array<string>')", f"array({', '.join(map(_literal, some))})"
    return [f"array_contains({listed}, {_literal(one)})", f"arrays_overlap({listed}, {array})", f"size(array_except({array}, {listed})) = 0"]


def _known_examples(key: str) -> list[str]:
    path = _path(key)
    return {
        "author": _array_examples(path, "John Doe", ["John Doe", "Jane Smith"])[:2], "date": [f"CAST({path} AS DOUBLE) >= 2021", f"CAST({path} AS DOUBLE) BETWEEN 2018 AND 2024"],
        "keywords": [*_array_examples(path, "machine learning", ["AI", "ML"])[:2], _array_examples(path, "", ["neural networks", "optimization"])[2]], "unique_words": _array_examples(path, "backpropagation", [])[:1],
        "title": [f"{path} LIKE '%Analysis%'"], "description": [f"{path} LIKE '%Analysis%'"],
    }[key]


def example_matches(examples: DataFrame, rows: DataFrame) -> DataFrame:
    """``examples`` with the number of rows that each predicate holds for: one pass over the rows for all of them."""
    listed = examples.collect()  # a few for each property of the schema
    counts = rows.agg(*[F.count_if(F.expr(r["example"])).alias(f"n{n}") for n, r in enumerate(listed)]).first()
    return examples.sparkSession.createDataFrame([(*r, counts[n]) for n, r in enumerate(listed)], "property string, type string, example string, matches long")


def filter_examples(spark: SparkSession, schema: dict, values: dict[str, list] | None = None) -> DataFrame:
    """(property, type, example): predicates to start from, in Spark SQL: by the type of each property, then for well-known fields, then one that combines the first of up to three properties (property ``*``). ``values`` gives a property values of its data to show; where it does, well-known fields get no others."""
    check_schema(schema)
    values, rows = values or {}, []
    for key, spec in schema["properties"].items():
        kind, path, own = spec.get("type", "other"), _path(key), values.get(key)
        if kind == "array":
            examples = _array_examples(path, (own or ["value"])[0], own or ["a", "b"])
        elif kind in ("integer", "number", "float"):
            low, high = (own or [1, 10])[0], (own or [1, 10])[-1]
            examples = [f"CAST({path} AS DOUBLE) BETWEEN {low} AND {high}", f"CAST({path} AS DOUBLE) IN ({low}, {high if own else 2})"]
        elif kind == "boolean":
            examples = [f"CAST({path} AS BOOLEAN) = true"]
        elif kind == "string":
            one = (own or ["value"])[0]
            examples = [f"{path} = {_literal(one)}", f"contains({path}, {_literal(one)})"]
        else:
            examples = [f"{path} IS NOT NULL"]
        rows += [(key, kind, e) for e in examples]
    firsts = [next(e for k, _, e in rows if k == key) for key in list(schema["properties"])[:3]]
    known = [k for k, kinds in KNOWN_FIELDS.items() if schema["properties"].get(k, {}).get("type") in kinds and k not in values]
    rows += [(k, schema["properties"][k]["type"], e) for k in known for e in _known_examples(k)]
    if firsts:
        rows.append(("*", "combined", " AND ".join(firsts)))
    return spark.createDataFrame(rows, "property string, type string, example string")


def members(metadata: Column) -> Column:
    """The keys of a JSON object with their values as they are; none for anything else."""
    return F.coalesce(F.from_json(sanitize(metadata), "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def override(base: Column, change: Column) -> Column:
    """Two JSON objects as one; the second's keys win."""
    a, b = members(base), members(change)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b))


def comb(chunks: DataFrame, perspective: str, limit: int = 1000) -> DataFrame:
    """One prompt from the first ``limit`` chunks by id (a capped report, as its caller asks for)."""
    first = chunks.orderBy("id").limit(limit)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda c: c["text"]), "\n")
    return first.agg(F.concat(F.lit(f"Read these passages with regard to {perspective}:\n"), texts).alias("prompt"), F.count("*").alias("passages"))


def extract(documents: DataFrame, schema: dict, answer: Callable[[pd.Series], pd.Series], *, key: str = "document_id", text: str = "text", context: str = "", tries: int = 3, limit: int = 4000, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Metadata of documents by a model that is given as a function from prompts to answers, a batch at a time.

    Answers are read as JSON (``coerce_json``), with ``strict`` put into the schema's form (``enforce``) and checked
    (``violations``). Documents whose answer can't be read or breaks a rule are asked again, with the broken rules
    in the prompt, up to ``tries`` times in all. Gives (documents with ``metadata`` and ``attempts``) and
    (key, attempts, broken, answer) of those that stayed bad. Every answer is written once, so none is asked for twice.
    """
    check_schema(schema)

    @F.pandas_udf("string")
    def model(prompts: pd.Series) -> pd.Series:
        return answer(prompts)

    prompt, metadata, broken, said, attempts = (tables.unused(n, documents.columns) for n in ("prompt", "metadata", "broken", "answer", "attempts"))
    todo = documents.withColumn(prompt, extraction_prompt(F.coalesce(F.col(text), F.lit("")), json.dumps(schema), context, limit))
    good = None
    for n in range(1, tries + 1):
        answered = tables.cut(todo.withColumn(said, model(F.col(prompt))).withColumn(attempts, F.lit(n)).withColumn(metadata, coerce_json(F.col(said))))
        read = tables.cut(answered.withColumn(metadata, F.when(F.col(metadata).isNotNull(), enforce(F.col(metadata), schema)))) if strict else answered
        checked = read.withColumn(broken, F.when(F.col(metadata).isNull(), F.array(F.lit("unreadable"))).otherwise(violations(F.col(metadata), schema)))
        done = checked.where(F.size(broken) == 0).select(*documents.columns, metadata, attempts)
        good = done if good is None else good.unionByName(done)
        bad = checked.where(F.size(broken) > 0)
        if n == tries or bad.isEmpty():
            break
        todo = bad.withColumn(prompt, F.concat(F.col(prompt), F.lit("\nThe last answer broke these rules: "), F.array_join(broken, ", "))).select(*documents.columns, prompt)
    return good, bad.select(key, attempts, broken, said)
