"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

Texts become templates in two readings: in both, numbers and units turn into typed placeholders, case
and punctuation go; in the second, runs of capitalised words, also where a sentence begins, are names
and turn into one placeholder each. The first finds copies in any case, the second questions in which
names were changed. Windows of ``WINDOW`` template tokens of every benchmark item and every document, at
every offset, meet in a hash join; an item of fewer tokens is one window of its own length. Windows with
fewer than ``LITERALS`` plain tokens say little by their template and meet by the values in it; so do
those that stand in more than ``MANY`` items, but for the first of these items, which stands for all.
What is common to so many items even by its values is met for the first of them and for items that have
nothing rarer: a line that a whole benchmark shares leads from each document to one item, not to all.
Documents that met such a first item then meet all items of these windows, by all of their windows, and what
these say holds: no leaking pair is lost, and none is found by a part of an item's windows alone. Such a document
can leak many items by one line; a report names those that were met first beside the list of all.

Windows are made of few documents only. Any ``s`` offsets in a row hold one that ``s`` divides, so every
window of ``w`` tokens holds a run of ``w - s + 1`` that starts at such an offset. Documents give those runs
alone, items give them at every offset, and a document without a common run has no common window.

Each meeting names an alignment of an item with a document. Within the windows that met, the slots of an
alignment must be consistent: one value of the item stands against one of the document. Of the
consistent alignments the tokens that windows cover count together (a slot that takes another number of
tokens moves what follows to another alignment), and an alignment's equal tokens count also between its
windows. An item leaks if ``COVERAGE`` of it is reached in one reading.

Defined results: null and empty texts and items leak nothing, and neither do items without a plain
token; a null doc_id gets a row but is never reported contaminated, and stays; repeated rows share
their result, repeated items count once each, and items of equal templates and values share theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, join_few, strategy

WINDOW = 8
LITERALS = 4
COVERAGE = 0.5
#: Items that may share a window before it says little about each of them.
MANY = 10
#: The two readings: as they stand, and with names.
READINGS = (0, 1)

#: Units that follow a number.
UNITS = "km cm mm m kg mg g lb oz ml l s ms min h hour hours minute minutes second seconds day days week weeks month months year years mile miles meter meters metre metres dollar dollars euro euros cent cents percent usd eur kb mb gb".split()
#: Placeholders, from the private-use area so that no cleaning touches them.
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
#: In a value, the place of a space; and what ends a name or a number while values are marked.
JOINT, NAME_END, NUMBER_END = "\ue003", "\ue004", "\ue005"
#: A name has eight words at most: longer runs of capitals are several, so that no space is looked at from far away.
_CAPITAL = r"\p{Lu}[\p{L}\p{N}]*+"
_NAMES = rf"(?<![\p{{L}}\p{{N}}{UNIT}]){_CAPITAL}(?: {_CAPITAL}){{0,7}}+"
_NUMBERS = r"(?<![\p{L}\p{N}])\p{N}++(?:[., ]\p{N}++){0,40}+"
_UNIT = rf"(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])"
_PUNCTUATION = r"[^\p{L}\p{N}\s\x{E000}-\x{E003}]+"


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), _PUNCTUATION, ""), r"\s+"), "")


def _numbers(text: Column) -> Column:
    """The text with placeholders for numbers and units."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _NUMBERS, NUMBER), rf"(?i)(?<={NUMBER}) ?{_UNIT}", f" {UNIT}")


def _valued_numbers(text: Column) -> Column:
    """The same with the value behind each placeholder."""
    counted = F.regexp_replace(F.coalesce(text, F.lit("")), _NUMBERS, f"{NUMBER}$0{NUMBER_END}")
    united = F.regexp_replace(counted, rf"(?i)(?<={NUMBER_END}) ?{_UNIT}", f" {UNIT}$0")
    whole = F.regexp_replace(united, f"(?<={UNIT}) ", "")
    # spaces inside a number are looked at from one group of digits to its end
    return F.regexp_replace(whole, rf"(?<=\p{{N}}) (?=\p{{N}}++(?:[., ]\p{{N}}++){{0,40}}+{NUMBER_END})", JOINT)


def _read(numbered: Column, reading: int) -> Column:
    """Template tokens of one reading: lower-cased, without punctuation, with placeholders."""
    return _tokens(F.regexp_replace(numbered, _NAMES, NAME) if reading else numbered)


def _read_values(numbered: Column, reading: int) -> Column:
    """The same tokens, one for one, with the value behind each placeholder."""
    if not reading:
        return _tokens(numbered)
    named = F.regexp_replace(numbered, _NAMES, f"{NAME}$0{NAME_END}")
    return _tokens(F.regexp_replace(named, rf"(?<=[\p{{L}}\p{{N}}]) (?={_CAPITAL}(?: {_CAPITAL}){{0,6}}+{NAME_END})", JOINT))


def template_tokens(text: Column, reading: int = 1) -> Column:
    return _read(_numbers(text), reading)


def valued_tokens(text: Column, reading: int = 1) -> Column:
    return _read_values(_valued_numbers(text), reading)


def _hashes(words: Column, width: Column, reading: Column, step: int = 1) -> Column:
    """Hashes of the windows of ``width`` tokens that start at every ``step``-th token, from the tokens' hashes."""
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i + 1, width), reading, width))


def _hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item, twins, reading, tokens, shapes, width): the distinct items with a plain token, in each reading; ``twins`` are all items with these tokens, the least of which stands for them."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").alias("item"), _valued_numbers(F.col("text")).alias("v"), _numbers(F.col("text")).alias("t"))
    read = items.select("item", *[f(F.col(c), r).alias(f"{c}{r}") for r in READINGS for c, f in (("v", _read_values), ("t", _read))])
    once = read.groupBy("v0", "v1").agg(F.min("item").alias("item"), F.array_sort(F.collect_set("item")).alias("twins"), F.first("t0").alias("t0"), F.first("t1").alias("t1"))
    each = once.select("item", "twins", F.explode(F.array(*[F.struct(F.lit(r).alias("reading"), F.col(f"v{r}").alias("tokens"), F.col(f"t{r}").alias("shapes")) for r in READINGS])).alias("x")).select("item", "twins", "x.*")
    return each.where(F.exists("shapes", lambda t: t < NAME)).withColumn("width", F.least(F.size("shapes"), F.lit(WINDOW)))


def _counted_windows(items: DataFrame) -> DataFrame:
    """Every window of the items with how many items share it, by its template and by its values, and the first of these."""
    literals = F.size(F.filter(F.slice("shapes", F.col("at") + 1, F.col("width")), lambda t: t < NAME))
    hashed = items.select("item", "reading", "width", "shapes", _hashed(F.col("shapes")).alias("s"), _hashed(F.col("tokens")).alias("v"))
    both = hashed.select("item", "reading", "width", "shapes", F.arrays_zip(_hashes(F.col("s"), F.col("width"), F.col("reading")).alias("s"), _hashes(F.col("v"), F.col("width"), F.col("reading")).alias("v")).alias("w"))
    spread = both.select("item", "reading", "width", "shapes", F.posexplode("w").alias("at", "w")).select("item", "reading", "width", "at", F.col("w.s").alias("shape"), F.col("w.v").alias("values"), (literals < LITERALS).alias("little"))
    of = lambda df, key: df.groupBy(key).agg(F.countDistinct("item").alias(f"{key}_items"), F.min("item").alias(f"{key}_first"))
    spread = cut(spread)
    return spread.join(of(spread, "shape").hint("merge"), "shape").join(of(spread, "values").hint("merge"), "values")


def _by_template() -> Column:
    return ~F.col("little") & ((F.col("shape_items") <= MANY) | (F.col("shape_first") == F.col("item")))


def item_windows(items: DataFrame, every: bool = False) -> DataFrame:
    """(item, reading, width, weak, item_at, hash): the windows by which items are met; with ``every`` all windows, whatever items share them."""
    counted = _counted_windows(items)
    by_template = ~F.col("little") if every else _by_template()
    rarest = F.min(F.struct("values_items", "at")).over(W.partitionBy("item", "reading"))
    met = counted.withColumn("rarest", rarest["at"] == F.col("at")).where(by_template | (F.col("values_items") <= MANY) | (F.col("values_first") == F.col("item")) | F.col("rarest") | F.lit(every))
    return met.select("item", "reading", "width", (~by_template).alias("weak"), F.col("at").alias("item_at"), F.when(by_template, F.col("shape")).otherwise(F.col("values")).alias("hash"))


def shared_windows(items: DataFrame) -> DataFrame:
    """(first, item): the items that ``item_windows`` leaves out of a window, and the item that is met by it."""
    counted = _counted_windows(items)
    left_out = (~F.col("little") & ~_by_template()) | (F.col("little") & (F.col("values_items") > MANY) & (F.col("values_first") != F.col("item")))
    return counted.where(left_out).select(F.when(F.col("little"), F.col("values_first")).otherwise(F.col("shape_first")).alias("first"), "item").distinct()


def _coarse(tokens: Column) -> Column:
    """Hashes of what a token has in common by its template and by its value: its start up to a placeholder."""
    start = lambda t: F.substring_index(F.substring_index(F.substring_index(t, NAME, 1), NUMBER, 1), UNIT, 1)
    return F.transform(tokens, lambda t: F.xxhash64(F.when(t >= NAME, F.substring(t, 1, 1)).otherwise(start(t))))


def sharing_runs(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents with a run of an item; no other document has a window that meets one."""
    step = F.greatest(F.floor(F.col("width") / 2).cast("int"), F.lit(1))
    sized = items.select("reading", step.alias("step"), (F.col("width") - step + 1).alias("run"), _coarse(F.col("shapes")).alias("s"))
    runs = cut(sized.select("reading", "step", "run", F.explode(_hashes(F.col("s"), F.col("run"), F.col("reading"))).alias("hash")).distinct())
    kinds = sorted(tuple(r) for r in runs.select("reading", "run", "step").distinct().collect())  # WINDOW for each reading at most
    given = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    if not kinds:
        return given.where("false")
    words = given.select("doc_id", _numbers(F.col("text")).alias("t")).select("doc_id", *[_coarse(_read(F.col("t"), r)).alias(f"t{r}") for r in sorted({r for r, _, _ in kinds})])
    seen = words.select("doc_id", F.explode(F.flatten(F.array(*[_hashes(F.col(f"t{r}"), F.lit(n), F.lit(r), s) for r, n, s in kinds]))).alias("hash"))
    hashes = cut(runs.select("hash").distinct())
    return join_few(given, seen.join(hashes.hint(strategy(hashes)), "hash", "left_semi").select("doc_id").distinct(), "doc_id", "left_semi")


def alignments(documents: DataFrame, items: DataFrame, every: bool = False) -> DataFrame:
    """(doc_id, item, reading, shift, ats): where windows met, by the item's windows. Documents are read once for templates and once for values, whatever the widths."""
    known = cut(item_windows(items, every))
    shapes = sorted(tuple(r) for r in known.select("weak", "reading", "width").distinct().collect())  # WINDOW for each reading at most, twice
    how, met = strategy(known), None
    given = documents.where("doc_id is not null and text is not null")
    for weak, numbered, read in ((False, _numbers, _read), (True, _valued_numbers, _read_values)):
        kinds = [(r, w) for k, r, w in shapes if k == weak]
        if not kinds:
            continue
        words = given.select("doc_id", numbered(F.col("text")).alias("t")).select("doc_id", *[read(F.col("t"), r).alias(f"t{r}") for r in sorted({r for r, _ in kinds})])
        hashed = words.select("doc_id", *[_hashed(F.col(c)).alias(c) for c in words.columns[1:]])
        runs = F.explode(F.array(*[_hashes(F.col(f"t{r}"), F.lit(w), F.lit(r)) for r, w in kinds])).alias("run")
        seen = hashed.select("doc_id", runs).select("doc_id", F.posexplode("run").alias("at", "hash"))
        part = seen.join(known.where(F.col("weak") == weak).drop("weak").hint(how), "hash").select("doc_id", "item", "reading", (F.col("at") - F.col("item_at")).alias("shift"), "item_at")
        met = part if met is None else met.unionByName(part)
    if met is None:
        met = given.where("false").select("doc_id", F.lit(0).cast("long").alias("item"), F.lit(0).alias("reading"), F.lit(0).alias("shift"), F.lit(0).alias("item_at"))
    return met.groupBy("doc_id", "item", "reading", "shift").agg(F.collect_set("item_at").alias("ats"))  # offsets in one item


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item, matched, n_tokens, slots, named): what of each item that leaks is found in a document; ``named`` where the item wasn't found through others that share its windows, or all of the document's were."""
    items = cut(benchmark_items(benchmark))
    documents = cut(sharing_runs(documents, items))
    met = cut(alignments(documents, items))
    found = _leaking(documents, items, met)
    shared = cut(shared_windows(items))
    if shared.isEmpty():
        return found.withColumn("named", F.lit(True))
    # documents that met the first item of a shared window meet all items of such windows, by all their windows
    firsts = shared.select(F.col("first").alias("item")).distinct()
    touched = cut(join_few(met.select("doc_id", "item"), firsts, "item", "left_semi").select("doc_id").distinct())
    if touched.isEmpty():
        return found.withColumn("named", F.lit(True))
    found = cut(found)
    rest = join_few(documents, touched, "doc_id", "left_semi")
    others = cut(items.join(shared.select("item").unionByName(firsts).distinct().hint("merge"), "item", "left_semi"))
    again = _leaking(rest, others, cut(alignments(rest, others, every=True)))
    ids = others.select(F.explode("twins").alias("item")).distinct().withColumn("_shares", F.lit(True))
    settled = join_few(join_few(found, ids, "item", "left"), touched.withColumn("_touched", F.lit(True)), "doc_id", "left")
    whole = settled.where("_shares is null or _touched is null").select(*again.columns).unionByName(again)
    first = F.col("_first").isNotNull()
    marked = whole.join(found.select("doc_id", "item", F.lit(True).alias("_first")).hint("merge"), ["doc_id", "item"], "left")
    return marked.withColumn("named", first | ~F.max(first).over(W.partitionBy("doc_id"))).drop("_first")


def _leaking(documents: DataFrame, items: DataFrame, met: DataFrame) -> DataFrame:
    """(doc_id, item, matched, n_tokens, slots) of the items that leak by the alignments ``met``."""
    asked = met.groupBy("doc_id").agg(F.collect_list(F.struct("item", "reading", "shift", "ats")).alias("asked"))  # items that a document shares rare windows with
    texts = join_few(documents, asked, "doc_id")
    # only the stretch of the document that lies against the item is carried on
    numbered = texts.select("doc_id", "asked", _valued_numbers(F.col("text")).alias("v"))
    read = numbered.select("doc_id", "asked", *[_read_values(F.col("v"), r).alias(f"t{r}") for r in READINGS])
    part = read.select("doc_id", F.explode("asked").alias("a"), "t0", "t1").select("doc_id", "a.*", F.when(F.col("a.reading") == 1, F.col("t1")).otherwise(F.col("t0")).alias("t"))
    few = cut(items.join(met.select("item", "reading").distinct().hint("merge"), ["item", "reading"], "left_semi"))
    sized = join_few(part, few.select("item", "reading", F.size("tokens").alias("n")), ["item", "reading"])
    low = F.greatest(F.col("shift"), F.lit(0))
    length = F.greatest(F.least(F.col("shift") + F.col("n"), F.size("t")) - low, F.lit(0))
    against = sized.select("doc_id", "item", "reading", "n", "ats", (low - F.col("shift")).alias("skip"), F.slice("t", low + 1, length).alias("dt"))
    both = join_few(against, few.select("item", "reading", "tokens", "width"), ["item", "reading"])
    covered = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("width") - 1))))
    pairs = F.zip_with(F.slice("tokens", F.col("skip") + 1, F.size("dt")), "dt", lambda x, y: F.struct(x.alias("v"), y.alias("u")))
    lined = both.select("doc_id", "item", "reading", "n", "skip", covered.alias("covered"), pairs.alias("pairs"))
    equal = F.size(F.filter("pairs", lambda r: (r["v"] == r["u"]) | ((r["v"] >= NAME) & (r["u"] >= NAME) & (F.substring(r["v"], 1, 1) == F.substring(r["u"], 1, 1)))))
    within = F.transform("covered", lambda i: F.get(F.col("pairs"), i - F.col("skip")))
    slots = F.array_distinct(F.filter(within, lambda r: r["v"] >= NAME))
    found = lined.select("doc_id", "item", "reading", "n", "covered", equal.alias("equal"), slots.alias("slots"))
    consistent = found.where(F.size("slots") == F.size(F.array_distinct("slots.v")))
    summed = consistent.groupBy("doc_id", "item", "reading").agg(F.max("n").alias("n_tokens"), F.max("equal").alias("equal"), F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("covered"), F.max(F.size("slots")).alias("slots"))
    reached = summed.select("doc_id", "item", F.greatest("equal", "covered").alias("matched"), "n_tokens", "slots").where(F.col("matched") >= COVERAGE * F.col("n_tokens"))
    best = reached.groupBy("doc_id", "item").agg(F.max(F.struct(F.col("matched") / F.col("n_tokens"), "matched", "n_tokens", "slots")).alias("best"))
    named = join_few(best, items.select("item", "twins").distinct(), "item")
    return named.select("doc_id", F.explode("twins").alias("item"), "best.matched", "best.n_tokens", "best.slots")


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, n_leaking, leaking_ids) per document: the named items, and all that leak."""
    ids = lambda named: F.array_sort(F.collect_set(F.when(named, F.col("item"))))
    by_doc = leaks(documents, benchmark).groupBy("doc_id").agg(ids(F.col("named")).alias("items"), ids(F.lit(True)).alias("all"))
    joined = join_few(documents.select("doc_id"), by_doc, "doc_id", "left")
    shown = [x for c, n, i in (("items", "n_items", "item_ids"), ("all", "n_leaking", "leaking_ids")) for x in (F.coalesce(F.size(c), F.lit(0)).cast("long").alias(n), F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit("")).alias(i))]
    return joined.select("doc_id", F.col("all").isNotNull().alias("contaminated"), *shown)


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the contaminated ones, all columns as they are."""
    return join_few(documents, leaks(documents, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")
