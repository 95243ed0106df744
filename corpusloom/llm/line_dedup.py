"""Line dedup: a deletion-neighbourhood join over the lines of a corpus.

A line is the sequence of its words (ASCII letters lower-cased, split at ASCII white space). A line
goes if an earlier one, by (doc_id, line number), lies within the edit bound: equal, or, from
``NEAR_WORDS`` words on, one word inserted, deleted or replaced (a similarity of 0.8 or more).
Whether the earlier line itself stays doesn't matter, so the result depends on no order of work.

1. Equal lines meet by a 128-bit hash; the earliest of each stands for all.
2. One edit leaves the first or the last ``h`` words alone when ``h`` is at most half the length.
   A line that shares neither with any other has no partner. This prunes without loss: only the
   rest emit neighbourhoods.
3. Each of those emits the hash of the line and of the line without each of its words. Equal
   variants join: with the same position missing they are a replacement, a whole line and a
   variant of another an insertion. Per variant only minima are kept, never pairs.
4. The earliest partner of each line is verified on the words themselves.

Defined results: a null text has no lines, and lines without a word always stay; rows with a null
doc_id keep their text and drop nothing; repeated rows of one doc_id with equal text share their
decisions. A document that loses every line that has a word goes; others keep all columns, with
``text`` (and ``n_chars`` if there is one) renewed.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from .common import cut, join_few, map_columns, unused, utf8

NEAR_WORDS = 5
#: Lines whose neighbourhoods a task makes at once.
LINES_AT_ONCE = 500
#: Lengths of the shared ends, growing by halves.
LADDER = np.unique([round(2 * 1.5**k) for k in range(48)])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _h(data: bytes, seed: int) -> int:
    return _signed(xxhash.xxh3_64_intdigest(data, seed))


def _end(n: int) -> int:
    return int(LADDER[np.searchsorted(LADDER, n // 2, side="right") - 1])


def _ends(words: list[bytes]) -> list[int]:
    """Hashes of the first and last words, as a line of this length and as the longer one of a pair."""
    n = len(words)
    if n < NEAR_WORDS:
        return []
    out = []
    for h in sorted({_end(n), _end(max(n - 1, 4))}):
        out += [_h(b" ".join(words[:h]), 2 * h), _h(b" ".join(words[-h:]), 2 * h + 1)]
    return out


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line, a, b, ends, again): every line with a word; ``again``: the same text has an equal line above."""

    def start():
        def run(cols):
            out: dict = {"doc_id": [], "line": [], "a": [], "b": [], "ends": [], "again": []}
            for doc, text in zip(cols["doc_id"], cols["utf8"]):
                seen: set = set()
                for i, line in enumerate(text.lower().split(b"\n")):
                    if words := line.split():
                        x = xxhash.xxh3_128_intdigest(b" ".join(words))
                        out["doc_id"].append(doc), out["line"].append(i)
                        out["a"].append(_signed(x >> 64)), out["b"].append(_signed(x & ((1 << 64) - 1)))
                        out["again"].append(x in seen), out["ends"].append([] if x in seen else _ends(words))
                        seen.add(x)
            return out

        return run

    return map_columns(documents.where("doc_id is not null").select("doc_id", utf8()), "doc_id long, line int, a long, b long, ends array<long>, again boolean", start)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def variant_hashes(base: np.ndarray, n: np.ndarray, salt: np.uint64) -> np.ndarray:
    """For lines of ``n`` words each, whose hashes stand one line after the other in ``base``: per line its own hash, then those without each word.

    A line's hash is the exclusive or of its words' hashes, each mixed with its place. Without word
    i, words before it keep their places and words after it move down by one, so two running
    exclusive ors over all lines give every variant in a few steps per word.
    """
    begin = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(base)) - begin[owner]
    place = at.astype(np.uint64) * salt
    here = np.append(np.uint64(0), np.bitwise_xor.accumulate(_mixed(base ^ _mixed(place + salt))))  # word j at place j
    moved = np.append(np.uint64(0), np.bitwise_xor.accumulate(_mixed(base ^ _mixed(place))))  # word j at place j - 1
    i = np.arange(len(base))
    end = begin + n
    without = here[i] ^ here[begin[owner]] ^ moved[end[owner]] ^ moved[i + 1] ^ _mixed((n - 1).astype(np.uint64) + salt)[owner]
    whole = here[end] ^ here[begin] ^ _mixed(n.astype(np.uint64) + salt)
    out = np.empty(len(base) + len(n), dtype=np.uint64)
    out[begin + np.arange(len(n))] = whole
    out[i + owner + 1] = without
    return out


def _variants(near: DataFrame) -> DataFrame:
    """(v, w, gone, doc_id, line): the line (gone = -1) and the line without word ``gone``, as two hashes; linear in its length."""
    salts = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)

    def run(batches):
        import pyarrow as pa

        keys: dict = {}
        for batch in batches:
            docs, lines_, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for at in range(0, len(held), LINES_AT_ONCE):
                if len(keys) > 150_000:
                    keys.clear()
                found = [x.split() for x in held[at : at + LINES_AT_ONCE]]
                n = np.array([len(x) for x in found], dtype=np.int64)
                base = np.array([keys.get(x) or keys.setdefault(x, xxhash.xxh3_64_intdigest(x) or 1) for words in found for x in words], dtype=np.uint64)
                own = np.repeat(np.arange(len(n)), n + 1)
                gone = np.arange(len(own)) - (np.cumsum(n + 1) - n - 1)[own] - 1
                v, w = (variant_hashes(base, n, s).view(np.int64) for s in salts)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(w), pa.array(gone.astype(np.int32)), pa.array(docs[at : at + LINES_AT_ONCE][own]), pa.array(lines_[at : at + LINES_AT_ONCE][own])], names=["v", "w", "gone", "doc_id", "line"])

    return near.select("doc_id", "line", "words").mapInArrow(run, "v long, w long, gone int, doc_id long, line int")


def within_one(x: list[bytes], y: list[bytes]) -> bool:
    """Whether two word sequences are equal or one insertion, deletion or replacement apart."""
    if abs(len(x) - len(y)) > 1:
        return False
    p = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    if len(x) == len(y):
        return x[p + 1 :] == y[p + 1 :]
    return x[p + 1 :] == y[p:] if len(x) > len(y) else x[p:] == y[p + 1 :]


@F.pandas_udf(BooleanType())
def _verified(x, y):
    import pandas as pd

    return pd.Series([within_one(a.split(), b.split()) for a, b in zip(x, y)], dtype=bool)


def decisions(documents: DataFrame) -> DataFrame:
    """(doc_id, drops array<struct<line, near>>): the lines to drop, for documents that have any."""
    every = cut(lines(documents))
    place = F.struct("doc_id", "line")
    # each text sends a line once; what it repeats within itself goes anyway
    once = every.where(~F.col("again"))
    first = cut(once.groupBy("a", "b").agg(F.min(place).alias("first"), F.first("ends").alias("ends"), F.count("*").alias("n")))
    repeated = once.select("a", "b", place.alias("at")).join(first.where("n > 1").select("a", "b", "first").hint("merge"), ["a", "b"]).where("at <> first").select("at.doc_id", "at.line")
    exact = every.where("again").select("doc_id", "line").unionByName(repeated).withColumn("near", F.lit(False))

    ends = first.select("first", F.explode("ends").alias("end"))
    shared = ends.groupBy("end").count().where("count > 1").select("end")
    likely = ends.join(shared.hint("merge"), "end", "left_semi").select("first.doc_id", "first.line").distinct().groupBy("doc_id").agg(F.collect_list("line").alias("wanted"))

    def start():
        def run(cols):
            out: dict = {"doc_id": [], "line": [], "words": []}
            for doc, text, wanted in zip(cols["doc_id"], cols["utf8"], cols["wanted"]):
                have = text.lower().split(b"\n")
                for i in wanted:
                    # another text of this doc_id may be shorter, or have no words there
                    if i < len(have) and (words := have[i].split()):
                        out["doc_id"].append(doc), out["line"].append(i), out["words"].append(b" ".join(words))
            return out

        return run

    near = cut(map_columns(join_few(documents.select("doc_id", utf8()), likely, "doc_id"), "doc_id long, line int, words binary", start))
    variants = _variants(near)
    met = variants.groupBy("v").count().where("count > 1").select("v")
    rows = cut(variants.join(met.hint("merge"), "v", "left_semi").withColumn("at", place).drop("doc_id", "line"))
    whole = F.col("gone") < 0
    same = rows.where(~whole).groupBy("v", "w", "gone").agg(F.min("at").alias("other"))
    across = rows.groupBy("v", "w").agg(F.min(F.when(whole, F.col("at"))).alias("line_itself"), F.min(F.when(~whole, F.col("at"))).alias("longer"))
    replaced = rows.where(~whole).join(same.hint("merge"), ["v", "w", "gone"]).select("at", "other")
    moved = rows.join(across.hint("merge"), ["v", "w"]).select("at", F.when(whole, F.col("longer")).otherwise(F.col("line_itself")).alias("other"))
    earlier = replaced.unionByName(moved).where("other < at").groupBy("at").agg(F.min("other").alias("other"))
    text = near.select(place.alias("at"), "words").dropDuplicates(["at"])
    pairs = earlier.join(text.hint("merge"), "at").join(text.select(F.col("at").alias("other"), F.col("words").alias("others")).hint("merge"), "other")
    close = pairs.where(_verified("words", "others")).select(F.col("at").alias("first"))
    # all copies of a line that has an earlier neighbour: the copies after the first go anyway
    return exact.unionByName(close.select("first.doc_id", "first.line", F.lit(True).alias("near"))).groupBy("doc_id").agg(F.collect_set(F.struct("line", "near")).alias("drops"))


def packed(drops: DataFrame) -> DataFrame:
    """(doc_id, exact, near): a document's dropped lines as two strings of decimal numbers, those with an equal earlier line and the others; a few bytes a line, so that far larger lists can be broadcast and texts stay where they are."""
    lines_ = lambda near: F.array_join(F.transform(F.filter("drops", lambda d: d["near"] == near), lambda d: d["line"].cast("string")), ",")
    return drops.select("doc_id", lines_(False).alias("exact"), lines_(True).alias("near"))


def unpacked(lines_: str | None) -> set[int]:
    return set(map(int, lines_.split(","))) if lines_ else set()


@F.pandas_udf(StringType())
def _kept(text, exact, near):
    import pandas as pd

    def one(t, e, n):
        if t is None:
            return None
        gone = unpacked(e) | unpacked(n)
        left = [x for i, x in enumerate(t.split("\n")) if i not in gone]
        return "\n".join(left) if any(x.encode().split() for x in left) else None

    return pd.Series([one(t, e, n) for t, e, n in zip(text, exact, near)], dtype=object)


#: Else Spark runs it once in the filter and once more for the texts, by a second worker for each task.
_kept = _kept.asNondeterministic()


def apply(documents: DataFrame, drops: DataFrame) -> DataFrame:
    """``documents`` with the dropped lines out of their texts; documents with no word left go."""
    names, kinds = documents.columns, dict(documents.dtypes)
    if "text" not in names or "doc_id" not in names:
        raise ValueError("documents needs doc_id and text")
    gone, near, new = (unused(x, names) for x in ("gone", "near", "new"))
    joined = join_few(documents, packed(drops).select("doc_id", F.col("exact").alias(gone), F.col("near").alias(near)), "doc_id", "left")
    some = F.col(gone).isNotNull() & F.col("text").isNotNull()
    changed = joined.withColumn(new, _kept(F.when(some, F.col("text")), F.col(gone), F.col(near))).where(~some | F.col(new).isNotNull())
    out = {"text": F.when(some, F.col(new)).otherwise(F.col("text"))}
    if "n_chars" in names:
        out["n_chars"] = F.when(some, F.length(new).cast(kinds["n_chars"])).otherwise(F.col("n_chars"))
    return changed.select(*[out[c].alias(c) if c in out else F.col(c) for c in names])


def dedup(documents: DataFrame) -> DataFrame:
    return apply(documents, decisions(documents))


def report(documents: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, n_near, kept_sha256) per document; n_near: those without an equal earlier line."""
    docs = documents.select("doc_id", "text")
    joined = join_few(docs, packed(decisions(docs)), "doc_id", "left")
    fields = "doc_id long, n_lines long, n_dropped long, n_near long, kept_sha256 string"

    def start():
        import hashlib

        def run(cols):
            out: dict = {k: [] for k in ("doc_id", "n_lines", "n_dropped", "n_near", "kept_sha256")}
            for doc, text, exact, near in zip(cols["doc_id"], cols["text"], cols["exact"], cols["near"]):
                have, exact, near = (text or "").split("\n"), unpacked(exact), unpacked(near)
                gone = exact | near
                left = [x for i, x in enumerate(have) if i not in gone]
                out["doc_id"].append(doc), out["n_lines"].append(len(have)), out["n_dropped"].append(len(gone))
                out["n_near"].append(len(near - exact)), out["kept_sha256"].append(hashlib.sha256("\n".join(left).encode()).hexdigest())
            return out

        return run

    return map_columns(joined.select("doc_id", "text", "exact", "near"), fields, start)
