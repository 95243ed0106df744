"""BM25 from kept postings: a table with a row for each range of rows, searched range by range with score bounds.

A range holds up to ``RANGE_ROWS`` rows: their ids in order, their lengths, and for every term the rows
that have it and how often. Beside them stand, for every term, the number of its rows, its largest
count and the least length of its rows: no row of the range scores more on that term than a row with
both would. A task skips a range for a query whose bounds together can't reach the ``k``-th score that it
has already; all other ranges are scored in full, so the result is exact. Texts are tokenised once, when
the ranges are made; words are counted where they lie, and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators import blocks, tables

K1, B = 1.2, 0.75
#: Rows and tokens at which a range ends; a longer text is a range of its own.
RANGE_ROWS, RANGE_TOKENS = 4_096, 1 << 20


def query_terms(queries: DataFrame, drop_ratio: float = 0.0, idf: DataFrame | None = None) -> DataFrame:
    """(query_id, term) distinct; with ``idf`` (term, idf) the lightest ``drop_ratio`` of each query's terms go."""
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    if not drop_ratio or idf is None:
        return terms
    share = F.percent_rank().over(W.partitionBy("query_id").orderBy("idf", "term"))
    return terms.join(idf.hint("merge"), "term").withColumn("share", share).where(F.col("share") >= drop_ratio).select("query_id", "term")


def _range(ids: pa.Array, lists: pa.ListArray, only) -> dict:
    """One range as columns; ``only`` holds the terms that are kept, or None for all."""
    order = pc.sort_indices(ids)
    ids, lists = ids.take(order), lists.take(order)
    sizes = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    rows = np.repeat(np.arange(len(sizes)), sizes)
    if only is not None:
        kept = pc.is_in(words, value_set=only).to_numpy(zero_copy_only=False)
        asked = kept[codes] if len(codes) else np.zeros(0, dtype=bool)
        codes, rows = codes[asked], rows[asked]
    pairs, tf = np.unique(codes * max(1, len(sizes)) + rows, return_counts=True)
    codes, rows = np.divmod(pairs, max(1, len(sizes)))
    found, begins, counts = np.unique(codes, return_index=True, return_counts=True)
    most = np.maximum.reduceat(tf, begins) if len(found) else tf
    least = np.minimum.reduceat(sizes[rows], begins) if len(found) else tf
    return {"n": len(sizes), "tokens": int(sizes.sum()), "ids": ids, "dls": sizes, "terms": words.take(pa.array(found)), "counts": counts, "most": most, "least": least, "rows": rows, "tfs": tf}


def build(rows: DataFrame, id_: str = "id", text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """The ranges of ``rows`` (unique ids; rows without one are left out), to be written or ``cut``; with ``only`` (term) just the postings of these terms, if they are few enough to be sent to the tasks."""
    spark = rows.sparkSession
    tables.small_batches(spark)
    sent = None
    if only is not None and tables.measured_bytes(only) <= tables.BROADCAST_BYTES:
        sent = spark.sparkContext.broadcast(blocks.one_array(only.toArrow()["term"]))
    kind = dict(rows.dtypes)[id_]
    schema = f"number long, n long, tokens long, ids array<{kind}>, dls array<int>, terms array<string>, counts array<int>, most array<int>, least array<int>, rows array<int>, tfs array<int>"
    shape = blocks.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = None if sent is None else sent.value
        at, held, many, length = TaskContext.get().partitionId() << 32, [], 0, 0

        def out():
            nonlocal at, held, many, length
            table = pa.Table.from_batches(held).combine_chunks()
            one = _range(blocks.one_array(table["id"]), blocks.one_array(table["t"]), words)
            row = {"number": at} | one
            at, held, many, length = at + 1, [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in shape], schema=shape)

        for batch in batches:
            sizes = np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))
            begin = 0
            while begin < batch.num_rows:
                before = sizes[begin - 1] if begin else 0
                fits = int(np.searchsorted(sizes, before + RANGE_TOKENS - length, side="right")) - begin
                take = min(RANGE_ROWS - many, max(fits, 0 if many else 1), batch.num_rows - begin)
                if take <= 0:
                    yield out()
                    continue
                held.append(batch.slice(begin, take))
                many, begin = many + take, begin + take
                length += int(sizes[begin - 1] - before)
        if many:
            yield out()

    read = tables.dealt_out(rows.where(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.col(text).alias("t")))
    return read.select("id", tokens(F.col("t")).alias("t")).mapInArrow(run, schema)


def write(rows: DataFrame, path: str, id_: str = "id", text: str = "text") -> None:
    """Write the ranges of ``rows`` to ``path``, in row groups of bounded bytes."""
    build(rows, id_, text).write.options(**tables.WIDE_ROWS).mode("overwrite").parquet(path)


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs, one after the other: ``sizes`` of them from each of ``begins``."""
    return np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _units(scores: np.ndarray, unit: float, kind: type) -> np.ndarray:
    """``scores`` in whole units, rounded up."""
    return np.ceil(scores / unit).astype(kind)


class _Met:
    """A range as a block of queries meets it: the asked terms that it has, query by query, and what each can add to a row's score."""

    #: Postings that are looked up or added at once.
    AT_ONCE = 1 << 18

    def __init__(self, asked: tuple, row: pa.RecordBatch, weight: Callable):
        _, words, term, of, idf, _ = asked
        self.ids = row.column("ids").flatten()
        terms = row.column("terms").flatten()
        dls, counts, rows, tfs = (row.column(c).flatten().to_numpy() for c in ("dls", "counts", "rows", "tfs"))
        self.n, self.counts, self.rows = len(dls), counts.astype(np.int64), rows.astype(np.int64)
        self.begins = np.cumsum(self.counts) - self.counts
        self.weights = weight(tfs, dls[rows])
        tops = np.maximum.reduceat(self.weights, self.begins) if len(counts) else self.weights
        place = pc.index_in(words, value_set=terms).fill_null(-1).to_numpy()[term]
        here = np.flatnonzero(place >= 0)
        self.at, self.by, self.of = place[here], idf[here], of[here]
        self.bounds = self.by * tops[self.at]

    def of_queries(self, many: int) -> np.ndarray:
        """Where the terms of each query begin, and the end."""
        return np.searchsorted(self.of, np.arange(many + 1))

    def lines(self, asked: np.ndarray, common: float, unit: float, kind: type) -> tuple[list[np.ndarray], np.ndarray]:
        """What the common ones of the terms ``asked`` add to each row, in units, and the line of each term, or -1."""
        wide = asked[self.counts[asked] >= common]
        line_of, idf = np.full(len(self.counts), -1), np.zeros(len(self.counts))
        line_of[wide], idf[self.at] = np.arange(len(wide)), self.by  # a term's idf is the same in all queries
        out = np.zeros((len(wide), self.n), dtype=kind)
        sizes = self.counts[wide]
        places = _spread(self.begins[wide], sizes)
        out[np.repeat(np.arange(len(wide)), sizes), self.rows[places]] = _units(self.weights[places] * np.repeat(idf[wide], sizes), unit, kind)
        return list(out), line_of

    @cached_property
    def keys(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)) * self.n, self.counts) + self.rows

    def looked_up(self, rows: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each of ``rows`` what the terms from ``begins`` to ``ends`` add to its score."""
        out, sizes = np.zeros(len(rows)), ends - begins
        done = np.cumsum(sizes)
        first = 0
        while first < len(rows):
            last = max(first + 1, int(np.searchsorted(done, done[first] - sizes[first] + self.AT_ONCE, side="right")))
            some = sizes[first:last]
            pairs = _spread(begins[first:last], some)
            wanted = self.at[pairs] * self.n + np.repeat(rows[first:last], some)
            found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            out[first:last] = np.bincount(np.repeat(np.arange(last - first), some), weights=np.where(self.keys[found] == wanted, self.by[pairs] * self.weights[found], 0.0), minlength=last - first)
            first = last
        return out


def _first_of_each(of: np.ndarray, scores: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the ``k`` best rows of every query, and their places among the best of it."""
    order = np.lexsort((rows, -scores, of))
    nth = np.arange(len(of)) - np.searchsorted(of[order], of[order])
    return order[nth < k], nth[nth < k]


class _Asked:
    """Query blocks as a task meets them."""

    #: Queries kept at once; beyond it their rows are given out and begun anew.
    KEPT = 65_536

    def __init__(self, k: int, mean: float, k1: float, b: float):
        self.k, self.mean, self.k1, self.b = k, mean, k1, b
        self.asked = {}

    def weight(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / self.mean))

    def take_in(self, number: int, queries: pa.Table) -> None:
        lists = [blocks.one_array(queries[c]) for c in ("terms", "idfs")]
        coded = lists[0].flatten().dictionary_encode()
        of = np.repeat(np.arange(queries.num_rows), np.diff(lists[0].offsets.to_numpy()))
        least = queries["least"].to_numpy() if "least" in queries.column_names else np.full(queries.num_rows, -np.inf)
        self.asked[number] = queries["query_id"], coded.dictionary, coded.indices.to_numpy(), of, lists[1].flatten().to_numpy(), least


class Seeds(_Asked):
    """The exact scores of the rows that have one of a query's rarest terms (of an idf of ``least`` or more): the ``k`` best of them in a task."""

    def __init__(self, *given):
        super().__init__(*given)
        self.best = {}

    def add(self, number: int, queries: pa.Table, row: pa.RecordBatch):
        if number not in self.best:
            if sum(map(len, self.best.values())) + queries.num_rows > self.KEPT:
                yield from self.rest()
            self.take_in(number, queries)
            self.best[number] = np.full((queries.num_rows, self.k), -np.inf)
        best, met = self.best[number], _Met(self.asked[number], row, self.weight)
        rare = np.flatnonzero(met.by >= self.asked[number][5][met.of])
        if not len(rare):
            return
        sizes = met.counts[met.at[rare]]
        q, r = np.divmod(np.unique(np.repeat(met.of[rare] * met.n, sizes) + met.rows[_spread(met.begins[met.at[rare]], sizes)]), met.n)
        ends = met.of_queries(len(best))
        scores = np.round(met.looked_up(r, ends[q], ends[q + 1]), 6)
        order, nth = _first_of_each(q, scores, r, self.k)
        new = np.full(best.shape, -np.inf)
        new[q[order], nth] = scores[order]
        some = np.unique(q)
        best[some] = -np.sort(-np.concatenate([best[some], new[some]], axis=1), axis=1)[:, : self.k]

    def rest(self):
        for number, best in self.best.items():
            q, nth = np.nonzero(best > -np.inf)
            if len(q):
                yield {"query_id": blocks.one_array(self.asked[number][0]).take(pa.array(q)), "score": best[q, nth]}
        self.best, self.asked = {}, {}


class Scores(_Asked):
    """The best ``k`` rows of every query that a task has met; counts the ranges it could skip.

    A query may come with a ``floor`` that its k-th score is known to reach. Common terms of a range are laid out over
    all of its rows, rounded up to small whole numbers, so that a query adds whole rows of numbers; their
    sums are bounds, and rows whose bound reaches the k-th score are scored exactly.
    """

    #: Queries whose sums are held at once, and the part of a range's rows from which a term is common.
    QUERIES, COMMON = 64, 1 / 24

    def __init__(self, k: int, mean: float, k1: float, b: float, report: bool = False):
        super().__init__(k, mean, k1, b)
        self.report = report
        self.best, self.known, self.met, self.skipped = {}, {}, 0, 0

    def add(self, number: int, queries: pa.Table, row: pa.RecordBatch):
        if number not in self.best:
            if sum(map(len, self.best.values())) + queries.num_rows > self.KEPT:
                yield from self.rest()
            self.take_in(number, queries)
            self.best[number] = [[] for _ in range(queries.num_rows)]
            self.known[number] = queries["floor"].to_numpy().copy() if "floor" in queries.column_names else np.full(queries.num_rows, -np.inf)
        known, met = self.known[number], _Met(self.asked[number], row, self.weight)
        within = np.bincount(met.of, weights=met.bounds, minlength=len(known))
        alive = (within > 0) & (within >= self._near(known))
        self.met, self.skipped = self.met + int((within > 0).sum()), self.skipped + int(((within > 0) & ~alive).sum())
        those, ends = np.flatnonzero(alive), met.of_queries(len(known))
        if not len(those):
            return
        many = int((ends[those + 1] - ends[those]).max())
        kind = np.uint16 if many < 1 << 12 else np.uint32
        unit = float(within[those].max()) / (np.iinfo(kind).max - many)  # so that no sum of bounds, each rounded up, is too large
        lines, line_of = met.lines(np.unique(met.at[alive[met.of]]), max(4.0, self.COMMON * met.n), unit, kind)
        done = np.cumsum(np.bincount(met.of, weights=np.where(line_of[met.at] < 0, met.counts[met.at], 0), minlength=len(known))[those])
        first = 0
        while first < len(those):
            fits = int(np.searchsorted(done, (done[first - 1] if first else 0) + met.AT_ONCE, side="right"))
            some = those[first : min(first + self.QUERIES, max(first + 1, fits))]
            self._score(number, met, some, ends, self._bounds(met, some, ends, lines, line_of, unit, kind), unit)
            first += len(some)

    @staticmethod
    def _near(known: np.ndarray) -> np.ndarray:
        """What reaches ``known`` but for rounding."""
        return known - 1e-6 - 1e-9 * np.abs(known)

    @staticmethod
    def _bounds(met: _Met, some: np.ndarray, ends: np.ndarray, lines: list[np.ndarray], line_of: np.ndarray, unit: float, kind: type) -> np.ndarray:
        """Bounds of the scores of all rows for the queries ``some``, in units."""
        many = ends[some + 1] - ends[some]
        pairs = _spread(ends[some], many)
        of, line = np.repeat(np.arange(len(some)), many), line_of[met.at[pairs]]
        few = line < 0
        sizes = met.counts[met.at[pairs[few]]]
        places = _spread(met.begins[met.at[pairs[few]]], sizes)
        sums = np.zeros((len(some), met.n), dtype=kind)
        np.add.at(sums.reshape(-1), np.repeat(of[few] * met.n, sizes) + met.rows[places], _units(np.repeat(met.by[pairs[few]], sizes) * met.weights[places], unit, kind))
        add, own = np.add, list(sums)
        for one, added in zip(of[~few].tolist(), line[~few].tolist()):
            add(own[one], lines[added], own[one])
        return sums

    def _score(self, number: int, met: _Met, some: np.ndarray, ends: np.ndarray, sums: np.ndarray, unit: float) -> None:
        known = self.known[number]
        least = np.maximum(np.floor(self._near(known[some]) / unit), 1)
        found = []
        for j in np.flatnonzero(sums.max(axis=1) >= least).tolist():
            own = sums[j]
            rows = np.flatnonzero(own >= least[j])
            if len(rows) > 4 * self.k:  # the k best by their bounds are at most a unit for each term below them
                edge = int(np.partition(own[rows], len(rows) - self.k)[len(rows) - self.k]) - int(ends[some[j] + 1] - ends[some[j]])
                rows = rows[own[rows] >= edge]
            found.append((np.full(len(rows), some[j]), rows))
        if not found:
            return
        q, r = map(np.concatenate, zip(*found))
        scores = np.round(met.looked_up(r, ends[q], ends[q + 1]), 6)
        kept = (scores >= known[q]) & (scores > 0)
        q, r, scores = q[kept], r[kept], scores[kept]
        order, _ = _first_of_each(q, scores, r, self.k)
        q, scores, names = q[order], scores[order], met.ids.take(pa.array(r[order])).to_pylist()
        best = self.best[number]
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(q)]):
            one = q[begin]
            best[one] = sorted([*best[one], *zip((-scores[begin:end]).tolist(), names[begin:end])])[: self.k]
            if len(best[one]) == self.k:
                known[one] = max(known[one], -best[one][-1][0])

    def rest(self):
        for number, best in self.best.items():
            names = self.asked[number][0].to_pylist()
            rows = [(names[q], i, -s) for q, found in enumerate(best) for s, i in found]
            if rows and not self.report:
                yield dict(zip(("query_id", "id", "score"), zip(*rows)))
        if self.report and self.met:
            yield {"met": [self.met], "skipped": [self.skipped]}
        self.best, self.known, self.asked, self.met, self.skipped = {}, {}, {}, 0, 0


def weights(index: DataFrame, terms: DataFrame) -> tuple[int, float, DataFrame]:
    """The number and the mean length of all rows, and (term, df, idf) of ``terms``: idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    n, total = index.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.counts").alias("df"))
    df = pairs.groupBy("term").agg(F.sum("df").alias("df")).join(terms.hint("merge"), "term", "left_semi")
    return n, float(total / n if n and total else 1.0), df.select("term", "df", F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


#: Rows with the rarest terms of a query that are scored first; one term may have more, up to ``SEED_ROWS`` of ``SEED_OF`` rows.
SEED_ROWS, SEED_OF = 256, 256_000


def _parts(packed: DataFrame) -> list[DataFrame]:
    """Written query blocks in parts that are small enough to be sent to the tasks; a block is thousands of queries, so their sizes are few."""
    parts, held = [], 0
    for number, size in packed.select("number", F.octet_length("block") + 64).orderBy("number").collect():
        if not parts or held + size > tables.BROADCAST_BYTES:
            parts, held = [*parts, []], 0
        parts[-1].append(number)
        held += size
    return [packed if len(parts) == 1 else packed.where(F.col("number").isin(part)) for part in parts] or [packed]


def _meet(lists: DataFrame, index: DataFrame, start: Callable[[], object], schema: str) -> DataFrame:
    """What ``start()`` finds for all queries: one part of them after the other meets the ranges where these lie, so no range is copied or shuffled, whatever the number of queries."""
    spark, key, found = index.sparkSession, "spark.sql.files.minPartitionNum", None
    given = spark.conf.get(key, None)
    for part in _parts(blocks.pack_queries(lists)):
        try:
            spark.conf.set(key, str(TASKS * spark.sparkContext.defaultParallelism))
            some = tables.cut(blocks.meet(part, index, start, schema, read=lambda row: row))
        finally:
            spark.conf.unset(key) if given is None else spark.conf.set(key, given)
        found = some if found is None else found.unionByName(some)
    return found


#: Tasks a core in which ranges are read, so that cores end at about the same time.
TASKS = 4


def _lists(queries: DataFrame, index: DataFrame, drop_ratio: float) -> tuple[float, DataFrame]:
    """The mean length of all rows, and (query_id, terms, idfs, least): the terms from the commonest on, and the idf from which they are rare."""
    terms = query_terms(queries)
    n, mean, idf = weights(index, terms.select("term").distinct())
    idf = tables.cut(idf)
    asked = query_terms(queries, drop_ratio, idf) if drop_ratio else terms
    rarest = W.partitionBy("query_id").orderBy("df", "term")
    alone = (F.row_number().over(rarest) == 1) & (F.col("df") <= SEED_ROWS * max(1, n // SEED_OF))
    pairs = asked.join(idf.hint("merge"), "term").withColumn("rare", (F.sum("df").over(rarest) <= SEED_ROWS) | alone)
    lists = pairs.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("idf", "term"))).alias("t"), F.coalesce(F.min(F.when(F.col("rare"), F.col("idf"))), F.lit(float("inf"))).alias("least"))
    return mean, tables.cut(lists.select("query_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("idfs"), "least"))


def _search(lists: DataFrame, index: DataFrame, k: int, mean: float, k1: float, b: float, report: bool, schema: str) -> DataFrame:
    """``schema`` for ``lists`` (query_id, terms, idfs, least): rows with rare terms give each query a score that its k-th can't be below, then all ranges are searched."""
    seeds = _meet(lists, index, lambda: Seeds(k, mean, k1, b), f"query_id {dict(lists.dtypes)['query_id']}, score double")
    # sums of another order may differ in the last digit that is kept
    floors = seeds.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("floor")).select("query_id", (F.col("floor") - 2e-6).alias("floor"))
    lists = lists.join(floors.hint("merge"), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    return _meet(lists, index, lambda: Scores(k, mean, k1, b, report), schema)


def search(queries: DataFrame, index: DataFrame, k: int, k1: float = K1, b: float = B, drop_ratio: float = 0.0) -> DataFrame:
    """(query_id, id, score, rank) of queries (query_id, text) over written ranges; queries that ask for the same terms of the index are searched once."""
    kinds = dict(queries.dtypes)["query_id"], dict(index.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    mean, lists = _lists(queries, index, drop_ratio)
    once = tables.cut(lists.groupBy("terms").agg(F.min("query_id").alias("query_id"), F.first("idfs").alias("idfs"), F.first("least").alias("least")))
    found = _search(once.select("query_id", "terms", "idfs", "least"), index, k, mean, k1, b, False, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = tables.join_few(lists.select("query_id", "terms"), once.select("terms", F.col("query_id").alias("asked")), "terms").select("query_id", "asked")
    return names.join(best.withColumnRenamed("query_id", "asked").hint("merge"), "asked").select("query_id", "id", "score", "rank")


def skipped(queries: DataFrame, index: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(met, skipped): pairs of a query and a range with one of its terms, and those that needed no scoring."""
    mean, lists = _lists(queries, index, 0.0)
    counted = _search(lists, index, k, mean, k1, b, True, "met long, skipped long")
    return counted.agg(F.coalesce(F.sum("met"), F.lit(0)).alias("met"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))
