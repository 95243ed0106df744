"""N-gram Jaccard join: documents whose word-shingle sets are at most ``RADIUS`` apart, as components.

Jaccard distance is a metric, so pivots and the triangle inequality cut the space. Texts make this
hard: unrelated ones are all about 1 apart, every document then lies in the window of every pivot,
and plain Voronoi regions hold everything. So the outermost regions are cells in slices of the
shingle space, and documents are pivots inside them:

1. Equal sets are one point, whatever their doc_ids (a 128-bit fingerprint of the content).
2. Two sets of close sizes within the radius differ in fewer than ``m`` shingles. Cut the shingle
   space into ``m`` slices: in one at least, both are at distance 0. A point goes into the cell of
   its content in every slice, for its size level and where the bound on sizes asks for it for the
   level below; these windows are complete by counting.
   Points that share cells, directly or over others, are a region; every close pair lies in one.
3. A region joins recursively. ``PIVOTS`` of its points are pivots; all exact distances to them are
   taken, and those within the radius are links. Each point goes to its nearest pivot's Voronoi
   region, and to every other whose distance is within twice the radius of that. In a region,
   points within the radius of the pivot are linked through it; the rest goes on, with those of the
   ball that the triangle inequality lets be their partners. Spark does these steps over regions of
   more than ``LEAF`` points; smaller ones lie in one task, which goes on in the same way down to
   ``FEW`` points, joined exactly.
4. Pivots don't thin out a region whose points are all about equally far apart, as texts are that
   share a long passage. In a task such a region is joined exactly at once. A larger one is parted by
   its own shingles: two close sets share one of their first ``n - ceil(t n) + 1`` in an order in
   which what is frequent in the region comes last. Parts that share points are one region again where
   a task can hold it. From a part go the points that no other there can be close to by size and
   sketch, before any set is sent, and of regions of the same points one is joined. Where that fails too, it is cut into blocks, each two of
   which are a region; that is quadratic in such a region, but complete.
5. Links become components by star contraction.

Defined results: a null or blank text has no shingles and is its own component; a null doc_id keeps
a null component; repeated rows get the same one. doc_id is the key: where different texts share
one, the links of all of them are its links, and n_shingles is each row's own.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, cut_at, forget, join_few, map_columns, strategy, utf8

#: Linked when PER_CENT * union <= 100 * intersection.
PER_CENT = 90
WORDS = 3
#: Words whose hashes a task keeps.
KNOWN_WORDS = 100_000
#: Points that a task remembers; a copy of one of them needs no cells of its own, as the first has them.
KNOWN_POINTS = 200_000
#: Sizes of one level go up by this factor; levels a little wider than the bound on sizes give the fewest cells.
LEVEL = 1.37


#: A region of at most so many points lies in one task.
LEAF = 2_000
#: Pivots of a region.
PIVOTS = 4
#: Points that are compared with each other without pivots.
FEW = 8
#: Pivots thin a region out if they send each of its points to fewer regions than this, on average.
THIN = 1.5
#: One point in so many tells what is frequent in a region, and the share of them from which a shingle is.
TELL, OFTEN = 64, 0.02
#: Least bits of a sketch; a larger set has the power of two from its size on.
SKETCH = 1024


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, known: dict[bytes, int], words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    ids = []
    for w in found:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(h)
    x = np.array(ids, dtype=np.uint64)
    k = min(words, len(x))
    out = np.full(len(x) - k + 1, np.uint64(k))
    for i in range(k):
        out = _mix(out ^ x[i : len(x) - k + 1 + i]) + np.uint64(i)
    return np.unique(out)


class Levels:
    """Size levels of the sets, and the slices of each: more than two close sets can differ by."""

    def __init__(self, per_cent: int):
        self.per_cent, self.low, self.high = per_cent, [1], []

    def level(self, n: int) -> int:
        while not self.high or self.high[-1] < n:
            lo = self.low[-1]
            self.high.append(max(int(lo * LEVEL), lo * 100 // self.per_cent))
            self.low.append(self.high[-1] + 1)
        return int(np.searchsorted(self.high, n))

    def slices(self, level: int) -> tuple[int, int]:
        """How many slices, and how many of them a point may leave empty and still agree with any close one in a full slice."""
        most = self.high[level] + self.high[level] * 100 // self.per_cent
        least = most * (100 - self.per_cent) // (100 + self.per_cent) + 1
        spare = 1 + least // 16 if least > 1 else 0
        return least + spare, spare

    def of(self, n: int) -> list[int]:
        at = self.level(n)
        return [at, at - 1] if at and -(-n * self.per_cent // 100) <= self.high[at - 1] else [at]


def cells(hashes: np.ndarray, levels: Levels) -> np.ndarray:
    """The keys of a set's cells: its content in each slice. Sorted hashes lie in order of slices.

    Many unrelated points agree in an empty slice. Those that have no more of them than there are
    slices to spare leave them out: a close pair agrees in so many more that a full one is among them.
    """
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mix(hashes), dtype=np.uint64)])
    out = []
    for level in levels.of(len(hashes)):
        m, spare = levels.slices(level)
        edge = np.searchsorted(hashes >> np.uint64(32), (np.arange(m + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(m))
        edge[-1] = len(hashes)
        keys = _mix(_mix(sums[edge[1:]] - sums[edge[:-1]]) + np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level + 1))
        full = edge[1:] > edge[:-1]
        out.append(keys[full] if m - int(full.sum()) <= spare else keys)
    return np.concatenate(out).view(np.int64)


def _signed(x: np.ndarray) -> int:
    return int(x.sum(dtype=np.uint64).view(np.int64))


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """Two longs that tell sets apart."""
    return _signed(_mix(hashes)), _signed(_mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One bit for the parity of the hashes that fall on it, as bytes: two sets differ in as many elements as their sketches do in bits, at least."""
    bits = max(SKETCH, 1 << (len(hashes) - 1).bit_length())
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool))


class Sketches:
    """Sketches of points that are sorted by size, and so by width; a wider one is folded onto a narrower, which gives the sketch of that width."""

    def __init__(self, sketches: list[bytes]):
        self.width = np.array([len(x) // 8 for x in sketches])
        self.begin = {int(w): int(np.searchsorted(self.width, w)) for w in np.unique(self.width)}
        self.words = {w: np.frombuffer(b"".join(sketches[lo : int(np.searchsorted(self.width, w, side="right"))]), dtype=np.uint64).reshape(-1, w) for w, lo in self.begin.items()}

    def differ(self, i: int, rest: np.ndarray) -> np.ndarray:
        """In how many bits point i and each of ``rest``, none of them smaller, differ."""
        w, out, widths = int(self.width[i]), np.zeros(len(rest), dtype=np.int64), self.width[rest]
        own = self.words[w][i - self.begin[w]]
        for v in map(int, np.unique(widths)):
            x = self.words[v][rest[widths == v] - self.begin[v]]
            out[widths == v] = np.bitwise_count((np.bitwise_xor.reduce(x.reshape(len(x), -1, w), axis=1) if v > w else x) ^ own).sum(axis=1)
        return out


def _digests(documents: DataFrame, per_cent: int, words: int) -> DataFrame:
    def start():
        known: dict = {}
        filed: set = set()  # points whose cells this task has given
        levels = Levels(per_cent)

        def run(cols):
            out: dict = {k: [] for k in ("row", "doc_id", "n", "a", "b", "cells")}
            for row, doc, text in zip(cols["row"], cols["doc_id"], cols["utf8"]):
                if len(known) > KNOWN_WORDS:
                    known.clear()
                if len(filed) > KNOWN_POINTS:
                    filed.clear()
                s = shingle_set(text, known, words)
                a, b = fingerprint(s)
                new = doc is not None and (a, b) not in filed
                if new:
                    filed.add((a, b))
                out["row"].append(row), out["doc_id"].append(doc), out["n"].append(len(s)), out["cells"].append(cells(s, levels) if new else [])
                out["a"].append(a), out["b"].append(b)
            return out

        return run

    return map_columns(documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", utf8()), "row long, doc_id long, n long, a long, b long, cells array<long>", start)


def _sets(documents: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(x, n, sketch, shingles) of the wanted points (x, doc_id, a, b); of the texts of a doc_id, the one with the point's fingerprint."""

    def start():
        known: dict = {}

        def run(cols):
            if len(known) > KNOWN_WORDS:
                known.clear()
            out: dict = {"x": [], "n": [], "sketch": [], "shingles": []}
            for text, points in zip(cols["utf8"], cols["points"]):
                s = shingle_set(text, known, words)
                own = fingerprint(s)
                for p in points:
                    if (p["a"], p["b"]) == own:
                        out["x"].append(p["x"]), out["n"].append(len(s)), out["sketch"].append(sketch(s).tobytes()), out["shingles"].append(s.view(np.int64))
            return out

        return run

    few = join_few(documents.select("doc_id", utf8()), wanted.groupBy("doc_id").agg(F.collect_list(F.struct("x", "a", "b")).alias("points")), "doc_id")
    return map_columns(few, "x long, n long, sketch binary, shingles array<long>", start).dropDuplicates(["x"])


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(p, x, inter, total) for distinct pairs of a pivot p and a point x: a point's set is shuffled once, those of the pivots are broadcast where their measured bytes allow."""
    own = cut(pairs.select("p").distinct().join(sets.select(F.col("x").alias("p"), F.col("shingles").alias("ps")).hint("merge"), "p"))
    to = pairs.groupBy("x").agg(F.collect_list("p").alias("to"))  # PIVOTS for each region that x is in
    rows = to.join(sets.hint("merge"), "x").select("x", F.col("shingles").alias("xs"), F.explode("to").alias("p")).join(own.hint(strategy(own)), "p").select("p", "x", "xs", "ps")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            xs, ps = batch.column(2), batch.column(3)
            inter = np.array([len(np.intersect1d(xs[k].values.to_numpy(), ps[k].values.to_numpy(), assume_unique=True)) for k in range(batch.num_rows)], dtype=np.int64)
            both = np.array([len(xs[k]) + len(ps[k]) for k in range(batch.num_rows)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(inter), pa.array(both - inter)], names=["p", "x", "inter", "total"])

    return rows.mapInArrow(run, "p long, x long, inter long, total long")


class Leaf:
    """A region in one task: ``links`` connects what is close among its points. Pairs that earlier links connect already need no look."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], per_cent: int):
        order = sorted(range(len(ids)), key=lambda i: len(sets[i]))
        self.ids, self.sets, self.per_cent = [ids[i] for i in order], [sets[i].view(np.uint64) for i in order], per_cent  # in which order they are sorted
        self.sizes = np.array([len(s) for s in self.sets])
        self.label = np.arange(len(ids))
        self.found: list[tuple[int, int]] = []
        self.sketches: Sketches | None = None

    def _link(self, i: int, j: int) -> None:
        if self.label[i] != self.label[j]:
            self.found.append((self.ids[i], self.ids[j]))
            self.label[self.label == self.label[j]] = self.label[i]

    def _close(self, inter, i, j):
        return 100 * inter >= self.per_cent * (self.sizes[i] + self.sizes[j] - inter)

    def _together(self, pivot: int, at: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the pivot's set with others."""
        own, every = self.sets[pivot], np.concatenate([self.sets[i] for i in at])
        place = np.minimum(np.searchsorted(own, every), len(own) - 1)
        return np.add.reduceat((own[place] == every).astype(np.int64), np.cumsum(self.sizes[at]) - self.sizes[at])

    def _exactly(self, at: np.ndarray) -> None:
        """All pairs, smaller sets first, by sketches and then in full."""
        if self.sketches is None:
            self.sketches = Sketches([sketch(s).tobytes() for s in self.sets])
        at = np.sort(at)  # by size
        for k, i in enumerate(at[:-1]):
            rest = at[k + 1 : int(np.searchsorted(self.sizes[at], self.sizes[i] * 100 // self.per_cent, side="right"))]
            rest = rest[self.label[rest] != self.label[i]]
            if len(rest):
                differ = self.sketches.differ(i, rest)
                for j in rest[differ * (100 + self.per_cent) <= (self.sizes[rest] + self.sizes[i]) * (100 - self.per_cent)]:
                    if self.label[i] != self.label[j] and self._close(len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)), i, j):
                        self._link(i, j)

    def links(self) -> list[tuple[int, int]]:
        radius = 1 - self.per_cent / 100 + 1e-12
        open_ = [np.arange(len(self.ids))]
        while open_:
            at = open_.pop()
            if len(at) < 2 or (self.label[at] == self.label[at[0]]).all():
                continue
            if len(at) <= FEW:
                self._exactly(at)
                continue
            pivots, rest, far = [], at, []
            for _ in range(PIVOTS):  # each next one is the farthest from those before
                p = rest[np.argmax(np.min(far, axis=0))] if far else rest[len(rest) // 2]
                keep = rest != p
                far, rest = [d[keep] for d in far], rest[keep]
                inter = self._together(p, rest)
                far.append(1 - inter / (self.sizes[rest] + self.sizes[p] - inter))
                pivots.append(p)
                for j in rest[self._close(inter, rest, p)]:
                    self._link(p, j)
            d = np.array(far)  # pivots are done: each was compared with all that were left
            homes = d <= d.min(axis=0) + 2 * radius
            if homes.sum() > THIN * len(rest):
                self._exactly(rest)
                continue
            for i in range(PIVOTS):
                mine, own = rest[homes[i]], d[i][homes[i]]
                outer = own[own > radius]
                if len(outer):
                    open_.append(mine[own >= outer.min() - radius])
        return self.found


def _leaves(regions: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Links (u, v) within regions of at most LEAF points."""

    def run(batches):
        import pyarrow as pa

        def close(ids, shingles):
            got = Leaf(ids, shingles, per_cent).links() if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], names=["u", "v"])

        now, ids, shingles = None, [], []
        for batch in batches:
            lists = batch.column(2)
            for k, (region, x) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if region != now:
                    yield close(ids, shingles)
                    now, ids, shingles = region, [], []
                ids.append(x)
                shingles.append(lists[k].values.to_numpy())
        yield close(ids, shingles)

    rows = regions.join(sets.hint("merge"), "x").select("region", "x", "shingles")
    parts = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "region").sortWithinPartitions("region").mapInArrow(run, "u long, v long")


def partnered(sizes: np.ndarray, sketches: list[bytes], per_cent: int) -> np.ndarray:
    """Which of some points another of them may be close to, by their sizes and sketches."""
    order = np.argsort(sizes, kind="stable")
    n, bits, has = sizes[order], Sketches([sketches[i] for i in order]), np.zeros(len(order), dtype=bool)
    last = np.searchsorted(n, n * 100 // per_cent, side="right")
    for i in range(len(n) - 1):
        rest = np.arange(i + 1, last[i])
        if has[i]:
            rest = rest[~has[rest]]
        near = rest[bits.differ(i, rest) * (100 + per_cent) <= (n[rest] + n[i]) * (100 - per_cent)]
        if len(near):
            has[i] = has[near] = True
    out = np.zeros(len(order), dtype=bool)
    out[order] = has
    return out


def _partnered(regions: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Regions of at most LEAF points without the points that no other of the same region can be close to; what travels is a sketch of each, not its set."""

    def run(batches):
        import pyarrow as pa

        def left(region, ids, sizes, sketches):
            has = partnered(np.array(sizes), sketches, per_cent) if len(ids) > 1 else np.zeros(len(ids), dtype=bool)
            own = np.array(ids, dtype=np.int64)[has]
            return pa.RecordBatch.from_arrays([pa.array([region] * len(own), pa.int64()), pa.array(own)], names=["region", "x"])

        now, ids, sizes, sketches = None, [], [], []
        for batch in batches:
            for region, x, n, bits in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if region != now:
                    yield left(now, ids, sizes, sketches)
                    now, ids, sizes, sketches = region, [], [], []
                ids.append(x), sizes.append(n), sketches.append(bits)
        yield left(now, ids, sizes, sketches)

    rows = regions.join(sets.select("x", "n", "sketch").hint("merge"), "x").select("region", "x", "n", "sketch")
    parts = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "region").sortWithinPartitions("region").mapInArrow(run, "region long, x long")


def _once(regions: DataFrame) -> DataFrame:
    """(region, x, n) of regions of two points or more, with their sizes; of those with the same points, which have the same links, one."""
    members = regions.groupBy("region").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("x")).alias("f"), F.bit_xor(F.xxhash64(F.lit(7), "x")).alias("g")).where("n > 1")
    one = members.groupBy("n", "f", "g").agg(F.min("region").alias("region")).select("region", "n")
    return regions.join(one.hint("merge"), "region").select("region", "x", "n")


def _split(regions: DataFrame, sets: DataFrame, per_cent: int) -> tuple[DataFrame, DataFrame]:
    """One step into large regions: links to their pivots, and the regions (region, x) of all pairs still open."""
    radius = 1 - per_cent / 100 + 1e-12
    dealt = regions.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(PIVOTS)))
    pivots = cut(dealt.groupBy("region", "part").agg(F.min("x").alias("p")))
    rows = regions.join(pivots.select("region", "p").hint("merge"), "region").where("p <> x")
    far = cut(_distances(rows.select("p", "x").distinct(), sets))
    found = far.where(F.col("inter") * 100 >= F.col("total") * per_cent).select(F.col("p").alias("u"), F.col("x").alias("v"))
    # pivots are done: each was compared with all points of its region
    rest = dealt.join(pivots.hint("merge"), ["region", "part"]).where("x <> p").select("region", "x")
    d = far.select("p", "x", (1 - F.col("inter") / F.col("total")).alias("d"))
    measured = rest.join(pivots.select("region", "p").hint("merge"), "region").join(d.hint("merge"), ["p", "x"])
    near = measured.groupBy("region", "x").agg(F.array_sort(F.collect_list(F.struct("p", "d"))).alias("to"))  # PIVOTS entries
    near = near.withColumn("homes", F.filter("to", lambda t: t["d"] <= F.array_min(F.col("to.d")) + 2 * radius))
    split = near.groupBy("region").agg((F.sum(F.size("homes")) <= THIN * F.count("*")).alias("split"))
    placed = near.join(split.hint("merge"), "region").select("region", "x", F.explode(F.when(F.col("split"), F.col("homes")).otherwise(F.slice("to", 1, 1))).alias("h"))
    cells_ = cut(placed.select(F.xxhash64("region", "h.p").alias("region"), "x", F.col("h.d").alias("d")))
    out = cells_.groupBy("region").agg(F.min(F.when(F.col("d") > radius, F.col("d"))).alias("nearest_out")).where("nearest_out is not null")
    return found, cells_.join(out.hint("merge"), "region").where(F.col("d") >= F.col("nearest_out") - radius).select("region", "x")


def _by_rare_shingles(regions: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Regions that pivots don't thin out, parted by shingles: (region, x) for each of the first of x in an order of the region.

    Any order that all sets of a region share is complete. What many of the region's points have comes last, so that the first ones part
    them; which those are is told by one point in ``TELL``, as that decides no more than the order. No shingle is counted over all points.
    """
    some = regions.where(F.pmod(F.xxhash64(F.lit(9), "x"), F.lit(TELL)) == 0)
    told = join_few(sets, some, "x").select("region", F.explode("shingles").alias("shingle")).groupBy("region", "shingle").agg(F.count("*").alias("times")).where("times > 1")
    often = told.join(some.groupBy("region").agg(F.count("*").alias("size")).hint("merge"), "region").where(F.col("times") >= OFTEN * F.col("size"))
    # of each region no more than its average set times 1 / OFTEN
    last = often.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("times", "shingle"))).alias("last")).select("region", F.col("last.shingle").alias("last"))
    rows = join_few(join_few(sets, regions, "x"), last, "region", "left").select("region", "x", "shingles", "last")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, xs = [], []
            for k in range(batch.num_rows):
                region, x = np.int64(batch.column(0)[k].as_py()).view(np.uint64), batch.column(1)[k].as_py()
                own, after = batch.column(2)[k].values.to_numpy().view(np.uint64), batch.column(3)[k].values
                after = np.zeros(0, dtype=np.uint64) if after is None else after.to_numpy().view(np.uint64)
                common = np.isin(own, after)
                rare = own[~common]
                order = np.concatenate([rare[np.argsort(_mix(rare))], after[np.isin(after, own)]])
                first = order[: len(own) + (-len(own) * per_cent // 100) + 1]  # n - ceil(n * per_cent / 100) + 1
                keys.append(_mix(_mix(first) ^ region)), xs.append(np.full(len(first), x, dtype=np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(xs))], names=["region", "x"])

    return rows.mapInArrow(run, "region long, x long")


def _blocks(regions: DataFrame) -> DataFrame:
    """Regions that nothing thins out: every two blocks of their points, as regions small enough for one task."""
    sized = regions.join(regions.groupBy("region").agg(F.ceil(F.count("*") * 4 / LEAF).cast("int").alias("k")).hint("merge"), "region")
    mine = sized.withColumn("b", F.pmod(F.xxhash64(F.lit(5), "x"), F.col("k")).cast("int"))
    pair = mine.select("region", "x", "b", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    return pair.select(F.xxhash64("region", F.least("b", "o"), F.greatest("b", "o")).alias("region"), "x")


def _regions(points: DataFrame) -> DataFrame:
    """(region, a): points that share cells, directly or over others, by the first half of their fingerprint.

    Nothing is linked yet, so two sets that agree in that half only make a region larger.
    """

    def run(batches):
        import pyarrow as pa

        cell = own = None
        for batch in batches:
            cells_, a = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(a):
                continue
            same = np.empty(len(a), dtype=bool)
            same[1:] = (cells_[1:] == cells_[:-1]) & (a[1:] != a[:-1])
            same[0] = cells_[0] == cell and a[0] != own
            before = np.append(a[:1] if own is None else [own], a[:-1])
            pairs = np.unique(np.stack([before[same], a[same]]), axis=1)
            cell, own = cells_[-1], a[-1]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

    # sorted, what shares a cell stands side by side: each is linked with the one before it, and a cell of any size passes through a task as a stream
    keyed = points.select(F.explode("cells").alias("cell"), "a")
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chained = keyed.repartition(parts, "cell").sortWithinPartitions("cell", "a").mapInArrow(run, "u long, v long")
    return components(chained).select(F.col("component").alias("region"), F.col("node").alias("a"))


def _gathered(parts: DataFrame) -> DataFrame:
    """(region, x): parts that share points as one region where one task can hold it, so that a set is sent there once and not once for each of its shingles; the others as they are."""
    whole = cut(_regions(parts.select(F.array("region").alias("cells"), F.col("x").alias("a"))).withColumnRenamed("a", "x"))
    sized = cut(whole.join(whole.groupBy("region").agg(F.count("*").alias("n")).hint("merge"), "region"))
    large = sized.where(F.col("n") > LEAF).select("x")
    return sized.where(F.col("n") <= LEAF).select("region", "x").unionByName(parts.join(large.hint("merge"), "x", "left_semi").select("region", "x"))


def links(documents: DataFrame, regions: DataFrame, classes: DataFrame, per_cent: int = PER_CENT, words: int = WORDS) -> DataFrame:
    """Links (u, v) between points, by their ``x``, within regions (region, x); their components are those of all close pairs."""
    wanted = classes.join(regions.select("x").hint("merge"), "x", "left_semi").select("x", "doc_id", "a", "b")
    sets = cut(_sets(documents, wanted, words))
    found, parted = None, False
    while True:
        sized = cut(_once(regions))
        leaves = sized.where(F.col("n") <= LEAF).select("region", "x")
        if parted:  # a point is in a part for each of its first shingles: its set goes only where a partner may be
            leaves = cut(_once(cut(_partnered(leaves, sets, per_cent)))).select("region", "x")
        small = cut(_leaves(leaves, sets, per_cent))
        found = small if found is None else found.unionByName(small)
        large = sized.where(F.col("n") > LEAF).select("region", "x")
        before = large.count()
        if not before:
            return found
        more, left = _split(large, sets, per_cent)
        found, regions = found.unionByName(more), cut(left)
        if regions.count() > 0.6 * before:
            regions = _blocks(regions) if parted else cut(_gathered(cut(_by_rare_shingles(regions, sets, per_cent))))
            parted = True


def join(documents: DataFrame, per_cent: int = PER_CENT, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    digests, path = cut_at(_digests(documents, per_cent, words))
    points = digests.where("n > 0 and doc_id is not null")
    classes = cut(points.groupBy("a", "b").agg(F.min("row").alias("x"), F.min("doc_id").alias("doc_id")))
    named = cut(points.select("doc_id", "n", "a", "b").join(classes.select("a", "b", "x").hint("merge"), ["a", "b"]).select("doc_id", "n", "x"))
    blank = cut(digests.where("n = 0 or doc_id is null").select("doc_id", "n"))
    regions = cut(_regions(points).join(classes.select("a", "x").hint("merge"), "a").select("region", "x"))
    forget(documents.sparkSession, path)  # the cells, which are about as large as the texts
    # the texts of one doc_id hold together
    same = named.groupBy("doc_id").agg(F.min("x").alias("u"), F.max("x").alias("last")).where("u < last").select("doc_id", "u")
    held = named.join(same.hint("merge"), "doc_id").select("u", F.col("x").alias("v"))
    linked = cut(components(links(documents, regions, classes, per_cent, words).unionByName(held)))
    least = linked.join(classes.select(F.col("x").alias("node"), "doc_id").hint("merge"), "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = linked.join(least.hint("merge"), "component").select(F.col("node").alias("x"), "component_id")
    alone = classes.select("x", F.col("doc_id").alias("least"))
    component = alone.join(of.hint("merge"), "x", "left").select("x", F.coalesce("component_id", "least").alias("component_id"))
    some = named.join(component.hint("merge"), "x").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(blank.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(documents: DataFrame, per_cent: int = PER_CENT, words: int = WORDS) -> DataFrame:
    """``documents`` without those whose component has a smaller doc_id; all columns, repeated rows included, stay as they are."""
    extra = join(documents, per_cent, words).where("component_id < doc_id").select("doc_id").distinct()
    return join_few(documents, extra, "doc_id", "left_anti")
