"""LM scoring: a gated recurrent language model in numpy with a class-factored softmax.

Token counts cover all training documents. The most frequent ``WORDS`` tokens have a place in the
network's output, in classes of ``CLASS`` by frequency; the most frequent ``OWN`` of them have an
input vector of their own, the others share as many hashed ones. All other tokens share one class in
which their smoothed counts share out the probability, so the model is a distribution over every
token and the unseen one. It starts as the unigram model: biases are the logs of the counts.

Training takes every training document once. A hash deals them into slices of about ``SLICE``
tokens in a fixed order; a task trains a copy of the network on a slice by truncated
backpropagation, and the copies' parameters are averaged in Spark, as arrays. With many slices this
goes in rounds, each from the average of the last; as the corpus grows, so do both the rounds and the
slices that one of them takes, each with the root of the number of slices. Neither the number of partitions nor a repeated task
changes what a slice holds. Documents are scored whole: the hidden state is carried from window to
window.

Counts of frequent tokens (``HEAD``) are broadcast; all others are looked up in a join.

Defined results: a null or empty text is its end token; a null doc_id is held out if the checksum
of the empty text asks for it (it doesn't); repeated rows are scored and counted each; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, give_back, shared_folder, small_batches, utf8

HEAD = 200_000
WORDS, CLASS, HIDDEN = 4096, 64, 24
#: Words with an input vector of their own; as many more are shared.
OWN = 1024
#: Time steps of a window; streams side by side, fewer where a slice would have less than STEPS windows else.
WINDOW, LANES, STEPS = 24, 512, 128
#: Training tokens of a slice, which one task takes, so that tasks grow in number with the corpus.
SLICE = 4_000_000
#: Slices of one round of averaging; with n times as many there are sqrt(n) rounds of sqrt(n) times as many.
ROUND_SLICES = 12
#: Parameters that are added up together.
CHUNK = 8192
#: Documents whose states go on side by side in scoring, and states whose outputs are taken at once, of however many windows.
TOGETHER, ROWS = 4096, 16384
#: Rows whose exponentials are held at once, so that they stay in a core's cache.
BLOCK = 1024
#: Tokens of a window from which on an input vector's gradients are added up on their own.
MANY = 48
#: The bias of a place that no word has.
NO_WORD = -60.0
#: The key of the end token; no word has it.
END = 0
LOG10 = float(np.log(10))


def key_of(word: bytes) -> int:
    x = xxhash.xxh3_64_intdigest(word)
    return (x - (1 << 64) if x >> 63 else x) or 1


def numbered(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For an Arrow array of UTF-8 texts: the numbers of all their words, text after text, the number of words of each text, and the keys of the words by number."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = texts.view(pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string())
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # by bytes; an empty word before or behind white space
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    held = words.flatten().dictionary_encode()
    number, distinct = held.indices.to_numpy(), held.dictionary.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()
    if b"" in distinct:
        real = number != distinct.index(b"")
        lengths = np.diff(np.append(0, np.cumsum(real))[np.append(0, np.cumsum(lengths))])
        number = number[real]
    return number, lengths, np.array([key_of(w) for w in distinct], dtype=np.int64)


def with_ends(places: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of so many words each, an end token (place 0) put behind each; and where each text begins, and the last ends."""
    begin = np.append(0, np.cumsum(lengths + 1))
    out = np.zeros(begin[-1], dtype=np.int32)
    out[np.arange(len(places)) + np.repeat(np.arange(len(lengths)), lengths)] = places
    return out, begin


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def token_counts(documents: DataFrame) -> DataFrame:
    """(token, c) over the training documents; words by key, the end as END."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                number, _, keys = numbered(batch.column(0))
                c = np.bincount(number, minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(END, keys[c > 0])), pa.array(np.append(batch.num_rows, c[c > 0]))], names=["token", "c"])

    small_batches(documents.sparkSession)
    return documents.where(~held_out()).select(utf8()).mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _exponentials(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, scale: np.ndarray, at: np.ndarray, steep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The logits at the places asked, the exponentials of all, their sums, whose logarithm is to be taken off, and what the exponentials are yet to be multiplied by.

    That is the biases' exponentials (``scale``), of which the sums know already, so no bias is added to the wide logits; not so where ``steep`` weights could overflow.
    """
    logits = states @ weights
    if steep:
        logits += bias
        logits -= logits.max(axis=1, keepdims=True)
        scale = np.ones_like(bias)
    picked = logits[np.arange(len(at)), at]
    if not steep:
        picked += bias[at]
    np.exp(logits, out=logits)
    return picked, logits, logits @ scale, scale


def _backwards(states: np.ndarray, e: np.ndarray, total: np.ndarray, scale: np.ndarray, at: np.ndarray, weights: np.ndarray, to_weights: np.ndarray, to_bias: np.ndarray) -> np.ndarray:
    """Add up the gradients of a softmax and give that of its states; the sums are divided by in the narrow states, not in the wide exponentials."""
    e[np.arange(len(at)), at] -= total / scale[at]
    share = 1 / total
    to_weights += ((states * share[:, None]).T @ e) * scale
    to_bias += (share @ e) * scale
    back = e @ (weights * scale).T
    back *= share[:, None]
    return back


def _steep(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Whether logits or their parts can be large; states lie in (-1, 1), which bounds them. Biases of places that no word has are very low and never asked for."""
    return (np.abs(weights).sum(axis=-2) + np.where(bias > NO_WORD + 1, np.abs(bias), 0)).max(axis=-1) > 40


def _logistic(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place; numpy's exponentials take half the time of its tangents."""
    np.negative(x, out=x)
    np.minimum(x, np.float32(80), out=x)
    np.exp(x, out=x)
    x += np.float32(1)
    return np.reciprocal(x, out=x)


class Network:
    """Embedding table into the gates, one gated recurrent layer, class softmax and a softmax within each class."""

    def __init__(self, counts: np.ndarray, rest: float):
        """counts: smoothed counts of the model's words, most frequent first; rest: the mass of all others."""
        m = len(counts)
        self.words, self.classes = m, -(-m // CLASS) + 1  # the last class holds the rest
        padded = np.zeros((self.classes - 1) * CLASS)
        padded[:m] = counts
        mass = np.append(padded.reshape(-1, CLASS).sum(axis=1), max(rest, 1e-9))
        r = np.random.default_rng(7)
        h = HIDDEN
        by_gate = lambda x: np.ascontiguousarray(x.reshape(len(x), 3, h).swapaxes(0, 1))  # noqa: E731  a gate's numbers lie together
        with np.errstate(divide="ignore"):
            inner = np.where(padded > 0, np.log(np.maximum(padded, 1e-12)), NO_WORD)
        self.p = {
            "table": by_gate(r.normal(0, 0.1, (2 * OWN, 3 * h))), "u": by_gate(r.normal(0, 1 / np.sqrt(h), (h, 3 * h))), "wc": np.zeros((h, self.classes)), "bc": np.log(mass / mass.sum()),
            "ww": np.zeros((self.classes - 1, h, CLASS)), "bw": inner.reshape(-1, CLASS),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        place = np.arange(m + 1, dtype=np.int64)
        self.row = np.where(place < OWN, place, OWN + place * 2654435761 % OWN)  # the input vector of each place

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def step(self, x: np.ndarray, state: np.ndarray) -> tuple:
        """One time step from rows of input vectors."""
        p = self.p
        given, fed = p["table"].take(x, axis=1), np.matmul(state, p["u"])
        zr = given[:2]
        zr += fed[:2]
        z, r = _logistic(zr)
        n = r * fed[2]
        n += given[2]
        n *= np.float32(2)  # the hyperbolic tangent of what it was
        _logistic(n)
        n *= np.float32(2)
        n -= np.float32(1)
        after = state - n
        after *= z
        after += n
        return z, r, n, fed[2], after

    def outputs(self, states: np.ndarray, target: np.ndarray, gradient: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """log P of the class and of the word in it, for rows of states; the rest's words count their class only."""
        p, n = self.p, len(target)
        group = np.minimum(target // CLASS, self.classes - 1)
        group[target >= self.words] = self.classes - 1
        out, back = np.empty(n, dtype=states.dtype), None if gradient is None else np.empty_like(states)
        steep, scale = bool(_steep(p["wc"], p["bc"])), np.exp(p["bc"])
        for at in range(0, n, BLOCK):
            some = slice(at, at + BLOCK)
            picked, e, total, times = _exponentials(states[some], p["wc"], p["bc"], scale, group[some], steep)
            out[some] = picked - np.log(total)
            if back is not None:
                back[some] = _backwards(states[some], e, total, times, group[some], p["wc"], gradient["wc"], gradient["bc"])
        # rows of one class lie side by side; what they give is put back once for all classes
        order = np.argsort(group.astype(np.int16), kind="stable")
        edges = np.searchsorted(group[order], np.arange(self.classes))
        rows = order[: edges[-1]]
        own, place = states[rows], target[rows] % CLASS
        picked, total = np.empty(len(rows), dtype=states.dtype), np.empty(len(rows), dtype=states.dtype)
        inner = None if back is None else np.empty_like(own)
        steep, scale = _steep(p["ww"], p["bw"]), np.exp(p["bw"])
        for g in np.flatnonzero(np.diff(edges)):
            some = slice(edges[g], edges[g + 1])
            x, at = own[some], place[some]
            picked[some], e, total[some], times = _exponentials(x, p["ww"][g], p["bw"][g], scale[g], at, steep[g])
            if gradient is not None:
                inner[some] = _backwards(x, e, total[some], times, at, p["ww"][g], gradient["ww"][g], gradient["bw"][g])
        out[rows] += picked - np.log(total)
        if back is not None:
            back[rows] += inner
        return out, back

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural-log probability of each token sequence, window by window with the state carried on; the start is the end token's place."""
        total = np.zeros(len(texts))
        order = np.argsort([-len(t) for t in texts], kind="stable")
        for at in range(0, len(order), TOGETHER):
            some = order[at : at + TOGETHER]
            total[some] = self._score([texts[i] for i in some])
        return total

    def _score(self, texts: list[np.ndarray]) -> np.ndarray:
        total, order = np.zeros(len(texts)), np.arange(len(texts))
        lengths = np.array([len(texts[i]) for i in order])
        state, last = np.zeros((len(texts), HIDDEN), dtype=np.float32), np.zeros(len(texts), dtype=np.int64)
        states, targets, owners, held = [], [], [], 0

        def give_out():
            got = self.outputs(np.concatenate(states), np.concatenate(targets))[0]
            np.add(total, np.bincount(np.concatenate(owners), weights=got, minlength=len(texts)), out=total)
            states.clear(), targets.clear(), owners.clear()

        for begin in range(0, int(lengths[0]) if len(lengths) else 0, WINDOW):
            live = int(np.searchsorted(-lengths, -begin, side="left"))
            block = np.zeros((live, WINDOW), dtype=np.int64)
            for row, i in enumerate(order[:live]):
                part = texts[i][begin : begin + WINDOW]
                block[row, : len(part)] = part
            left = lengths[:live] - begin
            for t in range(WINDOW):
                n = int(np.searchsorted(-left, -t, side="left"))
                if not n:
                    break
                now = state[:n] = self.step(self.row[last[:n]], state[:n])[-1]
                last[:n] = block[:n, t]
                states.append(now), targets.append(block[:n, t]), owners.append(order[:n])
                held += n
                if held >= ROWS:
                    give_out()
                    held = 0
        if held:
            give_out()
        return total

    @staticmethod
    def _inputs(gates: np.ndarray, at: np.ndarray, to_table: np.ndarray) -> None:
        """Add up the gates' gradients of each input vector; those of frequent ones each on its own, which is faster than a sum in pieces."""
        at = at.astype(np.int32)
        count = np.bincount(at, minlength=to_table.shape[1])
        order = np.argsort(at.astype(np.int16) if len(count) < 1 << 15 else at, kind="stable")
        edges = np.append(0, np.cumsum(count))
        for i in np.flatnonzero(count >= MANY):
            to_table[:, i] += gates.take(order[edges[i] : edges[i + 1]], axis=1).sum(axis=1)
        few = order[count[at[order]] < MANY]
        if len(few):
            first = np.flatnonzero(np.append(True, np.diff(at[few]) > 0))
            to_table[:, at[few][first]] += np.add.reduceat(gates.take(few, axis=1), first, axis=1)

    def train(self, stream: np.ndarray, rate: float = 0.01) -> None:
        """Truncated backpropagation through windows of a token stream, cut into lanes that go on side by side; Adam."""
        lanes = max(1, min(LANES, len(stream) // (STEPS * WINDOW)))
        width = len(stream) // lanes
        if width < 2:
            return
        rows, h = stream[: lanes * width].reshape(lanes, width), HIDDEN
        state = np.zeros((lanes, h), dtype=np.float32)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        steps = range(0, width - 1, WINDOW)
        for number, begin in enumerate(steps, 1):
            x, y = rows[:, begin : min(begin + WINDOW, width - 1)], rows[:, begin + 1 : begin + WINDOW + 1]
            x = np.ascontiguousarray(x.T)  # by time step
            inputs, kept, states = self.row[x], [], []
            ends = [np.flatnonzero(now == 0) for now in x]
            for t in range(len(x)):
                before = state.copy()
                before[ends[t]] = 0  # a new document starts afresh after an end token
                z, r, n, fed, state = self.step(inputs[t], before)
                kept.append((before, z, r, n, fed))
                states.append(state)
            g = {k: np.zeros_like(v) for k, v in self.p.items()}
            _, back = self.outputs(np.concatenate(states), y.T.ravel(), g)
            back = back.reshape(len(x), lanes, h)
            carried = np.zeros((lanes, h), dtype=np.float32)
            gates, turned = np.empty((3, len(x), lanes, h), dtype=np.float32), np.ascontiguousarray(self.p["u"].swapaxes(1, 2))
            through, one = np.empty((3, lanes, h), dtype=np.float32), np.float32(1)
            for t in range(len(x) - 1, -1, -1):
                before, z, r, n, fed = kept[t]
                d, (dz, dr, dn), rest = back[t], gates[:, t], one - z
                d += carried
                np.multiply(n, n, out=dn)  # dn = d (1 - z) (1 - n n)
                np.subtract(one, dn, out=dn)
                dn *= rest
                dn *= d
                np.subtract(before, n, out=dz)  # dz = d (before - n) z (1 - z)
                dz *= d
                dz *= z
                dz *= rest
                np.multiply(dn, r, out=through[2])
                np.subtract(one, r, out=dr)  # dr = dn fed r (1 - r)
                dr *= fed
                dr *= through[2]
                through[0], through[1] = dz, dr
                g["u"] += np.matmul(before.T, through)
                carried, for_r, for_n = np.matmul(through, turned)
                carried += for_r
                carried += for_n
                d *= z
                carried += d
                carried[ends[t]] = 0
            self._inputs(gates.reshape(3, -1, h), inputs.ravel(), g["table"])
            pace = np.float32(rate * min(1.0, number / 10) / (1 - 0.9**number))
            share, spread = np.float32(1 / x.size), np.float32(1 / (1 - 0.99**number))
            for k, v in self.p.items():
                grad = g[k]
                grad *= share
                np.clip(grad, -1, 1, out=grad)
                m1[k] *= np.float32(0.9)
                m1[k] += np.float32(0.1) * grad
                grad *= grad
                m2[k] *= np.float32(0.99)
                m2[k] += np.float32(0.01) * grad
                np.multiply(m2[k], spread, out=grad)
                np.sqrt(grad, out=grad)
                grad += np.float32(1e-6)
                np.divide(m1[k], grad, out=grad)
                grad *= pace
                v -= grad


class Model:
    """Counts of the frequent tokens, the totals, and the network. Place 0 of the network is the end token."""

    def __init__(self, head: list[tuple[int, int]], total: int, distinct: int):
        places = [END, *[t for t, _ in head if t != END][: WORDS - 1]]
        count = dict(head)
        end = count.get(END, 0)
        self.total, self.distinct = total, distinct
        self.mass = total + 0.5 * (distinct + 1)
        keys = np.array([t for t, _ in head if t != END], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], np.array([c for t, c in head if t != END], dtype=np.int64)[order]
        place = {t: i for i, t in enumerate(places)}
        self.places = np.array([place.get(int(t), len(places)) for t in self.keys], dtype=np.int64)
        own = np.array([count.get(t, 0) + 0.5 for t in places])
        self.end, self.outside, self.rest = end, len(places), self.mass - own.sum()
        self.network = Network(own, self.rest)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For tokens by key: whether the head has them, their counts and their places in the network."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64), np.full(len(keys), self.outside)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return known, np.where(known, self.counts[at], 0), np.where(known, self.places[at], self.outside)


def fit(documents: DataFrame, counts: DataFrame) -> Model:
    """The model of the training documents, given their token counts."""
    spark = documents.sparkSession
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the frequent tokens by steps of the logarithm of their count, as far down as HEAD has room; of the next step a hashed share
    step = F.floor(F.log("c") * 16)
    wanted, room = F.lit(False), HEAD
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        if row["count"] > room:
            share = F.pmod(F.xxhash64(F.lit(3), "token"), F.lit(1 << 20)) < int(0.98 * room / row["count"] * (1 << 20))
            wanted = (step > row["step"]) | ((step == row["step"]) & share)
            break
        wanted, room = step >= row["step"], room - row["count"]
    head = sorted(((r[0], r[1]) for r in counts.where(wanted).collect()), key=lambda r: (-r[1], r[0]))
    end = counts.where(F.col("token") == END).collect()
    model = Model(head if any(t == END for t, _ in head) or not end else [(END, end[0]["c"]), *head[: HEAD - 1]], int(totals[0]), int(totals[1]))
    if not model.total:
        return model
    slices = max(4, -(-model.total // SLICE))
    rounds = max(1, math.isqrt(slices // ROUND_SLICES))
    mine = documents.where(~held_out()).select(utf8(), F.xxhash64("doc_id", "text").alias("draw")).withColumn("slice", F.pmod("draw", F.lit(slices)).cast("int"))
    path = f"{shared_folder(spark)}/corpusloom-{uuid.uuid4().hex}"
    if rounds > 1:  # written by round, so that a round reads its own texts and no others
        mine.withColumn("turn", F.col("slice") % rounds).write.partitionBy("turn").parquet(path)
        mine = spark.read.parquet(path)
    for turn in range(rounds):
        here = -(-(slices - turn) // rounds)  # slices with this remainder
        part = mine if rounds == 1 else mine.where(F.col("turn") == turn)
        part = part.select("utf8", "draw", F.expr(f"slice div {rounds}").cast("int").alias("slice"))
        moves = _moves(part.repartitionById(here, F.col("slice")).sortWithinPartitions("slice", "draw"), model)
        rows = sorted((r["chunk"], r["tokens"], r["moved"]) for r in moves.collect())  # one number for each parameter of the network
        if rows:
            moved = np.concatenate([np.array(m) for _, _, m in rows]) / rows[0][1]
            model.network.load(model.network.flat().astype(np.float64) + np.round(moved, 9))  # sums in any order agree so far
    if rounds > 1:
        forget(spark, path)
    return model


def _moves(slices: DataFrame, model: Model) -> DataFrame:
    """(chunk, tokens, moved): for ``CHUNK`` parameters at a time the sums over slices of how far training moved them, times the slice's tokens; and all tokens."""
    shared = slices.sparkSession.sparkContext.broadcast(model)  # HEAD counts and the network: a fixed size

    def trained(batches):
        import copy

        import pyarrow as pa

        m = shared.value

        def rows(stream):
            network = copy.deepcopy(m.network)
            start, tokens = network.flat(), np.concatenate(stream)
            network.train(tokens)
            moved = (network.flat() - start).astype(np.float64) * len(tokens)
            parts = [moved[at : at + CHUNK] for at in range(0, len(moved), CHUNK)]
            return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([len(tokens)] * len(parts), pa.int64()), pa.array(parts, pa.list_(pa.float64()))], names=["chunk", "tokens", "moved"])

        now, stream = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            number, lengths, keys = numbered(batch.column(0))
            tokens, begin = with_ends(m.look_up(keys)[2].astype(np.int32)[number], lengths)
            slice_of = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(slice_of)) + 1).tolist(), len(slice_of)]  # rows come by slice
            for lo, hi in zip(cuts, cuts[1:]):
                if slice_of[lo] != now:
                    if stream:
                        yield rows(stream)
                    now, stream = slice_of[lo], [np.zeros(1, dtype=np.int32)]
                stream.append(tokens[begin[lo] : begin[hi]])
        if stream:
            yield rows(stream)

    def added(batches):
        import pyarrow as pa

        sums: dict = {}  # a task has a few chunks, each of CHUNK numbers, whatever the number of slices
        for batch in batches:
            for chunk, tokens, moved in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                old = sums.get(chunk, (0, 0.0))
                sums[chunk] = old[0] + tokens, old[1] + moved.values.to_numpy()
        if sums:
            chunks, both = zip(*sums.items())
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array([t for t, _ in both], pa.int64()), pa.array([m for _, m in both], pa.list_(pa.float64()))], names=["chunk", "tokens", "moved"])

    schema = "chunk int, tokens long, moved array<double>"
    return slices.select("utf8", "slice").mapInArrow(trained, schema).repartition("chunk").mapInArrow(added, schema)


def score(documents: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # HEAD counts and the network: a fixed size

    def run(batches):
        import pyarrow as pa

        m = shared.value
        texts, held = [], []

        def scored():
            logs, at = m.network.score(texts), 0
            for out in held:
                out["network"] = pa.array(logs[at : at + len(out["row"])])
                at += len(out["row"])
                yield pa.RecordBatch.from_arrays([out[k] for k in names], names=names)
            texts.clear(), held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            number, lengths, keys = numbered(batch.column("utf8"))
            known, count, place = m.look_up(keys)
            log = np.log10(count + 0.5)
            outside = place == m.outside
            owner = np.repeat(np.arange(len(lengths)), lengths)
            by_text = lambda of_word: np.bincount(owner, weights=of_word[number], minlength=len(lengths)).astype(np.float64)  # noqa: E731  whole numbers where there is no word
            # what the head doesn't have, once for each text
            far = ~known[number]
            tail, times = np.unique(owner[far] * len(keys) + number[far], return_counts=True)
            begin = pa.array(np.searchsorted(tail, np.arange(len(lengths) + 1) * len(keys)).astype(np.int32))
            tokens, ends = with_ends(place.astype(np.int32)[number], lengths)
            out = {
                "row": batch.column("row"), "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n": pa.array(lengths + 1), "known": pa.array(by_text(known).astype(np.int64) + (m.end > 0)),
                "logs": pa.array(by_text(np.where(known, log, 0.0)) + np.log10(m.end + 0.5)), "outer_logs": pa.array(by_text(np.where(known & outside, log, 0.0))),
                "outer": pa.array(by_text(outside).astype(np.int64)), "tail": pa.ListArray.from_arrays(begin, pa.array(keys[tail % max(len(keys), 1)])), "times": pa.ListArray.from_arrays(begin, pa.array(times)),
            }
            held.append(out)
            texts += np.split(tokens, ends[1:-1])
            # texts of several batches go on side by side, for a step costs as much for a few as for many
            if len(texts) >= TOGETHER or sum(map(len, texts)) >= SLICE:
                yield from scored()
        yield from scored()
        give_back()

    small_batches(documents.sparkSession)
    given = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), utf8())
    schema = "row long, doc_id long, held_out boolean, n long, known long, logs double, outer_logs double, network double, outer long, tail array<long>, times array<long>"
    names = [field.split(" ")[0] for field in schema.split(", ")]
    firsts = cut(given.mapInArrow(run, schema))
    tails = firsts.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("token"), F.col("t.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    found = tails.join(counts.hint("merge"), "token", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("tail_known"), F.sum(F.col("times") * F.log10(c + 0.5)).alias("tail_logs"))
    joined = firsts.drop("tail", "times").join(found.hint("merge"), "row", "left")
    tail_logs = F.coalesce("tail_logs", F.lit(0.0))
    base = F.col("logs") + tail_logs - F.col("n") * F.log10(F.lit(float(model.mass)))
    full = F.col("network") / LOG10 + F.col("outer_logs") + tail_logs - F.col("outer") * F.log10(F.lit(max(float(model.rest), 1e-9)))
    return joined.select("doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), full.alias("score"))


def fit_and_score(documents: DataFrame) -> DataFrame:
    counts = cut(token_counts(documents))
    return score(documents, fit(documents, counts), counts)
