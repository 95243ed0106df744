"""Operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import bpe, decontamination, language_model, line_dedup, ngram_join, pii, quality, secrets, sharding, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# --- line dedup


def test_texts_are_renewed_once(make):
    """The new text is asked for by the filter and by the result; one evaluation, so one worker a task, serves both."""
    docs = make([(1, "a b\nc"), (2, "a b\nd"), (3, "a b")])
    out = line_dedup.apply(docs, line_dedup.decisions(docs))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [_kept") == 1
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "a b\nc", 2: "d"}


def test_a_worker_gives_back_what_a_task_held():
    import re
    from pathlib import Path

    from corpusloom.llm.common import give_back

    held = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024
    before, rows = held(), [bytes(1000) for _ in range(100_000)]
    rows = rows[::100]  # what stays holds the heap's end
    kept = held() - before
    give_back()
    assert len(rows) == 1000 and held() - before < kept / 2


def brute_lines(texts):
    seen, order, drops = {}, [], defaultdict(int)
    for d in sorted(texts):
        for i, line in enumerate((texts[d] or "").split("\n")):
            w = tuple(line.encode().lower().split())
            if w:
                if w in seen:
                    drops[d] += 1
                else:
                    seen[w] = (d, i)
                    if len(w) >= 5 and any(len(o) >= 5 and line_dedup.within_one(list(o), list(w)) for o in order):
                        drops[d] += 1
                    order.append(w)
    return drops


def test_line_dedup_is_exact(make):
    r = random.Random(4)
    base = [[r.choice("abcdefgh") * 2 for _ in range(r.randint(1, 12))] for _ in range(30)]
    texts = {}
    for d in range(60):
        lines = []
        for _ in range(r.randint(0, 6)):
            w = list(r.choice(base))
            for _ in range(r.randint(0, 2)):
                at, kind = r.randrange(len(w) + 1), r.choice("idr")
                w[at : at + (kind != "i")] = [] if kind == "d" else [r.choice("xyz")]
            lines.append(" ".join(w))
        texts[d] = "\n".join(lines)
    got = {x["doc_id"]: x["n_dropped"] for x in line_dedup.report(make(list(texts.items()))).collect()}
    want = brute_lines(texts)
    assert got == {d: want[d] for d in texts}


def test_line_dedup_renews_texts(make):
    got = {r["doc_id"]: r for r in line_dedup.dedup(make([(1, "a line of five words\nkept"), (2, "A  line of five words\nmine"), (3, "kept"), (4, "a line of six words now\nown words"), (5, None)])).collect()}
    assert got[2]["text"] == "mine" and got[2]["n_chars"] == 4 and 3 not in got and got[5]["text"] is None and got[1]["text"].startswith("a line")
    assert got[4]["text"] == "a line of six words now\nown words"


# --- n-gram join


def brute_components(texts, per_cent, k):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if sets[a] and 100 * inter >= per_cent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in texts}


@pytest.mark.parametrize("leaf, per_cent, words", [(2000, 90, 3), (4, 90, 3), (4, 80, 5), (4, 60, 2)])
def test_ngram_join_is_exact(make, monkeypatch, leaf, per_cent, words):
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    r = random.Random(leaf + per_cent)
    bases = [[f"w{r.randrange(400)}" for _ in range(r.choice([1, 2, 3, 8, 40, 120]))] for _ in range(12)]
    texts = {}
    for d in range(150):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = f"n{r.randrange(30)}"
        texts[d] = " ".join(w)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.join(make(list(texts.items())), per_cent, words).collect()}
    assert got == brute_components(texts, per_cent, words)


def test_ngram_join_holds_the_texts_of_a_doc_id_together(make):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    got = ngram_join.join(make([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "other words"), (None, a)])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_texts_that_share_a_long_passage(make, monkeypatch):
    """All about equally far apart: pivots thin nothing out, in a task or in Spark."""
    r, passage = random.Random(8), " ".join(f"p{i}" for i in range(40))
    texts = {d: passage + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(40)) for d in range(60)}
    for d in range(60, 80):
        texts[d] = texts[d - 60].rsplit(" ", 1)[0] + " end"
    for leaf in (2000, 10):
        monkeypatch.setattr(ngram_join, "LEAF", leaf)
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.join(make(list(texts.items())), 80, 5).collect()}
        assert got == brute_components(texts, 80, 5)


def test_regions_in_a_task_are_exact():
    r = random.Random(6)
    for per_cent in (90, 60):
        bases = [[r.randrange(1 << 60) for _ in range(r.choice([5, 40, 120]))] for _ in range(10)]
        sets = []
        for _ in range(300):
            s = list(r.choice(bases))
            for _ in range(r.choice([0, 1, 2, 8])):
                s[r.randrange(len(s))] = r.randrange(1 << 60)
            sets.append(np.unique(np.array(s, dtype=np.uint64)))
        parent = list(range(300))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in ((i, j) for i in range(300) for j in range(i)):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if 100 * inter >= per_cent * (len(sets[i]) + len(sets[j]) - inter):
                parent[root(i)] = root(j)
        want = {frozenset(i for i in range(300) if root(i) == k) for k in range(300)} - {frozenset()}
        parent = list(range(300))
        for u, v in ngram_join.Leaf(list(range(300)), sets, per_cent).links():
            parent[root(u)] = root(v)
        assert {frozenset(i for i in range(300) if root(i) == k) for k in range(300)} - {frozenset()} == want


@pytest.mark.parametrize("per_cent", [90, 80, 60])
def test_points_that_may_have_a_partner(per_cent):
    """No close pair loses a point, sizes on the bound included; points that share a passage and no more go."""
    r = random.Random(per_cent)
    fresh = lambda n: [r.randrange(1 << 60) for _ in range(n)]
    passage, sets = fresh(50), []
    for n in (1, 10, 100, 400, 3000):
        base = fresh(n)
        for change in (0, 1, n // 20, n // 10, n * (100 - per_cent) // 100):
            sets.append(base[change:]), sets.append([*base[change:], *fresh(change)])
    alone = len(sets)
    sets += [passage + fresh(r.choice([150, 600, 950, 1100, 9000]) + r.randrange(90)) for _ in range(60)]
    sets = [np.unique(np.array(x, dtype=np.uint64)) for x in sets]
    sizes, bits = np.array([len(s) for s in sets]), [ngram_join.sketch(s).tobytes() for s in sets]
    has = ngram_join.partnered(sizes, bits, per_cent)
    for i, j in ((i, j) for i in range(len(sets)) for j in range(i)):
        inter = len(np.intersect1d(sets[i], sets[j]))
        if 100 * inter >= per_cent * (sizes[i] + sizes[j] - inter):
            assert has[i] and has[j]
    assert per_cent < 80 or not has[alone:].any()
    assert not ngram_join.partnered(sizes[:1], bits[:1], per_cent).any()


# --- decontamination


def test_templates_catch_other_numbers_and_names(make, spark):
    item = "A train leaves with 120 people and after stop 3 it picks up 45 more while Maria waits for 7 min at home"
    bench = spark.createDataFrame([(1, item), (2, "too short")], "item_id long, text string")
    moved = item.replace("120", "64").replace("45", "9").replace("Maria", "Peter").replace("7 min", "12 h")
    twice = "a 5 b then c 5 d and e 5 f over g 5 h"
    bench = bench.unionByName(spark.createDataFrame([(3, twice)], "item_id long, text string"))
    rows = [(1, f"Before. {item} After."), (2, f"Intro words here, {moved} and more"), (3, "A train leaves with nothing else in common"), (4, "x " + twice.replace("5", "8")), (5, "x a 5 b then c 6 d and e 7 f over g 8 h")]
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.report(make(rows), bench).collect()}
    assert got == {1: "1", 2: "1", 3: "", 4: "3", 5: ""}  # 5: one slot value against several


def test_contained_items_are_found(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [r["text"] for r in bench.collect()]
    want = {d for d, t in texts.items() if any(i in t for i in items)}
    got = {r["doc_id"] for r in decontamination.report(docs, bench).where("contaminated").collect()}
    assert got == want
    assert {r["doc_id"] for r in decontamination.clean(docs, bench).collect()} == set(texts) - want


def test_short_items_and_slots_of_other_lengths(make, spark):
    items = [(1, "what is 5 plus 7 then"), (2, "seven old geese fly north"), (3, "on day 3 Maria buys 1000 red apples for her school and then sells 45 of them to Peter who pays her at once"), (4, "12 34 56")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, "pad. What is 8 plus 9 then?"), (2, "where seven old geese fly north today"), (3, "seven old geese"),
        (4, "so on day 3 Ana Maria buys 1 000 red apples for her school and then sells 45 of them to Jan Peter who pays her at once"),
        (5, "12 34 56"), (6, "on day 3 Maria buys 1000 green pears"), (7, None),
        (8, "on day 4 Carla buys 999 red apples for her school and then sells 4 of them to Olaf who pays her at once, and Maria left, and 3 more"),
    ]
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.report(make(rows), bench).collect()}
    assert got == {1: "1", 2: "2", 3: "", 4: "3", 5: "", 6: "", 7: "", 8: "3"}


def test_short_runs_are_met_at_every_offset(make, spark):
    item = "old clocks tick softly while the keeper sleeps"
    rows = [(i, "pad " * i + item + " end") for i in range(8)]
    got = decontamination.report(make(rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert all(r["contaminated"] for r in got)


# --- BPE


def test_bpe_equals_the_library(spark, make, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, vocabulary = Tokenizer.from_file(path), bpe.read_vocabulary(path)
    r = random.Random(1)
    pool = "abcdeéß 'śΣ\n\t<|>!?.123²ﬁ日\U0001f600 \x1c"
    odd = ["", "  ", "ΣΑΣ Σ", "İstanbul ﬁ ½", "foo<|endoftext|>bar <|startoftext|>", "it's WE'RE", "a\x1cb\x1f c d\xa0e\x85f", "x" * 3000, "aaaaaaa aaaa", "é"]
    odd += ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(500)]
    rows = [*enumerate(odd), *((1000 + d, t) for d, t in texts.items())]
    got = {x["doc_id"]: x for x in bpe.digests(make(rows), vocabulary).collect()}
    for d, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[d]["n_tokens"] == len(ids), t
        assert got[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), t
        assert got[d]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), t
    few = make(rows[:30])
    back = {x["doc_id"]: x["text"] for x in bpe.decode(bpe.encode(few, vocabulary), vocabulary).collect()}
    assert all(back[d] == library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for d, t in rows[:30])


# --- language model


def test_base_score_and_distribution(docs, texts):
    got = language_model.fit_and_score(docs).collect()
    c = Counter()
    for d, t in texts.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            c.update(t.encode().lower().split())
            c[None] += 1
    n, v = sum(c.values()), len(c)
    for r in got:
        w = [*texts[r["doc_id"]].encode().lower().split(), None]
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(c[x] > 0 for x in w) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)


def test_network_is_a_distribution_and_carries_its_state():
    net = language_model.Network(np.array([50.0, 30, 10, 5] + [1.0] * 40), 7.0)
    r = np.random.default_rng(0)
    stream = np.concatenate([[0], r.integers(1, 44, 600)])
    net.train(np.tile(stream, 3))
    state = r.normal(size=(1, language_model.HIDDEN)).astype(np.float32)
    total = sum(np.exp(net.outputs(state, np.array([t]))[0][0]) for t in range(45))  # place 44 stands for all others
    assert total == pytest.approx(1, abs=1e-4)
    text = r.integers(1, 44, 100)
    whole, window = net.score([text, text[:3]]), language_model.WINDOW
    language_model.WINDOW = 7
    try:
        assert net.score([text, text[:3]]) == pytest.approx(whole, rel=1e-4)
    finally:
        language_model.WINDOW = window


def test_outputs_are_taken_for_many_windows_at_once(monkeypatch):
    """A long text has few calls of the output layers, not one a window; their number changes no score."""
    net = language_model.Network(np.array([50.0, 30, 10, 5] + [1.0] * 140), 7.0)
    r = np.random.default_rng(0)
    net.train(np.concatenate([[0], r.integers(1, 144, 2000)]))
    texts, calls, whole = [r.integers(1, 145, 2400), r.integers(1, 145, 7), r.integers(1, 145, 0)], [], net.outputs
    monkeypatch.setattr(net, "outputs", lambda states, target: calls.append(len(target)) or whole(states, target))
    once = net.score(texts)
    assert len(calls) == 1 and sum(calls) == 2407
    monkeypatch.setattr(language_model, "ROWS", 50)
    assert net.score(texts) == pytest.approx(once, rel=1e-5) and max(calls[1:]) < 53


def test_gradients_are_those_of_differences():
    net = language_model.Network(np.array([50.0, 30, 10, 5] + [1.0] * 140), 7.0)
    r = np.random.default_rng(0)
    net.p = {k: (v + r.normal(0, 0.2, v.shape)).astype(np.float64) for k, v in net.p.items()}
    states, target = np.tanh(r.normal(size=(40, language_model.HIDDEN))), r.integers(0, 145, 40)
    g = {k: np.zeros_like(v) for k, v in net.p.items()}
    _, back = net.outputs(states, target, g)
    places = [(net.p[k], g[k], i) for k in ("wc", "bc", "ww", "bw") for i in np.ndindex(g[k].shape)][::37] + [(states, back, i) for i in np.ndindex(back.shape)][::37]
    for values, gradient, i in places:
        given, ends = values[i], []
        for step in (1e-5, -1e-5):
            values[i] = given + step
            ends.append(-net.outputs(states, target)[0].sum())
        values[i] = given
        assert gradient[i] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-4)


def test_words_are_numbered_as_they_are_split():
    import pyarrow as pa

    r = random.Random(3)
    texts = ["", "  ", " \x0b\x0c", "Ab aB  ab", "x\x1cY\x85\xa0Z É", *("".join(r.choice("aB \t\n\r\x0b\x0cé\x1f") for _ in range(30)) for _ in range(200))]
    held = [b"\xff \xFEA b", *(t.encode() for t in texts)]
    for kind in (pa.binary(), pa.large_binary()):
        number, lengths, keys = language_model.numbered(pa.array([b"not asked for", *held], kind).slice(1))
        want = [[language_model.key_of(w) for w in t.lower().split()] for t in held]
        assert [list(x) for x in np.split(keys[number], np.cumsum(lengths)[:-1])] == want
    tokens, begin = language_model.with_ends(np.array([5, 6, 7]), np.array([0, 2, 1, 0]))
    assert tokens.tolist() == [0, 5, 6, 0, 7, 0, 0] and begin.tolist() == [0, 1, 4, 6, 7]


def test_texts_of_several_batches_are_scored_together(make):
    """A step of the network costs as much for a few texts as for many; texts of small Arrow batches go on side by side, for each as before."""
    rows = make([(i, f"red green w{i % 7} blue") for i in range(60)]).coalesce(1)
    counts = language_model.token_counts(rows)
    model = language_model.fit(rows, counts)
    scores = []
    for limit in ("64b", "4194304b"):
        rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)
        scores.append({r["doc_id"]: r["score"] for r in language_model.score(rows, model, counts).collect()})
    assert scores[0] == pytest.approx(scores[1], rel=1e-6) and len(scores[0]) == 60


def test_training_learns_a_cycle():
    net = language_model.Network(np.array([5.0, 4, 3, 2, 1]), 1.0)
    r = np.random.default_rng(1)
    for k in ("wc", "ww"):
        net.p[k] += r.normal(0, 0.3, net.p[k].shape).astype(np.float32)
    before = net.flat().copy()
    pattern = np.tile([1, 2, 3, 4], 5000)  # the end token, place 0, would start afresh
    start = net.score([pattern[1:200]])[0]
    for _ in range(8):
        net.train(pattern, rate=0.02)
    assert net.score([pattern[1:200]])[0] > start / 3 and not np.array_equal(before, net.flat())  # a plain cycle is learnt


def test_every_training_document_trains_the_network(make):
    from pyspark.sql import functions as F

    # documents that one fixed share (xxhash64 mod 8) doesn't hold, in a cycle that only a trained network tells from its counts
    rows = make([(i, " ".join(["red", "green", "blue", "black"] * 1000)) for i in range(60)]).where((F.pmod(F.xxhash64("doc_id"), F.lit(8)) != 0))
    got = language_model.fit_and_score(rows).collect()
    assert any(r["held_out"] for r in got) and all(r["score"] > r["base_score"] + 5 for r in got)


def test_the_score_depends_on_no_partitioning(make):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["red", "green", "blue", "black", f"w{r.randrange(50)}"]) for _ in range(r.randrange(400)))) for i in range(120)]
    one, other = ({x["doc_id"]: x["score"] for x in language_model.fit_and_score(d).collect()} for d in (make(rows).repartition(1), make(rows[::-1]).repartition(7)))
    assert one == pytest.approx(other, rel=1e-6)


def test_the_network_tells_more_than_counts_on_held_out_texts(docs):
    got = [r for r in language_model.fit_and_score(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


# --- sharding


def test_shards_are_even_and_mixed(make):
    rows = [(i * 3 if i % 3 else i * 3 + (i % 2), f"text {i}") for i in range(1, 1001)]
    got = sharding.assign(make(rows)).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    for source, n in Counter(r["source"] for r in got).items():
        counts = Counter(r["shard"] for r in got if r["source"] == source)
        assert all(abs(counts[s] - n / 40) <= 2 for s in range(40))
    for r in got:
        t = dict(rows)[r["doc_id"]]
        assert r["size"] == len(t) + 16 and r["text_crc32"] == zlib.crc32(t.encode()) and r["law"] == "rows" and r["grown_shard"] is None


def test_positions_are_those_of_the_fractional_ranks(make, spark):
    from pyspark.sql import functions as F

    rows = make([(i, f"text {i % 50}") for i in range(300)] + [(None, None), (7, "text 7")])
    got = sharding.assign(rows).collect()
    draws = rows.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"), F.xxhash64(F.lit(sharding.SEED), "doc_id", F.coalesce("text", F.lit(""))).alias("draw")).collect()
    placed = []
    for source in {r["source"] for r in draws}:
        own = sorted((r for r in draws if r["source"] == source), key=lambda r: (r["draw"], r["doc_id"] is not None, r["doc_id"] or 0))
        placed += [((k + 0.5) / len(own), source, r["draw"], r["doc_id"]) for k, r in enumerate(own)]
    placed.sort(key=lambda p: (*p[:3], p[3] is not None, p[3] or 0))
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == [p[3] for p in placed]


# --- toxicity, quality


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(documents, labels.where("doc_id % 3 <> 0"))
    assert model.cuts == sorted(model.cuts) and len(model.cuts) == toxicity.GRADES
    judged = toxicity.score(documents, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert sum(r["rejected"] == bool(r["toxic"]) for r in judged) >= 0.97 * len(judged)
    assert toxicity.reject(documents, model).count() == toxicity.score(documents, model).where("not rejected").count()


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = quality.fit(documents, labels.where("doc_id % 3 <> 0"))
    judged = quality.judge(documents, field).join(labels.where("doc_id % 3 = 0"), "doc_id").where("not base_failed").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in judged) >= 0.97 * len(judged)


def test_quality_measures(texts):
    for t in [*texts.values(), "", "a a a a a a a a a a a", "x\nx\n \nx"]:
        w = t.encode().split()
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        m, _, _ = quality.measure(t.encode())
        assert m == {"n_words": len(w), "word_chars": sum(len(x.decode()) for x in w), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": dup, "n_repeat_words": len(covered)}


def test_viterbi_changes_a_verdict(spark):
    sf = "/root/testdata/sf0.01"
    field = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    text = "\n".join(["A plain sentence that says what it has to say and ends."] * 3 + ["!!! $$$ BUY | NOW | ### !!!"] + ["Another sentence follows it and is as plain as those before."] * 3)
    _, features, _ = quality.measure(text.encode())
    alone = (features @ field.emission).argmax(axis=1)
    assert field.decode(features).tolist() != alone.tolist()  # line by line another verdict


def test_training_lines_of_a_long_document_are_bounded():
    x = np.arange(10_000, dtype=float)[:, None] * np.ones(quality.FEATURES)
    got = quality.stretches(x)
    assert len(got) == quality.CHAIN * quality.CHAINS and got[0, 0] == 0 and got[-1, 0] == 9_999 and len(quality.stretches(x[:200])) == 200


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(3)
    field = quality.LineField(r.normal(size=(quality.FEATURES, 2)), r.normal(size=(2, 2)))
    for n in (1, 2, 6):
        x = r.normal(size=(n, quality.FEATURES))
        e = x @ field.emission
        value = lambda p: sum(e[i, k] for i, k in enumerate(p)) + sum(field.transition[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(([int(b) for b in f"{i:0{n}b}"] for i in range(2**n)), key=value)
        assert field.decode(x).tolist() == best


# --- spans

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
digits = lambda s: re.sub(r"[^0-9]", "", s)
PII_OK = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}


def test_pii_base_spans(texts):
    r = random.Random(2)
    odd = ["".join(r.choice("ab@@..-+ 1234567890()%9") for _ in range(r.randint(0, 80))) for _ in range(3000)]
    for t in [*texts.values(), *odd, "4111111111111111 x 4111 1111 1111 1111", "1.2.3.4.5.6.7.8 300.1.1.1"]:
        assert pii.find(t)[0] == [(k, *m.span()) for k in PII for m in re.finditer(PII[k], t) if PII_OK[k](m[0])]


def test_pii_added_spans():
    assert [x[0] for x in pii.find("pay to account GB82 WEST 1234 5698 7654 32 now")[1]] == ["iban"]
    assert pii.find("GB83 WEST 1234 5698 7654 32")[1] == []
    assert pii.find("id 078-05-1120")[1] == [] and pii.find("her ssn is 078-05-1120")[1] == [("national", 11, 22)]
    assert pii.find("amex card 378282246310005 ok")[1] == [("shortcard", 10, 25)] and pii.find("no 378282246310005 ok")[1] == []
    for behind in ("now", "IBAN", "US", ""):
        assert pii.find(f"AT61 1904 3002 3457 3201 {behind}")[1] == [("iban", 0, 24)]
    assert pii.find("AT611904300234573201")[1] == [("iban", 0, 20)] and pii.find("AT61 1904 3002 3457 3202 AT61 1904 3002 3457 3201")[1] == [("iban", 25, 49)]
    assert not pii.find("AB12" * 50_000)[1] and not pii.find("AB12 " * 50_000)[1]
    pii.find("a" * 200_000 + "@" + "1" * 200_000)  # in linear time


SECRETS = {"assign": r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
SECRETS_OK = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}


def test_secret_base_spans(texts):
    r = random.Random(5)
    bits = ["token", "=", "PassWord", ":", " ", "AKIA", "ABC", "0f3e", "'", '"', "deadbeef", "api_key", "Z9"]
    for t in [*texts.values(), *("".join(r.choice(bits) for _ in range(30)) for _ in range(1000))]:
        want = sorted(((k, *m.span()) for k in SECRETS for m in re.finditer(SECRETS[k], t) if SECRETS_OK[k](m)), key=lambda y: (y[1], secrets.BASE.index(y[0])))
        assert secrets.find(t, lambda s: [0] * len(s))[0] == want


def test_random_strings_stand_out():
    import tiktoken

    tokens = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=secrets.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={}).encode_ordinary
    assert [x[0] for x in secrets.find("see xK9fQ2zLw7VbT4mNp8RsY1cD here", tokens)[1]] == ["random"]
    for known in ("123e4567-e89b-12d3-a456-426614174000", "D41D8CD98F00B204E9800998ECF8427E", "very_long_identifier_name_of_a_function_12", "understandableinternationalization"):
        assert secrets.find(f"see {known} here", tokens)[1] == []


def test_random_strings_behind_readable_ones():
    import tiktoken

    tokens = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=secrets.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={}).encode_ordinary
    r, letters = random.Random(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for before in ("private_key_for_production_server=", "/var/lib/application/credentials/", "/srv/data/of/all/customers/and/their/private/production/server/keys/"):
        for _ in range(200):
            secret = "".join(r.choice(letters) for _ in range(20)) + "7q"
            (_, start, end), *more = secrets.find(f"see {before}{secret} here", tokens)[1]
            assert not more and start <= 4 + len(before) and end == 4 + len(before) + len(secret)
    for known in ("/api/users/550e8400-e29b-41d4-a716-446655440000/details", "/objects/of/repository/d41d8cd98f00b204e9800998ecf8427e", "private_key_for_production_server=2024"):
        assert not secrets.random_stretches(known, tokens)


def test_copies_of_a_text_share_its_cells(make):
    """Of the rows of one text in a task the first alone has cells; all have its component."""
    text = " ".join(f"w{i} of" for i in range(40))
    docs = make([(i, text) for i in range(500)] + [(600, text + " end"), (601, None), (None, text)]).coalesce(1)
    given = [len(r["cells"]) for r in ngram_join._digests(docs, 90, 3).where("n > 0").collect()]
    assert sum(n > 0 for n in given) == 2
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()}
    assert {got[i] for i in [*range(500), 600]} == {0} and got[601] == 601 and got[None] is None


def test_ordinal_fit_is_at_the_least_loss():
    """The fit's likelihood against a plain descent by differences, and against small moves of every number."""
    rng = np.random.default_rng(3)
    n, width = 120, 5
    x = rng.integers(0, 4, size=(n, width)).astype(float)
    lean = x @ np.array([1.0, -0.8, 0.5, 0.0, 0.3]) + rng.logistic(size=n)
    grade = np.digitize(lean, np.quantile(lean, [0.5, 0.7, 0.9]))
    rows, cols = np.nonzero(x)

    def loss(p):
        w, cuts = p[:width], p[width:]
        upper = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-((x @ w)[:, None] - cuts[None, :]))), np.zeros((n, 1))], axis=1)
        return -np.log(np.maximum(upper[np.arange(n), grade] - upper[np.arange(n), grade + 1], 1e-12)).mean() + 1e-3 / 20 * (w**2).sum()

    w, cuts = toxicity._ordinal_fit(rows, cols, x[rows, cols], grade, width, steps=3000)
    fitted = np.concatenate([w, cuts])
    assert list(cuts) == sorted(cuts)
    plain = np.concatenate([np.zeros(width), [0.0, 1.0, 2.0]])
    for _ in range(3000):
        slope = np.array([(loss(plain + d) - loss(plain - d)) / 2e-5 for d in np.eye(len(plain)) * 1e-5])
        plain = plain - 0.3 * slope
    assert loss(fitted) <= loss(plain) + 1e-4
    assert np.abs(fitted - plain).max() < 0.1
    for d in np.eye(len(fitted)) * 0.05:
        assert loss(fitted) <= min(loss(fitted + d), loss(fitted - d)) + 1e-6


def test_toxicity_on_a_table_that_no_constant_was_chosen_on(spark):
    """Fitted on two thirds of the labels of the larger table, judged on the rest; nothing was tried on it before."""
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(documents, labels.where("doc_id % 3 <> 1"))
    judged = toxicity.score(documents, model).join(labels.where("doc_id % 3 = 1"), "doc_id").select("rejected", "toxic").collect()
    assert len(judged) > 1000 and sum(r["rejected"] == bool(r["toxic"]) for r in judged) >= 0.97 * len(judged)


@pytest.mark.parametrize("text", [None, "", " "])
def test_values_of_blank_texts(spark, make, text):
    docs = make([(1, text), (1, text), (None, text), (2, "bad bad worse"), (3, "good words")])
    labels = spark.createDataFrame([(2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("doc_id = 1 or doc_id is null").collect():
        assert (r["severity"], r["grade"], r["rejected"]) == (0.0, 0, False)  # two documents teach nothing
    for r in quality.judge(docs, quality.fit(docs, labels)).where("doc_id = 1 or doc_id is null").collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == (0, 0, 0, 0, 0, True, False)
    for r in language_model.fit_and_score(docs).where("doc_id = 1 or doc_id is null").collect():
        assert r["n_tokens"] == 1 and -20 < r["score"] < 0


def test_rounds_grow_and_read_their_own_texts(spark, make, monkeypatch):
    """Many slices: several rounds, the same model whatever the partitions."""
    monkeypatch.setattr(language_model, "SLICE", 200)
    docs = make([(i, " ".join(f"w{(i * j) % 17}" for j in range(20))) for i in range(700)])
    scores = [{r["doc_id"]: r["score"] for r in language_model.fit_and_score(d).collect()} for d in (docs, docs.repartition(7))]
    assert scores[0].keys() == scores[1].keys() and all(abs(scores[0][k] - scores[1][k]) < 1e-3 for k in scores[0])
    base = {r["doc_id"]: r["base_score"] for r in language_model.fit_and_score(docs).collect()}
    assert sum(scores[0].values()) > sum(base.values())
