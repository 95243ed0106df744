"""The searches over vectors against plain loops: clusters, ties, uneven lengths, huge and ragged vectors, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives, norm_search, vectors
from corpusloom.operators import blocks, tables

SCHEMA = "vec_id long, label int, embedding array<float>"
END = 2**63 - 1


def plain(rows, with_label):
    """Usable rows by id: (label, whole numbers)."""
    out = {}
    for i, label, v in rows:
        if i is None or v is None or (with_label and label is None) or any(x is None or not np.isfinite(x) for x in v):
            continue
        row = (label if with_label else 0, [int(np.floor(256 * x)) for x in v])
        out[i] = min(row, out.get(i, row))
    return out


def scored(rows, anchor):
    dot = lambda a, b: max(-END, min(END, sum(x * y for x, y in zip(a, b))))
    return sorted(((-dot(rows[anchor][1], v), i) for i, (_, v) in rows.items() if i != anchor))


def plain_search(rows):
    rows = plain(rows, False)
    return sorted((q, n + 1, i, -s) for q in rows if q % 50 == 0 for n, (s, i) in enumerate(scored(rows, q)[:5]))


def plain_negatives(rows):
    rows = {i: ((label + 1) % 10 if i % 7 == 0 else label, v) for i, (label, v) in plain(rows, True).items()}
    out = []
    for a in (i for i in rows if i % 100 == 0):
        order = scored(rows, a)
        for ps, p in [(-s, i) for s, i in order if rows[i][0] == rows[a][0]][:5]:
            fits = [(i, -s) for s, i in order if rows[i][0] != rows[a][0] and 30 * ps <= -100 * s <= 90 * ps]
            out += [(a, p, n + 1, i, ps, s) for n, (i, s) in enumerate(fits[:10])]
    return sorted(out)


def table(kind, n=500):
    rng, rnd = np.random.default_rng(5), random.Random(5)
    centres, rows = rng.normal(size=(12, 16)), []
    for i in range(n):
        v = {
            "clusters": lambda: (centres[rnd.randrange(12)] + 0.1 * rng.normal(size=16)) * rnd.choice([0.1, 0.5, 1, 2, 10]), "ties": lambda: [rnd.choice([-0.01, 0.0, 0.01, 0.02]) for _ in range(3)],
            "copies": lambda: [0.5, 0.25] if i % 3 else rng.normal(size=2), "norms": lambda: rng.normal(size=8) * np.exp(rng.normal() * 2), "huge": lambda: rng.normal(size=4) * 10.0 ** rnd.randrange(0, 9), "ragged": lambda: rng.normal(size=rnd.randrange(0, 5)),
        }[kind]()
        rows.append((i, rnd.randrange(3), [float(np.float32(x)) for x in v]))
    rows += [(None, 1, [1.0]), (n + 50, 1, None), (n + 1, 1, [float("nan")]), (n + 3, 1, [float("-inf")]), (n + 2, 2, [None]), rows[0], (100, None, [1.0] * 4), (50, 1, [9.0] * 4), (n + 700, None, [1.0] * 3)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(params=["broadcast", "merge"])
def how(request, monkeypatch):
    if request.param == "merge":
        monkeypatch.setattr(tables, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(blocks, "GROUP", 1)


@pytest.mark.parametrize("kind", ["clusters", "ties", "copies", "norms", "huge", "ragged"])
def test_like_plain_loops(spark, how, kind):
    rows = table(kind)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"v": F.lit(1), "length": F.lit("x"), "part": F.lit(2)})
    assert sorted(tuple(r) for r in norm_search.search(df, F.col("vec_id") % 50 == 0, head=64).collect()) == plain_search(rows)
    assert sorted(tuple(r) for r in hard_negatives.mine(hard_negatives.prepared(df), F.col("vec_id") % 100 == 0).collect()) == plain_negatives(rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert norm_search.search(none, F.lit(True)).count() == 0
    assert hard_negatives.mine(hard_negatives.prepared(none), F.lit(True)).count() == 0


def test_buckets_are_pruned_and_coordinates_used():
    """A high threshold leaves short buckets out and takes few rows of a long one."""
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(2000, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    v = np.floor(256 * 40 * unit).astype(np.int64)
    lengths = np.sqrt((v.astype(float) ** 2).sum(1))
    order = np.argsort(-lengths)
    import pyarrow as pa

    bucket = norm_search.Bucket(pa.table({"vec_id": order, "v": v[order].tolist(), "length": lengths[order]}))
    for q, t in ((unit[3], 0.95), (np.eye(8)[2], 0.9), (-np.eye(8)[5], 0.9)):
        cosines = (bucket.v / bucket.lengths[:, None]) @ q
        near = bucket.in_ranges(q, t)
        assert near is not None and len(near) < 1000
        assert set(np.flatnonzero(cosines >= t)) <= set(near)


def test_visit_ends_early_on_clustered_rows():
    """Windows are certified before every cell has been seen."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 300
    v = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))).astype(np.int64)
    books = tuple(hard_negatives.codebook(h) for h in hard_negatives.halves(v, 16))
    whole = hard_negatives.filed(pa.table({"vec_id": np.arange(4000), "label": np.zeros(4000, dtype=int), "v": v.tolist()}), 16, books)
    part = hard_negatives.Part(whole, 16, books)
    first, second = part.bounds(v[:1])
    seen, bounds = [], []
    for places, bound in part.visit(first[0], second[0]):
        scores = vectors.products(v[:1], part.v[places])[0]
        seen.append(scores)
        bounds.append(bound)
    for n in range(1, len(seen)):
        assert max(s.max() for s in seen[n:]) <= bounds[n - 1]
    assert np.sort(np.concatenate(seen[:1]))[-5] > bounds[0]
    assert sum(map(len, seen)) == 4000
