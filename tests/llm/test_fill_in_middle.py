"""Fill-in-middle against a plain regular expression, on odd texts and whole tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import fill_in_middle as fim


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


POOL = ["a", "Z", "b", "@", "[", "`", "{", "é", "日", "\U0001f600", " ", "\n", "\r", "0", "<", "P", ">", "S", "M", "\x00", "z", "A", "́"]


def test_cuts_at_every_unit():
    rnd = random.Random(1)
    for _ in range(500):
        text = "".join(rnd.choice(POOL) for _ in range(rnd.randrange(60)))
        units, data = re.findall(r"[A-Za-z]+|[^A-Za-z]", text), text.encode()
        ends, inner = fim.marks(data)
        running, points = fim.counts(ends), fim.counts(inner)
        assert running[-1] == len(units)
        for k in range(len(units) + 1):
            at = fim.place(ends, running, k)
            assert data[:at].decode() == "".join(units[:k])
            assert fim.code_points(inner, points, at) == len("".join(units[:k]))


def test_table(spark, make):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(POOL) for _ in range(rnd.randrange(40))) for _ in range(600)]
    rows = [*enumerate(texts), (None, "abc def"), (7, texts[7]), (7, texts[7]), (-5, "<S"), (1000, None), (1001, ""), (1002, " " * 9), (1003, "x" * 300_000), (1004, "é1" * 200_000), (1005, "<P> here")]
    docs = make(rows, extra=True).withColumns({"n": F.lit("x"), "form": F.lit(1), "output": F.lit(2)})
    found = [tuple(r) for r in fim.arrange(docs).collect()]
    assert sorted(found, key=str) == sorted((plain(*r) for r in rows), key=str)
    back = fim.arrange(docs).select("doc_id", fim.restore(F.col("output"), F.col("form")).alias("text"))
    assert sorted(((r[0], r[1]) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    forms = {r[2] for r in found}
    assert forms == {"plain", "spm", "psm"}


def test_digests(make, none):
    row = fim.digests(make([(3, "some words, é")])).first()
    want = plain(3, "some words, é")
    assert tuple(row[:5]) == want[:5]
    assert row["output_sha256"] == hashlib.sha256(want[5].encode()).hexdigest()
    assert row["restored_sha256"] == hashlib.sha256("some words, é".encode()).hexdigest()
    assert fim.digests(none).count() == 0


@pytest.mark.parametrize("below", [0, 100])
def test_other_shares(make, below):
    forms = {r["form"] for r in fim.arrange(make([(i, "a b c") for i in range(20)]), plain_from=100, spm_below=below).collect()}
    assert forms == {"spm" if below else "psm"}
