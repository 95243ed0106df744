"""Templates, slots and shared windows: plain leaks in other forms, a plain version on random texts, and lines that many items share."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from corpusloom.llm import decontamination as dc

ITEMS = "item_id long, text string"
NAME, NUMBER, UNIT = dc.NAME, dc.NUMBER, dc.UNIT


def found(spark, make, items, docs):
    bench = spark.createDataFrame(items, ITEMS)
    return {r["doc_id"]: r["item_ids"] for r in dc.report(make(docs), bench).collect()}


def test_leaks_in_other_cases_and_with_names_at_sentence_starts(spark, make):
    items = [(1, "the price is 5 euro and the tax is 2 euro so what is the total price"), (2, "Tom has 5 pens. Sara has 3 pens. Ben has 4 pens. Who has most?"), (3, "Maria buys 3 pens and 4 cups today")]
    docs = [
        (1, "THE PRICE IS 5 EURO AND THE TAX IS 2 EURO SO WHAT IS THE TOTAL PRICE"), (2, "The Price Is 9 Euro And The Tax Is 4 Euro So What Is The Total Price"),
        (3, "Ann has 15 pens. Lea has 13 pens. Max has 4 pens. Who has most?"), (4, "Clara buys 5 pens and 6 cups today"), (5, "So Clara buys 5 pens and 6 cups today, he said."),
        (6, "tom has 5 pens. sara has 3 pens. ben has 4 pens. who has most?"), (7, "Prices and taxes are high. Pens and cups are cheap."), (8, "Tom has pens. Sara has cups."),
    ]
    assert found(spark, make, items, docs) == {1: "1", 2: "1", 3: "2", 4: "3", 5: "3", 6: "2", 7: "", 8: ""}


def test_a_line_that_all_items_share(spark, make):
    """Its documents meet the first item alone; what an item has to itself still finds it."""
    stem = "choose the best answer to the question below and explain it in full"
    items = [(i, f"{stem} " + " ".join(f"q{i}w{j}" for j in range(20))) for i in range(100)]
    docs = [(i, f"{stem} other words {i}") for i in range(200)] + [(500 + i, f"pad {items[i][1]}") for i in range(100)] + [(700 + i, "pad " + items[i][1][len(stem):]) for i in range(100)]
    bench = spark.createDataFrame(items, ITEMS)
    met = dc.alignments(make(docs), dc.cut(dc.benchmark_items(bench)))
    assert met.where("doc_id < 500").select("doc_id", "item").distinct().count() <= 200
    assert met.select("doc_id", "item").distinct().count() <= 200 + 3 * 100 + 100
    got = found(spark, make, items, docs)
    assert all(got[i] == "" for i in range(200))
    assert all(got[500 + i] == str(i) and got[700 + i] == str(i) for i in range(100))


def test_items_of_one_template(spark, make):
    """Questions that differ in their numbers alone: a document with other numbers meets one of them, a copy its own."""
    items = [(i, f"the shop sold {1000 + i} red lamps on monday and {2000 + i} blue lamps on friday how many in all") for i in range(40)]
    docs = [(1, "the shop sold 7 red lamps on monday and 8 blue lamps on friday how many in all"), (2, items[30][1]), (3, "the shop is shut")]
    got = found(spark, make, items, docs)
    assert got[1] == "0" and "30" in got[2].split(",") and got[3] == ""


def test_equal_items_share_their_result(spark, make):
    text = "seven old geese fly north over cold hills at dawn"
    assert found(spark, make, [(5, text), (3, text), (9, text.upper()), (4, None)], [(1, f"so {text}"), (2, None), (None, text)]) == {1: "3,5,9", 2: "", None: ""}


def plain_tokens(text, reading):
    """(template token, value) of each token."""
    t = regex.sub(r"(?<![\p{L}\p{N}])\p{N}++(?:[., ]\p{N}++)*+", lambda m: f"{NUMBER}{m[0].replace(' ', '_')};", text)
    t = regex.sub(rf"(?i)(?<={NUMBER}[^;]*;) ?(?:{'|'.join(sorted(dc.UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])", lambda m: f" {UNIT}{m[0].strip()}", t)
    if reading:
        t = regex.sub(rf"(?<![\p{{L}}\p{{N}}{UNIT}])\p{{Lu}}[\p{{L}}\p{{N}}]*+(?: \p{{Lu}}[\p{{L}}\p{{N}}]*+){{0,7}}+", lambda m: f"{NAME}{m[0].replace(' ', '_')};", t)
    out = []
    for w in t.lower().split():
        kind = w[0] if w[0] in (NAME, NUMBER, UNIT) else None
        w = regex.sub(rf"[^\p{{L}}\p{{N}}{NAME}{NUMBER}{UNIT}]+", "", w)
        if w:
            out.append((kind or w, w))
    return out


def plain_leaks(items, docs):
    out = set()
    for doc, text in docs:
        for item, question in items:
            for reading in (0, 1):
                d, q = plain_tokens(text, reading), plain_tokens(question, reading)
                if all(k in (NAME, NUMBER, UNIT) for k, _ in q):
                    continue
                width, met = min(len(q), dc.WINDOW), {}
                for j in range(len(q) - width + 1):
                    part = q[j : j + width]
                    weak = sum(k not in (NAME, NUMBER, UNIT) for k, _ in part) < dc.LITERALS
                    for i in range(len(d) - width + 1):
                        if [x[weak] for x in d[i : i + width]] == [x[weak] for x in part]:
                            met.setdefault(i - j, set()).update(range(j, j + width))
                equal, covered = 0, set()
                for shift, places in met.items():
                    slots = {(q[p][1], d[p + shift][1]) for p in places if q[p][0] in (NAME, NUMBER, UNIT)}
                    if len({a for a, _ in slots}) == len(slots):
                        covered |= places
                        equal = max(equal, sum(0 <= p + shift < len(d) and q[p][0] == d[p + shift][0] for p in range(len(q))))
                if max(equal, len(covered)) >= dc.COVERAGE * len(q):
                    out.add((doc, item))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_like_a_plain_version(spark, make, seed):
    rnd = random.Random(seed)
    words = ["red", "lamp", "Runs", "home", "Ann", "Bob Lee", "7", "12", "3,5", "4 km", "9 Kg", "old", "sea.", "and", "Is", "it?", "Öl", "x9"]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    items = [(i, text(rnd.choice([3, 6, 9, 14, 20]))) for i in range(8)]
    docs = []
    for n in range(60):
        _, base = items[n % 8]
        parts = base.split()
        for _ in range(rnd.randrange(4)):
            parts[rnd.randrange(len(parts))] = rnd.choice(words)
        docs.append((n, f"{text(rnd.randrange(5))} {' '.join(parts)} {text(rnd.randrange(5))}"))
    got = {(r["doc_id"], r["item"]) for r in dc.leaks(make(docs), spark.createDataFrame(items, ITEMS)).collect()}
    want = plain_leaks(items, docs)
    assert len(want) > 10 and got == want


def test_tokens_of_both_forms_stand_one_for_one(spark):
    texts = ["Ann Lee has 3 km, 4,5 KG and 1 000 Euro. USA! 7", "", None, "ÉCOLE 5h", "a 5 KM B", "12 34 56 Km", "a5 5 6b", "A B C D E F G H I J K 7 L M", "1 2 " * 60, "UP " * 30 + "down"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for reading in dc.READINGS:
        got = rows.select(dc.template_tokens(F.col("text"), reading).alias("s"), dc.valued_tokens(F.col("text"), reading).alias("v")).collect()
        for r in got:
            assert len(r["s"]) == len(r["v"]) and all(v[0] == s[0] for s, v in zip(r["s"], r["v"]))


def test_a_short_item_behind_a_line_that_many_items_share(spark, make):
    """The shared line is half of one item only, and not of the first that has it."""
    stem = "choose the best answer to the question below and explain it in full"
    items = [(i, f"{stem} " + " ".join(f"q{i}w{j}" for j in range(20))) for i in range(20)] + [(50, f"{stem} a b c d e")]
    docs = [(1, f"{stem} other words"), (2, "nothing of it"), (3, items[7][1])]
    assert found(spark, make, items, docs) == {1: "50", 2: "", 3: "7"}


@pytest.mark.parametrize("seed", [1, 2])
def test_documents_like_a_plain_version_whatever_items_share(spark, make, monkeypatch, seed):
    rnd = random.Random(seed)
    words = ["red", "lamp", "home", "Ann", "7", "12", "4 km", "old", "and", "it?", "x9"]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    line = "the red lamp is at home and old now"
    items = [(i, f"{line} {text(rnd.choice([2, 6, 14, 20]))}" if i % 3 else text(12)) for i in range(9)]
    docs = [(n, f"{text(3)} {line} {text(rnd.randrange(9))}" if n % 2 else f"{text(4)} {items[n % 9][1][rnd.randrange(20):]}") for n in range(40)]
    monkeypatch.setattr(dc, "MANY", 1)
    got = {r["doc_id"] for r in dc.leaks(make(docs), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {d for d, _ in plain_leaks(items, docs)} and 0 < len(got) < 40


def test_windows_are_made_of_few_documents(spark, make, monkeypatch):
    """Only documents with a run of an item are made into windows at every offset."""
    made, whole = [], dc.alignments
    monkeypatch.setattr(dc, "alignments", lambda documents, *rest, **more: made.append(documents.count()) or whole(documents, *rest, **more))
    item = "the old miller sold nine red lamps to Ann before the long winter came over the hills"
    docs = [(i, f"text {i} of other things that nobody asked for, the old one and the red one") for i in range(200)] + [(900, f"so {item}"), (901, item.replace("Ann", "Bob Lee"))]
    got = found(spark, make, [(1, item), (2, "who sold lamps")], docs)
    assert {d for d, ids in got.items() if ids} == {900, 901} and len(got) == 202
    assert made and max(made) <= 2


def test_documents_that_meet_an_item_share_a_run(spark, make):
    """Items of any length; names and numbers whose values and templates part words at other places."""
    rnd = random.Random(1)
    words = ["red", "lamp", "Ann-marie", "Annmarie", "Ann", "Bob Lee", "a-5b", "a-6b", "5-6", "7", "1 000", "4 km", "old", "x-Ann", "Öl", "ﬁn", "it?"]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    items = [(i, text(i % 8 + 3)) for i in range(8)]
    bench = dc.cut(dc.benchmark_items(spark.createDataFrame(items, ITEMS)))
    docs = make([(n, f"{text(rnd.randrange(6))} {items[n % 8][1] if n % 3 else ''} {text(rnd.randrange(4))}") for n in range(60)] + [(90, None), (91, ""), (None, items[0][1])])
    near = {r["doc_id"] for r in dc.sharing_runs(docs, bench).collect()}
    met = {r["doc_id"] for r in dc.alignments(docs, bench, every=True).select("doc_id").distinct().collect()}
    assert met and met <= near and not near & {None, 90, 91}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_like_a_plain_version_whatever_items_share(spark, make, monkeypatch, seed):
    """Every item that leaks is found in every document, also where another that shares its windows was met first."""
    rnd = random.Random(seed)
    words = ["red", "lamp", "home", "Ann", "7", "12", "4 km", "old", "and", "it?", "x9"]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    line = "the red lamp 5 is at home and old now"
    items = [(i, f"{line} {text(rnd.choice([2, 6, 14, 20]))}" if i % 3 else text(12)) for i in range(9)]
    items += [(20, items[1][1])]  # a twin
    docs = [(n, f"{text(3)} {line.replace('5', str(n % 3 + 5))} {text(rnd.randrange(9))}" if n % 2 else f"{text(4)} {items[n % 9][1][rnd.randrange(20):]}") for n in range(40)]
    monkeypatch.setattr(dc, "MANY", 1)
    bench = spark.createDataFrame(items, ITEMS)
    want = plain_leaks(items, docs)
    assert {(r["doc_id"], r["item"]) for r in dc.leaks(make(docs), bench).collect()} == want and len(want) > 40
    got = {r["doc_id"]: r for r in dc.report(make(docs), bench).collect()}
    assert {(d, int(i)) for d, r in got.items() for i in r["leaking_ids"].split(",") if i} == want
    assert all(r["contaminated"] == bool(r["item_ids"]) == (r["n_leaking"] > 0) and {*r["item_ids"].split(",")} <= {*r["leaking_ids"].split(",")} for r in got.values())


def test_all_items_of_one_template_are_listed(spark, make):
    """Forty questions that differ in their numbers alone all leak where one does."""
    items = [(i, f"the shop sold {1000 + i} red lamps on monday and {2000 + i} blue lamps on friday how many in all") for i in range(40)]
    docs = [(1, "the shop sold 7 red lamps on monday and 8 blue lamps on friday how many in all"), (2, items[30][1]), (3, "the shop is shut")]
    got = {r["doc_id"]: (r["n_leaking"], r["leaking_ids"]) for r in dc.report(make(docs), spark.createDataFrame(items, ITEMS)).collect()}
    every = ",".join(str(i) for i in range(40))
    assert got == {1: (40, every), 2: (40, every), 3: (0, "")}


def test_shared_windows_count_against_an_item(spark, make):
    """One number of the item stands against two of the document, one of them in a line that many items share."""
    line = "the old shop on the hill sold 5 red lamps"
    items = [(i, f"{line} q{i}a q{i}b q{i}c q{i}d q{i}e q{i}f q{i}g q{i}h") for i in range(12)] + [(50, f"{line} while she who kept it bought 5 more and went home")]
    docs = [(1, items[-1][1].replace("sold 5", "sold 8").replace("bought 5", "bought 9")), (2, items[-1][1].replace("5", "8"))]
    want = {(d, i) for d, i in plain_leaks(items, docs)}
    assert (1, 50) not in want and (2, 50) in want
    assert {(r["doc_id"], r["item"]) for r in dc.leaks(make(docs), spark.createDataFrame(items, ITEMS)).collect()} == want
