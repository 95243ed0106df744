import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while seven grey geese fly north beyond cold rivers and quiet hills every autumn morning".split()


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text) pairs."""

    def build(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", f"src{0 if i is None else i % 3}", len(t or "")) for i, t in rows], SCHEMA)
        if extra:  # columns with names that the operators use inside
            df = df.selectExpr("*", "1 as line", "2 as a", "3 as region", "4 as rank", "5 as x", "6 as utf8", "7 as item", "8 as shard", "9 as row")
        return df

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and blank texts, repeated rows, a very long text."""
    long = " ".join(f"{w}{i}" for i in range(2000) for w in WORDS[:10])
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, " ".join(WORDS)), (5, " ".join(WORDS)), (6, " ".join(WORDS)), (None, " ".join(WORDS)), (None, None), (7, long), (8, "é\n\nÜ ß\x00 日本 \U0001f600")]
    return make(rows, extra=True)


@pytest.fixture(scope="session")
def none(make):
    return make([], extra=True)
