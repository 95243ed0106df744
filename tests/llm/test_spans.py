"""Personal data and secrets in texts full of spans, and values on odd rows."""

import hashlib
import random
import time

import public_tokenizers
import pytest

from corpusloom.llm import pii, secrets
from corpusloom.llm.common import Taken

EMPTY = hashlib.sha256(b"").hexdigest()


def test_taken_like_a_plain_search():
    rnd = random.Random(1)
    for _ in range(300):
        spans = [(a, a + rnd.randrange(1, 9)) for a in (rnd.randrange(60) for _ in range(rnd.randrange(8)))]
        taken = Taken(spans)
        for a in range(60):
            for b in range(a + 1, min(a + 9, 64)):
                assert taken.overlaps(a, b) == any(s < b and a < e for s, e in spans)


def test_spans_of_a_long_text_take_linear_time():
    """50,000 e-mails beside 50,000 IBANs, and as many hex strings beside keys, in one text each."""
    text = "a@b.cc GB82WEST12345698765432 " * 50_000
    began = time.time()
    base, added = pii.find(text)
    assert len(base) == 50_000 and len(added) == 50_000 and time.time() - began < 30
    tokens_of = lambda part: list(part)  # one character a token, so every key looks random
    text = "deadbeefdeadbeefdeadbeef0 xK9qZ7rT2mW4vB8nL5pQ3 " * 50_000
    began = time.time()
    base, added = secrets.find(text, tokens_of)
    assert len(base) == 50_000 and len(added) >= 50_000 and time.time() - began < 60


def test_one_huge_word_and_one_huge_line():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "a@" * 500_000, "x " * 1_000_000):
        began = time.time()
        pii.find(text)
        assert time.time() - began < 30


@pytest.mark.parametrize("text", [None, "", " \n"])
def test_values_of_blank_texts(make, text):
    docs = make([(1, text), (1, text), (None, text)])
    for r in pii.digests(docs).collect():
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"]) == (0, 0, 0, 0, EMPTY, "")
    found = secrets.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(found) == 3
    for r in found:
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) == (0, 0, 0, EMPTY, "")
