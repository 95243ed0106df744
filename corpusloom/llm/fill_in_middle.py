"""Fill-in-middle: texts cut into prefix, middle and suffix between units, and put into the order in which a model is trained to fill the middle.

A unit is a run of ASCII letters or any other single code point. Cuts are found in the UTF-8 bytes
without a loop over characters: eight bytes at a time as an unsigned 64-bit word, a high bit for every
byte that ends a unit by word arithmetic, a bit count of each word, a search of the word in the running
counts, and the choice of the bit inside it. Time and memory follow the length of a text.

Edges: a null or empty text gives n = 0 and form plain; a null doc_id is written as nothing; repeated
rows each give a row with the same result; other columns are left out. Texts with a marker stay plain,
so every output can be turned back.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns, utf8

#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, those that stay as they are begin here; of 100 cut ones, those below have the suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = "1"


def _each(byte: int) -> np.uint64:
    """A word of eight equal bytes."""
    return np.uint64(byte * 0x0101010101010101)


HIGH, LOW, CASE = _each(0x80), _each(0x7F), _each(0x20)
FROM_A, PAST_Z = _each(0x80 - ord("a")), _each(0x80 - ord("z") - 1)
ONE_BIT, ONE_BYTE, SEVEN_BYTES = np.uint64(1), np.uint64(8), np.uint64(56)


def _next(marks: np.ndarray) -> np.ndarray:
    """The mark of the byte behind, at each byte."""
    behind = np.append(marks[1:], np.uint64(0))
    return (marks >> ONE_BYTE) | (behind << SEVEN_BYTES)


def marks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Words in which the high bit is set at bytes that end a unit, and at bytes that continue a code point."""
    words = np.frombuffer(data + bytes(8 - len(data) % 8), dtype="<u8").astype(np.uint64)
    low = (words & LOW) | CASE
    letter = (low + FROM_A) & ~(low + PAST_Z) & ~words & HIGH  # sums stay below 256, so no byte carries
    inner = words & ~(words << ONE_BIT) & HIGH
    ends = HIGH & ~_next(inner) & ~(letter & _next(letter))
    ends[-1] &= np.uint64((1 << 8 * (len(data) % 8)) - 1)  # not the padding
    return ends, inner


def counts(marked: np.ndarray) -> np.ndarray:
    """Marks up to and with each word."""
    return np.cumsum(np.bitwise_count(marked), dtype=np.int64)


def place(ends: np.ndarray, running: np.ndarray, k: int) -> int:
    """The byte behind the ``k``-th mark."""
    if k == 0:
        return 0
    at = int(np.searchsorted(running, k))
    word = int(ends[at])
    for _ in range(k - (int(running[at - 1]) if at else 0) - 1):
        word &= word - 1
    return 8 * at + (word & -word).bit_length() // 8


def code_points(inner: np.ndarray, running: np.ndarray, stop: int) -> int:
    """Code points that begin before byte ``stop``."""
    word, rest = divmod(stop, 8)
    inside = int(inner[word]) & ((1 << 8 * rest) - 1)
    return stop - (int(running[word - 1]) if word else 0) - inside.bit_count()


def draw(doc_id: int | None, seed: str = SEED) -> tuple[int, ...]:
    """Four numbers that the seed and the id decide."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[at : at + 8], 16) for at in (0, 8, 16, 24))


def arrange(documents: DataFrame, seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every text."""
    before, between, at_last = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def start():
        def rows(columns):
            out = {name: [] for name in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")}
            for doc_id, data in zip(columns["doc_id"], columns["utf8"]):
                ends, inner = marks(data)
                running = counts(ends)
                n = int(running[-1])
                h = draw(doc_id, seed)
                first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                sizes = (None, None)
                if not data or before in data or between in data or at_last in data or h[2] % 100 >= plain_from:
                    form, output = "plain", data
                else:
                    a, b = place(ends, running, first), place(ends, running, last)
                    prefix, middle, suffix = data[:a], data[a:b], data[b:]
                    points = counts(inner)
                    chars = code_points(inner, points, a)
                    sizes = (chars, code_points(inner, points, b) - chars)
                    if h[3] % 100 < spm_below:
                        form, output = "spm", between + suffix + before + prefix + at_last + middle
                    else:
                        form, output = "psm", before + prefix + between + suffix + at_last + middle
                for name, value in zip(out, (doc_id, n, form, *sizes, output.decode())):
                    out[name].append(value)
            return out

        return rows

    return map_columns(documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8()), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", start)


def _parted(text: Column, mark: str) -> tuple[Column, Column]:
    """What stands before the first ``mark``, and behind it."""
    head = F.substring_index(text, mark, 1)
    return head, F.substring(text, F.length(head) + len(mark) + 1, F.length(text))


def restore(output: Column, form: Column) -> Column:
    """The text that ``arrange`` was given."""
    body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    prefix, rest = _parted(body, SUFFIX)
    suffix, middle = _parted(rest, MIDDLE)
    suffix_first, rest_first = _parted(body, PREFIX)
    prefix_then, middle_then = _parted(rest_first, MIDDLE)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_then, middle_then, suffix_first)).otherwise(output)


def digests(documents: DataFrame) -> DataFrame:
    """``arrange`` with digests of the output and of the text rebuilt from it."""
    found = arrange(documents)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
