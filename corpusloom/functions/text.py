"""Column functions over text: cleaning, tokens, prompts, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it.
BLANK = r"(?U)^\s*$"
# A line feed inside a paragraph, and spaces before punctuation.
LONE_BREAK, BEFORE_PUNCTUATION = r"(?<!\n)\n(?!\n)", r" +([.,;:!?])"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; no stemming, no stop words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(BLANK)


def join_paragraph_lines(text: Column) -> Column:
    """A single line feed inside a paragraph becomes a space; spaces before punctuation go; CRLF counts as LF."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(unix, LONE_BREAK, " "), BEFORE_PUNCTUATION, "$1")


def chunk_estimate(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """How many chunks a text will give, by its length alone."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    n = F.length(text)
    return F.when(is_blank(text), 0).when(n <= size, 1).otherwise(F.greatest(F.lit(1), F.floor((n - overlap) / (size - overlap)) + 1)).cast("long")


def snippet(text: Column, terms: Column, width: int = 300) -> Column:
    """``width`` characters from half of it before the earliest term that occurs; from the start when none does."""
    found = F.filter(F.transform(terms, lambda t: F.when(t != "", F.instr(F.lower(text), F.lower(t)))), lambda p: p > 0)
    start = F.greatest(F.lit(0), F.coalesce(F.array_min(found), F.lit(1)) - 1 - width // 2)
    return F.regexp_replace(F.substring(text, start + 1, F.lit(width)), r"(?U)^\s+|\s+$", "")


def truncate_marked(text: Column, n: int) -> Column:
    cut = F.regexp_replace(F.substring(text, 1, n), r"(?U)\s+$", "")
    return F.when(F.length(text) > n, F.concat(cut, F.lit("\n\n[truncated]"))).otherwise(text)


def one_line(text: Column, n: int = 240) -> Column:
    return F.substring(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), 1, n)


def split_groups(text: Column) -> Column:
    """Groups written with commas or white space between."""
    return F.filter(F.split(text, r"[\s,]+"), lambda g: g != "")


def parse_groups(text: Column, default: tuple[str, ...] = ("public",)) -> Column:
    """A JSON list, a JSON scalar or a bare word as a list; blank: the default."""
    fallback = F.array(*map(F.lit, default))
    listed = F.from_json(F.when(F.trim(text).startswith("["), text), "array<string>")
    alone = F.array(F.regexp_replace(F.trim(text), r'^"|"$', ""))
    return F.when(is_blank(text), fallback).otherwise(F.coalesce(listed, alone))


def parse_authors(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda a: F.trim(a)), lambda a: a != "")


def display_title(title: Column, text: Column, source: Column) -> Column:
    """The metadata title, else the first line of the text, else the source."""
    first = F.trim(F.split(text, "\n")[0])
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.nullif(first, F.lit("")), F.nullif(source, F.lit("")), F.lit("Untitled"))


def strip_fences(text: Column) -> Column:
    """Text without a Markdown code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))


def extraction_prompt(text: Column, schema_json: str, context: str = "", limit: int = 4000) -> Column:
    return F.concat(F.lit(f"Describe the document as JSON by this schema:\n{schema_json}\nContext: {context}\nDocument:\n"), F.substring(text, 1, limit))


def question_prompt(text: Column, n: int, limit: int = 4000) -> Column:
    return F.concat(F.lit(f"Write {n} questions, as a JSON array of strings, that this document answers:\n"), F.substring(text, 1, limit))


def parse_questions(answer: Column, n: int) -> Column:
    """A JSON array's first n strings, else the first n lines that end in a question mark."""
    plain = strip_fences(answer)
    listed = F.from_json(F.when(plain.startswith("["), plain), "array<string>")
    asked = F.filter(F.transform(F.split(answer, "\n"), lambda q: F.trim(q)), lambda q: q.endswith("?"))
    return F.slice(F.coalesce(F.filter(listed, lambda q: q.isNotNull()), asked, F.array().cast("array<string>")), 1, n)


def summary_prompt(text: Column, words: int = 200) -> Column:
    return F.concat(F.lit(f"Summarise in at most {words} words:\n"), text)


def summary_lengths(text: Column, summary: Column) -> tuple[Column, Column]:
    """Bytes of a text and of its summary."""
    return tuple(F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in (text, summary))


def display_authors(authors: Column) -> Column:
    """A list of authors as one text; null where there are none."""
    return F.nullif(F.array_join(F.filter(F.transform(authors, lambda a: F.trim(a)), lambda a: a != ""), ", "), F.lit(""))


def html_text(html: Column) -> Column:
    """The readable text of a page: scripts, styles, comments and tags out, block ends as line feeds, common entities decoded."""
    x = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|section|article)\s*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    lines = F.regexp_replace(F.regexp_replace(x, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(lines, r"^\s+|\s+$", "")
