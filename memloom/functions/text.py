"""Text functions of ingestion and display, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a comment and a conventional header are.
HTML_COMMENT = r"(?s)<!--.*?-->"
HEADER = r"^[A-Za-z][A-Za-z0-9()\-_/]*:\s*\S"
ELLIPSIS = "…"
# Fixed value: the characters that are white space in Unicode.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def lines(text: Column) -> Column:
    """The lines of a text; a newline at its end starts none."""
    split = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(split)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def strip_html_comments(text: Column) -> Column:
    return F.regexp_replace(text, HTML_COMMENT, "")


def filter_lines(text: Column, dropped: Callable[[Column], Column]) -> Column:
    """The message without dropped lines and repeats of the line before, and how many lines were
    dropped: (text, dropped).  The first line stays; the others are trimmed and go where ``dropped`` holds."""

    def single(joined: Column) -> Column:
        # each line differs from the one before it
        return F.array_join(F.filter(joined, lambda s, i: (i == 0) | (s != F.get(joined, i - 1))), "\n")

    def parts(all_lines: Column) -> Column:
        first = F.filter(F.slice(all_lines, 1, 1), lambda s: s != "")
        rest = F.slice(all_lines, 2, 1_000_000_000)
        kept = F.filter(rest, lambda s: (s == "") | ~dropped(s))
        both = F.struct(F.concat(first, kept).alias("joined"), (F.greatest(F.size(all_lines) - 1, F.lit(0)) - F.size(kept)).alias("dropped"))
        return let(both, lambda x: F.struct(let(x["joined"], single).alias("text"), x["dropped"].alias("dropped")))

    return let(F.transform(lines(text), strip), parts)


def is_header(line: Column) -> Column:
    """Whether a line reads like ``type(scope): subject``."""
    return strip(line).rlike(HEADER)


def is_bullet(line: Column) -> Column:
    text = strip(line)
    return text.rlike(r"^[-*] ") & (F.octet_length(text) >= 3)


def context(text: Column) -> Column:
    """White space collapsed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def compact_snippet(text: Column, most: int) -> Column:
    """On one line, cut after so many characters with three dots."""
    flat = F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))
    return cut(flat, most)


def cut(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def summarize(text: Column, most: int) -> Column:
    flat = context(text)
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit(ELLIPSIS))).otherwise(flat)


def format_day(ts: Column) -> Column:
    return F.when(F.coalesce(ts, F.lit(0)) <= 0, F.lit("n/a")).otherwise(F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd"))


def to_rfc3339(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ssxxx")


def from_rfc3339(text: Column) -> Column:
    """Epoch seconds; an error where the text is no such time."""
    return F.unix_timestamp(F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ssXXX"))


def parse_links(text: Column) -> Column:
    """``id:score`` entries between commas or white space: (note_id, score), a missing score 0, others left out."""
    entries = F.filter(F.split(text, r"[\s,]+"), lambda s: s != "")

    def one(s: Column) -> Column:
        number = F.regexp_extract(s, r"^([+-]?\d+)", 1)
        after = F.when(s.contains(":"), F.regexp_extract(s, r"^[^:]*:([^:]*)", 1))
        score = F.when(F.coalesce(after, F.lit("")) == "", F.lit(0.0)).otherwise(F.regexp_extract(after, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"))
        return F.struct(number.try_cast("bigint").alias("note_id"), score.alias("score"))

    return F.filter(F.transform(entries, one), lambda e: e["note_id"].isNotNull() & e["score"].isNotNull())
