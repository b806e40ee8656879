"""Fuzzy search for short license notices by pigeonhole seeds and bounded-error matching.

Texts are compared as words (runs of letters of any script and digits, A-Z lower-cased) joined
by one space.  A notice consists of kept words, which must stand as they are (names, version
numbers), and of runs of other words, each of which may be off by 15 % of its characters
(a word of seven letters by one).
With k edits allowed in all, a notice is cut into k + 1 pieces; one of them must then occur
unchanged, so a single Aho-Corasick pass with the pieces of all notices finds every place worth
looking at.  Where enough of the notice's grams stand near it as well, the regex library matches the notice with bounded errors and tells its span.
A place where a notice stands as it is, its words whole, is an exact place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.shared import fresh

# The base phrases, whose exact places are counted, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Other short notices and their labels.
OTHERS = {
    "permission is hereby granted free of charge to any person": "mit",
    "spdx license identifier mit": "mit",
    "licensed under the apache license": "apache",
    "spdx license identifier apache 2": "apache-2",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
}
#: Words that tell one license from another; so do all words with a digit.
KEPT = {"mit", "apache", "gnu", "lesser", "affero", "mozilla", "cc", "by", "nc", "sa", "noncommercial", "non", "commercial", "sharealike", "spdx"}
#: Edits allowed in a run of other words, as a share of its characters.
RATE = 0.15
#: Edits allowed in one run at most.
MOST_EDITS = 4
#: Characters of the grams that are counted before a place is matched.
GRAM = 3
_NO_WORD = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOUND = "array<struct<notice: string, label: string, edits: int, exact: boolean, first_word: bigint, last_word: bigint, start: int, end: int>>"


def words(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NO_WORD).split()


@dataclass
class Notice:
    """A notice with what it takes to find it.  Texts and pieces have a space before and after each word."""

    text: str
    label: str
    kept: set[str] = field(default_factory=lambda: KEPT)
    rate: float = RATE

    def __post_init__(self):
        import regex

        parts: list[tuple[str, bool]] = []  # runs of words, each with its spaces, and whether it is kept
        for w in self.text.split():
            fixed = w in self.kept or any(c.isdigit() for c in w)
            if parts and parts[-1][1] == fixed:
                parts[-1] = (parts[-1][0] + " " + w, fixed)
            else:
                parts.append((w, fixed))
        self.parts = [(t, 0 if fixed else min(int(len(t) * self.rate), MOST_EDITS)) for t, fixed in parts]
        self.must = [f" {t} " for t, fixed in parts if fixed]
        self.edits = sum(k for _, k in self.parts)
        self.form = f" {self.text} "
        self.grams = [self.form[i : i + GRAM] for i in range(len(self.form) - GRAM + 1)]
        self.least = len(self.grams) - GRAM * self.edits  # an edit changes GRAM grams at most
        self.pattern = regex.compile("(?b) " + " ".join(f"(?:{regex.escape(t)}){{e<={k}}}" if k else regex.escape(t) for t, k in self.parts) + " ")

    def pieces(self) -> list[tuple[int, str]]:
        """The form cut into edits + 1 pieces of nearly equal length, with their offsets."""
        cuts = [len(self.form) * i // (self.edits + 1) for i in range(self.edits + 2)]
        return [(a, self.form[a:b]) for a, b in zip(cuts, cuts[1:])]


def notices(phrases: dict[str, str] | None = None, others: dict[str, str] | None = None) -> list[Notice]:
    known = {**(PHRASES if phrases is None else phrases), **(OTHERS if others is None else others)}
    return [Notice(" ".join(w.decode() for w in words(t)), label) for t, label in known.items()]


class Finder:
    """All notices in one automaton."""

    def __init__(self, wanted: list[Notice]):
        import ahocorasick

        self.wanted = wanted
        places: dict[str, list[tuple[int, int]]] = {}
        for number, notice in enumerate(wanted):
            for offset, piece in notice.pieces():
                places.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, form: str) -> list[tuple[int, int, bool, int, int]]:
        """(notice's number, edits, exact, start, end) of each place in a form, which has a space before
        and after each word.  Exact places are all told, also where they overlap; of places with
        edits those that no other place of the notice overlaps, the best of each neighbourhood."""
        if not self.wanted:
            return []
        begins: dict[int, set[int]] = {}
        for end, (length, where) in self.automaton.iter(form):
            for number, offset in where:
                begins.setdefault(number, set()).add(end + 1 - length - offset)
        out = []
        for number, spots in begins.items():
            notice = self.wanted[number]
            n, k = len(notice.form), notice.edits
            at = sorted(spots)
            exact = [b for b in at if b >= 0 and form.startswith(notice.form, b)]
            out += [(number, 0, True, b + 1, b + n - 1) for b in exact]
            if not k:
                continue
            done = 0  # places are told from left to right
            i = 0
            while i < len(at):
                j = i
                while j + 1 < len(at) and at[j + 1] <= at[j] + 2 * k:
                    j += 1
                low, high = max(done, at[i] - k, 0), min(len(form), at[j] + n + k)
                i, near = j + 1, form[low:high]
                if any(form.find(m, low, high) < 0 for m in notice.must):
                    continue
                if notice.least > 0 and sum(g in near for g in notice.grams) < notice.least:
                    continue
                for m in notice.pattern.finditer(form, low, high, overlapped=False):
                    edits = sum(m.fuzzy_counts)
                    done = m.end() - 1
                    if not any(b < m.end() - 1 and m.start() + 1 < b + n for b in exact):
                        out.append((number, edits, False, m.start() + 1, m.end() - 1))
        return sorted(out, key=lambda r: (r[3], r[4], r[0]))


def _find(wanted: dict[str, dict[str, str]], out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = notices(**wanted)
        finder = Finder(known)
        kind = pa.list_(pa.struct([("notice", pa.string()), ("label", pa.string()), ("edits", pa.int32()), ("exact", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            counts, found = [], []
            for value in batch.column(batch.num_columns - 1):
                text = value.as_py()
                tokens = words(text)
                counts.append(len(tokens))
                form = " " + b" ".join(tokens).decode("utf-8", "surrogatepass") + " "
                hits = finder.find(form) if tokens else []
                spans = [m.span() for m in _WORD.finditer(text)] if hits else []
                rows, seen, at = [], 0, 0
                for number, edits, exact, a, b in hits:
                    seen, at = seen + form.count(" ", at, a), a
                    # with an edit at its border a place may begin or end within a word: the word counts whole
                    first = seen - 1
                    last = first + form.count(" ", a, b)
                    rows.append({"notice": known[number].text, "label": known[number].label, "edits": edits, "exact": exact, "first_word": first, "last_word": last, "start": spans[first][0], "end": spans[last][1]})
                found.append(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(found, kind)], names=[*batch.schema.names[:-1], out + "_words", out])

    return run


def find_notices(df: DataFrame, columns: list[str], text_col: str = "text", out: str = "notices", phrases: dict[str, str] | None = None, others: dict[str, str] | None = None) -> DataFrame:
    """The given columns of df, ``out``_words (number of words) and ``out``: the notices found in
    the row's whole text, as (notice, label, edits, exact, first_word, last_word, start, end), by
    place.  Words are numbered from 0; start and end are characters of the original text.

    Null or empty text has no words and no notices.  Texts of any length are searched whole,
    repeated rows each; places that tie are ordered by span, then by the list's order; an empty
    table gives an empty result.  Other columns, whatever their names, are kept if asked for.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in columns]).schema.fields)
    rows = df.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text_col}`").cast("string").alias(fresh(columns, "_text")))
    return rows.mapInArrow(_find({"phrases": phrases, "others": others}, out), f"{fields}, `{out}_words` bigint, `{out}` {_FOUND}")


def license_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_notices.

    n_base counts the exact places of the base phrases, first_word and last_word are the least
    and greatest word they start at (null without any).  labels has those of all notices found,
    base_labels those of base places; without any they are empty strings.  score is 1 less the
    edits of the best notice as a share of its characters; 0 without a notice.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find_notices(rows, ["doc_id"])
    base = F.filter("notices", lambda x: x["exact"] & x["notice"].isin(list(PHRASES)))

    def labels(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda x: x["label"]))), ",")

    best = F.array_max(F.transform("notices", lambda x: 1 - x["edits"] / F.length(x["notice"])))
    return found.withColumn("base", base).select(
        "doc_id",
        F.col("notices_words").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["first_word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["first_word"])).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("notices").alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
        F.size("notices").cast("long").alias("n_notices"),
    )
