"""Benchmark decontamination by pigeonhole edit matching.

Texts and benchmark items are compared in a plain form: letters and digits lower-cased, every
run of other characters one space.  An item of n characters may be found with up to k edits
(``rate`` of n, but no more than leave PIECE characters to a piece: an item of fewer than 20
characters is found without edits only).  Cut into k + 1 pieces, one piece at least must then occur unchanged, so an
Aho-Corasick pass over the whole text with all items' pieces finds every place worth looking
at; there Myers' bit-parallel algorithm gives the smallest edit distance of the item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.shared import fresh

#: Edits allowed, as a share of an item's characters.
RATE = 0.06
#: The shortest piece: an item allows no more edits than leave its pieces this long.
PIECE = 10
#: Characters of items in one automaton; more items take several automata, one after the other over each batch.
PASS_CHARS = 1_000_000
#: All items together: they are sent to every worker.
ITEM_CHARS = 20_000_000
_OTHER = re.compile(r"[\W_]+")
_MATCH = "array<struct<item_id: bigint, distance: int, start: int, end: int>>"


def plain(text: str) -> str:
    """The form that is compared."""
    return _OTHER.sub(" ", text.lower()).strip()


def budget(length: int, rate: float = RATE) -> int:
    return max(0, min(int(length * rate), length // PIECE - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """The item cut into k + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def pattern_bits(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def myers(bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of a pattern (of m characters) to any substring of text, and where the first such substring ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, at = m, 0
    for i, c in enumerate(text, 1):
        eq = bits.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(xh | plus) & full)
        down = plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (~(xv | up) & full)
        minus = up & xv
        if score < best:
            best, at = score, i
    return best, at


class Matcher:
    """All items of one pass."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = plain(text or "")
            if not item:
                continue
            k = budget(len(item), rate)
            number = len(self.items)
            self.items.append((item_id, item, k, pattern_bits(item), pattern_bits(item[::-1])))
            for offset, piece in pieces(item, k):
                places.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each item in the text: its best place, by characters of the plain form."""
        if not text or not self.items:
            return []
        form = plain(text)
        spots: dict[int, set[int]] = {}
        for end, (length, where) in self.automaton.iter(form):
            for number, offset in where:
                # where the item would begin; spots within its error budget are looked at together
                spots.setdefault(number, set()).add(end + 1 - length - offset)
        out = []
        for number, begins in spots.items():
            item_id, item, k, bits, reverse = self.items[number]
            best = None
            windows: list[list[int]] = []
            for b in sorted(begins):
                if windows and b <= windows[-1][1] + 2 * k:
                    windows[-1][1] = b
                else:
                    windows.append([b, b])
            for first, last in windows:
                low, high = max(0, first - k), min(len(form), last + len(item) + k)
                distance, end = myers(bits, len(item), form[low:high])
                if distance <= k and (best is None or distance < best[0]):
                    _, back = myers(reverse, len(item), form[max(0, low + end - len(item) - k) : low + end][::-1])
                    best = (distance, low + end - back, low + end)
            if best:
                out.append((item_id, *best))
        return sorted(out, key=lambda r: (r[0] is None, r[0] or 0))


def _matches(blocks: list[list[tuple[int, str]]], rate: float, out: str):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [Matcher(items, rate) for items in blocks] if len(blocks) == 1 else None
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for matcher in matchers or (Matcher(items, rate) for items in blocks):  # of many blocks, one is in memory at a time
                for i, text in enumerate(batch.column(batch.num_columns - 1)):
                    found[i] += [{"item_id": n, "distance": d, "start": s, "end": e} for n, d, s, e in matcher.find(text.as_py())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=[*batch.schema.names[:-1], out])

    return run


def passes(benchmark: DataFrame, item_col: str, text_col: str, chars: int = PASS_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, in the order of their identifiers.  They are the stated
    pattern set of the search: held whole, and refused beyond ITEM_CHARS."""
    total = benchmark.agg(F.sum(F.length(F.col(text_col).cast("string")))).first()[0] or 0
    if total > ITEM_CHARS:
        raise ValueError(f"{total} characters of items; match them in parts of {ITEM_CHARS} at most")
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).orderBy(item_col, text_col).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_items(df: DataFrame, benchmark: DataFrame, columns: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE, out: str = "_matches") -> DataFrame:
    """The given columns of df and ``out``, an array of the items found in the row's whole
    text: (item_id, distance, start, end), offsets in the plain form.

    Null or empty texts, and items null, empty or without letters and digits, match nothing;
    a null item_id is kept as null.  Repeated items are each found, repeated rows each searched;
    texts of any length are searched whole.  More than ITEM_CHARS characters of items are a
    ValueError: they are to be matched in parts.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in columns]).schema.fields)
    blocks = list(passes(benchmark, item_col, item_text)) or [[]]
    rows = df.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text_col}`").cast("string").alias(fresh(columns, "_text")))
    return rows.mapInArrow(_matches(blocks, rate, out), f"{fields}, `{out}` {_MATCH}")


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each document and each item found in it: (doc_id, item_id, distance, start, end)."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return find_items(rows, benchmark, ["doc_id"], **options).select("doc_id", F.inline("_matches"))


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of df, with all their columns, in which no item is found."""
    out = fresh(df.columns, "_matches")
    found = find_items(df, benchmark, df.columns, text_col=text_col, out=out, **options)
    return found.where(F.size(out) == 0).drop(out)
