"""Fuzzy line deduplication by MinHash.

1. Lines that are equal (two 64-bit hashes) become one, with their first place and count.
2. Each distinct line gets a signature of its character shingles, sampled at word starts (at
   every character where there are few): the shingles' hashes are sorted, the hash range is
   cut into ``BANDS`` equal parts, and a band is the ``ROWS`` least hashes from the start of
   its part on.  As with any MinHash, two lines agree in a band with probability similarity
   ** ROWS.
3. Lines that share a band are compared: all pairs where up to ``PAIRS`` lines share it, else
   each line with the band's least one, which is all that a family of similar lines needs.
4. Candidates are verified by the exact Jaccard similarity of their full shingle sets.
5. Union-find joins verified pairs.  In large bands whose lines aren't all in one component by
   then, every two lines of different components are compared, block by block, so that no
   similar pair of a band stays apart.
6. The first line of each component stays.

Signatures, bands, components and what goes are DataFrame functions.  The sets that verification
compares are made in Arrow batches: as array functions, whole results don't fit the limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.shared import Scratch, both_hashes, checked_broadcast, components, fresh, looked_up
from memloom.llm.word_hashes import mix, overlap

SHINGLE = 8
BANDS, ROWS = 8, 3
PAIRS = 12
#: Lines, and characters of lines, of a block; two blocks of a band meet in a task.
BLOCK_LINES, BLOCK_CHARS = 512, 4_000_000
#: Pairs with one line in common whose sets are compared by the one row of that line.
TOGETHER = 16
SIMILARITY = 0.8
#: Lines of fewer characters stay as they are, unless told otherwise.
MIN_CHARS = 12
_SPAN = 1 << 64


def _cut(line: Column, every: bool) -> Column:
    """The character shingles of a line: from every character on, or from word starts only."""
    on = "" if every else r"\S+\s*"
    return F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{SHINGLE}}})){on}"), F.lit(1))


def sampled(df: DataFrame, line: str, out: str) -> DataFrame:
    """Adds the sorted hashes of a line's shingles at word starts; at every character where a word start comes less than once in 16 characters."""
    df = df.withColumn(out, _cut(F.col(line), False))
    df = df.withColumn(out, F.when(F.size(out) * 16 < F.length(line), _cut(F.col(line), True)).otherwise(F.col(out)))
    return df.withColumn(out, F.sort_array(F.transform(out, lambda s: F.xxhash64(s))))


def with_bands(df: DataFrame, line: str) -> DataFrame:
    """Adds ``bands``: a hash for each band of the line's signature."""
    starts = [-(_SPAN // 2) + i * (_SPAN // BANDS) for i in range(BANDS)]
    marks = F.array(*[F.lit(s).cast("long") for s in starts])
    df = sampled(df, line, "_hashes")
    # sorted in between the hashes, a band's start tells how many hashes are below it
    df = df.withColumn("_marked", F.sort_array(F.concat("_hashes", marks)))
    df = df.withColumn("_ring", F.concat("_hashes", F.slice("_hashes", 1, ROWS)))
    bands = [
        F.xxhash64(F.lit(i), F.slice("_ring", (F.array_position("_marked", F.lit(s).cast("long")) - i).cast("int"), F.lit(ROWS)))
        for i, s in enumerate(starts)
    ]
    return df.withColumn("bands", F.when(F.size("_hashes") > 0, F.array(*bands)).otherwise(F.array().cast("array<bigint>"))).drop("_hashes", "_marked", "_ring")


def bare(line: Column) -> Column:
    """A line as it is compared: without white space at its ends."""
    return F.btrim(line, F.lit(" \t\r\x0b\f"))


def lines_of(df: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """The lines that are compared: (doc_id, line_no, line, h1, h2)."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("line_no", "line"))
    rows = rows.select("doc_id", "line_no", bare(F.col("line")).alias("line")).where(F.length("line") >= min_chars)
    h1, h2 = both_hashes(F.col("line"))
    return rows.withColumn("h1", h1).withColumn("h2", h2)


def _pairs(scratch: Scratch, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) of lines that share a band, a < b; and (band, a, b) of the bands of
    more than PAIRS lines, a being the band's least one."""
    entries = lines.select("h1", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("size"), F.min("h1").alias("a"), F.max("h1").alias("b")).where("size > 1")
    shared = scratch.table(shared, "bands")
    two = shared.where("size = 2").select("a", "b")
    larger = shared.where("size > 2").select("band", "size", "a")
    members = scratch.table(looked_up(entries, larger, ["band"], "h1"), "members")
    few = members.where(F.col("size") <= PAIRS)
    other = few.select("band", F.col("h1").alias("b"))
    close = few.select("band", F.col("h1").alias("a")).join(other, "band").where("a < b").select("a", "b")
    star = members.where(F.col("size") > PAIRS).select("band", "a", F.col("h1").alias("b")).where("a < b")
    star = scratch.table(star, "star")
    return scratch.table(two.unionByName(close).unionByName(star.select("a", "b")).distinct(), "pairs"), star


def _texts(scratch: Scratch, df: DataFrame, lines: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, line): the lines in pairs, read at their first places again."""
    wanted = pairs.select(F.col("a").alias("h1")).unionByName(pairs.select(F.col("b").alias("h1"))).distinct()
    wanted = scratch.table(wanted.join(lines.select("h1", "place.doc_id", "place.line_no"), "h1"), "wanted")
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = docs.join(checked_broadcast(wanted), "doc_id")
    line = bare(F.expr(r"substring_index(substring_index(text, '\n', line_no + 1), '\n', -1)")).alias("line")
    texts = found.select("h1", line).where(F.col("h1") == F.xxhash64("line"))
    nameless = wanted.where("doc_id is null").select("h1")
    if not nameless.isEmpty():  # lines that only documents without an identifier have
        nameless = scratch.table(nameless, "nameless")
        texts = texts.unionByName(looked_up(lines_of(docs.where("doc_id is null"), "doc_id", "text", 0), nameless, ["h1"], "line_no").select("h1", "line"))
    return scratch.table(texts.dropDuplicates(["h1"]), "texts")


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The hashed shingles of lines, from every character on, sorted and distinct."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = max(0, len(codes) - SHINGLE + 1)
    hashes = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + codes[i : n + i]
    hashes, out, at = mix(hashes), [], 0
    for line in lines:
        out.append(np.unique(hashes[at : at + max(0, len(line) - SHINGLE + 1)]))
        at += len(line)
    return out


def _verified(percent: float):
    """Of rows (a, first, others of (b, line)) the pairs whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for a, first, others in zip(*(batch.column(i).to_pylist() for i in range(3))):
                one, *sets = shingle_sets([first, *[o["line"] for o in others]])
                for o, two in zip(others, sets):
                    if len(one) and len(two) and min(len(one), len(two)) * 100 >= max(len(one), len(two)) * percent:
                        common = overlap(one, two)
                        if common * (100 + percent) >= (len(one) + len(two)) * percent:
                            found[0].append(a)
                            found[1].append(o["b"])
            yield pa.RecordBatch.from_pydict({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return run


def _similar(scratch: Scratch, pairs: DataFrame, texts: DataFrame, percent: float) -> DataFrame:
    """Of the pairs those whose sets of shingles are similar.  Pairs of one first line are looked at together, up to TOGETHER."""
    nth = F.row_number().over(Window.partitionBy("a").orderBy("b"))
    dealt = pairs.withColumn("part", F.floor((nth - 1) / TOGETHER)).join(texts.select(F.col("h1").alias("b"), "line"), "b")
    dealt = dealt.groupBy("a", "part").agg(F.collect_list(F.struct("b", "line")).alias("others"))
    both = dealt.join(texts.select(F.col("h1").alias("a"), F.col("line").alias("first")), "a").select("a", "first", "others")
    return scratch.table(both.mapInArrow(_verified(percent), "a long, b long"), "similar")


def link_components(sets: list[np.ndarray], component: list[int], side: list[int], percent: float) -> list[tuple[int, int]]:
    """Similar pairs of sets (as index pairs) that join different components, as many as it takes to
    join them; between the sides -1 and 1 if there are such, else within all."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    tokens, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = times[inverse] > 1
    row, column = row[shared], (np.cumsum(times > 1) - 1)[inverse[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.float32)
    width = 8192
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((n, width), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        common += part @ part.T
    good = common * (100 + percent) >= (sizes[:, None] + sizes[None, :]) * percent
    component, side = np.array(component), np.array(side)
    good &= (component[:, None] != component[None, :]) & (sizes[:, None] > 0) & (sizes[None, :] > 0)
    if side.any():
        good &= side[:, None] < side[None, :]
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while up.get(c, c) != c:
            c = up[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(np.triu(good, 1) if not side.any() else good)):
        x, y = root(int(component[i])), root(int(component[j]))
        if x != y:
            up[x] = y
            out.append((int(i), int(j)))
    return out


def _linked(percent: float):
    def run(rows: pa.Table) -> pa.Table:
        h1, component, side = (rows.column(c).to_pylist() for c in ("h1", "component", "side"))
        pairs = link_components(shingle_sets(rows.column("line").to_pylist()), component, side, percent) if len(set(component)) > 1 else []
        return pa.table({"a": pa.array([h1[i] for i, _ in pairs], pa.int64()), "b": pa.array([h1[j] for _, j in pairs], pa.int64())})

    return run


def _between(scratch: Scratch, members: DataFrame, texts: DataFrame, percent: float) -> DataFrame:
    """Similar pairs (a, b) among members (band, h1, component) of a band that belong to different
    components.  A band's lines are dealt to blocks, and every two blocks meet in one task."""
    lines = members.join(texts, "h1")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_LINES), F.ceil(F.sum(F.length("line")) / BLOCK_CHARS)).cast("int")
    sizes = scratch.table(lines.groupBy("band").agg(blocks.alias("blocks")), "blocks")
    rows = looked_up(lines, sizes, ["band"], "h1").withColumn("own", F.pmod(F.xxhash64("h1"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1)
    tasks = rows.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "h1", "component", "line")
    return scratch.table(tasks.groupBy("band", "i", "j").applyInArrow(_linked(percent), "a long, b long").distinct(), "between")


def linked_lines(scratch: Scratch, df: DataFrame, lines: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(node, component) of the similar ones among distinct lines (h1, h2, place, bands) of the texts of df."""
    percent = round(100 * similarity, 6)
    pairs, star = _pairs(scratch, lines)
    texts = _texts(scratch, df, lines, pairs, id_col, text_col)
    found = _similar(scratch, pairs, texts, percent)
    linked = components(scratch, found, "a", "b")
    # large bands whose lines aren't all linked by now
    members = star.select("band", F.col("b").alias("h1")).unionByName(star.select("band", F.col("a").alias("h1")).distinct())
    members = members.join(linked, F.col("h1") == F.col("node"), "left").select("band", "h1", F.coalesce("component", "h1").alias("component"))
    members = scratch.table(members, "members")
    mixed = members.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    mixed = scratch.table(mixed, "mixed")
    if mixed.isEmpty():
        return linked
    more = _between(scratch, looked_up(members, mixed, ["band"], "h1"), texts, percent)
    return linked if more.isEmpty() else components(scratch, found.unionByName(more), "a", "b")


def duplicate_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, min_chars: int = MIN_CHARS) -> DataFrame:
    """The lines that go: (doc_id, line_no, keep_doc_id, keep_line_no), the latter saying which line stays for them.

    Lines are compared without white space at their ends; those of fewer than min_chars
    characters stay (0: none for that).  Of equal or similar lines the one of the smallest identifier stays, in it
    the first.  Null or empty texts have no lines.  Lines of documents with a null identifier
    go if equal to another's, and come last.  Rows that repeat an identifier are taken for one
    document, whose lines at one place stay or go together.
    """
    scratch = Scratch(df.sparkSession, "lines")
    rows = with_bands(lines_of(df, id_col, text_col, min_chars), "line").select("doc_id", "line_no", "h1", "h2", "bands")
    rows = scratch.table(rows, "rows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no")
    distinct = rows.groupBy("h1", "h2").agg(F.min(F.struct(place.alias("place"), "bands")).alias("first"), F.count("*").alias("times"))
    distinct = scratch.table(distinct.select("h1", "h2", "times", "first.place", "first.bands"), "distinct")
    linked = linked_lines(scratch, df, distinct, id_col, text_col, similarity)
    placed = distinct.select("h1", "h2", "place", "times").join(linked, F.col("h1") == F.col("node"), "left")
    firsts = scratch.table(placed.where("component is not null").groupBy("component").agg(F.min("place").alias("first")), "firsts")
    groups = looked_up(placed.where("times > 1 or component is not null"), firsts, ["component"], "h1", "left")
    groups = scratch.table(groups.select("h1", "h2", F.coalesce("first", "place").alias("keep")), "groups")
    found = looked_up(rows.select("doc_id", "line_no", "h1", "h2"), groups, ["h1", "h2"], "line_no")
    gone = found.where(~(F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("line_no") == F.col("keep.line_no"))))
    return gone.select("doc_id", "line_no", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of df with the lines that go cut out of their texts, and ``_dropped``, how many
    those were.  All other columns stay as they are; a text with no line left becomes empty."""
    scratch = Scratch(df.sparkSession, "texts")
    lines, owner, number = (fresh(df.columns, n) for n in ("_gone", "_owner", "_dropped"))
    gone = duplicate_lines(df, id_col, text_col, similarity, min_chars)
    per_doc = scratch.table(gone.groupBy("doc_id").agg(F.collect_set("line_no").alias("lines")), "gone").select(F.col("doc_id").alias(owner), F.col("lines").alias(lines))
    joined = df.join(checked_broadcast(per_doc), F.col(f"`{id_col}`").eqNullSafe(F.col(owner)), "left")
    rest = F.filter(F.split(F.col(f"`{text_col}`").cast("string"), "\n"), lambda line, i: ~F.array_contains(F.col(lines), i))
    text = F.when(F.col(lines).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(rest, "\n"))
    kept = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    return joined.select(*kept, F.coalesce(F.size(lines), F.lit(0)).alias(number))


def line_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_lines (before), n_dropped, kept_bytes and kept_crc32 of the text that stays (null: 0)."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))))
    out = dedup_lines(rows)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", F.col("_dropped").alias("n_dropped"), F.octet_length(text).alias("kept_bytes"), F.crc32(text.cast("binary")).alias("kept_crc32"))
