"""Periodic runs of words, by the algorithm of Kolpakov and Kucherov.

A run is a stretch of words that repeats with some smallest period at least twice, and that no
neighbouring word extends.  A suffix automaton gives the Lempel-Ziv factorisation of a text; Main's
algorithm finds, at the start of every factor, the runs that end in the factor and begin at or
before its start, of which only a stretch of bounded length before the factor need be looked at;
the runs within a factor are those of its earlier occurrence, moved.

Only runs of ``shortest`` words or more count.  Each word of such a run lies in a gram of half as
many words that occurs twice in the text, so the algorithm runs on the zones of such grams only,
which vectorised hashing finds; equal hashes only propose, words are compared as they are.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm import word_hashes as wh

#: The fewest words of a run.
SHORTEST = 12
#: UTF-8 bytes of texts hashed at once.
BATCH_BYTES = 8 << 20


class _Automaton:
    """The suffix automaton of a sequence.  Most states have one transition; only others have a dictionary."""

    def __init__(self, seq: list[int]):
        self.length, self.link, self.first = array("q", [0]), array("q", [-1]), array("q", [-1])
        self.letter, self.target = array("q", [-1]), array("q", [-1])
        self.more: dict[int, dict[int, int]] = {}
        length, link, first, letter, target, more = self.length, self.link, self.first, self.letter, self.target, self.more
        last = 0
        for i, c in enumerate(seq):
            cur = len(length)
            length.append(i + 1)
            link.append(0)
            first.append(i)
            letter.append(-1)
            target.append(-1)
            p = last
            q = -1
            while p >= 0:
                if letter[p] == c:
                    q = target[p]
                    break
                if letter[p] < 0:
                    letter[p], target[p] = c, cur
                else:
                    others = more.get(p)
                    if others is None:
                        more[p] = {c: cur}
                    elif c in others:
                        q = others[c]
                        break
                    else:
                        others[c] = cur
                p = link[p]
            if p >= 0:
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    first.append(first[q])
                    letter.append(letter[q])
                    target.append(target[q])
                    if q in more:
                        more[twin] = dict(more[q])
                    while p >= 0:
                        if letter[p] == c:
                            if target[p] != q:
                                break
                            target[p] = twin
                        else:
                            others = more.get(p)
                            if others is None or others.get(c) != q:
                                break
                            others[c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur

    def step(self, state: int, c: int) -> int:
        return self.target[state] if self.letter[state] == c else self.more[state][c]


def factors(seq: list[int]) -> Iterator[tuple[int, int, int]]:
    """The Lempel-Ziv factors (start, end, earlier start or -1): each the longest that also starts
    earlier (the two may overlap), or one new letter."""
    automaton = _Automaton(seq)
    first, step = automaton.first, automaton.step
    b, n = 0, len(seq)
    while b < n:
        state, size = 0, 0
        while b + size < n:
            after = step(state, seq[b + size])
            if first[after] - size >= b:  # it occurs nowhere before
                break
            state, size = after, size + 1
        if size:
            yield b, b + size, first[state] + 1 - size
        else:
            yield b, b + 1, -1
        b += max(1, size)


def _prefixes(s: list[int]) -> list[int]:
    """For each place, how many letters from there on are those of the beginning."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def _crossing(seq: list[int], a: int, b: int, e: int, shortest: int) -> Iterator[tuple[int, int, int]]:
    """Main's algorithm: the repetitions (start, end, period) of seq[a:e] that begin at or before b, reach it and are long enough."""
    t, u = seq[a:b], seq[b:e]
    nt, nu = len(t), len(u)
    forward = _prefixes(u)  # u against itself
    back = _prefixes(t[::-1])  # t against itself, from its end
    over = _prefixes(u + [-1] + t)  # u against places of t
    under = _prefixes(t[::-1] + [-2] + u[::-1])  # t's end against ends within u
    for p in range(1, nu + 1):  # a whole period right of b
        ahead = forward[p] if p < nu else 0
        behind = under[nt + 1 + nu - p] if nt else 0
        if behind == p and p < nt:  # on into t
            behind += back[p]
        if ahead + behind >= p and ahead + behind + p >= shortest:
            yield b - behind, b + p + ahead, p
    for p in range(1, nt + 1):  # a whole period left of b
        ahead = over[nu + 1 + nt - p]
        if ahead == p and p < nu:  # on into u
            ahead += forward[p]
        behind = back[p] if p < nt else 0
        if ahead + behind >= p and ahead + behind + p >= shortest and ahead:
            yield b - p - behind, b + ahead, p


def runs(seq: list[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of max(shortest, 2 * period) letters or more, by start and period."""
    n = len(seq)
    found: dict[tuple[int, int], int] = {}
    order: list[tuple[int, int]] = []

    def add(s: int, e: int, p: int) -> None:
        if (s and seq[s - 1] == seq[s - 1 + p]) or (e < n and seq[e] == seq[e - p]):
            return  # a neighbour extends it
        if (s, e) not in found:
            insort(order, (s, e))
            found[s, e] = p
        elif p < found[s, e]:
            found[s, e] = p

    before = 0
    for b, e, earlier in factors(seq):
        a = max(0, b - 2 * before - (e - b))
        if e - a >= shortest:
            for s, end, p in _crossing(seq, a, b, e, shortest):
                add(s, end, p)
        if earlier >= 0 and e - b >= shortest:
            moved, last = b - earlier, earlier + (e - b)
            i = bisect_right(order, (earlier, n + 1))
            while i < len(order) and order[i][0] <= last - shortest:  # those just moved may be moved again
                s, end = order[i]
                p = found[s, end]
                cut = min(end, last)
                if cut - s >= max(shortest, 2 * p):
                    add(s + moved, cut + moved, p)
                i += 1
        before = e - b
    return sorted((s, e, p) for (s, e), p in found.items())


def _zones(words: np.ndarray, at: np.ndarray, gram: int) -> list[list[tuple[int, int]]]:
    """For each text (words of all, offsets) its stretches covered by grams that it has more than once."""
    zones: list[list[tuple[int, int]]] = [[] for _ in range(len(at) - 1)]
    grams = wh.combine(words, gram)
    if not len(grams):
        return zones
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = text[: len(grams)] == text[gram - 1 :]
    keys = wh.mix(grams + text[: len(grams)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys, places = keys[inside], np.flatnonzero(inside)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[1:] == keys[:-1]
    starts = places[order[same[1:] | same[:-1]]]
    if not len(starts):
        return zones
    depth = np.zeros(len(words) + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + gram, -1)
    covered = np.cumsum(depth[:-1]) > 0
    edge = np.ones(len(words) + 1, bool)  # a zone ends where its text does
    edge[1:-1] = (covered[1:] != covered[:-1]) | (text[1:] != text[:-1])
    cuts = np.flatnonzero(edge)
    for a, b in zip(cuts[:-1], cuts[1:]):
        if covered[a]:
            zones[text[a]].append((int(a - at[text[a]]), int(b - at[text[a]])))
    return zones


def text_runs(words: list[bytes], zones: list[tuple[int, int]], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of a text's words, by start and period."""
    out = []
    for a, b in zones:
        if b - a < shortest:
            continue
        ids: dict[bytes, int] = {}
        seq = [ids.setdefault(w, len(ids)) for w in words[a:b]]
        out += [(a + s, e - s, p) for s, e, p in runs(seq, shortest)]
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that a run has after its first period."""
    if not found:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for s, n, p in found:
        depth[s + p] += 1
        depth[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def periodic_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where the query's planted repetition begins in a text of n words, and its period."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _run(plant: bool, shortest: int, texts: bool, out: str):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1).cast(pa.binary())
            ids = batch.column(batch.num_columns - 2)
            lengths = pa.compute.binary_length(column).fill_null(0).to_pylist()
            for first, last in wh.slices(lengths, lambda n: n + 64, BATCH_BYTES):
                data = [v.as_py() or b"" for v in column[first:last]]
                words, at = wh.texts_to_words(data, lower=False)
                split = [d.split() for d in data]
                if plant:
                    moved = np.arange(len(words))
                    for i, parts in enumerate(split):
                        tail = periodic_tail(ids[first + i].as_py(), len(parts))
                        if tail:
                            a, p = tail
                            n, base = len(parts), int(at[i])
                            moved[base + a : base + n] = base + a + (np.arange(n - a) % p)
                            split[i] = parts[:a] + [parts[a + k % p] for k in range(n - a)]
                    words = words[moved]
                zones = _zones(words, at, shortest // 2)
                found = [text_runs(parts, z, shortest) if z else [] for parts, z in zip(split, zones)]
                left = [b" ".join(collapsed(parts, f)) for parts, f in zip(split, found)]
                end = pa.array([v.decode() for v in left], pa.string()) if texts else pa.array([hashlib.sha256(v).hexdigest() for v in left], pa.string())
                rows = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in f] for f in found], kind)
                kept = [c.slice(first, last - first) for c in batch.columns[:-2]]
                yield pa.RecordBatch.from_arrays([*kept, rows, end], names=[*batch.schema.names[:-2], out, out + "_rest"])

    return run


def find_runs(df: DataFrame, columns: list[str], text_col: str = "text", id_col: str = "doc_id", shortest: int = SHORTEST, texts: bool = True, plant: bool = False, out: str = "runs") -> DataFrame:
    """The given columns of df, ``out``: the runs (start, length, period) of the row's whole text, by
    start and period, words numbered from 0, and ``out``_rest: the text without the words that repeat,
    joined by single spaces (with ``texts``), or else the SHA-256 of it.

    Words are what white space (space, 0x09 to 0x0D) separates, compared as they are.  Null or empty
    text has no runs and an empty rest.  Texts of any length count whole; repeated rows are each
    searched; an empty table gives an empty result.  ``plant`` first makes the ends of some texts
    periodic, by identifier (none where it is null), for tests of the operator.
    """
    if shortest < 2:
        raise ValueError("a run has two words at least")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in columns]).schema.fields)
    rows = df.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return rows.mapInArrow(_run(plant, shortest, texts, out), f"{fields}, `{out}` array<struct<start: bigint, length: bigint, period: bigint>>, `{out}_rest` string")


def run_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_runs, start, length, period, exponent_milli (of the longest run,
    ties by start, then period; null without a run), runs_sha256, collapsed_sha256.

    Texts have periodic ends planted by identifier (``periodic_tail``).
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find_runs(rows, ["doc_id"], texts=False, plant=True)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * -F.col("best.less") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.col("runs_rest").alias("collapsed_sha256"),
    )
