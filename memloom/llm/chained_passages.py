"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

1. Seeds.  A word k-mer is a seed if its middle word is the first of those with the smallest
   hash, so whether it is one depends on its own words alone, and edits beside it don't matter.
2. Only seeds of several documents count.  Two of them that follow each other in a document are
   a link with a key, and so are two at nearly the distance of a passage; documents meet where
   they have links of the same key, the n-th of a key in one with the n-th (and the first) in
   the other.  All documents of a key meet the smallest one, its hub: a star, so a link of any
   number of documents gives one match each.  Documents that share a whole passage have links
   that others lack which hold only parts of it or a changed one, and so meet all the same.
3. Per pair of documents the matches, ordered in both, are chained: the best chain ending at a
   match is found through a Fenwick tree over positions in one document, which holds prefix
   maxima of scores corrected for the gap cost (linear in the distances in both documents).
4. Chains, with some words around them, are aligned: extended outwards through edits while the
   score does not drop too far, or word by word to the fewest words of a passage, then measured
   by bit-parallel edit distance over words.  Where a
   chain is not similar as a whole, the parts of it that are are passages.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.shared import BROADCAST_BYTES, Scratch, checked_broadcast, looked_up
from memloom.llm.word_hashes import combine, slices, texts_to_words

K = 4
#: Chaining: cost of a word of gap in either document, and the gap at which a chain is cut.
GAP_COST, MAX_GAP, MAX_SHIFT = 0.04, 60, 24
#: Words around a chain that alignment may extend into.
MARGIN = 72
#: Chains of one document whose words are cut from its text together.
TOGETHER = 32
#: A passage: words in both documents, and similarity (1 - edits / longer length).
MIN_WORDS, MIN_SIMILARITY = 50, 0.8
WORD = r"[^\x20\x09-\x0D]+"
#: Keys of more rows than all rows / HOT_KEYS (and 1,000) are frequent: of those there are HOT_KEYS at most.
HOT_KEYS = 50_000


def seeds_of(words: np.ndarray, k: int) -> np.ndarray:
    """Which of the k-mers (of hashed words) are seeds."""
    n, middle = len(words) - k + 1, k // 2
    if n <= 0:
        return np.empty(0, bool)
    own, out = words[middle : n + middle], np.ones(n, bool)
    for i in range(k):
        if i != middle:
            other = words[i : n + i]
            out &= (own < other) if i < middle else (own <= other)
    return out


def _seeds(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            texts = batch.column("text").cast(pa.binary())
            for a, b in slices(pa.compute.binary_length(texts).to_pylist(), lambda n: n or 0, 1 << 21):
                words, at = texts_to_words(texts.slice(a, b - a).to_pylist(), True)
                owner = np.repeat(np.arange(b - a), np.diff(at))
                found = np.flatnonzero(seeds_of(words, k))
                found = found[owner[found] == owner[found + k - 1]]
                own = owner[found]
                who = ids.slice(a, b - a).take(pa.array(own))
                rows = pa.RecordBatch.from_pydict({"h": combine(words, k)[found].view(np.int64), "doc_id": who, "pos": (found - at[own]).astype(np.int32)})
                yield rows.filter(who.is_valid())

    return run


def chains(matches: list[tuple[int, int]], weight: float = K, cost: float = GAP_COST, max_gap: int = MAX_GAP, max_shift: int = MAX_SHIFT) -> list[list[tuple[int, int]]]:
    """Collinear chains of matches (a, b), each match in one chain at most, best ends first.

    The best chain that ends at a match adds its weight to the best earlier one, less the gap
    cost.  As that cost is linear in both distances, the earlier one is a prefix maximum of
    score + cost * (a + b) over smaller b, kept in a Fenwick tree while a grows.
    """
    points = sorted(set(matches))
    if all(x[0] < y[0] and x[1] < y[1] for x, y in zip(points, points[1:])):  # in order in both: all earlier ones are the prefix
        return _cut_chains(points, *_in_order(points, weight, cost), max_gap, max_shift)
    ranks = sorted({b for _, b in points})
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(ranks) + 1)
    score, before = [0.0] * len(points), [-1] * len(points)
    i = 0
    while i < len(points):
        j = i
        while j < len(points) and points[j][0] == points[i][0]:
            a, b = points[j]
            best, at = (float("-inf"), -1), bisect_left(ranks, b)  # prefix of smaller b
            while at > 0:
                best = max(best, tree[at])
                at -= at & -at
            gain = best[0] - cost * (a + b)
            score[j], before[j] = (weight + gain, best[1]) if gain > 0 else (weight, -1)
            j += 1
        for p in range(i, j):
            a, b = points[p]
            at, value = bisect_left(ranks, b) + 1, (score[p] + cost * (a + b), p)
            while at < len(tree):
                if value > tree[at]:
                    tree[at] = value
                at += at & -at
        i = j
    return _cut_chains(points, score, before, max_gap, max_shift)


def _in_order(points: list[tuple[int, int]], weight: float, cost: float) -> tuple[list[float], list[int]]:
    """The score of the best chain that ends at each of points that ascend in both, and the point before."""
    score, before, best = [0.0] * len(points), [-1] * len(points), (float("-inf"), -1)
    for p, (a, b) in enumerate(points):
        gain = best[0] - cost * (a + b)
        score[p], before[p] = (weight + gain, best[1]) if gain > 0 else (weight, -1)
        best = max(best, (score[p] + cost * (a + b), p))
    return score, before


def _cut_chains(points: list[tuple[int, int]], score: list[float], before: list[int], max_gap: int, max_shift: int) -> list[list[tuple[int, int]]]:
    """The chains that scores and the points before give, best ends first, cut where they leap."""
    used, out = [False] * len(points), []
    for end in sorted(range(len(points)), key=lambda p: (-score[p], p)):
        chain, p = [], end
        while p >= 0 and not used[p]:
            used[p] = True
            chain.append(points[p])
            p = before[p]
        chain.reverse()
        part: list[tuple[int, int]] = []
        for point in chain:  # a chain is cut where it leaps
            if part:
                da, db = point[0] - part[-1][0], point[1] - part[-1][1]
                if max(da, db) > max_gap or abs(da - db) > max_shift:
                    out.append(part)
                    part = []
            part.append(point)
        if part:
            out.append(part)
    return out


def _chains(k: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in ("head", "doc_id", "nth", "a0", "a1", "b0", "b1")}
            found = batch.column(2)
            at, flat = (found.offsets.to_numpy() - found.offsets[0].as_py()).tolist(), found.flatten()
            h1, h2, p1, p2 = (flat.field(n).to_numpy().tolist() for n in ("h1", "h2", "p1", "p2"))
            for head, doc, i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), at, at[1:]):
                nth = 0
                for chain in chains([*zip(h1[i:j], p1[i:j]), *zip(h2[i:j], p2[i:j])], k):
                    if len(chain) < least:
                        continue
                    for name, v in zip(rows, (head, doc, nth, chain[0][0], chain[-1][0] + k, chain[0][1], chain[-1][1] + k)):
                        rows[name].append(v)
                    nth += 1
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in rows.items()})

    return run


def extend(a: list, b: list, drop: float = 14) -> tuple[int, int]:
    """How far two word lists run alike from their beginnings, through edits: +1 for a common word,
    -1.5 for an edit, up to the best score before it has dropped too far below it."""
    i = j = score = best = 0
    at = (0, 0)
    while i < len(a) and j < len(b) and score > best - drop:
        if a[i] == b[j]:
            i, j, score = i + 1, j + 1, score + 1
            if score > best:
                best, at = score, (i, j)
            continue
        # the nearest place where two words agree again
        jump = None
        for total in range(1, 9):
            for x in range(total + 1):
                y = total - x
                if a[i + x : i + x + 2] == b[j + y : j + y + 2] and i + x < len(a) and j + y < len(b):
                    jump = (x, y)
                    break
            if jump:
                break
        if jump is None:
            break
        i, j, score = i + jump[0], j + jump[1], score - 1.5 * max(jump)
    return at


def distance(a: list, b: list) -> int:
    """Edit distance of two word lists, bit-parallel over the first, without what they begin and end with alike."""
    first, last = 0, 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if not a or not b:
        return max(len(a), len(b))
    bits: dict = {}
    for i, w in enumerate(a):
        bits[w] = bits.get(w, 0) | 1 << i
    full, high = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for w in b:
        eq = bits.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(xh | plus) & full)
        down = plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = (up << 1 | 1) & full
        down = (down << 1) & full
        plus = down | (~(xv | up) & full)
        minus = up & xv
    return score


def align(a: list[str], b: list[str], seed_a: tuple[int, int], seed_b: tuple[int, int], min_words: int, similarity: float, k: int = K) -> list[tuple[int, int, int, int, int]]:
    """The passages around a chain: (a_start, a_end, b_start, b_end, edits) within the given words.

    One that spans the whole chain if that is similar enough, else those of its parts that are."""
    back_a, back_b = extend(a[: seed_a[0]][::-1], b[: seed_b[0]][::-1])
    on_a, on_b = extend(a[seed_a[1] :], b[seed_b[1] :])
    a0, a1, b0, b1 = seed_a[0] - back_a, seed_a[1] + on_a, seed_b[0] - back_b, seed_b[1] + on_b
    longer, shorter = max(a1 - a0, b1 - b0), min(a1 - a0, b1 - b0)
    if shorter < min_words:
        return _filled(a, b, (a0, a1, b0, b1), min_words, 1 - similarity)
    if shorter >= similarity * longer:
        edits = distance(a[a0:a1], b[b0:b1])
        if edits <= (1 - similarity) * longer + 1e-9:
            return [(a0, a1, b0, b1, edits)]
    return [(x0 + a0, x1 + a0, y0 + b0, y1 + b0, e) for x0, x1, y0, y1, e in parts(a[a0:a1], b[b0:b1], min_words, similarity, k)]


def _differing(a: list[str], b: list[str]) -> list[int]:
    """For each number of words from the beginning, in how many of them two lists differ."""
    out = [0]
    for x, y in zip(a, b):
        out.append(out[-1] + (x != y))
    return out


def _filled(a: list[str], b: list[str], span: tuple[int, int, int, int], min_words: int, allowed: float) -> list[tuple[int, int, int, int, int]]:
    """A span that ends at common words, widened by different ones to so many words, if it stays similar."""
    a0, a1, b0, b1 = span
    missing = min_words - min(a1 - a0, b1 - b0)
    best: list[tuple[int, int, int, int, int]] = []
    # word by word outwards, how many of the words differ: the least of all ways to share the missing ones out
    left = _differing(a[max(0, a0 - missing) : a0][::-1], b[max(0, b0 - missing) : b0][::-1])
    right = _differing(a[a1 : a1 + missing], b[b1 : b1 + missing])
    tries = [(left[n] + right[missing - n], n) for n in range(missing + 1) if n < len(left) and missing - n < len(right)]
    most = allowed * (max(a1 - a0, b1 - b0) + missing) + 1e-9
    if tries and min(tries)[0] <= most:
        n = min(tries)[1]
        s0, s1, t0, t1 = a0 - n, a1 + missing - n, b0 - n, b1 + missing - n
        edits = distance(a[s0:s1], b[t0:t1])
        if edits <= most:
            return [(s0, s1, t0, t1, edits)]
    if missing > allowed * min_words:
        return best
    for back in range(missing + 1):
        s0, s1, t0, t1 = a0 - back, a1 + missing - back, b0 - back, b1 + missing - back
        if min(s0, t0) < 0 or s1 > len(a) or t1 > len(b):
            continue
        edits = distance(a[s0:s1], b[t0:t1])
        if edits <= allowed * max(s1 - s0, t1 - t0) + 1e-9 and (not best or edits < best[0][4]):
            best = [(s0, s1, t0, t1, edits)]
    return best


def blocks_of(a: list[str], b: list[str], k: int) -> list[list[tuple[int, int, int]]]:
    """Chains of common runs (a, b, words) of two word lists, from all their k-mers, the n-th with the n-th."""
    places: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(a) - k + 1):
        places.setdefault(tuple(a[i : i + k]), []).append(i)
    met: dict[tuple[str, ...], int] = {}
    matches = []
    for j in range(len(b) - k + 1):
        gram = tuple(b[j : j + k])
        if gram in places:
            n = met[gram] = met.get(gram, -1) + 1
            matches.append((places[gram][min(n, len(places[gram]) - 1)], j))
    out = []
    for chain in chains(matches, k):
        runs: list[tuple[int, int, int]] = []
        for i, j in chain:
            if runs and i - j == runs[-1][0] - runs[-1][1] and i <= runs[-1][0] + runs[-1][2]:
                runs[-1] = (*runs[-1][:2], i + k - runs[-1][0])
                continue
            # a k-mer on another diagonal counts from where the last run ends on both sides
            skip = max(0, runs[-1][0] + runs[-1][2] - i, runs[-1][1] + runs[-1][2] - j) if runs else 0
            if skip < k:
                runs.append((i + skip, j + skip, k - skip))
        out.append(runs)
    return out


def parts(a: list[str], b: list[str], min_words: int, similarity: float, k: int = K) -> list[tuple[int, int, int, int, int]]:
    """The similar parts of two word lists that are not similar as a whole: of each chain of common
    runs the longest stretch from run to run that is, then the same before and behind it."""
    found, allowed = [], 1 - similarity
    for runs in blocks_of(a, b, k):
        at = np.array(runs, np.int64)
        starts, ends = at[:, :2], at[:, :2] + at[:, 2:]
        gaps = [distance(a[e[0] : s[0]], b[e[1] : s[1]]) for e, s in zip(ends[:-1].tolist(), starts[1:].tolist())]
        cost = np.concatenate(([0], np.cumsum(gaps, dtype=np.int64)))  # edits before each run
        open_ = [(0, len(runs))]
        while open_:
            low, high = open_.pop()
            best = (0, -1, -1)
            for i in range(low, high):
                spans = ends[i:high] - starts[i]
                longer, shorter = spans.max(1), spans.min(1)
                if shorter[-1] <= best[0]:
                    break  # later starts are shorter still
                good = np.flatnonzero(cost[i:high] - cost[i] <= allowed * longer + 1e-9)
                if len(good) and shorter[good[-1]] > best[0]:
                    best = (int(shorter[good[-1]]), i, i + int(good[-1]))
            _, i, j = best
            if i < 0:
                continue
            got = _widened(a, b, (*starts[i].tolist(), *ends[j].tolist()), min_words, allowed)
            if got:
                found.append(got)
            open_ += [(low, i), (j + 1, high)]
    return found


def _widened(a: list[str], b: list[str], core: tuple[int, int, int, int], min_words: int, allowed: float):
    """A similar stretch (a_start, b_start, a_end, b_end) with what it can take in on both sides, the widest that stays similar."""
    a0, b0, a1, b1 = core
    sizes = (MARGIN, MARGIN // 2, MARGIN // 4, MARGIN // 8, 0)
    back = [extend(a[max(0, a0 - n) : a0][::-1], b[max(0, b0 - n) : b0][::-1]) for n in sizes]
    on = [extend(a[a1 : a1 + n], b[b1 : b1 + n]) for n in sizes]
    tries = {(a0 - x, a1 + u, b0 - y, b1 + v) for x, y in back for u, v in on}
    for s0, s1, t0, t1 in sorted(tries, key=lambda t: (-min(t[1] - t[0], t[3] - t[2]), t)):
        if min(s1 - s0, t1 - t0) < min_words:
            return None
        edits = distance(a[s0:s1], b[t0:t1])
        if edits <= allowed * max(s1 - s0, t1 - t0) + 1e-9:
            return s0, s1, t0, t1, edits
    return None


def _numbered(left: pa.ListArray, right: pa.ListArray) -> list[list[list[int]]]:
    """Two columns of word lists with a number for each word, the same for equal ones."""
    flat = [side.flatten() for side in (left, right)]
    numbers = pa.concat_arrays(flat).dictionary_encode().indices.to_numpy()
    out = []
    for side, own in zip((left, right), (numbers[: len(flat[0])], numbers[len(flat[0]) :])):
        at, words = (side.offsets.to_numpy() - side.offsets[0].as_py()).tolist(), own.tolist()
        out.append([words[i:j] for i, j in zip(at, at[1:])])
    return out


def _align(min_words: int, similarity: float, k: int):
    names = ("doc_id", "other_id", "start", "end", "other_start", "other_end", "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            sizes = pa.compute.add(pa.compute.list_value_length(batch.column("left")), pa.compute.list_value_length(batch.column("right")))
            for i, j in slices(sizes.to_pylist(), lambda n: n, 1 << 20):
                some = batch.slice(i, j - i)
                places = (some.column(n).to_pylist() for n in ("head", "doc_id", "a0", "a1", "left_at", "b0", "b1", "right_at"))
                for left, right, head, doc, p0, p1, left_at, q0, q1, right_at in zip(*_numbered(some.column("left"), some.column("right")), *places):
                    for a0, a1, b0, b1, edits in align(left, right, (p0 - left_at, p1 - left_at), (q0 - right_at, q1 - right_at), min_words, similarity, k):
                        rows.append((doc, head, b0 + right_at, b1 + right_at, a0 + left_at, a1 + left_at, edits))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    return run


def _lowered_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))


def _links(shared: DataFrame, reach: int) -> DataFrame:
    """(c, own, doc_id, p1, p2): links of the seeds (h, doc_id, pos) of a document, with their keys:
    of each seed with the next one, and with the last one up to ``reach`` words on.  The key has the
    link's number among the equal ones of its document; all but the first have the first one's
    key as well (own is false there)."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    next_ = F.struct(F.lead("h").over(order).alias("h"), F.lead("pos").over(order).alias("pos"))
    far = F.struct(F.last("h").over(order.rangeBetween(1, reach)).alias("h"), F.last("pos").over(order.rangeBetween(1, reach)).alias("pos"))
    links = shared.select("doc_id", "h", "pos", next_.alias("next"), far.alias("far"))
    both = F.when(F.col("far.pos") > F.col("next.pos"), F.array("next", "far")).otherwise(F.array("next"))
    links = links.select("doc_id", "h", "pos", F.explode(both).alias("next")).where(F.col("next.pos") - F.col("pos") <= MAX_GAP)
    links = links.select("doc_id", F.col("pos").alias("p1"), F.col("next.pos").alias("p2"), F.xxhash64("h", "next.h").alias("link"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "link").orderBy("p1", "p2"))
    key = lambda n, own: F.struct(F.xxhash64("link", n).alias("c"), F.lit(own).alias("own"))
    links = links.withColumn("nth", nth)
    keys = F.when(F.col("nth") > 1, F.array(key(F.col("nth"), True), key(F.lit(1), False))).otherwise(F.array(key(F.lit(1), True)))
    return links.select("doc_id", "p1", "p2", keys.alias("keys")).select(F.inline("keys"), "doc_id", "p1", "p2")


def _met(rows: DataFrame, found: DataFrame, key: str, how: str) -> DataFrame:
    """rows joined by their key with a written table of (key, n, ...), n being the rows of the key:
    frequent keys, of which there are few by definition, are broadcast, the others shuffled."""
    least = max(1000, (found.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot = F.broadcast(found.where(F.col("n") > least).drop("n"))
    rest = found.where(F.col("n") <= least).drop("n")
    return rows.join(hot, key, how).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key, how))


def _chained(scratch: Scratch, links: DataFrame, k: int) -> DataFrame:
    """(head, doc_id, nth, a0, a1, b0, b1): chains of the places that a document's links have in it
    and in the smallest document of the same keys."""
    own = F.when(F.col("own"), F.col("doc_id"))
    place = F.shiftleft(F.col("p1").cast("long"), 32) + F.col("p2")  # in one number
    hubs = links.groupBy("c").agg(F.count("*").alias("n"), F.min(own).alias("head"), F.max(own).alias("last"), F.min_by(place, own).alias("h"))
    hubs = hubs.where("head <> last").select("c", "n", "head", F.shiftright("h", 32).cast("int").alias("h1"), F.col("h").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("h2"))
    hubs = scratch.table(hubs, "hubs")
    met = _met(links.drop("own"), hubs, "c", "inner").where("doc_id <> head")
    # a pair's matches: no more than twice the links of its second document
    pairs = met.groupBy("head", "doc_id").agg(F.collect_list(F.struct("h1", "h2", "p1", "p2")).alias("found"))
    chains = scratch.table(pairs.mapInArrow(_chains(k, 2), "head long, doc_id long, nth long, a0 long, a1 long, b0 long, b1 long"), "chains")
    scratch.drop(links)
    scratch.drop(hubs)
    return chains


def _sides(scratch: Scratch, docs: DataFrame, chains: DataFrame, who: str, low: str, high: str, words: str) -> DataFrame:
    """(head, doc_id, nth, low, high, at, words) of chains: the words of one side with a margin, from
    word ``at`` on.  A document's chains are taken together, TOGETHER or so, and its text cut to words once for them."""
    at = F.greatest(F.lit(0), F.col(low) - MARGIN)
    span = F.struct("head", "doc_id", "nth", low, high, at.alias(f"{words}_at"), (F.col(high) + MARGIN - at).alias("n"))
    other = "doc_id" if who == "head" else "head"
    counts = scratch.table(chains.groupBy(who).agg(F.count("*").alias("of")), "counts")
    part = F.pmod(F.xxhash64(other, "nth"), F.ceil(F.col("of") / TOGETHER))
    dealt = looked_up(chains, counts, [who], other).select(F.col(who).alias("_id"), part.alias("part"), span.alias("span"))
    dealt = scratch.table(dealt.groupBy("_id", "part").agg(F.collect_list("span").alias("spans")), "dealt")
    rows = docs.withColumnRenamed("doc_id", "_id").join(checked_broadcast(dealt, 2 * BROADCAST_BYTES), "_id").select("spans", F.explode(F.array(_lowered_words(F.col("text")))).alias("all"))
    cut = F.transform("spans", lambda s: F.struct(s.alias("span"), F.slice(F.col("all"), (s[f"{words}_at"] + 1).cast("int"), s["n"].cast("int")).alias(words)))
    return rows.select(F.inline(cut)).select("span.*", words).drop("n")


def _aligned(scratch: Scratch, docs: DataFrame, chains: DataFrame, k: int, min_words: int, similarity: float) -> DataFrame:
    """The passages around chains."""
    left = _sides(scratch, docs, chains, "head", "a0", "a1", "left")
    right = _sides(scratch, docs, chains, "doc_id", "b0", "b1", "right")
    both = left.join(right, ["head", "doc_id", "nth"])
    return both.mapInArrow(_align(min_words, similarity, k), "doc_id long, other_id long, start long, end long, other_start long, other_end long, edits long")


def repeated_passages(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = K,
    min_words: int = MIN_WORDS,
    similarity: float = MIN_SIMILARITY,
) -> DataFrame:
    """Passages that repeat across documents: (doc_id, other_id, start, end, other_start, other_end, edits).

    A row says that words start .. end-1 of doc_id are, but for the edits, words other_start ..
    other_end-1 of other_id, a smaller identifier.  Every document of a repeated passage has a
    row with another one of them, not with each.  Words are runs of characters other than white
    space (space, 0x09-0x0D), A-Z lower-cased.  Copies of whole documents are long passages.
    Null or empty texts, texts of fewer than k words and rows with a null identifier share
    nothing; rows that repeat an identifier count as one document.  Texts of any length are
    taken whole.  An empty table gives an empty result; other columns of df are ignored.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "passages")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seeds = scratch.table(docs.mapInArrow(_seeds(k), "h long, doc_id long, pos int"), "seeds")
    counts = seeds.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    counts = scratch.table(counts.where("low <> high").select("h", "n"), "counts")
    shared = scratch.table(_met(seeds, counts, "h", "left_semi"), "shared")
    scratch.drop(seeds)
    scratch.drop(counts)
    # two seeds at most so far apart lie in a passage of min_words
    links = scratch.table(_links(shared, max(1, min_words - k)), "links")
    scratch.drop(shared)
    passages = _aligned(scratch, docs, _chained(scratch, links, k), k, min_words, similarity)
    # chains of one passage that were cut apart extend to the same words
    return passages.groupBy("doc_id", "other_id", "start", "end").agg(F.min("other_start").alias("other_start"), F.min("other_end").alias("other_end"), F.min("edits").alias("edits"))
