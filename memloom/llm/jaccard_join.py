"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes.

Texts become sets of word shingles; texts with the same set are one class.  Two sets of
similarity t share at least ceil(t * n) shingles for either one's size n, so under any total
order of shingles the prefixes of n - ceil(t * n) + m shingles of both share m or more.

1. Order.  Shingles that repeat within pieces of the input get a score, the sum of their local
   counts; the prefixes take shingles without a score first, frequent ones last.
2. Prefixes for up to ``most_matches`` required matches are indexed.  A shingle in one prefix
   only links nothing.  Each set then chooses its own number of required matches m: the entries
   that scanning its shared prefix shingles yields, and the candidates left to verify (no more
   than scanned / m), weigh against each other; if for any m fewer than m of its prefix shingles
   are shared, nothing can be similar to it, and it leaves; the others' counts fall, and the
   choice is made again ``ROUNDS`` times.  A pair must share min(m1, m2) prefix shingles.
3. Sets connected through prefix shingles form clusters (by distributed union-find over star
   edges, so no list is expanded to pairs).  A cluster's sets are dealt to size classes so wide
   that similar sets lie in one or two neighbouring ones, and large classes to blocks.  Two
   blocks meet in one task, which runs the same join in memory, ordered by the exact counts
   there, verifies every candidate on the whole sets, counts links, and returns a spanning
   forest of them.
4. Union-find over the forest gives the classes.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.shared import Scratch, checked_broadcast, components, parallelism
from memloom.llm.word_hashes import mix, overlap, shingle_sets, slices

#: Most matches a prefix may be lengthened for: so many, or this percentage of the set.
MATCHES, MATCHES_PERCENT = 4, 8
#: Numbers of required matches to choose from, as far as a set's most matches allow.
CHOICES = [2**i for i in range(13)]
#: How often sets that nothing can be similar to are taken out before clusters form.
ROUNDS = 2
#: Cost of verifying a candidate, in scanned index entries.
VERIFY_COST = 8
#: Scored shingles, at most: the score to be in the order grows with the input so that this holds.
SCORED = 400_000
#: Sets, and shingles, of a block; two blocks meet in a task.
BLOCK_SETS, BLOCK_SHINGLES = 1500, 1_500_000
_LOCAL = 3_000_000
_SLICE = 1 << 21


def least_shared(n, percent: int):
    """ceil(percent * n / 100)"""
    return (n * percent + 99) // 100


def most_matches(n: int, percent: int) -> int:
    """Never more than similar sets share at least."""
    return min(least_shared(n, percent), max(MATCHES, n * MATCHES_PERCENT // 100))


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        sizes = pa.compute.binary_length(texts).to_pylist()
        for a, b in slices(sizes, lambda n: n or 0, _SLICE):
            yield batch, a, shingle_sets(texts.slice(a, b - a).to_pylist(), k)


def _local_counts(k: int):
    """Per piece of the input the shingles that several of its texts have, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counts() -> Iterator[pa.RecordBatch]:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            often = c > 1
            yield pa.RecordBatch.from_pydict({"h": h[often].view(np.int64), "c": c[often].astype(np.int64)})

        for _, _, sets in _sets(batches, k):
            held += sets
            size += sum(map(len, sets))
            if size >= _LOCAL:
                yield from counts()
                held, size = [], 0
        if held:
            yield from counts()

    return run


def _prefixes(k: int, percent: int, scored):
    """Per row its set's size, a 128-bit digest of the set, and the prefix for the most matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, scores = scored.value
        for batch, a, sets in _sets(batches, k):
            n, d1, d2, prefix = [], [], [], []
            for s in sets:
                n.append(len(s))
                d1.append(np.sum(mix(s), dtype=np.uint64))
                d2.append(np.sum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
                length = len(s) - least_shared(len(s), percent) + most_matches(len(s), percent)
                if len(hashes) and len(s):
                    at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                    score = np.where(hashes[at] == s, scores[at], 0)
                    if score.any():
                        s = s[np.lexsort((s, score))]
                prefix.append(s[:length].view(np.int64))
            columns = [batch.column("doc_id").slice(a, len(sets)), pa.array(n, pa.int64()), pa.array(np.array(d1, np.uint64).view(np.int64)), pa.array(np.array(d2, np.uint64).view(np.int64))]
            offsets = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([len(p) for p in prefix], out=offsets[1:])
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefix) if prefix else np.empty(0, np.int64))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "d1", "d2", "prefix"])

    return run


def required_matches(shared: dict[int, int], n: int, percent: int) -> int:
    """The number of matches to require of a set of n shingles; 0 if nothing can be similar to it.
    shared: of its prefix, the positions that other prefixes share, with how many others do."""
    best, cheapest = 0, None
    for m in CHOICES:
        if m > most_matches(n, percent):
            break
        length = n - least_shared(n, percent) + m
        found = [c for at, c in shared.items() if at < length]
        if len(found) < m:
            return 0
        cost = sum(found) * (1 + VERIFY_COST / m)
        if cheapest is None or cost < cheapest:
            best, cheapest = m, cost
    return best


def _required_matches(entries: DataFrame, percent: int) -> DataFrame:
    """The same over entries (rep, n, pos, others): (rep, m), without the sets for which m is 0."""
    n = F.col("n")
    tight = F.expr(f"n - ((n * {percent} + 99) div 100)")
    most = F.least(n - tight, F.greatest(F.lit(MATCHES), F.expr(f"(n * {MATCHES_PERCENT}) div 100")))
    entries = entries.withColumn("over", F.col("pos") - tight)  # within the prefix for m matches if below m
    sums = [F.count(F.when(F.col("over") < m, 1)).alias(f"found{m}") for m in CHOICES]
    sums += [F.sum(F.when(F.col("over") < m, F.col("others")).otherwise(0)).alias(f"scan{m}") for m in CHOICES]
    by_set = entries.groupBy("rep", "n").agg(*sums).withColumn("most", most)
    none = F.lit(False)
    options = []
    for m in CHOICES:
        allowed = F.col("most") >= m
        none = none | (allowed & (F.col(f"found{m}") < m))
        options.append(F.when(allowed, F.struct((F.col(f"scan{m}") * (1 + VERIFY_COST / m)).alias("cost"), F.lit(m).alias("m"))))
    return by_set.where(~none).select("rep", F.least(*options)["m"].alias("m"))


def join_block(left: list[int], right: list[int] | None, ids: list[int], sets: list[np.ndarray], weights: list[int], percent: int):
    """All similar pairs between two lists of sets (or within one): a spanning forest of them as
    index pairs, and for each set the sum of the weights of those it is linked with."""
    members = left + (right or [])
    side = dict.fromkeys(left, 0) | dict.fromkeys(right or [], 1)
    tokens, counts = np.unique(np.concatenate([sets[i] for i in members]), return_counts=True)
    prefix, matches = {}, {}
    for i in members:
        s = sets[i]
        c = counts[np.searchsorted(tokens, s)]
        order = np.lexsort((s, c))[: len(s) - least_shared(len(s), percent) + most_matches(len(s), percent)]
        others = c[order] - 1
        shared = {int(p): int(o) for p, o in enumerate(others) if o}
        matches[i] = required_matches(shared, len(s), percent)
        if matches[i]:
            length = len(s) - least_shared(len(s), percent) + matches[i]
            prefix[i] = s[order[:length]][others[:length] > 0]
    up = {i: i for i in members}

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    degree, forest = defaultdict(int), []
    order = sorted(prefix, key=lambda i: (len(sets[i]), ids[i]))
    if not order:
        return forest, degree
    # the inverted index: entries (token, place of the set in the order), by token
    lengths = [len(prefix[i]) for i in order]
    token, place = np.concatenate([prefix[i] for i in order]), np.repeat(np.arange(len(order), dtype=np.int32), lengths)
    by_token = np.lexsort((place, token))
    token, place = token[by_token], place[by_token]
    begins = np.searchsorted(token, token)  # where each entry's token begins
    own = np.argsort(place, kind="stable")  # each set's entries
    ends = np.cumsum(lengths)
    del token, by_token
    needed = np.array([matches[i] for i in order])
    sizes, sides = np.array([len(sets[i]) for i in order]), np.array([side[i] for i in order])
    for at, i in enumerate(order):
        mine = own[ends[at] - lengths[at] : ends[at]]
        counts = mine - begins[mine]  # of each token, the sets that come earlier
        total = int(counts.sum())
        if not total:
            continue
        flat = np.repeat(begins[mine] - np.cumsum(counts) + counts, counts) + np.arange(total)
        found = np.bincount(place[flat], minlength=at)[:at]
        fit = (found >= np.minimum(needed[at], needed[:at])) & (sizes[:at] * 100 >= sizes[at] * percent)
        if right is not None:
            fit &= sides[:at] != sides[at]
        n = len(sets[i])
        for j in (order[x] for x in np.flatnonzero(fit)):
            both = overlap(sets[i], sets[j])
            if 100 * both >= percent * (n + len(sets[j]) - both):
                degree[i] += weights[j]
                degree[j] += weights[i]
                if root(i) != root(j):
                    up[root(i)] = root(j)
                    forest.append((i, j))
    return forest, degree


_LINKS = "a long, b long, id long, links long"


def _verify(k: int, percent: int):
    """The join of one task: rows of one or two blocks; rows for the forest (a, b) and for link counts (id, links)."""

    def run(rows: pa.Table) -> pa.Table:
        sets = shingle_sets(rows.column("text").cast(pa.binary()).to_pylist(), k)
        ids, weights = rows.column("doc_id").to_pylist(), rows.column("weight").to_pylist()
        sides = rows.column("side").to_pylist()
        left = [x for x in range(len(ids)) if sides[x] < 1]
        right = [x for x in range(len(ids)) if sides[x] == 1] if rows.column("between")[0].as_py() else None
        forest, degree = join_block(left, right, ids, sets, weights, percent) if left and right != [] else ([], {})
        empty = [None] * len(forest)
        return pa.table(
            {
                "a": pa.array([ids[i] for i, _ in forest] + [None] * len(degree), pa.int64()),
                "b": pa.array([ids[j] for _, j in forest] + [None] * len(degree), pa.int64()),
                "id": pa.array(empty + [ids[i] for i in degree], pa.int64()),
                "links": pa.array(empty + list(degree.values()), pa.int64()),
            }
        )

    return run


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of df: (doc_id, n_shingles, component_id, n_links).

    Words are runs of characters other than white space (space, 0x09-0x0D), A-Z lower-cased; a
    set holds the distinct k-word shingles, of fewer words the whole sequence.  Two documents
    link when 100 * intersection >= percent * union; component_id is the smallest identifier
    reachable by links, n_links the number of documents linked with.  Documents without words
    or text have an empty set and link with nothing, nor do rows with a null identifier
    (component_id null).  Rows that repeat an identifier are taken for one document where they
    link.  Texts of any length are taken whole.  An empty table gives an
    empty result; other columns of df are ignored.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    local = docs.select("doc_id", "text").mapInArrow(_local_counts(k), "h long, c long")
    scores = scratch.table(local.groupBy("h").agg(F.sum("c").alias("score")), "scores")
    total = scores.agg(F.sum("score")).first()[0] or 0
    frequent = scores.where(F.col("score") > max(7, total // SCORED)).orderBy("h").toPandas()  # SCORED rows at most, as their scores sum to total
    order = np.argsort(frequent["h"].to_numpy(np.int64).view(np.uint64))
    scored = spark.sparkContext.broadcast((frequent["h"].to_numpy(np.int64).view(np.uint64)[order], frequent["score"].to_numpy(np.int64)[order]))

    rows = scratch.table(docs.mapInArrow(_prefixes(k, percent, scored), "doc_id long, n long, d1 long, d2 long, prefix array<long>"), "prefixes")
    same = ["n", "d1", "d2"]
    classes = scratch.table(rows.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("doc_id").alias("weight")).where("rep is not null"), "classes")
    chosen = rows.withColumn("rep", F.col("doc_id")).join(classes, ["rep", *same])  # by identifier, so that copies don't meet
    entries = chosen.select("rep", "n", F.posexplode("prefix").alias("pos", "h"))
    entries = scratch.table(entries, "entries")  # read twice below
    lists = entries.groupBy("h").agg((F.count("*") - 1).alias("others")).where("others > 0")
    shared = scratch.table(entries.join(lists, "h"), "shared")
    scratch.drop(entries)

    for left in reversed(range(ROUNDS + 1)):
        alive = shared.join(_required_matches(shared, percent), "rep")
        if not left:  # the choice is final: each set keeps its own prefix
            alive = alive.where(f"pos < n - ((n * {percent} + 99) div 100) + m")
        alive = scratch.table(alive.select("rep", "n", "pos", "h"), "alive")
        lists = alive.groupBy("h").agg((F.count("*") - 1).alias("others")).where("others > 0")
        scratch.drop(shared)
        shared = scratch.table(alive.join(lists, "h"), "shared")
        scratch.drop(alive)
    heads = shared.groupBy("h").agg(F.min("rep").alias("head"))
    edges = shared.join(heads, "h").where("rep <> head").select("rep", "head").distinct()
    clusters = components(scratch, edges, "rep", "head")

    placed = clusters.join(shared.groupBy("rep").agg(F.first("n").alias("n")), F.col("node") == F.col("rep"))
    # similar sets differ by a factor of 100 / percent at most, so by one class at most; classes are a little wider
    width = math.log(100 / max(1, percent - 1))
    size_class = F.floor(F.log(F.col("n").cast("double")) / width).cast("int") if percent > 1 else F.lit(0)
    placed = scratch.table(placed.select("rep", "n", "component", size_class.alias("class")), "placed")
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = scratch.table(placed.groupBy("component", "class").agg(blocks.alias("blocks"), F.count("*").alias("sets")), "sizes")

    def near(step: int) -> DataFrame:
        return sizes.select("component", (F.col("class") - step).alias("class"), F.col("blocks").alias("after" if step > 0 else "before"))

    dealt = placed.join(sizes, ["component", "class"]).join(near(1), ["component", "class"], "left").join(near(-1), ["component", "class"], "left")
    dealt = dealt.where("sets > 1 or after is not null or before is not null").join(classes.select("rep", "weight"), "rep")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")
    dealt = scratch.table(dealt.select("rep", "component", "class", "weight", "sets", "blocks", "before", "after", block), "dealt")
    known = checked_broadcast(dealt)
    wanted = docs.join(known, docs["doc_id"] == known["rep"]).drop("rep")

    def up_to(count) -> Column:
        return F.sequence(F.lit(0), F.col(count) - 1)

    own = F.transform(up_to("blocks"), lambda o: F.struct(F.col("class").alias("c"), F.col("class").alias("d"), F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), F.when(o == F.col("block"), -1).when(F.col("block") < o, 0).otherwise(1).alias("side")))
    on = F.transform(up_to("after"), lambda o: F.struct(F.col("class").alias("c"), (F.col("class") + 1).alias("d"), F.col("block").alias("i"), o.alias("j"), F.lit(0).alias("side")))
    back = F.transform(up_to("before"), lambda o: F.struct((F.col("class") - 1).alias("c"), F.col("class").alias("d"), o.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")))
    none = F.array().cast("array<struct<c:int,d:int,i:int,j:int,side:int>>")
    tasks = F.concat(F.when(F.col("sets") > 1, own).otherwise(none), F.coalesce(on, none), F.coalesce(back, none))
    tasks = wanted.withColumn("task", F.explode(tasks)).select("component", "task.c", "task.d", "task.i", "task.j", "task.side", "doc_id", "weight", "text")
    tasks = tasks.withColumn("between", F.expr("c <> d or i <> j"))
    found = scratch.table(tasks.groupBy("component", "c", "d", "i", "j").applyInArrow(_verify(k, percent), _LINKS), "links")
    linked = components(scratch, found.where("a is not null").select("a", "b"), "a", "b")
    degrees = found.where("id is not null").groupBy("id").agg(F.sum("links").alias("links"))

    groups = classes.join(linked, F.col("rep") == F.col("node"), "left").join(degrees, F.col("rep") == F.col("id"), "left")
    groups = groups.select(*same, F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    # a hash class of identifiers beside the digest spreads a large class of copies
    lanes = parallelism(spark)
    lane = F.pmod(F.xxhash64("doc_id"), F.lit(lanes)).cast("int")
    keyed = rows.select("doc_id", *same, lane.alias("lane"))
    met = keyed.where("n > 0 and doc_id is not null").select(*same, "lane").distinct().join(groups, same)
    out = keyed.join(met, [*same, "lane"], "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
g as (select doc_id, list_distinct(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: md5(array_to_string(ws[i:i + 3], ' ')))
  when len(ws) > 0 then [md5(array_to_string(ws, ' '))] else [] end) s from w),
n as (select doc_id, len(s)::bigint n from g),
e as (select doc_id, unnest(s) h from g),
p as (select a.doc_id x, b.doc_id y, count(*) c from e a join e b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
u as (select x, y from l union all select y, x from l),
r as (select doc_id x, doc_id y from n union select r.x, u.y from r join u on u.x = r.y)
select doc_id, n as n_shingles, (select min(y) from r where r.x = n.doc_id) as component_id, (select count(*) from u where u.x = n.doc_id) as n_links from n
"""
