"""Mixing sources to target weights by min-cost flow, where documents may belong to several sources.

Documents with the same set of sources form a membership pattern; only the patterns' total
sizes reach the driver.  Capacity flows from patterns to their sources' quotas.  Using a
pattern's words once costs nothing, a second time more, a third time more still (convex
repetition costs), so that nothing is repeated where another pattern can serve the quota.
Every pattern then repeats all its documents as often as its flow goes into its size, and
takes the rest from a seeded order of its documents.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.shared import Scratch

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Membership patterns the driver solves the flow for, and the memberships in them; a table with
#: more is refused before anything is collected (memberships are never dropped to fit).
MAX_PATTERNS, MAX_MEMBERS = 100_000, 1_000_000
#: Hash classes in a pattern's seeded order, as hex digits; only one class per pattern is sorted.
CLASS_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, weights: Sequence[int] = WEIGHTS, most: int = REPEATS) -> dict:
    """Each source's share of the total of all sizes, by the weights repeated over the sources in
    code point order (null last), no more than ``most`` times its size; excess goes to the
    others by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, rest = sum(sizes.values()), sum(weight.values())
    out: dict = {}
    for s in sorted(order, key=lambda s: (most * sizes[s] / weight[s], order.index(s))):
        level = total / rest if rest else 0.0
        out[s] = float(min(most * sizes[s], weight[s] * level))
        if out[s] == most * sizes[s]:
            total, rest = total - most * sizes[s], rest - weight[s]
    return out


def min_cost_flow(supplies: dict, quotas: dict, repeats: int = REPEATS) -> dict:
    """Words of each pattern to each of its sources, {(pattern, source): words}.

    supplies: {pattern (a tuple of sources): words}.  Repetition r of a pattern's words costs
    more than any earlier one and all other arcs are free, so the flow is made greatest level by
    level: the words of the first repetition, then those of the second, and so on, each time with
    what flows already rerouted where that helps.  Within a level, flow is pushed along shortest
    residual paths only, as long as there are any, phase by phase.
    """
    flow: dict = {}
    used = dict.fromkeys(supplies, 0)
    need = dict(quotas)
    takers: dict = {s: set() for s in need}
    for level in range(1, repeats + 1):
        while True:
            starts = [p for p, words in supplies.items() if used[p] < level * words]
            steps = _layers(starts, need, takers, flow)
            if steps is None:
                break
            for p in starts:
                while (path := _path(p, steps, need)) is not None:
                    amount = min([level * supplies[p] - used[p], need[path[-1]], *(flow[path[i + 1], path[i]] for i in range(1, len(path) - 1, 2))])
                    if amount:
                        for i in range(0, len(path), 2):
                            flow[path[i], path[i + 1]] = flow.get((path[i], path[i + 1]), 0) + amount
                            takers[path[i + 1]].add(path[i])
                        for i in range(1, len(path) - 1, 2):
                            flow[path[i + 1], path[i]] -= amount
                            if not flow[path[i + 1], path[i]]:
                                takers[path[i]].discard(path[i + 1])
                        used[p] += amount
                        need[path[-1]] -= amount
                    if used[p] == level * supplies[p]:
                        break
                    _spent(path, steps, flow, need)
    return {k: v for k, v in flow.items() if v}


def _layers(starts: list, need: dict, takers: dict, flow: dict) -> dict | None:
    """The residual arcs that lead one layer on, by breadth-first search from the patterns with
    words left to the nearest sources in need: {("p", pattern): [sources], ("s", source): [patterns]}."""
    steps: dict = {}
    patterns, seen_p, seen_s = starts, set(starts), set()
    while patterns:
        layer: dict = {}
        for p in patterns:
            steps["p", p] = [s for s in p if s in need and s not in seen_s]
            layer.update(dict.fromkeys(steps["p", p]))
        seen_s.update(layer)
        if any(need[s] > 0 for s in layer):
            for s in layer:
                steps["s", s] = []
            return steps
        patterns = []
        for s in layer:
            steps["s", s] = [p for p in sorted(takers[s], key=str) if p not in seen_p]
            patterns += steps["s", s]
        patterns = list(dict.fromkeys(patterns))
        seen_p.update(patterns)
    return None


def _path(start, steps: dict, need: dict) -> list | None:
    """[pattern, source, pattern, ..., source in need] along the arcs left; arcs that lead nowhere go."""
    path = [("p", start)]
    while path:
        kind, node = path[-1]
        if kind == "s" and not steps[kind, node] and need[node] > 0:
            return [n for _, n in path]
        if steps[kind, node]:
            path.append(("s" if kind == "p" else "p", steps[kind, node][-1]))
            continue
        path.pop()
        if path:
            steps[path[-1]].pop()
    return None


def _spent(path: list, steps: dict, flow: dict, need: dict) -> None:
    """Takes the arcs of a path that can carry no more out of the layers."""
    for i in range(1, len(path) - 1, 2):
        if not flow[path[i + 1], path[i]]:
            steps["s", path[i]].pop()
            return


def mix(
    df: DataFrame,
    members: str,
    size: str,
    order: str,
    weights: Sequence[int] = WEIGHTS,
    repeats: int = REPEATS,
    seed: str = "mix",
    max_patterns: int = MAX_PATTERNS,
    out: str = "times",
) -> tuple[DataFrame, dict, dict]:
    """df with ``out`` (how often the mix takes each row, 0 to repeats), each source's size, and each source's target.

    members: an array of sources per row (null or empty: the null source; null elements: the
    same).  size: words, a long.  order: a column that, hashed with the seed, orders the rows
    of a pattern; rows equal in it lie next to each other in an undetermined order, so results
    repeat when it is unique.  A row's size counts in each source it belongs to.  Of a
    pattern's rows the last one is taken where more than half of it fits.  More patterns than
    max_patterns, or more than MAX_MEMBERS sources in them, are a ValueError.
    """
    spark = df.sparkSession
    own = F.array_sort(F.array_distinct(F.coalesce(F.col(members).cast("array<string>"), F.array().cast("array<string>"))))
    own = F.when(F.size(own) == 0, F.array(F.lit(None).cast("string"))).otherwise(own)
    hashed = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(order).cast("string"), F.lit(""))))
    # the row itself is one column, so that its columns' names don't matter
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), own.alias("pattern"), F.col(size).cast("long").alias("size"), F.col(order).alias("order"), hashed.alias("hash"))
    scratch = Scratch(spark, "mix")
    sums = scratch.table(rows.groupBy("pattern").agg(F.sum("size").alias("words")), "patterns")
    patterns, memberships = sums.agg(F.count("*"), F.coalesce(F.sum(F.size("pattern")), F.lit(0))).first()
    if patterns > max_patterns or memberships > MAX_MEMBERS:
        raise ValueError(f"{patterns} membership patterns of {memberships} sources; coarsen the sources to {max_patterns} patterns of {MAX_MEMBERS} at most")
    by_pattern = {tuple(r[0]): int(r[1] or 0) for r in sums.collect()}
    sizes: dict = {}
    for pattern, words in by_pattern.items():
        for s in pattern:
            sizes[s] = sizes.get(s, 0) + words
    goal = targets(sizes, weights, repeats)
    flow = min_cost_flow(by_pattern, {s: int(t) for s, t in goal.items()}, repeats)
    taken = dict.fromkeys(by_pattern, 0)
    for (p, _), words in flow.items():
        taken[p] += words
    plan = [(list(p), taken[p] // w if w else 0, taken[p] % w if w else 0) for p, w in by_pattern.items()]
    plan_df = F.broadcast(spark.createDataFrame(plan, "planned array<string>, whole int, rest long"))  # a row for each pattern, counted above
    rows = rows.join(plan_df, F.col("pattern").eqNullSafe(F.col("planned"))).drop("planned")
    rows = rows.withColumn("class", F.substring("hash", 1, CLASS_DIGITS))
    classes = rows.groupBy("pattern", "class").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("class"))
    cut = (
        classes.withColumn("end", upto)
        .where((F.col("end") - F.col("words") <= F.col("rest")) & (F.col("rest") < F.col("end")))
        .groupBy(F.col("pattern").alias("cut_pattern"))
        .agg(F.min_by(F.struct("class", (F.col("end") - F.col("words")).alias("start")), "class").alias("cut"))
    )
    # a row for each pattern; without one (nothing or everything taken) the rest is 0
    rows = rows.join(F.broadcast(cut), F.col("pattern").eqNullSafe(F.col("cut_pattern")), "left").drop("cut_pattern")
    partly = F.col("cut").isNotNull() & (F.col("rest") > 0)
    cutting = F.coalesce(partly & (F.col("class") == F.col("cut.class")), F.lit(False))
    plain = rows.where(~cutting).withColumn("extra", F.when(partly, (F.col("class") < F.col("cut.class")).cast("int")).otherwise(0))
    before = F.sum("size").over(Window.partitionBy("pattern").orderBy("hash", "order").rowsBetween(Window.unboundedPreceding, 0))
    split = rows.where(cutting).withColumn("extra", (F.col("cut.start") + before - F.col("size") / 2 <= F.col("rest")).cast("int"))
    every = plain.unionByName(split)
    return every.select(*[F.col("row")[c].alias(c) for c in df.columns], (F.col("whole") + F.col("extra")).cast("int").alias(out)), sizes, goal


def words(text):
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per row of df: doc_id, size, source_size, target, taken, times.

    The membership of a row is its one source; null is a source of its own.  size counts the
    words of the text (null: 0).  target is the source's, taken = size * times.  Rows without
    words are never needed, and take nothing.  An empty table gives an empty result; other
    columns of df, whatever their names, are ignored.
    """
    spark = df.sparkSession
    base = Scratch(spark, "sizes").table(
        df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size")), "rows"
    )
    mixed, sizes, goal = mix(base.withColumn("members", F.array("source")), "members", "size", "doc_id", **options)
    known = spark.createDataFrame([(s, sizes[s], goal[s]) for s in sizes], "_s string, source_size long, target double")  # a row for each source, MAX_MEMBERS at most
    out = mixed.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def sql(seed: str = "mix", weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> str:
    """``mix_sources`` of the table documents as DuckDB SQL; with one source per document the flow is its target."""
    list_ = ", ".join(map(str, weights))
    return rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents),
s as (select source, sum(size)::bigint z, [{list_}][1 + (row_number() over (order by source nulls last) - 1) % {len(weights)}]::bigint w from d group by source),
o as (select *, row_number() over (order by {repeats} * z / w, source nulls last) k from s),
l as (select *, (select sum(z) from s) - {repeats} * coalesce(sum(z) over (order by k rows between unbounded preceding and 1 preceding), 0) as left_,
  sum(w) over (order by k rows between current row and unbounded following) as rest from o),
c as (select coalesce(min(k), 1000000000) k from l where w * (left_ / rest) < {repeats} * z),
t as (select source, z, least({repeats} * z, case when l.k < c.k then {repeats} * z else l.w * (select left_ / rest from l l2, c where l2.k = c.k) end)::double t from l, c),
r as (select d.*, t.z, t.t, floor(t.t)::bigint f, md5('{seed}|' || doc_id::varchar) h from d join t on d.source is not distinct from t.source),
u as (select *, sum(size) over (partition by source order by h, doc_id rows unbounded preceding) as upto from r)
select doc_id, size, z as source_size, t as target,
  (size * (case when z = 0 then 0 else f // z + case when f % z > 0 and upto - size / 2.0 <= f % z then 1 else 0 end end))::bigint as taken,
  (case when z = 0 then 0 else f // z + case when f % z > 0 and upto - size / 2.0 <= f % z then 1 else 0 end end)::int as times
from u
"""
