"""An exact similarity join that leaves out pairs of blocks that can't hold a similar pair.

Angles are a metric, so a vector's angles to a few pivots bound its angle to any other: if the
angles of two blocks to one pivot lie further apart than the threshold's angle, no pair of the
blocks reaches the threshold.  Vectors are ordered by their nearest pivot and their angle to it
and cut into blocks of equal size; each block has an interval of angles for each pivot.  Only
pairs of blocks whose intervals all come near enough meet in a task.

New vectors can be joined with those there are: then only pairs with a new block are made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from memloom.operators import notes as N
from memloom.operators.settle import settled

#: Vectors the pivots are chosen from, pivots at most, and bytes of all blocks' intervals, which every task gets.
SAMPLE, PIVOTS, BOUNDS_BYTES = 4_096, 32, 32 << 20
#: Added to the angle of the threshold, for rounding.
SLACK = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def _matrix(column, rows: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def choose_pivots(rows: DataFrame, most: int = PIVOTS) -> np.ndarray:
    """Pivots far from each other, of a sample of SAMPLE vectors (id, vector) by the hash of their id."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
    if not sample.num_rows:
        return np.zeros((0, 1))
    x = _unit(_matrix(sample.column("vector"), sample.num_rows))
    x = x[(x != 0).any(1)]
    if not len(x):
        return np.zeros((0, x.shape[1]))
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(most, len(x)):
        at = int(near.argmin())
        if near[at] > 1 - 1e-9:
            break
        chosen.append(at)
        near = np.maximum(near, x @ x[at])
    # each next to one near it, so that a block that reaches over two cells is small as well
    order, left = [chosen[0]], chosen[1:]
    while left:
        order.append(left.pop(int((x[left] @ x[order[-1]]).argmax())))
    return x[order]


@dataclass
class Blocks:
    """Rows (id, vector, symbol, block) and each block's number of rows and intervals (block, n, lo, hi)."""

    rows: DataFrame
    bounds: DataFrame


def cut(rows: DataFrame, pivots: np.ndarray, size: int, first: int = 0) -> Blocks:
    """Rows (id, vector, symbol, and more) in blocks of ``size``, numbered from ``first``."""
    n = len(pivots)
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column("vector"), batch.num_rows))
            angles = np.arccos(np.clip(x @ pivots.T, -1.0, 1.0)) if n else np.zeros((len(x), 0))
            none = ~(x != 0).any(1)
            cell = np.where(none, n, angles.argmin(1) if n else n)
            near = np.where(none, 0.0, angles.min(1) if n else 0.0)
            low, high = np.where(none[:, None], 0.0, angles), np.where(none[:, None], math.pi, angles)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(v.ravel())) for v in (low, high)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(near), *lists], names=[*batch.schema.names, "cell", "near", "low", "high"])

    placed = rows.mapInArrow(run, f"{plain}, cell int, near double, low array<double>, high array<double>")
    placed = N.numbered(placed, ["cell", "near", "id"], "place").withColumn("block", (F.floor(F.col("place") / size) + first).cast("long"))
    if n:
        lo = F.array(*[F.min(F.col("low")[i]) for i in range(n)])
        hi = F.array(*[F.max(F.col("high")[i]) for i in range(n)])
    else:
        lo = hi = F.array().cast("array<double>")
    bounds = placed.groupBy("block").agg(F.count("*").alias("n"), lo.alias("lo"), hi.alias("hi"))
    return Blocks(placed.select(*rows.columns, "block"), settled(bounds))


def block_pairs(left: DataFrame, right: DataFrame, angle: float) -> DataFrame:
    """(p, q), p <= q: blocks of ``left`` with those of ``right`` that may hold a pair within the angle, each
    once: ``right`` has the blocks of ``left`` and perhaps others, of higher numbers.  The intervals of ``right`` take BOUNDS_BYTES at most, by the number of pivots."""
    table = right.orderBy("block").toArrow()
    if not table.num_rows:
        return left.select(F.col("block").alias("p"), F.col("block").alias("q")).limit(0)
    shared = left.sparkSession.sparkContext.broadcast((table.column("block").to_numpy(), *(_matrix(table.column(c), table.num_rows) for c in ("lo", "hi"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, lo, hi = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lows, highs = _matrix(batch.column("lo"), batch.num_rows), _matrix(batch.column("hi"), batch.num_rows)
            for own, a, b in zip(batch.column("block").to_pylist(), lows, highs):
                near = (np.maximum(lo - b, a - hi) <= angle + SLACK).all(1)
                others = blocks[near & (blocks >= own)]
                yield pa.RecordBatch.from_pydict({"p": np.full(len(others), own, np.int64), "q": others})

    return left.select("block", "lo", "hi").mapInArrow(run, "p long, q long")


def sharing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(p, q), p <= q: blocks of ``left`` rows with blocks of ``right`` rows that share a symbol."""
    a, b = (x.where("symbol is not null").select("symbol", "block").distinct() for x in (left, right))
    met = a.withColumnRenamed("block", "a").join(b.withColumnRenamed("block", "b"), "symbol")
    return met.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct()


def rows_of(df: DataFrame, id_col: str, vector_col: str, symbol_col: str | None, more: Sequence[str] = ()) -> DataFrame:
    """(id, vector, symbol, and more columns), without null vectors; single precision stays as short as it is."""
    vector = F.col(vector_col)
    if df.schema[vector_col].dataType.simpleString() != "array<float>":
        vector = vector.cast("array<double>")
    symbol = F.when(F.col(symbol_col).isNotNull(), F.xxhash64(symbol_col)) if symbol_col else F.lit(None).cast("long")
    return df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), symbol.alias("symbol"), *more).where("vector is not null")


@dataclass
class Plan:
    """What meets in a join: all rows with their blocks, the pairs of blocks, and how many there might have been."""

    rows: DataFrame
    pairs: DataFrame
    bounds: DataFrame
    possible: int
    total: int
    size: int

    def compared(self) -> tuple[int, int]:
        """Pairs of blocks, and pairs of vectors, that meet."""
        n = self.bounds.select("block", "n")
        sized = self.pairs.join(n.select(F.col("block").alias("p"), F.col("n").alias("np")), "p").join(n.select(F.col("block").alias("q"), F.col("n").alias("nq")), "q")
        each = F.when(F.col("p") == F.col("q"), F.col("np") * (F.col("np") - 1) / 2).otherwise(F.col("np") * F.col("nq"))
        r = sized.agg(F.count("*").alias("b"), F.coalesce(F.sum(each), F.lit(0)).cast("long").alias("v")).first()
        return r["b"], r["v"]


def plan(df: DataFrame, id_col: str, vector_col: str, threshold: float, size: int, symbol_col: str | None = None, known: DataFrame | None = None, more: Sequence[str] = ()) -> Plan:
    """The blocks of df and the pairs of them that may hold a pair of vectors over the threshold (or,
    with a symbol column, of one symbol); with ``known`` vectors, pairs with a block of df only."""
    rows = rows_of(df, id_col, vector_col, symbol_col, more)
    old = rows_of(known, id_col, vector_col, symbol_col, more) if known is not None else None
    total = rows.count() + (old.count() if old is not None else 0)
    most = max(1, min(PIVOTS, BOUNDS_BYTES // (16 * max(1, math.ceil(total / size)))))
    pivots = choose_pivots(old.unionByName(rows) if old is not None else rows, most)
    own = cut(rows, pivots, size)
    angle = math.acos(min(1.0, max(-1.0, threshold)))
    if threshold <= -1.0:
        angle = math.inf
    every, bounds = own.rows, own.bounds
    n = own.bounds.count()
    possible = n * (n + 1) // 2
    if old is not None:
        other = cut(old, pivots, size, first=n)
        every, bounds = own.rows.unionByName(other.rows), own.bounds.unionByName(other.bounds)
        possible += n * other.bounds.count()
    pairs = block_pairs(own.bounds, bounds, angle)
    if symbol_col:
        pairs = pairs.unionByName(sharing(own.rows, every)).distinct()
    return Plan(every, settled(pairs), bounds, possible, total, size)


def parties(total: int, most: int, cores: int) -> int:
    """How many groups of up to ``most`` rows meet two by two: a row is sent to as many tasks as there are groups,
    so there are few, but enough for all cores."""
    return max(1, math.ceil(total / max(1, most)), min(math.ceil(total / 256), math.ceil(math.sqrt(6 * cores))))


def by_pair(tasks: DataFrame, groups: int) -> GroupedData:
    """Rows grouped by the pair (p, q) of groups they meet in, dealt to partitions that no setting merges: their rows are few for their work."""
    return tasks.repartition(groups * (groups + 1), "p", "q").groupBy("p", "q")


def meet(made: Plan, most: int) -> tuple[DataFrame, int]:
    """The rows (p, q, side, block, and made.rows) that meet in each pair of groups of neighbouring blocks, of up to
    ``most`` rows together, and the number of groups.

    The pairs of blocks that may hold a pair come as rows of side 2, with the two as id and symbol; a row is sent once to
    each group that one of its group's blocks meets, not once to each block.
    """
    groups = parties(made.total, most, made.rows.sparkSession.sparkContext.defaultParallelism)
    each = max(1, math.ceil(made.total / groups / made.size))
    of = lambda c: F.floor(F.col(c) / each).cast("long")
    met = made.pairs.select(of("p").alias("p"), of("q").alias("q")).distinct()
    same = met.where("p = q").select("p", "q", F.lit(0).alias("side"), F.col("p").alias("_group"))
    left, right = (met.where("p < q").select("p", "q", F.lit(s).alias("side"), F.col(c).alias("_group")) for s, c in ((-1, "p"), (1, "q")))
    # a row for each two groups
    rows = made.rows.withColumn("_group", of("block")).join(F.broadcast(same.unionByName(left).unionByName(right)), "_group").drop("_group")
    pairs = made.pairs.select(of("p").alias("p"), of("q").alias("q"), F.lit(2).alias("side"), F.col("p").alias("id"), F.col("q").alias("symbol"))
    return rows.unionByName(pairs, allowMissingColumns=True), groups + 1
