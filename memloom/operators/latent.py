"""An embedder learned from the texts themselves: latent semantic analysis.

Texts become rows of a sparse matrix, a column for each term, weighted (1 + ln tf) * idf and scaled
to unit length.  Its greatest singular vectors come from a block Lanczos iteration on A'A that runs
until the residuals are small; texts, old or new, are folded in by multiplying their row with
the right singular vectors, so texts that share topics are near without sharing words.

The rows stay on the executors: a step sends the block of vectors to them and gets the sums of
its products back.  The model, and with it all the driver holds, is a matrix of at most TERMS
rows; its size depends on TERMS and the dimensions, not on the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators.settle import dropped, settled

DIMS = 64
#: Terms of a model, those of most texts first (ties by term), and the texts a term stands in at least.
TERMS, LEAST_TEXTS = 30_000, 2
#: Vectors of a block beyond those asked for, vectors of a basis at most, and the residual, as a share of the greatest eigenvalue, it ends at.
SPARE, BASIS, TOLERANCE = 8, 240, 1e-4
#: Matrix entries multiplied at once, terms of a block of sums, and first-level groups of its partial sums.
ENTRIES, BLOCK, LANES = 50_000, 256, 32


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def term_counts(df: DataFrame, text: str) -> DataFrame:
    """(term, texts): in how many texts each term stands."""
    return df.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("texts"))


def idf(texts: Column | np.ndarray, n: int):
    """Smoothed inverse document frequency, never below 1."""
    if isinstance(texts, Column):
        return F.log((F.lit(1.0) + n) / (F.lit(1.0) + texts)) + 1
    return np.log((1.0 + n) / (1.0 + texts)) + 1


def vocabulary(df: DataFrame, text: str, terms: int = TERMS, least: int = LEAST_TEXTS) -> DataFrame:
    """(term, texts, idf) of the terms of a model."""
    n = df.count()
    known = term_counts(df, text).where(F.col("texts") >= least).orderBy(F.desc("texts"), "term").limit(terms)
    return known.withColumn("idf", idf(F.col("texts"), n))


def _rows(lists: pa.Array, terms: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token lists as matrix entries (row, term, weight), by row; unknown tokens left out."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    at = pc.index_in(flat, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = at >= 0
    keys, counts = np.unique(row[known] * len(terms) + at[known], return_counts=True)
    row, term = keys // len(terms), keys % len(terms)
    w = (1 + np.log(counts)) * weights[term]
    length = np.sqrt(np.bincount(row, w * w, len(lists)))
    return row, term, w / length[row]


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values with the same row; rows must be sorted."""
    starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    return rows[starts], np.add.reduceat(values, starts, axis=0)


def _folded(n: int, row: np.ndarray, term: np.ndarray, w: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The rows times q, some entries at a time."""
    out = np.zeros((n, q.shape[1]))
    for a in range(0, len(row), ENTRIES):
        part = slice(a, a + ENTRIES)
        at, sums = _sums(row[part], q[term[part]] * w[part, None])
        out[at] += sums
    return out


def _gram_times(q) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A'A q of a partition's rows, in blocks of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, total = q.value, None
        for batch in batches:
            terms = batch.column("term")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
            term, w = terms.flatten().to_numpy().astype(np.int64), batch.column("w").flatten().to_numpy()
            if not len(term):
                continue
            if total is None:
                total = np.zeros(block.shape)
            y = _folded(batch.num_rows, row, term, w, block)
            order = np.argsort(term, kind="stable")
            row, term, w = row[order], term[order], w[order]
            for a in range(0, len(row), ENTRIES):
                part = slice(a, a + ENTRIES)
                at, sums = _sums(term[part], y[row[part]] * w[part, None])
                total[at] += sums
        if total is not None:
            lane = TaskContext.get().partitionId() % LANES
            for a in range(0, len(total), BLOCK):
                if total[a : a + BLOCK].any():
                    yield pa.RecordBatch.from_pydict({"block": [a], "lane": pa.array([lane], pa.int32()), "x": pa.array([total[a : a + BLOCK].ravel()], pa.list_(pa.float64()))})

    return run


def _added(table: pa.Table) -> pa.Table:
    lists = table.column("x").combine_chunks()
    total = lists.flatten().to_numpy().reshape(table.num_rows, -1).sum(0)
    kept = {c: table.column(c)[:1] for c in table.column_names if c != "x"}
    return pa.table({**kept, "x": pa.array([total], pa.list_(pa.float64()))})


def lanczos(product: Callable[[np.ndarray], np.ndarray], n: int, k: int, spare: int = SPARE, most: int = BASIS, tolerance: float = TOLERANCE, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenpairs of a symmetric positive matrix of which only products with blocks are
    known: block Lanczos with full re-orthogonalisation, anew from the best vectors when the basis has
    ``most``, until all residuals are at most ``tolerance`` of the greatest value."""
    k = min(k, n)
    width = min(n, k + spare)
    most = max(most, 3 * width)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))
    basis, small = q, np.zeros((0, 0))
    while True:
        z = product(q)
        h = basis.T @ z
        z = z - basis @ h
        again = basis.T @ z
        z, h = z - basis @ again, h + again
        size, last = basis.shape[1], q.shape[1]
        grown = np.zeros((size, size))
        grown[: len(small), : len(small)] = small
        grown[:, size - last :] = h
        grown[size - last :, :] = h.T
        small = grown
        values, ritz = np.linalg.eigh((small + small.T) / 2)
        values, ritz = values[::-1], ritz[:, ::-1]
        left, sizes, right = np.linalg.svd(z, full_matrices=False)
        kept = sizes > 1e-12 * max(values[0], 1e-300)
        r = (sizes[:, None] * right)[kept]
        residuals = np.sqrt(((r @ ritz[size - last :, :k]) ** 2).sum(0)) if len(r) else np.zeros(k)
        if not len(r) or residuals.max() <= tolerance * max(values[0], 0.0):
            return values[:k], basis @ ritz[:, :k]
        q = left[:, kept]
        if size + q.shape[1] > most:
            best = ritz[:, : min(size, max(k, most // 3))]
            basis, small = basis @ best, np.diag(values[: best.shape[1]])
        basis = np.hstack([basis, q])


@dataclass
class LatentModel:
    terms: list[str]
    idf: np.ndarray
    vectors: np.ndarray
    values: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, text: str, dims: int = DIMS, terms: int = TERMS, least: int = LEAST_TEXTS, tolerance: float = TOLERANCE) -> LatentModel:
        """A model of all texts; of a table without terms, one that folds every text to zeros."""
        spark = df.sparkSession
        known = vocabulary(df, text, terms, least).toArrow()  # no more rows than terms
        names, weights = known.column("term").to_pylist(), known.column("idf").to_numpy()
        if not names:
            return cls([], weights, np.zeros((0, dims)), np.zeros(0))
        shared = spark.sparkContext.broadcast((pa.array(names), weights))

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value_set, w = shared.value
            for batch in batches:
                row, term, weight = _rows(batch.column(0), value_set, w)
                at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (term.astype(np.int32), weight)]
                yield pa.RecordBatch.from_arrays(lists, names=["term", "w"])

        matrix = settled(df.select(tokens(F.col(text)).alias("t")).mapInArrow(entries, "term array<int>, w array<double>"))

        def product(q: np.ndarray) -> np.ndarray:
            sent = spark.sparkContext.broadcast(q)
            partial = matrix.mapInArrow(_gram_times(sent), "block long, lane int, x array<double>")
            lanes = partial.groupBy("block", "lane").applyInArrow(_added, "block long, lane int, x array<double>")
            total = lanes.select("block", "x").groupBy("block").applyInArrow(_added, "block long, x array<double>").toArrow()
            out = np.zeros(q.shape)
            for block, x in zip(total.column("block").to_pylist(), total.column("x")):
                out[block : block + BLOCK] = x.values.to_numpy().reshape(-1, q.shape[1])
            sent.destroy()
            return out

        values, vectors = lanczos(product, len(names), dims, tolerance=tolerance)
        dropped(matrix)
        at = np.abs(vectors).argmax(0)
        vectors = vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
        return cls(names, weights, vectors, np.sqrt(np.maximum(values, 0.0)))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = pa.table({"term": self.terms, "at": np.arange(len(self.terms)), "idf": self.idf, "vector": pa.array(list(self.vectors), pa.list_(pa.float64()))})
        spark.createDataFrame(rows).coalesce(1).write.mode("overwrite").parquet(f"{path}/terms")
        spark.createDataFrame([(self.vectors.shape[1], [float(v) for v in self.values])], "dims int, values array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/values")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LatentModel:
        dims, values = spark.read.parquet(f"{path}/values").first()
        rows = spark.read.parquet(f"{path}/terms").orderBy("at").toArrow()
        vectors = np.array(rows.column("vector").to_pylist(), float).reshape(-1, dims)
        return cls(rows.column("term").to_pylist(), rows.column("idf").to_numpy(), vectors, np.array(values))


class LatentEmbedder:
    """Vectors by a fitted model, of unit length unless told otherwise; zeros for texts without a term it knows."""

    def __init__(self, model: LatentModel, unit: bool = True):
        self.model, self.unit = model, unit
        self.dims = model.vectors.shape[1]

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        m, unit = self.model, self.unit
        shared = df.sparkSession.sparkContext.broadcast((pa.array(m.terms, pa.string()), m.idf, m.vectors))

        @F.arrow_udf("array<float>")
        def fold(lists: pa.Array) -> pa.Array:
            terms, weights, vectors = shared.value
            if not len(terms):
                x = np.zeros((len(lists), vectors.shape[1]))
            else:
                x = _folded(len(lists), *_rows(lists, terms, weights), vectors)
            if unit:
                length = np.sqrt((x * x).sum(1, keepdims=True))
                x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            return pa.ListArray.from_arrays(offsets, pa.array(x.ravel().astype(np.float32)))

        return df.withColumn(out, fold(tokens(F.col(text))))
