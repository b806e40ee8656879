"""Eigenvectors of the normalised Laplacian, and clusters from them.

The reference point is the definition: the k smallest eigenpairs, ascending.  Small graphs are
solved on the driver, larger ones by a block Lanczos iteration that runs until the residuals
of all k pairs are below a tolerance.  Its matrix-vector products multiply cells of the matrix,
of a bounded number of entries, with blocks of the vectors; the driver holds the small projected
matrix, never the graph's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.graph import STRIPE, TILE, Side, Similarity, block_tasks, both_ways, laplacian, normalized_weights
from memloom.operators.settle import bucketed, dropped, settled

#: Nodes up to which the matrix is solved on the driver: dense, 128 MB at most.
DENSE_NODES = 4_000
#: Vectors of a Lanczos block beyond those asked for, vectors of the basis at which the iteration starts anew from its best ones, and the residual it ends at.
SPARE, BASIS, TOLERANCE = 8, 320, 1e-7
#: Nodes of a block of the matrix, and entries of a cell; a block of more entries is dealt to several cells.
ROWS, CELL = 4_096, 2_000_000
_ENTRIES, _BLOCK = "r long, c long, v double", "block int, i long, x array<double>"


def canonical(vectors: np.ndarray) -> np.ndarray:
    """Each column with its largest entry positive."""
    at = np.abs(vectors).argmax(0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def smallest_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(matrix)
    return values[:k], canonical(vectors[:, :k])


def dense_eigen(nodes: DataFrame, edges: DataFrame | Similarity, k: int) -> tuple[np.ndarray, list[int], np.ndarray]:
    """On the driver, which gets the matrix as columns of DENSE_NODES ** 2 / 2 entries at most."""
    ids = np.sort(nodes.select("note_id").toArrow().column(0).to_numpy())
    entries = laplacian(nodes, edges).toArrow()
    i, j = (np.searchsorted(ids, entries.column(c).to_numpy()) for c in ("i", "j"))
    matrix = np.zeros((len(ids), len(ids)))
    matrix[i, j] = matrix[j, i] = entries.column("w").to_numpy()
    values, vectors = smallest_eigenpairs(matrix, min(k, len(ids)))
    return values, ids.tolist(), vectors


def _columns(batch, name: str) -> np.ndarray:
    """An array column of equal lengths as a matrix."""
    column = batch.column(name)
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _arrays(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _times(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block of matrix rows (block, j, i, w), all of some nodes j, times their vectors (block, i, x): partial sums by i."""
    names = pa.schema([("i", pa.int64()), ("y", pa.list_(pa.float64()))])
    if not left.num_rows or not right.num_rows:
        return names.empty_table()
    i, j, w = (left.column(c).to_numpy() for c in ("i", "j", "w"))
    nodes, x = right.column("i").to_numpy(), _columns(right, "x")
    order = np.argsort(nodes)
    nodes, x = nodes[order], x[order]
    order = np.argsort(i, kind="stable")
    i, j, w = i[order], j[order], w[order]
    starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
    ends = np.append(starts[1:], len(i))
    out = np.empty((len(starts), x.shape[1]))
    at = np.searchsorted(nodes, j)
    first = 0
    while first < len(starts):  # some rows at once, so that the products stay small
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + 200_000, "right")))
        part = slice(starts[first], ends[last - 1])
        out[first:last] = np.add.reduceat(x[at[part]] * w[part, None], starts[first:last] - starts[first], axis=0)
        first = last
    return pa.table([pa.array(i[starts]), _arrays(out)], schema=names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of vectors (block, i, y) by i, of one block of nodes; partial sums are added as they come."""
    nodes, total = np.empty(0, np.int64), None
    for part in batches:
        if part.num_rows:
            batch = part
            i, y = batch.column("i").to_numpy(), _columns(batch, "y")
            if total is not None:
                i, y = np.concatenate((nodes, i)), np.vstack((total, y))
            order = np.argsort(i, kind="stable")
            i, y = i[order], y[order]
            starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
            nodes, total = i[starts], np.add.reduceat(y, starts, axis=0)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), batch.column("block")[0].as_py(), np.int32)), pa.array(nodes), _arrays(total)], names=["block", "i", "x"])


def _entries(m: np.ndarray) -> pa.Table:
    return pa.table({"r": pa.array(np.repeat(np.arange(len(m)), m.shape[1])), "c": pa.array(np.tile(np.arange(m.shape[1]), len(m))), "v": pa.array(m.ravel())})


def _added(parts: DataFrame) -> np.ndarray:
    """The sum of matrices (r, c, v); tasks add up their own, and only the small sums leave them."""
    cells = parts.groupBy("r", "c").agg(F.sum("v").alias("v")).toArrow()
    r, c = cells.column("r").to_numpy(), cells.column("c").to_numpy()
    out = np.zeros((r.max() + 1, c.max() + 1))
    out[r, c] = cells.column("v").to_numpy()
    return out


def _squared(df: DataFrame, column: str) -> np.ndarray:
    """x' * x of an array column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                x = _columns(batch, column)
                total = total + x.T @ x
        if not np.isscalar(total):
            yield from _entries(total).to_batches()

    return _added(df.select(column).mapInArrow(run, _ENTRIES))


def _turned(df: DataFrame, column: str, by: np.ndarray) -> DataFrame:
    """(block, i, q): an array column times a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"block": batch.column("block"), "i": batch.column("i"), "q": _arrays(_columns(batch, column) @ by)})

    return df.select("block", "i", column).mapInArrow(run, "block int, i long, q array<double>")


def _vectors(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a block, ascending, and their basis vectors, of rows (step, i, q)."""
    step, out = rows.column("step").to_numpy(), []
    for n in np.unique(step):
        part = rows.filter(pa.array(step == n)).sort_by("i")
        out.append(_columns(part, "q"))
    return part.column("i").to_numpy(), np.hstack(out)


def _rows(rows: pa.Table, nodes: np.ndarray, width: int) -> np.ndarray:
    """The vectors of rows (i, x) by node; zeros for nodes without."""
    out = np.zeros((len(nodes), width))
    if rows.num_rows:
        out[np.searchsorted(nodes, rows.column("i").to_numpy())] = _columns(rows, "x")
    return out


def _on_basis(basis: DataFrame, w: DataFrame, width: int, value: Callable[[np.ndarray, np.ndarray], pa.Table | np.ndarray], out: str) -> DataFrame:
    """value(basis vectors, w) for each block of nodes, both of which are in buckets by block: nothing is shuffled."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        nodes, q = _vectors(left)
        made = value(q, _rows(right, nodes, width))
        if isinstance(made, pa.Table):
            return made
        return pa.table({"block": pa.array(np.full(len(nodes), left.column("block")[0].as_py(), np.int32)), "i": pa.array(nodes), "x": _arrays(made)})

    return basis.groupBy("block").cogroup(w.groupBy("block")).applyInArrow(run, out)


def _cells(entries: DataFrame, blocks: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Entries (i, j, w) of the matrix as cells (block, part): the columns of some nodes j, and as
    many parts of their rows as CELL asks for; and the number of parts of each block."""
    entries = settled(entries.select(_block("j", blocks), "i", "j", "w"))
    parts = settled(entries.groupBy("block").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("i", F.lit(1)), F.col("parts")).cast("int").alias("part")
    # a row for each ROWS nodes
    cells = bucketed(entries.join(parts, "block").select("block", part, "i", "j", "w"), ["block", "part"], buckets)
    dropped(entries)
    return cells, parts


def _block(node: str, blocks: int):
    return F.pmod(F.xxhash64(node), F.lit(blocks)).cast("int").alias("block")


def _multiplied(cells: DataFrame, parts: DataFrame, vectors: DataFrame, blocks: int) -> DataFrame:
    """The matrix times vectors (block, i, q), as (block, i, x); nodes without an entry are left out."""
    sent = vectors.select("block", "i", F.col("q").alias("x")).join(parts, "block")
    sent = sent.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "i", "x")
    partial = cells.groupBy("block", "part").cogroup(sent.groupBy("block", "part")).applyInArrow(_times, "i long, y array<double>")
    return partial.select(_block("i", blocks), "i", "y").groupBy("block").applyInArrow(_summed, _BLOCK)


class _Stored:
    """The normalised adjacency as cells of its entries."""

    def __init__(self, edges: DataFrame, blocks: int, buckets: int) -> None:
        self.cells, self.parts = _cells(both_ways(normalized_weights(edges)), blocks, buckets)
        self.blocks = blocks

    def times(self, vectors: DataFrame) -> DataFrame:
        """The matrix times vectors (block, i, q) of all nodes, as (block, i, x)."""
        return _multiplied(self.cells, self.parts, vectors, self.blocks)

    def drop(self) -> None:
        dropped(self.cells)
        dropped(self.parts)


def _tile_product(threshold: float):
    """Two blocks of vectors (id, vector, scale), of which the pairs that reach the threshold are the matrix's
    entries, times their nodes' vectors (i, x): partial sums by i.  Entries live a tile at a time."""

    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        names = pa.schema([("i", pa.int64()), ("y", pa.list_(pa.float64()))])
        side = rows.column("side").to_numpy()
        own = bool((side == 0).any())
        left = Side(rows.filter(pa.array(side <= 0)))
        right = left if own else Side(rows.filter(pa.array(side == 1)))
        if not len(left.ids) or not len(right.ids) or not sent.num_rows:
            return names.empty_table()
        nodes, x = sent.column("i").to_numpy(), _columns(sent, "x")
        order = np.argsort(nodes)
        nodes, x = nodes[order], x[order]
        a, b = (x[np.searchsorted(nodes, s.ids)] * s.more["scale"][:, None] for s in (left, right))
        y, z = np.zeros_like(a), np.zeros_like(b)
        stripe = max(1, min(STRIPE, TILE // len(right.ids)))
        for row in range(0, len(left.ids), stripe):
            w = left.x[row : row + stripe] @ right.x.T
            if not (left.finite and right.finite):
                w = np.nan_to_num(w)
            w[w < threshold] = 0.0
            if own:
                w[np.arange(len(w)), row + np.arange(len(w))] = 0.0
            y[row : row + stripe] = w @ b
            if not own:
                z += w.T @ a[row : row + stripe]
        y, ids = y * left.more["scale"][:, None], left.ids
        if not own:
            y, ids = np.vstack((y, z * right.more["scale"][:, None])), np.concatenate((ids, right.ids))
        return pa.table([pa.array(ids), _arrays(y)], schema=names)

    return run


class _Implied:
    """The normalised adjacency of a similarity graph, whose entries are made anew in each product: the
    vectors they follow from are kept, in buckets by the pair of blocks that meet."""

    def __init__(self, graph: Similarity, blocks: int) -> None:
        tasks, self.groups = block_tasks(settled(graph.scaled()), "note_id", "embedding", more=["scale"])
        self.tasks = bucketed(tasks, ["p", "q"], self.groups * (self.groups + 1))
        self.threshold, self.blocks = graph.threshold, blocks

    def times(self, vectors: DataFrame) -> DataFrame:
        own = F.pmod(F.xxhash64("i"), F.lit(self.groups)).cast("int").alias("own")
        sent = vectors.select(own, F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))).alias("other"), "i", F.col("q").alias("x"))
        sent = sent.select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "i", "x")
        partial = self.tasks.groupBy("p", "q").cogroup(sent.groupBy("p", "q")).applyInArrow(_tile_product(self.threshold), "i long, y array<double>")
        return partial.select(_block("i", self.blocks), "i", "y").groupBy("block").applyInArrow(_summed, _BLOCK)

    def drop(self) -> None:
        dropped(self.tasks)


def _orthonormal(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For vectors X with X'X = g: (u, r) so that X u is orthonormal and X = X u r, without directions that vanish."""
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    kept = values > 1e-18
    root = np.sqrt(values[kept])
    return vectors[:, kept] / root, (vectors[:, kept] * root).T


def lanczos_eigen(nodes: DataFrame, edges: DataFrame | Similarity, k: int, seed: int = 1, tolerance: float = TOLERANCE, most: int = BASIS, known: DataFrame | None = None, progress: Callable[[int, float], None] | None = None) -> tuple[np.ndarray, DataFrame]:
    """The k smallest eigenpairs by block Lanczos with full re-orthogonalisation: (values, coords by node).

    With ``known`` coordinates (note_id, coords) of some nodes, such as those of a graph before
    notes were added, the iteration starts from them; it ends by the same residuals.

    A block has more vectors than pairs are wanted, so repeated values, such as the zeros of a
    graph of several components, are found as often as they occur.  The basis is a table
    with rows (block of nodes, step, node, vectors); a step reads all of it and puts its own rows
    behind.  At ``most`` vectors the iteration starts anew from the best ones.

    Edges are a table, of which the matrix is kept in cells, or a similarity graph, of which no entry is kept.
    """
    n = nodes.count()
    k = min(k, n)
    blocks = max(1, -(-n // ROWS))
    buckets = min(blocks, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    matrix = _Implied(edges, blocks) if isinstance(edges, Similarity) else _Stored(edges, blocks, buckets)
    width = min(n, k + SPARE)
    start = F.array(*[F.xxhash64("note_id", F.lit(seed + c)) / F.lit(float(1 << 63)) for c in range(width)])
    first = nodes.select("note_id", start.alias("q"))
    if known is not None:
        size = known.agg(F.coalesce(F.max(F.least(F.size("coords"), F.lit(k))), F.lit(0))).first()[0]
    if known is not None and size:
        old = known.select("note_id", F.slice("coords", 1, max(1, size)).alias("_old"))
        zeros = F.array_repeat(F.lit(0.0), size)
        first = settled(first.join(old, "note_id", "left"))
        # nodes without coordinates get what the matrix makes of their neighbours'; the spare vectors stay random
        near = matrix.times(first.select(_block("note_id", blocks), F.col("note_id").alias("i"), F.coalesce("_old", zeros).alias("q")))
        first = first.join(near.select(F.col("i").alias("note_id"), F.col("x").alias("_near")), "note_id", "left")
        first = first.select("note_id", F.concat(F.coalesce("_old", "_near", zeros), F.slice("q", size + 1, width)).alias("q"))
    held = settled(first.select(_block("note_id", blocks), F.col("note_id").alias("i"), "q"))
    u, _ = _orthonormal(_squared(held, "q"))
    again = settled(_turned(held, "q", u))
    u, _ = _orthonormal(_squared(again, "q"))  # once more, to working precision
    step = 0

    def put(vectors: DataFrame, behind: DataFrame | None = None) -> DataFrame:
        return bucketed(vectors.select("block", F.lit(step).alias("step"), "i", "q"), ["block"], buckets, behind)

    basis = put(_turned(again, "q", u))
    for table in (held, again):
        dropped(table)
    small = np.zeros((0, 0))
    size = last = u.shape[1]
    while True:
        # w = (adjacency) * (last block), and z = w less its parts along the basis, twice: the second parts
        # come with z'z from one pass, and z itself is made where it is written
        w = bucketed(matrix.times(basis.where(F.col("step") == step)), ["block"], buckets)
        h = _added(_on_basis(basis, w, last, lambda q, x: _entries(q.T @ x), _ENTRIES))

        def second(q: np.ndarray, x: np.ndarray, h: np.ndarray = h) -> pa.Table:
            z = x - q @ h
            return _entries(np.vstack((q.T @ z, z.T @ z)))

        both = _added(_on_basis(basis, w, last, second, _ENTRIES))
        again, g = both[:size], both[size:]
        u, r = _orthonormal(g - again.T @ again)
        # the projected matrix: what was known, the new block's column, and its mirror image
        h = h + again
        grown = np.zeros((size, size))
        grown[: len(small), : len(small)] = small
        grown[:, size - last :] = h
        grown[size - last :, :] = h.T
        small = grown
        values, ritz = np.linalg.eigh((small + small.T) / 2)
        values, ritz = values[::-1], ritz[:, ::-1]  # the greatest of the adjacency are the smallest of the Laplacian
        good = min(k, size)
        residuals = np.sqrt(((r @ ritz[size - last :, :good]) ** 2).sum(0)) if len(r) else np.zeros(good)
        if progress:
            progress(size, float(residuals.max()))
        if len(r) == 0 or residuals.max() <= tolerance:
            break
        z = _on_basis(basis, w, last, lambda q, x, h=h - again, again=again, u=u: (x - q @ h - q @ again) @ u, _BLOCK).withColumnRenamed("x", "q")
        if size + len(r) > most:  # anew from the best vectors, with the block they leave over
            best = ritz[:, : min(size, most // 4)]
            z = settled(z)
            fewer = put(_combined(basis, best))
            dropped(basis)
            basis, small, size = fewer, np.diag(values[: best.shape[1]]), best.shape[1]
        step += 1
        basis = put(z, basis)
        size, last = size + len(r), len(r)
        dropped(w)
    found = settled(_combined(basis, ritz[:, :good]).select("i", "q"))
    for table in (basis, w):
        dropped(table)
    matrix.drop()
    return 1.0 - values[:good], canonical_signs(found)


def _combined(basis: DataFrame, by: np.ndarray) -> DataFrame:
    """(block, i, q): the basis vectors times a matrix."""

    def run(rows: pa.Table) -> pa.Table:
        nodes, q = _vectors(rows)
        return pa.table({"block": pa.array(np.full(len(nodes), rows.column("block")[0].as_py(), np.int32)), "i": pa.array(nodes), "q": _arrays(q @ by)})

    return basis.groupBy("block").applyInArrow(run, "block int, i long, q array<double>")


def canonical_signs(vectors: DataFrame) -> DataFrame:
    """(note_id, coords) of vectors (i, q), turned so that each vector's largest entry is positive."""
    rows = vectors.select("i", F.posexplode("q").alias("c", "x")).groupBy("c").agg(F.max_by("x", F.struct(F.abs("x"), -F.col("i"))).alias("x")).collect()  # a row for each vector
    signs = [1.0 if r["x"] >= 0 else -1.0 for r in sorted(rows, key=lambda r: r["c"])]
    return vectors.select(F.col("i").alias("note_id"), F.zip_with("q", F.array(*map(F.lit, signs)), lambda x, s: x * s).alias("coords"))


def spectral_decomposition(nodes: DataFrame, edges: DataFrame | Similarity, k: int, known: DataFrame | None = None) -> tuple[np.ndarray, DataFrame]:
    """Eigenvalues, ascending, and (note_id, coords) of the k smallest; an iteration starts from ``known`` coordinates."""
    n = nodes.count()
    if n > DENSE_NODES:
        return lanczos_eigen(nodes, edges, k, known=known)
    values, ids, vectors = dense_eigen(nodes, edges, k)
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return values, nodes.sparkSession.createDataFrame(rows, "note_id long, coords array<double>")


def eigengap(values) -> int:
    """The index of the largest positive gap between successive values, the first of equals; at least 2."""
    if len(values) <= 2:
        return 2
    gaps = [values[i] - values[i - 1] for i in range(1, len(values))]
    best = max(gaps)
    return max(2, gaps.index(best) + 1) if best > 0 else 2


def eigengap_of(values: DataFrame) -> DataFrame:
    """The same over a table (idx, value); a row for each eigenpair."""
    gap = F.col("value") - F.lag("value").over(Window.orderBy("idx"))
    gaps = values.withColumn("gap", gap).where("gap > 0")
    return gaps.agg(F.greatest(F.lit(2), F.coalesce(F.max_by("idx", F.struct("gap", -F.col("idx"))), F.lit(2))).cast("int").alias("clusters"))


def spectral_embedding(coords: DataFrame, dims: int, n: int) -> DataFrame:
    """The first dims coordinates (no more than n - 1), rows of unit length; zero rows stay."""
    kept = F.slice("coords", 1, max(1, min(dims, n - 1)))
    out = coords.select("note_id", kept.alias("coords"))
    length = F.sqrt(F.aggregate("coords", F.lit(0.0), lambda s, x: s + x * x))
    return out.withColumn("_length", length).select("note_id", F.when(F.col("_length") > 0, F.transform("coords", lambda x: x / F.col("_length"))).otherwise(F.col("coords")).alias("coords"))


def cluster(spectral: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(note_id, label) by k-means; labels are numbered by their smallest note."""
    points = spectral.select("note_id", array_to_vector("coords").alias("features"))
    model = KMeans(k=max(1, k), seed=seed, maxIter=100).fit(points.orderBy("note_id"))
    raw = model.transform(points).select("note_id", F.col("prediction").alias("_raw"))
    firsts = raw.groupBy("_raw").agg(F.min("note_id").alias("_first"))  # a row for each cluster
    names = firsts.select("_raw", (F.row_number().over(Window.orderBy("_first")) - 1).cast("int").alias("label"))
    return raw.join(F.broadcast(names), "_raw").select("note_id", "label")
