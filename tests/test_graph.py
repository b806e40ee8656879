import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.api import MemoryGraph
from memloom.config import BuildConfig
from memloom.operators import graph, spectral, views
from memloom.operators.notes import structural_links

TEXTS = ["the scheduler drops jobs on restart", "colours of the chart legend", "move settings into one file", "spelling in the handbook", "cover the date parser with cases", "read the index once per request", "remove the old import script", "count retries in the worker log"]


def edges(spark, rows):
    return spark.createDataFrame(rows, "i long, j long, w double")


def test_sparsify_and_degree(spark):
    kept = graph.thinned(edges(spark, [(0, 0, 1.0), (0, 1, 0.3), (0, 2, 0.1), (1, 2, 0.05)]), 0.2)
    assert [tuple(r) for r in kept.collect()] == [(0, 1, 0.3)]
    assert {r["i"]: r["degree"] for r in graph.degrees(kept).collect()} == {0: 0.3, 1: 0.3}


def test_similarity_join_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    x[7] = 0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    n = np.linalg.norm(x, axis=1)
    w = np.divide(x @ x.T, np.outer(n, n), out=np.zeros((60, 60)), where=np.outer(n, n) > 0)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if w[i, j] >= 0.4}
    got = graph.similarity_join(df, "id", "v", 0.4, block=16).collect()
    assert {(r["i"], r["j"]) for r in got} == want and len(got) == len(want)
    assert all(abs(r["w"] - w[r["i"], r["j"]]) < 1e-9 for r in got)


def test_similarity_join_in_stripes(spark, monkeypatch):
    """Stripes within a block, and vectors too long for a block of the usual size, change nothing."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(50, 5)))], "id long, v array<double>")
    want = {(r["i"], r["j"]) for r in graph.similarity_join(df, "id", "v", 0.3).collect()}
    monkeypatch.setattr(graph, "STRIPE", 7)
    assert {(r["i"], r["j"]) for r in graph.similarity_join(df, "id", "v", 0.3).collect()} == want and want
    monkeypatch.setattr(graph, "BLOCK_NUMBERS", 50)
    assert {(r["i"], r["j"]) for r in graph.similarity_join(df, "id", "v", 0.3).collect()} == want


def test_fusion_applies_for_each_direction(spark):
    assert spark.range(1).select(graph.fused(F.lit(0.5), F.lit(2), 0.8, 0.2)).first()[0] == pytest.approx(0.64 * 0.5 + 0.36)
    assert spark.range(1).select(graph.fused(F.lit(0.5), F.lit(3), 1.0, 0.1)).first()[0] == pytest.approx(0.8)


@pytest.mark.parametrize("alpha", [0.8, 1.0])
def test_edges_by_symbol(spark, alpha):
    """The closed form within blocks gives the edges that the pairs of a symbol give, also with null symbols."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in rng.normal(size=4)], rng.choice(["a", "b", "c"]) if i % 4 else None) for i in range(40)]
    notes = spark.createDataFrame(rows, "note_id long, embedding array<double>, symbol_id string")
    config = BuildConfig(alpha=alpha)
    want = graph.fused_edges(notes, structural_links(notes), config).collect()
    got = {(r["i"], r["j"]): r["w"] for r in graph.symbol_edges(notes, config).collect()}
    assert got.keys() == {(r["i"], r["j"]) for r in want} and all(abs(got[r["i"], r["j"]] - r["w"]) < 1e-9 for r in want)


def blocks(spark, size=12, bridge=0.05):
    rows = [(b * size + i, b * size + j, 0.9) for b in range(3) for i in range(size) for j in range(i + 1, size)]
    nodes = spark.range(3 * size).select(F.col("id").alias("note_id"))
    return nodes, edges(spark, rows + ([(0, size, bridge), (size, 2 * size, bridge)] if bridge else []))


def test_spectrum_of_planted_blocks(spark):
    nodes, e = blocks(spark)
    values, coords = spectral.spectral_decomposition(nodes, e, 6)
    assert all(-1e-9 <= v <= 2 + 1e-9 for v in values) and list(values) == sorted(values) and abs(values[0]) < 1e-9
    assert spectral.eigengap(list(values)) == 3
    labels = {r["note_id"]: r["label"] for r in spectral.cluster(spectral.spectral_embedding(coords, 3, 36), 3).collect()}
    assert [len({labels[b * 12 + i] for i in range(12)}) for b in range(3)] == [1, 1, 1] and set(labels.values()) == {0, 1, 2}


def apart(spark, parts=3, size=40, seed=2):
    """A graph of several components with random weights: the Laplacian has as many zeros."""
    rng = np.random.default_rng(seed)
    rows = [(p * size + i, p * size + j, float(rng.uniform(0.2, 1))) for p in range(parts) for i in range(size) for j in range(i + 1, size) if rng.random() < 0.3 or j == i + 1]
    return spark.range(parts * size + 1).select(F.col("id").alias("note_id")), edges(spark, rows)  # and a node without edges


@pytest.mark.parametrize("most", [320, 40])
def test_lanczos_agrees_with_the_dense_solver(spark, monkeypatch, most):
    """Also on a disconnected graph, whose zeros repeat, and with restarts of the iteration."""
    nodes, e = apart(spark)
    values, ids, vectors = spectral.dense_eigen(nodes, e, 8)
    other, coords = spectral.lanczos_eigen(nodes, e, 8, most=most)
    assert np.abs(values - other).max() < 1e-6 and (np.abs(other) < 1e-6).sum() == 3
    rows = {r["note_id"]: r["coords"] for r in coords.collect()}
    x = np.array([rows[i] for i in ids])
    assert np.allclose(x.T @ x, np.eye(8), atol=1e-6)
    # the same spaces: of the zeros, and of all
    for k in (3, 8):
        assert np.linalg.norm(x[:, :k] @ x[:, :k].T - vectors[:, :k] @ vectors[:, :k].T) < 1e-3


def test_lanczos_of_small_graphs(spark):
    """Fewer nodes than the basis may hold, and no edges at all."""
    nodes, e = blocks(spark, size=4)
    values, _, _ = spectral.dense_eigen(nodes, e, 3)
    other, coords = spectral.lanczos_eigen(nodes, e, 3)
    assert np.allclose(values, other, atol=1e-6) and coords.count() == 12
    lone, _ = spectral.lanczos_eigen(nodes, e.limit(0), 3)
    assert np.allclose(lone, 1.0)


def test_lanczos_in_many_cells(spark, monkeypatch):
    """Blocks of nodes and cells of the matrix far smaller than the graph; a step writes its own vectors
    only, whatever the basis has, and the basis meets them without a shuffle."""
    monkeypatch.setattr(spectral, "ROWS", 16)
    monkeypatch.setattr(spectral, "CELL", 60)
    written, plans = [], []
    real, meet = spectral.bucketed, spectral._on_basis

    def bucketed(df, by, buckets, behind=None):
        kept = df.persist()
        x = next((c for c in ("q", "x") if c in df.columns), None)
        written.append(kept.agg(F.max(F.size(x))).first()[0] if x else 0)
        return real(kept, by, buckets, behind)

    def on_basis(*args):
        plans.append(meet(*args))
        return plans[-1]

    monkeypatch.setattr(spectral, "bucketed", bucketed)
    monkeypatch.setattr(spectral, "_on_basis", on_basis)
    nodes, e = apart(spark)
    cells, parts = spectral._cells(spectral.both_ways(spectral.normalized_weights(e)), 8, 4)
    assert parts.agg(F.max("parts")).first()[0] > 2 and cells.count() == 2 * e.count()
    values, _, _ = spectral.dense_eigen(nodes, e, 8)
    other, coords = spectral.lanczos_eigen(nodes, e, 8)
    assert np.abs(values - other).max() < 1e-6 and coords.count() == 121
    assert len(written) > 9 and max(written) == 16
    assert all("Exchange" not in p._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0] for p in plans)
    spectral.dropped(cells)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("memloom_")]


def test_large_graphs_are_solved_alike(spark, monkeypatch):
    nodes, e = apart(spark)
    small, _ = spectral.spectral_decomposition(nodes, e, 6)
    monkeypatch.setattr(spectral, "DENSE_NODES", 0)
    large, _ = spectral.spectral_decomposition(nodes, e, 6)
    assert np.abs(small - large).max() < 1e-6


def test_eigengap():
    assert spectral.eigengap([0.0, 0.1]) == 2 and spectral.eigengap([0, 0, 0, 0.9, 1.0]) == 3 and spectral.eigengap([1, 1, 1]) == 2


def test_config():
    for bad in ({"spectral_dims": 0}, {"adjacency_threshold": 1.5}, {"min_clusters": 0}, {"min_clusters": 5, "max_clusters": 4}):
        with pytest.raises(ValueError):
            BuildConfig(**bad)
    assert BuildConfig().merged({"spectral_dims": "4", "alpha": "9"}, max_clusters=5) == BuildConfig(spectral_dims=4, max_clusters=5)


def test_roundtrip(spark, tmp_path):
    turns = spark.createDataFrame([(i + 1, f"author{i}", t, f"synthetic-{i}", 1_700_000_000 + i) for i, t in enumerate(TEXTS)], "turn_id long, speaker string, content string, commit_id string, timestamp long")
    g = MemoryGraph(spark)
    g.ingest_turns(turns)
    assert not g.update(turns.limit(3))
    g.resolve_structural_links()
    g.build()
    first = g.retrieve("the scheduler drops jobs on restart", 5)
    assert first[0] == 1
    best = g.search("the scheduler drops jobs on restart", 5).agg(F.max("final_score")).first()[0]
    assert g.search("the scheduler drops jobs on restart", 5, best).count() and not g.search("the scheduler drops jobs on restart", 5, best + 1e-6).count()
    g.save(str(tmp_path / "graph"))
    again = MemoryGraph.load(spark, str(tmp_path / "graph"))
    assert again.notes.count() == 8 and again.clusters.count() == g.clusters.count()
    assert set(again.retrieve("the scheduler drops jobs on restart", 5)) & set(first)
    g.save(str(tmp_path / "tables"), form="parquet")
    tables = MemoryGraph.load(spark, str(tmp_path / "tables"), form="parquet")
    for name in ("notes", "clusters", "centroids", "links", "structural"):
        mine, its = (sorted(map(str, getattr(x, name).select(*sorted(getattr(g, name).columns)).collect())) for x in (g, tables))
        assert mine == its, name
    assert tables.metadata["format_version"].endswith("-v1") and tables.retrieve("the scheduler drops jobs on restart", 5) == first
    bad = spark.read.text(str(tmp_path / "graph")).select(F.replace("value", F.lit("-v1"), F.lit("-v9")).alias("value"))
    bad.write.text(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        MemoryGraph.load(spark, str(tmp_path / "bad"))


def test_neighbourhood_budget(spark):
    notes = spark.range(6).select(F.col("id").alias("note_id"))
    related = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.8), (0, 9, 1.0), (3, 0, 0.7), (4, 0, 0.95)], "src long, dst long, score double")
    links = spark.createDataFrame([(0, 5, 0.99)], "a long, b long, score double")
    nodes, e = views.neighbourhood(notes, related, links, 0, limit=3)
    assert {r["note_id"]: r["kind"] for r in nodes.collect()} == {0: "selected", 1: "outbound", 2: "outbound", 4: "inbound", 5: "long_range"}
    assert {(r["src"], r["dst"], r["kind"]) for r in e.collect()} == {(0, 1, "related_out"), (0, 2, "related_out"), (4, 0, "related_in"), (0, 5, "long_range")}


@pytest.mark.parametrize("kind", ["normal", "skewed", "equal", "few", "infinite"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(2)
    x = {"normal": rng.standard_normal(3000), "skewed": 2.0 ** -rng.integers(0, 200, 3000), "equal": np.full(3000, 7.0), "few": np.array([3.0, 1.0]), "infinite": np.concatenate([rng.standard_normal(900), [math.inf] * 200, [-math.inf] * 30])}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (math.nan,)], "v double").repartition(3)
    shares = [0.0, 0.1, 0.5, 0.77, 0.9, 1.0]
    got = views.quantiles(df, shares, bins=64, few=20)
    want = [float(np.sort(x)[0]) if s == 0 else float(np.quantile(x, s)) for s in shares] if kind != "infinite" else [float(np.sort(x)[round(s * (len(x) - 1))]) for s in shares]
    for g, w, s in zip(got, want, shares):
        assert g == w or abs(g - w) <= 1e-12 * abs(w) or kind == "infinite" and s in (0.1, 0.5, 0.77), (s, g, w)
    assert views.quantiles(df.limit(0), shares) == [None] * 6
