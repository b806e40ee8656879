import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.api import MemoryGraph
from memloom.config import BuildConfig
from memloom.operators import graph, metric, spectral


def clustered(rng, clusters=12, each=40, dims=10, spread=0.05):
    centers = rng.standard_normal((clusters, dims))
    return np.concatenate([c + spread * rng.standard_normal((each, dims)) for c in centers])


def table(spark, x, first=0, symbols=7):
    rows = [(first + i, [float(v) for v in row], f"s{i % symbols}" if i % 3 else None) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "note_id long, embedding array<double>, symbol_id string").repartition(3)


def brute(x, threshold, shift=None, symbols=7):
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)
    w = u @ u.T
    if shift:
        s = np.array([i % symbols if i % 3 else -1 - i for i in range(len(x))])
        w = np.where(s[:, None] == s[None, :], w * shift[0] + shift[1], w)
    return {(i, j): w[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if w[i, j] >= threshold}


def agree(got, want):
    rows = got.collect()
    assert len(rows) == len(want) and {(r.i, r.j) for r in rows} == set(want)
    assert all(abs(r.w - want[r.i, r.j]) < 1e-9 for r in rows)


@pytest.mark.parametrize("threshold", [0.95, 0.5])
def test_clustered_vectors_agree_with_brute_force_and_most_blocks_do_not_meet(spark, threshold):
    x = clustered(np.random.default_rng(1))
    x[5] = x[77] = 0.0
    df = table(spark, x)
    agree(graph.pruned_join(df, "note_id", "embedding", threshold, 20), brute(x, threshold))
    made = metric.plan(df, "note_id", "embedding", threshold, 20)
    blocks, vectors = made.compared()
    print(blocks, vectors)
    assert made.possible == 24 * 25 // 2
    if threshold == 0.95:
        assert blocks < 0.45 * made.possible and vectors < 0.45 * len(x) ** 2 / 2


@pytest.mark.parametrize("threshold", [0.3, 0.0, -1.0])
def test_uniform_vectors_agree_with_brute_force(spark, threshold):
    x = np.random.default_rng(2).standard_normal((150, 6))
    x[3] = 0.0
    agree(graph.pruned_join(table(spark, x), "note_id", "embedding", threshold, 16), brute(x, threshold))


def test_symbols_move_pairs_over_the_threshold_wherever_their_blocks_are(spark):
    x, shift = clustered(np.random.default_rng(3), each=15), graph.symbol_shift(BuildConfig())
    agree(graph.pruned_join(table(spark, x), "note_id", "embedding", 0.9, 16, "symbol_id", shift), brute(x, 0.9, shift))


def test_small_tables(spark):
    df = table(spark, np.ones((3, 4)))
    assert graph.pruned_join(df.limit(0), "note_id", "embedding", 0.5, 4).count() == 0
    assert graph.pruned_join(df, "note_id", "embedding", 0.5, 4).count() == 3
    assert graph.pruned_join(table(spark, np.zeros((3, 4))), "note_id", "embedding", 0.5, 4).count() == 0


def test_added_edges_are_those_of_a_whole_join_and_old_notes_are_not_compared(spark):
    x, c = clustered(np.random.default_rng(4), each=20), BuildConfig(adjacency_threshold=0.6)
    np.random.default_rng(0).shuffle(x)
    every = table(spark, x)
    old, fresh = every.where("note_id < 200"), every.where("note_id >= 200")
    both = graph.symbol_edges(old, c).unionByName(graph.added_edges(fresh, old, c))
    agree(both, {k: v for k, v in brute(x, 0.6, graph.symbol_shift(c)).items() if v != 0})
    made = metric.plan(fresh, "note_id", "embedding", 0.6, 16, known=old)
    blocks = {r.block for r in made.rows.join(fresh.select(F.col("note_id").alias("id")), "id").select("block").distinct().collect()}
    assert blocks and all(r.p in blocks or r.q in blocks for r in made.pairs.collect())
    assert made.compared()[1] <= 40 * 39 / 2 + 40 * 200


def test_eigenvectors_go_on_from_those_of_the_graph_before(spark):
    x = clustered(np.random.default_rng(5), clusters=6, each=25, spread=0.6)
    np.random.default_rng(1).shuffle(x)
    every, c = table(spark, x), BuildConfig(adjacency_threshold=0.1)
    old = every.where("note_id < 140")
    _, coords = spectral.lanczos_eigen(old.select("note_id"), graph.symbol_edges(old, c), 4)
    edges = graph.symbol_edges(every, c)
    nodes = every.select("note_id")
    want, _, _ = spectral.dense_eigen(nodes, edges, 4)
    steps = {"anew": [], "on": []}
    cold, _ = spectral.lanczos_eigen(nodes, edges, 4, progress=lambda s, r: steps["anew"].append(r))
    warm, found = spectral.lanczos_eigen(nodes, edges, 4, known=coords, progress=lambda s, r: steps["on"].append(r))
    assert np.allclose(warm, want, atol=1e-6) and np.allclose(cold, want, atol=1e-6)
    assert steps["on"][0] < steps["anew"][0] / 2 and len(steps["on"]) <= len(steps["anew"]), steps
    assert found.count() == 150


def test_incremental_builds_equal_whole_builds(spark, tmp_path):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(12)]
    turns = [(i + 1, "u", " ".join(rng.choice(words, 4)), f"c{i}", 1_700_000_000 + i, f"k:{i % 5}" if i % 2 else None) for i in range(30)]
    schema = "turn_id long, speaker string, content string, commit_id string, timestamp long, symbol_id string"
    whole = MemoryGraph(spark)
    whole.ingest_turns(spark.createDataFrame(turns, schema))
    whole.resolve_structural_links()
    whole.build()
    first = MemoryGraph(spark)
    first.ingest_turns(spark.createDataFrame(turns[:22], schema))
    first.resolve_structural_links()
    first.build()
    first.save(str(tmp_path / "g"), "parquet")
    again = MemoryGraph.load(spark, str(tmp_path / "g"), form="parquet")
    assert again.update(spark.createDataFrame(turns, schema))
    again.resolve_structural_links()
    again.build(incremental=True)
    edges = [{(r.i, r.j): round(r.w, 9) for r in g.edges.collect()} for g in (whole, again)]
    assert edges[0] == edges[1] and len(edges[0]) > 10
    assert np.allclose(whole.eigenvalues, again.eigenvalues, atol=1e-6)
    assert whole.clusters.exceptAll(again.clusters).isEmpty()
