import numpy as np
import pytest

from memloom.api import MemoryGraph
from memloom.operators.latent import LatentEmbedder, LatentModel, lanczos, vocabulary


def planted(rng, topics=6, texts=40, words=18, own=60):
    """Texts of topics: each draws a few of its topic's many words, so that two seldom share one, and common words."""
    rows = []
    for t in range(topics):
        for i in range(texts):
            body = [f"t{t}w{rng.integers(own)}" for _ in range(words)] + [f"common{rng.integers(30)}" for _ in range(6)]
            rng.shuffle(body)
            rows.append((t * texts + i, " ".join(body), t))
    return rows


def weighted(rows, model):
    """The matrix, by the definition."""
    from collections import Counter

    at = {t: i for i, t in enumerate(model.terms)}
    out = np.zeros((len(rows), len(at)))
    for r, row in enumerate(rows):
        for w, n in Counter(w for w in (row[1] or "").lower().split() if w in at).items():
            out[r, at[w]] = (1 + np.log(n)) * model.idf[at[w]]
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def test_lanczos_gives_eigenpairs_repeated_ones_included():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((90, 90)))
    spectrum = np.concatenate([[5.0, 3.0, 3.0, 3.0, 2.0], np.linspace(1.5, 0.0, 85)])
    a = q @ np.diag(spectrum) @ q.T
    values, vectors = lanczos(lambda x: a @ x, 90, 8, spare=3, most=33, tolerance=1e-10)
    assert np.allclose(values, spectrum[:8], atol=1e-8) and np.allclose(a @ vectors, vectors * values, atol=1e-6)


def test_values_agree_with_a_dense_solution_and_saved_models_are_the_same(spark, tmp_path):
    rows = planted(np.random.default_rng(1), topics=4, texts=15)
    df = spark.createDataFrame([*rows, (900, None, 0), (901, "", 0), (902, "unseen", 0)], "id long, text string, topic int").repartition(3)
    model = LatentModel.fit(df, "text", dims=6, tolerance=1e-11)
    dense = weighted(rows, model)
    assert np.allclose(model.values, np.linalg.svd(dense, compute_uv=False)[:6], atol=1e-8)
    got = {r.id: np.array(r.v) for r in LatentEmbedder(model).embed(df, "text", "v").collect()}
    want = dense @ model.vectors
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose([got[r[0]] for r in rows], want, atol=1e-5)
    assert not any(got[i].any() for i in (900, 901, 902))
    model.save(spark, str(tmp_path / "m"))
    again = LatentModel.load(spark, str(tmp_path / "m"))
    assert again.terms == model.terms and np.array_equal(again.vectors, model.vectors) and np.array_equal(again.values, model.values)


def test_vocabulary_counts_texts(spark):
    df = spark.createDataFrame([("a b b",), ("B, c",), ("a b",), (None,)], "text string")
    got = [(r.term, r.texts, round(r.idf, 6)) for r in vocabulary(df, "text", 2).collect()]
    assert got == [("b", 3, round(np.log(5 / 4) + 1, 6)), ("a", 2, round(np.log(5 / 3) + 1, 6))]
    empty = LatentModel.fit(df.limit(0), "text", dims=3)
    assert [list(r.v) for r in LatentEmbedder(empty).embed(df, "text", "v").collect()] == [[0, 0, 0]] * 4


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_topics_are_found_by_texts_that_share_no_words(spark, seed):
    rng = np.random.default_rng(seed)
    rows = planted(rng)
    df = spark.createDataFrame(rows, "id long, text string, topic int")
    embedder = LatentEmbedder(LatentModel.fit(df, "text", dims=6))
    vectors = {r.id: np.array(r.v) for r in embedder.embed(df, "text", "v").collect()}
    topic = {r[0]: r[2] for r in rows}
    words = {r[0]: {w for w in r[1].split() if not w.startswith("common")} for r in rows}
    queries = planted(rng, texts=3, words=5)  # new texts, folded in
    asked = embedder.embed(spark.createDataFrame(queries, "id long, text string, topic int"), "text", "v").collect()
    hits = total = apart = 0
    for q in asked:
        best = sorted(vectors, key=lambda i: -float(vectors[i] @ np.array(q.v)))[:20]
        hits += sum(topic[i] == q.topic for i in best)
        apart += sum(not (words[i] & set(q.text.split())) for i in best)
        total += len(best)
    assert hits / total >= 0.9 and apart / total >= 0.1


def test_graph_with_a_learned_embedder_answers_texts_it_has_not_seen(spark):
    rng = np.random.default_rng(4)
    rows = planted(rng, topics=3, texts=12)
    turns = spark.createDataFrame([(i, "u", t, f"c{i}", 1_700_000_000 + i) for i, t, _ in rows], "turn_id long, speaker string, content string, commit_id string, timestamp long")
    graph = MemoryGraph(spark, LatentEmbedder(LatentModel.fit(turns, "content", dims=3)))
    graph.ingest_turns(turns)
    question = planted(rng, topics=3, texts=1, words=6)[1]
    topic = {i: t for i, _, t in rows}
    found = [r["note_id"] for r in graph.search(question[1], 10).collect()]
    assert sum(topic[i] == question[2] for i in found) >= 9
