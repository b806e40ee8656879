import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import langid_crf
from memloom.llm import queries as Q

EN = "the and of that with from this have which there would their what about when people could other".split()
FR = "le les des dans pour avec vous cette mais tout nous comme fait être leur aussi bien sans".split()


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    k, lengths = 3, np.array([5, 4, 1])
    scores, t, start = rng.normal(size=(5, 3, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    gamma, log_z, pairs = langid_crf.forward_backward(scores, lengths, t, start)
    want_pairs = np.zeros((k, k))
    for c, n in enumerate(lengths):
        total, marginal, moves = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=int(n)):
            w = np.exp(start[path[0]] + sum(scores[s, c, y] for s, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
            total += w
            for s, y in enumerate(path):
                marginal[s, y] += w
            for a, b in zip(path, path[1:]):
                moves[a, b] += w
        want_pairs += moves / total
        assert np.allclose(gamma[:n, c], marginal / total) and log_z[c] == pytest.approx(np.log(total))
    assert np.allclose(pairs, want_pairs)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(80):
        pool, label = ((EN, "en"), (FR, "fr"))[i // 2 % 2]
        texts.append(" ".join(rng.choice(pool) for _ in range(60)))
        labels.append(label)
    return langid_crf.train(texts, labels)


def test_switched_text(spark, model):
    rng = random.Random(4)
    text = " ".join([rng.choice(EN) for _ in range(20)] + [rng.choice(FR) for _ in range(15)] + [rng.choice(EN) for _ in range(90)])
    df = spark.createDataFrame([(1, text), (2, None), (3, "12 !")], "doc_id long, text string")
    spans = {r["doc_id"]: r["_spans"] for r in langid_crf.label_spans(df, model, ["doc_id"]).collect()}
    assert [(s["lang"], s["first_word"], s["n_words"]) for s in spans[1]] == [("en", 0, 20), ("fr", 20, 15), ("en", 35, 90)]
    assert spans[2] == [] and spans[3] == []


def test_words_are_letters(spark, model):
    assert langid_crf.words_of("² ½ Ⅳ 12 _ \u0301") == [] and langid_crf.words_of("x² aⅣb Straße_3d") == ["x", "a", "b", "straße", "d"]
    df = spark.createDataFrame([(1, "² ½ Ⅳ 12"), (2, "² the of")], "doc_id long, text string")
    got = {r["doc_id"]: (r["_lang"], r["_score"]) for r in langid_crf.predict(df, model, ["doc_id"]).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] == "en"


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid_crf, "SAMPLE_ALL", 6)
    rows = [(i, f"text {i}", f"l{i % 9}" if i % 10 else "und") for i in range(200)]
    texts, labels = langid_crf.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert labels == ["l0", "l1", "l2", "l3", "l4", "l5"]
    monkeypatch.setattr(langid_crf, "SAMPLE_ALL", 30)
    texts, labels = langid_crf.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert len(labels) == 27 and set(labels) == {f"l{i}" for i in range(9)}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = Q.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r["lang_pred"] == r["lang"] for r in rows if r["held_out"]]
    assert len(rows) == 1000 and len(held) > 250 and sum(held) / len(held) > 0.97


def test_every_language_fills_the_sample(spark, monkeypatch):
    """Where all languages have more documents than the sample takes, they alternate in it; each still gets a lexicon and chains."""
    monkeypatch.setattr(langid_crf, "SAMPLE_DOCS", 40)
    rng = random.Random(5)
    pools = {"en": EN, "fr": FR, "xx": [w[::-1] + "o" for w in EN], "yy": [w[::-1] + "u" for w in FR]}
    rows = [(i * 4 + j, " ".join(rng.choice(pool) for _ in range(60)), lang) for i in range(90) for j, (lang, pool) in enumerate(pools.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, labels = langid_crf.sample(df.where(~langid_crf.held_out("doc_id")), "doc_id", "text", "lang")
    assert labels == sorted(pools) * 40
    model = langid_crf.train(texts, labels)
    assert {(n - 1) // (len(langid_crf._RATES) + 1) for n in model.lexicon.values()} == {0, 1, 2, 3}
    truth = {i: lang for i, _, lang in rows}
    held = [(truth[r["doc_id"]], r["lang_pred"]) for r in langid_crf.identify(df).collect() if r["held_out"]]
    for lang in pools:
        mine = [got == lang for want, got in held if want == lang]
        assert len(mine) > 20 and sum(mine) / len(mine) > 0.97, lang


def test_cases(spark, docs, none):
    rows = langid_crf.identify(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (130, 131, 132, 135)) and by[120]["lang_pred"] in ("en", "fr")
    assert langid_crf.identify(none).count() == 0
    unlabelled = langid_crf.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlabelled} == {("und", 0.0)}
