import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memloom.llm import decontaminate as D
from memloom.llm import mixing as M
from memloom.llm import queries as Q


def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab c", min_size=1, max_size=70), st.text(alphabet="ab c", max_size=90))
def test_myers(pattern, text):
    assert D.myers(D.pattern_bits(pattern), len(pattern), text)[0] == least_distance(pattern, text)


def test_edited_items_are_found():
    rng = random.Random(5)
    letters = "abcdefghijklmnop "
    items = [(n, "".join(rng.choice(letters) for _ in range(rng.randrange(60, 200)))) for n in range(12)]
    matcher = D.Matcher(items)
    for _ in range(60):
        n, item = rng.choice(items)
        form = D.plain(item)
        k = D.budget(len(form))
        s = list(form)
        for _ in range(rng.randrange(0, k + 3)):
            at = rng.randrange(len(s))
            edit = rng.randrange(3)
            s[at : at + (edit > 0)] = [] if edit == 1 else [rng.choice(letters)]
        text = "".join(rng.choice(letters) for _ in range(150)) + " " + "".join(s) + " " + "".join(rng.choice(letters) for _ in range(150))
        least = least_distance(form, D.plain(text))
        got = {i: d for i, d, _, _ in matcher.find(text)}
        assert got.get(n) == (least if least <= k else None)


def test_documents(spark, docs, none):
    rows = docs.where("doc_id = 110").first()["text"]
    passage = rows.split("\n")[2][:300]
    bench = spark.createDataFrame([(1, passage.upper() + "!"), (2, None), (3, ""), (4, "..."), (None, passage[:120].replace(" ", ", ", 1)), (6, "no such words anywhere in these documents at all")], "item_id long, text string")
    found = D.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(110 + i, n) for i in range(4) for n in (1, None)} and {r["distance"] for r in found} == {0}
    clean = D.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 4 and clean.where("doc_id is null").count() == 2
    assert D.contaminated(none, bench).count() == 0 and D.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_query_against_brute_force(spark):
    """All pairs of items and texts by a plain edit distance, with the items in one automaton or in several."""
    rng = random.Random(9)
    make = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    items = [(n, make(rng.randrange(5, 16))) for n in range(12)] + [(20, "short one"), (21, None)]
    texts = []
    for i in range(60):
        n = rng.randrange(12)
        s = list(items[n][1])
        for _ in range(rng.randrange(0, 8)):
            s[rng.randrange(len(s))] = rng.choice("abcxyz")
        texts.append((i, f"{make(10)}. {''.join(s)}, {make(10)}" + (" Short; ONE" if i % 7 == 0 else "")))
    texts += [(97, None), (98, ""), (5, texts[5][1])]
    want = set()
    for n, item in items:
        form = D.plain(item or "")
        for i, text in texts:
            if form and (d := least_distance(form, D.plain(text or ""))) <= D.budget(len(form)):
                want.add((i, n, d))
    df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == want and len(want) > 20
    blocks = list(D.passes(bench, "item_id", "text", chars=200))
    assert len(blocks) > 2 and [i for b in blocks for i in b] == sorted(items)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in texts], "_text": [t for _, t in texts]})]
    several = next(D._matches(blocks, D.RATE, "found")(iter(batches))).to_pylist()
    assert {(r["doc_id"], m["item_id"], m["distance"]) for r in several for m in r["found"]} == want


def test_too_large_a_benchmark_is_refused(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEM_CHARS", 10)
    df = spark.createDataFrame([(1, "some words, more than ten characters")], "item_id long, text string")
    with pytest.raises(ValueError, match="match them in parts"):
        D.contaminated(df.withColumnRenamed("item_id", "doc_id"), df)


def test_targets():
    assert M.targets({"a": 100, "b": 100, "c": 100}) == {"a": 187.5, "b": 75.0, "c": 37.5}
    got = M.targets({"a": 10, "b": 100, None: 100})
    assert got["a"] == 30 and sum(got.values()) == pytest.approx(210) and got["b"] == pytest.approx(120) and M.targets({}) == {}
    assert M.targets({"a": 0, "b": 5}) == {"a": 0.0, "b": 5.0}


def cheapest(supplies, quotas, repeats=3):
    """The least cost of serving all quotas that can be served, by trying all takings of small instances."""
    import itertools

    best = None
    names = list(supplies)
    for takes in itertools.product(*[range(repeats * supplies[p] + 1) for p in names]):
        # whether these takings fill quotas as far as any: a small matching by words
        words = [p for p, n in zip(names, takes) for _ in range(n)]
        slots = [s for s, n in quotas.items() for _ in range(n)]
        match = {}

        def give(i, seen):
            for j, s in enumerate(slots):
                if s in words[i] and j not in seen:
                    seen.add(j)
                    if j not in match or give(match[j], seen):
                        match[j] = i
                        return True
            return False

        if all(give(i, set()) for i in range(len(words))):
            cost = sum(max(0, n - r * supplies[p]) for p, n in zip(names, takes) for r in range(1, repeats))
            if best is None or (-len(words), cost) < best:
                best = (-len(words), cost)
    return best


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.sampled_from([("a",), ("b",), ("a", "b"), ("b", "c")]), st.integers(0, 2), min_size=1, max_size=3), st.dictionaries(st.sampled_from("abc"), st.integers(0, 4), min_size=1, max_size=3))
def test_flow_is_cheapest(supplies, quotas):
    flow = M.min_cost_flow(supplies, quotas)
    used = {p: sum(v for (q, _), v in flow.items() if q == p) for p in supplies}
    assert all(v > 0 and s in p for (p, s), v in flow.items()) and all(used[p] <= 3 * supplies[p] for p in supplies)
    assert all(sum(v for (_, t), v in flow.items() if t == s) <= quotas[s] for s in quotas)
    cost = sum(max(0, used[p] - r * supplies[p]) for p in supplies for r in (1, 2))
    assert (-sum(used.values()), cost) == cheapest(supplies, quotas)


def test_mix(spark, docs, texts, none):
    rows = M.mix_sources(docs).collect()
    assert len(rows) == len(texts) and all(r["taken"] == r["size"] * r["times"] and r["times"] <= 3 for r in rows)
    sized = docs.select("doc_id", "source", M.words(F.col("text")).alias("size")).collect()
    total = sum(r["size"] for r in sized)
    assert total == sum(len((t or "").split()) for _, t in texts)
    assert sorted(map(tuple, M.mix_sources(docs.repartition(5)).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert M.mix_sources(none).count() == 0


def test_overlapping_sources(spark):
    rng = random.Random(8)
    rows = [(i, sorted(rng.sample("abc", rng.randrange(1, 4))), rng.randrange(1, 20)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, members array<string>, words long")
    mixed, sizes, goal = M.mix(df, "members", "words", "id")
    got = mixed.collect()
    assert len(got) == 400 and mixed.columns == ["id", "members", "words", "times"]
    taken = sum(r["words"] * r["times"] for r in got)
    assert abs(taken - min(sum(goal.values()), 3 * sum(r[2] for r in rows))) <= 7 * 20
    with pytest.raises(ValueError, match="7 membership patterns"):
        M.mix(df, "members", "words", "id", max_patterns=2)


def test_targets_are_met(spark):
    """Of the query's rows, every source's taken words are within half of its largest document of its target."""
    out = Q.op6_mix_sources(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in out.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("largest"), F.sum("size").alias("size"), F.first("source_size").alias("source_size")).collect():
        assert abs(r["taken"] - r["target"]) <= r["largest"] / 2 + 1 and r["size"] == r["source_size"]


def test_many_patterns():
    """Thousands of patterns: what can be served is, and words flow to their own sources only."""
    rng = random.Random(4)
    names = [f"s{i}" for i in range(30)]
    supplies = {tuple(sorted(rng.sample(names, rng.randrange(1, 5)))): rng.randrange(1, 1000) for _ in range(5000)}
    sizes = {s: sum(w for p, w in supplies.items() if s in p) for s in names}
    quotas = {s: int(t) for s, t in M.targets(sizes).items()}
    flow = M.min_cost_flow(supplies, quotas)
    used = {p: sum(flow.get((p, s), 0) for s in p) for p in supplies}
    assert all(s in p and v > 0 for (p, s), v in flow.items()) and all(used[p] <= 3 * w for p, w in supplies.items())
    assert all(sum(v for (_, t), v in flow.items() if t == s) <= q for s, q in quotas.items())
    # what isn't served can't be: all words of the patterns of a source in need are used up three times
    short = {s for s, q in quotas.items() if sum(v for (_, t), v in flow.items() if t == s) < q}
    assert all(used[p] == 3 * w for p, w in supplies.items() if short & set(p))
