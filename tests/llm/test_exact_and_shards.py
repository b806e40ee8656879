import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from memloom.llm import exact_dedup, feistel_shards
from memloom.llm.shared import Scratch, components


@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_dedup(docs, texts, fan_in):
    groups = defaultdict(list)
    for i, t in texts:
        groups[hashlib.sha256(re.sub(r"[ \t-\r]+", " ", t or "").encode()).hexdigest()].append(i)
    rows = exact_dedup.exact_dedup(docs, fan_in=fan_in).collect()
    assert len(rows) == len(texts)
    for h, ids in groups.items():
        mine = [r for r in rows if r["text_sha256"] == h]
        known = [i for i in ids if i is not None]
        assert len(mine) == len(ids) and {r["group_size"] for r in mine} == {len(ids)}
        assert {r["keep_id"] for r in mine} == {min(known) if known else None}
        assert sum(r["kept"] for r in mine) == 1


def test_runs_are_merged_in_order(docs):
    """Each round of the tree sorts by digest and aggregates equal neighbours."""
    plan = exact_dedup.exact_dedup(docs, fan_in=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") >= 4 and "HashAggregate" not in plan


def test_shards(spark, docs, texts):
    rows = feistel_shards.shard(docs, shards=5).collect()
    assert len(rows) == len(texts) and {r["law"] for r in rows} == {"rows"} and all(r["grown_shard"] is None for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    counts = [len(v) for v in by.values()]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    got = sorted(rows, key=lambda r: r["row_number"])
    assert [(r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got] == want
    again = feistel_shards.shard(docs.repartition(7), shards=5).collect()
    key = lambda r: (r["row_number"], r["size"], r["text_crc32"], r["place"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 4099])
def test_permutation(spark, n):
    p = feistel_shards.Permutation(n, key=3)
    rows = p.row_number(p.place(spark.range(n), "id", "p"), "p", "back").collect()
    assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["id"] == r["back"] for r in rows)


def test_empty(none):
    assert exact_dedup.exact_dedup(none).count() == 0 and feistel_shards.shard(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(200, 100), (200, 150), (150, 300), (7, 7), (500, None)]
    got = dict(components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {i: 0 for i in range(51)} | {100: 100, 150: 100, 200: 100, 300: 100}
