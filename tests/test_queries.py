"""Queries against their SQL, on the smallest tables."""

import math

import duckdb
import pytest

from memloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
SOME = ["t01_strip_html_comments", "t03_t07_filter_lines", "t15_split_strict", "i06_structural_links", "b04_b05_fused_edges", "b07_laplacian", "s06_rerank", "r05_centroid_boost", "r14_query", "r15_group_by_commit", "a06_hotspots", "g14_cluster_matrix", "t19_changed_symbols"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(rows, columns):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5)
        return v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([one(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_query(spark, oracle, name):
    df = registry.queries()[name](spark, DATA)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    want = oracle.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert got and got == plain(want.fetchall(), columns)
