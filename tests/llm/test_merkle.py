import hashlib
import random
import zlib

import duckdb
import pytest

from memloom.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climbed(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([h(*at[i : i + fanout]) for i in range(0, len(at), fanout)])
    return levels


def path(levels, i, fanout):
    out = []
    for nodes in levels[:-1]:
        a = i // fanout * fanout
        out.append((nodes[a:i], nodes[i + 1 : a + fanout]))
        i //= fanout
    return out


def brute(rows, fanout=2):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], h(*map(enc, r)), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[name] = climbed([x[1] for x in groups[name]], fanout)
    top = climbed([trees[n][-1][0] for n in names], fanout)
    out = []
    for t, name in enumerate(names):
        for i, (doc_id, leaf, r) in enumerate(groups[name]):
            steps = path(trees[name], i, fanout) + path(top, t, fanout)
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and r[3] is not None:
                node = h(*map(enc, (*r[:3], r[3] + 1, r[4])))
            else:
                node = leaf
            for left, right in steps:
                node = h(*left, node, *right)
            proof = h(*[x for left, right in steps for x in left + right])
            out.append((doc_id, leaf, trees[name][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def some(rng, n):
    langs = ["en"] * 8 + ["fr", "de", None, "", "é", "zz"]
    return [(i, rng.choice(["a", "ü", None]), rng.choice(langs), rng.choice([None, 5, 17]), rng.choice([None, "", "text é\n", "x" * 5000])) for i in range(n)]


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, at string, leaf string, digest int"


@pytest.mark.parametrize("n", [1, 3, 150])
def test_report_agrees_with_brute_force(spark, n):
    rows = some(random.Random(n), n)
    if n == 150:
        rows += [(3, None, "en", None, "again"), (None, "s", "en", 1, "a"), (None, None, None, None, None), rows[4], rows[4]]
    df = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA).repartition(3)
    got = sorted([tuple(r[c] for c in COLUMNS) for r in merkle.merkle_report(df).collect()], key=repr)
    assert got == brute(rows)
    if n == 150:
        assert not all(r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("fanout,levels", [(2, 1), (3, 2)])
def test_any_fanout_and_number_of_levels_a_pass(spark, fanout, levels):
    rows = some(random.Random(9), 61)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    from pyspark.sql import functions as F

    leaf = merkle.leaf([F.col(c) for c in merkle.FIELDS])
    found = merkle.manifest(df, leaf, leaf, fanout=fanout, levels=levels)
    got = sorted((r.doc_id, r.leaf, r.subroot, r.root) for r in found.withColumn("x", merkle.folded(F.col("leaf"), F.col("path"))).where("x = root").collect())
    assert got == sorted(r[:4] for r in brute(rows, fanout))


def test_empty_table(spark, none):
    assert merkle.merkle_report(none).collect() == []


def test_sql(spark, tmp_path):
    rows = some(random.Random(4), 90)
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    got = con.execute(f"select {', '.join(COLUMNS)} from ({merkle.SQL})").fetchall()
    assert sorted(got, key=repr) == brute(rows)
