import __spark_entry__ as entry
import corpus_pipeline as P
from memloom.llm import decontaminate as D
from memloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for n, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(n)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(n)))
        assert docs.count() > 0
        if n < 4:
            assert docs.columns == columns
        kept[name] = docs, before
    items = [D.plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean, before = kept["benchmark"]
    gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in clean.collect()}
    assert {r["doc_id"] for r in before.collect() if any(i in D.plain(r["text"]) for i in items)} <= gone
    near, before = kept["near duplicates"]
    assert near.select("text").distinct().count() == near.count()
    shards, mixed = kept["sharding"]
    assert shards.count() == mixed.count() and {r["shard"] for r in shards.collect()} == set(range(16))


def test_registered():
    assert set(Q.QUERIES) <= set(entry.queries()) and set(Q.ORACLES) <= set(entry.oracle_sql())
    assert [n for n in Q.QUERIES if n.startswith("op")] == sorted((n for n in Q.QUERIES if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0])) and len(Q.QUERIES) == 11


def test_cases(spark, docs, none):
    for name, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0, name
    for name, stage in P.STAGES[:4]:
        assert stage(spark, docs, SF).columns == docs.columns, name
