import math

import pytest
from pyspark.sql import functions as F

from memloom.api import MemoryGraph
from memloom.config import TemporalConfig
from memloom.functions import sql, temporal, vec

NOW = 1_700_000_000


def test_scores_in_sql_are_those_of_the_column_functions(spark):
    names = sql.register(spark, "m")
    assert {"m_cosine", "m_blend", "m_keyword"} <= set(names)
    vectors = [([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([-1.0, 3.5], [1e300, 1e300]), ([math.nan, 1.0], [1.0, 1.0])]
    rows = [(a, b, ts) for a, b in vectors for ts in (None, NOW, NOW + 9, NOW - 86400, NOW - 14 * 86400, NOW - 15 * 86400)]
    df = spark.createDataFrame(rows, "a array<float>, b array<double>, ts long")
    df = df.withColumn("moment", F.lit(NOW).cast("long"))
    pairs = {
        "m_cosine(a, b)": vec.cosine(F.col("a"), F.col("b")),
        "m_blend(m_cosine(a, b), 0.5, 0.3)": temporal.final_score(vec.cosine(F.col("a"), F.col("b")), F.lit(0.5), TemporalConfig(weight=0.3)),
    }
    for mode, options in (("exponential", {}), ("exponential", {"half_life": 1000}), ("exponential", {"half_life": 0}), ("linear", {}), ("linear", {"window": 100000}), ("linear", {"window": 0}), ("step", {}), ("step", {"window": 5, "magnitude": 1.5})):
        given = "".join(f", {v}" for v in options.values())
        pairs[f"m_decay_{mode}(ts, moment{given})"] = temporal.temporal_score(F.col("ts"), F.col("moment"), TemporalConfig(mode=mode, **options))
    for text, column in pairs.items():
        for r in df.select(F.expr(text).alias("x"), column.alias("y")).collect():
            assert r["x"] == pytest.approx(r["y"], abs=1e-12), text
    with pytest.raises(ValueError):
        sql.register(spark, "m; drop")


def test_lookups_of_a_graph_in_sql(spark):
    turns = spark.createDataFrame([(i + 1, "a", f"text {i % 3}", f"c{i}", NOW + i * 100, "fn:a" if i % 2 else None) for i in range(6)], "turn_id long, speaker string, content string, commit_id string, timestamp long, symbol_id string")
    g = MemoryGraph(spark)
    g.ingest_turns(turns)
    g.links = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.75), (3, 4, 0.9)], "a long, b long, score double")
    assert "g_linked" in g.views("g")
    assert sorted(map(tuple, spark.sql("select * from g_linked(1)").collect())) == [(0, 0.5), (2, 0.75)]
    assert [r["note_id"] for r in spark.sql(f"select note_id from g_between({NOW + 100}, {NOW + 300}) order by note_id").collect()] == [1, 2, 3]
    assert spark.sql(f"select * from g_between(null, {NOW})").count() == 1
    assert [(r["note_id"], r["commit_id"]) for r in spark.sql("select * from g_history('fn:a') order by ts").collect()] == [(1, "c1"), (3, "c3"), (5, "c5")]
    assert spark.sql("select note_id from g_notes where g_norm(embedding) > 0").count() == 6
    # functions of one prefix don't change those of another
    sql.register(spark, "other")
    assert spark.sql("select g_clamp(2)").first()[0] == 1.0
