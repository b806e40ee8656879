import pytest
from pyspark.sql import functions as F

from memloom.config import DAY, TemporalConfig, clamp_top_k, days_to_seconds, parse_temporal_mode
from memloom.functions.temporal import temporal_score
from memloom.operators.retrieve import ranked, rerank

NOW = 1_767_225_600


def score(spark, age, **config):
    df = spark.createDataFrame([(None if age is None else NOW - age,)], "ts long")
    return df.select(temporal_score(F.col("ts"), F.lit(NOW).cast("long"), TemporalConfig(**config))).first()[0]


@pytest.mark.parametrize(
    "age, config, expected",
    [
        (10, {"half_life": 10}, 0.5),
        (50, {"mode": "linear", "window": 100}, 0.5),
        (1800, {"mode": "step", "window": 3600, "magnitude": 0.8}, 0.8),
        (7200, {"mode": "step", "window": 3600, "magnitude": 0.8}, 0.0),
        (3600, {"mode": "buckets", "buckets": [(DAY, 1.0), (7 * DAY, 0.6), (30 * DAY, 0.3)]}, 1.0),
        (3 * DAY, {"mode": "buckets", "buckets": [(DAY, 1.0), (7 * DAY, 0.6), (30 * DAY, 0.3)]}, 0.6),
        (100 * DAY, {"mode": "buckets", "buckets": [(DAY, 1.0), (7 * DAY, 0.6), (30 * DAY, 0.3)]}, 0.0),
        (None, {}, 0.0),
        (-5, {}, 1.0),
        (5, {"half_life": 0}, 0.0),
        (5, {"mode": "linear", "window": 0}, 0.0),
    ],
)
def test_scores(spark, age, config, expected):
    assert score(spark, age, **config) == pytest.approx(expected)


def rows(spark, raws, ages):
    return spark.createDataFrame([(i, i, r, NOW - a, 0) for i, (r, a) in enumerate(zip(raws, ages))], "turn_id long, note_id long, raw_score double, timestamp long, pos int")


def test_old_best_is_demoted(spark):
    out = ranked(rerank(rows(spark, [0.9, 0.85, 0.8], [60 * DAY, 2 * DAY, DAY]), TemporalConfig(weight=0.3), NOW)).collect()
    assert out[0]["note_id"] != 0
    finals = [r["final_score"] for r in out]
    assert finals == sorted(finals, reverse=True)


def test_disabled(spark):
    out = ranked(rerank(rows(spark, [0.7, 0.9], [0, 90 * DAY]), TemporalConfig(enabled=False), NOW)).collect()
    assert [r["final_score"] for r in out] == [0.9, 0.7]


def test_settings():
    assert days_to_seconds(0) == 1 and days_to_seconds(1.5) == 129_600
    assert parse_temporal_mode("LinearWindow") == "linear" and parse_temporal_mode("?") == "exponential"
    assert clamp_top_k(None, 5, 20) == 5 and clamp_top_k(0, 5, 20) == 1 and clamp_top_k(99, 5, 20) == 20
    with pytest.raises(ValueError):
        TemporalConfig(mode="never")
