"""Temporal scores of ages, and their blend with similarity."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.config import DAY, TemporalConfig
from memloom.functions.vec import clamp


def age(ts: Column, now: Column) -> Column:
    """Seconds since ts; nothing is younger than now."""
    return F.greatest(now - ts, F.lit(0))


def exponential(years: Column, half_life: int | None) -> Column:
    life = 14 * DAY if half_life is None else half_life
    return F.lit(0.0) if life <= 0 else F.exp(F.lit(-math.log(2)) * years / F.lit(float(life)))


def linear(years: Column, window: int | None) -> Column:
    span = 14 * DAY if window is None else window
    return F.lit(0.0) if span <= 0 else clamp(1 - years / F.lit(float(span)))


def step(years: Column, window: int | None, magnitude: float | None) -> Column:
    span = 14 * DAY if window is None else window
    height = min(1.0, max(0.0, 1.0 if magnitude is None else magnitude))
    return F.when(years <= span, F.lit(height)).otherwise(0.0)


def buckets(years: Column, steps) -> Column:
    out = None
    for most, score in steps:
        value = F.lit(min(1.0, max(0.0, float(score))))
        out = F.when(years <= most, value) if out is None else out.when(years <= most, value)
    return F.lit(0.0) if out is None else out.otherwise(0.0)


def temporal_score(ts: Column, now: Column, cfg: TemporalConfig) -> Column:
    """The score of a timestamp in [0, 1]; 0 without one."""
    years = age(ts, now).cast("double")
    if cfg.mode == "linear":
        score = linear(years, cfg.window)
    elif cfg.mode == "step":
        score = step(years, cfg.window, cfg.magnitude)
    elif cfg.mode == "buckets" and cfg.buckets is not None:
        score = buckets(years, cfg.buckets)
    else:
        score = exponential(years, cfg.half_life)
    return F.when(ts.isNull(), 0.0).otherwise(score)


def final_score(raw: Column, temporal: Column, cfg: TemporalConfig) -> Column:
    w = min(1.0, max(0.0, cfg.weight))
    return clamp(F.lit(1 - w) * clamp(raw) + F.lit(w) * temporal) if cfg.enabled else clamp(raw)
