"""The engine's scores and lookups as SQL functions.

All are SQL themselves, so a query that uses them is one plan without Python.  Those of
``SCALARS`` need no tables; those of ``TABLES`` read the views of a graph (``MemoryGraph.views``).
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from memloom.config import DAY

#: name and signature, type, body; {p} is the prefix of functions and views.
SCALARS = [
    ("dot(a array<double>, b array<double>)", "double", "aggregate(zip_with(a, b, (x, y) -> x * y), 0d, (s, x) -> s + x)"),
    ("norm(a array<double>)", "double", "sqrt({p}_dot(a, a))"),
    # 0 where a norm is 0 or the result is no number
    ("cosine(a array<double>, b array<double>)", "double", "case when {p}_norm(a) = 0 or {p}_norm(b) = 0 then 0d else nanvl({p}_dot(a, b) / ({p}_norm(a) * {p}_norm(b)), 0d) end"),
    ("clamp(x double)", "double", "greatest(0d, least(1d, x))"),
    # ages in seconds; nothing is younger than now
    ("age(ts bigint, moment bigint)", "double", "double(greatest(moment - ts, 0))"),
    (f"decay_exponential(ts bigint, moment bigint, half_life bigint default {14 * DAY})", "double", "case when ts is null or half_life <= 0 then 0d else exp(-ln(2) * {p}_age(ts, moment) / half_life) end"),
    (f"decay_linear(ts bigint, moment bigint, span bigint default {14 * DAY})", "double", "case when ts is null or span <= 0 then 0d else {p}_clamp(1 - {p}_age(ts, moment) / span) end"),
    (f"decay_step(ts bigint, moment bigint, span bigint default {14 * DAY}, height double default 1)", "double", "case when ts is not null and {p}_age(ts, moment) <= span then {p}_clamp(height) else 0d end"),
    ("blend(raw double, recency double, weight double default 0.2)", "double", "{p}_clamp((1 - {p}_clamp(weight)) * {p}_clamp(raw) + {p}_clamp(weight) * recency)"),
    # a score raised where the question stands in symbol or path
    ("keyword(score double, question string, symbol string, path string, weight double default 0.3)", "double",
     "score * (1 + weight * int(coalesce(contains(lower(symbol), lower(question)), false)) + weight * int(coalesce(contains(lower(path), lower(question)), false)))"),
]

TABLES = [
    # notes whose sources' time span meets the range; an open end is null
    ("between(first bigint, last bigint)", "note_id bigint, raw_content string, first_ts bigint, last_ts bigint",
     "select note_id, raw_content, array_min(sources.ts), array_max(sources.ts) from {p}_notes where (first is null or array_max(sources.ts) >= first) and (last is null or array_min(sources.ts) <= last)"),
    ("linked(note bigint)", "note_id bigint, score double",
     "select other, max(score) from (select a, b as other, score from {p}_links union all select b, a, score from {p}_links) where a = note group by other"),
    # the sources of a symbol's notes
    ("history(symbol string)", "note_id bigint, turn_id bigint, commit_id string, ts bigint",
     "select note_id, s.turn_id, s.commit_id, s.ts from {p}_notes lateral view explode(sources) t as s where symbol_id = symbol"),
]


def register(spark: SparkSession, prefix: str = "memory", tables: bool = False) -> list[str]:
    """Makes the functions of the session, replacing those of the same prefix; returns their names."""
    if not re.fullmatch(r"[A-Za-z_]\w*", prefix):
        raise ValueError(f"{prefix!r} is no prefix of names")
    every = [(s, t, f"return {body}") for s, t, body in SCALARS] + ([(s, f"table({t})", f"return {body}") for s, t, body in TABLES] if tables else [])
    for signature, type_, body in every:
        spark.sql(f"create or replace temporary function {prefix}_{signature} returns {type_} {body.format(p=prefix)}")
    return [f"{prefix}_{s.split('(')[0]}" for s, *_ in every]
