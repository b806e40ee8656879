"""Ranked retrieval: similarity scan, boosts, filters, top-k, time-aware re-ranking, presentation rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.config import TemporalConfig
from memloom.functions import temporal, vec
from memloom.functions import text as X

CLUSTER_BOOST, BOOSTED_CLUSTERS = 1.2, 3
KEYWORD_WEIGHT = 0.3
MIN_SCORE = 0.6


def _contains(column: str, wanted: str) -> Column:
    return F.coalesce(F.lower(column).contains(wanted.lower()), F.lit(False)).cast("int")


def scored_notes(
    notes: DataFrame,
    query_vector: Sequence[float],
    query: str = "",
    file_filter: str | None = None,
    symbol_filter: str | None = None,
    keyword_weight: float = 0.0,
) -> DataFrame:
    """All notes with ``score``: cosine to the query, raised where the whole query string occurs in
    symbol or path, and set to 0 (not removed) where a filter does not hold."""
    q = vec.vector(query_vector)
    length = sum(float(x) ** 2 for x in query_vector) ** 0.5
    score = vec.cosine(F.col("embedding"), q, F.col("norm").cast("double"), F.lit(length))
    if keyword_weight > 0:
        score = score * (1 + keyword_weight * _contains("symbol_id", query) + keyword_weight * _contains("file_path", query))
    for column, wanted in (("file_path", file_filter), ("symbol_id", symbol_filter)):
        if wanted is not None:
            score = F.when(F.coalesce(column, F.lit("")).contains(wanted), score).otherwise(0.0)
    return notes.withColumn("score", score)


def top_clusters(centroids: DataFrame, query_vector: Sequence[float], k: int = BOOSTED_CLUSTERS) -> DataFrame:
    """(label) of the clusters nearest to the query."""
    length = sum(float(x) ** 2 for x in query_vector) ** 0.5
    sim = vec.cosine(F.col("centroid"), vec.vector(query_vector), F.col("norm").cast("double"), F.lit(length))
    return centroids.select("label", sim.alias("sim")).orderBy(F.col("sim").desc(), "label").limit(k).select("label")


def cluster_boosted(scored: DataFrame, clusters: DataFrame, centroids: DataFrame, query_vector: Sequence[float]) -> DataFrame:
    """Scores of notes in the nearest clusters times 1.2."""
    best = top_clusters(centroids, query_vector).withColumn("_top", F.lit(True))
    labelled = scored.join(clusters.select(F.col("note_id").alias("_n"), "label"), F.col("note_id") == F.col("_n"), "left").drop("_n")
    joined = labelled.join(F.broadcast(best), "label", "left")  # three rows
    return joined.withColumn("score", F.when(F.col("_top"), F.col("score") * CLUSTER_BOOST).otherwise(F.col("score"))).drop("_top", "label")


def top_notes(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.col("score").desc(), "note_id").limit(k)


def candidates(top: DataFrame) -> DataFrame:
    """A row for each source turn of the notes: (turn_id, note_id, raw_score, timestamp, pos)."""
    rows = top.select("note_id", F.col("score").alias("raw_score"), F.posexplode("sources").alias("pos", "s"))
    return rows.select(F.col("s.turn_id").alias("turn_id"), "note_id", "raw_score", F.col("s.ts").alias("timestamp"), "pos", F.col("s.commit_id").alias("commit_id"))


def retrieve_candidates(
    notes: DataFrame,
    query_vector: Sequence[float],
    k: int,
    query: str = "",
    clusters: DataFrame | None = None,
    centroids: DataFrame | None = None,
    **filters,
) -> DataFrame:
    scored = scored_notes(notes, query_vector, query, **filters)
    if clusters is not None and centroids is not None:
        scored = cluster_boosted(scored, clusters, centroids, query_vector)
    return candidates(top_notes(scored, k))


def rerank(cands: DataFrame, cfg: TemporalConfig, now: int | None = None) -> DataFrame:
    """Candidates with ``temporal_score`` and ``final_score``."""
    at = now if now is not None else cfg.now
    moment = F.unix_timestamp(F.current_timestamp()) if at is None else F.lit(at).cast("long")
    score = temporal.temporal_score(F.col("timestamp"), moment, cfg) if cfg.enabled else F.lit(0.0)
    return cands.withColumn("temporal_score", score).withColumn("final_score", temporal.final_score(F.col("raw_score"), F.col("temporal_score"), cfg))


def ranked(df: DataFrame) -> DataFrame:
    """In the order in which a stable sort by final score leaves candidates."""
    return df.orderBy(F.col("final_score").desc(), F.col("raw_score").desc(), "note_id", "pos")


def retrieve_with_scores(notes: DataFrame, query_vector: Sequence[float], top_k: int, query: str = "", cfg: TemporalConfig | None = None, truncate: bool = False, keyword_weight: float = KEYWORD_WEIGHT, **options) -> DataFrame:
    """Re-ranked candidates of four times top_k notes, all of them unless truncated."""
    out = ranked(rerank(retrieve_candidates(notes, query_vector, top_k * 4, query, keyword_weight=keyword_weight, **options), cfg or TemporalConfig()))
    return out.limit(top_k) if truncate else out


def in_time_range(notes: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Notes whose sources' time span meets the range; without timestamps none."""
    first, last = F.array_min("sources.ts"), F.array_max("sources.ts")
    out = notes
    if start is not None:
        out = out.where(last >= start)
    if end is not None:
        out = out.where(first <= end)
    return out


def retrieve_in_time_range(notes: DataFrame, query_vector: Sequence[float], top_k: int, start: int | None = None, end: int | None = None, query: str = "", cfg: TemporalConfig | None = None, keyword_weight: float = KEYWORD_WEIGHT, **options) -> DataFrame:
    """As retrieve_with_scores, over notes of a time range only; then candidates are top_k notes."""
    if start is None and end is None:
        return retrieve_with_scores(notes, query_vector, top_k, query, cfg, keyword_weight=keyword_weight, **options)
    kept = in_time_range(notes, start, end)
    return ranked(rerank(retrieve_candidates(kept, query_vector, top_k, query, keyword_weight=keyword_weight, **options), cfg or TemporalConfig()))


def search(notes: DataFrame, query_vector: Sequence[float], top_k: int, query: str = "", min_score: float = 0.0, cfg: TemporalConfig | None = None, **options) -> DataFrame:
    """(score, note_id) of candidates from min_score on."""
    found = retrieve_with_scores(notes, query_vector, top_k, query, cfg, **options)
    return found.where(F.col("final_score") >= min_score)


def query(
    notes: DataFrame,
    query_vector: Sequence[float],
    text: str,
    top_k: int = 5,
    candidate_k: int | None = None,
    min_score: float = MIN_SCORE,
    cfg: TemporalConfig | None = None,
    keyword_weight: float = KEYWORD_WEIGHT,
    **options,
) -> DataFrame:
    """The command line's query: candidates of five times top_k notes, re-ranked, from min_score on, the first top_k."""
    found = retrieve_candidates(notes, query_vector, candidate_k or top_k * 5, text, keyword_weight=keyword_weight, **options)
    return ranked(rerank(found, cfg or TemporalConfig()).where(F.col("final_score") >= min_score)).limit(top_k)


def with_rank(results: DataFrame) -> DataFrame:
    """Ranked results, of which there are top_k at most, with their rank from 1."""
    order = Window.orderBy(F.col("final_score").desc(), F.col("raw_score").desc(), "note_id", "pos")
    return results.withColumn("rank", F.row_number().over(order))


def group_by_commit(results: DataFrame) -> DataFrame:
    """Ranked results (with rank): a row for each first hit of a commit, later hits nested in
    ``contextual_hits``; hits without commit come behind all others, each for itself."""
    key = F.coalesce("commit_id", F.concat(F.lit("\u0000"), F.col("rank").cast("string")))
    keyed = results.withColumn("_key", key)
    hit = F.struct("rank", "note_id", "turn_id", "final_score")
    grouped = keyed.groupBy("_key").agg(F.array_sort(F.collect_list(hit)).alias("hits"), F.first("commit_id").alias("commit_id"))
    out = grouped.select("commit_id", F.get("hits", F.lit(0)).alias("first"), F.slice("hits", F.lit(2), F.size("hits")).alias("contextual_hits"))
    rows = out.select("commit_id", "first.*", "contextual_hits")
    position = F.row_number().over(Window.orderBy(F.col("commit_id").isNull(), "rank"))
    return rows.withColumn("position", position)


def enriched(results: DataFrame, notes: DataFrame, clusters: DataFrame, links: DataFrame, links_k: int = 5) -> DataFrame:
    """Results with their note's context, cluster label and best related notes."""
    texts = notes.select("note_id", X.context(F.col("raw_content")).alias("context"), "symbol_id", "file_path")
    both = links.select(F.col("a").alias("note_id"), F.col("b").alias("other"), "score").unionByName(links.select(F.col("b").alias("note_id"), F.col("a").alias("other"), "score"))
    best = both.join(results.select("note_id").distinct(), "note_id", "left_semi").groupBy("note_id", "other").agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("note_id").orderBy(F.col("score").desc(), "other"))
    related = best.withColumn("nth", nth).where(F.col("nth") <= links_k).groupBy("note_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "other", "score"))), lambda r: F.struct(r["other"].alias("note_id"), r["score"].alias("score"))).alias("related"))
    none = F.array().cast("array<struct<note_id:bigint,score:double>>")
    out = results.join(texts, "note_id").join(clusters, "note_id", "left").join(related, "note_id", "left")
    return out.withColumn("related", F.coalesce("related", none))
