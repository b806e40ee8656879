"""Lookups and aggregates over a built graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.config import clamp_top_k
from memloom.functions import text as X


def top_links(links: DataFrame, k: int | None) -> DataFrame:
    """The strongest long-range links; all if k is None."""
    out = links.orderBy(F.col("score").desc(), "a", "b")
    return out if k is None else out.limit(k)


def numbered_links(links: DataFrame, k: int | None = None) -> DataFrame:
    """The tool's list: 20 links, 100 at most, numbered from 1."""
    top = top_links(links, clamp_top_k(k, 20, 100))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "a", "b")))


def related_notes(links: DataFrame, note_id: int, k: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    """A note's neighbours (note_id, score) by their best link, or, where the graph has no links, its stored list (src, dst, score)."""
    if stored is not None and links.isEmpty():
        both = stored.where(F.col("src") == note_id).select(F.col("dst").alias("note_id"), "score")
    else:
        both = links.where(F.col("a") == note_id).select(F.col("b").alias("note_id"), "score")
        both = both.unionByName(links.where(F.col("b") == note_id).select(F.col("a").alias("note_id"), "score"))
        both = both.groupBy("note_id").agg(F.max("score").alias("score"))
    out = both.orderBy(F.col("score").desc(), "note_id")
    return out if k is None else out.limit(k)


def note(notes: DataFrame, clusters: DataFrame, note_id: int) -> DataFrame:
    """One note with its label and context; an error if there is none."""
    found = notes.where(F.col("note_id") == note_id)
    if found.isEmpty():
        raise KeyError(f"no note {note_id}")
    return found.join(clusters, "note_id", "left").withColumn("context", X.context(F.col("raw_content")))


def inspect_note(notes: DataFrame, links: DataFrame, note_id: int, links_k: int | None = None, snippet: int | None = None) -> DataFrame:
    """A note's related notes with snippets for a table: bars escaped, missing notes marked."""
    most = min(max(140 if snippet is None else snippet, 40), 300)
    related = related_notes(links, note_id, clamp_top_k(links_k, 10, 25)).withColumnRenamed("note_id", "related_id")
    text = F.replace(X.compact_snippet(F.col("raw_content"), most), F.lit("|"), F.lit("\\|"))
    joined = related.join(notes.select(F.col("note_id").alias("related_id"), text.alias("snippet")), "related_id", "left")
    return joined.withColumn("snippet", F.coalesce("snippet", F.lit("(missing note payload)")))


def hotspots(notes: DataFrame, top_k: int = 10) -> DataFrame:
    """Symbols by the number of turns that touched them."""
    known = notes.where("symbol_id is not null and ast_node_type is not null")
    counts = known.groupBy("symbol_id").agg(F.sum(F.size("sources")).alias("churn"), F.min_by("ast_node_type", "note_id").alias("category"))
    return counts.orderBy(F.col("churn").desc(), "symbol_id").limit(min(top_k, 50))


def symbol_history(notes: DataFrame, symbol_id: str, limit: int | None = None) -> DataFrame:
    """All turns of a symbol, latest first, with how many there are in all."""
    rows = notes.where(F.col("symbol_id") == symbol_id).select("note_id", X.compact_snippet(F.col("raw_content"), 100).alias("snippet"), F.explode("sources").alias("s"))
    total = rows.agg(F.count("*").alias("total"))
    out = rows.select("note_id", "snippet", F.col("s.ts").alias("ts"), X.to_rfc3339(F.col("s.ts")).alias("date"), F.col("s.commit_id").alias("commit_id")).crossJoin(F.broadcast(total))  # one row
    out = out.orderBy(F.col("ts").desc(), F.col("note_id").desc())
    return out if limit is None else out.limit(limit)


def graph_summary(notes: DataFrame, clusters: DataFrame, centroids: DataFrame, links: DataFrame) -> DataFrame:
    """One row of counts."""
    one = notes.agg(F.count("*").alias("notes"), F.coalesce(F.max("note_id") + 1, F.lit(0)).alias("next_id"))
    for df, name in ((links, "long_range_links"), (clusters, "cluster_labels"), (centroids, "centroids")):
        one = one.crossJoin(df.agg(F.count("*").alias(name)))  # one row each
    return one.withColumn("has_labels", F.col("cluster_labels") > 0).withColumn("has_links", F.col("long_range_links") > 0)


def ingest_summary(notes: DataFrame, clusters: DataFrame) -> DataFrame:
    return notes.agg(F.count("*").alias("notes")).crossJoin(clusters.agg((F.count("*") > 0).alias("labels_present")))
