"""Notes: building them from turns, and keeping them up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import vec
from memloom.operators.embed import Embedder, embed_distinct
from memloom.operators.settle import settled


def numbered(df: DataFrame, order: list[str], out: str, first: int = 0) -> DataFrame:
    """df with gapless numbers in an order, without bringing all rows together: range partitions
    number themselves, and their counts (a row for each partition) give the offsets."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = settled(ranged.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_pos", F.col("_at") - F.shiftleft("_part", 33))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.col("_pos") + first).drop("_at", "_part", "_pos", "_before")


def turns_to_notes(turns: DataFrame, next_id: int = 0) -> DataFrame:
    """A note for each embedded turn, numbered in turn order."""
    source = F.struct("turn_id", "commit_id", F.col("timestamp").alias("ts"))
    rows = turns.withColumn("norm", vec.norm(F.col("embedding"))).withColumn("sources", F.array(source))
    rows = rows.select(F.col("content").alias("raw_content"), "embedding", "norm", "sources", "symbol_id", "ast_node_type", "file_path", "turn_id")
    return numbered(rows, ["turn_id"], "note_id", next_id).select("note_id", "raw_content", "embedding", "norm", "sources", "symbol_id", "ast_node_type", "file_path")


def new_turns(turns: DataFrame, notes: DataFrame) -> DataFrame:
    """Turns whose commit no note stems from; turns without commit are always new."""
    known = notes.select(F.explode("sources.commit_id").alias("commit_id")).where("commit_id is not null").distinct()
    return turns.join(known, "commit_id", "left_anti").select(*turns.columns)


def last_turn_id(notes: DataFrame) -> int:
    return int(notes.select(F.explode("sources.turn_id").alias("t")).agg(F.coalesce(F.max("t"), F.lit(0))).first()[0])


def next_note_id(notes: DataFrame) -> int:
    return int(notes.agg(F.coalesce(F.max("note_id") + 1, F.lit(0))).first()[0])


def renumbered(turns: DataFrame, notes: DataFrame, order: list[str]) -> DataFrame:
    """Turns with ids that go on from the notes'."""
    return numbered(turns.drop("turn_id"), order, "turn_id", last_turn_id(notes) + 1)


def update(notes: DataFrame, turns: DataFrame, embedder: Embedder, order: list[str]) -> DataFrame:
    """Notes and those of the turns that are new; the same notes if none is."""
    fresh = new_turns(turns, notes)
    if fresh.isEmpty():
        return notes
    embedded = embed_distinct(renumbered(fresh, notes, order), embedder)
    return notes.unionByName(turns_to_notes(embedded, next_note_id(notes)))


def structural_links(notes: DataFrame) -> DataFrame:
    """(src, dst, mult): notes of the same symbol; a set, however often it is resolved."""
    known = notes.where("symbol_id is not null").select("note_id", "symbol_id")
    other = known.select(F.col("note_id").alias("dst"), "symbol_id")
    return known.join(other, "symbol_id").where("note_id <> dst").select(F.col("note_id").alias("src"), "dst", F.lit(1).alias("mult"))


def merge_turns(notes: DataFrame, turns: DataFrame) -> DataFrame:
    """Turns (note_id, turn_id, content, embedding, commit_id, timestamp, file_path) merged into
    their notes: content behind content, the running mean of the vectors, sources appended."""
    parts = notes.select("note_id", F.lit(0).alias("at"), F.col("raw_content").alias("content"), "embedding", F.size("sources").alias("n"), "sources", "file_path")
    source = F.array(F.struct("turn_id", "commit_id", F.col("timestamp").alias("ts")))
    added = turns.select("note_id", (F.col("turn_id") + 1).alias("at"), "content", "embedding", F.lit(1).alias("n"), source.alias("sources"), "file_path").join(notes.select("note_id"), "note_id", "left_semi")
    every = parts.unionByName(added)
    weighed = every.select("note_id", "n", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    sums = weighed.groupBy("note_id", "pos").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"))
    means = sums.groupBy("note_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("embedding"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "content", "sources", "file_path")))
    texts = every.groupBy("note_id").agg(ordered.alias("all")).select(
        "note_id",
        F.array_join(F.transform("all", lambda e: e["content"]), " | ").alias("raw_content"),
        F.flatten(F.transform("all", lambda e: e["sources"])).alias("sources"),
        F.get(F.filter(F.transform("all", lambda e: e["file_path"]), lambda p: p.isNotNull()), F.lit(0)).alias("file_path"),
    )
    kept = notes.select("note_id", "symbol_id", "ast_node_type")
    return texts.join(means, "note_id").join(kept, "note_id").withColumn("norm", vec.norm(F.col("embedding")))


def edited_links(given: DataFrame, notes: DataFrame) -> DataFrame:
    """An editor's links (note_id, score): the best score for each note, notes that do not exist left out."""
    return given.groupBy("note_id").agg(F.max("score").alias("score")).join(notes.select("note_id"), "note_id", "left_semi")


def edit_note(notes: DataFrame, note_id: int, content: str) -> DataFrame:
    """notes with one note's content replaced; its vector stays."""
    return notes.withColumn("raw_content", F.when(F.col("note_id") == note_id, F.lit(content)).otherwise(F.col("raw_content")))


def delete_notes(gone: DataFrame, notes: DataFrame, clusters: DataFrame, related: DataFrame, links: DataFrame) -> tuple[DataFrame, ...]:
    """All tables without the notes of ``gone`` (note_id): their rows, labels, and links to and from them."""

    def without(df: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            df = df.join(gone.select(F.col("note_id").alias("_gone")), F.col(c) == F.col("_gone"), "left_anti")
        return df

    return without(notes, "note_id"), without(clusters, "note_id"), without(related, "src", "dst"), without(links, "a", "b")


def sources_as_arrays(notes: DataFrame) -> DataFrame:
    """The three parallel arrays of the exchange format instead of ``sources``."""
    names: list[tuple[str, Column]] = [("source_turn_ids", F.col("sources.turn_id")), ("source_commit_ids", F.col("sources.commit_id")), ("source_timestamps", F.col("sources.ts"))]
    return notes.select(*[c for c in notes.columns if c != "sources"], *[c.alias(n) for n, c in names])


def arrays_as_sources(notes: DataFrame) -> DataFrame:
    zipped = F.arrays_zip("source_turn_ids", "source_commit_ids", "source_timestamps")
    sources = F.transform(zipped, lambda z: F.struct(z["source_turn_ids"].alias("turn_id"), z["source_commit_ids"].alias("commit_id"), z["source_timestamps"].alias("ts")))
    gone = ("source_turn_ids", "source_commit_ids", "source_timestamps")
    return notes.withColumn("sources", sources).drop(*gone)
