"""Exact deduplication by a tree merge of sorted digest runs.

Each lane (a hash class of row identifiers) holds a run: its distinct digests in order, each
with the smallest identifier and the row count.  In every round the runs of ``fan_in``
neighbouring lanes that cover the same slice of digests meet on one node, which merges them in
digest order and keeps the smallest identifier; each round also cuts every run into ``fan_in``
finer digest slices, so all nodes stay equally loaded.  With fan-in 2 these are the rounds of a
binomial tree; a larger fan-in joins several of them in one multiway merge.  After the last
round one lane is left and each digest lies on exactly one node.  The answers go back to the
lanes' runs and from there to the rows, so no digest, however frequent, meets in one task.

A node sorts what it gets by digest and then aggregates equal neighbours (the identifier is
kept in a struct, for which Spark has sort-based aggregation only).  A shuffle doesn't keep the
order of the runs, so each node sorts anew: the rounds are those of the tree, the merging is a sort.  Rows are verified to be equal at every level: beside the digest they
must agree in length and in a second, independent hash of the text, else they stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.shared import Scratch, parallelism

#: Fixed value: the white space of the contract, as a Java character class.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text, null as empty, each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def smallest(keep: str) -> list[Column]:
    """The smallest identifier, null last, in a struct, and the row count."""
    return [F.min(keep).alias("keep"), F.sum("group_size").alias("group_size")]


def tree_merge(runs: DataFrame, keys: list[str], levels: int, fan_in: int, parts: int) -> DataFrame:
    """Merges runs (lane, *keys, keep, group_size) to one lane; a row for each key."""
    for level in range(1, levels + 1):
        slice_ = F.pmod(F.xxhash64(*keys), F.lit(fan_in**level * 16))  # finer with each round
        met = runs.withColumn("lane", F.floor(F.col("lane") / fan_in).cast("int")).withColumn("slice", slice_).repartition(parts, "lane", "slice")
        runs = met.groupBy("lane", "slice", *keys).agg(*smallest("keep")).drop("slice")
    return runs.drop("lane")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per row of df: (doc_id, keep_id, group_size, kept, text_sha256).

    Equal texts are those with the same SHA-256, length and second hash after normalisation; the
    row with the smallest identifier stays.  Texts of any length are read whole.  Null text counts as empty.  Of rows that repeat both
    identifier and text, one stays.  A null identifier never wins against another; where a
    group has none else, keep_id is null and one row stays.  An empty table gives an empty
    result; other columns of df, whatever their names, are ignored.
    """
    spark = df.sparkSession
    parts = parallelism(spark)
    levels = 1
    while fan_in**levels < parts:
        levels += 1
    scratch = Scratch(spark, "exact")
    text = normalised(F.col(text_col))
    rows = scratch.table(
        df.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
            "doc_id",
            F.pmod(F.xxhash64("doc_id"), F.lit(fan_in**levels)).cast("int").alias("lane"),
            F.unhex(F.sha2("text", 256)).alias("digest"),
            F.octet_length("text").alias("bytes"),
            F.xxhash64("text").alias("check"),
        ),
        "rows",
    )
    keys = ["digest", "bytes", "check"]
    keep = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id").alias("keep")
    runs = rows.select("lane", *keys, keep, F.lit(1).cast("long").alias("group_size")).groupBy("lane", *keys).agg(*smallest("keep"))
    runs = scratch.table(runs, "runs")
    merged = tree_merge(runs, keys, levels, fan_in, parts).withColumn("keep_id", F.col("keep.doc_id")).drop("keep")
    answers = runs.select("lane", *keys).join(merged, keys)
    joined = rows.join(answers, ["lane", *keys])
    # which of the rows that repeat an identifier stays: all of them lie in one lane
    nth = F.row_number().over(Window.partitionBy("lane", *keys, "doc_id").orderBy(F.lit(1)))
    return joined.withColumn("nth", nth).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) h from documents),
g as (select h, min(doc_id) keep_id, count(*) n from d group by h)
select doc_id, keep_id, n as group_size, doc_id = keep_id as kept, h as text_sha256 from d join g using (h)
"""
