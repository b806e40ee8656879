"""The corpus pipeline: five operators of ``memloom.llm``, one after the other, over documents.

Each stage takes what the one before kept, as Parquet, and returns documents with all their
columns; the last deals them to shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import decontaminate, feistel_shards, jaccard_join, langid_crf, mixing
from memloom.llm.shared import Scratch, checked_broadcast, fresh, table

#: Least share of one language in a document's letters.
LEAST_SCORE = 0.45
SHARDS = 16


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are mostly in one known language stay; those without text or letters go.

    The model learns from the labelled documents that are not held out; without any label
    there is no language to be in, and only documents without letters go.
    """
    model = langid_crf.fit(docs.where(~langid_crf.held_out("doc_id")))
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    lang, score = fresh(docs.columns, "_lang"), fresh(docs.columns, "_score")
    kept = langid_crf.predict(docs, model, docs.columns, lang=lang, score=score)
    return kept.where((F.col(lang) != langid_crf.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by 5-word shingles, four fifths of them in common, the
    document with the smallest identifier stays.  Rows with a null identifier stay."""
    classes = jaccard_join.jaccard_join(docs, k=5, percent=80)
    gone = classes.where("component_id <> doc_id").select("doc_id").distinct()
    gone = Scratch(spark, "near").table(gone, "gone")
    return docs.join(checked_broadcast(gone), "doc_id", "left_anti").select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it, one row for each time."""
    size, members, times = (fresh(docs.columns, n) for n in ("_size", "_members", "_times"))
    sized = docs.withColumn(size, mixing.words(F.col("text"))).withColumn(members, F.array("source"))
    taken, _, _ = mixing.mix(sized, members, size, "doc_id", out=times)
    return taken.where(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document that is left, in one of the shards."""
    return feistel_shards.shard(docs, shards=SHARDS)


STAGES = [
    ("language", language),
    ("near duplicates", near_duplicates),
    ("benchmark", benchmark_free),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL cannot express the learned and the approximate stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what one stage keeps is written before the next reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.table(docs, name.replace(" ", "-"))
    return docs
