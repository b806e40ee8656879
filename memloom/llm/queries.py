"""The corpus operators as queries over the test tables, with production parameters."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers

from memloom.llm import (
    chained_passages,
    decontaminate,
    exact_dedup,
    feistel_shards,
    fuzzy_lines,
    jaccard_join,
    langid_crf,
    merkle,
    mixing,
    notices,
    packed_ids,
    runs,
    surrogates,
)
from memloom.llm.shared import table


def op1_language_id(spark, sf_dir):
    """The language of every document, by a conditional random field learned from those not held out."""
    return langid_crf.identify(table(spark, sf_dir, "documents"))


def op2_shards(spark, sf_dir):
    """All documents dealt to 16 shards by a keyed permutation of their row numbers."""
    return feistel_shards.shard(table(spark, sf_dir, "documents"), shards=16)


def op3_packed_ids(spark, sf_dir):
    """Token ids of all documents, written in packed files and read back."""
    return packed_ids.pack_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_decontaminate(spark, sf_dir):
    """The benchmark items found, within an edit budget, in all documents."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_surrogates(spark, sf_dir):
    """All documents with personal data and secrets replaced by keyed surrogates."""
    return surrogates.surrogate_texts(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark, sf_dir):
    """How much of each document a mix of the sources by weights 5, 2, 1 takes."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_repeated_passages(spark, sf_dir):
    """Passages of 50 words or more that repeat, but for edits, across all documents."""
    return chained_passages.repeated_passages(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark, sf_dir):
    """The classes of documents linked by 85 % of common 4-word shingles."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), k=4, percent=85)


def op9_fuzzy_lines(spark, sf_dir):
    """What fuzzy line deduplication leaves of every document."""
    return fuzzy_lines.line_report(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark, sf_dir):
    """The groups of equal texts of all documents, by a tree merge of digest runs."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_license_notices(spark, sf_dir):
    """License notices, as they are or with errors, in all documents."""
    return notices.license_report(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark, sf_dir):
    """The Merkle tree of all documents by language, with a proof for each, checked against tampered rows."""
    return merkle.merkle_report(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark, sf_dir):
    """Periodic runs of words in all documents, and what is left without repetitions."""
    return runs.run_report(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    """The places in shards of what the corpus pipeline keeps of all documents."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_shards, op3_packed_ids, op4_decontaminate, op5_surrogates, op6_mix_sources, op7_repeated_passages, op8_jaccard_join, op9_fuzzy_lines, op10_exact_dedup, op11_license_notices, op12_merkle_manifest, op13_periodic_runs, pipeline)}
ORACLES = {"op2_shards": feistel_shards.sql(16), "op6_mix_sources": mixing.sql(), "op8_jaccard_join": jaccard_join.SQL, "op10_exact_dedup": exact_dedup.SQL, "op12_merkle_manifest": merkle.SQL}
