"""Embedders: anything that maps a text column to a vector column can stand in for a neural model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 384


class Embedder(Protocol):
    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """df with a vector column ``out`` for the text column."""


class HashEmbedder:
    """Deterministic vectors from hashes of text and dimension, each value in [-1, 1]; runs in the JVM."""

    def __init__(self, dims: int = DIMS):
        self.dims = dims

    def vector(self, text: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(self.dims - 1)), lambda i: (F.xxhash64(text, i) / F.lit(float(1 << 63))).cast("float"))

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, self.vector(F.col(text)))


class PandasEmbedder:
    """A Python model, loaded once in each worker, called with batches of texts."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32):
        self.load, self.batch = load, batch

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        load, size = self.load, self.batch

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                values = texts.tolist()
                vectors = [v for i in range(0, len(values), size) for v in model(values[i : i + size])]
                yield pd.Series(vectors, index=texts.index)

        return df.withColumn(out, run.asNondeterministic()(F.col(text)))


def embed_distinct(df: DataFrame, embedder: Embedder, text: str = "content", out: str = "embedding") -> DataFrame:
    """df with a vector for each text, each distinct text embedded once; null texts get that of null.
    Texts meet their vectors by two hashes, so only the distinct ones are shuffled."""
    keyed = df.withColumn("_h1", F.xxhash64(text)).withColumn("_h2", F.xxhash64(F.lit(7919), text))
    once = keyed.groupBy("_h1", "_h2").agg(F.first(text).alias(text))
    known = embedder.embed(once, text, out).drop(text)
    return keyed.join(known, ["_h1", "_h2"]).select(*df.columns, out)
