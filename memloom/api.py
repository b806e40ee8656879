"""The engine as one object: ingest turns, build the graph, ask it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.config import BuildConfig, TemporalConfig
from memloom.functions import sql
from memloom.operators import analytics, graph, retrieve, spectral
from memloom.operators import notes as N
from memloom.operators.embed import Embedder, HashEmbedder, embed_distinct
from memloom.operators.settle import settled
from memloom.schema import NOTES
from memloom.sources import graph_json


_STATE = ("edges", "coords", "built")


class MemoryGraph:
    """A spectral memory graph over DataFrames; tables can also be queried in SQL through ``views``."""

    def __init__(self, spark: SparkSession, embedder: Embedder | None = None):
        self.spark = spark
        self.embedder = embedder or HashEmbedder()
        self.notes = spark.createDataFrame([], NOTES)
        self.structural = spark.createDataFrame([], "src long, dst long, mult int")
        self.related = spark.createDataFrame([], "src long, dst long, score double")
        self.clusters, self.centroids, self.links = graph_json.empty_tables(spark)
        self.edges: DataFrame | None = None
        self.by_symbol: DataFrame | None = None
        self.coords: DataFrame | None = None
        self.built: DataFrame | None = None
        self.eigenvalues: Sequence[float] = ()
        self.config = BuildConfig()
        self.metadata: dict = {}

    # ingestion

    def ingest_turns(self, turns: DataFrame) -> None:
        """Turns as notes, in turn order, behind those there are."""
        for c in ("symbol_id", "ast_node_type", "file_path", "commit_id"):
            if c not in turns.columns:
                turns = turns.withColumn(c, F.lit(None).cast("string"))
        fresh = N.turns_to_notes(embed_distinct(turns, self.embedder), N.next_note_id(self.notes))
        self.notes = settled(self.notes.unionByName(fresh.select(*self.notes.columns)))

    ingest_turn = ingest_turns

    def update(self, turns: DataFrame, order: Sequence[str] = ("timestamp", "commit_id", "content")) -> bool:
        """Ingests turns of commits that are new, and says whether there were any."""
        fresh = N.new_turns(turns, self.notes)
        if fresh.isEmpty():
            return False
        self.ingest_turns(N.renumbered(fresh, self.notes, list(order)))
        return True

    def resolve_structural_links(self) -> None:
        self.structural = N.structural_links(self.notes)
        self.by_symbol = self.notes  # the links of these notes follow from their symbols

    # build

    def build(self, config: BuildConfig | None = None, progress: Callable[[str, float], None] | None = None, incremental: bool = False) -> None:
        """The build; graphs of fewer than three notes stay as they are.

        An incremental build keeps the edges of the last one and adds those of the notes that have
        come since, and starts the eigenvectors from the last ones; labels and links follow anew.
        It needs the edges of the last build, the same weights and threshold, and structural links
        that follow from the symbols; else the whole is built.
        """
        tell = progress or (lambda stage, share: None)
        before, self.config = self.config, config or self.config
        n = self.notes.count()
        if n < 3:
            return
        c = self.config
        tell("similarity", 0.0)
        follows = self.by_symbol is self.notes
        known = None
        same = all(getattr(before, k) == getattr(c, k) for k in ("adjacency_threshold", "alpha", "beta"))
        if incremental and follows and same and self.edges is not None and self.built is not None:
            old, fresh = self.notes.join(self.built, "note_id", "left_semi"), self.notes.join(self.built, "note_id", "left_anti")
            self.edges, known = settled(self.edges.unionByName(graph.added_edges(fresh, old, c))), self.coords
        else:
            self.edges = settled(graph.symbol_edges(self.notes, c) if follows else graph.fused_edges(self.notes, self.structural, c))
        tell("spectrum", 0.4)
        nodes = self.notes.select("note_id")
        self.eigenvalues, coords = spectral.spectral_decomposition(nodes, self.edges, min(c.spectral_dims, n), known)
        self.coords = coords = settled(coords)
        self.built = settled(nodes)
        k = c.clamp_clusters(spectral.eigengap(list(self.eigenvalues)), len(self.eigenvalues), n)
        embedding = settled(spectral.spectral_embedding(coords, c.spectral_dims, n))
        tell("clusters", 0.6)
        self.clusters = settled(spectral.cluster(embedding, k))
        self.centroids = settled(graph.centroids(self.notes, self.clusters))
        tell("links", 0.8)
        self.links = settled(graph.long_range_links(embedding, self.notes, self.edges, c))
        both = self.links.select(F.col("a").alias("src"), F.col("b").alias("dst"), "score")
        self.related = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"))
        tell("done", 1.0)

    # questions

    def embed_query(self, text: str) -> list[float]:
        return [float(x) for x in self.embedder.embed(self.spark.createDataFrame([(text,)], "q string"), "q", "v").first()["v"]]

    def _built(self) -> dict:
        return {} if self.clusters.isEmpty() else {"clusters": self.clusters, "centroids": self.centroids}

    def retrieve_candidates(self, query: str, k: int, file_filter: str | None = None, symbol_filter: str | None = None, keyword_weight: float = 0.0) -> DataFrame:
        return retrieve.retrieve_candidates(self.notes, self.embed_query(query), k, query, file_filter=file_filter, symbol_filter=symbol_filter, keyword_weight=keyword_weight, **self._built())

    def retrieve_with_scores(self, query: str, top_k: int, cfg: TemporalConfig | None = None, **options) -> DataFrame:
        return retrieve.retrieve_with_scores(self.notes, self.embed_query(query), top_k, query, cfg, **self._built(), **options)

    def retrieve_in_time_range(self, query: str, top_k: int, start: int | None = None, end: int | None = None, cfg: TemporalConfig | None = None, **options) -> DataFrame:
        return retrieve.retrieve_in_time_range(self.notes, self.embed_query(query), top_k, start, end, query, cfg, **self._built(), **options)

    def retrieve(self, query: str, top_k: int) -> list[int]:
        return [r["turn_id"] for r in self.retrieve_with_scores(query, top_k).collect()]

    def search(self, query: str, top_k: int, min_score: float = 0.0) -> DataFrame:
        return retrieve.search(self.notes, self.embed_query(query), top_k, query, min_score, **self._built()).select("final_score", "note_id")

    def query(self, query: str, **options) -> DataFrame:
        return retrieve.query(self.notes, self.embed_query(query), query, **self._built(), **options)

    def long_range_links(self, k: int | None = None) -> DataFrame:
        return analytics.top_links(self.links, k)

    def related_notes(self, note_id: int, k: int | None = None) -> DataFrame:
        return analytics.related_notes(self.links, note_id, k, self.related)

    # storage

    def tables(self) -> graph_json.GraphTables:
        return graph_json.GraphTables(self.notes, self.clusters, self.centroids, self.links, self.related, self.structural, self.metadata)

    def save(self, path: str, form: str = "json") -> None:
        """As one JSON object, or (form "parquet") as a folder of tables for graphs of any size."""
        {"json": graph_json.save, "parquet": graph_json.save_tables}[form](self.tables(), path, self.config)
        if form == "parquet" and self.built is not None:  # what an incremental build goes on from
            for name in _STATE:
                getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, embedder: Embedder | None = None, form: str = "json") -> MemoryGraph:
        out, t = cls(spark, embedder), {"json": graph_json.load, "parquet": graph_json.load_tables}[form](spark, path)
        out.notes, out.clusters, out.centroids, out.links = t.notes, t.clusters, t.centroids, t.links
        out.related, out.structural, out.metadata = t.related.drop("pos"), t.structural, t.metadata
        out.config = BuildConfig().merged(t.metadata)
        if form == "parquet" and graph_json.there(spark, f"{path}/built"):
            for name in _STATE:
                setattr(out, name, spark.read.parquet(f"{path}/{name}"))
            out.config = replace(out.config, **{k: float(t.metadata[k]) for k in ("adjacency_threshold", "alpha", "beta") if k in t.metadata})
        return out

    def views(self, prefix: str = "memory") -> list[str]:
        """Makes the tables views and the scores and lookups SQL functions; returns the functions' names."""
        for name in ("notes", "clusters", "centroids", "links", "related", "structural"):
            getattr(self, name).createOrReplaceTempView(f"{prefix}_{name}")
        return sql.register(self.spark, prefix, tables=True)
