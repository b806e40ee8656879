"""Incremental ingestion as a stream: every batch adds what is new to the notes table.

What a stream has seen of each commit is its state, so a commit may arrive in parts over any
number of batches, and turns that come again add nothing.  A batch writes to a folder of
its own, named by stream and batch, which the same batch replaces when it runs again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memloom.operators import notes as N
from memloom.operators.embed import Embedder, HashEmbedder, embed_distinct
from memloom.sources.graph_json import there

if TYPE_CHECKING:
    import pandas as pd

#: Parts of a commit's state, so that the turns of a very large commit are spread.
LANES = 16


def _unseen(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The turns of a commit (digest, turn) that no earlier batch had; repeated ones of this batch all pass."""
    known = set(state.get[0]) if state.exists else set()
    added: set[int] = set()
    for frame in frames:
        fresh = frame[~frame["digest"].isin(known)]
        added.update(int(d) for d in fresh["digest"])
        yield fresh[["turn"]]
    if added:
        state.update((sorted(known | added),))


def unseen_turns(turns: DataFrame) -> DataFrame:
    """A stream of turns without those of commits that came in an earlier batch; turns without a
    commit are always new.  Turns are told apart by all columns but turn_id."""
    shape = turns.schema
    packed = F.to_json(F.struct(*turns.columns), {"ignoreNullFields": "false"}).alias("turn")
    digest = F.xxhash64(F.to_json(F.struct(*[c for c in turns.columns if c != "turn_id"])))
    keyed = turns.where("commit_id is not null").select("commit_id", digest.alias("digest"), packed).withColumn("lane", F.pmod("digest", F.lit(LANES)))
    fresh = keyed.groupBy("commit_id", "lane").applyInPandasWithState(_unseen, "turn string", "digests array<bigint>", "append", GroupStateTimeout.NoTimeout)
    return fresh.select(F.from_json("turn", shape).alias("t")).select("t.*").unionByName(turns.where("commit_id is null"))


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity of a stream, kept in its checkpoint from its first start on."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def stream_notes(turns: DataFrame, table: str, checkpoint: str, embedder: Embedder | None = None, once: bool = True) -> StreamingQuery:
    """Starts a stream of turns into a Parquet table of notes, partitioned by stream and batch.

    Turns of commits that other streams have brought are left out; of its own commits a stream
    adds each turn once, in whatever batch it comes.  Note and turn ids go on from those of the
    table without the batch that is written, so a batch that runs again gives the same notes.
    """
    spark = turns.sparkSession
    embedder = embedder or HashEmbedder()

    def add(batch: DataFrame, number: int) -> None:
        stream = _stream_id(spark, checkpoint)
        fresh, first = batch, 0
        if there(spark, table):
            every = spark.read.parquet(table).where((F.col("stream") != stream) | (F.col("batch") < number))
            fresh = N.new_turns(batch, every.where(F.col("stream") != stream))
            first = N.next_note_id(every)
            if first:
                fresh = N.renumbered(fresh, every, ["timestamp", "commit_id", "content"])
        path = f"{table}/stream={stream}/batch={number}"
        N.turns_to_notes(embed_distinct(fresh, embedder), first).write.mode("overwrite").parquet(path)

    writer = unseen_turns(turns).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
