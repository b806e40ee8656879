"""What the corpus operators share: written intermediate tables, connected components, table access.

Intermediate tables are written as Parquet below the folder the cluster names in
``spark.checkpoint.dir``.  They cut lineage, so a lost executor costs the running stage
only, and every executor and the driver can read them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side may be broadcast; every use adds them up first and shuffles beyond.
BROADCAST_BYTES = 16 << 20
#: Parts a frequent key's rows are dealt to where they meet what is looked up for it.
LANES = 64


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share.  Only a one-machine session may fall back to a temporary folder."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not root:
        known = context._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="memloom-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables of one operator call, below the shared folder; removed when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        home = f"{shared_root(spark)}/memloom-{spark.sparkContext.applicationId}"
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(home).getFileSystem(conf)
        self._fs.mkdirs(self._path(home))
        self._fs.deleteOnExit(self._path(home))
        self.root = f"{home}/{name}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:6]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._memloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a table of this scratch that no later step reads; the files of finished shuffles
        go as well, as Spark keeps them only as long as the driver's memory has their plans."""
        self._fs.delete(self._path(df._memloom_path), True)
        self.spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def _width(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value, roughly."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(column), F.lit(0)) * _fixed(kind.elementType) + 16
    return F.lit(_fixed(kind))


def _fixed(kind: T.DataType) -> int:
    return 8 + sum(_fixed(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else 16 if isinstance(kind, (T.StringType, T.BinaryType)) else 8


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether all rows of a written table take at most so many bytes."""
    width = F.lit(8)
    for f in df.schema.fields:
        width = width + _width(F.col(f"`{f.name}`"), f.dataType)
    return (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= most


def checked_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if its rows take few bytes; else df as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, most) else df


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], spread: str, how: str = "inner") -> DataFrame:
    """rows joined with a written table that has one row for each key, however many rows a key has.

    Broadcast if small.  Else each key's rows are dealt to LANES by the column ``spread``, and
    what is found for the key goes to those lanes only that have rows of it.
    """
    if small(found):
        return rows.join(F.broadcast(found), keys, how)
    laned = rows.withColumn("_lane", F.pmod(F.xxhash64(spread), F.lit(LANES)).cast("int"))
    met = laned.select(*keys, "_lane").distinct().join(found, keys)
    return laned.join(met, [*keys, "_lane"], how).drop("_lane")


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores before it until no column has it, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def both_hashes(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes, together the identity of a string."""
    return F.xxhash64(text), F.xxhash64(F.lit(7919), text)


def components(scratch: Scratch, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each node of the undirected edges, with the smallest node it can reach.

    Distributed union-find: each round hooks every node to its smallest neighbour, follows the
    pointers to their roots by repeated doubling, and contracts the edges to roots, until none
    is left.  Only joins and aggregations with map-side combining; nothing is collected.
    """
    left = scratch.table(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct(),
        "edges",
    )
    found: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = both.groupBy("u").agg(F.min("v").alias("v"))
        roots = scratch.table(hooks.select(F.col("u").alias("node"), F.least("u", "v").alias("up")), "hooks")
        while True:
            above = roots.where("node <> up").select(F.col("node").alias("mid"), F.col("up").alias("top"))
            doubled = roots.join(above, F.col("up") == F.col("mid"), "left")
            after = scratch.table(doubled.select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "roots")
            moved = not after.where("moved").isEmpty()
            scratch.drop(roots)
            roots = after.drop("moved")
            roots._memloom_path = after._memloom_path
            if not moved:
                break
        pairs = (
            left.join(roots.select(F.col("node").alias("u"), F.col("up").alias("ru")), "u")
            .join(roots.select(F.col("node").alias("v"), F.col("up").alias("rv")), "v")
            .where("ru <> rv")
        )
        contracted = scratch.table(pairs.select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), "edges")
        scratch.drop(left)
        left = contracted
        if found is None:
            found = roots.select("node", F.col("up").alias("component"))
        else:
            upper = roots.select(F.col("node").alias("component"), F.col("up").alias("top"))
            found = scratch.table(found.join(upper, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "found")
    if found is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found
