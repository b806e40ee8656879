"""Cutting lineage of tables that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _new_path(spark: SparkSession) -> str:
    home = f"{shared_root(spark)}/memloom-tables-{spark.sparkContext.applicationId}"
    store, at = _files(spark, home)
    store.mkdirs(at)
    store.deleteOnExit(at)
    return f"{home}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder, from where later steps read it, also
    those that run again after an executor is lost.  It goes when the application ends, or by ``dropped``."""
    spark = df.sparkSession
    path = _new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._memloom_path = path
    return out


def bucketed(df: DataFrame, by: list[str], buckets: int, behind: DataFrame | None = None) -> DataFrame:
    """As ``settled``, but in buckets by some columns: tables of as many buckets by the same columns are grouped
    together without a shuffle.  Rows may be put behind those of another such table, which isn't
    written again.  The session's catalog knows the table until it is ``dropped``."""
    spark = df.sparkSession
    path = behind._memloom_path if behind is not None else _new_path(spark)
    name = f"memloom_{path.rsplit('/', 1)[1]}"
    df.repartition(buckets, *by).write.mode("append").bucketBy(buckets, *by).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._memloom_path, out._memloom_name = path, name
    return out


def dropped(df: DataFrame) -> None:
    """Removes a settled or bucketed table that no later step reads."""
    if name := getattr(df, "_memloom_name", None):
        df.sparkSession.sql(f"drop table if exists {name}")
    store, at = _files(df.sparkSession, df._memloom_path)
    store.delete(at, True)
