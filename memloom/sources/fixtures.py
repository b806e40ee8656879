"""The engine's tables derived from the test tables: notes, commits, turns, and a stand-in graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import vec
from memloom.operators.graph import Similarity, similarity_join

NOW = 1_706_745_600
KEYWORD = "click"

NOTES_SQL = """
notes as (select e.vec_id as note_id, e.embedding::double[] as v, e.label as label, d.text as raw_content, e.vec_id + 1 as turn_id,
  case when e.vec_id % 5 = 4 then null else concat('function_item:', ev.event_type, '_', cast(ev.user_id % 10 as varchar)) end as symbol_id,
  case when e.vec_id % 5 = 4 then null when ev.event_type = 'signup' then 'API_DEFINITION' else 'IMPLEMENTATION' end as ast_node_type,
  case when e.vec_id % 7 = 6 then null else concat('src/', ev.event_type, '/mod_', cast(e.label as varchar), '.rs') end as file_path,
  concat('c', cast(cast(floor(e.vec_id / 3) as bigint) as varchar)) as commit_id, cast(floor(epoch(ev.ts)) as bigint) as ts
  from embeddings e join events ev on ev.event_id = e.vec_id left join documents d on d.doc_id = e.vec_id)"""
COMMITS_SQL = """
commits as (select doc_id, concat('d', cast(doc_id as varchar)) as commit_id, source as author, 1704067200 + doc_id * 3600 as ts,
  case doc_id % 5 when 0 then text when 1 then concat('fix(', source, '): ', replace(text, chr(10), concat(chr(10), 'fix(', source, '): ')))
  when 2 then concat('- ', replace(text, chr(10), concat(chr(10), '- '))) when 3 then replace(text, chr(10), concat(chr(10), chr(10)))
  else concat(text, chr(10), 'Signed-off-by: a <a@b.c>', chr(10), '<!-- x', chr(10), 'y -->', chr(10), chr(10), 'tail', chr(10), 'tail') end as message
  from documents)"""
TURNS_SQL = """
turns as (select row_number() over (order by conv_id, turn) as turn_id, role as speaker, text as content, concat('conv-', cast(conv_id as varchar)) as commit_id,
  1704067200 + conv_id * 86400 + turn * 60 as timestamp from conversations)"""
COS = "(case when list_dot_product(x.v, x.v) = 0 or list_dot_product(y.v, y.v) = 0 then 0 else list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) end)"
SIM_SQL = NOTES_SQL + f""",
sim as (select x.note_id as i, y.note_id as j, {COS} as w from notes x join notes y on x.note_id < y.note_id where {COS} >= 0.2)"""
LINKS_SQL = SIM_SQL + ", links as (select i as a, j as b, w as score from sim where w >= 0.3)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    ev = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_content"))
    has = F.col("vec_id") % 5 != 4
    symbol = F.concat(F.lit("function_item:"), F.col("event_type"), F.lit("_"), (F.col("user_id") % 10).cast("string"))
    path = F.concat(F.lit("src/"), F.col("event_type"), F.lit("/mod_"), F.col("label").cast("string"), F.lit(".rs"))
    commit = F.concat(F.lit("c"), F.floor(F.col("vec_id") / 3).cast("bigint").cast("string"))
    ts = F.unix_timestamp(F.col("ts").cast("timestamp"))
    joined = e.join(ev, F.col("event_id") == F.col("vec_id")).join(d, F.col("doc_id") == F.col("vec_id"), "left")
    return joined.select(
        F.col("vec_id").alias("note_id"),
        "raw_content",
        F.col("embedding"),
        vec.norm(F.col("embedding")).alias("norm"),
        F.array(F.struct((F.col("vec_id") + 1).alias("turn_id"), commit.alias("commit_id"), ts.alias("ts"))).alias("sources"),
        F.when(has, symbol).alias("symbol_id"),
        F.when(has, F.when(F.col("event_type") == "signup", "API_DEFINITION").otherwise("IMPLEMENTATION")).alias("ast_node_type"),
        F.when(F.col("vec_id") % 7 != 6, path).alias("file_path"),
        F.col("label").cast("int").alias("label"),
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the vectors, standing in for clusters."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("note_id"), F.col("label").cast("int").alias("label"))


def query_vector(spark: SparkSession, sf_dir: str, note_id: int = 0) -> list[float]:
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id") == note_id).first()["embedding"]


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    fix = F.concat(F.lit("fix("), "source", F.lit("): "))
    nl = F.lit("\n")
    noise = F.lit("\nSigned-off-by: a <a@b.c>\n<!-- x\ny -->\n\ntail\ntail")
    kind = F.col("doc_id") % 5
    message = (
        F.when(kind == 0, F.col("text"))
        .when(kind == 1, F.concat(fix, F.replace("text", nl, F.concat(nl, fix))))
        .when(kind == 2, F.concat(F.lit("- "), F.replace("text", nl, F.lit("\n- "))))
        .when(kind == 3, F.replace("text", nl, F.lit("\n\n")))
        .otherwise(F.concat("text", noise))
    )
    return d.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("commit_id"), F.col("source").alias("author"), (F.lit(1_704_067_200) + F.col("doc_id") * 3600).alias("ts"), message.alias("message"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.operators.notes import numbered

    c = read(spark, sf_dir, "conversations")
    rows = c.select(
        "conv_id", "turn", F.col("role").alias("speaker"), F.col("text").alias("content"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("commit_id"),
        (F.lit(1_704_067_200) + F.col("conv_id") * 86_400 + F.col("turn") * 60).alias("timestamp"),
    )
    return numbered(rows, ["conv_id", "turn"], "turn_id", 1).drop("conv_id", "turn")


def sim(spark: SparkSession, sf_dir: str, threshold: float = 0.2) -> DataFrame:
    return similarity_join(notes(spark, sf_dir), "note_id", "embedding", threshold)


def similarity(spark: SparkSession, sf_dir: str, threshold: float = 0.2) -> Similarity:
    """The same graph as vectors, of which pairs are made where they are needed."""
    return Similarity(notes(spark, sf_dir).select("note_id", "embedding"), threshold)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of cosine 0.3 or more, standing in for long-range links."""
    return sim(spark, sf_dir, 0.3).select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("w").alias("score"))


def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs as stored links (src, dst, score), in both directions."""
    both = links(spark, sf_dir)
    return both.select(F.col("a").alias("src"), F.col("b").alias("dst"), "score").unionByName(both.select(F.col("b").alias("src"), F.col("a").alias("dst"), "score"))
