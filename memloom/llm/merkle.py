"""Merkle manifest of a dataset: iterative DataFrame levels of hashes, with a proof for each row.

Every row is a leaf, the hash of its fields.  The leaves of a tree (the rows of one group) are
numbered in order; ``fanout`` consecutive nodes become one by the hash of their digests, until
one is left, the tree's subroot.  The subroots, in order of their groups, are the leaves of a
last tree, whose root stands for the dataset.

Going up, a pass groups nodes by their number floor-divided by ``fanout ** LEVELS``, sorts each
group's digests and hashes LEVELS levels of parents; a pass leaves a fraction of the nodes, so
all passes together cost little more than the first.  Going down, each pass joins the nodes'
parents with the groups they came from and puts the siblings of each level before the path of
the parent, so a path is made once for all leaves below it.  The row numbers come from range
partitions and their counts, so a group of any share of the rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.feistel_shards import numbered
from memloom.llm.shared import Scratch, looked_up

#: Levels of parents made in one pass.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Fixed value: rows whose identifier's CRC-32 this divides are tampered with in the query.
TAMPERED = 7
_PATH = "array<struct<left: string, right: string>>"


def digest(parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the UTF-8 string."""
    return F.sha2(parts.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value's length in UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(F.concat(*[field(c) for c in fields]))


def parents(nodes: Column, fanout: int) -> Column:
    """The digests of every ``fanout`` consecutive nodes of an array, the last of those left over."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * fanout + 1, fanout), "")))


def _count_up(n: Column, fanout: int) -> Column:
    return F.floor((n + (fanout - 1)) / fanout).cast("long")


def climb(scratch: Scratch, nodes: DataFrame, most: int, fanout: int, levels: int = LEVELS) -> list[DataFrame]:
    """The passes from nodes (tree, at, n, digest, *extra of leaves as ``rows``) up to one node a tree.

    n is the number of nodes of the tree, ``most`` the largest of them.  Each pass is a table
    (tree, at, n, above, kids, a0 .. a(levels - 1), top): the digests of a group level by level,
    and what became of them.
    """
    passes: list[DataFrame] = []
    while True:
        group = nodes.groupBy("tree", F.floor(F.col("at") / fanout**levels).cast("long").alias("at")).agg(
            F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "digest", "rows"))).alias("kids")
        )
        group = group.withColumn("a0", F.transform("kids", lambda x: x["digest"])).withColumn("above", F.col("n"))
        for i in range(levels):
            up = F.when(F.col("above") > 1, parents(F.col(f"a{i}"), fanout)).otherwise(F.col(f"a{i}"))
            group = group.withColumn(f"a{i + 1}", up).withColumn("above", _count_up(F.col("above"), fanout))
        group = group.withColumn("top", F.col(f"a{levels}")[0]).drop(f"a{levels}")
        passes.append(scratch.table(group.withColumn("kids", F.transform("kids", lambda x: x["rows"])), f"pass{len(passes)}"))
        most = -(-most // fanout**levels)
        if most <= 1:
            return passes
        nodes = passes[-1].select("tree", "at", F.col("above").alias("n"), F.col("top").alias("digest"), F.lit(None).cast(nodes.schema["rows"].dataType).alias("rows"))


def _siblings(i: Column, fanout: int, levels: int) -> Column:
    """The path of the i-th digest of a pass's group through its levels: what stands left and right of it in each run."""
    steps = []
    n = F.col("n")
    for level in range(levels):
        own = F.floor(i / fanout**level).cast("int")
        first = (F.floor(own / fanout) * fanout).cast("int")
        nodes = F.col(f"a{level}")
        step = F.struct(
            F.array_join(F.slice(nodes, first + 1, own - first), "").alias("left"),
            F.array_join(F.slice(nodes, own + 2, fanout - 1 - (own - first)), "").alias("right"),
        )
        steps.append(F.when(n > 1, F.array(step)).otherwise(F.array().cast(_PATH)))
        n = _count_up(n, fanout)
    return F.concat(*steps)


def descend(passes: list[DataFrame], tops: DataFrame, fanout: int, levels: int = LEVELS) -> DataFrame:
    """(tree, at, rows, digest, path) of every leaf: the siblings of its levels, from the leaf up to the
    end of the path that ``tops`` (tree, path) has for its tree."""
    paths = tops.select("tree", F.lit(0).cast("long").alias("at"), "path")
    for i, group in reversed(list(enumerate(passes))):
        met = group.join(paths, ["tree", "at"])
        each = F.transform(F.sequence(F.lit(0), F.size("a0") - 1), lambda j: F.struct(
            (F.col("at") * fanout**levels + j).alias("at"),
            F.col("kids")[j].alias("rows"),
            F.col("a0")[j].alias("digest"),
            F.concat(_siblings(j, fanout, levels), F.col("path")).alias("path"),
        ))
        paths = met.select("tree", F.explode(each).alias("x")).select("tree", "x.*")
    return paths


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda d, s: digest(F.concat(s["left"], d, s["right"])))


def manifest(df: DataFrame, leaves: Column, tampered: Column, id_col: str = "doc_id", tree_col: str = "lang", fanout: int = 2, levels: int = LEVELS) -> DataFrame:
    """One row per row of df: doc_id, leaf, tampered, subroot, root, path.

    ``leaves`` is each row's digest; ``tampered`` another digest, carried along for checks.  Trees
    are the values of tree_col, null among them and first, in the order of their UTF-8 bytes;
    leaves ascend by identifier, null first, and of equal identifiers by digest.  Rows equal in
    both may change places, which their digests can't tell.  path has the siblings' digests,
    joined, left and right of the node on each level, from leaf to root.  An empty table gives an
    empty result.  Texts of any length only take part by their digest.
    """
    if fanout < 2 or levels < 1:
        raise ValueError("fanout must be 2 or more, levels 1 or more")
    scratch = Scratch(df.sparkSession, "merkle")
    tree = F.col(f"`{tree_col}`").cast("string")
    rows = df.select(tree.isNotNull().alias("named"), F.coalesce(tree, F.lit("")).alias("name"), F.col(f"`{id_col}`").alias("doc_id"), leaves.alias("leaf"), tampered.alias("tampered"))
    rows, _ = numbered(rows, ["named", "name", "doc_id", "leaf"])
    # rows are numbered tree by tree, so a tree's first number makes its leaves' numbers from 0
    trees = rows.groupBy("named", "name").agg(F.min("row_number").alias("first"), F.count("*").alias("n"))
    trees, n_trees = numbered(trees, ["named", "name"])
    trees = scratch.table(trees.withColumnRenamed("row_number", "tree"), "trees")
    most = trees.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    nodes = looked_up(rows, trees, ["named", "name"], "row_number").select(
        "tree", (F.col("row_number") - F.col("first")).alias("at"), "n", F.col("leaf").alias("digest"), F.struct("doc_id", "tampered").alias("rows")
    )
    passes = climb(scratch, nodes, most, fanout, levels)
    subroots = passes[-1].select("tree", F.col("top").alias("subroot"))
    upper = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(n_trees).cast("long").alias("n"), F.col("subroot").alias("digest"), F.struct("tree").alias("rows"))
    roots = climb(scratch, upper, n_trees, fanout, levels)
    top = scratch.table(roots[-1].select("tree", F.array().cast(_PATH).alias("path")), "top")
    ends = descend(roots, top, fanout, levels).select(F.col("rows.tree").alias("tree"), F.col("digest").alias("subroot"), "path")
    ends = scratch.table(ends, "ends")
    found = descend(passes, ends.select("tree", "path"), fanout, levels).select("tree", "rows.doc_id", F.col("digest").alias("leaf"), "rows.tampered", "path")
    root = roots[-1].select("top").first()
    return looked_up(found, ends.select("tree", "subroot"), ["tree"], "leaf").withColumn("root", F.lit(root[0] if root else None).cast("string")).drop("tree")


def merkle_report(df: DataFrame) -> DataFrame:
    """One row per row of a table with the columns FIELDS: doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified, levels.

    proof_sha256 is the hash of all siblings from leaf to root.  Where TAMPERED divides the CRC-32 of
    the identifier, the fold starts from a leaf whose n_chars is one more (null stays null, and so
    does a null identifier's row); verified tells whether it ends at the root.
    """
    columns = [F.col(f"`{c}`") for c in FIELDS]
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    changed = [F.when(chosen, c + 1).otherwise(c) if name == "n_chars" else c for name, c in zip(FIELDS, columns)]
    found = manifest(df, leaf(columns), leaf(changed))
    both = F.transform("path", lambda s: F.concat(s["left"], s["right"]))
    return found.withColumn("folded_root", folded(F.col("tampered"), F.col("path"))).select(
        "doc_id", "leaf", "subroot", "root", digest(F.array_join(both, "")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), F.size("path").cast("long").alias("levels")
    )


SQL = """
with recursive t as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) crc
  from range(256) r(i)),
f as (select *, hex(doc_id::varchar) hx, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
  coalesce(strlen(text) || ':' || text, '-') as tail from documents),
c as (select f.*, xor(4294967295::bigint, list_reduce(list_transform(range(1, length(hx), 2), lambda i: ('0x' || substr(hx, i, 2))::bigint),
  lambda c, b: xor(c >> 8, t.crc[1 + (xor(c, b) & 255)]::bigint), 4294967295::bigint)) as check32 from f, t),
l as (select doc_id, lang, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
  sha256(head || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || tail) as other, check32 % 7 = 0 as chosen from c),
n as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by lang) as n from l),
up as (select lang, 0 as level, place, n, leaf as digest from n
  union all select lang, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by place)) from up where n > 1 group by lang, level, place // 2, n),
s as (select *, row_number() over (order by lang nulls first) - 1 as tree, count(*) over () as trees from (select lang, digest as subroot from up where n = 1)),
top as (select 0 as level, tree as place, trees as n, subroot as digest from s
  union all select level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by place)) from top where n > 1 group by level, place // 2, n),
w as (select doc_id, lang, leaf, place, n, 0 as level, '' as proof, case when chosen then other else leaf end as folded from n
  union all select w.doc_id, w.lang, w.leaf, w.place // 2, (w.n + 1) // 2, w.level + 1, proof || coalesce(u.digest, ''),
    sha256(case when w.place % 2 = 1 then u.digest || folded else folded || coalesce(u.digest, '') end)
  from w left join up u on u.lang is not distinct from w.lang and u.level = w.level and u.place = xor(w.place, 1::bigint) where w.n > 1),
w2 as (select doc_id, leaf, subroot, s.tree as place, s.trees as n, 0 as level, level as before, proof, folded from w join s on w.lang is not distinct from s.lang where w.n = 1
  union all select w.doc_id, w.leaf, w.subroot, w.place // 2, (w.n + 1) // 2, w.level + 1, before, proof || coalesce(u.digest, ''),
    sha256(case when w.place % 2 = 1 then u.digest || folded else folded || coalesce(u.digest, '') end)
  from w2 w left join top u on u.level = w.level and u.place = xor(w.place, 1::bigint) where w.n > 1)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified, before + level as levels
from w2, (select digest as root from top where n = 1) where n = 1
"""
