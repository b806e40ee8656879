"""Symbols of source files, and which of them a commit changed.

Python files are parsed by the standard library, the brace languages by ``grammar``.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.sources import grammar

API, IMPLEMENTATION = "API_DEFINITION", "IMPLEMENTATION"
Parser = Callable[[str], list[tuple[str, str, int, int]]]
API_KINDS = {"trait_item", "interface_declaration"}
#: Rows of a file that are swept together.
BIN_ROWS = 128


def parse_python(source: str) -> list[tuple[str, str, int, int]]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out: list[tuple[str, str, int, int]] = []

    def visit(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(("function_definition", child.name, child.lineno - 1, child.end_lineno - 1))
            elif isinstance(child, ast.ClassDef):
                out.append(("class_definition", child.name, child.lineno - 1, child.end_lineno - 1))
            visit(child)

    visit(tree)
    return out


class Registry:
    """Parsers by file extension; others can be added."""

    def __init__(self) -> None:
        self.parsers: dict[str, Parser] = {
            "py": parse_python,
            "rs": grammar.parse_rust,
            "ts": grammar.script_parser(jsx=False, typed=True),
            "tsx": grammar.script_parser(jsx=True, typed=True),
            "js": grammar.script_parser(jsx=True, typed=False),
            "jsx": grammar.script_parser(jsx=True, typed=False),
        }

    def register(self, ext: str, parser: Parser) -> None:
        self.parsers[ext] = parser

    def get(self, ext: str) -> Parser | None:
        return self.parsers.get(ext)


def symbols(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """(commit_id, path, kind, name, start, end, preorder, category) of files (commit_id, path, source)."""
    registry = registry or Registry()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for commit, path, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
                parser = registry.get((path or "").rsplit(".", 1)[-1])
                for n, (kind, name, start, end) in enumerate(parser(source or "") if parser else []):
                    rows.append((commit, path, kind, name, start, end, n, API if kind in API_KINDS else IMPLEMENTATION))
            names = ["commit_id", "path", "kind", "name", "start", "end", "preorder", "category"]
            kinds = [pa.string()] * 4 + [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=names)

    schema = "commit_id string, path string, kind string, name string, start long, end long, preorder long, category string"
    return files.select("commit_id", "path", "source").mapInArrow(run, schema)


def touched(found: DataFrame, hunks: DataFrame, rows: int = BIN_ROWS) -> DataFrame:
    """Symbols that meet a changed range of their file, each row once: start < hunk end and end >= hunk start.

    A sweep over the rows of each file, cut into bins: of the hunks that start in a symbol's last
    bin at most ``rows`` remain, one for each row they start at, and of those that start in earlier
    bins the furthest end decides.  So a file of any number of symbols and hunks makes no pairs.
    Ranges may be empty; nulls meet nothing.
    """
    file = ["commit_id", "path"]
    at = lambda c: F.floor(F.col(c) / rows).alias("_bin")
    ends = hunks.where("start is not null").groupBy(*file, at("start"), F.col("start").alias("_from")).agg(F.max("end").alias("_to"))
    bins = ends.groupBy(*file, "_bin").agg(F.max("_to").alias("_most"), F.collect_list(F.struct("_from", "_to")).alias("_hunks"))
    symbols_ = found.distinct().withColumn("_bin", at("end"))
    wanted = symbols_.select(*file, "_bin").where("_bin is not null").distinct()
    # a row for each bin that has symbols or hunks: the furthest end of all bins before it
    grid = bins.unionByName(wanted, allowMissingColumns=True).groupBy(*file, "_bin").agg(F.max("_most").alias("_most"), F.first("_hunks", ignorenulls=True).alias("_hunks"))
    before = F.max("_most").over(Window.partitionBy(*file).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    met = symbols_.join(grid.select(*file, "_bin", before.alias("_before"), "_hunks"), [*file, "_bin"])
    near = F.exists("_hunks", lambda h: (h["_from"] <= F.col("end")) & (h["_to"] > F.col("start")))
    return met.where((F.col("_before") > F.col("start")) | near).select(*found.columns)


def changed_symbols(found: DataFrame, hunks: DataFrame) -> DataFrame:
    """Each symbol a commit touched, once for the commit, where it comes first."""
    named = touched(found, hunks).withColumn("symbol_id", F.concat_ws(":", "kind", "name"))
    nth = F.row_number().over(Window.partitionBy("commit_id", "symbol_id").orderBy("path", "preorder"))
    return named.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def symbol_turns(commits: DataFrame, changed: DataFrame, text_turns: DataFrame) -> DataFrame:
    """Turns of commits: one for each changed symbol, with the whole message; commits without any keep their text turns."""
    by_symbol = commits.join(changed, "commit_id").select("commit_id", F.col("author").alias("speaker"), F.col("filtered").alias("content"), F.col("ts").alias("timestamp"), "symbol_id", F.col("category").alias("ast_node_type"), F.col("path").alias("file_path"))
    rest = text_turns.join(changed.select("commit_id").distinct(), "commit_id", "left_anti")
    none = F.lit(None).cast("string")
    return by_symbol.unionByName(rest.select("commit_id", "speaker", "content", "timestamp", none.alias("symbol_id"), none.alias("ast_node_type"), none.alias("file_path")))
