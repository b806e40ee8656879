"""The six tools over a loaded graph, as functions that return Markdown, and a line-based JSON-RPC server for them."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Sequence
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.api import MemoryGraph
from memloom.config import clamp_top_k
from memloom.functions import text as X
from memloom.operators import analytics


def table(df: DataFrame, columns: Sequence[str], heads: Sequence[str]) -> str:
    """A Markdown table of a result, of 100 rows at most."""
    rows = df.select(*columns).limit(100).collect()
    shown = [[f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v).replace("|", "\\|") for v in r] for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in [list(heads), ["---"] * len(heads), *shown])


class Tools:
    def __init__(self, graph: MemoryGraph):
        self.graph = graph

    def query_graph(self, query: str, top_k: int | None = None, min_score: float = 0.0, links_k: int | None = None) -> str:
        k = clamp_top_k(top_k, 5, 20)
        found = self.graph.search(query, k, min_score).limit(k)
        texts = self.graph.notes.select("note_id", X.compact_snippet(F.col("raw_content"), 140).alias("snippet"))
        joined = found.join(texts, "note_id").orderBy(F.col("final_score").desc(), "note_id")
        out = table(joined, ["note_id", "final_score", "snippet"], ["note", "score", "text"])
        if links_k is not None:
            for row in joined.select("note_id").collect():
                out += f"\n\nRelated to {row[0]}:\n" + table(self.graph.related_notes(row[0], clamp_top_k(links_k, 10, 25)), ["note_id", "score"], ["note", "score"])
        return out

    def inspect_note(self, note_id: int, links_k: int | None = None, snippet: int | None = None) -> str:
        about = analytics.note(self.graph.notes, self.graph.clusters, note_id)
        related = analytics.inspect_note(self.graph.notes, self.graph.links, note_id, links_k, snippet).orderBy(F.col("score").desc(), "related_id")
        return table(about, ["note_id", "label", "context"], ["note", "cluster", "text"]) + "\n\n" + table(related, ["related_id", "score", "snippet"], ["related", "score", "text"])

    def long_range_links(self, top_k: int | None = None) -> str:
        return table(analytics.numbered_links(self.graph.links, top_k).orderBy("rank"), ["rank", "a", "b", "score"], ["#", "a", "b", "score"])

    def graph_summary(self) -> str:
        one = analytics.graph_summary(self.graph.notes, self.graph.clusters, self.graph.centroids, self.graph.links)
        return "\n".join(f"- {k}: {v}" for k, v in one.first().asDict().items())

    def structural_hotspots(self, top_k: int = 10) -> str:
        return table(analytics.hotspots(self.graph.notes, top_k), ["symbol_id", "category", "churn"], ["symbol", "category", "churn"])

    def symbol_history(self, symbol_id: str, limit: int | None = None) -> str:
        found = analytics.symbol_history(self.graph.notes, symbol_id, limit)
        total = found.first()
        if total is None:
            return f"No history of {symbol_id}."
        shown = found.count()
        return f"Showing last {shown} of {total['total']}.\n\n" + table(found, ["date", "commit_id", "note_id", "snippet"], ["date", "commit", "note", "text"])

    def names(self) -> dict[str, Callable[..., str]]:
        return {n: getattr(self, n) for n in ("query_graph", "inspect_note", "long_range_links", "graph_summary", "structural_hotspots", "symbol_history")}

    def call(self, name: str, arguments: dict) -> str:
        """A tool's answer; whatever goes wrong is told as text."""
        try:
            return self.names()[name](**arguments)
        except Exception as e:
            return f"Error: {e}"


def serve(tools: Tools, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    """JSON-RPC, one message a line: initialize, tools/list and tools/call."""
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            print(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}), file=sink, flush=True)
            continue
        method, params, id_ = message.get("method"), message.get("params") or {}, message.get("id")
        if id_ is None:
            continue
        if method == "initialize":
            result = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "memloom", "version": "1"}}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "inputSchema": {"type": "object"}} for n in tools.names()]}
        elif method == "tools/call":
            result = {"content": [{"type": "text", "text": tools.call(params.get("name", ""), params.get("arguments") or {})}]}
        else:
            print(json.dumps({"jsonrpc": "2.0", "id": id_, "error": {"code": -32601, "message": f"no method {method}"}}), file=sink, flush=True)
            continue
        print(json.dumps({"jsonrpc": "2.0", "id": id_, "result": result}), file=sink, flush=True)
