"""Command line: ingest, update, query, note, mcp, hotspots, history."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.api import MemoryGraph
from memloom.config import DAY, BuildConfig, FilterConfig, SplitConfig, TemporalConfig, days_to_seconds, parse_temporal_mode
from memloom.operators import analytics, retrieve, segments
from memloom.operators.latent import LatentEmbedder, LatentModel
from memloom.operators.settle import settled
from memloom.sources import git, graph_json, symbols
from memloom.tools import Tools, serve


def session() -> SparkSession:
    return SparkSession.builder.appName("memloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def stored(spark: SparkSession, path: str) -> MemoryGraph:
    """A saved graph, with the embedder that was learned with it, if any."""
    learned, form = path + ".embedder", "parquet" if os.path.isdir(os.path.join(path, "metadata")) else "json"
    return MemoryGraph.load(spark, path, LatentEmbedder(LatentModel.load(spark, learned)) if os.path.exists(learned) else None, form)


def repository_turns(spark: SparkSession, repo: str, filters: FilterConfig, split: SplitConfig, max_commits: int | None = None) -> DataFrame:
    """Turns of a repository's commits, latest first; mode ``ast`` divides commits by the symbols they change."""
    commits = segments.kept_messages(git.commits(spark, repo, max_commits), filters)
    turns = segments.segments_to_turns(segments.split_messages(commits, split))
    none = F.lit(None).cast("string")
    if split.mode == "ast":
        hunks = git.changed(spark, repo, max_commits)
        files = hunks.select("commit_id", "path").distinct()

        found = symbols.symbols(git.contents(files, repo))
        return symbols.symbol_turns(commits, symbols.changed_symbols(found, hunks), turns)
    return turns.select("commit_id", "speaker", "content", "timestamp", none.alias("symbol_id"), none.alias("ast_node_type"), none.alias("file_path"))


def ingest(args: argparse.Namespace) -> int:
    spark = session()
    filters = FilterConfig(args.git_filter_preset, tuple(args.git_filter_drop or ()), args.git_filter_case_insensitive)
    split = SplitConfig(args.git_commit_split_mode, args.git_commit_split_max_segments, args.git_commit_split_min_confidence)
    known = os.path.exists(args.out) and (args.append or args.incremental)
    graph = stored(spark, args.out) if known else MemoryGraph(spark)
    turns = repository_turns(spark, args.repo, filters, split, args.max_commits)
    if args.embedder == "latent" and not known:
        turns = settled(turns)
        graph.embedder = LatentEmbedder(LatentModel.fit(turns, "content"))
        graph.embedder.model.save(spark, args.out + ".embedder")
    if args.incremental:
        if not graph.update(turns):
            print("No new commits.")
            return 0
    else:
        from memloom.operators import notes as N

        graph.ingest_turns(N.renumbered(turns, graph.notes, ["timestamp", "commit_id", "content"]))
    graph.resolve_structural_links()
    config = BuildConfig().merged(graph.metadata if known else None, spectral_dims=args.num_spectral_dims, min_clusters=args.min_clusters, max_clusters=args.max_clusters)
    graph.build(config, incremental=args.incremental)
    target = args.out + ".new" if known else args.out
    graph.save(target, args.form)
    if known:
        import shutil

        # at every moment one of the two is whole
        os.rename(args.out, args.out + ".old")
        os.rename(target, args.out)
        shutil.rmtree(args.out + ".old")
    print(f"{graph.notes.count()} notes, labels {'present' if not graph.clusters.isEmpty() else 'absent'}")
    return 0


def update(args: argparse.Namespace) -> int:
    args.append = args.incremental = True
    return ingest(args)


def moment(text: str) -> int:
    """Epoch seconds, given as such or as an RFC 3339 time."""
    if text.lstrip("-").isdigit():
        return int(text)
    got = datetime.fromisoformat(text)
    if got.tzinfo is None:
        raise ValueError("a time needs its offset")
    return int(got.timestamp())


def note(args: argparse.Namespace) -> int:
    if not args.json:
        return tool("inspect_note", "note_id", "links_k")(args)
    graph = stored(session(), args.graph)
    try:
        found = analytics.note(graph.notes.drop("embedding"), graph.clusters, args.note_id).toJSON().first()
    except KeyError as error:
        print(f"Error: {error.args[0]}")
        return 1
    links = [{"note_id": r["note_id"], "score": r["score"]} for r in graph.related_notes(args.note_id, args.links_k or 10).collect()]
    print(json.dumps({**json.loads(found), "links": links}))
    return 0


def query(args: argparse.Namespace) -> int:
    graph = stored(session(), args.graph)
    cfg = TemporalConfig(not args.no_temporal, args.temporal_weight, parse_temporal_mode(args.temporal_mode), int(args.temporal_half_life_days * DAY), now=args.temporal_now)
    start, end = args.time_start, args.time_end
    if args.time_window_days is not None:
        end = end or args.temporal_now or int(time.time())
        start = end - days_to_seconds(args.time_window_days)
    graph.notes = retrieve.in_time_range(graph.notes, start, end)
    found = graph.query(args.query, top_k=args.top_k, candidate_k=args.candidate_k, min_score=args.min_score, cfg=cfg, keyword_weight=args.keyword_weight, file_filter=args.file, symbol_filter=args.symbol)
    hits = retrieve.group_by_commit(retrieve.with_rank(found))
    top = graph.long_range_links(args.links_k or 5)
    if args.json:
        print(graph_json.query_payload(hits, top).first()["payload"])
        return 0
    texts = graph.notes.select("note_id", F.substring("raw_content", 1, 120).alias("snippet"))
    for r in hits.join(texts, "note_id").orderBy("position").collect():
        print(f"{r['position']}. [{r['final_score']:.4f}] note {r['note_id']} {r['commit_id'] or ''} {r['snippet']!r} (+{len(r['contextual_hits'])})")
        if args.links_k:
            for other in graph.related_notes(r["note_id"], args.links_k).collect():
                print(f"     {other['score']:.4f} note {other['note_id']}")
    return 0


def tool(name: str, *keys: str):
    def run(args: argparse.Namespace) -> int:
        text = Tools(stored(session(), args.graph)).call(name, {k: getattr(args, k) for k in keys if getattr(args, k) is not None})
        print(text)
        return int(text.startswith("Error:"))

    return run


def mcp(args: argparse.Namespace) -> int:
    serve(Tools(stored(session(), args.graph)))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="memloom")
    commands = top.add_subparsers(required=True)
    for name, run in (("ingest", ingest), ("update", update)):
        p = commands.add_parser(name)
        p.add_argument("--repo", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--max-commits", type=int)
        p.add_argument("--append", action="store_true")
        p.add_argument("--include-diff", action="store_true", help="accepted and without effect: messages alone are ingested")
        p.add_argument("--incremental", action="store_true")
        p.add_argument("--git-filter-preset")
        p.add_argument("--git-filter-drop", action="append")
        p.add_argument("--git-filter-case-insensitive", action="store_true")
        p.add_argument("--git-commit-split-mode", default="auto")
        p.add_argument("--git-commit-split-max-segments", type=int, default=6)
        p.add_argument("--git-commit-split-min-confidence", type=float, default=0.75)
        p.add_argument("--embedder", choices=["hash", "latent"], default="hash", help="latent: learned from the texts of the first ingestion, and kept beside the graph")
        p.add_argument("--form", choices=["json", "parquet"], default="json")
        p.add_argument("--num-spectral-dims", type=int)
        p.add_argument("--min-clusters", type=int)
        p.add_argument("--max-clusters", type=int)
        p.set_defaults(run=run)
    p = commands.add_parser("query")
    p.add_argument("--graph", required=True)
    p.add_argument("--query", required=True)
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--candidate-k", type=int)
    p.add_argument("--min-score", type=float, default=retrieve.MIN_SCORE)
    p.add_argument("--keyword-weight", type=float, default=retrieve.KEYWORD_WEIGHT)
    p.add_argument("--file")
    p.add_argument("--symbol")
    p.add_argument("--links-k", type=int)
    p.add_argument("--json", action="store_true")
    p.add_argument("--no-temporal", action="store_true")
    p.add_argument("--temporal-weight", type=float, default=0.20)
    p.add_argument("--temporal-mode", default="exponential")
    p.add_argument("--temporal-half-life-days", type=float, default=14.0)
    p.add_argument("--temporal-now", type=moment, help="epoch seconds or an RFC 3339 time")
    p.add_argument("--time-start", type=moment, help="epoch seconds or an RFC 3339 time")
    p.add_argument("--time-end", type=moment, help="epoch seconds or an RFC 3339 time")
    p.add_argument("--time-window-days", type=float)
    p.set_defaults(run=query)
    p = commands.add_parser("note")
    p.add_argument("--graph", required=True)
    p.add_argument("--note-id", type=int, required=True)
    p.add_argument("--links-k", type=int)
    p.add_argument("--json", action="store_true")
    p.set_defaults(run=note)
    p = commands.add_parser("hotspots")
    p.add_argument("--graph", required=True)
    p.add_argument("--top-k", type=int, default=10)
    p.set_defaults(run=tool("structural_hotspots", "top_k"))
    p = commands.add_parser("history")
    p.add_argument("--graph", required=True)
    p.add_argument("--symbol-id", required=True)
    p.add_argument("--limit", type=int)
    p.set_defaults(run=tool("symbol_history", "symbol_id", "limit"))
    p = commands.add_parser("mcp")
    p.add_argument("--graph", required=True)
    p.set_defaults(run=mcp)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
