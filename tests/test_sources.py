import io
import json
import os
import subprocess

import pytest
import xxhash
from pyspark.sql import functions as F

from memloom import cli
from memloom.api import MemoryGraph
from memloom.cli import repository_turns
from memloom.config import FilterConfig, SplitConfig
from memloom.operators.embed import HashEmbedder, PandasEmbedder, embed_distinct
from memloom.sources import git, graph_json, symbols
from memloom.streaming.ingest import stream_notes
from memloom.tools import Tools, serve


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")

    def run(*args):
        subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=a@b.c", "-c", "commit.gpgsign=false", "-C", str(path), *args], check=True, capture_output=True)

    run("init", "-q")
    (path / "a.py").write_text("def one():\n    return 1\n\n\n" + "\n" * 20 + "def two():\n    return 2\n")
    run("add", ".")
    run("commit", "-qm", "feat: start\n\nSigned-off-by: Ann")
    (path / "a.py").write_text("def one():\n    return 11\n\n\n" + "\n" * 20 + "def two():\n    return 2\n")
    run("commit", "-qam", "fix: one\nfix: other")
    return str(path)


def test_git_sources(spark, repo):
    rows = git.commits(spark, repo).orderBy("pos").collect()
    assert [r["message"].split("\n")[0] for r in rows] == ["fix: one", "feat: start"] and rows[0]["author"] == "Ann" and rows[0]["parent"] == rows[1]["commit_id"]
    assert git.commits(spark, repo, 1).count() == 1
    h = {(r["commit_id"], r["start"]) for r in git.changed(spark, repo).collect()}
    assert (rows[1]["commit_id"], 0) in h and len(h) == 2
    with pytest.raises(RuntimeError):
        git.git(repo, "log", "no-such-ref")


def test_turns_by_symbol(spark, repo):
    text = repository_turns(spark, repo, FilterConfig("git-noise"), SplitConfig())
    assert sorted(r["content"] for r in text.collect()) == ["feat: start", "fix: one", "fix: other"]
    by_symbol = repository_turns(spark, repo, FilterConfig("git-noise"), SplitConfig(mode="ast")).collect()
    got = sorted((r["content"].split("\n")[0], r["symbol_id"]) for r in by_symbol)
    assert got == [("feat: start", "function_definition:one"), ("feat: start", "function_definition:two"), ("fix: one", "function_definition:one")]


def test_file_contents(spark, repo):
    rows = git.commits(spark, repo).select("commit_id").collect()
    files = spark.createDataFrame([(rows[0][0], "a.py"), (rows[1][0], "a.py"), (rows[0][0], "none.py"), ("0" * 40, "a.py")], "commit_id string, path string").coalesce(1)
    got = {(r["commit_id"], r["path"]): r["source"] for r in git.contents(files, repo).collect()}
    assert "return 11" in got[rows[0][0], "a.py"] and "return 1\n" in got[rows[1][0], "a.py"]
    assert got[rows[0][0], "none.py"] is None and got["0" * 40, "a.py"] is None


def test_times_on_the_command_line():
    assert cli.moment("1700000000") == 1_700_000_000 == cli.moment("2023-11-14T22:13:20Z") == cli.moment("2023-11-14T23:13:20+01:00")
    with pytest.raises(ValueError):
        cli.moment("2023-11-14T22:13:20")
    args = cli.parser().parse_args(["query", "--graph", "g", "--query", "q", "--time-start", "2023-11-14T22:13:20Z", "--time-window-days", "2"])
    assert args.time_start == 1_700_000_000 and args.time_window_days == 2


def test_note_as_json_and_time_ranges(spark, tmp_path, capsys):
    turns = spark.createDataFrame([(i + 1, "a", f"text {i}", f"c{i}", 1_700_000_000 + i * 100) for i in range(5)], "turn_id long, speaker string, content string, commit_id string, timestamp long")
    g = MemoryGraph(spark)
    g.ingest_turns(turns)
    g.build()
    path = str(tmp_path / "g")
    g.save(path)
    assert cli.main(["note", "--graph", path, "--note-id", "2", "--json"]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert shown["note_id"] == 2 and shown["raw_content"] == "text 2" and isinstance(shown["links"], list)
    assert cli.main(["note", "--graph", path, "--note-id", "99", "--json"]) == 1 and "Error" in capsys.readouterr().out
    assert cli.main(["query", "--graph", path, "--query", "text 1", "--min-score", "-1", "--json", "--time-start", "1700000100", "--time-end", "2023-11-14T22:15:00Z"]) == 0
    assert {r["commit_id"] for r in json.loads(capsys.readouterr().out)["results"]} <= {"c1"}


def test_learned_embedder_and_tables_from_the_command_line(spark, repo, tmp_path, capsys):
    out = str(tmp_path / "graph")
    assert cli.main(["ingest", "--repo", repo, "--out", out, "--embedder", "latent", "--form", "parquet"]) == 0
    assert cli.main(["update", "--repo", repo, "--out", out, "--form", "parquet"]) == 0 and "No new commits" in capsys.readouterr().out
    assert cli.main(["query", "--graph", out, "--query", "fix", "--json", "--min-score", "-1"]) == 0
    assert json.loads(capsys.readouterr().out)["results"]


def test_time_range_on_the_command_line_keeps_notes_that_reach_over_it(spark, tmp_path, capsys):
    turns = spark.createDataFrame([(i + 1, "a", f"text {i}", f"c{i}", 1_700_000_000 + i * 100) for i in range(3)], "turn_id long, speaker string, content string, commit_id string, timestamp long")
    g = MemoryGraph(spark)
    g.ingest_turns(turns)
    g.notes = g.notes.withColumn("sources", F.when(F.col("note_id") == 0, F.array_append("sources", F.struct(F.lit(9).cast("long").alias("turn_id"), F.lit("c0").alias("commit_id"), F.lit(1_700_009_000).cast("long").alias("ts")))).otherwise(F.col("sources")))
    g.save(str(tmp_path / "g"))
    assert cli.main(["query", "--graph", str(tmp_path / "g"), "--query", "text", "--min-score", "-1", "--json", "--time-start", "1700005000", "--time-end", "1700006000"]) == 0
    assert [r["commit_id"] for r in json.loads(capsys.readouterr().out)["results"]] == ["c0"]


def test_hash_embedder_by_brute_force(spark):
    """The value of a dimension is the hash of text and dimension, chained, over the range of 64-bit numbers."""
    df = HashEmbedder(5).embed(spark.createDataFrame([("some text",), ("",)], "t string"), "t", "v")
    for r in df.collect():
        for i, x in enumerate(r["v"]):
            h = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), xxhash.xxh64_intdigest(r["t"].encode(), 42))
            assert abs(x - (h - (1 << 64) * (h >> 63)) / 2**63) < 1e-6


def test_parsers_by_extension():
    r = symbols.Registry()
    rust = 'pub trait T {\n  fn f(&self);\n}\nimpl T for X {\n  fn g() { let s = "}"; }\n}\nstruct P;\n'
    assert [(k, n) for k, n, *_ in r.get("rs")(rust)] == [("trait_item", "T"), ("function_item", "g"), ("struct_item", "P")]
    ts = "export interface A {\n  x: number\n}\nclass B {\n  run(x: number): void {\n    if (x) { go(); }\n  }\n}\nfunction c() {}\n"
    assert [(k, n, a, b) for k, n, a, b in r.get("ts")(ts)] == [("interface_declaration", "A", 0, 2), ("class_declaration", "B", 3, 7), ("method_definition", "run", 4, 6), ("function_declaration", "c", 8, 8)]
    assert r.get("go") is None
    r.register("go", lambda source: [])
    assert r.get("go")("x") == []


def test_embedders(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "content string")
    rows = embed_distinct(df, HashEmbedder(16)).collect()
    assert len(rows) == 4 and all(len(r["embedding"]) == 16 and all(-1 <= x <= 1 for x in r["embedding"]) for r in rows)
    assert embed_distinct(df.dropna(), PandasEmbedder(lambda: lambda ts: [[float(len(t))] for t in ts])).where("embedding[0] = 1").count() == 3


def test_stream_is_idempotent(spark, tmp_path):
    schema = "turn_id long, content string, commit_id string, timestamp long, symbol_id string, ast_node_type string, file_path string"
    turns = spark.createDataFrame([(i, f"text {i}", f"c{i % 3}", i, None, None, None) for i in range(1, 7)], schema)
    turns.write.parquet(str(tmp_path / "in/1"))
    for n in range(2):
        source = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in/*"))
        stream_notes(source, str(tmp_path / "notes"), str(tmp_path / f"state{n}"), HashEmbedder(4)).awaitTermination()
    notes = spark.read.parquet(str(tmp_path / "notes"))
    assert notes.count() == 6 and notes.agg(F.max("note_id")).first()[0] == 5


TURNS = "turn_id long, content string, commit_id string, timestamp long, symbol_id string, ast_node_type string, file_path string"


def test_stream_takes_a_commit_in_parts_and_turns_that_come_again_once(spark, tmp_path):
    def arrive(name, rows):
        spark.createDataFrame([(*r, None, None, None) for r in rows], TURNS).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        source = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        stream_notes(source, str(tmp_path / "notes"), str(tmp_path / "state"), HashEmbedder(4)).awaitTermination()
        return sorted(((r["raw_content"], r["sources"][0]["commit_id"]) for r in spark.read.parquet(str(tmp_path / "notes")).collect()), key=lambda r: r[0])

    arrive("1", [(1, "a", "c1", 10), (2, "b", "c1", 10), (3, "x", None, 11), (4, "b", "c1", 10)])
    first = run()
    assert first == [("a", "c1"), ("b", "c1"), ("b", "c1"), ("x", None)]
    arrive("2", [(5, "c", "c1", 10), (6, "a", "c1", 10), (7, "d", "c2", 12), (8, "x", None, 11)])
    second = run()
    assert second == sorted([*first, ("c", "c1"), ("d", "c2"), ("x", None)], key=lambda r: r[0])
    # the last batch runs again, as after a failure between its notes and its commit
    (last,) = (tmp_path / "state/commits").glob("1")
    last.unlink()
    for crc in (tmp_path / "state/commits").glob(".1.crc"):
        crc.unlink()
    assert sorted(run(), key=repr) == sorted(second, key=repr)
    ids = [r["note_id"] for r in spark.read.parquet(str(tmp_path / "notes")).collect()]
    assert sorted(ids) == list(range(7))


def test_touched_by_brute_force_and_without_pairs(spark):
    import random

    rng = random.Random(3)
    found, hunks = [], []
    for i in range(300):
        a = rng.randrange(600)
        found.append((rng.choice("xy"), "f", "k", f"n{i}", a, a + rng.choice([0, 3, 40, 500]), i, "C"))
        b = rng.randrange(600)
        hunks.append((rng.choice("xy"), "f", b, b + rng.choice([0, 1, 9, 300])))
    found += [found[0], ("x", "f", "k", "none", None, 3, 0, "C"), ("x", "f", "k", "none", 3, None, 0, "C"), ("z", "f", "k", "alone", 0, 9, 0, "C"), ("x", None, "k", "q", 0, 9, 0, "C")]
    hunks += [("x", "f", None, 5), ("x", "f", 5, None), ("x", None, 0, 9)]
    hunks = hunks[::7] + hunks[-3:]
    s = spark.createDataFrame(found, "commit_id string, path string, kind string, name string, start long, end long, preorder long, category string")
    h = spark.createDataFrame(hunks, "commit_id string, path string, start long, end long")
    got = sorted((r["commit_id"], r["name"]) for r in symbols.touched(s, h).collect())
    want = sorted({(f[0], f[3]) for f in found for k in hunks if f[:2] == k[:2] and None not in (*f[:6], *k) and f[4] < k[3] and f[5] >= k[2]})
    assert got == want and 20 < len(want) < 290
    # one file of very many symbols and hunks: pairs would be 1.6e9
    many = spark.range(40_000).select(F.lit("c").alias("commit_id"), F.lit("p").alias("path"), F.lit("k").alias("kind"), F.concat(F.lit("n"), "id").alias("name"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + 2).alias("end"), F.col("id").alias("preorder"), F.lit("C").alias("category"))
    cuts = spark.range(40_000).select(F.lit("c").alias("commit_id"), F.lit("p").alias("path"), (F.col("id") * 6).alias("start"), (F.col("id") * 6 + 1).alias("end"))
    assert symbols.touched(many, cuts).count() == 20_000


def test_tools_and_server(spark):
    g = MemoryGraph(spark, HashEmbedder(8))
    turns = spark.createDataFrame([(i, f"text | {i}", f"c{i}", 1_700_000_000 + i, "fn:x" if i % 2 else None, "IMPLEMENTATION") for i in range(1, 6)], "turn_id long, content string, commit_id string, timestamp long, symbol_id string, ast_node_type string")
    g.ingest_turns(turns)
    t = Tools(g)
    assert "| fn:x | IMPLEMENTATION | 3 |" in t.structural_hotspots()
    assert t.symbol_history("fn:x", 2).startswith("Showing last 2 of 3.")
    assert t.call("inspect_note", {"note_id": 99}).startswith("Error:")
    ask = [{"id": 1, "method": "initialize"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "graph_summary"}}, {"id": 4, "method": "x"}, {"method": "note"}]
    out = io.StringIO()
    serve(t, io.StringIO("".join(json.dumps(a) + "\n" for a in ask) + "no json\n"), out)
    got = [json.loads(line) for line in out.getvalue().splitlines()]
    assert len(got) == 5 and len(got[1]["result"]["tools"]) == 6 and "- notes: 5" in got[2]["result"]["content"][0]["text"] and got[3]["error"]["code"] == -32601


_GRAPH_TEXT = 'ends in },{"note_id":5}, then "note_id" },\n    {\n  "'


def _saved_object() -> dict:
    notes = []
    for i in range(300):
        text = ["note_id", "},{", _GRAPH_TEXT, '"notes":[{', "ü\u2028]} ", ""][i % 6]
        notes.append({
            "note_id": 3 * i, "raw_content": text, "embedding": [i / 4, 1.0], "norm": 1.5, "source_turn_ids": [i, i + 1], "source_commit_ids": [None, "c"], "source_timestamps": [7, 8],
            "related_note_links": [[3 * ((i + 1) % 300), 0.5]] if i % 2 else [], "symbol_id": text or None, "ast_node_type": None, "file_path": "}", "structural_links": [0, 0] if i == 5 else [],
        })
    notes.append({**notes[7], "raw_content": "again"})
    return {
        "metadata": {"format_version": "other-v1", "},{": 'x"notes":['}, "notes": notes, "cluster_labels": [i % 3 for i in range(300)],
        "cluster_centroids": {"0": [1.0, 2.0], "1": [0.5, 0.0], "2": [1e-7, 3.0]}, "cluster_centroid_norms": {"0": 1.0, "1": 0.5, "2": 3.0}, "long_range_links": [[0, 3, 0.9], [3, 6, 0.25]],
    }


def _shown(tables):
    rows = {n: sorted((str(r.asDict(True)) for r in getattr(tables, n).drop("pos").collect())) for n in ("clusters", "centroids", "links", "related", "structural")}
    notes = tables.notes.select(*sorted(tables.notes.columns))
    return rows | {"notes": sorted(str(r.asDict(True)) for r in notes.collect()), "metadata": {k: v for k, v in tables.metadata.items() if k == "format_version"}}


@pytest.mark.parametrize("layout", [{"separators": (",", ":")}, {"indent": 2}, {}])
def test_saved_graph_is_read_in_byte_ranges_however_it_is_laid_out(spark, tmp_path, layout):
    given = _saved_object()
    path = tmp_path / "g.json"
    path.write_text(json.dumps(given, ensure_ascii=False, **layout))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        between = graph_json.separator(spark, str(path))
        assert between and spark.read.option("lineSep", between).text(str(path)).rdd.getNumPartitions() > 8
        got = graph_json.load(spark, str(path))
        notes = {r["note_id"]: r for r in got.notes.collect()}
        assert sorted(notes) == [3 * i for i in range(300)] and notes[21]["raw_content"] == "again"
        for n in given["notes"][8:300]:
            row = notes[n["note_id"]]
            assert (row["raw_content"], row["symbol_id"], list(row["embedding"])) == (n["raw_content"], n["symbol_id"], n["embedding"])
            assert [tuple(s) for s in row["sources"]] == list(zip(n["source_turn_ids"], n["source_commit_ids"], n["source_timestamps"]))
        assert {(r["note_id"], r["label"]) for r in got.clusters.collect()} == {(3 * i, i % 3) for i in range(300)}
        assert {(r["a"], r["b"], r["score"]) for r in got.links.collect()} == {(0, 3, 0.9), (3, 6, 0.25)} and got.centroids.count() == 3
        assert [tuple(r) for r in got.structural.collect()] == [(15, 0, 2)] and got.related.count() == 150
        # written again, the file is one JSON object that says the same, with whole numbers where the format has them
        graph_json.save(got, str(tmp_path / "again"))
        file, = (tmp_path / "again").glob("part-*")
        again = json.loads(file.read_text())
        assert again["notes"][1]["related_note_links"] == [[6, 0.5]] and isinstance(again["notes"][1]["related_note_links"][0][0], int)
        assert again["cluster_labels"] == given["cluster_labels"] and again["long_range_links"] == given["long_range_links"] and again["metadata"]["},{"] == 'x"notes":['
        assert [n["note_id"] for n in again["notes"]] == sorted(notes) and again["notes"][5]["structural_links"] == [0, 0]
        assert _shown(graph_json.load(spark, str(tmp_path / "again"))) == _shown(got)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_saved_graphs(spark, tmp_path, n):
    given = _saved_object()
    given = {**given, "notes": given["notes"][:n], "cluster_labels": [0] * n, "long_range_links": None, "cluster_centroids": None, "cluster_centroid_norms": None}
    (tmp_path / "g.json").write_text(json.dumps(given))
    got = graph_json.load(spark, str(tmp_path / "g.json"))
    assert got.notes.count() == n == got.clusters.count() and got.links.count() == 0 and got.centroids.count() == 0
    graph_json.save(got, str(tmp_path / "again"))
    assert _shown(graph_json.load(spark, str(tmp_path / "again"))) == _shown(got)


def test_a_broken_note_is_an_error(spark, tmp_path):
    text = json.dumps(_saved_object(), separators=(",", ":"))
    at = text.index('"embedding"', len(text) // 2)
    (tmp_path / "g.json").write_text(text[:at] + text[at + 5 :])
    with pytest.raises(Exception, match="(?i)malformed"):
        graph_json.load(spark, str(tmp_path / "g.json")).notes.count()


@pytest.fixture()
def history(tmp_path):
    path = tmp_path / "repo"
    path.mkdir()
    made = []

    def commit(name, text, ts):
        (path / name).parent.mkdir(exist_ok=True)
        (path / name).write_text(text)
        env = {**os.environ, "GIT_COMMITTER_DATE": f"{ts} +0000", "GIT_AUTHOR_DATE": f"{ts} +0000"}
        run = lambda *a: subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=a@b.c", "-c", "commit.gpgsign=false", "-C", str(path), *a], check=True, capture_output=True, env=env).stdout.decode().strip()
        if not made:
            run("init", "-q")
        run("add", ".")
        run("commit", "-qm", f"m{len(made)} {name}")
        made.append(run("rev-parse", "HEAD"))

    return str(path), commit, made


def test_filters_reach_the_git_source_and_change_neither_places_nor_the_cut(spark, history, monkeypatch):
    path, commit, made = history
    for i in range(12):
        # the clock of the seventh was wrong
        commit(["a.py", "dir/b.py", "dir/a[1].py"][i % 3], "x\n" * (i + 1), 1_700_000_000 + (i * 100 if i != 6 else -5000))
    every = git.commits(spark, path, 10).collect()
    for low, high in ((1_700_000_500, 1_700_001_000), (0, 1_700_000_300), (5, 4)):
        kept = git.commits(spark, path, 10).where((F.col("ts") >= low) & (F.col("ts") < high))
        assert sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in every if low <= r["ts"] < high)
    one = git.commits(spark, path).where(F.col("commit_id") == made[4])
    assert [r["message"].strip() for r in one.collect()] == ["m4 dir/b.py"] and one.rdd.getNumPartitions() == 1
    hunks = git.changed(spark, path).collect()
    for names in (["a.py"], ["dir"], ["dir/a[1].py", "a.py"], ["none"]):
        got = git.changed(spark, path).where(F.col("path").isin(names))
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in hunks if r["path"] in names)

    reader = git._HunkReader({"path": path})
    asked = [git.EqualTo(("path",), "a.py"), git.GreaterThan(("ts",), 3), git.EqualTo(("commit_id",), made[3])]
    assert list(reader.pushFilters(asked)) == asked[:2] and reader.paths == ["a.py"] and [p.ids for p in reader.partitions()] == [[made[3]]]
    reader = git._CommitReader({"path": path, "commits_per_partition": "3"})
    assert list(reader.pushFilters([git.LessThan(("ts",), 1_700_000_300)])) == [] and [p.places for p in reader.partitions()] == [[5, 9, 10], [11]]


def test_new_commits_as_a_stream_go_on_after_a_restart(spark, history, tmp_path):
    path, commit, made = history
    commit("a.py", "1", 1_700_000_000)
    commit("a.py", "2", 1_700_000_100)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        query = git.new_commits(spark, path).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        query.awaitTermination()
        return sorted((r["commit_id"], r["pos"]) for r in spark.read.parquet(out).collect())

    assert run() == sorted([(made[1], 0), (made[0], 1)])
    assert len(run()) == 2  # nothing new
    commit("b.py", "1", 1_600_000_000)
    assert run() == sorted([(made[1], 0), (made[0], 1), (made[2], 0)])
    # into notes
    turns = git.new_commits(spark, path).select(F.col("pos").alias("turn_id"), F.col("author").alias("speaker"), F.col("message").alias("content"), "commit_id", F.col("ts").alias("timestamp"), *[F.lit(None).cast("string").alias(c) for c in ("symbol_id", "ast_node_type", "file_path")])
    table, place = str(tmp_path / "notes"), str(tmp_path / "place")
    for expected in (3, 4):
        stream_notes(turns, table, place).awaitTermination()
        assert spark.read.parquet(table).select(F.explode("sources.commit_id")).distinct().count() == expected
        commit("b.py", f"{expected}", 1_700_000_300)
