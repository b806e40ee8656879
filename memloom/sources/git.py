"""Git history as DataFrames: commits, and the row ranges each commit changed."""

from __future__ import annotations

import operator
import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

_FORMAT = "%H%x1f%P%x1f%an%x1f%ct%x1f%B"
_HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")
#: The tree of an empty repository, which first commits are compared with.
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def git(repo: str, *args: str, given: str | None = None) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, input=None if given is None else given.encode())
    if done.returncode:
        raise RuntimeError(done.stderr.decode(errors="replace").strip())
    return done.stdout.decode(errors="replace")


class Range(InputPartition):
    """Commits: their places in the walk, and their ids."""

    def __init__(self, places: list[int], ids: list[str]):
        super().__init__((places, ids))
        self.places, self.ids = places, ids


_SIGNS = {GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, EqualTo: operator.eq}


def _records(repo: str, ids: list[str]) -> Iterator[tuple]:
    if not ids:
        return
    # by their ids, so that no partition walks the history again
    out = git(repo, "log", "-z", "--no-walk=unsorted", "--stdin", f"--format={_FORMAT}", given="\n".join(ids) + "\n")
    for record in (r for r in out.split("\0") if r.strip()):
        sha, parents, author, ts, message = record.lstrip("\n").split("\x1f", 4)
        yield sha, (parents.split() or [None])[0], author or "unknown", int(ts), message


class _CommitReader(DataSourceReader):
    """Reads the commits that pass the pushed filters; what max_commits cuts off and the places of
    commits are decided before, so no filter changes them."""

    def __init__(self, options: dict):
        self.repo = options["path"]
        self.most = int(options["max_commits"]) if options.get("max_commits") else None
        self.size = int(options.get("commits_per_partition", 2000))
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of the time and of the commit's id."""
        for f in filters:
            if type(f) in _SIGNS and f.attribute in (("ts",), ("commit_id",)) and self.has(f.attribute[0]):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def has(self, column: str) -> bool:
        return True

    def partitions(self) -> list[Range]:
        limit = [] if self.most is None else [f"--max-count={self.most}"]
        rows = [r.split() for r in git(self.repo, "rev-list", "--date-order", "--timestamp", *limit, "HEAD").splitlines()]
        kept = [(at, sha) for at, (ts, sha) in enumerate(rows) if all(_SIGNS[sign]({"ts": int(ts), "commit_id": sha}[c], value) for c, sign, value in self.tests)]
        parts = [kept[i : i + self.size] for i in range(0, len(kept), self.size)] or [[]]
        return [Range([at for at, _ in part], [sha for _, sha in part]) for part in parts]

    def read(self, partition: Range) -> Iterator[tuple]:
        for at, record in zip(partition.places, _records(self.repo, partition.ids)):
            yield *record, at


class _CommitStream(DataSourceStreamReader):
    """Commits that HEAD reaches and the last offset doesn't; an offset is the id of a head.

    History that was rewritten counts by its new ids; a head that is gone is an error, since what
    it reached isn't known.  A partition names its commits, so a batch that runs again is the same.
    """

    def __init__(self, options: dict):
        self.repo = options["path"]
        self.size = int(options.get("commits_per_partition", 2000))

    def initialOffset(self) -> dict:
        return {"head": ""}

    def latestOffset(self) -> dict:
        found = subprocess.run(["git", "-C", self.repo, "rev-parse", "--verify", "-q", "HEAD"], capture_output=True)
        return {"head": found.stdout.decode().strip()}  # none before the first commit

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if not end["head"]:
            return []
        known = [f"^{start['head']}"] if start["head"] else []
        ids = git(self.repo, "rev-list", "--date-order", end["head"], *known).split()
        return [Range(list(range(i, min(i + self.size, len(ids)))), ids[i : i + self.size]) for i in range(0, len(ids), self.size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        for at, record in zip(partition.places, _records(self.repo, partition.ids)):
            yield *record, at

    def commit(self, end: dict) -> None:
        pass


class GitLog(DataSource):
    """``spark.read.format("git_log").load(path)``: commits, latest first; option max_commits stops the walk.

    ``spark.readStream.format("git_log")`` gives new commits; there ``pos`` counts from each batch's latest.
    """

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "commit_id string, parent string, author string, ts long, message string, pos long"

    def reader(self, schema) -> DataSourceReader:
        return _CommitReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _CommitStream(self.options)


class _HunkReader(_CommitReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.paths: list[str] = []

    def has(self, column: str) -> bool:
        return column == "commit_id"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of the commit's id, and a path or list of paths, of which alone git makes the difference."""
        for f in super().pushFilters(filters):
            named = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if named is not None and f.attribute == ("path",) and not self.paths and all(isinstance(p, str) and p for p in named):
                self.paths = named
            yield f  # git takes a folder's name for all below it, so Spark looks again

    def read(self, partition: Range) -> Iterator[tuple]:
        only = ["--", *(f":(literal){p}" for p in self.paths)] if self.paths else []
        for sha, parent, *_ in super().read(partition):
            for path, start, end in hunks(git(self.repo, "diff", "-U3", "--no-color", "--no-renames", parent or EMPTY_TREE, sha, *only)):
                yield sha, path, start, end


class GitHunks(DataSource):
    """``spark.read.format("git_hunks").load(path)``: row ranges [start, end), from 0, of each changed file against the first parent."""

    @classmethod
    def name(cls) -> str:
        return "git_hunks"

    def schema(self) -> str:
        return "commit_id string, path string, start long, end long"

    def reader(self, schema) -> DataSourceReader:
        return _HunkReader(self.options)


def hunks(diff: str) -> Iterator[tuple[str, int, int]]:
    path = None
    for line in diff.splitlines():
        if line.startswith("+++ "):
            path = None if line[4:] == "/dev/null" else line[6:]
        elif path and (m := _HUNK.match(line)):
            count = 1 if m[2] is None else int(m[2])
            start = max(0, int(m[1]) - 1)
            yield path, start, start + count


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session; sources that take filters need the session to push them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitLog)
    spark.dataSource.register(GitHunks)


def commits(spark: SparkSession, repo: str, max_commits: int | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("git_log")
    if max_commits is not None:
        reader = reader.option("max_commits", max_commits)
    return reader.load(repo)


def changed(spark: SparkSession, repo: str, max_commits: int | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("git_hunks")
    if max_commits is not None:
        reader = reader.option("max_commits", max_commits)
    return reader.load(repo)


def contents(files: DataFrame, repo: str) -> DataFrame:
    """files (commit_id, path) with ``source``, the file's text at that commit, or null where it
    isn't there.  One git process serves a whole partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as store:

            def text(commit: str, path: str) -> str | None:
                if "\n" in path:
                    return None
                store.stdin.write(f"{commit}:{path}\n".encode())
                store.stdin.flush()
                head = store.stdout.readline().split()
                if head[-1:] == [b"missing"] or len(head) < 3 or not head[-1].isdigit():
                    return None
                data = store.stdout.read(int(head[-1]))
                store.stdout.read(1)
                return data.decode(errors="replace") if head[-2] == b"blob" else None

            for batch in batches:
                ids, paths = batch.column(0), batch.column(1)
                found = [text(c, p) for c, p in zip(ids.to_pylist(), paths.to_pylist())]
                yield pa.RecordBatch.from_arrays([ids, paths, pa.array(found, pa.string())], names=["commit_id", "path", "source"])
            store.stdin.close()

    return files.select("commit_id", "path").mapInArrow(run, "commit_id string, path string, source string")


def new_commits(spark: SparkSession, repo: str) -> DataFrame:
    """A stream of the commits of a repository, each once, in batches of what has come since."""
    register(spark)
    return spark.readStream.format("git_log").load(repo)
