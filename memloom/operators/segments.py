"""Commit messages: line filters, and their division into segments, row by row without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.config import FilterConfig, SplitConfig
from memloom.functions import text as X

_SEGMENT = "struct<header:string,details:array<string>>"
_SEGMENTS = f"array<{_SEGMENT}>"
CONFIDENCE = {"conventional_header": 0.95, "bullet_grouped": 0.80, "paragraph_fallback": 0.65}


def _filtered(message: Column, config: FilterConfig) -> Column:
    """(filtered, lines_dropped) of a message."""

    def of(bare: Column) -> Column:
        empty = X.strip(bare) == ""
        if not config.patterns:
            return F.struct(F.when(~empty, bare).alias("filtered"), F.lit(0).alias("lines_dropped"))

        def both(x: Column) -> Column:
            kept = F.when(~empty & (X.strip(x["text"]) != ""), x["text"])
            return F.struct(kept.alias("filtered"), F.when(empty, 0).otherwise(x["dropped"]).alias("lines_dropped"))

        return X.let(X.filter_lines(bare, config.matches), both)

    return X.let(X.strip_html_comments(message), of)


def filter_messages(commits: DataFrame, config: FilterConfig, message: str = "message") -> DataFrame:
    """All commits with ``filtered`` (null where nothing is left) and ``lines_dropped``."""
    return commits.select("*", _filtered(F.col(message), config).alias("_filter")).select(*commits.columns, "_filter.*")


def kept_messages(commits: DataFrame, config: FilterConfig, message: str = "message") -> DataFrame:
    """The commits of whose message something is left, with ``filtered``.  A generator drops the
    others, as a filter would be pushed below and compute each message twice."""
    kept = F.filter(F.array(_filtered(F.col(message), config)["filtered"]), lambda t: t.isNotNull())
    return commits.select("*", F.explode(kept).alias("filtered"))


def filter_stats(filtered: DataFrame, message: str = "message") -> DataFrame:
    """One row of counts; sizes are UTF-8 bytes."""
    before, after = F.sum(F.octet_length(message)), F.sum(F.octet_length("filtered"))
    kept = F.col("filtered").isNotNull()
    return filtered.agg(
        F.count("*").alias("commits_seen"),
        F.count_if(kept).alias("commits_kept"),
        F.count_if(~kept).alias("commits_skipped_empty"),
        F.coalesce(F.sum("lines_dropped"), F.lit(0)).alias("lines_dropped"),
        F.coalesce(before, F.lit(0)).alias("chars_before"),
        F.coalesce(after, F.lit(0)).alias("chars_after"),
        F.round(F.when(before > 0, 100.0 * after / before).otherwise(0.0), 6).alias("retention_percent"),
    )


def _empty() -> Column:
    return F.array().cast(_SEGMENTS)


def _by_marks(all_lines: Column, starts, header, most: int) -> Column:
    """Segments that begin at certain lines: non-blank lines behind one, up to the next, are its
    details; lines before the first are lost, and so is all from the line that would begin one too many."""

    def cut(rows: Column, at: Column) -> Column:
        def one(p: Column, k: Column) -> Column:
            end = F.coalesce(F.get(at, k + 1), F.size(rows))
            behind = F.filter(F.slice(rows, p + 2, end - p - 1), lambda x: x["bare"] != "")
            return F.struct(header(F.get(rows, p)["bare"]).alias("header"), F.transform(behind, lambda x: x["bare"]).alias("details"))

        return F.transform(F.slice(at, 1, most), one)

    def found(rows: Column) -> Column:
        places = F.filter(F.transform(rows, lambda x, i: F.when(x["starts"], i)), lambda i: i.isNotNull())
        return X.let(places, lambda at: cut(rows, at))

    marked = F.transform(all_lines, lambda s: F.struct(X.strip(s).alias("bare"), starts(s).alias("starts")))
    return X.let(marked, found)


def _two(found: Column) -> Column:
    """Segments, or none if there are fewer than two."""
    return X.let(found.cast(_SEGMENTS), lambda s: F.when(F.size(s) >= 2, s).otherwise(_empty()))


def header_segments(message: Column, most: int) -> Column:
    """Segments by conventional headers; empty unless there are two."""
    return _two(_by_marks(X.lines(message), X.is_header, lambda s: s, most))


def bullet_segments(message: Column, most: int) -> Column:
    return _two(_by_marks(X.lines(message), X.is_bullet, lambda s: X.strip(F.substr(s, F.lit(3))), most))


def _first_and_rest(text: Column) -> Column:
    kept = F.filter(F.transform(X.lines(text), X.strip), lambda s: s != "")
    return X.let(kept, lambda k: F.struct(F.get(k, F.lit(0)).alias("header"), F.slice(k, F.lit(2), F.size(k)).alias("details")))


def merged_paragraphs(message: Column) -> Column:
    """Paragraphs, with fragments (markup, or fewer than 5 words, or behind so few) joined to the one before."""
    paragraphs = F.filter(F.transform(F.split(message, "\n\n"), X.strip), lambda p: p != "")

    def merged(ps: Column) -> Column:
        def cut(facts: Column) -> Column:
            # only the first group can have fewer than 5 words, as any other begins with so many:
            # up to there all paragraphs belong to it, then each that is no fragment begins one
            first = F.aggregate(
                facts,
                F.struct(F.lit(0).alias("words"), F.lit(0).alias("paragraphs")),
                lambda a, x: F.struct((a["words"] + x["words"]).alias("words"), (a["paragraphs"] + F.when(a["words"] < 5, 1).otherwise(0)).alias("paragraphs")),
            )["paragraphs"]

            def begins(limit: Column) -> Column:
                marks = F.transform(facts, lambda x, i: F.when((i == 0) | ((i >= limit) & x["whole"]), i))
                return F.filter(marks, lambda i: i.isNotNull())

            def groups(at: Column) -> Column:
                return F.transform(at, lambda p, k: F.array_join(F.slice(ps, p + 1, F.coalesce(F.get(at, k + 1), F.size(ps)) - p), "\n\n"))

            return X.let(X.let(first, begins), groups)

        def fact(p: Column) -> Column:
            return X.let(X.word_count(p), lambda n: F.struct(n.alias("words"), ((n >= 5) & ~p.startswith("<") & ~p.endswith(">")).alias("whole")))

        return X.let(F.transform(ps, fact), cut)

    return X.let(paragraphs, merged)


def paragraph_segments(message: Column, most: int) -> Column:
    def cut(merged: Column) -> Column:
        enough = F.size(F.filter(merged, lambda p: X.word_count(p) >= 5)) >= 2
        return F.when(enough, F.transform(F.slice(merged, 1, most), _first_and_rest).cast(_SEGMENTS)).otherwise(_empty())

    return _two(X.let(merged_paragraphs(message), cut))


def single_segment(message: Column) -> Column:
    return X.let(_first_and_rest(message), lambda one: F.array(F.struct(F.coalesce(one["header"], X.strip(message)).alias("header"), one["details"].alias("details"))))


def split_messages(commits: DataFrame, config: SplitConfig, message: str = "filtered") -> DataFrame:
    """Commits with ``segments``, how they were found (``parse_mode``), ``confidence``, and whether the message was split."""
    m = F.col(message)

    def row(segments: Column, kind: str, confidence: float, split: bool) -> Column:
        return F.struct(segments.cast(_SEGMENTS).alias("segments"), F.lit(kind).alias("parse_mode"), F.lit(confidence).alias("confidence"), F.lit(split).alias("is_split"))

    def choose(name: str, keeps: bool, rest: Column):
        one = row(single_segment(m), "paragraph_fallback", 1.0, False)
        return lambda found: F.when(F.size(found) >= 2, row(found, name, CONFIDENCE[name], True) if keeps else one).otherwise(rest)

    out = row(single_segment(m), "paragraph_fallback", 1.0, False)
    if config.mode != "off":
        kinds = [("paragraph_fallback", paragraph_segments), ("bullet_grouped", bullet_segments), ("conventional_header", header_segments)]
        kept = False
        for name, find in kinds:  # the last one is tried first
            # all segments of a kind have its confidence, so their mean is known beforehand
            keeps = config.mode in ("strict", "ast") or CONFIDENCE[name] >= config.min_confidence
            if not keeps and not kept:
                continue  # found or not, the message stays one segment
            kept = True
            out = X.let(find(m, config.max_segments), choose(name, keeps, out))
    return commits.select("*", out.alias("_split")).select(*commits.columns, "_split.*")


def split_stats(split: DataFrame) -> DataFrame:
    """One row of counts over all commits."""
    n = F.size("segments")

    def by(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("is_split") & (F.col("parse_mode") == kind), n)), F.lit(0))

    return split.agg(
        F.count("*").alias("commits_seen"),
        F.count_if("is_split").alias("commits_split"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_segments"),
        F.count_if(~F.col("is_split")).alias("fallback_single"),
        by("conventional_header").alias("from_headers"),
        by("bullet_grouped").alias("from_bullets"),
        by("paragraph_fallback").alias("from_paragraphs"),
    )


def segment_content(segment: Column) -> Column:
    return F.array_join(F.concat(F.array(segment["header"]), segment["details"]), "\n")


def segments_to_turns(split: DataFrame, author: str = "author", ts: str = "ts") -> DataFrame:
    """One turn for each segment, in order, sharing its commit's id, time and author."""
    rows = split.select("commit_id", F.col(author).alias("speaker"), F.col(ts).alias("timestamp"), F.posexplode("segments").alias("pos", "segment"))
    return rows.select("commit_id", "pos", "speaker", segment_content(F.col("segment")).alias("content"), F.lit("git").alias("topic"), "timestamp")
