"""Queries of ingestion: text functions, segments, embedding, notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.config import FilterConfig, SplitConfig
from memloom.functions import text as X
from memloom.functions import vec
from memloom.operators import embed, latent, notes, segments
from memloom.plans.registry import query
from memloom.sources import fixtures as fx

_NOISE = FilterConfig(preset="git-noise")
_TRIM = r"trim({}, ' ' || chr(9) || chr(10) || chr(13))"
_BARE = r"regexp_replace(message, '(?s)<!--.*?-->', '', 'g')"
_NOISE_RE = r"^Co-authored-by:|^Signed-off-by:|^Reviewed-by:|^Change-Id:|^See merge request"


def _t(x: str) -> str:
    return _TRIM.format(x)


def _lines(x: str) -> str:
    return f"case when {x} = '' then [] else string_split(regexp_replace({x}, '\\n$', ''), chr(10)) end"


_FILTERED = f"""with {fx.COMMITS_SQL},
b as (select *, {_BARE} as bare from commits),
l as (select *, list_transform({_lines('bare')}, lambda s: {_t('s')}) as ls from b),
k as (select *, list_concat(list_filter(ls[1:1], lambda s: s <> ''), list_filter(ls[2:], lambda s: s = '' or not regexp_matches(s, '{_NOISE_RE}'))) as ks,
  len(list_filter(ls[2:], lambda s: s <> '' and regexp_matches(s, '{_NOISE_RE}'))) as dropped from l),
f as (select *, array_to_string(list_filter(ks, lambda s, i: i = 1 or s <> ks[i - 1]), chr(10)) as joined from k),
filtered as (select doc_id, commit_id, author, ts, message, case when {_t('bare')} <> '' and {_t('joined')} <> '' then joined end as filtered,
  case when {_t('bare')} = '' then 0 else dropped end as lines_dropped from f)"""


@query("t01_strip_html_comments", r"select page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') as stripped from pages")
def t01(spark, d):
    return fx.read(spark, d, "pages").select("page_id", X.strip_html_comments(F.col("html")).alias("stripped"))


@query("t02_drop_empty_messages", f"with {fx.COMMITS_SQL} select commit_id, {_BARE} as filtered from commits where {_t(_BARE)} <> ''")
def t02(spark, d):
    return segments.kept_messages(fx.commits(spark, d), FilterConfig()).select("commit_id", "filtered")


@query("t03_t07_filter_lines", _FILTERED + " select commit_id, filtered, lines_dropped::int as lines_dropped from filtered")
def t03(spark, d):
    return segments.filter_messages(fx.commits(spark, d), _NOISE).select("commit_id", "filtered", "lines_dropped")


@query("t05_drop_pattern_ignoring_case", _FILTERED.replace(_NOISE_RE, "(?i)^TAIL$") + " select commit_id, filtered from filtered")
def t05(spark, d):
    return segments.filter_messages(fx.commits(spark, d), FilterConfig(drop=["^TAIL$"], ignore_case=True)).select("commit_id", "filtered")


@query(
    "t08_filter_stats",
    _FILTERED
    + """ select count(*) as commits_seen, count(filtered) as commits_kept, count(*) - count(filtered) as commits_skipped_empty, sum(lines_dropped)::bigint as lines_dropped,
  sum(strlen(message))::bigint as chars_before, coalesce(sum(strlen(filtered)), 0)::bigint as chars_after, round(100.0::double * sum(strlen(filtered)) / sum(strlen(message)), 6) as retention_percent from filtered""",
)
def t08(spark, d):
    return segments.filter_stats(segments.filter_messages(fx.commits(spark, d), _NOISE))


_HDR = r"^[A-Za-z][A-Za-z0-9()\-_/]*:\s*\S"


@query("t09_header_lines", f"with {fx.COMMITS_SQL}, l as (select commit_id, unnest({_lines('message')}) as line from commits) select commit_id, count(*) as headers from l where regexp_matches({_t('line')}, '{_HDR}') group by commit_id")
def t09(spark, d):
    rows = fx.commits(spark, d).select("commit_id", F.explode(X.lines(F.col("message"))).alias("line"))
    return rows.where(X.is_header(F.col("line"))).groupBy("commit_id").agg(F.count("*").alias("headers"))


@query("t11_bullet_lines", f"with {fx.COMMITS_SQL}, l as (select commit_id, unnest({_lines('message')}) as line from commits) select commit_id, count(*) as bullets from l where regexp_matches({_t('line')}, '^[-*] ') and strlen({_t('line')}) >= 3 group by commit_id")
def t11(spark, d):
    rows = fx.commits(spark, d).select("commit_id", F.explode(X.lines(F.col("message"))).alias("line"))
    return rows.where(X.is_bullet(F.col("line"))).groupBy("commit_id").agg(F.count("*").alias("bullets"))


def _folded(name: str, starts: str, header: str, most: int) -> str:
    """Segments by marked lines in SQL: numbered by a running count, the first `most` kept."""
    return f"""
{name}l as (select commit_id, unnest({_lines('filtered')}) as line, generate_subscripts({_lines('filtered')}, 1) as pos from filtered where filtered is not null),
{name}n as (select *, {_t('line')} as bare, sum(case when {starts} then 1 else 0 end) over (partition by commit_id order by pos) as seg, ({starts}) as st from {name}l),
{name}s as (select commit_id, seg, max(case when st then {header} end) as header, coalesce(list(bare order by pos) filter (where not st and bare <> ''), []) as details
  from {name}n where seg between 1 and {most} group by commit_id, seg),
{name} as (select commit_id, list({{'header': header, 'details': details}} order by seg) as segs from {name}s group by commit_id having count(*) >= 2)"""


_H = _folded("h", f"regexp_matches({_t('line')}, '{_HDR}')", _t("line"), 6)
_B = _folded("b_", f"(regexp_matches({_t('line')}, '^[-*] ') and strlen({_t('line')}) >= 3)", _t(f"substr({_t('line')}, 3)"), 6)
_WC = r"len(regexp_extract_all({}, '\S+'))"
_P = f"""
p0 as (select commit_id, list_filter(list_transform(string_split(filtered, chr(10) || chr(10)), lambda p: {_t('p')}), lambda p: p <> '') as ps from filtered where filtered is not null),
p1 as (select commit_id, list_reduce(list_transform(ps, lambda p: [p]), lambda a, q: case when starts_with(q[1], '<') or ends_with(q[1], '>') or {_WC.format('q[1]')} < 5 or {_WC.format('a[-1]')} < 5
  then list_concat(a[1:len(a) - 1], [a[-1] || chr(10) || chr(10) || q[1]]) else list_concat(a, q) end) as ms from p0 where len(ps) > 0),
p2 as (select commit_id, list_transform(ms[1:6], lambda m: list_filter(list_transform(string_split(m, chr(10)), lambda s: {_t('s')}), lambda s: s <> '')) as xs from p1 where len(list_filter(ms, lambda m: {_WC.format('m')} >= 5)) >= 2),
p as (select commit_id, list_transform(xs, lambda x: {{'header': x[1], 'details': x[2:]}}) as segs from p2)"""
_ONE = f"""
o0 as (select commit_id, list_filter(list_transform({_lines('filtered')}, lambda s: {_t('s')}), lambda s: s <> '') as xs from filtered where filtered is not null),
o as (select commit_id, [{{'header': xs[1], 'details': xs[2:]}}] as segs from o0)"""
_STRICT = f"""{_FILTERED},{_H},{_B},{_P},{_ONE},
split as (select f.commit_id, f.author, f.ts, coalesce(h.segs, b_.segs, p.segs, o.segs) as segs,
  case when h.segs is not null then 'conventional_header' when b_.segs is not null then 'bullet_grouped' else 'paragraph_fallback' end as parse_mode,
  (h.segs is not null or b_.segs is not null or p.segs is not null) as is_split
  from filtered f left join h using (commit_id) left join b_ using (commit_id) left join p using (commit_id) left join o using (commit_id) where f.filtered is not null)"""
_AUTO = _STRICT.replace("coalesce(h.segs, b_.segs, p.segs, o.segs)", "coalesce(h.segs, b_.segs, o.segs)").replace(" or p.segs is not null", "")
_SHOW = "select commit_id, u.seg as seg, u.s.header as header, array_to_string(u.s.details, chr(10)) as details from (select commit_id, unnest(segs) as s, generate_subscripts(segs, 1) as seg from {} ) u"


def _filtered(spark, d):
    return segments.kept_messages(fx.commits(spark, d), _NOISE)


def _show(df, column):
    rows = df.select("commit_id", F.posexplode(column).alias("seg", "s"))
    return rows.select("commit_id", (F.col("seg") + 1).alias("seg"), F.col("s.header").alias("header"), F.array_join("s.details", "\n").alias("details"))


@query("t10_header_segments", f"{_FILTERED},{_H} {_SHOW.format('h')}")
def t10(spark, d):
    return _show(_filtered(spark, d).withColumn("segs", segments.header_segments(F.col("filtered"), 6)), "segs")


@query("t12_bullet_segments", f"{_FILTERED},{_B} {_SHOW.format('b_')}")
def t12(spark, d):
    return _show(_filtered(spark, d).withColumn("segs", segments.bullet_segments(F.col("filtered"), 6)), "segs")


@query("t13_paragraph_segments", f"{_FILTERED},{_P} {_SHOW.format('p')}")
def t13(spark, d):
    return _show(_filtered(spark, d).withColumn("segs", segments.paragraph_segments(F.col("filtered"), 6)), "segs")


@query("t14_single_segments", f"{_FILTERED},{_ONE} {_SHOW.format('o')}")
def t14(spark, d):
    return _show(_filtered(spark, d).withColumn("segs", segments.single_segment(F.col("filtered"))), "segs")


@query("t15_split_auto", f"{_AUTO} select commit_id, parse_mode, is_split, len(segs)::int as n_segments from split")
def t15(spark, d):
    split = segments.split_messages(_filtered(spark, d), SplitConfig())
    return split.select("commit_id", "parse_mode", "is_split", F.size("segments").alias("n_segments"))


@query("t15_split_strict", f"{_STRICT} select commit_id, parse_mode, is_split, len(segs)::int as n_segments from split")
def t15_strict(spark, d):
    split = segments.split_messages(_filtered(spark, d), SplitConfig(mode="strict"))
    return split.select("commit_id", "parse_mode", "is_split", F.size("segments").alias("n_segments"))


@query(
    "t17_split_stats",
    f"""{_STRICT} select count(*) as commits_seen, count_if(is_split)::bigint as commits_split, sum(len(segs))::bigint as total_segments, count_if(not is_split)::bigint as fallback_single,
  coalesce(sum(case when is_split and parse_mode = 'conventional_header' then len(segs) end), 0)::bigint as from_headers, coalesce(sum(case when is_split and parse_mode = 'bullet_grouped' then len(segs) end), 0)::bigint as from_bullets,
  coalesce(sum(case when is_split and parse_mode = 'paragraph_fallback' then len(segs) end), 0)::bigint as from_paragraphs from split""",
)
def t17(spark, d):
    return segments.split_stats(segments.split_messages(_filtered(spark, d), SplitConfig(mode="strict")))


@query("t18_segment_turns", f"{_AUTO} select commit_id, (u.seg - 1)::int as pos, author as speaker, array_to_string(list_concat([u.s.header], u.s.details), chr(10)) as content, 'git' as topic, ts as timestamp from (select commit_id, author, ts, unnest(segs) as s, generate_subscripts(segs, 1) as seg from split) u")
def t18(spark, d):
    return segments.segments_to_turns(segments.split_messages(_filtered(spark, d), SplitConfig()))


@query("t22_context", r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as context from documents")
def t22(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", X.context(F.col("text")).alias("context"))


@query("t23_compact_snippet", "with f as (select doc_id, replace(replace(text, chr(10), ' '), '  ', ' ') as t from documents) select doc_id, case when length(t) > 100 then substr(t, 1, 100) || '...' else t end as snippet from f")
def t23(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", X.compact_snippet(F.col("text"), 100).alias("snippet"))


@query("t24_human_snippets", "select doc_id, case when length(text) > 120 then substr(text, 1, 120) || '...' else text end as short, case when length(text) > 200 then substr(text, 1, 200) || '...' else text end as long from documents")
def t24(spark, d):
    t = F.col("text")
    return fx.read(spark, d, "documents").select("doc_id", X.cut(t, 120).alias("short"), X.cut(t, 200).alias("long"))


@query("t25_summarize", r"with f as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents) select doc_id, case when length(t) > 80 then substr(t, 1, 79) || '…' else t end as summary from f")
def t25(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", X.summarize(F.col("text"), 80).alias("summary"))


@query("t26_format_day", "select event_id, case when event_id % 10 = 0 then 'n/a' else strftime(make_timestamp(cast(floor(epoch(ts)) as bigint) * 1000000), '%Y-%m-%d') end as day from events")
def t26(spark, d):
    ts = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return fx.read(spark, d, "events").select("event_id", X.format_day(F.when(F.col("event_id") % 10 != 0, ts)).alias("day"))


@query("t27_rfc3339", "select event_id, strftime(make_timestamp(cast(floor(epoch(ts)) as bigint) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' as rendered, cast(floor(epoch(ts)) as bigint) as parsed from events")
def t27(spark, d):
    text = X.to_rfc3339(F.unix_timestamp(F.col("ts").cast("timestamp")))
    return fx.read(spark, d, "events").select("event_id", text.alias("rendered"), X.from_rfc3339(text).alias("parsed"))


@query(
    "t28_parse_links",
    r"""with e as (select event_id, unnest(regexp_split_to_array(concat(user_id, ':', round(value, 2), ', ', event_id, ' x:1 ', user_id, 'ab:2'), '[\s,]+')) as s from events),
q as (select event_id, try_cast(regexp_extract(s, '^([+-]?\d+)', 1) as bigint) as note_id, case when contains(s, ':') then try_cast(regexp_extract(split_part(s, ':', 2), '^([+-]?(?:\d+\.?\d*|\.\d+))', 1) as double) else 0 end as score from e)
select event_id, note_id, score from q where note_id is not null and score is not null""",
)
def t28(spark, d):
    e = fx.read(spark, d, "events")
    text = F.concat(F.col("user_id").cast("string"), F.lit(":"), F.round("value", 2).cast("string"), F.lit(", "), F.col("event_id").cast("string"), F.lit(" x:1 "), F.col("user_id").cast("string"), F.lit("ab:2"))
    return e.select("event_id", F.inline(X.parse_links(text)))


@query("e01_term_weights", r"with w as (select distinct doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as term from documents), n as (select count(*) as n from documents) select term, count(*) as texts, round(ln((1.0 + n) / (1.0 + count(*))) + 1, 6) as idf from w, n where term <> '' group by term, n having count(*) >= 2 order by texts desc, term limit 30000")
def e01_terms(spark, d):
    """The terms of a latent model over all documents."""
    return latent.vocabulary(fx.read(spark, d, "documents"), "text").select("term", "texts", F.round("idf", 6).alias("idf"))


@query("e01_latent_embedding")
def e01(spark, d):
    """Vectors of all documents by a model learned from them."""
    docs = fx.read(spark, d, "documents").select("doc_id", "text")
    return latent.LatentEmbedder(latent.LatentModel.fit(docs, "text", dims=16)).embed(docs, "text", "embedding").drop("text")


@query("e01_singular_vectors", "select i::int as idx, true as solved from range(4) t(i)")
def e01_vectors(spark, d):
    """Whether all documents, folded in, have the model's singular values as the lengths of their coordinates, and coordinates at right angles."""
    docs = fx.read(spark, d, "documents").select("doc_id", "text")
    model = latent.LatentModel.fit(docs, "text", dims=4, tolerance=1e-7)
    y = latent.LatentEmbedder(model, unit=False).embed(docs, "text", "y").select(F.col("y").cast("array<double>").alias("y"))
    pairs = [(i, j) for i in range(4) for j in range(4)]
    sums = y.agg(*[F.sum(F.col("y")[i] * F.col("y")[j]).alias(f"s{i}_{j}") for i, j in pairs])
    square, most = [float(v) ** 2 for v in model.values], float(model.values[0]) ** 2
    close = lambda i: F.greatest(*[F.abs(F.col(f"s{i}_{j}") - (square[i] if i == j else 0.0)) for j in range(4)]) < 1e-5 * most
    return sums.select(F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), close(i).alias("solved")) for i in range(4)])).alias("r")).select("r.*")


@query("e02_hash_embedding")
def e02(spark, d):
    return embed.HashEmbedder().embed(fx.read(spark, d, "conversations").select("conv_id", "turn", "text"), "text", "embedding")


@query("e03_embed_distinct", "select count(*) as turns, count(distinct text) as embedded from conversations")
def e03(spark, d):
    t = fx.read(spark, d, "conversations").select(F.col("text").alias("content"))
    out = embed.embed_distinct(t, embed.HashEmbedder(8))
    return out.agg(F.count("*").alias("turns"), F.count_distinct("embedding").alias("embedded"))


@query("e04_norms", "select vec_id as note_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm from embeddings")
def e04(spark, d):
    return fx.read(spark, d, "embeddings").select(F.col("vec_id").alias("note_id"), F.round(vec.norm(F.col("embedding")), 6).alias("norm"))


@query("i01_i02_turns_to_notes", f"with {fx.TURNS_SQL} select turn_id - 1 as note_id, content as raw_content, turn_id, commit_id, timestamp as ts from turns")
def i01(spark, d):
    t = fx.turns(spark, d)
    for c in ("symbol_id", "ast_node_type", "file_path"):
        t = t.withColumn(c, F.lit(None).cast("string"))
    out = notes.turns_to_notes(embed.embed_distinct(t, embed.HashEmbedder(8)))
    return out.select("note_id", "raw_content", F.inline("sources"))


_KNOWN = "known as (select * from turns where right(commit_id, 1) in ('0', '2', '4', '6', '8'))"


def _known(spark, d):
    t = fx.turns(spark, d)
    k = t.where(F.substring("commit_id", -1, 1).isin("0", "2", "4", "6", "8"))
    return t, k.select(F.col("turn_id").alias("note_id"), F.array(F.struct("turn_id", "commit_id", F.col("timestamp").alias("ts"))).alias("sources"))


@query("i03_incremental_skip", f"with {fx.TURNS_SQL}, {_KNOWN} select turn_id, commit_id from turns where commit_id is null or commit_id not in (select commit_id from known)")
def i03(spark, d):
    t, k = _known(spark, d)
    return notes.new_turns(t, k).select("turn_id", "commit_id")


@query("i04_renumbered_turns", f"with {fx.TURNS_SQL}, {_KNOWN}, f as (select * from turns where commit_id not in (select commit_id from known)) select (select max(turn_id) from known) + row_number() over (order by timestamp, content) as turn_id, timestamp from f")
def i04(spark, d):
    t, k = _known(spark, d)
    return notes.renumbered(notes.new_turns(t, k), k, ["timestamp", "content"]).select("turn_id", "timestamp")


@query("i05_append", f"with {fx.TURNS_SQL}, {_KNOWN} select turn_id from known union all select turn_id from turns where commit_id not in (select commit_id from known)")
def i05(spark, d):
    t, k = _known(spark, d)
    return k.select(F.col("note_id").alias("turn_id")).unionByName(notes.new_turns(t, k).select("turn_id"))


@query("i06_structural_links", f"with {fx.NOTES_SQL} select a.note_id as src, b.note_id as dst, 1 as mult from notes a join notes b on a.symbol_id = b.symbol_id and a.note_id <> b.note_id")
def i06(spark, d):
    return notes.structural_links(fx.notes(spark, d))


@query(
    "i07_merge_turns",
    f"""with {fx.NOTES_SQL}, g as (select note_id // 4 as g, * from notes), e as (select g, note_id, generate_subscripts(v, 1) as p, unnest(v) as x from g), m as (select g, p, avg(x) as x from e group by g, p),
l as (select g, list(x order by p) as v from m group by g)
select s.g as note_id, array_to_string(list(raw_content order by note_id), ' | ') as raw_content, count(*)::int as turns, (list(file_path order by note_id) filter (where file_path is not null))[1] as file_path, round(any_value(sqrt(list_dot_product(l.v, l.v))), 6) as norm
from g s join l on s.g = l.g group by s.g""",
)
def i07(spark, d):
    n = fx.notes(spark, d)
    g = F.floor(F.col("note_id") / 4).cast("long")
    first = n.where("note_id % 4 = 0").withColumn("note_id", g)
    rest = n.where("note_id % 4 <> 0").select(g.alias("note_id"), F.col("sources")[0]["turn_id"].alias("turn_id"), F.col("raw_content").alias("content"), "embedding", F.col("sources")[0]["commit_id"].alias("commit_id"), F.col("sources")[0]["ts"].alias("timestamp"), "file_path")
    out = notes.merge_turns(first, rest)
    return out.select("note_id", "raw_content", F.size("sources").alias("turns"), "file_path", F.round("norm", 6).alias("norm"))


@query("i08_edited_links", "select user_id as note_id, max(value) as score from events where user_id in (select vec_id from embeddings) group by user_id")
def i08(spark, d):
    given = fx.read(spark, d, "events").select(F.col("user_id").alias("note_id"), F.col("value").alias("score"))
    return notes.edited_links(given, fx.notes(spark, d))


@query("i09_cascade_delete", f"with {fx.LINKS_SQL}, n as (select * from notes where note_id % 10 <> 3), l as (select * from links where a % 10 <> 3 and b % 10 <> 3) select (select count(*) from n) as notes, (select count(*) from n) as labels, (select count(*) from l) as links")
def i09(spark, d):
    n, l = fx.notes(spark, d), fx.links(spark, d)
    gone = n.where("note_id % 10 = 3").select("note_id")
    n2, c2, _, l2 = notes.delete_notes(gone, n, fx.clusters(spark, d), fx.related(spark, d), l)
    return n2.agg(F.count("*").alias("notes")).crossJoin(c2.agg(F.count("*").alias("labels"))).crossJoin(l2.agg(F.count("*").alias("links")))
