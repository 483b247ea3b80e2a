"""One query for each operator of the engine, over the standard tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from shoal.model import SearchOptions
from shoal.operators import content, hierarchy, incremental
from shoal.operators.search import Catalog, compose, history_order, unsigned, with_run_history
from shoal.sources import virtual as V
from shoal.tables import new_path

#: The moment that relative dates are read at.
NOW = datetime(2024, 2, 1, 12, 0, tzinfo=timezone.utc)
DAY = 864_000_000_000

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NAT = (
    "array_to_string(list_transform(regexp_extract_all(lower({v}), '([0-9]+|[^0-9]+)'), lambda t: case when regexp_matches(t, '^[0-9]') "
    "then '0' || lpad(length(ltrim(t, '0'))::varchar, 5, '0') || ltrim(t, '0') || lpad(length(t)::varchar, 5, '0') else t end), '')"
)


def nat(v: str) -> str:
    return NAT.format(v=v)


def _files_sql(name: str) -> str:
    return f"""
  select doc_id + 1000000 as id, name, 'D:' || chr(92) || lang || chr(92) || source || chr(92) || name as path, ext,
    'D:' || chr(92) || lang || chr(92) || source as parent, n_chars as size, doc_id, text, source, lang,
    133485408000000000 + doc_id * 36000000000 as mtime,
    32 + case when doc_id % 7 = 0 then 2 else 0 end + case when doc_id % 11 = 0 then 1 else 0 end as attributes
  from (select *, {name} || '.' || ext as name from (
    select *, case doc_id % 5 when 0 then 'txt' when 1 then 'md' when 2 then 'log' when 3 then 'html' else 'json' end as ext
    from documents))"""


PRELUDE = {
    "files": _files_sql("'doc_' || doc_id || '_' || source"),
    "words": _files_sql("regexp_extract(text, '^([^ .\\n]+)', 1) || '_' || doc_id"),
    "tree": """
  select 3000000000 + l_orderkey * 1000 + l_linenumber * 100 + rn as id, 2000000000 + l_orderkey as parent_id,
    'item' || l_linenumber || '_' || rn || '_part' || l_partkey || '.' || lower(l_returnflag) || lower(l_linestatus) as name,
    false as directory, floor(l_extendedprice)::bigint as size
  from (select *, row_number() over (partition by l_orderkey, l_linenumber
    order by l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) as rn from lineitem)
  union all select 2000000000 + o_orderkey, 1000000000 + o_custkey, 'order_' || o_orderkey, true, 0 from orders
  union all select 1000000000 + c_custkey, 1, c_name, true, 0 from customer""",
    "odd": """
  select 5000000000 + s_suppkey as id, 6000000000 + s_suppkey as parent_id, 'stray_' || s_suppkey as name from supplier
  union all select 6500000000 + s_suppkey, 5000000000 + s_suppkey, 'below_' || s_suppkey from supplier
  union all select 7000000000 + n_nationkey, 7000000000 + (n_nationkey + 1) % 25, n_name from nation
  union all select 7100000000 + n_nationkey, 7000000000 + n_nationkey, 'under_' || n_name from nation
  union all select 8000000000 + p_partkey, case when p_partkey % 40 = 0 then 1 else 8000000000 + p_partkey - 1 end, 'deep_' || p_partkey
    from part where p_partkey >= 40 and p_partkey < 4000""",
    "paged": """
  select page_id as id, 'D:' || chr(92) || regexp_extract(url, '^[a-z]+://([^/]+)', 1) || chr(92)
    || replace(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/', chr(92)) as path, length(html)::bigint as size from pages""",
    "rooted": """
  select page_id as id, 'D:' || chr(92) || regexp_extract(url, '^[a-z]+://([^/]+)', 1) || case when page_id % 3 = 0 then ''
    else chr(92) || replace(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/', chr(92)) end as path from pages""",
    "parts": "select p_partkey as id, p_name || '.' || lower(p_type) as name, p_size::bigint * 1024 as size from part",
    "journal": """
  select event_id as usn, user_id as file_id, event_id % 50 as parent_id,
    case event_type when 'signup' then 256 when 'purchase' then 8192 when 'error' then 512 when 'click' then 32768 else 2 end as reason,
    case when user_id % 10 = 0 then 16 else 32 end as attributes, 'user' || user_id || '_' || event_id || '.dat' as name from events""",
    "jbase": """
  select distinct user_id as id, 7 as parent_id, 'user' || user_id || '.dat' as name, user_id % 10 = 0 as directory,
    user_id * 10 as size, 133485408000000000 as last_write_time, case when user_id % 10 = 0 then 16 else 32 end as attributes
  from events where user_id % 2 = 0""",
    "tokens": """
  select doc_id, source, t.term, t.pos from (
    select doc_id, source, unnest(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'),
      lambda x, i: {'term': x, 'pos': i - 1})) as t from documents)""",
}


def sql(name: str, *uses: str, select: str) -> None:
    with_ = "with " + ", ".join(f"{u} as ({PRELUDE[u]})" for u in uses)
    SQL[name] = f"{with_} {select}" if uses else select


def query(name: str):
    def put(fn):
        Q[name] = fn
        return fn

    return put


# -- predicates --------------------------------------------------------------------------

KINDS = {"rooted": V.rooted_pages, "files": V.files, "words": lambda s, d: V.files(s, d, "word"), "paged": V.page_paths, "parts": V.parts}


def search_query(name: str, kind: str, text: str, where: str, score: str = "0", **options) -> None:
    """All matches of a text with their scores, and the condition and score that it stands for."""

    def run(spark, sf_dir):
        c = Catalog(KINDS[kind](spark, sf_dir), now=NOW)
        return c.matches(c.parse(text), SearchOptions(**options)).select("id", "score")

    Q[name] = run
    sql(name, kind, select=f"select id, ({score})::int as score from {kind} where {where}")


def points(value: str, subject: str = "lower(name)", path: str | None = None) -> str:
    v = value.replace("'", "''")
    by_path = f" when contains({path}, '{v}') then 20" if path else ""
    return f"case when {subject} = '{v}' then 120 when starts_with({subject}, '{v}') then 80 when contains({subject}, '{v}') then 50{by_path} else 0 end"


search_query("term_any", "files", "SRC1", "contains(lower(name), 'src1')", points("src1"))
search_query(
    "term_and_or_not", "files", "doc_1 (src1 OR src2) !.log", "contains(lower(name), 'doc_1') and (contains(lower(name), 'src1') or contains(lower(name), 'src2')) and not contains(lower(name), '.log')",
    f"{points('doc_1')} + {points('src1')} + {points('src2')}",
)
search_query(
    "term_not_operator", "files", "NOT (src1 | src2) && <md|txt>",
    "not (contains(lower(name), 'src1') or contains(lower(name), 'src2')) and (contains(lower(name), 'md') or contains(lower(name), 'txt'))",
    f"{points('src1')} + {points('src2')} + {points('md')} + {points('txt')}",
)
search_query("quoted_phrase", "parts", '"Small anvil"', "contains(lower(name), 'small anvil')", points("small anvil"))
search_query("name_scope", "files", "name:doc_12", "contains(lower(name), 'doc_12')", points("doc_12"))
search_query("path_scope", "files", "path:\\en\\src3", "contains(lower(path), '\\en\\src3')", points("\\en\\src3", path="lower(path)"))
search_query("match_path", "files", "src1\\doc", "contains(lower(name), 'src1\\doc') or contains(lower(path), 'src1\\doc')", points("src1\\doc", path="lower(path)"), match_path=True)
search_query("glob_name", "files", "doc_?5*.md", "regexp_matches(lower(name), 'doc_.5.*\\.md')", "20")
search_query("glob_path", "files", "path:\\en\\*\\doc_1", "regexp_matches(lower(path), '\\\\en\\\\.*\\\\doc_1')", "20")
search_query("regex_name", "files", 'regex:"^doc_[0-9]{2}_SRC\\d+\\.(md|txt)$"', "regexp_matches(name, '^doc_[0-9]{2}_src\\d+\\.(md|txt)$')", "20")
search_query("regex_posix", "files", "name-regex:_[[:alpha:]]+[[:digit:]]\\.", "regexp_matches(name, '_[[:alpha:]]+[[:digit:]]\\.')", "20")
search_query("regex_path", "files", 'path-regex:"\\\\e[ns]\\\\src(1|2)\\\\doc"', "regexp_matches(path, '\\\\e[ns]\\\\src(1|2)\\\\doc')", "20")
search_query("filelist_names", "files", 'filelist:"doc_1_src1.md|DOC_5_src5.txt|nothing"', "lower(name) in ('doc_1_src1.md', 'doc_5_src5.txt', 'nothing')", points("doc_1_src1.md"))
search_query("filelist_paths", "files", 'filelist:"D:\\en\\src1/doc_1_src1.md|d:/fr/src4\\doc_4_src4.json"', "lower(path) in ('d:\\en\\src1\\doc_1_src1.md', 'd:\\fr\\src4\\doc_4_src4.json')", points("d:\\en\\src1\\doc_1_src1.md"))
search_query("filelist_glob", "files", 'filelist:"doc_1?_*.md|*9.log"', "regexp_matches(lower(name), '^doc_1._.*\\.md$') or regexp_matches(lower(name), '^.*9\\.log$')", "20")
search_query("ext_list", "files", "ext:MD;.log", "ext in ('md', 'log')", points("md"))
search_query("ext_glob", "files", "ext:t*;?d", "ext in ('txt', 'md')", "20")
search_query("startwith", "files", "startwith:Doc_2", "starts_with(lower(name), 'doc_2')", points("doc_2"))
search_query("endwith", "files", "endwith:7.log", "ends_with(lower(name), '7.log')", points("7.log"))
search_query("len_cmp", "files", "len:>14", "length(name) > 14")
search_query("len_range", "files", "len:12..13", "length(name) between 12 and 13")
search_query("depth_cmp", "paged", "depth:>=2", "len(list_filter(string_split(path, chr(92)), lambda x: x <> '')) >= 4")
search_query("root", "rooted", "root:", "len(list_filter(string_split(path, chr(92)), lambda x: x <> '')) = 2")
search_query("parent_exact", "files", "parent:d:\\EN\\src3", "lower(parent) = 'd:\\en\\src3'")
search_query("size_cmp", "files", "size:>=2kb", "size >= 2048")
search_query("size_range", "files", "size:1kb-4kb", "size between 1024 and 4096")
search_query("size_constants", "files", "size:small OR size:empty", "size > 10240 and size <= 102400 or size = 0")
search_query("date_day", "files", "dm:2024-01-05", f"mtime >= 133485408000000000 + 4 * {DAY} and mtime < 133485408000000000 + 5 * {DAY}")
search_query("date_cmp", "files", "modified:<2024-01-08T06:30", f"mtime < 133485408000000000 + 7 * {DAY} + 234000000000")
search_query("date_month", "files", "date:january", f"mtime >= 133485408000000000 and mtime < 133485408000000000 + 31 * {DAY}")
search_query("date_week", "files", "dm:lastweek OR dm:monday", f"mtime >= 133485408000000000 + 21 * {DAY} and mtime < 133485408000000000 + 28 * {DAY} or mtime >= 133485408000000000 + 28 * {DAY} and mtime < 133485408000000000 + 29 * {DAY}")
search_query("date_today", "files", "dm:today OR dm:yesterday", f"mtime >= 133485408000000000 + 30 * {DAY} and mtime < 133485408000000000 + 32 * {DAY}")
search_query("date_this", "files", "dm:thisweek", f"mtime >= 133485408000000000 + 28 * {DAY} and mtime < 133485408000000000 + 32 * {DAY}")
search_query("date_past", "files", "dm:pastweek", f"mtime >= 133485408000000000 + 24 * {DAY} + {DAY // 2}")
search_query("date_next", "files", "dm:nextweek OR dm:nextmonth", f"mtime >= 133485408000000000 + 35 * {DAY} and mtime < 133485408000000000 + 42 * {DAY} or mtime >= 133485408000000000 + 60 * {DAY} and mtime < 133485408000000000 + 91 * {DAY}")
search_query("date_rolling", "files", "datemodified:last10days", f"mtime >= 133485408000000000 + 21 * {DAY} + {DAY // 2}")
search_query("date_coming", "files", "dm:next36hours", f"mtime >= 133485408000000000 + 31 * {DAY} + {DAY // 2} and mtime < 133485408000000000 + 33 * {DAY}")
search_query("attr_all", "files", "attr:hidden,readonly", "attributes & 3 = 3")
search_query("attr_absent", "files", "attr:!h", "attributes & 2 <> 2")
search_query("case_on", "words", "case:on The", "contains(name, 'The')", points("The", subject="name"))
search_query("whole_word", "parts", "wholeword:yes small", "regexp_matches(lower(name), '(^|[^\\p{L}\\p{N}_])small($|[^\\p{L}\\p{N}_])')", points("small"))
search_query("fold_diacritics", "words", "ele", "contains(strip_accents(lower(name)), 'ele')", points("ele", subject="strip_accents(lower(name))"), match_diacritics=False)
search_query("filter_macro_documents", "files", compose("doc_1", "document"), "contains(lower(name), 'doc_1') and ext in ('txt', 'md')", " + ".join([points("doc_1"), *[points(e) for e in "doc docx xls xlsx ppt pptx pdf txt md rtf".split()]]))
search_query("regex_macro", "files", compose("^doc_[0-9]+_src[12]", regex=True), "regexp_matches(name, '^doc_[0-9]+_src[12]')", "20")


# -- children ----------------------------------------------------------------------------


def child_query(name: str, text: str, where: str, score: str = "0", having: str = "") -> None:
    def run(spark, sf_dir):
        nodes = V.tree_nodes(spark, sf_dir).withColumns({"path": F.col("name"), "last_write_time": F.lit(0).cast("long"), "attributes": F.lit(0)})
        c = Catalog(nodes, now=NOW)
        return c.matches(c.parse(text), SearchOptions()).select("id", "score")

    Q[name] = run
    facts = "facts as (select parent_id as p, count(*) as n, count(*) filter (not directory) as files, count(*) filter (directory) as folders" + (f", bool_or({having}) as flag" if having else "") + " from tree where parent_id <> 0 and parent_id <> id group by parent_id)"
    SQL[name] = f"with tree as ({PRELUDE['tree']}), {facts} select id, ({score})::int as score from tree left join facts on id = p where {where}"


child_query("child_name", "child:_part17.", "directory and coalesce(flag, false)", points("_part17."), "contains(lower(name), '_part17.')")
child_query("child_glob", "child:item7_?_*.ro", "directory and coalesce(flag, false)", "20", "regexp_matches(lower(name), 'item7_._.*\\.ro')")
child_query("empty_dir", "empty:", "directory and coalesce(n, 0) = 0")
child_query("childcount", "childcount:>=9", "directory and coalesce(n, 0) >= 9")
child_query("childfilecount", "childfilecount:3-4", "directory and coalesce(files, 0) between 3 and 4")
child_query("childfoldercount", "folder: childfoldercount:>12", "directory and coalesce(folders, 0) > 12")
child_query("folder_only", "folder: order_1", "directory and contains(lower(name), 'order_1')", points("order_1"))
child_query("file_only", "file: item", "not directory and contains(lower(name), 'item')", points("item"))
child_query("not_empty", "!empty: order_12", "not (directory and coalesce(n, 0) = 0) and contains(lower(name), 'order_12')", points("order_12"))


# -- score, sorts, top-k, duplicates -------------------------------------------------------


def sort_query(name: str, kind: str, text: str, where: str, order: str, score: str, limit: int, chosen: str | None = None, **options) -> None:
    """The first ``limit`` rows with their rank."""

    def run(spark, sf_dir):
        c = Catalog(KINDS[kind](spark, sf_dir), now=NOW)
        return c.search(text, SearchOptions(limit=limit, **options), ["id", "score"], ranked=True)

    Q[name] = run
    page = f"select * from (select *, ({score})::int as score from {kind} where {where})"
    page += f" order by {chosen} limit {limit}" if chosen else ""
    sql(name, kind, select=f"select id, score, rank::int as rank from (select id, score, row_number() over (order by {order}) as rank from ({page})) where rank <= {limit}")


TIES = f"{nat('path')}, id"
sort_query("score_relevance", "files", "doc_1", "contains(lower(name), 'doc_1')", f"score desc, {TIES}", points("doc_1"), 1000, "score desc, id")
sort_query("topk_relevance_two_stage", "files", "src1 OR doc_2", "contains(lower(name), 'src1') or contains(lower(name), 'doc_2')", f"score desc, {TIES}", f"{points('src1')} + {points('doc_2')}", 50, "score desc, id")
sort_query("sort_name_natural", "files", "src", "contains(lower(name), 'src')", f"{nat('name')}, {TIES}", points("src"), 500, sort="name")
sort_query("sort_path", "files", "src1", "contains(lower(name), 'src1')", f"{TIES}", points("src1"), 500, sort="path")
sort_query("sort_size_desc", "files", "doc", "contains(lower(name), 'doc')", f"size desc, {nat('path')} desc, id desc", points("doc"), 200, sort="size", descending=True)
sort_query("sort_mtime", "files", "ext:md", "ext = 'md'", f"mtime, {TIES}", points("md"), 100, sort="last_write_time")
sort_query("sort_attrs", "files", "doc", "true", f"attributes, {TIES}", points("doc"), 300, sort="attributes")
sort_query("sort_ext_dirs_first", "files", "doc_", "true", f"{nat('ext')}, {TIES}", points("doc_"), 300, sort="extension")
sort_query("sort_tiebreak", "files", "doc", "true", TIES, points("doc"), 400, sort="run_count")
sort_query("sort_relevance_desc", "files", "doc_1 OR src2", "contains(lower(name), 'doc_1') or contains(lower(name), 'src2')", f"score, {nat('path')} desc, id desc", f"{points('doc_1')} + {points('src2')}", 100, descending=True)
sort_query("count_cap", "files", "count:25 src", "contains(lower(name), 'src')", f"{nat('name')}, {TIES}", points("src"), 25, sort="name")


def dupe_query(name: str, mode: str, key: str) -> None:
    def run(spark, sf_dir):
        c = Catalog(V.parts(spark, sf_dir), now=NOW)
        return c.matches(c.parse(f"file: dupe:{mode}"), SearchOptions()).select("id", "size")

    Q[name] = run
    sql(name, "parts", select=f"select id, size from (select *, count(*) over (partition by {key}) as n from parts) where n >= 2")


dupe_query("dupe_name", "name", "lower(name)")
dupe_query("dupe_size", "size", "size")
dupe_query("dupe_name_size", "name-size", "lower(name), size")


# -- hierarchy ---------------------------------------------------------------------------


@query("path_derivation")
def _(spark, sf_dir):
    return hierarchy.derive_paths(V.tree_nodes(spark, sf_dir), 1, "D:")


sql("path_derivation", "tree", select="""
  , c as (select id, 'D:' || chr(92) || name as path from tree where parent_id = 1),
  o as (select t.id, c.path || chr(92) || t.name as path from tree t join c on t.parent_id = c.id),
  l as (select t.id, o.path || chr(92) || t.name as path from tree t join o on t.parent_id = o.id)
  select * from c union all select * from o union all select * from l""")


@query("path_derivation_odd")
def _(spark, sf_dir):
    """Strays, rings and deep chains."""
    return hierarchy.derive_paths(V.odd_nodes(spark, sf_dir), 1, "D:")


sql("path_derivation_odd", "odd", select="""
  , lost as (select id, 'D:' || chr(92) || '$OrphanFiles' || chr(92) || name as path from odd where parent_id between 6000000000 and 6099999999),
  below as (select t.id, x.path || chr(92) || t.name as path from odd t join lost x on t.parent_id = x.id),
  ring as (select id, 'D:' || chr(92) || '$Cycle' || chr(92) || name as path from odd where id between 7000000000 and 7999999999),
  chain as (select id, 'D:' || chr(92) || array_to_string(list_transform(
      range((id - 8000000000) // 40 * 40, id - 8000000000 + 1), lambda i: 'deep_' || i), chr(92)) as path from odd where id >= 8000000000)
  select * from lost union all select * from below union all select * from ring union all select * from chain""")


@query("affected_descendants")
def _(spark, sf_dir):
    nodes = V.tree_nodes(spark, sf_dir)
    return hierarchy.descendants(nodes, nodes.filter("id between 1000000001 and 1999999999"))


sql("affected_descendants", "tree", select="""
  , c as (select id, id as top from tree where id between 1000000001 and 1999999999),
  o as (select t.id, c.top from tree t join c on t.parent_id = c.id),
  l as (select t.id, o.top from tree t join o on t.parent_id = o.id)
  select * from c union all select * from o union all select * from l""")


# -- deltas and journals -----------------------------------------------------------------


def _delta(spark, sf_dir):
    base = V.files(spark, sf_dir).select("id", "name", "path", "size", "last_write_time", "attributes")
    upserts = base.filter("id % 10 = 3").withColumns({"name": F.concat(F.lit("new_"), "name"), "size": F.col("size") + 1})
    upserts = upserts.union(base.filter("id % 50 = 0").withColumn("id", F.col("id") + 500_000_000))
    return base, upserts, base.filter("id % 10 in (3, 4)").select("id")


DELTA_SQL = """
  select id, name, size from files where id % 10 not in (3, 4)
  union all select id, 'new_' || name, size + 1 from files where id % 10 = 3
  union all select id + 500000000, name, size from files where id % 50 = 0"""


@query("delta_apply")
def _(spark, sf_dir):
    return incremental.apply_delta(*_delta(spark, sf_dir)).select("id", "name", "size")


sql("delta_apply", "files", select=DELTA_SQL)


@query("live_view")
def _(spark, sf_dir):
    base, upserts, removed = _delta(spark, sf_dir)
    blank = [F.lit(None).cast(t).alias(c) for c, t in base.dtypes if c != "id"]
    changes = removed.select(F.lit(1).alias("seq"), F.lit("remove").alias("op"), "id", *blank)
    changes = changes.unionByName(upserts.select(F.lit(2).alias("seq"), F.lit("upsert").alias("op"), *base.columns))
    return incremental.live_view(base, changes).select("id", "name", "size")


sql("live_view", "files", select=DELTA_SQL)


@query("compaction")
def _(spark, sf_dir):
    from shoal.sources.snapshot import read_snapshot, write_snapshot

    folder = new_path(spark, "compaction")
    generation = write_snapshot(incremental.apply_delta(*_delta(spark, sf_dir)), folder)
    return read_snapshot(spark, folder, generation).select("id", "name", "size")


sql("compaction", "files", select=DELTA_SQL)


@query("metadata_reuse")
def _(spark, sf_dir):
    old = V.files(spark, sf_dir).select("id", "name", "path", "size", "last_write_time", "attributes")
    old = old.withColumn("last_write_time", F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("last_write_time")))
    new = old.filter("id % 6 != 1").withColumns({"size": F.lit(0).cast("long"), "last_write_time": F.lit(0).cast("long"), "attributes": F.lit(0), "path": F.when(F.col("id") % 9 == 0, F.concat("path", F.lit("x"))).otherwise(F.col("path"))})
    return incremental.reuse_metadata(new, old).select("id", "size", "last_write_time", "attributes", "state")


sql("metadata_reuse", "files", select="""
  select id, case when s = 'reused' then size else 0 end as size, case when s = 'reused' then mtime else 0 end as last_write_time,
    case when s = 'reused' then attributes else 0 end as attributes, s as state
  from (select *, case when id % 9 = 0 then 'stale' when id % 4 = 0 then 'unknown' else 'reused' end as s from files where id % 6 <> 1)""")


def _late(spark, sf_dir):
    base = V.files(spark, sf_dir).select("id", "name", "path", "size", "last_write_time", "attributes")
    updates = base.filter("id % 3 = 0").select("id", F.when(F.col("id") % 5 == 0, F.lit("moved")).otherwise(F.col("path")).alias("path"), (F.col("size") * 2).alias("size"), (F.col("last_write_time") + 1).alias("last_write_time"), F.lit(1).alias("attributes"))
    updates = updates.union(updates.filter("id % 30 = 0").withColumn("id", F.col("id") + 500_000_000))
    return incremental.apply_metadata(base, updates)


@query("metadata_apply_guard")
def _(spark, sf_dir):
    return _late(spark, sf_dir)[0].select("id", "size", "last_write_time", "attributes")


sql("metadata_apply_guard", "files", select="""
  select id, case when a then size * 2 else size end as size, case when a then mtime + 1 else mtime end as last_write_time,
    case when a then 1 else attributes end as attributes from (select *, id % 3 = 0 and id % 5 <> 0 as a from files)""")


@query("metadata_apply_counts")
def _(spark, sf_dir):
    return _late(spark, sf_dir)[1]


sql("metadata_apply_counts", "files", select="""
  select count(*) filter (id % 5 <> 0) as applied, count(*) filter (id % 5 = 0) + count(*) filter (id % 30 = 0) as stale
  from files where id % 3 = 0""")


@query("hydration_batch")
def _(spark, sf_dir):
    rows = V.files(spark, sf_dir).withColumn("last_write_time", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("last_write_time")))
    return incremental.hydration_batch(rows, 1_000_100, 150)


sql("hydration_batch", "files", select="select id, path from files where id > 1000100 and id % 3 = 0 order by id limit 150")

CLASSIFIED = """
  k as (select j.*, case when reason & 4096 <> 0 then 'old' when reason & 512 <> 0 then 'delete' when reason & 8448 <> 0 then 'name' else 'touch' end as kind,
      case when b.id is null then 0 else 1 end as in_base from journal j left join jbase b on j.file_id = b.id),
  s as (select *, case kind when 'delete' then 0 when 'name' then 1 end as sets from k),
  l as (select *, coalesce(last_value(sets ignore nulls) over (partition by file_id order by usn rows between unbounded preceding and 1 preceding), in_base) as lived from s),
  c as (select *, case when kind = 'delete' and lived = 1 then 'deleted' when kind = 'name' and lived = 0 then 'created' when lived = 0 then 'ignored'
      when kind = 'name' and reason & 8192 <> 0 then 'renamed' else 'updated' end as outcome from l)"""


@query("journal_apply_final")
def _(spark, sf_dir):
    base = V.journal_base(spark, sf_dir)
    return incremental.apply_changes(base, V.journal(spark, sf_dir)).select("id", "parent_id", "name", "directory", "size", "attributes")


SQL["journal_apply_final"] = f"""with journal as ({PRELUDE['journal']}), jbase as ({PRELUDE['jbase']}), {CLASSIFIED},
  f as (select file_id, arg_max(sets, usn) filter (sets is not null) as lives, arg_max(name, usn) filter (kind = 'name') as name,
      arg_max(parent_id, usn) filter (kind = 'name') as parent_id, arg_max(attributes, usn) as attributes
    from c where outcome <> 'ignored' group by file_id)
  select coalesce(f.file_id, b.id) as id, coalesce(f.parent_id, b.parent_id) as parent_id, coalesce(f.name, b.name) as name,
    coalesce(f.attributes, b.attributes) & 16 <> 0 as directory, case when f.file_id is null then b.size else 0 end as size,
    coalesce(f.attributes, b.attributes) as attributes
  from jbase b full join f on b.id = f.file_id where coalesce(f.lives, 1) = 1"""


@query("journal_apply_counts")
def _(spark, sf_dir):
    return incremental.change_counts(V.journal_base(spark, sf_dir), V.journal(spark, sf_dir))


SQL["journal_apply_counts"] = f"""with journal as ({PRELUDE['journal']}), jbase as ({PRELUDE['jbase']}), {CLASSIFIED}
  select count(*) filter (outcome = 'created') as created, count(*) filter (outcome = 'updated') as updated,
    count(*) filter (outcome = 'renamed') as renamed, count(*) filter (outcome = 'deleted') as deleted,
    count(*) filter (outcome = 'ignored') as ignored from c"""


@query("journal_read_clamped")
def _(spark, sf_dir):
    from shoal.sources.snapshot import JournalState, read_changes

    return read_changes(V.journal(spark, sf_dir), 10, JournalState(1, 5, 0, 200), 0x300).select("usn", "file_id", "reason")


sql("journal_read_clamped", "journal", select="select usn, file_id, reason::bigint as reason from journal where usn >= 200 and reason & 768 <> 0")


@query("journal_state")
def _(spark, sf_dir):
    from shoal.sources.snapshot import journal_state

    return journal_state(V.journal(spark, sf_dir))


sql("journal_state", "journal", select="select 0 as journal_id, min(usn) as first_usn, max(usn) + 1 as next_usn from journal")


@query("log_replay")
def _(spark, sf_dir):
    """The journal as a log of six batches, and what is replayed from a cursor within the third."""
    from shoal.sources.logs import JournalLog

    rows = V.journal(spark, sf_dir)
    low, high = rows.agg(F.min("usn"), F.max("usn") + 1).first()
    log = JournalLog(spark, new_path(spark, "log"), "D:", 1)
    ends = [low + (high - low) * i // 6 for i in range(7)]
    for a, b in zip(ends, ends[1:]):
        log.append(rows.filter((F.col("usn") >= a) & (F.col("usn") < b)), a, b)
    return log.replay(low + (high - low) * 5 // 12, rows.schema)[0].select("usn", "file_id", "reason", "name")


sql("log_replay", "journal", select="""
  select usn, file_id, reason::bigint as reason, name from journal
  where usn >= (select min(usn) + (max(usn) + 1 - min(usn)) * 5 // 12 from journal)""")


def _hydrated(spark, sf_dir):
    from shoal.sources.logs import HydrationLog, path_fingerprint

    base = V.files(spark, sf_dir).select("id", "path", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("last_write_time"), F.lit(32).alias("attributes"))
    log = HydrationLog(spark, new_path(spark, "hydration"), "D:", 1)
    for part in (0, 1):
        rows = base.filter((F.col("id") % 3 == 0) & (F.col("id") % 2 >= part))
        seen = F.when(F.col("id") % 5 == 0, F.xxhash64(F.lit("moved"))).otherwise(path_fingerprint())
        log.append(rows.select("id", seen.alias("path_fingerprint"), (F.col("id") + part).alias("size"), F.col("id").alias("last_write_time"), F.lit(33).alias("attributes")))
    return log.replay(base.filter("id % 7 != 0"))


@query("hydration_replay")
def _(spark, sf_dir):
    return _hydrated(spark, sf_dir)[0].select("id", "size", "last_write_time", "attributes")


sql("hydration_replay", "files", select="""
  select id, case when a then id + id % 2 else 0 end as size, case when a then id else 0 end as last_write_time, case when a then 33 else 32 end as attributes
  from (select id, id % 3 = 0 and id % 5 <> 0 as a from files where id % 7 <> 0)""")


@query("hydration_replay_counts")
def _(spark, sf_dir):
    return _hydrated(spark, sf_dir)[1]


sql("hydration_replay_counts", "files", select="""
  select count(*) filter (id % 5 <> 0 and id % 7 <> 0) as applied, count(*) filter (id % 5 = 0 or id % 7 = 0) as stale from files where id % 3 = 0""")


@query("run_history_sort")
def _(spark, sf_dir):
    rows = Catalog(V.files(spark, sf_dir)).rows
    past = rows.filter("id % 3 = 0").select(F.upper("path").alias("path"), (F.col("id") % 17).alias("run_count"), (F.col("id") * 2).alias("last_open_time"))
    rows = with_run_history(rows, past)
    order = history_order("run_count", True)
    return rows.orderBy(*order).limit(300).select("id", "run_count", "last_open_time", F.row_number().over(W.orderBy(*order)).alias("rank"))


sql("run_history_sort", "files", select=f"""
  select * from (select id, r as run_count, o as last_open_time, (row_number() over (order by r desc, {nat('path')} desc, id desc))::int as rank
    from (select *, case when id % 3 = 0 then id % 17 else 0 end as r, case when id % 3 = 0 then id * 2 else 0 end as o from files)) where rank <= 300""")


@query("multi_volume_union")
def _(spark, sf_dir):
    a, b = V.files(spark, sf_dir).select("id", "name", "size"), V.parts(spark, sf_dir).select("id", "name", "size")
    return incremental.union_volumes({"D:": a, "E:": b}).select("volume", "id", "name", "size")


sql("multi_volume_union", "files", "parts", select="select 'D:' as volume, id, name, size from files union all select 'E:', id, name, size from parts")


@query("storage_stats")
def _(spark, sf_dir):
    return incremental.storage_stats(V.files(spark, sf_dir))


sql("storage_stats", "files", select="""
  select count(*) as records, 0::bigint as directories, count(*) as files, sum(length(name))::bigint as name_chars, sum(length(path))::bigint as path_chars,
    sum(size)::bigint as bytes, 0::bigint as unknown from files""")


@query("watch_bursts")
def _(spark, sf_dir):
    from shoal.streaming.journal import bursts

    e = V.table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("root"), F.lit("modified").alias("action"), F.lit("").alias("path"))
    out = bursts(e, "5 minutes")
    return out.select("root", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSS").alias("start"), "changes")


SQL["watch_bursts"] = """
  with g as (select event_type as root, ts, case when ts < lag(ts) over w + interval 5 minutes then 0 else 1 end as fresh from events
      window w as (partition by event_type order by ts)),
  b as (select *, sum(fresh) over (partition by root order by ts rows unbounded preceding) as n from g)
  select root, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') as start, count(*) as changes from b group by root, n"""


# -- content -----------------------------------------------------------------------------


_STORED: dict[tuple, str] = {}


def _index(spark, sf_dir) -> content.ContentIndex:
    """The stored index of the documents: built and saved once a session, then only read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    key = (spark.sparkContext.applicationId, sf_dir, fs.getFileStatus(path).getModificationTime(), fs.getContentSummary(path).getLength())
    if key not in _STORED:
        folder = new_path(spark, "content")
        content.ContentIndex.build(V.table(spark, sf_dir, "documents"), key="doc_id", shard="source").save(folder)
        _STORED[key] = folder
    return content.ContentIndex.load(spark, _STORED[key])


def content_query(name: str, text: str, where: str, terms: list[str], extra: str = "") -> None:
    """Documents that match, without weights."""

    def run(spark, sf_dir):
        return _index(spark, sf_dir).matches(text).select("doc")

    Q[name] = run
    flags = ", ".join(f"coalesce(bool_or({t}), false) as f{i}" for i, t in enumerate(terms))
    sql(name, "tokens", select=f"{extra} , m as (select doc_id, {flags} from tokens group by doc_id) select d.doc_id as doc from documents d left join m using (doc_id) where {where}")


_PAIR = ", nxt as (select *, lead(term) over (partition by doc_id order by pos) as after from tokens)"
content_query("content_and", "the und", "coalesce(f0 and f1, false)", ["term = 'the'", "term = 'und'"])
content_query("content_and_words", "idiot the", "coalesce(f0 and f1, false)", ["term = 'idiot'", "term = 'the'"])
content_query("content_or_not", "(idiot OR clown) NOT moron", "coalesce((f0 or f1) and not f2, false)", ["term = 'idiot'", "term = 'clown'", "term = 'moron'"])
content_query("content_not_only", "NOT the", "not coalesce(f0, false)", ["term = 'the'"])
content_query("content_xor", "idiot XOR clown", "coalesce(f0 <> f1, false)", ["term = 'idiot'", "term = 'clown'"])
content_query("content_prefix", "wort* the", "coalesce(f0 and f1, false)", ["starts_with(term, 'wort')", "term = 'the'"])
content_query("content_lovehate", "+the -of and", "coalesce(f0 and f2 and not f1, false)", ["term = 'the'", "term = 'of'", "term = 'and'"])


@query("content_phrase")
def _(spark, sf_dir):
    return _index(spark, sf_dir).matches('"of the"').select("doc")


sql("content_phrase", "tokens", select=f"{_PAIR} select distinct doc_id as doc from nxt where term = 'of' and after = 'the'")

BM25 = """
  , len as (select d.doc_id, d.source, coalesce(n, 0) as n from documents d left join (select doc_id, count(*) as n from tokens group by doc_id) using (doc_id)),
  tot as (select count(*)::double as docs, avg(n) as mean from len),
  tf as (select doc_id, count(*) filter (term = 'idiot') as a, count(*) filter (term = 'the') as b from tokens where term in ('idiot', 'the') group by doc_id),
  df as (select count(*) filter (a > 0) as a, count(*) filter (b > 0) as b from tf),
  w as (select doc_id as doc, source as shard,
      ln(1 + (docs - df.a + 0.5) / (df.a + 0.5)) * tf.a * 2.0::double / (tf.a + 1.0::double * (0.5::double + 0.5::double * n / mean))
      + ln(1 + (docs - df.b + 0.5) / (df.b + 0.5)) * tf.b * 2.0::double / (tf.b + 1.0::double * (0.5::double + 0.5::double * n / mean)) as weight
    from tf join len using (doc_id), tot, df where tf.a > 0 or tf.b > 0)"""


@query("content_bm25_topk")
def _(spark, sf_dir):
    return _index(spark, sf_dir).search("idiot OR the", 50).select("doc", "shard", "relevance_percent", F.round("weight", 6).alias("weight"))


sql("content_bm25_topk", "tokens", select=f"""{BM25}, t as (select * from w order by weight desc, lower(doc::varchar) limit 50)
  select doc, shard, round(100 * weight / max(weight) over ())::int as relevance_percent, round(weight, 6) as weight from t""")


@query("content_shard_merge")
def _(spark, sf_dir):
    """Every shard is searched by itself, so its percentages are those of its own best; all are merged."""
    index = _index(spark, sf_dir)
    return content.merge_shards(index.shard_pages("idiot OR the", 20), 100).select("doc", "shard", "relevance_percent")


sql("content_shard_merge", "tokens", select=f"""{BM25},
  own as (select *, row_number() over (partition by shard order by weight desc, lower(doc::varchar)) as n, max(weight) over (partition by shard) as top from w)
  select doc, shard, round(100 * weight / top)::int as relevance_percent from own where n <= 20
  order by relevance_percent desc, lower(doc::varchar) limit 100""")


@query("content_shard_topk")
def _(spark, sf_dir):
    return _index(spark, sf_dir).search_shards("idiot OR the", 20, 200).select("doc", "shard", "relevance_percent")


sql("content_shard_topk", "tokens", select=f"""{BM25},
  own as (select *, row_number() over (partition by shard order by weight desc, lower(doc::varchar)) as n from w),
  t as (select doc, shard, weight from own where n <= 20 order by weight desc, lower(doc::varchar) limit 200)
  select doc, shard, round(100 * weight / max(weight) over ())::int as relevance_percent from t""")


@query("content_shards_of_roots")
def _(spark, sf_dir):
    path = F.concat(F.lit("D:\\"), "lang", F.lit("\\"), F.col("doc_id").cast("string"))
    docs = V.table(spark, sf_dir, "documents").select(path.alias("path"), "text")
    index = content.ShardedContentIndex.build(docs, ["D:\\en", "D:\\de", "d:/fr/", "D:\\es"])
    return index.search("idiot OR the", 100).select("doc", "relevance_percent", F.round("weight", 6).alias("weight"))


sql("content_shards_of_roots", "tokens", select="""
  , len as (select d.doc_id, d.lang, coalesce(n, 0) as n from documents d left join (select doc_id, count(*) as n from tokens group by doc_id) using (doc_id)),
  tot as (select lang, count(*)::double as docs, avg(n) as mean from len group by lang),
  tf as (select doc_id, count(*) filter (term = 'idiot') as a, count(*) filter (term = 'the') as b from tokens where term in ('idiot', 'the') group by doc_id),
  df as (select lang, count(*) filter (a > 0) as da, count(*) filter (b > 0) as db from tf join len using (doc_id) group by lang),
  w as (select 'D:' || chr(92) || lang || chr(92) || doc_id as doc, lang,
      ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.0::double / (a + 1.0::double * (0.5::double + 0.5::double * n / mean))
      + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.0::double / (b + 1.0::double * (0.5::double + 0.5::double * n / mean)) as weight
    from tf join len using (doc_id) join tot using (lang) join df using (lang)),
  own as (select *, row_number() over (partition by lang order by weight desc, lower(doc)) as n, max(weight) over (partition by lang) as top from w)
  select doc, round(100 * weight / top)::int as relevance_percent, round(weight, 6) as weight from own where n <= 100
  order by relevance_percent desc, lower(doc) limit 100""")


@query("content_estimated")
def _(spark, sf_dir):
    return _index(spark, sf_dir).matches("the").agg(F.count(F.lit(1)).alias("estimated_matches"))


sql("content_estimated", "tokens", select="select count(distinct doc_id) as estimated_matches from tokens where term = 'the'")


@query("content_status")
def _(spark, sf_dir):
    return content.overall_status(_index(spark, sf_dir).status())


SQL["content_status"] = "select count(*) as documents, true as ready, false as indexing from documents"


@query("content_postings")
def _(spark, sf_dir):
    rows = _index(spark, sf_dir).postings
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("occurrences"), F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)).alias("positions"))


sql("content_postings", "tokens", select="select term, count(distinct doc_id) as docs, count(*) as occurrences, sum(pos)::bigint as positions from tokens group by term")


@query("content_path_filter")
def _(spark, sf_dir):
    rows = V.files(spark, sf_dir)
    ok = content.accepted(F.col("path"), "D:\\en", ("src1", "D:\\en\\src2"))
    return rows.filter(ok).select("id", "path")


sql("content_path_filter", "files", select="select id, path from files where lang = 'en' and source not in ('src1', 'src2')")


@query("content_supported")
def _(spark, sf_dir):
    from shoal.sources.extract import is_supported

    return V.typed_files(spark, sf_dir).filter(is_supported(F.col("path"))).select("id", "path")


sql("content_supported", select=f"""
  select id, path from (select p_partkey as id, 'D:' || chr(92) || 'f' || p_partkey || '.' || {V.EXTENSIONS!r}[p_partkey % {len(V.EXTENSIONS)} + 1] as path from part)
  where regexp_matches(lower(path), '\\.({"|".join(V.SUPPORTED)})$')""")


@query("content_upsert")
def _(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    index = _index(spark, sf_dir)
    new = docs.filter("doc_id % 20 = 0").withColumn("text", F.lit("fresh marker text"))
    return index.upsert(new, docs.filter("doc_id % 20 = 1").select(F.col("doc_id").alias("doc")), key="doc_id", shard="source").matches("the OR marker").select("doc")


sql("content_upsert", "tokens", select="select distinct doc_id as doc from tokens where term in ('the', 'marker') and doc_id % 20 not in (0, 1) union select doc_id from documents where doc_id % 20 = 0")


@query("content_hits")
def _(spark, sf_dir):
    out = _index(spark, sf_dir).hits("idiot OR clown", 100)
    marks = F.transform("highlights", lambda h: F.concat_ws(":", h["start"].cast("string"), h["length"].cast("string")))
    return out.withColumn("highlights", F.array_join(marks, " "))


SQL["content_hits"] = f"""with tokens as ({PRELUDE['tokens']}) {BM25.replace("'idiot'", "'clown'").replace("'the'", "'idiot'")},
  t as (select * from w order by weight desc, lower(doc::varchar) limit 100),
  p as (select doc, shard, round(100 * weight / max(weight) over ())::int as relevance_percent, text from t join documents on doc_id = doc),
  u as (select doc, unnest(l) as piece, generate_subscripts(l, 1) as n
    from (select doc, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') as l from p)),
  v as (select *, sum(length(piece)) over (partition by doc order by n) as e from u),
  h as (select doc, e - length(piece) as s, e from v where lower(piece) in ('idiot', 'clown')),
  c as (select a.doc, a.s, count(*) as many, max(b.e) as far from h a join h b on a.doc = b.doc and b.s >= a.s and b.e <= a.s + 260 group by a.doc, a.s),
  best as (select * from c qualify row_number() over (partition by doc order by many desc, s) = 1),
  b as (select p.*, greatest(0, least(s - (260 - (far - s)) // 2, length(text) - 260)) as begins from p join best using (doc)),
  inside as (select b.doc, max(h.s) as s from b join h on h.doc = b.doc and h.s < begins and begins < h.e group by b.doc),
  z as (select b.*, coalesce(inside.s, begins)::bigint as a, least(length(text), coalesce(inside.s, begins) + 260)::bigint as o from b left join inside using (doc)),
  m as (select z.doc, string_agg((h.s - a + case when a > 0 then 3 else 0 end)::bigint || ':' || (h.e - h.s)::bigint, ' ' order by h.s) as highlights
    from z join h on h.doc = z.doc and h.s >= a and h.e <= o group by z.doc)
  select doc, shard, relevance_percent, case when a > 0 then '...' else '' end || substr(text, a + 1, o - a) || case when o < length(text) then '...' else '' end as snippet,
    coalesce(highlights, '') as highlights from z left join m using (doc)"""


@query("snapshot_round_trip")
def _(spark, sf_dir):
    from shoal.sources.snapshot import read_snapshot, write_snapshot

    folder = new_path(spark, "snapshot")
    generation = write_snapshot(V.files(spark, sf_dir), folder)
    return read_snapshot(spark, folder, generation).select("id", "path", "size")


sql("snapshot_round_trip", "files", select="select id, path, size from files")


@query("efu_round_trip")
def _(spark, sf_dir):
    from shoal.sources import efu

    folder = new_path(spark, "efu")
    efu.write(V.files(spark, sf_dir), folder)
    return efu.read(spark, folder).select("path", "name", "size", "last_write_time", "attributes")


sql("efu_round_trip", "files", select="select path, name, size, mtime as last_write_time, attributes from files")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file: ext:txt;md doc size:>1kb``, the best hundred."""
    c = Catalog(V.files(spark, sf_dir), now=NOW)
    return c.search('file: ext:txt;md "doc" size:>1kb', SearchOptions(), ["id", "name", "path", "size", "score"], ranked=True)


Q["flagship"] = flagship
sql("flagship", "files", select=f"""
  , m as (select *, ({points('txt')} + {points('doc')})::int as score from files where ext in ('txt', 'md') and contains(lower(name), 'doc') and size > 1024),
  t as (select * from m order by score desc, id limit 100)
  select id, name, path, size, score, (row_number() over (order by score desc, {TIES}))::int as rank from t""")

__all__ = ["Q", "SQL", "flagship", "unsigned"]
