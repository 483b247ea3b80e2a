"""Catalog search: a query text and options to a DataFrame of ranked rows."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timezone, tzinfo

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from shoal.functions.text import enrich, natural_key
from shoal.model import FIRST_PAGE, RECORD, SERVICE_BYTES, SERVICE_LIMIT, SearchOptions
from shoal.operators.hierarchy import with_child_facts
from shoal.plans.compiler import Compiler, InvalidPattern
from shoal.plans.parser import Query, QueryError, parse


def unsigned(column: str) -> list[Column]:
    """Sort keys of a number in unsigned order."""
    return [F.shiftrightunsigned(column, 1), F.col(column).bitwiseAND(1)]


def sort_keys(sort: str, descending: bool) -> list[Column]:
    """Keys of a sort with its tie-breaks (natural path, then id); descending turns all."""
    ties = [F.col("path_nat"), *unsigned("id")]
    if sort == "relevance":
        keys = [-F.col("score")]
    elif sort in ("extension", "type"):
        keys = [(~F.col("directory")).cast("int"), natural_key(F.col("ext"))]
    elif sort in ("name", "path"):
        keys = [F.col(sort + "_nat")]
    elif sort == "size":
        keys = unsigned("size")
    elif sort in ("last_write_time", "attributes", "creation_time", "last_access_time", "change_time"):
        keys = [F.col(sort)]
    elif sort in ("run_count", "last_open_time", "file_list_name"):
        keys = []
    else:
        raise ValueError(f"unknown sort: {sort}")
    return [k.desc() if descending else k.asc() for k in [*keys, *ties]]


def duplicates(rows: DataFrame, mode: str) -> DataFrame:
    """Rows whose key occurs at least twice.  The counts are summed map-side and joined
    back, so that adaptive execution can split a key that many rows share."""
    key = {"name": [F.lower("name")], "size": [F.col("size")], "name_size": [F.lower("name"), F.col("size")]}[mode]
    named = [k.alias(f"__k{i}") for i, k in enumerate(key)]
    on = [f"__k{i}" for i in range(len(key))]
    often = rows.groupBy(*named).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    return rows.select("*", *named).join(often, on, "left_semi").drop(*on)


class Catalog:
    """A catalog that can be searched.  ``now``, ``tz`` and the first day of the week fix
    what relative dates mean."""

    def __init__(self, rows: DataFrame, now: datetime | None = None, tz: tzinfo = timezone.utc, first_day_of_week: int = 0):
        self.rows, self.now, self.tz, self.first = enrich(rows), now, tz, first_day_of_week

    @classmethod
    def from_df(cls, rows: DataFrame, **kw) -> "Catalog":
        return cls(rows, **kw)

    @classmethod
    def from_efu(cls, spark, path: str, **kw) -> "Catalog":
        """A file list to search instead of the live catalog."""
        from shoal.sources import efu

        return cls(efu.read(spark, path), **kw)

    def parse(self, text: str) -> Query:
        return parse(text, self.now, self.tz, self.first)

    def matches(self, query: Query, options: SearchOptions) -> DataFrame:
        """All rows that match, with their score, before duplicates, sort and limit."""
        compiled = Compiler(self.rows.sparkSession, query, options).compile()
        rows = self.rows
        if compiled.needs_counts or compiled.child_flags:
            rows = with_child_facts(rows, compiled.needs_counts, compiled.child_flags)
        rows = rows.filter(compiled.predicate).withColumn("score", compiled.score)
        return duplicates(rows, query.duplicates) if query.duplicates else rows

    def search(self, text: str, options: SearchOptions | None = None, columns: list[str] | None = None, ranked: bool = False) -> DataFrame:
        """Rows in order; ``ranked`` adds their place as ``rank``.  A text that is no
        query, or asks for nothing, finds nothing."""
        options = options or SearchOptions()
        shown = [*(columns or RECORD), "score"] if "score" not in (columns or []) else list(columns)
        shown = [c for c in shown if c in self.rows.columns or c == "score"]
        try:
            query = self.parse(text)
            limit = min(options.limit, options.limit if query.max_results is None else query.max_results)
            nothing = limit == 0 or (not query.terms and query.directories_only is None)
            found = None if nothing else self.matches(query, options)
        except (QueryError, InvalidPattern):
            found = None
        if found is None:
            out = self.rows.withColumn("score", F.lit(0)).limit(0).select(*shown)
            return out.withColumn("rank", F.lit(0)) if ranked else out
        keys = sort_keys(options.sort, options.descending)
        if options.sort == "relevance" and not options.descending and not query.duplicates:
            # The page is chosen by score and id, then shown by score and path.
            found = found.orderBy(F.desc("score"), *unsigned("id")).limit(limit)
            out = found.orderBy(*keys)
        else:
            out = found.orderBy(*keys).limit(limit)
        if ranked:  # at most ``limit`` rows are left
            return out.select(*shown, F.row_number().over(W.orderBy(*keys)).alias("rank"))
        return out.select(*shown)


def serve(catalog: Catalog, text: str, options: SearchOptions, most_bytes: int = SERVICE_BYTES) -> DataFrame:
    """A search as a service answers it: at most ``SERVICE_LIMIT`` rows, and of those the first that
    fit ``most_bytes`` with names and paths in UTF-16 and 80 bytes of numbers a row."""
    page = catalog.search(text, replace(options, limit=min(options.limit, SERVICE_LIMIT)), ranked=True)
    size = 80 + F.octet_length(F.encode("name", "UTF-16BE")) + F.octet_length(F.encode("path", "UTF-16BE"))
    upto = W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)  # a page at most
    return page.withColumn("__bytes", F.sum(size).over(upto)).filter(F.col("__bytes") <= most_bytes).orderBy("rank").drop("__bytes", "rank")


def interactive(catalog: Catalog, text: str, options: SearchOptions):
    """The pages to show while someone types: the first ``FIRST_PAGE`` rows and, if there may be more, the whole page."""
    first = catalog.search(text, replace(options, limit=min(options.limit, FIRST_PAGE))).toArrow()  # a page
    yield catalog.rows.sparkSession.createDataFrame(first)
    if first.num_rows == FIRST_PAGE < options.limit:
        yield catalog.search(text, options)


# -- rewriting by a client ---------------------------------------------------------------

#: Extensions of the named filters (fixed values).
FILTERS = {
    "audio": "mp3 wav flac aac m4a ogg wma",
    "archive": "zip 7z rar tar gz bz2 xz",
    "document": "doc docx xls xlsx ppt pptx pdf txt md rtf",
    "executable": "exe com bat cmd msi ps1",
    "picture": "jpg jpeg png gif bmp webp tif tiff svg ico",
    "video": "mp4 mkv avi mov wmv webm m4v flv",
}


def filter_text(name: str, saved: dict[str, str] | None = None) -> str:
    """The query text of a named or a saved filter."""
    if name in FILTERS:
        return "(" + " OR ".join(f"ext:{e}" for e in FILTERS[name].split()) + ")"
    if name == "folder":
        return "folder:"
    return (saved or {})[name]


def compose(text: str, filter_name: str | None = None, regex: bool = False, saved: dict[str, str] | None = None) -> str:
    """The text that is searched for: a regular expression is quoted, a filter is added."""
    if regex and text:
        quoted = text.replace("\\", "\\\\").replace('"', '\\"')
        text = f'regex:"{quoted}"'
    if not filter_name:
        return text
    extra = filter_text(filter_name, saved)
    return f"({text}) {extra}" if text else extra


def with_run_history(rows: DataFrame, history: DataFrame) -> DataFrame:
    """run_count and last_open_time by lower-cased path, 0 where a path was never run."""
    past = history.groupBy(F.lower("path").alias("__path")).agg(F.max("run_count").alias("run_count"), F.max("last_open_time").alias("last_open_time"))
    rows = rows.drop("run_count", "last_open_time")
    out = rows.join(past, F.lower(rows["path"]) == F.col("__path"), "left").drop("__path")
    return out.fillna(0, ["run_count", "last_open_time"])


def history_order(column: str, descending: bool) -> list[Column]:
    keys = [F.col(column), F.col("path_nat"), *unsigned("id")]
    return [k.desc() if descending else k.asc() for k in keys]
