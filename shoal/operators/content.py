"""Full-text search: postings, boolean and phrase matching, BM25, snippets, shards.

An index is two tables: postings (doc, term, tf, positions) and documents (doc, length,
shard, text).  A query reads the postings of its own terms only, folds them to one row a
document and evaluates the boolean tree there; a common term costs its postings and nothing
is joined but document lengths.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from shoal.model import CONTENT_LIMIT
from shoal.plans.content_query import TOKEN, Leaf, Op, Tree, leaves, parse, words
from shoal.ship import ship

#: BM25 parameters, and the length of a snippet in characters.
K1, B, SNIPPET = 1.0, 0.5, 260


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def documents_table(docs: DataFrame, key: str = "path", text: str = "text", shard: str | None = None) -> DataFrame:
    """doc, shard, text, length in words."""
    shard_col = F.col(shard) if shard else F.lit("")
    return docs.select(F.col(key).alias("doc"), shard_col.alias("shard"), F.col(text).alias("text"), F.size(tokens(F.coalesce(F.col(text), F.lit("")))).alias("length"))


def postings_table(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """doc, term, tf, positions.  Terms of a document are gathered within it, before any shuffle."""
    rows = docs.select(F.col(key).alias("doc"), F.posexplode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("pos", "term"))
    rows = rows.groupBy("doc", "term").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    return rows.select("doc", "term", F.size("positions").alias("tf"), "positions")


def _totals(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))


def upsert(old: DataFrame, new: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """An index table with the rows of documents in ``new`` replaced, those in ``removed`` gone."""
    gone = new.select("doc")
    if removed is not None:
        gone = gone.union(removed.select("doc"))
    return old.join(gone.distinct(), "doc", "left_anti").unionByName(new)


def _occurrences(leaf: Leaf, at: dict[str, str]) -> Column:
    """How often a leaf occurs, from the columns of its words' positions."""
    first = F.col(at[leaf.words[0]])
    if len(leaf.words) == 1:
        return F.coalesce(F.size(first), F.lit(0))
    follows = lambda p: reduce(lambda a, b: a & b, [F.array_contains(F.col(at[w]), p + i) for i, w in enumerate(leaf.words) if i])
    return F.coalesce(F.size(F.filter(first, follows)), F.lit(0))


def _truth(tree: Tree, column: dict[Leaf, str]) -> Column:
    if isinstance(tree, Leaf):
        return F.col(column[tree]) > 0
    parts = [_truth(p, column) for p in tree.parts]
    if tree.kind == "not":
        return ~parts[0]
    if tree.kind == "xor":
        return reduce(lambda a, b: a != b, parts)
    return reduce((lambda a, b: a | b) if tree.kind == "or" else (lambda a, b: a & b), parts)


def _can_match_without_words(tree: Tree) -> bool:
    """Would a document with none of the query's words match?"""
    if isinstance(tree, Leaf):
        return False
    parts = [_can_match_without_words(p) for p in tree.parts]
    return {"not": not parts[0], "or": any(parts), "and": all(parts), "xor": sum(parts) % 2 == 1}[tree.kind]


@dataclass
class ContentIndex:
    documents: DataFrame
    postings: DataFrame
    #: One row n, mean: documents and their mean length; derived where an index was not saved.
    totals: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, key: str = "path", text: str = "text", shard: str | None = None) -> "ContentIndex":
        return cls(documents_table(docs, key, text, shard), postings_table(docs, key, text))

    @classmethod
    def load(cls, spark, folder: str, generation: int | None = None) -> "ContentIndex":
        """The latest complete generation, or the one asked for."""
        from shoal.sources.snapshot import generations

        at = f"{folder}/gen={max(generations(spark, folder)) if generation is None else generation}"
        return cls(*[spark.read.parquet(f"{at}/{t}") for t in ("documents", "postings", "totals")])

    def save(self, folder: str) -> int:
        """Write the next generation, whose marker comes last: readers see the one before or all of this, and an
        index may be saved over the folder that it was loaded from.  Postings are range-sorted by
        term, so that a query's scan skips to its terms."""
        from shoal.sources.snapshot import generations, save_json

        spark = self.documents.sparkSession
        generation = max(generations(spark, folder), default=0) + 1
        at, parts = f"{folder}/gen={generation}", int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.documents.write.mode("overwrite").parquet(f"{at}/documents")
        self.postings.repartitionByRange(parts, "term", "doc").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{at}/postings")
        _totals(spark.read.parquet(f"{at}/documents")).write.mode("overwrite").parquet(f"{at}/totals")
        save_json(spark, f"{at}/_SUCCESS", {})
        return generation

    def upsert(self, docs: DataFrame, removed: DataFrame | None = None, key: str = "path", text: str = "text", shard: str | None = None) -> "ContentIndex":
        new = ContentIndex.build(docs, key, text, shard)
        # A document without words has no postings, so what is replaced follows the documents.
        gone = new.documents.select("doc")
        gone = gone.union(removed.select("doc")) if removed is not None else gone
        return ContentIndex(upsert(self.documents, new.documents, removed), self.postings.join(gone.distinct(), "doc", "left_anti").unionByName(new.postings))

    def matches(self, text: str) -> DataFrame | None:
        """doc, shard, weight of every document that matches; None for a text without words."""
        tree = parse(text)
        if tree is None:
            return None
        found = leaves(tree)
        plain = sorted({w for leaf, _ in found for w in leaf.words if not leaf.prefix})
        prefixes = sorted({leaf.words[0] for leaf, _ in found if leaf.prefix})
        wanted = [F.col("term").isin(plain)] if plain else []
        wanted += [F.startswith("term", F.lit(p)) for p in prefixes]
        rows = self.postings.filter(reduce(lambda a, b: a | b, wanted))
        at = {w: f"at_{i}" for i, w in enumerate(plain)}
        sums = [F.max(F.when(F.col("term") == w, F.col("positions"))).alias(c) for w, c in at.items()]
        sums += [F.sum(F.when(F.startswith("term", F.lit(p)), F.col("tf")).otherwise(0)).alias(f"pre_{i}") for i, p in enumerate(prefixes)]
        rows = rows.groupBy("doc").agg(*sums)
        column = {leaf: f"tf_{i}" for i, (leaf, _) in enumerate(found)}
        counts = {c: F.coalesce(F.col(f"pre_{prefixes.index(leaf.words[0])}"), F.lit(0)) if leaf.prefix else _occurrences(leaf, at) for leaf, c in column.items()}
        rows = rows.select("doc", *[v.alias(c) for c, v in counts.items()])
        how = "left" if _can_match_without_words(tree) else "inner"
        rows = self.documents.select("doc", "shard", "length").join(rows, "doc", how).fillna(0, list(counts))
        totals = (_totals(self.documents) if self.totals is None else self.totals).first()  # one row
        plus = [column[leaf] for leaf, positive in found if positive]
        weight = F.lit(0.0)
        if plus:
            df = rows.agg(*[F.count_if(F.col(c) > 0).alias(c) for c in plus]).first()  # one row
            n, mean = totals["n"], max(totals["mean"] or 0.0, 1e-9)
            for c in plus:
                idf = F.lit(1 + (n - df[c] + 0.5) / (df[c] + 0.5))
                norm = K1 * (1 - B + B * F.col("length") / mean)
                weight = weight + F.log(idf) * F.col(c) * (K1 + 1) / (F.col(c) + norm)
        return rows.filter(_truth(tree, column)).select("doc", "shard", weight.alias("weight"))

    def search(self, text: str, limit: int = 100) -> DataFrame:
        """doc, shard, relevance_percent, weight of the best ``limit`` documents (at most
        ``CONTENT_LIMIT``), best first, ties by lower-cased doc."""
        limit = min(limit, CONTENT_LIMIT)
        found = self.matches(text) if limit > 0 else None
        if found is None:
            empty = self.documents.limit(0)
            return empty.select("doc", "shard", F.lit(0).alias("relevance_percent"), F.lit(0.0).alias("weight"))
        best = found.orderBy(F.desc("weight"), F.lower(F.col("doc").cast("string"))).limit(limit)
        top = F.max("weight").over(W.partitionBy())  # over the page
        percent = F.when(top > 0, F.round(100 * F.col("weight") / top)).otherwise(100).cast("int")
        return best.select("doc", "shard", percent.alias("relevance_percent"), "weight").orderBy(F.desc("weight"), F.lower(F.col("doc").cast("string")))

    def search_shards(self, text: str, each: int, limit: int = 100) -> DataFrame:
        """Like ``search``, from the best ``each`` documents of every shard of the index."""
        found = self.matches(text) if min(each, limit) > 0 else None
        if found is None:
            return self.search(text, 0)
        order = [F.desc("weight"), F.lower(F.col("doc").cast("string"))]
        own = found.withColumn("n", F.row_number().over(W.partitionBy("shard").orderBy(*order))).filter(F.col("n") <= each)
        best = own.orderBy(*order).limit(min(limit, CONTENT_LIMIT))
        top = F.max("weight").over(W.partitionBy())  # over the page
        percent = F.when(top > 0, F.round(100 * F.col("weight") / top)).otherwise(100).cast("int")
        return best.select("doc", "shard", percent.alias("relevance_percent"), "weight").orderBy(*order)

    def shard_pages(self, text: str, each: int) -> DataFrame:
        """doc, shard, relevance_percent, weight of the best ``each`` documents of every shard; the
        percentages are shares of the shard's own best weight."""
        found = self.matches(text) if each > 0 else None
        if found is None:
            return self.search(text, 0)
        own = W.partitionBy("shard")
        ranked = found.withColumn("n", F.row_number().over(own.orderBy(F.desc("weight"), F.lower(F.col("doc").cast("string"))))).filter(F.col("n") <= each)
        top = F.max("weight").over(own)
        percent = F.when(top > 0, F.round(100 * F.col("weight") / top)).otherwise(100).cast("int")
        return ranked.select("doc", "shard", percent.alias("relevance_percent"), "weight")

    def estimated_matches(self, text: str) -> int:
        found = self.matches(text)
        return 0 if found is None else found.count()

    def status(self, indexing: bool = False) -> DataFrame:
        """shard, documents, ready, indexing."""
        return self.documents.groupBy("shard").agg(F.count(F.lit(1)).alias("documents"), F.lit(True).alias("ready"), F.lit(indexing).alias("indexing"))

    def hits(self, text: str, limit: int = 100) -> DataFrame:
        """Search results with snippet and highlights (start and length in UTF-16 units)."""
        page = self.search(text, limit).join(self.documents.select("doc", "text"), "doc")
        tree = parse(text)
        wanted = [(leaf.words, leaf.prefix) for leaf, plus in leaves(tree) if plus] if tree else []
        schema = page.select("doc", "shard", "relevance_percent").schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

        def run(frames):
            for f in frames:
                made = [snippet(t or "", wanted) for t in f["text"]]
                f["snippet"] = [m[0] for m in made]
                f["highlights"] = [[{"start": a, "length": n} for a, n in m[1]] for m in made]
                yield f[["doc", "shard", "relevance_percent", "snippet", "highlights"]]

        ship(page.sparkSession)
        return page.mapInPandas(run, f"{schema}, snippet string, highlights array<struct<start:int,length:int>>")


def snippet(text: str, wanted: list[tuple[tuple[str, ...], bool]], most: int = SNIPPET) -> tuple[str, list[tuple[int, int]]]:
    """The stretch of at most ``most`` characters with the most matched words, with ``...``
    where text is left out, and where the matched words are in it."""
    from shoal.plans.content_query import _PY_TOKEN

    full = {w for ws, prefix in wanted for w in ws if not prefix}
    starts = tuple(ws[0] for ws, prefix in wanted if prefix)
    hits = [(m.start(), m.end()) for m in _PY_TOKEN.finditer(text) if (w := m[0].lower()) in full or (starts and w.startswith(starts))]
    hits = [h for h in hits if h[1] - h[0] <= most]
    begin, best, last = 0, 0, 0
    for first in range(len(hits)):
        while last < len(hits) and hits[last][1] <= hits[first][0] + most:
            last += 1
        if last - first > best:
            best, begin = last - first, hits[first][0]
    spare = most - (max((e for s, e in hits if s >= begin and e <= begin + most), default=begin) - begin)
    begin = max(0, min(begin - spare // 2, len(text) - most))
    while 0 < begin and not text[begin - 1].isspace() and any(s < begin < e for s, e in hits):
        begin -= 1
    end = min(len(text), begin + most)
    head, tail = "..." if begin else "", "..." if end < len(text) else ""
    units = lambda s: len(s.encode("utf-16-le", "surrogatepass")) // 2
    marks = [(units(head + text[begin:s]), units(text[s:e])) for s, e in hits if s >= begin and e <= end]
    return head + text[begin:end] + tail, marks


def merge_shards(parts: DataFrame | list[DataFrame], limit: int) -> DataFrame:
    """Results of several shards, in one table or one each: by relevance, then lower-cased doc."""
    rows = reduce(DataFrame.unionByName, parts) if isinstance(parts, list) else parts
    return rows.orderBy(F.desc("relevance_percent"), F.lower(F.col("doc").cast("string"))).limit(limit)


def overall_status(status: DataFrame) -> DataFrame:
    return status.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.bool_and("ready"), F.lit(False)).alias("ready"), F.coalesce(F.bool_or("indexing"), F.lit(False)).alias("indexing"))


# -- roots and paths ---------------------------------------------------------------------

#: Folders that are left out directly below a root, and anywhere (fixed values).
TOP_EXCLUDED = ("windows", "program files", "program files (x86)", "programdata", "$recycle.bin", "system volume information", "recovery")
ANY_EXCLUDED = (".git", ".svn", "node_modules", ".cache", "__pycache__")


def normal_path(path: str) -> str:
    return path.replace("/", "\\").rstrip("\\")


def normalise_roots(roots: list[str]) -> list[str]:
    """Roots without those that another covers."""
    out: list[str] = []
    for root in sorted({normal_path(r) for r in roots}, key=lambda r: (len(r), r.lower(), r)):
        if not any(root.lower() == o.lower() or root.lower().startswith(o.lower() + "\\") for o in out):
            out.append(root)
    return out


def is_within(path: Column, root: str) -> Column:
    low, own = F.lower(F.replace(path, F.lit("/"), F.lit("\\"))), normal_path(root).lower()
    return (low == own) | F.startswith(low, F.lit(own + "\\"))


def accepted(path: Column, root: str, excluded: tuple[str, ...] = (), defaults: bool = True) -> Column:
    """Is a path below a root and not in a folder that is left out?"""
    root = normal_path(root)
    low = F.lower(F.replace(path, F.lit("/"), F.lit("\\")))
    ok = is_within(path, root)
    for e in excluded:
        e = normal_path(e)
        full = e if ":" in e or e.startswith("\\\\") else f"{root}\\{e}"
        ok = ok & ~is_within(path, full)
    if defaults:
        below = F.split(F.substr(low, F.lit(len(root) + 2)), r"\\")
        left_out = F.arrays_overlap(below, F.array(*map(F.lit, ANY_EXCLUDED))) | F.get(below, F.lit(0)).isin(*TOP_EXCLUDED)
        ok = ok & ((low == root.lower()) | ~left_out)
    return ok


def route(path: Column, roots: list[str]) -> Column:
    """The root that a path belongs to; null outside all."""
    out = F.lit(None).cast("string")
    for root in normalise_roots(roots):
        out = F.when(is_within(path, root), F.lit(root)).otherwise(out)
    return out


class ShardedContentIndex:
    """An index of its own for each root.  Shards know only their own documents, so weights and percentages
    are those of a shard; results are merged by percentage."""

    def __init__(self, shards: dict[str, ContentIndex]):
        roots = [normal_path(r) for r in shards]
        if len(normalise_roots(roots)) != len(roots):
            raise ValueError("roots overlap")
        self.shards = dict(zip(roots, shards.values()))

    @classmethod
    def build(cls, docs: DataFrame, roots: list[str], text: str = "text") -> "ShardedContentIndex":
        """Each document goes to the root that its path is in; see ``outside``."""
        routed = docs.withColumn("__root", route(F.col("path"), roots))
        return cls({r: ContentIndex.build(routed.filter(F.col("__root") == normal_path(r)).drop("__root"), text=text) for r in roots})

    @classmethod
    def load(cls, spark, folder: str, roots: list[str]) -> "ShardedContentIndex":
        return cls({r: ContentIndex.load(spark, f"{folder}/{_folder_of(r)}") for r in roots})

    def save(self, folder: str) -> None:
        for root, index in self.shards.items():
            index.save(f"{folder}/{_folder_of(root)}")

    def outside(self, docs: DataFrame) -> DataFrame:
        """Documents that no shard takes."""
        return docs.filter(route(F.col("path"), list(self.shards)).isNull())

    def upsert(self, docs: DataFrame, removed: DataFrame | None = None) -> "ShardedContentIndex":
        """Only shards that a document of ``docs`` or a path of ``removed`` (doc) is in change.  Documents outside all
        roots are refused."""
        if not self.outside(docs).isEmpty():
            raise ValueError("documents outside all roots")
        out = {}
        for root, index in self.shards.items():
            gone = removed.filter(is_within(F.col("doc"), root)) if removed is not None else None
            out[root] = index.upsert(docs.filter(is_within(F.col("path"), root)), gone)
        return ShardedContentIndex(out)

    def search(self, text: str, limit: int = 100) -> DataFrame:
        """doc, relevance_percent, weight of the best of all shards, from the best ``limit`` of each."""
        pages = [i.search(text, limit).select("doc", "relevance_percent", "weight") for i in self.shards.values()]
        return merge_shards(pages, min(limit, CONTENT_LIMIT))

    def estimated_matches(self, text: str) -> int:
        return sum(i.estimated_matches(text) for i in self.shards.values())

    def status(self, indexing: frozenset[str] = frozenset()) -> DataFrame:
        return reduce(DataFrame.unionByName, [i.status(r in indexing).withColumn("shard", F.lit(r)) for r, i in self.shards.items()])


def _folder_of(root: str) -> str:
    return "".join(c if c.isalnum() else f"%{ord(c):X}" for c in normal_path(root).lower())


__all__ = ["ContentIndex", "Op", "ShardedContentIndex", "words"]
