"""Line dedup by content-defined chunks of lines.

A document's lines are hashed; a rolling polynomial hash over the last ``WINDOW`` line hashes, modulo
a Mersenne prime, ends a chunk where it is 0 modulo ``DIVISOR``.  Boundaries depend on nearby lines
only, so lines inserted or removed elsewhere do not shift them, and a passage that two documents
share is cut alike in both once the window lies in it.  A chunk of several lines whose bytes
occur more than once in the corpus is removed everywhere but at its first place: the
least doc_id that has it (ties by text), and there its first occurrence.  What chunks leave of a shared passage,
its head and tail or a passage of a few lines, is the work of ``passages``.

All of it is DataFrame operations.  Chunks are grouped by their own bytes, map-side
first, so a passage that a third of the documents share is one row a task.  Places of
chunks then meet the repeated ones by SHA-256, without texts, and what a document
loses meets it in a join on a row key, where the document is rebuilt from its chunks.

Defined cases: null text stays null; the empty text has one empty line; a chunk of a
single line always stays, and so do chunks of blank lines only; null ids come after all
others; rows that repeat id and text count as one document and get the same result; rows of one
id with other texts are documents of their own; an empty table gives an empty result; other columns
pass through ``without_repeats``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .shared import as_given, free_names, row_key, text_or_empty

#: Lines that the rolling hash covers, and the mean number of lines of a chunk, about.
WINDOW, DIVISOR = 4, 3
BASE, PRIME = 1_000_003, (1 << 31) - 1


def line_hashes(lines: Column) -> Column:
    """31 bits of each line's MD5, the same in any engine."""
    return F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 10), 16, 10).cast("long") % PRIME)


def chunks_of(text: Column) -> Column:
    """array of struct(n lines, chunk text), in order."""
    lines = F.split(text, "\n", -1)
    hashes = line_hashes(lines)

    def rolled(i: Column, all_hashes: Column) -> Column:
        """Of the last ``WINDOW`` lines; at a text's start of those that there are."""
        terms = [F.coalesce(F.get(all_hashes, i - back), F.lit(0)) * pow(BASE, back, PRIME) % PRIME for back in range(WINDOW)]
        return sum(terms[1:], terms[0]) % PRIME

    def cut(all_: Column) -> Column:  # all_: struct(lines, hashes)
        last = F.size(all_["lines"]) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (rolled(i, all_["hashes"]) % DIVISOR == 0))
        return pieces(all_["lines"], ends)

    def pieces(all_lines: Column, ends: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(ends, lambda e: e + 1))
        spans = F.arrays_zip(F.slice(starts, F.lit(1), F.size(ends)).alias("a"), ends.alias("b"))
        return F.transform(
            spans,
            lambda s: F.struct(
                (s["b"] - s["a"] + 1).alias("n"),
                F.array_join(F.slice(all_lines, s["a"] + 1, s["b"] - s["a"] + 1), "\n").alias("text"),
            ),
        )

    # A lambda over an array of one element evaluates lines and hashes once.
    one = F.array(F.struct(lines.alias("lines"), hashes.alias("hashes")))
    return F.element_at(F.transform(one, cut), 1)


def places(docs: DataFrame) -> DataFrame:
    """row, id, at (chunk number), text of each chunk that may be removed: of several lines, not all blank."""
    late = (1 << 63) - 1  # null ids come last
    found = docs.select(
        row_key(F.col("doc_id"), F.col("text")).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(late)).alias("id"),
        F.posexplode(chunks_of(text_or_empty())).alias("at", "c"),
    )
    found = found.filter((F.col("c.n") > 1) & F.col("c.text").rlike(r"[^\s]"))
    return found.select("row", "id", "at", F.col("c.text").alias("text"))


def repeats(docs: DataFrame) -> DataFrame:
    """row, gone (chunk numbers to remove) of each document that loses any."""
    rows = places(docs)
    sha = F.unhex(F.sha2("text", 256)).alias("sha")
    shared = rows.groupBy("text").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "row")).alias("keeper"))
    shared = shared.filter("times > 1").select(sha, "keeper.id", "keeper.row").toDF("sha", "keeper", "first")
    met = rows.select("row", "id", "at", sha).distinct().join(shared, "sha")
    own = (F.col("id") == F.col("keeper")) & (F.col("row") == F.col("first"))
    late = met.filter(~own).select("row", "at")
    twins = W.partitionBy("row", "sha").orderBy("at")
    again = met.filter(own).withColumn("n", F.row_number().over(twins)).filter("n > 1").select("row", "at")
    return late.union(again).groupBy("row").agg(F.collect_set("at").alias("gone"))


def rebuilt(docs: DataFrame, gone: DataFrame, kept_and_lost) -> DataFrame:
    """``docs`` joined to ``gone`` (row, what): the columns as given, text without what goes, and
    n_lines and n_removed, the numbers of lines that the text had and lost (with underscores
    before them where the table has such columns).  ``kept_and_lost`` maps a text and
    its ``what`` to struct(text, lost)."""
    lines, lost, row, what, done = free_names(docs.columns, "n_lines", "n_removed", "row", "what", "done")
    rows = docs.withColumn(row, row_key(F.col("doc_id"), F.col("text"))).join(gone.toDF(row, what), row, "left")
    # The new text is a column of its own before it takes the old one's place: both counts read the old.
    new = F.when(F.col(what).isNotNull(), kept_and_lost(text_or_empty(), F.col(what)))
    rows = rows.withColumn(done, new)
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    text = F.when(F.col(what).isNull(), F.col("text")).otherwise(F.col(done)["text"]).alias("text")
    return rows.select(
        *[text if c == "text" else as_given([c])[0] for c in docs.columns],
        F.coalesce(breaks + 1, F.lit(0)).cast("long").alias(lines),
        F.coalesce(F.col(done)["lost"], F.lit(0)).cast("long").alias(lost),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without repeated chunks; see ``rebuilt``."""

    def kept_and_lost(text: Column, gone: Column) -> Column:
        numbered = F.transform(chunks_of(text), lambda c, i: F.struct(F.array_contains(gone, i).alias("out"), c["n"].alias("n"), c["text"].alias("text")))

        def parts(all_: Column) -> Column:
            kept = F.transform(F.filter(all_, lambda c: ~c["out"]), lambda c: c["text"])
            lost = F.aggregate(all_, F.lit(0).cast("long"), lambda n, c: n + F.when(c["out"], c["n"]).otherwise(0))
            return F.struct(F.array_join(kept, "\n").alias("text"), lost.alias("lost"))

        return F.element_at(F.transform(F.array(numbered), parts), 1)

    return rebuilt(docs, repeats(docs), kept_and_lost)
