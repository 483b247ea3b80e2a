"""Removal of shared passages: runs of lines with ``LONG`` words or more that occur elsewhere.

The second step of line dedup.  ``lines`` removes whole chunks, so a passage's head and tail stay where
foreign lines share their chunk, and so does a long line by itself.  Here every line starts the shortest run of lines of ``LONG`` words and ends one.  Runs
depend on their own lines only, and those inside a passage cover all its lines, so a passage goes
whole wherever the text around it differs.  A run stays at its first place, the least doc_id and
there the first line; repeats that overlap it go from its end on.

Blank lines count for nothing in a run and go with the lines around them.  Defined cases as in
``lines``: null text stays null, null ids come last, rows that repeat id and text are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .lines import rebuilt
from .shared import WORD, row_key, text_or_empty, written

#: Words of a run, at least.
LONG = 50


def runs(docs: DataFrame) -> DataFrame:
    """row, id, a, b (first and last line), key of each shortest run of ``LONG`` words."""
    rows = docs.select(
        row_key(F.col("doc_id"), F.col("text")).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"),
        F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("at", "line"),
    )
    rows = rows.select("row", "id", "at", F.regexp_count("line", F.lit(WORD)).cast("long").alias("n"), F.unhex(F.sha2("line", 256)).alias("h"))
    rows = rows.filter("n > 0").repartition("row").dropDuplicates(["row", "at"])
    upto = W.partitionBy("row").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("end", F.sum("n").over(upto)).withColumn("begin", F.col("end") - F.col("n"))
    ahead = W.partitionBy("row").orderBy("begin").rangeBetween(0, LONG - 1)
    behind = W.partitionBy("row").orderBy("end").rangeBetween(1 - LONG, 0)

    def run(over):
        return F.when(
            F.sum("n").over(over) >= LONG,
            F.struct(F.min("at").over(over).alias("a"), F.max("at").over(over).alias("b"), F.collect_list("h").over(over).alias("hs")),
        )

    rows = rows.select("row", "id", run(ahead).alias("x"), run(behind).alias("y"))
    rows = rows.select("row", "id", F.explode(F.array_distinct(F.array("x", "y"))).alias("r")).filter("r is not null")
    digest = F.unhex(F.sha2(F.array_join(F.transform("r.hs", lambda h: F.hex(h)), ""), 256))
    return rows.select("row", "id", "r.a", "r.b", F.substring(digest, 1, 16).alias("key")).distinct()


def repeats(docs: DataFrame) -> DataFrame:
    """row, spans (first and last line to remove) of each document that loses any."""
    rows = written(runs(docs), "passages")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "row", "a", "b")).alias("first"))
    met = rows.join(shared.filter("times > 1").select("key", "first"), "key")
    own = F.col("row") == F.col("first.row")
    start = F.when(own, F.greatest("a", F.col("first.b") + 1)).otherwise(F.col("a"))
    late = met.select("row", start.alias("a"), "b", (own & (F.col("a") == F.col("first.a"))).alias("kept"))
    late = late.filter("not kept and a <= b").select("row", "a", "b").distinct()
    return late.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def without_passages(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without repeated passages; see ``lines.rebuilt``."""

    def kept_and_lost(text: Column, spans: Column) -> Column:
        gone = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["a"], s["b"]))))

        def parts(at: Column) -> Column:
            kept = F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains(at, i))
            return F.struct(F.array_join(kept, "\n").alias("text"), F.size(at).cast("long").alias("lost"))

        return F.element_at(F.transform(F.array(gone), parts), 1)

    return rebuilt(docs, repeats(docs), kept_and_lost)
