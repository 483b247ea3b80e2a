"""Following a change journal, and a watched folder, with Structured Streaming.

A micro-batch of changes is folded by the batch operator and appended to a table of
deltas under its batch number; a batch that runs again replaces what it wrote.  Reading
merges the base with the deltas, latest batch first; compaction writes the next base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoal.operators.content import ContentIndex
from shoal.operators.incremental import COMPACT_AFTER, fold_changes, live_view, should_compact
from shoal.sources.snapshot import generations, load_state, read_snapshot, save_state, write_snapshot


class JournalFollower:
    """A catalog in ``folder`` that follows a stream of changes."""

    def __init__(self, spark: SparkSession, folder: str, compact_after: int = COMPACT_AFTER, reset_metadata: bool = True):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.compact_after, self.reset_metadata = compact_after, reset_metadata

    def bootstrap(self, base: DataFrame, boundary_usn: int = 0) -> None:
        """Write the first generation.  ``boundary_usn`` is where the journal stood before the
        base was read; changes from there on are replayed, which is harmless."""
        generation = write_snapshot(base, f"{self.folder}/base")
        save_state(self.spark, f"{self.folder}/state", {"generation": generation, "first_batch": 0, "boundary_usn": boundary_usn, "changes": {}})

    def state(self) -> dict:
        return load_state(self.spark, f"{self.folder}/state")

    def base(self) -> DataFrame:
        return read_snapshot(self.spark, f"{self.folder}/base", self.state()["generation"])

    def deltas(self, before: int | None = None) -> DataFrame:
        """(seq, op, record) of the batches since the base, up to one batch."""
        first, base = self.state()["first_batch"], self.base()
        schema = base.limit(0).select(F.lit("").alias("op"), "*").schema.simpleString()[7:-1].replace(":", " ")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/deltas")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = []
        if fs.exists(path):
            done = [int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=")]
        done = sorted(b for b in done if b >= first and (before is None or b < before))
        if not done:
            return base.limit(0).select(F.lit(0).cast("long").alias("seq"), F.lit("").alias("op"), "*")
        rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/deltas").parquet(*[f"{self.folder}/deltas/batch={b}" for b in done])
        return rows.select(F.col("batch").cast("long").alias("seq"), "op", *base.columns)

    def live(self, before: int | None = None, ids: DataFrame | None = None) -> DataFrame:
        """The merged view, or its rows of some ids: both sides are cut to them before they meet."""
        base, deltas = self.base(), self.deltas(before)
        if ids is not None:
            base, deltas = base.join(ids, "id", "left_semi"), deltas.join(ids, "id", "left_semi").select(*deltas.columns)
        return live_view(base, deltas)

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Fold a batch over what was live before it, and write what it amounts to.  The same
        batch gives the same rows again, so it may run more than once."""
        state = self.state()
        if batch < state["first_batch"]:
            return  # already in the base
        changes = changes.filter(F.col("usn") >= state["boundary_usn"])
        live = self.live(batch, changes.select(F.col("file_id").alias("id")).distinct())
        upserts, removed = fold_changes(live, changes, self.reset_metadata)
        missing = [F.lit(None).cast(t).alias(c) for c, t in live.dtypes if c != "id"]
        gone = removed.select(F.lit("remove").alias("op"), "id", *missing).select("op", *live.columns)
        upserts.select(F.lit("upsert").alias("op"), *live.columns).unionByName(gone).write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch}")
        # Counted from this batch's files only; the state holds what the others had.
        counts = state["changes"] | {str(batch): self.spark.read.parquet(f"{self.folder}/deltas/batch={batch}").count()}
        save_state(self.spark, f"{self.folder}/state", state | {"changes": counts})
        if should_compact(sum(counts.values()), self.compact_after):
            self.compact(batch + 1)

    def compact(self, next_batch: int) -> None:
        """Write the live view as the next generation; the next state then points to it."""
        state = self.state()
        generation = write_snapshot(self.live(), f"{self.folder}/base")
        save_state(self.spark, f"{self.folder}/state", state | {"generation": generation, "first_batch": next_batch, "changes": {}})

    def follow(self, changes: DataFrame, once: bool = True) -> StreamingQuery:
        """Start to follow a streaming DataFrame of changes."""
        writer = changes.writeStream.foreachBatch(lambda df, batch: self.apply(df, batch))
        writer = writer.option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="250 milliseconds")).start()

    def generations(self) -> list[int]:
        return generations(self.spark, f"{self.folder}/base")


def bursts(changes: DataFrame, gap: str = "150 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Watched changes (ts, root, action, path) gathered into bursts that end with a quiet
    gap: root, start, end, changes.  A burst is when a root is scanned again."""
    if changes.isStreaming:
        changes = changes.withWatermark("ts", late)
    out = changes.groupBy(F.session_window("ts", gap).alias("w"), "root").agg(F.count(F.lit(1)).alias("changes"))
    return out.select("root", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes")


#: What a watched change means for the index.
GONE, NEW = ("removed", "renamed_old"), ("added", "modified", "renamed_new")


def apply_watched(index: ContentIndex, changes: DataFrame, texts: DataFrame, overflowed: bool = False, within: Column | None = None) -> ContentIndex:
    """The index after a batch of (seq, action, path): the last action of a path counts;
    ``texts`` has path and text of those that exist.

    When the watcher lost changes (``overflowed``), ``texts`` is a scan of all that exists below the
    root, and what the index has there (``within``, of its column doc; all by default) but the scan
    hasn't goes."""
    if overflowed:
        there = index.documents.filter(within) if within is not None else index.documents
        gone = there.select("doc").join(texts.select(F.col("path").alias("doc")), "doc", "left_anti")
        return index.upsert(texts, gone)
    last = changes.groupBy("path").agg(F.max_by("action", "seq").alias("action"))
    gone = last.filter(F.col("action").isin(*GONE)).select(F.col("path").alias("doc"))
    new = texts.join(last.filter(F.col("action").isin(*NEW)).select("path"), "path", "left_semi")
    return index.upsert(new, gone)
