"""Durable logs as append-only tables: journal batches, and metadata read late.

An entry is a folder of Parquet files that counts once its marker is there; one without is a torn tail,
which readers leave out and the next append replaces.  Facts of an entry are in its name, so that a
log is opened by listing its folder.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LogError(ValueError):
    """The log can't take an entry, or isn't of this catalog."""


@dataclass(frozen=True)
class Entry:
    number: int
    start: int
    end: int
    complete: bool
    path: str


class Log:
    """Entries of a folder, bound to a volume's generation: a log of another one is refused."""

    def __init__(self, spark: SparkSession, folder: str, volume: str, generation: int):
        self.spark = spark
        self.folder = f"{folder.rstrip('/')}/{_name(volume)}/gen={generation}"

    def _status(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs, [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []

    def entries(self) -> list[Entry]:
        """Whole entries in order."""
        fs, paths = self._status()
        out = []
        for p in paths:
            m = re.fullmatch(r"entry-(\d+)-(-?\d+)-(-?\d+)-([01])", p.getName())
            if m and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")):
                out.append(Entry(int(m[1]), int(m[2]), int(m[3]), m[4] == "1", p.toString()))
        return sorted(out, key=lambda e: e.number)

    def _append(self, rows: DataFrame, start: int, end: int, complete: bool = False) -> None:
        number = max((e.number for e in self.entries()), default=0) + 1
        fs, paths = self._status()
        for p in paths:  # a torn entry of this number
            if p.getName().startswith(f"entry-{number}-"):
                fs.delete(p, True)
        rows.write.parquet(f"{self.folder}/entry-{number}-{start}-{end}-{int(complete)}")

    def read(self, entries: list[Entry], schema) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[e.path for e in entries])

    def reset(self) -> None:
        """Forget all entries, when a new generation holds what they say."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _name(volume: str) -> str:
    return re.sub(r"[^0-9A-Za-z]", lambda m: f"%{ord(m[0]):X}", volume)


class JournalLog(Log):
    """Batches of changes, each of the journal numbers from ``start`` up to ``end``, one after the other."""

    def append(self, changes: DataFrame, start: int, end: int) -> bool:
        """Append a batch.  One that the log has already is skipped (False); a batch that
        does not begin where the log ends, or is partly in it, is an error."""
        if end < start:
            raise LogError(f"a batch from {start} to {end}")
        last = max((e.end for e in self.entries()), default=None)
        if last is not None:
            if end <= last:
                return False
            if start != last:
                raise LogError(f"a batch from {start} after a log that ends at {last}")
        self._append(changes, start, end)
        return True

    def replay(self, cursor: int, schema) -> tuple[DataFrame, int]:
        """(changes, next cursor): what follows the cursor without a gap.  Entries that end at the cursor
        or before are applied already; one that reaches over the cursor is read from there on."""
        following, at = [], cursor
        for e in sorted(self.entries(), key=lambda e: e.start):
            if e.end <= at:
                continue
            if e.start > at:
                break
            following.append(e)
            at = e.end
        return self.read(following, schema).filter((F.col("usn") >= cursor) & (F.col("usn") < at)), at


HYDRATION = "id long, path_fingerprint long, size long, last_write_time long, attributes int"


def path_fingerprint(path="path"):
    return F.xxhash64(F.lower(path))


class HydrationLog(Log):
    """Batches of metadata that were read late.  The entry that says that all is read is the last."""

    def append(self, updates: DataFrame, complete: bool = False) -> None:
        if any(e.complete for e in self.entries()):
            raise LogError("the log is complete")
        self._append(updates.select(*[c.split()[0] for c in HYDRATION.split(", ")]), 0, 0, complete)

    @property
    def complete(self) -> bool:
        return any(e.complete for e in self.entries())

    def replay(self, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(catalog, counts): the catalog with the latest update of each row whose path is still the one
        that was read, and one row applied, stale: updates taken, and those of rows gone or moved since."""
        updates = self.read(self.entries(), HYDRATION)
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/entry-(\d+)-", 1).cast("long")
        updates = updates.withColumn("__at", number) if self.entries() else updates.withColumn("__at", F.lit(0).cast("long"))
        latest = updates.groupBy("id").agg(F.max_by(F.struct("path_fingerprint", "size", "last_write_time", "attributes"), "__at").alias("__new"))
        rows = catalog.join(latest, "id", "left")
        fits = F.coalesce(F.col("__new.path_fingerprint") == path_fingerprint(), F.lit(False))
        kinds = dict(catalog.dtypes)
        out = rows.select(*[F.when(fits, F.col(f"__new.{c}").cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in ("size", "last_write_time", "attributes") else F.col(c) for c in catalog.columns])
        counts = latest.join(catalog.select("id", path_fingerprint().alias("__is")), "id", "left")
        taken = F.coalesce(F.col("__new.path_fingerprint") == F.col("__is"), F.lit(False))
        return out, counts.agg(F.count_if(taken).alias("applied"), F.count_if(~taken).alias("stale"))


def hydrate(catalog: DataFrame, read, log: HydrationLog, batch: int = 4096, most: int | None = None) -> int:
    """Read the metadata of rows that have none (last_write_time 0), ``batch`` ids at a time in the order of
    ids, each batch into the log before the next.  ``read`` maps (id, path) rows to (id, size, last_write_time,
    attributes).  Goes on after the last id that the log has; returns the batches done."""
    from shoal.operators.incremental import hydration_batch
    from shoal.tables import written

    seen = log.read(log.entries(), HYDRATION).agg(F.max("id")).first()[0]
    after, done = seen if seen is not None else -1, 0
    while not log.complete and (most is None or done < most):
        rows = written(hydration_batch(catalog, after, batch), "hydration")
        count, last = rows.agg(F.count(F.lit(1)), F.max("id")).first()
        updates = rows.join(read(rows), "id").withColumn("path_fingerprint", path_fingerprint())
        log.append(updates, complete=count < batch)
        after, done = last if last is not None else after, done + 1
    return done
