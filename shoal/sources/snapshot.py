"""Versioned snapshots of a catalog, saved searches, checkpoints.

A generation is a folder of Parquet files; it counts once its marker is there, so readers see
an old generation or a complete new one.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def generations(spark: SparkSession, folder: str) -> list[int]:
    """Complete generations, oldest first."""
    path, fs = _fs(spark, folder)
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        m = re.fullmatch(r"gen=(\d+)", status.getPath().getName())
        if m and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(m[1]))
    return sorted(found)


def write_snapshot(catalog: DataFrame, folder: str, sort: str = "id") -> int:
    """Write the next generation and return its number.  Rows are range-sorted so that files
    have narrow bounds of ``sort``, which scans use to skip."""
    spark = catalog.sparkSession
    generation = max(generations(spark, folder), default=0) + 1
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = catalog.repartitionByRange(partitions, sort).sortWithinPartitions(sort)
    ordered.write.mode("overwrite").parquet(f"{folder}/gen={generation}")
    save_json(spark, f"{folder}/checksum-{generation}.json", fingerprint(spark.read.parquet(f"{folder}/gen={generation}"), sort))
    return generation


def fingerprint(rows: DataFrame, key: str = "id") -> dict:
    """Rows, distinct keys and a checksum that does not depend on the order of rows."""
    plain = [c for c, t in rows.dtypes if "map" not in t]
    got = rows.agg(F.count(F.lit(1)), F.count_distinct(key), F.coalesce(F.bit_xor(F.xxhash64(*plain)), F.lit(0))).first()
    return {"rows": got[0], "keys": got[1], "checksum": got[2], "key": key}


def read_snapshot(spark: SparkSession, folder: str, generation: int | None = None, verify: bool = False) -> DataFrame:
    """A generation, by default the latest complete one.  ``verify`` reads it once more and fails when rows
    were lost or changed since it was written, or its keys repeat."""
    if generation is None:
        generation = max(generations(spark, folder))
    rows = spark.read.parquet(f"{folder}/gen={generation}")
    if verify:
        was = load_json(spark, f"{folder}/checksum-{generation}.json")
        if was is None or fingerprint(rows, was["key"]) != was or was["keys"] != was["rows"]:
            raise ValueError(f"generation {generation} of {folder} is damaged")
    return rows


def drop_generations(spark: SparkSession, folder: str, keep: int = 2) -> None:
    for old in generations(spark, folder)[:-keep]:
        for name in (f"gen={old}", f"checksum-{old}.json"):
            path, fs = _fs(spark, f"{folder}/{name}")
            fs.delete(path, True)


# -- checkpoints -------------------------------------------------------------------------


@dataclass(frozen=True)
class Checkpoint:
    journal_id: int
    next_usn: int


@dataclass(frozen=True)
class JournalState:
    journal_id: int
    first_usn: int
    next_usn: int
    lowest_valid_usn: int = 0


def validate(checkpoint: Checkpoint, journal: JournalState) -> str:
    """'valid', or why the journal can't be followed from the checkpoint."""
    if checkpoint.journal_id != journal.journal_id:
        return "journal_changed"
    if checkpoint.next_usn < max(journal.first_usn, journal.lowest_valid_usn):
        return "expired"
    if checkpoint.next_usn > journal.next_usn:
        return "ahead_of_journal"
    return "valid"


def save_json(spark: SparkSession, path: str, value: dict) -> None:
    """Write a small file under a temporary name, then put it in place."""
    target, fs = _fs(spark, path)
    temporary = spark._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(temporary, True)
    out.write(json.dumps(value, sort_keys=True).encode())
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(temporary, target)


def save_state(spark: SparkSession, folder: str, value: dict, keep: int = 5) -> None:
    """Put down a state under the next number.  No file is ever replaced, so a crash at any point
    leaves the state before or this one; older ones than ``keep`` are deleted after."""
    numbers = _state_numbers(spark, folder)
    save_json(spark, f"{folder}/state-{(numbers[-1] if numbers else 0) + 1:012d}.json", value)
    for n in numbers[: -keep or None]:
        path, fs = _fs(spark, f"{folder}/state-{n:012d}.json")
        fs.delete(path, False)


def load_state(spark: SparkSession, folder: str) -> dict | None:
    """The state of the greatest number."""
    numbers = _state_numbers(spark, folder)
    return load_json(spark, f"{folder}/state-{numbers[-1]:012d}.json") if numbers else None


def _state_numbers(spark: SparkSession, folder: str) -> list[int]:
    path, fs = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"state-(\d+)\.json", n)))


def load_json(spark: SparkSession, path: str) -> dict | None:
    target, fs = _fs(spark, path)
    if not fs.exists(target):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def journal_state(changes: DataFrame, journal_id: int = 0) -> DataFrame:
    """One row: journal_id, first_usn, next_usn of a table of changes."""
    return changes.agg(
        F.lit(journal_id).alias("journal_id"),
        F.coalesce(F.min("usn"), F.lit(0)).alias("first_usn"),
        F.coalesce(F.max("usn") + 1, F.lit(0)).alias("next_usn"),
    )


def read_changes(changes: DataFrame, start: int, state: JournalState, mask: int = 0xFFFFFFFF) -> DataFrame:
    """Changes from ``start``, or from where the journal still has them, with any bit of ``mask``."""
    start = max(start, state.first_usn, state.lowest_valid_usn)
    return changes.filter((F.col("usn") >= start) & (F.col("reason").bitwiseAND(mask) != 0))


# -- saved searches ----------------------------------------------------------------------


@dataclass(frozen=True)
class SavedSearch:
    name: str
    query: str
    case_sensitive: bool = False
    whole_word: bool = False
    match_path: bool = False
    match_diacritics: bool = False
    regex: bool = False


FLAGS = ("case_sensitive", "whole_word", "match_path", "match_diacritics", "regex")


def _escape(text: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in "%\t\r\n" else c for c in text)


def _unescape(text: str) -> str:
    return re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), text)


def dump_searches(searches: list[SavedSearch]) -> str:
    """One line a search: name, query and flag bits, parted by tabs."""
    return "".join(f"{_escape(s.name)}\t{_escape(s.query)}\t{sum(getattr(s, f) << i for i, f in enumerate(FLAGS))}\n" for s in searches)


def load_searches(text: str) -> list[SavedSearch]:
    """Lines that do not fit are left out."""
    out = []
    for line in text.splitlines():
        parts = line.split("\t")
        if len(parts) == 3 and parts[0] and parts[2].isdigit():
            bits = int(parts[2])
            out.append(SavedSearch(_unescape(parts[0]), _unescape(parts[1]), *(bool(bits >> i & 1) for i in range(len(FLAGS)))))
    return out


def remember(history: list[str], query: str, most: int = 100) -> list[str]:
    """A query history with the query in front, once."""
    return [query, *(q for q in history if q != query)][:most]


def rebuild_reason(checkpoint: Checkpoint | None, journal: JournalState | None, volumes: set[str] = frozenset(), known: set[str] = frozenset()) -> str | None:
    """Why a catalog must be built anew instead of followed; None if it need not."""
    if checkpoint is None:
        return "no_checkpoint"
    if journal is None:
        return "journal_unreadable"
    if set(volumes) != set(known):
        return "volumes_changed"
    state = validate(checkpoint, journal)
    return None if state == "valid" else state


def replayable(log: DataFrame, cursor: DataFrame) -> DataFrame:
    """The batches of a log that can be replayed: those after their volume's cursor, up to the
    first gap.  ``log`` has volume, usn_start, usn_end; ``cursor`` has volume, next_usn.
    Batches that were applied already are left out; one that was partly applied is a gap."""
    rows = log.join(cursor, "volume").filter(F.col("usn_end") > F.col("next_usn"))
    order = W.partitionBy("volume").orderBy("usn_start")
    follows = F.col("usn_start") == F.coalesce(F.lag("usn_end").over(order), F.col("next_usn"))
    rows = rows.withColumn("__follows", follows)
    whole = F.bool_and("__follows").over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__whole", whole).filter("__whole").drop("__follows", "__whole", "next_usn")


def should_consolidate(log_bytes: int, changes: int, seconds: float, volumes: int = 1) -> bool:
    """Is it time to write a new generation?  One volume: by the size of its log; several: by
    changes or time."""
    if volumes == 1:
        return log_bytes >= 64 << 20
    return changes >= 100_000 or (changes > 0 and seconds >= 300)
