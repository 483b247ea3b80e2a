"""Exact dedup against a minimal perfect hash over historical distinct digests.

The corpus seen so far is kept as an index: its distinct SHA-256 digests are dealt
to buckets, and each bucket has a minimal perfect hash (levels of bit arrays: a key
whose place is hit by it alone sets the bit and leaves, the others go on to the
next level; its number is the count of bits before it).  Slot i holds the full digest
of key i, the locator of its winner (largest doc_id) and its rows.

A new batch is first reduced to distinct digests with map-side sums, so a group of
copies of any size is one row before it is dealt to a bucket.  A lookup compares all 32
bytes of the slot: equal means a repeat and is folded into the slot, unequal means a
nonmember and is grouped separately.  Texts never move; only digests do.

Defined cases: null text is the empty text; null ids lose against any id, and a group
of null ids has a null keep_id; rows that repeat both id and text are one document
(``survivors`` returns it once); an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.ship import ship

from .shared import row_key, rows_with, text_or_empty, written

BUCKET_KEYS = 1024
#: Bits of a level for each key that is left.
GAMMA = 2
LEVELS = 64
INDEX = "bucket int, sizes array<int>, bits binary, digests binary, winners array<bigint>, counts array<bigint>"
GROUPS = "digest binary, keep_id long, group_size long, member boolean"


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each digest (n x 4 words) in a level."""
    x = words[:, 2] + words[:, 3] * np.uint64(2 * level + 1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


def _words(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, "<u8").reshape(-1, 4)


def build_mph(digests: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits in one array, and the number of each digest."""
    words = _words(digests)
    left, sizes, levels = np.arange(len(words)), [], []
    number, before = np.empty(len(words), np.int64), 0
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("digests repeat within a bucket")
        size = max(64, GAMMA * len(left))
        place = _places(words[left], len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        settled = alone[place]
        number[left[settled]] = before + (np.cumsum(alone) - 1)[place[settled]]
        before += int(alone.sum())
        sizes.append(size)
        levels.append(alone)
        left = left[~settled]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool), number


def lookup_mph(sizes: list[int], bits: np.ndarray, digests: bytes) -> np.ndarray:
    """The number that each digest would have; -1 where it meets no bit."""
    words = _words(digests)
    rank = np.cumsum(bits) - 1
    left, number, start = np.arange(len(words)), np.full(len(words), -1, np.int64), 0
    for level, size in enumerate(sizes):
        place = start + _places(words[left], level, size)
        hit = bits[place]
        number[left[hit]] = rank[place[hit]]
        left, start = left[~hit], start + size
    return number


def _index(t: pa.Table) -> pa.Table:
    raw = b"".join(t.column("digest").to_pylist())
    sizes, bits, number = build_mph(raw)
    order = pa.array(np.argsort(number))
    row = {
        "bucket": t.column("bucket").slice(0, 1).cast(pa.int32()),
        "sizes": pa.array([sizes], pa.list_(pa.int32())),
        "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
        "digests": pa.array([np.frombuffer(raw, "S32")[np.argsort(number)].tobytes() if raw else b""], pa.binary()),
        "winners": _one_list(t.column("keep_id").take(order)),
        "counts": _one_list(t.column("group_size").take(order)),
    }
    return pa.table(row)


def _one_list(values: pa.ChunkedArray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.combine_chunks().cast(pa.int64()))


def _numbers(values, null: int) -> np.ndarray:
    return values.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


def _resolve(index: pa.Table, batch: pa.Table) -> pa.Table:
    """All groups of a bucket: slots with the batch's repeats folded in, then nonmembers.
    A winner of no id is less than any id; the digests of a batch are distinct."""
    least = np.iinfo(np.int64).min
    slots = np.zeros((0, 32), np.uint8)
    winners = counts = have = np.zeros(0, np.int64)
    new = np.frombuffer(b"".join(batch.column("digest").to_pylist()) if batch.num_rows else b"", np.uint8).reshape(-1, 32)
    number = np.full(len(new), -1, np.int64)
    if index.num_rows:
        row = {c: index.column(c)[0] for c in index.column_names}
        sizes = row["sizes"].as_py()
        slots = np.frombuffer(row["digests"].as_py(), np.uint8).reshape(-1, 32)
        have = row["winners"].values.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        winners, counts = _numbers(row["winners"].values, least).copy(), _numbers(row["counts"].values, 0).copy()
        bits = np.unpackbits(np.frombuffer(row["bits"].as_py(), np.uint8))[: sum(sizes)].astype(bool)
        number = lookup_mph(sizes, bits, new.tobytes())
    member = number >= 0
    member[member] = (slots[number[member]] == new[member]).all(axis=1)
    if len(new):
        keep, rows = _numbers(batch.column("keep_id").combine_chunks(), least), _numbers(batch.column("group_size").combine_chunks(), 0)
        known = batch.column("keep_id").combine_chunks().is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        at = number[member]
        winners[at] = np.maximum(winners[at], keep[member])
        counts[at] += rows[member]
        have[at] |= known[member]
        slots = np.concatenate([slots, new[~member]])
        winners, counts, have = (np.concatenate(x) for x in ((winners, keep[~member]), (counts, rows[~member]), (have, known[~member])))
    is_member = np.arange(len(slots)) < len(slots) - int((~member).sum())
    digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(slots), [None, pa.py_buffer(np.ascontiguousarray(slots).tobytes())])
    return pa.table({"digest": digest.cast(pa.binary()), "keep_id": pa.array(winners, mask=have == 0), "group_size": pa.array(counts), "member": pa.array(is_member)})


def digests(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """(doc_id, digest) of every row and its ``key`` if one is given, written once: 40 or 72
    bytes instead of a text."""
    digest = F.unhex(F.sha2(text_or_empty(), 256))
    more = [] if key is None else [key.alias("key")]
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), *more), "digests")


def distinct_digests(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row a bucket: the hash, its slots' digests, winners and rows; written."""
    return written(_bucketed(distinct_digests(history), buckets).groupBy("bucket").applyInArrow(_index, INDEX), "mph-index")


def resolve(index: DataFrame, batch: DataFrame, buckets: int) -> DataFrame:
    """digest, keep_id, group_size, member of all groups of history and batch."""
    new = _bucketed(distinct_digests(batch), buckets)
    return index.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInArrow(_resolve, GROUPS)


def find_groups(rows: DataFrame, history_until: int | None = None) -> DataFrame:
    """Groups of (doc_id, digest) rows.  Ids up to ``history_until`` (by default the
    middle of the range of ids) are the history that the index is built of; the
    others, and rows without an id, are the batch that is looked up."""
    ship(rows.sparkSession)
    low, high, count = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    if history_until is None:
        history_until = (low + high) // 2 if low is not None else 0
    buckets = max(1, math.ceil(count / BUCKET_KEYS))
    old = F.coalesce(F.col("doc_id") <= history_until, F.lit(False))
    return resolve(build_index(rows.filter(old), buckets), rows.filter(~old), buckets)


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept of every document."""
    rows = digests(docs)
    out = rows.join(find_groups(rows), "digest")
    return out.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, columns as given."""
    kept = digests(docs, row_key(F.col("doc_id"), F.col("text")))
    best = find_groups(kept).select("digest", "keep_id")
    won = kept.join(best, "digest").filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return rows_with(docs, won.select("key").distinct())
