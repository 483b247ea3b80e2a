"""Document fingerprints from closed syncmers, matched by position.

A k-mer of ``K`` characters is an anchor when the least hash of its inner substrings
of ``S`` characters lies at its first or its last place.  That depends on the k-mer alone, so an
edit elsewhere neither adds nor removes an anchor; at least one anchor begins in every
``K - S + 1`` places.  The fingerprint holds all anchors of a text in the order of their places: a
32-bit number each, the gap to the anchor before it (8 bits) and 24 bits of its hash, in base64.

Fingerprints are matched by position: the r-th anchor of a hash meets the r-th one of that hash in
the other text, and of those meetings the longest chain whose places rise in both texts counts.
``likeness`` is the chain's share of all anchors, chain / (n + m - chain); ``spans`` gives the
stretches that the chain covers, as places in both texts and lengths.

``with_next`` puts documents in descending order of doc_id (ties by MD5 of the text).  Keys alone
are dealt to ranges first, which gives the first key of each range.  One shuffle then brings
every range's texts to a task, and with them a copy of the next range's first document, so the
task streams its range and sees each document's successor; nothing is stored in between.  The ranges
are as many as shuffle partitions, and their first keys travel with the tasks.

Defined cases: null is the empty text, with the empty fingerprint; two empty fingerprints
are alike (1), an empty and another are not (0); a text of at most ``PAIR``
characters is one anchor; one under ``SHORT`` has all its pairs of characters as anchors, too;
null ids come last; with one row the next document is itself; repeated rows follow one
another; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import arrow_map, text_or_empty, texts_of

K, S = 24, 8
#: Texts of fewer characters have all their pairs of characters as anchors, too.
SHORT, PAIR = 48, 2
#: Characters that are hashed at a time; neighbours overlap by a k-mer.
BLOCK = 1 << 18
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def _grams(chars: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n characters from every place, by doubling."""
    count = len(chars) - n + 1
    have, width, out, at = chars, 1, None, 0
    power = _A
    while True:
        if n & width:
            part = have[at : at + count]
            out = part if out is None else out * power + part
            at += width
        if width * 2 > n:
            return _mix(out)
        have = have[:-width] * power + have[width:]
        power = power * power
        width *= 2


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    width = 1
    while width * 2 <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (w - width)], x[w - width :]) if w > width else x


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all closed syncmers of a text, and of the pairs of a short one, by place."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        if len(chars) <= PAIR:
            return np.zeros(1, np.int64), _grams(chars, len(chars))
        places, hashes = [], []
        if len(chars) < SHORT:
            places.append(np.arange(len(chars) - PAIR + 1))
            hashes.append(_grams(chars, PAIR))
        for start in range(0, len(chars) - K + 1, BLOCK):
            part = chars[start : start + BLOCK + K - 1]
            inner = _grams(part, S)
            span = K - S
            least = _window_min(inner, span + 1)
            n = len(part) - K + 1
            at = np.flatnonzero((inner[:n] == least) | (inner[span : span + n] == least))
            places.append(at + start)
            hashes.append(_grams(part, K)[at])
        at = np.concatenate(places)
        order = np.argsort(at, kind="stable")
        return at[order], np.concatenate(hashes)[order]


def fingerprint(text: str) -> np.ndarray:
    """All anchors of a text: gap << 24 | high bits of the hash."""
    places, hashes = anchors(text)
    gaps = np.diff(places, prepend=0).astype(np.uint32)  # under 256: an anchor begins in every K - S + 1 places
    return gaps << np.uint32(24) | (hashes >> np.uint64(40)).astype(np.uint32)


def as_text(print_: np.ndarray) -> str:
    return base64.b64encode(print_.astype(">u4").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u4").astype(np.uint32)


def _ranked(hashes: np.ndarray) -> np.ndarray:
    """Each hash with the number of equal ones before it, as one number."""
    order = np.argsort(hashes, kind="stable")
    own = hashes[order]
    first = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
    at = np.arange(len(own))
    number = np.empty(len(own), np.int64)
    number[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return number << 24 | hashes.astype(np.int64)


def _longest_rise(values: np.ndarray) -> np.ndarray:
    """Places of a longest rising subsequence of distinct values."""
    if len(values) < 2 or (values[1:] > values[:-1]).all():
        return np.arange(len(values))
    tops, last, before = [], [], []
    for i, v in enumerate(values.tolist()):
        at = bisect_left(tops, v)
        before.append(last[at - 1] if at else -1)
        if at == len(tops):
            tops.append(v)
            last.append(i)
        else:
            tops[at], last[at] = v, i
    out, i = [], last[-1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1])


def chain(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the anchors of two fingerprints that meet in the longest chain."""
    low = np.uint32((1 << 24) - 1)
    _, left, right = np.intersect1d(_ranked(a & low), _ranked(b & low), assume_unique=True, return_indices=True)
    order = np.argsort(left)
    left, right = left[order], right[order]
    kept = _longest_rise(right)
    return left[kept], right[kept]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of all anchors that the longest chain holds."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    n = len(chain(a, b)[0])
    return n / (len(a) + len(b) - n)


def spans(a: np.ndarray, b: np.ndarray, size: int = K) -> list[tuple[int, int, int]]:
    """(place in a, place in b, characters) of the stretches that the chain covers.  Anchors of
    one offset whose k-mers touch are one stretch."""
    i, j = chain(a, b)
    out: list[list[int]] = []
    place_a, place_b = np.cumsum(a >> np.uint32(24)), np.cumsum(b >> np.uint32(24))
    for x, y in zip(place_a[i].tolist(), place_b[j].tolist()):
        if out and x - y == out[-1][0] - out[-1][1] and x <= out[-1][0] + out[-1][2]:
            out[-1][2] = x - out[-1][0] + size
        else:
            out.append([x, y, size])
    return [tuple(s) for s in out]


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many characters of the next document."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [x.split()[0] for x in RESULT.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def compared(doc_id, text: str, own: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
    new = edited(text, following)
    changed = own if new == text else fingerprint(new)
    digest = hashlib.sha256(new.encode()).hexdigest()
    return doc_id, len(text), digest, as_text(own), as_text(changed), likeness(own, changed), likeness(own, theirs)


def _stream(batches):
    """Compares each document of a range with the next one; the copy that follows the
    range's last document only ends it."""
    held = None
    for b in batches:
        rows = []
        for doc_id, text, part, copy in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "part", "copy"))):
            if held is not None and held[0] == part:
                own = fingerprint(text)
                rows.append(compared(*held[1:], text, own))
            elif not copy:
                own = fingerprint(text)
            held = None if copy else (part, doc_id, text, own)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(TYPES), TYPES)], NAMES)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, places, hashes, fingerprint: all anchors of every document."""

    def run(batches):
        for b in batches:
            texts = texts_of(b)
            found = [anchors(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1].view(np.int64) for f in found], pa.list_(pa.int64())), pa.array([as_text(fingerprint(t)) for t in texts])],
                ["doc_id", "places", "hashes", "fingerprint"],
            )

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, places array<long>, hashes array<long>, fingerprint string", rows=200)


def span_table(pairs: DataFrame) -> DataFrame:
    """a, b, likeness, spans of rows (a, b, text_a, text_b): what two documents share, and where."""

    def run(batches):
        kind = pa.list_(pa.struct([("in_a", pa.int64()), ("in_b", pa.int64()), ("n", pa.int64())]))
        for batch in batches:
            found = [(fingerprint(x), fingerprint(y)) for x, y in zip(texts_of(batch, "text_a"), texts_of(batch, "text_b"))]
            shared = [[dict(zip(("in_a", "in_b", "n"), s)) for s in spans(x, y)] for x, y in found]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array([likeness(x, y) for x, y in found], pa.float64()), pa.array(shared, kind)], ["a", "b", "likeness", "spans"])

    rows = pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "text_a", "text_b")
    return arrow_map(rows, run, "a long, b long, likeness double, spans array<struct<in_a:long,in_b:long,n:long>>", rows=200)


def _order_key() -> Column:
    """A string whose order is: larger doc_id first, null last, ties by MD5 of the text."""
    turned = F.bitwise_not(F.col("doc_id")).bitwiseXOR(F.lit(-(1 << 63)))
    number = F.coalesce(F.concat(F.lit("0"), F.lpad(F.hex(turned), 16, "0")), F.lit("1"))
    return F.concat(number, F.md5("text"))


def with_next(docs: DataFrame) -> DataFrame:
    """The columns of ``RESULT`` for every document."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("key", _order_key())
    firsts = rows.select("key").repartitionByRange(tasks, "key").groupBy(F.spark_partition_id().alias("part"))
    bounds = np.array(sorted(r[1] for r in firsts.agg(F.min("key")).collect()), "U49")  # one key a range

    @pandas_udf("array<struct<part:int,copy:boolean>>")
    def places(keys):
        """The range of each key and, for the first of a range, the range before it."""
        import pandas as pd

        own = keys.to_numpy().astype("U49")
        at = np.searchsorted(bounds, own, side="right") - 1
        first = bounds[at] == own
        return pd.Series([[(p, False), ((p - 1) % len(bounds), True)] if f else [(p, False)] for p, f in zip(at.tolist(), first.tolist())])

    rows = rows.withColumn("place", F.explode(places("key"))).select("doc_id", "text", "key", "place.part", "place.copy")
    rows = rows.repartitionById(tasks, F.col("part")).sortWithinPartitions("part", "copy", "key")
    return arrow_map(rows.drop("key"), _stream, RESULT, rows=500)
