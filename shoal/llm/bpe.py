"""Byte-level BPE encoding and decoding by a rank file.

Each match of the split pattern is encoded separately.  Its bytes are the leaves of a
segment tree; a leaf holds the rank of the pair that begins there, and a node the
least rank below it, leftmost first.  The root names the next merge: the pair's
left leaf becomes the merged token, its right leaf dies, and the two leaves whose pair
changed (the merged one and its live left neighbour) are updated in logarithmic time.

Short matches of a batch are merged side by side: one tree a match, all roots
read and all changed leaves updated in one numpy step.  Longer ones go one by one.
A worker keeps the ids of matches it has seen in a bounded table.

Defined cases: null text is the empty text with no tokens; a lone surrogate cannot
occur in Spark strings; ids of repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, texts_of

#: Matches of up to so many bytes are merged side by side.
SHORT = 64
#: Matches in each of a worker's two tables at most: when the newer one is full it
#: becomes the older one, from which matches that are met again are carried over.
REMEMBERED = 300_000
#: Characters of a match that is remembered; with ``REMEMBERED`` this bounds the tables.
LONGEST = 256
NONE = np.int64(1) << np.int64(62)


class Ranks:
    """A vocabulary of byte strings by rank, and the rank that each pair merges into."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.tokens = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.tokens.values(), default=-1) + 1)
        for token, rank in self.tokens.items():
            self.bytes_of[rank] = token
        self.byte_rank = np.array([self.tokens.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.pairs = {
            (left, right): rank
            for token, rank in self.tokens.items()
            for at in range(1, len(token))
            if (left := self.tokens.get(token[:at])) is not None and (right := self.tokens.get(token[at:])) is not None
        }
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.concatenate((keys[order], [NONE]))
        self.merged = np.concatenate((np.array(list(self.pairs.values()), np.int64)[order], [NONE]))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NONE; a negative id is no token."""
        want = np.where((left >= 0) & (right >= 0), left << np.int64(32) | right, np.int64(-1))
        at = np.searchsorted(self.keys, want)
        return np.where(self.keys[at] == want, self.merged[at], NONE)


@cache
def ranks(path: str) -> Ranks:
    return Ranks(path)


def merge_one(piece: bytes, r: Ranks) -> list[int]:
    """Ids of one match, by a segment tree over its byte positions."""
    n = len(piece)
    width = 1 << max(0, (n - 1).bit_length())
    ids = r.byte_rank[np.frombuffer(piece, np.uint8)].tolist()
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    big, pairs = int(NONE), r.pairs
    tree = [big] * (2 * width)
    for i in range(n - 1):
        rank = pairs.get((ids[i], ids[i + 1]))
        if rank is not None:
            tree[width + i] = rank * width + i
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        i >>= 1
        while i:
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1

    while (root := tree[1]) != big:
        rank, at = divmod(root, width)
        gone = after[at]
        ids[at], ids[gone] = rank, -1
        after[at] = after[gone]
        if after[gone] < n:
            before[after[gone]] = at
        put(gone, big)
        for i in (at, before[at]):
            if i >= 0:
                rank = pairs.get((ids[i], ids[after[i]])) if after[i] < n else None
                put(i, big if rank is None else rank * width + i)
    return [i for i in ids if i >= 0]


def merge_many(pieces: list[bytes], r: Ranks) -> list[bytes]:
    """Ids of many short matches, as little-endian bytes; all trees take a merge at a time."""
    n = np.fromiter(map(len, pieces), np.int64, len(pieces))
    rows, width = len(pieces), 1 << max(1, int(n.max() - 1).bit_length())
    padded = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
    column = np.arange(width)
    ids = np.where(column < n[:, None], r.byte_rank[padded], -1)
    ids = np.concatenate((ids, np.full((rows, 2), -1)), axis=1)  # column width: after the last; width + 1: before the first
    before = np.tile(np.concatenate(([width + 1], column[:-1], [0, 0])), (rows, 1))
    after = np.tile(np.concatenate((column[1:], [width, width, width])), (rows, 1))
    tree = np.full((rows, 2 * width), NONE)
    rank = r.pair_ranks(ids[:, : width - 1], ids[:, 1:width])
    tree[:, width : 2 * width - 1] = np.where(rank < NONE, rank * width + column[:-1], NONE)
    for i in range(width - 1, 0, -1):
        tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])

    def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + width
        tree[row, node] = value
        while node[0] > 1:
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    active = np.flatnonzero(tree[:, 1] < NONE)
    while len(active):
        rank, at = np.divmod(tree[active, 1], width)
        gone = after[active, at]
        beyond = after[active, gone]
        ids[active, at], ids[active, gone] = rank, -1
        after[active, at] = beyond
        inside = beyond < width
        before[active[inside], beyond[inside]] = at[inside]
        put(active, gone, np.full(len(active), NONE))
        for left in (at, before[active, at]):
            some = left < width
            row, leaf = active[some], left[some]
            if len(row):
                rank = r.pair_ranks(ids[row, leaf], ids[row, after[row, leaf]])
                put(row, leaf, np.where(rank < NONE, rank * width + leaf, NONE))
        active = active[tree[active, 1] < NONE]
    ids = ids[:, :width]
    live = ids >= 0
    flat, ends = ids[live].astype("<u4").tobytes(), (4 * np.cumsum(live.sum(axis=1))).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Encodes texts by a rank file; ids are kept as little-endian bytes."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.split, self.seen, self.older = ranks(path), regex.compile(pattern), {}, {}

    def learn(self, pieces: set[str]) -> None:
        """Encode matches not yet seen.  A match that is a token is that token."""
        short: dict[int, list[str]] = {}
        tokens, seen = self.ranks.tokens, self.seen
        for piece in pieces:
            raw = piece.encode()
            whole = tokens.get(raw)
            if whole is not None:
                seen[piece] = whole.to_bytes(4, "little")
            elif len(raw) <= SHORT:
                short.setdefault((len(raw) - 1).bit_length(), []).append(piece)
            else:
                seen[piece] = np.array(merge_one(raw, self.ranks), "<u4").tobytes()
        for some in short.values():
            for at in range(0, len(some), 8192):
                part = some[at : at + 8192]
                seen.update(zip(part, merge_many([p.encode() for p in part], self.ranks)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        found = list(map(self.split.findall, texts))
        new = self.unknown(found)
        if len(self.seen) + len(new) > REMEMBERED:
            self.older, self.seen = self.seen, {}
            new = self.unknown(found)
        again = new & self.older.keys()
        self.seen.update(zip(again, map(self.older.__getitem__, again)))
        self.learn(new - again)
        get = self.seen.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in found]
        for piece in new:
            if len(piece) > LONGEST:
                del self.seen[piece]
        return out

    def unknown(self, found: list[list[str]]) -> set[str]:
        new: set[str] = set()
        for pieces in found:
            new.update(filterfalse(self.seen.__contains__, pieces))
        return new

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_table(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""

    def run(batches):
        e = encoder(path, pattern)
        for batch in batches:
            ids = [np.frombuffer(x, "<i4") for x in e.encode(texts_of(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>", rows=500)


def decode_table(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and bytes (binary) of every row of ids."""

    def run(batches):
        e = encoder(path, pattern)
        for batch in batches:
            out = [e.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, bytes binary", rows=500)


def digest_table(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, so
    that neither ids nor bytes leave the worker."""

    def run(batches):
        e = encoder(path, pattern)
        for batch in batches:
            ids = e.encode(texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(e.decode(x)).hexdigest() for x in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema, rows=500)
