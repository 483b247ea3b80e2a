"""SimHash near-duplicate groups found with Golay-code fuzzy hashing.

Fingerprint: ASCII-lower-cased words, shingles of three words joined by one space
(repeats count; fewer words give one shingle of all; none gives fingerprint 0),
XXH64 with seed 42 of each; a bit is set when it is set in over half the hashes.

Search for pairs that differ in at most three of 64 bits.  The fingerprint is cut
into segments of 22, 21 and 21 bits.  Sorted by errors, a pair's segments have
(0, at most 1, any) or (1, 1, 1) errors.  A segment is decoded by the perfect
binary Golay code of length 23: a word at distance 3 from its codeword has five
more codewords at distance 4, any other word has none.  So if words x and y differ
in one bit, y's own codeword is always among the one or six near codewords of x.
Every fingerprint is filed under its own codewords and looked up under its near
ones:

* six keys (exact segment i, codeword of segment j) find the first kind of pair;
* one key (codewords of all three segments, 36 bits) finds the second.

Candidates meet in an equi-join on the key and are verified by a bit count.  Equal
fingerprints are one node from the start, so a group of copies of any size is one
row here; a fingerprint has at most 43,744 others within three bits, whatever the corpus.
Components of the links come from alternating star rounds on written
tables; nothing is collected.

Defined cases: null and word-free texts have fingerprint 0 and link like any other;
null ids are left out of the minimum and a component of null ids only has a null
component_id; repeated rows stay in ``groups``; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, discard, row_key, rows_with, texts_of, written

SHINGLE = 3
MAX_BITS = 3
#: Hashes that are unpacked to bits at a time.
CHUNK = 1 << 15
#: Low bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of a whole text, in order, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
    return np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """SimHash of a whole text, as an unsigned 64-bit number."""
    return majority(shingle_hashes(text, size))


def _fingerprints(batches):
    for batch in batches:
        found = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])


def _keyed(batches):
    for batch in batches:
        found = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(found)], ["doc_id", "key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document, computed once and written."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(arrow_map(rows, _fingerprints, "doc_id long, fp long"), "simhash")


def _syndrome(word: int) -> int:
    for at in range(22, 10, -1):
        if word >> at & 1:
            word ^= GENERATOR << (at - 11)
    return word


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of every 12-bit half (low, high) and, by syndrome, the error patterns
    that lead to near codewords: the least one, then five of weight 4 where that one
    has weight 3 (elsewhere the least one again)."""
    one = [_syndrome(1 << i) for i in range(23)]
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
    for i in range(12):
        low[1 << i : 2 << i] = low[: 1 << i] ^ one[i]
        high[1 << i : 2 << i] = high[: 1 << i] ^ (one[12 + i] if 12 + i < 23 else 0)
    found: list[list[int]] = [[] for _ in range(1 << 11)]

    def place(weight: int, first: int, pattern: int, syndrome: int) -> None:
        if not weight:
            least = found[syndrome]
            if not least or (least[0].bit_count() == 3 and pattern.bit_count() == 4):
                least.append(pattern)
            return
        for i in range(first, 23):
            place(weight - 1, i + 1, pattern | 1 << i, syndrome ^ one[i])

    for weight in range(5):
        place(weight, 0, 0, 0)
    patterns = np.array([p if len(p) == 6 else p * 6 for p in found], np.int64)
    return low, high, patterns


def near_codewords(words: np.ndarray) -> np.ndarray:
    """n x 6 codewords near each 23-bit word, its own first; fewer are repeated."""
    low, high, patterns = golay()
    return words[:, None] ^ patterns[low[words & 0xFFF] ^ high[words >> 12]]


def fuzzy_keys(fps: np.ndarray, triples: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, filed) for unsigned fingerprints: filed keys are a fingerprint's own,
    the others are those that it looks up.  Without ``triples`` the key of three
    codewords is left out, and with it only pairs of one error in each segment."""
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = [near_codewords(p) for p in parts]
    many = [n[:, 1] != n[:, 0] for n in near]
    rows, keys, filed = [], [], []
    number = np.arange(len(fps))

    def put(kind: int, left: np.ndarray, right: np.ndarray, which: np.ndarray, own: bool) -> None:
        rows.append(which)
        keys.append((np.int64(kind) << np.int64(46)) | (left << np.int64(23)) | right)
        filed.append(np.full(len(which), own))

    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                put(kind, parts[i], near[j][:, 0], number, True)
                put(kind, parts[i], near[j][:, 0], number, False)
                some = number[many[j]]
                for c in range(1, 6):
                    put(kind, parts[i][some], near[j][some, c], some, False)
                kind += 1
    if not triples:
        return np.concatenate(rows), np.concatenate(keys), np.concatenate(filed)
    index = [n >> 11 for n in near]  # the 12 data bits of a codeword
    put(kind, index[0][:, 0] << 1, index[1][:, 0] << 12 | index[2][:, 0], number, True)
    for a, b, c in product(range(6), repeat=3):
        some = number[(many[0] | (a == 0)) & (many[1] | (b == 0)) & (many[2] | (c == 0))]
        put(kind, index[0][some, a] << 1, index[1][some, b] << 12 | index[2][some, c], some, False)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(filed)


def _keys(own: bool, triples: bool):
    def run(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            rows, keys, filed = fuzzy_keys(fps.view(np.uint64), triples)
            some = filed == own
            yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(fps[rows[some]])], ["key", "fp"])

    return run


def links(nodes: DataFrame, triples: bool = True) -> DataFrame:
    """(a, b), a < b: verified links between the distinct fingerprints of ``nodes``.

    When a looks b up it finds b's own key and the other way round, so it is enough
    that every node is filed once and looks up once.  All links are found with ``triples``;
    without, those of all pairs within two bits and most within three, for a fifth of the keys.
    """
    schema = "key long, fp long"
    filed = arrow_map(nodes, _keys(True, triples), schema)
    asked = arrow_map(nodes, _keys(False, triples), schema).withColumnRenamed("fp", "other")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= MAX_BITS
    found = asked.join(filed, "key").filter((F.col("fp") != F.col("other")) & near)
    return found.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def components(edges: DataFrame, label: str = "component") -> DataFrame:
    """(node, root) of every node that has a link; root is the least node reachable.

    Alternating large-star and small-star rounds: a hub is a key of an aggregation
    and of a join that adaptive execution can split.  The number of rounds grows with
    the logarithm of the longest chain.
    """

    def least_of(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return low.select("u", F.least("u", "m").alias("m"))

    def state(pairs: DataFrame):
        return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    pairs = written(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), label)
    was = state(pairs)
    while was[0]:
        both = pairs.union(pairs.select("v", "u"))
        large = both.join(least_of(both), "u").filter(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = least_of(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low).filter("u != v").distinct()
        before, pairs = pairs, written(small.select("u", "v"), label)
        discard(before)
        now = state(pairs)
        if now == was:
            break
        was = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every document."""
    prints = fingerprints(docs)
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp")))
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    label = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(nodes.join(label, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one document stays, that of
    the least id (null ids last, ties by text).  Rows are told apart by id and text,
    so other texts under a dropped id stay; of rows that repeat both, one stays."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    prints = written(arrow_map(rows, _keyed, "doc_id long, key binary, fp long"), "simhash")
    return rows_with(docs, best_keys(prints, "fp", components(links(prints.select("fp").distinct()))))


def best_keys(rows: DataFrame, node: str, roots: DataFrame) -> DataFrame:
    """The key of the document that stays of each component of the nodes of ``rows``
    (doc_id, key, node).  A group of any size is one row a task before it moves."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")).alias("best")
    nodes = rows.groupBy(F.col(node).alias("node")).agg(best).join(roots, "node", "left")
    kept = nodes.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    return kept.select("best.key")
