"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of the lengths, in tokens, of frequent pre-tokens, sent to
all workers once: at most ``FREQUENT`` words, whatever the corpus.  Tier two is a
worker's own bounded cache, which the tokenizer library fills for pre-tokens that are in
neither.  A text's count is the sum over its pre-tokens, so no pre-token is ever shuffled.

The choice of the frequent words is approximate: over all documents each task sums the words between
spaces that a batch has ``RARE`` times or more, of up to 64 characters, in a bounded summary (when full, it drops the
rarer half) and sends its ``SENT`` most frequent ones.  Only these summaries meet in a sum by word;
no pre-token of a document is shuffled.  What they are decides what is fast, never what is counted.

Defined cases: null text is the empty text with 0 tokens; a special token's string inside
a text is one token, as the library has it; repeated rows repeat; an empty table gives
an empty result.
"""

from __future__ import annotations

import os
import uuid
from functools import cache, lru_cache
from itertools import filterfalse

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, texts_of

FREQUENT, SENT, SUMMARY = 16_384, 4_096, 1 << 18
#: A batch of documents tells the words that it has so many times.
RARE = 3
#: Pre-tokens in each of a worker's two tables at most: when the newer one is full it becomes the older
#: one, from which pre-tokens that are met again are carried over, and a new one starts from tier one.
REMEMBERED = 400_000
#: Characters of a pre-token that is remembered; with ``REMEMBERED`` this bounds the cache.
LONGEST = 256
LIMIT = 512


@cache
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Counter:
    """Counts tokens of texts; ``frequent`` are the pre-tokens of tier one and their lengths."""

    def __init__(self, path: str, pattern: str, frequent: tuple[list[str], bytes] = ([], b"")):
        self.library, self.split = tokenizer(path), regex.compile(pattern)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.frequent = dict(zip(frequent[0], frequent[1]))
        self.lengths, self.older = dict(self.frequent), {}

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and the number of special tokens that part it."""
        if self.special is None or not self.special.search(text):
            return self.split.findall(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.split.findall(part)], len(parts) - 1

    def learn(self, pieces: list[str]) -> None:
        encode = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        for at in range(0, len(pieces), 8192):
            some = pieces[at : at + 8192]
            self.lengths.update(zip(some, (len(e) for e in encode(some, add_special_tokens=False))))

    def counts(self, texts: list[str]) -> list[int]:
        found = [self.pieces(t) for t in texts]
        new = self.unknown(found)
        if len(self.lengths) + len(new) > REMEMBERED + len(self.frequent):
            self.older, self.lengths = self.lengths, dict(self.frequent)
            new = self.unknown(found)
        again = new & self.older.keys()
        self.lengths.update(zip(again, map(self.older.__getitem__, again)))
        self.learn(list(new - again))
        length = self.lengths.__getitem__
        out = [sum(map(length, pieces)) + special for pieces, special in found]
        for piece in new:
            if len(piece) > LONGEST:
                del self.lengths[piece]
        return out

    def unknown(self, found: list[tuple[list[str], int]]) -> set[str]:
        new: set[str] = set()
        for pieces, _ in found:
            new.update(filterfalse(self.lengths.__contains__, pieces))
        return new


def _summaries(batches):
    seen: dict[str, int] = {}
    for batch in batches:
        words = pc.list_flatten(pc.split_pattern(batch.column("text").cast(pa.large_string()), " "))
        counts = pc.value_counts(words)
        counts = counts.filter(pc.greater_equal(counts.field("counts"), RARE))
        for word, n in zip(counts.field("values").to_pylist(), counts.field("counts").to_pylist()):
            if word is not None and len(word) <= 64:
                seen[word] = seen.get(word, 0) + n
        if len(seen) > SUMMARY:
            seen = dict(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: SUMMARY // 2])
    best = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:SENT]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["word", "n"])


def frequent_pretokens(docs: DataFrame, path: str, pattern: str) -> tuple[list[str], bytes]:
    """Tier one: pre-tokens of the most frequent words, and their lengths (one byte each)."""
    words = arrow_map(docs.select("text"), _summaries, "word string, n long")
    words = words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    c = Counter(path, pattern)
    pieces = sorted({p for r in words for form in (r[0], " " + r[0]) for p in c.split.findall(form)})
    c.learn(pieces)
    short = [p for p in pieces if c.lengths[p] < 256]
    return short, bytes(c.lengths[p] for p in short)


@lru_cache(maxsize=1)
def _worker_counter(path: str, pattern: str, key: str) -> list:
    """Where a worker keeps its counter from one task of a query to the next."""
    return []


def count_table(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(frequent_pretokens(docs, path, pattern))
    key = uuid.uuid4().hex

    def run(batches):
        held = _worker_counter(path, pattern, key)
        if not held:
            held.append(Counter(path, pattern, sent.value))
        c = held[0]
        for batch in batches:
            texts = texts_of(batch)
            n = c.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return arrow_map(docs, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", rows=500)
