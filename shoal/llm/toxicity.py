"""Toxicity scores: a linear classifier on character n-grams whose features are scaled
by naive Bayes log-count ratios.

Text is lower-cased, runs of white space become one space and the ends get one; its
n-grams of 2 to 6 characters (code points) are hashed to 2^20 features that a document has or has
not.  From labelled documents of either class the ratio
``r = log((p + 1) / (n_toxic + 2)) - log((q + 1) / (n_clean + 2))`` of each
feature is taken (p and q documents have it).  The features whose frequencies differ between the
classes at the 0.1 % level of the log-likelihood-ratio test are scaled by r, however many they
are, and a logistic regression with an L2 penalty is fitted by Newton steps with conjugate
gradients.  The score is its probability.  (On long texts the others only add noise: with all
features a third of the held-out toxic documents of sf0.1 were missed, with these a twelfth.)

The fit uses a bounded sample of the labelled rows (``SAMPLE`` of each class in the order
of a hash of their id, whole texts), weighted back to the classes' sizes over all labelled rows.
Executors turn the sampled texts into features; the driver gets at most 2 * ``SAMPLE`` sets of them.
Scoring covers every whole text.

Defined cases: null text is the empty text, scored by the intercept; null ids are
hashed as the empty string and have no label; a document with several labels counts as
toxic if any is; of rows that share a labelled id the one of least text hash is learnt from;
without two classes the score is the share of toxic labels (0.5
without labels); an empty table gives an empty result; other columns are ignored by ``scores``
and returned by ``clean``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, as_given, free_names, release, row_hash, text_or_empty, texts_of

GRAMS = (2, 3, 4, 5, 6)
BITS = 20
SAMPLE = 1200
PENALTY = 1.0
#: Chi-squared with one degree of freedom, at 0.1 %.
SIGNIFICANT = 10.83
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Characters of a text that are hashed at a time; neighbours overlap.
BLOCK = 1 << 18


def features_at(text: str):
    """Arrays of the hashed feature at every position of a text; they repeat."""
    raw = (" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass")
    count = len(raw) // 4
    for start in range(0, count, BLOCK):
        b = np.frombuffer(raw, "<u4", min(BLOCK + GRAMS[-1] - 1, count - start), start * 4).astype(np.uint64) + np.uint64(1)
        h = b
        for n in range(2, GRAMS[-1] + 1):
            if len(b) < n:
                break
            h = h[: len(b) - n + 1] * np.uint64(0x100000001B3) + b[n - 1 :]
            if n in GRAMS:
                yield ((h * _PRIME) >> np.uint64(64 - BITS)).astype(np.int32)


def features_of_gram(gram: str) -> int:
    """The feature of one n-gram, by plain numbers."""
    h = 0
    for n, c in enumerate(gram):
        h = ((h * 0x100000001B3 if n else 0) + ord(c) + 1) % (1 << 64)
    return h * int(_PRIME) % (1 << 64) >> 64 - BITS


def features(text: str, mark: np.ndarray | None = None) -> np.ndarray:
    """The distinct features of a text, ascending.  ``mark`` is a reusable array of 2^BITS
    False values."""
    mark = np.zeros(1 << BITS, bool) if mark is None else mark
    for found in features_at(text):
        mark[found] = True
    at = np.flatnonzero(mark).astype(np.int32)
    mark[at] = False
    return at


@dataclass
class Model:
    weights: np.ndarray  # float32 of all features
    intercept: float

    def score(self, text: str) -> float:
        kept = [f[self.weights[f] != 0] for f in features_at(text)]
        at = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int32)
        z = self.intercept + float(self.weights[at].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def ratios(found: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The naive Bayes log-count ratio of every feature, and the log-likelihood-ratio statistic of
    its difference between the classes."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for at, label in zip(found, labels):
        counts[label, at] += 1
    total = np.bincount(labels, minlength=2)
    # Features differ by their two counts only, of which there are few: each is worked out once.
    kinds, kind = np.unique(counts[0].astype(np.int64) << 32 | counts[1], return_inverse=True)
    x, y = kinds & 0xFFFFFFFF, kinds >> 32
    p, q = (x + 1) / (total[1] + 2), (y + 1) / (total[0] + 2)
    mean = (x + y + 1) / (total.sum() + 2)

    def gain(x, n):
        return 2 * n * (x * np.log(x / mean) + (1 - x) * np.log((1 - x) / (1 - mean)))

    return np.log(p / q).astype(np.float32)[kind], (gain(p, total[1]) + gain(q, total[0])).astype(np.float32)[kind]


def fit(found: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, prior: float = 0.5) -> Model:
    """found: distinct features of each document; weight: of each, so that classes count by
    their true sizes."""
    if not len(found) or labels.min() == labels.max():
        share = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    ratio, statistic = ratios(found, labels)
    found = [at[statistic[at] >= SIGNIFICANT] for at in found]
    kept = np.unique(np.concatenate(found))
    scale, columns = ratio[kept].astype(float), np.searchsorted(kept, np.concatenate(found))
    ends = np.cumsum([len(at) for at in found])
    lengths, y, w = np.diff(ends, prepend=0), labels.astype(float), weight / weight.mean()

    def product(v):  # X v, X with a last column of ones
        sums = np.concatenate(([0.0], np.cumsum((v[:-1] * scale)[columns])))
        return sums[ends] - sums[ends - lengths] + v[-1]

    def back(u):  # transposed
        return np.append(np.bincount(columns, np.repeat(u, lengths), len(kept)) * scale, u.sum())

    penalty = np.append(np.full(len(kept), PENALTY), 1e-6)
    v = np.zeros(len(kept) + 1)
    v[-1] = np.log((w * y).sum() / (w * (1 - y)).sum())

    def loss(v, z):
        return (w * (np.logaddexp(0, z) - y * z)).sum() + (penalty * v * v).sum() / 2

    z = product(v)
    now = loss(v, z)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        gradient = back(w * (mu - y)) + penalty * v
        curve = w * mu * (1 - mu)
        step, rest = np.zeros_like(v), -gradient
        along, size2 = rest.copy(), rest @ rest
        goal = size2 * 1e-2
        for _ in range(60):
            bent = back(curve * product(along)) + penalty * along
            a = size2 / (along @ bent)
            step, rest = step + a * along, rest - a * bent
            new = rest @ rest
            if new < goal:
                break
            along, size2 = rest + new / size2 * along, new
        length, ahead = 1.0, product(step)
        while loss(v + length * step, z + length * ahead) > now and length > 1e-6:
            length /= 2
        v, z = v + length * step, z + length * ahead
        was, now = now, loss(v, z)
        if was - now < 1e-7 * abs(was):
            break
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = v[:-1] * scale
    return Model(weights, float(v[-1]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _features(batches):
    mark = np.zeros(1 << BITS, bool)
    for batch in batches:
        found = [features(t, mark) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "found"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows that are not held out, one document an id."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    order = row_hash("toxicity", F.col("doc_id"))
    chosen = [marks.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(sample) for c in (0, 1)]
    chosen = chosen[0].union(chosen[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # At most 2 * sample rows of 12 bytes: the bound of the broadcast.
    rows = rows.join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.sha2("text", 256), "text")).alias("x"))
    rows = rows.select("doc_id", "toxic", F.col("x.text").alias("text"))
    got = arrow_map(rows, _features, "doc_id long, toxic int, found array<int>", rows=100).toArrow()
    release(docs.sparkSession)  # the JVM has sent its copy
    order = np.lexsort((got.column("doc_id").to_numpy(), got.column("toxic").to_numpy()))
    y = got.column("toxic").to_numpy()[order].astype(np.int64)
    found = got.column("found")
    found = [found[int(i)].values.to_numpy() for i in order]
    n = np.bincount(y, minlength=2)
    weight = np.array([sizes.get(c, 0) / max(1, n[c]) for c in (0, 1)])
    all_rows = sum(sizes.values())
    return fit(found, y, weight[y], sizes.get(1, 0) / all_rows if all_rows else 0.5)


def score_table(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """Columns ``keep`` and the score, as ``name``, of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^20 floats, whatever the input
    rows = docs.select(*as_given(keep), *([] if "text" in keep else ["text"]))
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batches):
        m = sent.value
        for batch in batches:
            scores = pa.array([m.score(t) for t in texts_of(batch)], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), scores], [*keep, name])

    return arrow_map(rows, run, f"{fields}, `{name}` double", rows=500)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score_table(ids, train(ids, labels), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, columns as given."""
    (name,) = free_names(docs.columns, "score")
    return score_table(docs, train(docs, labels), docs.columns, name).filter(F.col(name) < 0.5).select(*as_given(docs.columns))
