"""Near copies against all pairs."""

import random

import numpy as np

from shoal.llm import near, simhash
from tests.llm.test_operators import frame, none, odd, words_like  # noqa: F401


def plain_shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_groups(rows):
    """rows: (doc_id, text); component id of each."""
    sets = [plain_shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        least[x] = min((v for v in (least.get(x), i) if v is not None), default=None)
    return sorted(((i, least[x]) for (i, _), x in zip(rows, label)), key=str)


def test_near_copies(spark, odd, none):  # noqa: F811
    rng = random.Random(21)
    passage, texts = words_like(rng, 120), []
    base = [words_like(rng, rng.choice([6, 30, 90, 300])) for _ in range(12)]
    for i in range(260):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"new{i}"
        texts.append(" ".join(words) + (" " + passage if i % 4 == 0 else ""))
    for df in (frame(spark, texts), odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = near.groups(df).collect()
        assert sorted(map(tuple, got), key=str) == plain_groups(rows)
    assert near.groups(none).count() == 0


def test_stage_drops_near_copies_of_many_bits(spark):
    import corpus_pipeline

    rng = random.Random(22)
    words = words_like(rng, 100).split()
    edited = [*words[:40], "new", *words[41:]]
    docs = frame(spark, [" ".join(words), " ".join(edited), words_like(rng, 100)])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 2]


def test_rows_of_one_id_are_told_apart(spark):
    """A dropped copy takes no other text of its id along, null ids lose, and repeats leave one row."""
    rng = random.Random(23)
    a, z = words_like(rng, 80), words_like(rng, 80)
    rows = frame(spark, [a, a, z, a, a, z, z], [1, 2, 2, None, None, 2, None])
    for kept in (near.keep_one(rows), simhash.keep_one(rows)):
        assert kept.columns == rows.columns
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (2, z)])
    alone = frame(spark, [a, a, z], [None, None, None])
    for kept in (near.keep_one(alone), simhash.keep_one(alone)):
        assert sorted(r.text for r in kept.collect()) == sorted([a, z])
    assert near.keep_one(rows.limit(0)).count() == simhash.keep_one(rows.limit(0)).count() == 0


def test_rest_finds_what_stars_miss(spark, monkeypatch):
    """However many star rounds there are, the groups are the same."""
    rng = random.Random(24)
    texts = []
    for _ in range(6):
        words = words_like(rng, 60).split()
        for i in range(30):
            words = words.copy()
            words[rng.randrange(60)] = f"v{i}"
            texts.append(" ".join(words))
    df = frame(spark, texts)
    want = plain_groups([(r.doc_id, r.text) for r in df.collect()])
    for rounds in (1, 3):
        monkeypatch.setattr(near, "ROUNDS", rounds)
        assert sorted(map(tuple, near.groups(df).collect()), key=str) == want


def test_parity_bounds_the_difference():
    rng = random.Random(25)
    for _ in range(50):
        a = {rng.getrandbits(64) for _ in range(rng.randrange(1, 900))}
        b = set(rng.sample(sorted(a), rng.randrange(len(a) + 1))) | {rng.getrandbits(64) for _ in range(rng.randrange(300))}
        bits = [near.parity(np.array(sorted(x), np.uint64)).view(np.uint64).tolist() for x in (a, b)]
        assert sum((x ^ y).bit_count() for x, y in zip(*bits)) <= len(a ^ b)


def tables_of(spark):
    """Names of the tables that are there."""
    from pathlib import Path

    from shoal.tables import session_dir

    return sorted(p.name.rpartition("-")[0] for p in Path(session_dir(spark).removeprefix("file:")).glob("*"))


def families(spark):
    rng = random.Random(26)
    texts = []
    for _ in range(5):
        words = words_like(rng, 80).split()
        for i in range(25):
            texts.append(" ".join([*words[:i], f"v{i}", *words[i + 1 :], *[f"w{i}x{j}" for j in range(i % 12)]]))
    return frame(spark, texts)


def test_pairs_are_verified_in_parts(spark, monkeypatch):
    """However few pairs are verified at a time, the groups are the same; shuffles and tables of one part go before the next."""
    df = families(spark)
    want = plain_groups([(r.doc_id, r.text) for r in df.collect()])
    monkeypatch.setattr(near, "LEAST_PAIRS", 40)
    monkeypatch.setattr(near, "PAIRS_A_TEXT", 0.2)
    parts, verified = [], near.Search.verified
    monkeypatch.setattr(near.Search, "verified", staticmethod(lambda *a: parts.append(a[3]) or verified(*a)))
    assert sorted(map(tuple, near.groups(df).collect()), key=str) == want
    assert max(parts) > 1


def test_prefixes_go_before_texts_move(spark):
    """The table of prefix shingles is a good part of the input: it is deleted when the buckets are made, and each
    part of the buckets is made of its own shingles alone."""
    from shoal.tables import drop_tables

    drop_tables(spark)
    seen, connect = [], near.Search.connect
    near.Search.connect = lambda self, pairs: seen.append(tables_of(spark)) or connect(self, pairs)
    try:
        near.keep_one(families(spark)).collect()
    finally:
        near.Search.connect = connect
    assert all("near" not in s for s in seen) and seen[0].count("near-buckets") == near.PARTS
    assert "near-buckets" not in tables_of(spark)


def test_shuffles_go_with_the_write(spark):
    """A table's shuffles are gone when it is written, whether or not the driver has collected what held them."""
    from shoal import tables

    def files():
        return spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")

    before = files()
    tables.written(spark.range(20000).repartition(7).groupBy("id").count(), "released")
    assert files() <= before
