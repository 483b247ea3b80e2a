"""The corpus operators against brute-force versions, on odd rows: nulls, empty and long texts,
ties, repeated rows, empty tables and columns with clashing names."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from shoal.llm import bpe, exact, lines, mixing, shared, simhash, syncmers, tokens, toxicity, urls, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, bucket int, __key string, fp long, size long, h long"


def rows_of(texts, ids=None, sources=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", s, None if t is None else len(t), "x", 1, "k", 5, 7, 9) for i, t, s in zip(ids, texts, sources or ["a"] * len(texts))]


def frame(spark, *args, **kw):
    return spark.createDataFrame(rows_of(*args, **kw), SCHEMA)


ODD = [None, "", " ", "a", "A b\tc\n\nd", "x" * 20_000, "日本 語 é 😀" * 40, "same text here", "same text here", "Same Text HERE", "\n\n\n", "don't <|endoftext|> I'll  \t go", "1²Ⅷ  !? \x1c\x85z"]


@pytest.fixture(scope="module")
def odd(spark):
    ids = [3, 1, 2, None, 5, 6, 7, 8, 9, 10, 11, 12, 13]
    df = frame(spark, ODD, ids, ["b", "a", None, "b", "a", "c", "d", None, "b", "a", "", "a", "b"])
    return df.union(df.filter("doc_id = 9")).union(df.filter("doc_id is null"))


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def words_like(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "théta"]) + str(rng.randrange(50)) for _ in range(n))


# -- BPE ---------------------------------------------------------------------------------

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library():
    import tiktoken

    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library_and_round_trips(spark, odd, none):
    enc = library()
    got = bpe.digest_table(odd, MULTI, public_tokenizers.PATTERN).collect()
    want = []
    for r in odd.collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    encoded = bpe.encode_table(odd, MULTI, public_tokenizers.PATTERN)
    decoded = bpe.decode_table(encoded, MULTI, public_tokenizers.PATTERN).filter("doc_id = 7").first()
    assert bytes(decoded["bytes"]).decode() == ODD[6]
    assert bpe.digest_table(none, MULTI, public_tokenizers.PATTERN).count() == 0


def test_segment_trees_agree_with_library():
    enc, e, rng = library(), bpe.Encoder(MULTI, public_tokenizers.PATTERN), random.Random(3)
    texts = ["".join(rng.choice("abcdeé ß'\n1.!中😀") for _ in range(rng.randrange(200))) for _ in range(300)]
    texts += ["ab" * 700, "\n" * 300, "é" * 999]
    for text, ids in zip(texts, e.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text)
    for piece in (b"abcabc", b"x", "中文字".encode()):
        one = bpe.merge_one(piece, e.ranks)
        assert np.array(one, "<u4").tobytes() == bpe.merge_many([piece], e.ranks)[0]


def test_encoder_forgets_and_carries_over(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    enc, e, rng = library(), bpe.Encoder(MULTI, public_tokenizers.PATTERN), random.Random(4)
    for _ in range(30):
        text = words_like(rng, 15)
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == enc.encode_ordinary(text)


# -- token counts ------------------------------------------------------------------------


def test_token_counts_equal_library(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = tokens.tokenizer(path)
    got = tokens.count_table(odd, path, public_tokenizers.PATTERN).collect()
    want = [(r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in odd.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokens.count_table(none, path, public_tokenizers.PATTERN).count() == 0


def test_token_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 30)
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(5)
    c = tokens.Counter(path, public_tokenizers.PATTERN, (["alpha", " beta"], bytes([9, 9])))
    assert c.counts(["alpha beta"]) == [18]  # tier one is asked first
    c = tokens.Counter(path, public_tokenizers.PATTERN)
    for _ in range(20):
        text = words_like(rng, 12)
        assert c.counts([text]) == [len(c.library.encode(text, add_special_tokens=False).ids)]


# -- mixing ------------------------------------------------------------------------------


def test_mixing_meets_targets(spark, odd, none):
    rng = random.Random(6)
    texts = [words_like(rng, rng.randrange(0, 400)) for _ in range(400)]
    sources = [rng.choice(["s1"] * 6 + ["s2", "s3", None]) for _ in texts]
    sources[0] = "tiny"
    df = frame(spark, texts, sources=sources)
    plan, seats = mixing.mix(df)
    rows = plan.collect()
    assert len(rows) == 400
    size = {}
    for t, s in zip(texts, sources):
        size[s] = size.get(s, 0) + len(t.split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    goal, free, left = {}, set(order), float(sum(size.values()))
    while True:
        per = left / sum(weight[s] for s in free)
        over = {s for s in free if per * weight[s] > 3 * size[s]}
        if not over:
            goal |= {s: per * weight[s] for s in free}
            break
        for s in over:
            goal[s] = 3.0 * size[s]
        left -= sum(goal[s] for s in over)
        free -= over
    taken = {}
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].split()) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 3 * r["size"] and r.target == pytest.approx(goal[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - goal[s]) <= 64 for s in order)
    again = mixing.mix(df)[0].collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    # the house of the last shard is filled to the block, and quotas never fall
    last = seats.filter("shard = 8").collect()
    assert sum(r.seats for r in last) == round(sum(size.values()) / 16)
    by = {}
    for r in seats.orderBy("shard").collect():
        assert r.seats >= by.get(r.skey, 0)
        by[r.skey] = r.seats
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    got = {}
    for r in mixed.collect():
        assert r.text == texts[r.doc_id] or texts[r.doc_id].startswith(r.text)
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert got == {s: n for s, n in taken.items() if n}


def test_sainte_lague_seats_are_the_highest_quotients(spark):
    rng = random.Random(7)
    size = {f"s{i}": rng.randrange(1, 5000) for i in range(9)}
    sizes = spark.createDataFrame([(s, n) for s, n in size.items()], "skey string, size long")
    goal = mixing.targets(sizes)
    seats = {r.skey: r.seats for r in mixing.quotas(goal, 16, 1).collect()}
    goals = {r.skey: r.target for r in goal.collect()}
    house = int(sum(size.values()) / 16 + 0.5)
    quotients = sorted(((t / (2 * k + 1), s) for s, t in goals.items() for k in range(2000)), reverse=True)[:house]
    assert seats == {s: sum(q[1] == s for q in quotients) for s in size}


def test_mixing_odd_rows(spark, odd, none):
    plan, _ = mixing.mix(odd)
    assert plan.count() == odd.count()
    assert plan.filter("taken > 3 * size").count() == 0
    assert mixing.mix(none)[0].count() == 0 and mixing.mixed(none).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def test_mix_gives_what_the_plan_takes(spark):
    """Repeated rows, one of them most of a source, share their takes; every copy has a shard, and a
    shard's words are near its quota."""
    rng = random.Random(16)
    texts = ["one two three " * 12] * 30 + [words_like(rng, rng.randrange(1, 60)) for _ in range(200)]
    ids = [5] * 30 + list(range(100, 300))
    df = frame(spark, texts, ids, ["a"] * 30 + [rng.choice("aabcd") for _ in range(200)])
    for some in (df, frame(spark, ["a b c " * 24] * 3 + ["x y " * 325], [1, 1, 1, 2], ["s1"] * 3 + ["s2"])):
        plan = mixing.mix(some)[0].groupBy("doc_id", "source").agg(F.sum("taken").alias("n")).filter("n > 0").collect()
        got, cut = {}, set()
        for r in (rows := mixing.mixed(some, shard="to").collect()):
            key = (r.doc_id, r.source)
            got[key] = got.get(key, 0) + len(r.text.split())
            assert 1 <= r.to <= 8
        assert got == {(r.doc_id, r.source): r.n for r in plan}
    quota = {(r.shard, r.skey): r.seats for r in mixing.mix(df)[1].collect()}
    rows, words = mixing.mixed(df, shard="to").collect(), {}
    for r in rows:
        words[r.to, "s" + r.source] = words.get((r.to, "s" + r.source), 0) + len(r.text.split())
    for (shard, source), seats in quota.items():
        share = 16 * (seats - quota.get((shard - 1, source), 0))
        assert abs(words.get((shard, source), 0) - share) <= 2 * 60 + 16


# -- exact dedup -------------------------------------------------------------------------


def test_minimal_perfect_hash():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    sizes, bits, number = exact.build_mph(b"".join(keys[:2000]))
    assert sorted(number) == list(range(2000))
    found = exact.lookup_mph(sizes, bits, b"".join(keys))
    assert found[:2000].tolist() == number.tolist()
    assert (found[2000:] < 2000).all()  # nonmembers land somewhere or nowhere; slots tell


def test_exact_groups(spark, odd, none):
    rng = random.Random(8)
    texts = [words_like(rng, 2) if rng.random() < 0.5 else "hot" for _ in range(500)]
    for df in (frame(spark, texts), odd):
        rows = df.collect()
        best, size = {}, {}
        for r in rows:
            t = r.text or ""
            size[t] = size.get(t, 0) + 1
            best[t] = max((x for x in (best.get(t), r.doc_id) if x is not None), default=None)
        want = [(r.doc_id, hashlib.sha256((r.text or "").encode()).digest(), best[r.text or ""], size[r.text or ""], r.doc_id == best[r.text or ""]) for r in rows]
        got = [(r.doc_id, bytes(r.digest), r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(df).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        left = exact.survivors(df)
        assert left.columns == df.columns and sorted(r.text or "" for r in left.collect()) == sorted(best)
    assert exact.exact_groups(none).count() == 0 and exact.survivors(none).count() == 0


def test_members_and_nonmembers(spark):
    df = frame(spark, ["a", "b", "c", "a", "d", "b"])
    rows = exact.digests(df)
    groups = {bytes(r.digest): (r.keep_id, r.group_size, r.member) for r in exact.find_groups(rows, 2).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    assert groups == {sha("a"): (3, 2, True), sha("b"): (5, 2, True), sha("c"): (2, 1, True), sha("d"): (4, 1, False)}


# -- SimHash -----------------------------------------------------------------------------


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: (doc_id, fingerprint) rows; component id of each fingerprint."""
    nodes = sorted({f for _, f in prints})
    parent = {f: f for f in nodes}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for i, f in prints:
        r = root(f)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return {f: least[root(f)] for f in nodes}


def test_golay_keys_find_every_pair_within_three_bits():
    rng = random.Random(9)
    for _ in range(60):
        a = rng.getrandbits(64)
        flips = [rng.sample(range(64), d) for d in (1, 2, 3) for _ in range(12)]
        for bits in flips:
            b = a
            for x in bits:
                b ^= 1 << x
            rows, keys, filed = simhash.fuzzy_keys(np.array([a, b], np.uint64))
            own = {k for r, k, f in zip(rows, keys, filed) if r == 1 and f}
            asked = {k for r, k, f in zip(rows, keys, filed) if r == 0 and not f}
            assert own & asked
    near = simhash.near_codewords(np.arange(1 << 12, dtype=np.int64))
    own = near[:, 0]
    assert all(int(x ^ y).bit_count() <= 3 for x, y in zip(range(1 << 12), own))


def test_simhash_groups(spark, odd, none):
    rng = random.Random(10)
    base = [words_like(rng, 300) for _ in range(20)]
    texts = []
    for i in range(300):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "new" + str(i)
        texts.append(" ".join(words))
    for df in (frame(spark, texts), odd):
        rows = df.collect()
        prints = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
        label = plain_components(prints)
        want = [(i, f"{f:016x}", label[f]) for i, f in prints]
        got = simhash.groups(df).select("doc_id", simhash.fingerprint_hex().alias("f"), "component_id").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.groups(none).count() == 0
    kept = simhash.keep_one(frame(spark, texts))
    prints = [(i, plain_fingerprint(t)) for i, t in enumerate(texts)]
    label = plain_components(prints)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({label[f] for _, f in prints})


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(100)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[1001 + i] == 1000 for i in range(100))


# -- toxicity ----------------------------------------------------------------------------


def labelled(spark, n=300, seed=11):
    rng = random.Random(seed)
    texts, toxic = [], []
    for i in range(n):
        words = words_like(rng, rng.randrange(5, 80)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["stinker", "fool", "wretch"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    return docs, labels, toxic


def test_toxicity_on_held_out_rows(spark, odd, none):
    docs, labels, toxic = labelled(spark)
    got = toxicity.scores(docs, labels).collect()
    assert len(got) == len(toxic)
    held = [r for r in got if r.held_out]
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.95 * len(held)
    left = toxicity.clean(docs, labels)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in got if not r.predicted)
    assert toxicity.scores(odd, labels).count() == odd.count()
    assert toxicity.scores(none, labels).count() == 0
    assert {r.score for r in toxicity.scores(odd, labels.limit(0)).collect()} == {0.5}


def plain_grams(text):
    line = " " + " ".join((text or "").lower().split()) + " "
    return {line[i : i + n] for n in range(2, 7) for i in range(len(line) - n + 1)}


def test_ratios_and_fit_against_plain_grams(spark):
    """Log-count ratios of character n-grams, counted gram by gram, and a fit at the minimum of its loss."""
    docs, _, toxic = labelled(spark, 200)
    texts = [r.text for r in docs.orderBy("doc_id").collect()] + ["日本語 毒", "ÀÉ ß", "", None]
    y = np.array([*toxic, 1, 0, 0, 1])
    found = [toxicity.features(t or "") for t in texts]
    ratio, statistic = toxicity.ratios(found, y)
    grams, total = [plain_grams(t) for t in texts], np.bincount(y)
    place = {g: toxicity.features_of_gram(g) for g in set().union(*grams)}
    shared_place = {p for p in place.values() if list(place.values()).count(p) > 1} if len(place) < 3000 else None
    for at, own in zip(found, grams):
        assert set(at.tolist()) == {place[g] for g in own}
    for g in random.Random(1).sample(sorted(place), 300):
        same = {h for h, p in place.items() if p == place[g]} if shared_place is None else {g}
        p, q = (sum(bool(same & own) for own, t in zip(grams, y) if t == c) for c in (1, 0))
        assert ratio[place[g]] == pytest.approx(np.log((p + 1) / (total[1] + 2)) - np.log((q + 1) / (total[0] + 2)))
        pp, qq, m = (p + 1) / (total[1] + 2), (q + 1) / (total[0] + 2), (p + q + 1) / (len(y) + 2)
        like = lambda x, m, n: n * (x * np.log(x / m) + (1 - x) * np.log((1 - x) / (1 - m)))
        assert statistic[place[g]] == pytest.approx(2 * (like(pp, m, total[1]) + like(qq, m, total[0])))
    weight = np.where(y == 1, 2.0, 0.5)
    model = toxicity.fit(found, y, weight)
    kept = np.flatnonzero(statistic >= toxicity.SIGNIFICANT)
    kept = kept[np.isin(kept, np.concatenate(found))]
    dense = np.array([np.isin(kept, at) for at in found]) * ratio[kept]
    v = model.weights[kept] / ratio[kept]
    mu = 1 / (1 + np.exp(-(dense @ v + model.intercept)))
    w = weight / weight.mean()
    slope = dense.T @ (w * (mu - y)) + toxicity.PENALTY * v
    assert abs(slope).max() < 0.05 and abs((w * (mu - y)).sum()) < 0.05
    assert np.count_nonzero(model.weights) <= len(kept)
    assert model.score(texts[0]) == pytest.approx(mu[0], abs=1e-5)


def test_one_document_an_id_is_learnt_from(spark):
    docs, labels, _ = labelled(spark, 60)
    twice = docs.union(docs).union(docs.withColumn("text", F.lit("zz")).filter("doc_id < 3"))
    a, b = toxicity.train(docs.filter("doc_id >= 3"), labels), toxicity.train(twice.filter("doc_id >= 3"), labels)
    assert np.array_equal(a.weights, b.weights) and a.intercept == b.intercept
    assert toxicity.scores(twice, labels).count() == twice.count()


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels, _ = labelled(spark, 120)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity.scores(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.scores(docs, flipped).collect()}
    assert a == b


# -- URLs --------------------------------------------------------------------------------


def test_rules_and_reputation(spark):
    from shoal.llm.queries import URL_RULES

    urls_ = [None, "", "no scheme", "http://A.Example.COM/en/1?x=/y#z", "https://www.example.com/en/", "http://example.com", "http://x.net/es/", "http://net/fr/a",
             "http://badexample.com/en/", "http://spam.org/a", "http://a://b/c", "ftp://h.org?q/..", "http://x\ny.org/p\nq?r"]
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls_)] + [(100 + i, "http://spam.org/%d" % i, "") for i in range(60)] + [(200 + i, "http://good%d.org/" % (i % 9), "") for i in range(90)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(100 + i, 0) for i in range(60)] + [(200 + i, 1) for i in range(90)] + [(None, 1), (205, None)], "page_id long, quality int")
    got = {r.page_id: r for r in urls.judge(pages, labels, F.col("quality") == 1, URL_RULES).collect()}
    assert len(got) == pages.count()
    assert (got[0].host, got[0].path, got[2].host) == ("", "", "")
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert (got[4].rule, got[4].verdict) == ("www.example.com/en/", "allow")
    assert (got[5].path, got[5].rule) == ("", None)
    assert (got[6].rule, got[7].rule, got[8].rule) == ("net/es/", "net/fr/", "com/")
    assert (got[9].rule, got[9].verdict) == (None, "block")
    assert (got[10].host, got[10].path) == ("a:", "//b/c")
    assert (got[11].host, got[11].path) == ("h.org", "")
    assert (got[12].host, got[12].path) == ("x\ny.org", "/p\nq")
    assert all(got[200 + i].verdict == "allow" for i in range(90))
    empty = urls.judge(pages.limit(0), labels, F.col("quality") == 1, URL_RULES)
    assert empty.count() == 0
    assert {r.verdict for r in urls.judge(pages.filter("page_id >= 100"), labels.limit(0), F.col("quality") == 1, []).collect()} == {"allow"}
    many = [*URL_RULES, *(("block", f"h{i}.org/") for i in range(1500)), ("block", "h.org")]
    assert {r.page_id: r.verdict for r in urls.judge(pages, labels, F.col("quality") == 1, many).collect()} == {i: "block" if i == 11 else r.verdict for i, r in got.items()}


def plain_reputation(rows, suffixes):
    """rows: (host, good or None) of each page; upper bound by host, and the corpus' rate."""
    hosts = {}
    for host, good in rows:
        n, k = hosts.get(host, (0, 0))
        hosts[host] = (n + (good is not None), k + (good or 0))

    def parents(host):
        name = re.sub(":[0-9]*$", "", host.split("@")[-1])
        if re.fullmatch("[0-9.]+", name):
            return name, ""
        parts = name.split(".")
        suffix = next((".".join(parts[-i:]) for i in (3, 2) if ".".join(parts[-i:]) in suffixes), parts[-1])
        extra = len(suffix.split(".")) + 1
        return (name if not suffix else ".".join(parts[-extra:])), suffix

    def summed(level, key):
        out = {}
        for u, (n, k) in level.items():
            a, b = out.get(key(u), (0, 0))
            out[key(u)] = (a + n, b + k)
        return out

    domain = {h: parents(h) for h in hosts}
    domains = summed(hosts, domain.__getitem__)
    tops = summed(domains, lambda d: d[1])
    total = summed(tops, lambda s: None)[None]
    rate, strength = total[1] / total[0], []
    above, units = total[1] * rate, 1
    for level, parent in ((tops, lambda u: total), (domains, lambda u: tops[u[1]]), (hosts, lambda u: domains[domain[u]])):
        seen = {u: x for u, x in level.items() if x[0]}
        a, c = sum(k * k / n for n, k in seen.values()), len(seen)
        rho = 0.0
        if c > units and total[0] > c:
            between, within = (a - above) / (c - units), (total[1] - a) / (total[0] - c)
            size = (total[0] - sum(n * n / parent(u)[0] for u, (n, _) in seen.items())) / (c - units)
            whole = between + (size - 1) * within
            rho = (between - within) / whole if whole > 0 else 0.0
        strength.append(1 / min(max(rho, 0.05), 0.5) - 1)
        above, units = a, c
    shrunk = lambda m, up, x: (m * up + x[1]) / (m + x[0])
    upper = {}
    for h, (n, k) in hosts.items():
        d = domain[h]
        prior = shrunk(strength[1], shrunk(strength[0], rate, tops[d[1]]), domains[d])
        a, b = strength[2] * prior + k, strength[2] * (1 - prior) + n - k
        upper[h] = a / (a + b) + (a * b / (a + b) ** 2 / (a + b + 1)) ** 0.5
    return upper, rate


def test_reputation_decides(spark):
    """Bad hosts, domains and suffixes go, with those of their hosts that have no outcomes; verdicts and
    bounds equal a plain computation."""
    rng = random.Random(31)
    names = [f"{x}.site{i}.org" for i in range(8) for x in ("www", "m", "blog")] + [f"h{i}.bad.org" for i in range(4)] + [f"s{i}.junk" for i in range(6)]
    names += ["a.one.co.uk", "b.two.co.uk", "x:8080", "u@x.org:80", "10.0.0.1", "10.0.0.1:99", "", "org", "evil.site0.org", "two.parts.custom.zone"]
    bad = lambda h: h.startswith("h") and "bad.org" in h or h.endswith(".junk") or h == "evil.site0.org"
    rows = [(i, (h := rng.choice(names)), None if h in ("h3.bad.org", "s5.junk") or rng.random() < 0.3 else int(rng.random() < (0.1 if bad(h) else 0.9))) for i in range(1500)]
    pages = spark.createDataFrame([(i, f"http://{h}/p", 1) for i, h, _ in rows], "page_id long, url string, good int")
    labels = spark.createDataFrame([(i, g, "z") for i, _, g in rows if g is not None], "page_id long, quality int, url string")
    suffixes = ("co.uk", "parts.custom.zone")
    got = urls.judge(pages, labels, F.col("quality") == 1, [], suffixes).collect()
    upper, rate = plain_reputation([(h, g) for _, h, g in rows], suffixes)
    assert len(got) == len(rows)
    for r in got:
        assert r.good_upper == pytest.approx(upper[r.host], abs=1e-9) and r.verdict == ("block" if upper[r.host] < rate else "allow")
        assert (r.verdict == "block") == bad(r.host), r
    assert {r.host for r in got if r.n == 0} == {"h3.bad.org", "s5.junk"}


# -- lines -------------------------------------------------------------------------------


def plain_chunks(text):
    all_lines, prime = text.split("\n"), 2**31 - 1
    h = [int(hashlib.md5(x.encode()).hexdigest()[:10], 16) for x in all_lines]
    out, start = [], 0
    for i in range(len(all_lines)):
        rolled = sum(h[i - k] * 1_000_003**k for k in range(4) if i >= k)
        if i == len(all_lines) - 1 or rolled % prime % 3 == 0:
            out.append((i + 1 - start, "\n".join(all_lines[start : i + 1])))
            start = i + 1
    return out


def test_line_dedup(spark, odd, none):
    rng = random.Random(12)
    pool = [words_like(rng, 6) for _ in range(2000)]
    passage = "\n".join(words_like(rng, 9) for _ in range(40))
    texts, paragraph = [], words_like(rng, 60)
    for i in range(120):
        own = [rng.choice(pool) for _ in range(rng.randrange(1, 9))]
        if i % 3 == 0:
            own.insert(rng.randrange(len(own) + 1), passage)
        if i % 4 == 0:
            own.insert(rng.randrange(len(own) + 1), paragraph)
        texts.append("\n".join(own))
    texts += [passage + "\n" + passage, passage]
    df = frame(spark, texts, [*range(len(texts) - 1), 0])
    seen, want = set(), {}
    for i, t in sorted(enumerate(texts), key=lambda x: (x[0] % (len(texts) - 1), hashlib.sha256(f"{x[0] % (len(texts) - 1)}:{x[1]}".encode()).digest())):
        kept, gone = [], 0
        for n, c in plain_chunks(t):
            if n > 1 and c.strip() and c in seen:
                gone += n
            else:
                kept.append(c)
            if n > 1:
                seen.add(c)
        want[i % (len(texts) - 1), "\n".join(kept)] = (len(t.split("\n")), gone)
    got = {(r.doc_id, r.text): (r.n_lines, r.n_removed) for r in lines.without_repeats(df).collect()}
    assert got == want and sum(g for _, g in want.values()) > 1000
    out = lines.without_repeats(odd).collect()
    assert len(out) == odd.count()
    assert {r.text for r in out if r.doc_id == 3} == {None}
    assert lines.without_repeats(none).count() == 0


def test_boundaries_resist_shifts():
    """Lines put before or after a passage move its chunks' ends only within a window."""
    rng = random.Random(17)
    passage = [words_like(rng, 5) for _ in range(300)]
    ends = lambda head: {c.split("\n")[-1] for _, c in plain_chunks("\n".join([*head, *passage]))}
    assert len(ends([]) ^ ends(["x", "y z", "q"])) <= 2 * lines.WINDOW and 60 < len(ends([])) < 140


# -- syncmers ----------------------------------------------------------------------------


def test_anchors_do_not_depend_on_context():
    rng = random.Random(13)
    a = "".join(rng.choice("abcdefgh ijkl") for _ in range(3000))
    places, hashes = syncmers.anchors(a)
    assert np.diff(places).max() <= syncmers.K - syncmers.S + 1
    moved = dict(zip(*(x.tolist() for x in syncmers.anchors("some other head " + a))))
    assert all(moved[p + 16] == h for p, h in zip(places.tolist(), hashes.tolist()))


def test_anchors_by_blocks(monkeypatch):
    rng = random.Random(14)
    a = "".join(rng.choice("abcé😀 ") for _ in range(2000))
    whole = [x.tolist() for x in syncmers.anchors(a)]
    monkeypatch.setattr(syncmers, "BLOCK", 100)
    assert [x.tolist() for x in syncmers.anchors(a)] == whole


def plain_hash(chars):
    h = sum((ord(c) + 1) * 0x9E3779B97F4A7C15 ** (len(chars) - 1 - i) for i, c in enumerate(chars)) % 2**64
    h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
    return h ^ h >> 29


def test_anchors_are_the_closed_syncmers():
    """Every k-mer whose least inner substring lies at an edge, and no other."""
    rng = random.Random(18)
    for n in (24, 25, 40, 47, 48, 49, 300):
        text = "".join(rng.choice("abé日😀 ") for _ in range(n))
        want = []
        for i in range(n - syncmers.K + 1):
            kmer = text[i : i + syncmers.K]
            inner = [plain_hash(kmer[j : j + syncmers.S]) for j in range(syncmers.K - syncmers.S + 1)]
            if min(inner) in (inner[0], inner[-1]):
                want.append((i, plain_hash(kmer)))
        if n < syncmers.SHORT:
            want += [(i, plain_hash(text[i : i + 2])) for i in range(n - 1)]
        assert sorted(zip(*(x.tolist() for x in syncmers.anchors(text)))) == sorted(want)


def plain_chain(a, b):
    """Longest chain of ranked anchors by dynamic programming."""
    def ranked(x):
        seen, out = {}, []
        for v in x.tolist():
            v &= (1 << 24) - 1
            seen[v] = seen.get(v, -1) + 1
            out.append((v, seen[v]))
        return out

    a, place = ranked(a), {v: j for j, v in enumerate(ranked(b))}
    js, best = [place[v] for v in a if v in place], []
    for i, j in enumerate(js):
        best.append(1 + max((best[k] for k in range(i) if js[k] < j), default=0))
    return max(best, default=0)


def test_positional_matching():
    rng = random.Random(19)
    parts = [words_like(rng, 40) for _ in range(6)]
    for _ in range(40):
        a, b = (" ".join(rng.choices(parts, k=rng.randrange(1, 6))) for _ in range(2))
        x, y = syncmers.fingerprint(a), syncmers.fingerprint(b)
        n = plain_chain(x, y)
        assert len(syncmers.chain(x, y)[0]) == n and syncmers.likeness(x, y) == n / (len(x) + len(y) - n)
        assert syncmers.likeness(x, x) == 1 and (syncmers.from_text(syncmers.as_text(x)) == x).all()
        ends = (0, 0)
        for at, bt, size in syncmers.spans(x, y):
            assert a[at : at + size] == b[bt : bt + size] and at >= ends[0] - syncmers.K and bt >= ends[1] - syncmers.K
            ends = at + size, bt + size
    a, b = syncmers.fingerprint(parts[0] + parts[1]), syncmers.fingerprint(parts[1] + parts[0])
    assert syncmers.likeness(a, b) < 0.7  # the same anchors in another order


def test_span_table(spark):
    rng = random.Random(20)
    shared = words_like(rng, 60)
    rows = [(1, 2, "head one " + shared + " x", "another, longer head " + shared + " y"), (3, 4, None, "z"), (5, 6, "abc", "abc")]
    got = {r.a: r for r in syncmers.span_table(spark.createDataFrame(rows, "a long, b long, text_a string, text_b string")).collect()}
    (s,) = got[1].spans
    assert s.in_b - s.in_a == len("another, longer head ") - len("head one ") and s.n > 0.8 * len(shared)
    assert got[3].likeness == 0 and got[5].likeness == 1


def test_syncmers_against_plain_order(spark, odd, none):
    rng = random.Random(15)
    texts = [words_like(rng, rng.randrange(0, 120)) for _ in range(60)]
    for df in (frame(spark, texts, rng.sample(range(1000), 60)), odd, frame(spark, ["only one"])):
        rows = df.collect()
        order = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), hashlib.md5((r.text or "").encode()).digest()))
        want = []
        for i, r in enumerate(order):
            text, after = r.text or "", order[(i + 1) % len(order)].text or ""
            third = len(text) // 3
            new = text[: len(text) - third] + after[:third]
            a, b, c = map(syncmers.fingerprint, (text, new, after))
            want.append((r.doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), syncmers.as_text(a), syncmers.as_text(b), syncmers.likeness(a, b), syncmers.likeness(a, c)))
        got = syncmers.with_next(df).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert syncmers.with_next(none).count() == 0
    near = syncmers.with_next(frame(spark, [words_like(rng, 200) for _ in range(20)])).collect()
    assert min(r.near_edited for r in near) > max(r.near_next for r in near)
    assert syncmers.fingerprint_table(odd).count() == odd.count()


# -- WARC --------------------------------------------------------------------------------


def pages_of(spark):
    long = "<p>" + "héllo " * 400
    rows = [(i, f"http://h.org/{i}?a=b c", long + str(i % 7)) for i in range(60)]
    rows += [(None, None, long + "0"), (None, "u\nv", None), (70, None, "small"), (71, "http://x/", "small"), (72, "x", long + "é"), (72, "x", long + "é"), (-5, "é", long + "1")]
    return spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, shard string")


def test_warc_round_trip(spark, tmp_path):
    pages = pages_of(spark)
    folder = f"file://{tmp_path}/a"
    manifest = warc.write(pages, folder, shard_bytes=20_000, roll_bytes=1_500)
    files = [r.asDict() for r in manifest.collect()]
    assert len({f["shard"] for f in files}) > 3 and len(files) > len({f["shard"] for f in files})
    assert not list((tmp_path / "a").glob("*.tmp"))
    other = f"file://{tmp_path}/b"
    warc.write(pages.repartition(7), other, shard_bytes=20_000, roll_bytes=1_500)
    for f in files:
        assert (tmp_path / "a" / f["file"]).read_bytes() == (tmp_path / "b" / f["file"]).read_bytes()
    got = warc.read(spark, folder)
    rows = pages.collect()
    best = {}
    for r in rows:
        if r.page_id is not None:
            best[r.html] = max(best.get(r.html, r.page_id), r.page_id)
    want = []
    for r in rows:
        raw = (r.html or "").encode()
        to = best.get(r.html) if len(raw) >= 1000 else None
        to = None if to == r.page_id else to
        want.append((r.page_id, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    back = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, back), key=str) == sorted(want, key=str)
    for r in got.filter("record_type = 'response'").collect():
        assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest
    import gzip

    first = sorted((tmp_path / "a").glob("*.warc.gz"))[0]
    assert gzip.decompress(first.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    damaged = bytearray(first.read_bytes())
    damaged[-30] ^= 1
    first.write_bytes(damaged)
    with pytest.raises(Exception, match="damaged file"):
        got.collect()
    first.unlink()
    with pytest.raises(ValueError, match="its manifest lists"):
        warc.read(spark, folder)


def test_rows_without_an_id_spread_over_shards(spark, tmp_path):
    rows = [(None, None, f"<p>{i} " + "x" * 500) for i in range(80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = warc.write(pages, f"file://{tmp_path}/n", shard_bytes=4_000, roll_bytes=10_000).collect()
    assert len({f["shard"] for f in files}) > 8 and sum(f["records"] for f in files) == 80
    assert warc.read(spark, f"file://{tmp_path}/n").select("payload").distinct().count() == 80


def test_warc_empty(spark, tmp_path):
    assert warc.round_trip(pages_of(spark).limit(0), f"file://{tmp_path}/e").count() == 0


# -- shared ------------------------------------------------------------------------------


def test_shared_folder_is_the_sessions(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or shared.LOCAL_DIR
    assert shared.new_path(spark, "x").startswith(named.rstrip("/") + "/tables/" + spark.sparkContext.applicationId + "/x-")
