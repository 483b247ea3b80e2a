"""Shared passages of few short lines in foreign text, against all runs of lines."""

import random

from shoal.llm import passages, queries
from tests.llm.test_operators import frame, none, odd, words_like  # noqa: F401


def plain(texts):
    """Lines to remove of each text, from every run of 50 words or more."""
    first, gone = {}, [set() for _ in texts]
    for i, t in enumerate(texts):
        some = [(n, x) for n, x in enumerate(t.split("\n")) if x.strip()]
        for a in range(len(some)):
            words = 0
            for b in range(a, len(some)):
                words += len(some[b][1].split())
                if words >= 50:
                    run = tuple(x for _, x in some[a : b + 1])
                    was = first.setdefault(run, (i, some[b][0]))
                    if was != (i, some[b][0]):
                        after = was[1] if was[0] == i else -1
                        gone[i].update(range(max(some[a][0], after + 1), some[b][0] + 1))
    return gone


def test_short_passages_go_whole(spark, odd, none):  # noqa: F811
    rng = random.Random(31)
    shared = ["\n".join(words_like(rng, -(-w // n)) for _ in range(n)) for n in (2, 3, 4, 5) for w in (51, 75, 100)]
    texts = []
    for i in range(90):
        own = [words_like(rng, rng.randrange(1, 12)) for _ in range(rng.randrange(2, 8))]
        own.insert(rng.randrange(len(own) + 1), shared[i % len(shared)])
        texts.append("\n".join(own))
    texts += ["\n".join([words_like(random.Random(1), 20)] * 12), shared[0] + "\n\n" + shared[0]]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in passages.without_passages(frame(spark, texts)).collect()}
    for i, (t, gone) in enumerate(zip(texts, plain(texts))):
        every = t.split("\n")
        assert got[i] == ("\n".join(x for n, x in enumerate(every) if n not in gone), len(every), len(gone))
    for p in shared:
        assert all(sum(x in t.split("\n") for t, *_ in got.values()) == 1 for x in p.split("\n"))
    out = passages.without_passages(odd).collect()
    assert len(out) == odd.count() and {r.text for r in out if r.doc_id == 3} == {None}
    assert passages.without_passages(none).count() == 0
    assert "op3_shared_passages" in queries.queries()
