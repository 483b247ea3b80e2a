"""Top-k of every shard, then the merge."""

from shoal.operators import content


def test_every_shard_gives_its_best(spark):
    rows = [(f"a{i:02}", "word " * 3, "hot") for i in range(30)] + [(f"b{i}", "word other " * 2 + "more " * 9 * i, f"s{i % 4}") for i in range(8)] + [("c", "none", "s9")]
    index = content.ContentIndex.build(spark.createDataFrame(rows, "path string, text string, root string"), shard="root")
    got = index.search_shards("word", 2, 100).collect()
    assert sorted((r.shard, r.doc) for r in got) == [("hot", "a00"), ("hot", "a01")] + sorted((f"s{i % 4}", f"b{i}") for i in range(8))
    assert [r.weight for r in got] == sorted((r.weight for r in got), reverse=True)
    assert got[0].relevance_percent == 100
    assert [r.doc for r in index.search_shards("word", 2, 3).collect()] == [r.doc for r in got[:3]]
    assert index.search_shards("word", 0).count() == 0
    assert {r.shard for r in index.search("word", 5).collect()} == {"hot"}
