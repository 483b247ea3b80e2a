"""Hierarchy, deltas, journals, metadata, snapshots, streaming."""

import random

import pytest
from pyspark.sql import functions as F

from shoal import model as M
from shoal.operators import hierarchy, incremental
from shoal.sources import snapshot
from shoal.streaming.journal import JournalFollower, apply_watched, bursts

NODE = "id long, parent_id long, name string, directory boolean, size long, last_write_time long, attributes int"


def nodes(spark, rows):
    return spark.createDataFrame([(i, p, n, d, 10, 5, 16 if d else 32) for i, p, n, d in rows], NODE)


def changes(spark, rows):
    """rows: (file_id, parent_id, reason, name) in order."""
    return spark.createDataFrame([(u, f, p, r, 16 if n == "New" else 32, n) for u, (f, p, r, n) in enumerate(rows, 1)], M.CHANGE)


# -- hierarchy ---------------------------------------------------------------------------


def test_paths_orphans_and_cycles(spark):
    rows = [(2, 1, "a", True), (3, 2, "b", False), (5, 99, "lost", True), (6, 5, "below", False), (7, 8, "x", True), (8, 7, "y", True), (9, 8, "z", False)]
    got = {r.id: r.path for r in hierarchy.derive_paths(nodes(spark, rows), 1, "D:").collect()}
    assert got == {2: "D:\\a", 3: "D:\\a\\b", 5: "D:\\$OrphanFiles\\lost", 6: "D:\\$OrphanFiles\\lost\\below", 7: "D:\\$Cycle\\x", 8: "D:\\$Cycle\\y", 9: "D:\\$Cycle\\z"}
    assert hierarchy.derive_paths(nodes(spark, []), 1, "D:").count() == 0


def test_descendants(spark):
    tree = nodes(spark, [(2, 1, "a", True), (3, 2, "b", True), (4, 3, "c", False), (5, 1, "d", False)])
    got = {tuple(r) for r in hierarchy.descendants(tree, tree.filter("id = 2")).collect()}
    assert got == {(2, 2), (3, 2), (4, 2)}


# -- deltas ------------------------------------------------------------------------------


def test_delta_removals_first(spark):
    base = nodes(spark, [(1, 0, "alpha.txt", False), (2, 0, "beta.txt", False)])
    new = nodes(spark, [(2, 0, "gamma.txt", False), (3, 0, "delta.md", False), (1, 0, "again", False)])
    gone = spark.createDataFrame([(1,), (7,)], "id long")
    assert {r.id: r.name for r in incremental.apply_delta(base, new.filter("id > 1"), gone).collect()} == {2: "gamma.txt", 3: "delta.md"}
    assert {r.id: r.name for r in incremental.apply_delta(base, new, gone).collect()} == {1: "again", 2: "gamma.txt", 3: "delta.md"}


def test_last_record_of_an_id_wins(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id long, name string, seq int")
    assert {r.name for r in incremental.last_by_id(df, "seq").collect()} == {"b", "c"}


def test_compaction_threshold():
    assert incremental.should_compact(100_000) and not incremental.should_compact(99_999) and not incremental.should_compact(5, 0)


# -- journals ----------------------------------------------------------------------------

BASE = [(2, 1, "Old", True), (3, 2, "old.txt", False)]
JOURNAL = [(2, 1, M.RENAME_OLD, "Old"), (2, 1, M.RENAME_NEW, "New"), (4, 2, M.CREATE, "beta.txt"), (4, 2, M.CLOSE, "beta.txt"), (3, 2, M.DELETE, "old.txt")]


def test_journal_example(spark):
    base, log = nodes(spark, BASE), changes(spark, JOURNAL)
    row = incremental.change_counts(base, log).first()
    assert (row.created, row.renamed, row.deleted, row.updated, row.ignored) == (1, 1, 1, 1, 0)
    after = incremental.apply_changes(base, log)
    got = {r.id: (r.name, r.size, r.last_write_time) for r in after.collect()}
    assert got == {2: ("New", 0, 0), 4: ("beta.txt", 0, 0)}
    paths = {r.id: r.path for r in hierarchy.derive_paths(after, 1, "D:").collect()}
    assert paths[4] == "D:\\New\\beta.txt"
    again = incremental.apply_changes(after, changes(spark, JOURNAL[2:4]))
    assert again.count() == 2
    assert {r.id for r in incremental.repathed(base, after).collect()} == {2, 4}
    kept = incremental.apply_changes(base, log, reset_metadata=False)
    assert {r.id: r.size for r in kept.collect()} == {2: 10, 4: 0}


def fold(base, log):
    """The journal taken one change at a time."""
    live, old = {i: [p, n, 32] for i, p, n, _ in base}, set()
    counts = dict.fromkeys(("created", "updated", "renamed", "deleted", "ignored"), 0)
    for f, p, r, n in log:
        if r & M.RENAME_OLD:
            old.add(f)
        elif r & M.DELETE:
            old.discard(f)
            counts["deleted" if live.pop(f, None) else "ignored"] += 1
        elif f not in live:
            if r & (M.CREATE | M.RENAME_NEW):
                live[f] = [p, n, 32]
                counts["created"] += 1
                if not r & M.RENAME_NEW:
                    old.discard(f)
            else:
                counts["ignored"] += 1
        elif r & M.RENAME_NEW:
            live[f] = [p, n, 32]
            old.discard(f)
            counts["renamed"] += 1
        else:
            if r & M.CREATE:
                live[f][:2] = [p, n]
            counts["updated"] += 1
    counts["ignored"] += len(old)
    return {f: tuple(v[:2]) for f, v in live.items()}, counts


@pytest.mark.parametrize("seed", range(6))
def test_journal_against_a_fold(spark, seed):
    rng = random.Random(seed)
    bits = [M.CREATE, M.DELETE, M.RENAME_OLD, M.RENAME_NEW, M.BASIC_INFO, M.DATA_EXTEND]
    base = [(i, 1, f"b{i}", False) for i in range(1, 7) if rng.random() < 0.5]
    log = [(rng.randrange(1, 7), rng.randrange(5), sum(set(rng.choices(bits, k=rng.choice([1, 1, 2])))), f"n{k}") for k in range(60)]
    live, counts = fold(base, log)
    got = incremental.apply_changes(nodes(spark, base), changes(spark, log))
    assert {r.id: (r.parent_id, r.name) for r in got.collect()} == live
    assert incremental.change_counts(nodes(spark, base), changes(spark, log)).first().asDict() == counts


# -- metadata ----------------------------------------------------------------------------


def test_metadata(spark):
    schema = "id long, path string, size long, last_write_time long, attributes int"
    old = spark.createDataFrame([(1, "a", 5, 7, 32), (2, "b", 5, 0, 32), (3, "c", 5, 7, 32)], schema)
    new = spark.createDataFrame([(1, "a", 0, 0, 0), (2, "b", 0, 0, 0), (3, "moved", 0, 0, 0), (4, "d", 0, 0, 0)], schema)
    got = {r.id: (r.state, r.size) for r in incremental.reuse_metadata(new, old).collect()}
    assert got == {1: ("reused", 5), 2: ("unknown", 0), 3: ("stale", 0), 4: ("unknown", 0)}
    late = spark.createDataFrame([(1, "a", 9, 9, 1), (3, "c", 9, 9, 1), (8, "z", 9, 9, 1)], schema)
    out, counts = incremental.apply_metadata(new, late)
    assert {r.id: r.size for r in out.collect()} == {1: 9, 2: 0, 3: 0, 4: 0} and tuple(counts.first()) == (1, 2)
    assert [r.id for r in incremental.hydration_batch(new, 1, 2).collect()] == [2, 3]
    assert incremental.enrich_page(new.limit(4), late).filter("size = 9").count() == 1


# -- snapshots and small files -----------------------------------------------------------


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "s")
    assert snapshot.generations(spark, folder) == []
    rows = nodes(spark, BASE)
    assert [snapshot.write_snapshot(rows, folder), snapshot.write_snapshot(rows.limit(1), folder), snapshot.write_snapshot(rows, folder)] == [1, 2, 3]
    (tmp_path / "s" / "gen=3" / "_SUCCESS").unlink()  # as if the writer had died
    assert snapshot.read_snapshot(spark, folder).count() == 1
    assert snapshot.read_snapshot(spark, folder, 1).count() == 2
    snapshot.write_snapshot(rows, folder)
    snapshot.drop_generations(spark, folder, 1)
    assert snapshot.generations(spark, folder) == [3]


def test_checkpoints(spark, tmp_path):
    c, j = snapshot.Checkpoint(7, 50), snapshot.JournalState
    assert snapshot.validate(c, j(7, 10, 90)) == "valid"
    assert snapshot.validate(c, j(8, 10, 90)) == "journal_changed"
    assert snapshot.validate(c, j(7, 51, 90)) == "expired" and snapshot.validate(c, j(7, 10, 90, 60)) == "expired"
    assert snapshot.validate(c, j(7, 10, 49)) == "ahead_of_journal"
    path = str(tmp_path / "state.json")
    assert snapshot.load_json(spark, path) is None
    snapshot.save_json(spark, path, {"a": 1})
    snapshot.save_json(spark, path, {"a": 2})
    assert snapshot.load_json(spark, path) == {"a": 2}


def test_saved_searches():
    s = [snapshot.SavedSearch("my\tname%", "a\nb \"c\" 报告", True, False, True, True, False), snapshot.SavedSearch("x", "")]
    assert snapshot.load_searches(snapshot.dump_searches(s)) == s
    assert snapshot.load_searches("bad line\nx\ty\tz\n") == []
    assert snapshot.remember(["a", "b"], "b") == ["b", "a"] and len(snapshot.remember([str(i) for i in range(100)], "n")) == 100


# -- streaming ---------------------------------------------------------------------------


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(21)
    bits = [M.CREATE, M.DELETE, M.RENAME_OLD, M.RENAME_NEW, M.BASIC_INFO]
    base = [(i, 1, f"b{i}", False) for i in range(1, 9, 2)]
    log = [(rng.randrange(1, 9), rng.randrange(5), rng.choice(bits), f"n{k}") for k in range(40)]
    source = tmp_path / "in"
    all_changes = changes(spark, log)
    follower = JournalFollower(spark, str(tmp_path / "live"), compact_after=6)
    follower.bootstrap(nodes(spark, base))
    for part in range(4):
        all_changes.filter((F.col("usn") > part * 10) & (F.col("usn") <= part * 10 + 10)).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(M.CHANGE).parquet(str(source))
        follower.follow(stream).awaitTermination()
    want, _ = fold(base, log)
    assert {r.id: (r.parent_id, r.name) for r in follower.live().collect()} == want
    assert len(follower.generations()) > 1
    last = follower.state()["first_batch"]
    follower.apply(all_changes.limit(5), last - 1)  # a batch that is already in the base does nothing
    assert {r.id: (r.parent_id, r.name) for r in follower.live().collect()} == want


def test_a_batch_may_run_twice(spark, tmp_path):
    follower = JournalFollower(spark, str(tmp_path / "twice"))
    follower.bootstrap(nodes(spark, BASE))
    for _ in range(2):
        follower.apply(changes(spark, JOURNAL), 0)
    assert {r.id for r in follower.live().collect()} == {2, 4}


def test_bursts(spark, tmp_path):
    rows = [("2024-01-01 00:00:00.000", "r"), ("2024-01-01 00:00:00.100", "r"), ("2024-01-01 00:00:00.500", "r"), ("2024-01-01 00:00:00.050", "q")]
    df = spark.createDataFrame(rows, "ts string, root string").select(F.to_timestamp("ts").alias("ts"), "root", F.lit("modified").alias("action"), F.lit("p").alias("path"))
    assert sorted((r.root, r.changes) for r in bursts(df).collect()) == [("q", 1), ("r", 1), ("r", 2)]
    df.write.parquet(str(tmp_path / "w"))
    stream = bursts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "w")), late="0 seconds")
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("bursts").count() >= 1


def test_watched_content(spark):
    from shoal.operators.content import ContentIndex

    index = ContentIndex.build(spark.createDataFrame([("a", "red fox"), ("b", "red hen")], "path string, text string"))
    log = spark.createDataFrame([(1, "removed", "a"), (2, "added", "c"), (3, "modified", "b"), (4, "added", "d"), (5, "removed", "d")], "seq int, action string, path string")
    texts = spark.createDataFrame([("c", "red cat"), ("b", "blue hen"), ("d", "red dog")], "path string, text string")
    after = apply_watched(index, log, texts)
    assert {r.doc for r in after.matches("red").collect()} == {"c"} and after.documents.count() == 2


def test_when_to_rebuild_and_consolidate():
    c, j = snapshot.Checkpoint(7, 50), snapshot.JournalState(7, 10, 90)
    assert snapshot.rebuild_reason(c, j) is None and snapshot.rebuild_reason(None, j) == "no_checkpoint"
    assert snapshot.rebuild_reason(c, None) == "journal_unreadable" and snapshot.rebuild_reason(c, j, {"D"}, {"D", "E"}) == "volumes_changed"
    assert snapshot.rebuild_reason(c, snapshot.JournalState(8, 10, 90)) == "journal_changed"
    assert snapshot.should_consolidate(64 << 20, 0, 0) and not snapshot.should_consolidate(5, 10**6, 10**6)
    assert snapshot.should_consolidate(0, 1, 300, 2) and not snapshot.should_consolidate(0, 0, 900, 2)


def test_replay_stops_at_a_gap(spark):
    log = spark.createDataFrame([("D", 0, 10), ("D", 10, 20), ("D", 20, 30), ("D", 31, 40), ("D", 40, 50), ("E", 5, 9)], "volume string, usn_start long, usn_end long")
    cursor = spark.createDataFrame([("D", 10), ("E", 6)], "volume string, next_usn long")
    assert sorted((r.volume, r.usn_start) for r in snapshot.replayable(log, cursor).collect()) == [("D", 10), ("D", 20)]
