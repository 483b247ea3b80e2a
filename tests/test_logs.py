"""Durable logs, numbered states, checked snapshots, overflow of a watcher, paths of odd trees."""

import random

import pytest
from pyspark.sql import functions as F

from shoal import tables
from shoal.operators import content, hierarchy
from shoal.sources import logs, snapshot
from shoal.streaming.journal import apply_watched

CHANGES = "usn long, file_id long, name string"


def changes(spark, start, end):
    return spark.createDataFrame([(u, u % 7, f"n{u}") for u in range(start, end)], CHANGES)


def test_journal_log(spark, tmp_path):
    log = logs.JournalLog(spark, str(tmp_path / "log"), "D:", 3)
    assert log.replay(5, CHANGES)[1] == 5 and log.replay(5, CHANGES)[0].count() == 0
    for a, b in ((0, 10), (10, 25), (25, 25), (25, 40)):
        assert log.append(changes(spark, a, b), a, b) == (b > a)
    assert not log.append(changes(spark, 10, 25), 10, 25)  # already there
    for a, b in ((50, 60), (30, 60), (60, 50)):
        with pytest.raises(logs.LogError):
            log.append(changes(spark, a, max(a, b)), a, b)
    rows, cursor = log.replay(12, CHANGES)
    assert cursor == 40 and sorted(r.usn for r in rows.collect()) == list(range(12, 40))
    # a torn tail: its folder has no marker, so it counts for nothing and is replaced
    torn = tmp_path / "log" / "D%3A" / "gen=3" / "entry-4-40-99-0"
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"half")
    assert log.replay(12, CHANGES)[1] == 40
    assert log.append(changes(spark, 40, 44), 40, 44) and not torn.exists()
    assert log.replay(40, CHANGES)[0].count() == 4
    # a lost entry is a gap: nothing after it is replayed
    log._status()[0].delete(spark._jvm.org.apache.hadoop.fs.Path(log.entries()[1].path), True)
    assert log.replay(0, CHANGES)[1] == 10 and log.replay(10, CHANGES)[1] == 10
    assert logs.JournalLog(spark, str(tmp_path / "log"), "D:", 4).entries() == []
    log.reset()
    assert log.entries() == []


def catalog(spark, n=20):
    return spark.createDataFrame([(i, f"D:\\f{i}", 0, 0, 32) for i in range(n)], "id long, path string, size long, last_write_time long, attributes int")


def test_hydration_log(spark, tmp_path):
    rows = catalog(spark)
    log = logs.HydrationLog(spark, str(tmp_path / "log"), "D:", 1)

    def read(batch):
        return batch.select("id", (F.col("id") * 10).alias("size"), (F.col("id") + 1).alias("last_write_time"), F.lit(33).alias("attributes"))

    assert logs.hydrate(rows, read, log, batch=6, most=2) == 2 and not log.complete
    assert logs.hydrate(rows, read, log, batch=6) == 2 and log.complete  # goes on where the log ends
    with pytest.raises(logs.LogError):
        log.append(read(rows).withColumn("path_fingerprint", F.lit(0).cast("long")))
    moved = rows.filter("id != 3").withColumn("path", F.when(F.col("id") == 7, "D:\\elsewhere").otherwise(F.col("path")))
    out, counts = log.replay(moved)
    got = {r.id: (r["size"], r.last_write_time, r.attributes) for r in out.collect()}
    assert got == {i: (0, 0, 32) if i == 7 else (i * 10, i + 1, 33) for i in range(20) if i != 3}
    assert tuple(counts.first()) == (18, 2)
    empty = logs.HydrationLog(spark, str(tmp_path / "other"), "D:", 1)
    assert empty.replay(rows)[0].exceptAll(rows).count() == 0 and tuple(empty.replay(rows)[1].first()) == (0, 0)


def test_latest_update_of_a_row_counts(spark, tmp_path):
    rows = catalog(spark, 2)
    log = logs.HydrationLog(spark, str(tmp_path), "v", 1)
    for size in (5, 9):
        log.append(rows.filter("id = 1").select("id", logs.path_fingerprint().alias("path_fingerprint"), F.lit(size).cast("long").alias("size"), F.lit(1).cast("long").alias("last_write_time"), "attributes"))
    assert {r.id: r["size"] for r in log.replay(rows)[0].collect()} == {0: 0, 1: 9}


def test_states_are_never_replaced(spark, tmp_path):
    folder = str(tmp_path / "state")
    assert snapshot.load_state(spark, folder) is None
    for i in range(8):
        snapshot.save_state(spark, folder, {"n": i}, keep=3)
        assert snapshot.load_state(spark, folder) == {"n": i}
    names = sorted(p.name for p in (tmp_path / "state").glob("state-*.json"))
    assert len(names) == 4
    (tmp_path / "state" / "state-000000000099.json.tmp").write_text("{half")
    assert snapshot.load_state(spark, folder) == {"n": 7}


def test_snapshot_is_verified(spark, tmp_path):
    folder = str(tmp_path / "s")
    snapshot.write_snapshot(catalog(spark), folder)
    assert snapshot.read_snapshot(spark, folder, verify=True).count() == 20
    catalog(spark, 1).write.mode("append").parquet(f"{folder}/gen=1")
    with pytest.raises(ValueError, match="damaged"):
        snapshot.read_snapshot(spark, folder, verify=True)
    snapshot.write_snapshot(catalog(spark).union(catalog(spark, 1)), folder)
    with pytest.raises(ValueError, match="damaged"):  # ids must not repeat
        snapshot.read_snapshot(spark, folder, verify=True)


def test_overflow_scans_again(spark):
    texts = lambda *paths: spark.createDataFrame([(p, f"word {p}") for p in paths], "path string, text string")
    index = content.ContentIndex.build(texts("a", "b", "x"))
    none = spark.createDataFrame([], "seq long, action string, path string")
    after = apply_watched(index, none, texts("b", "c"), overflowed=True, within=F.col("doc") < "x")
    assert sorted(r.doc for r in after.documents.collect()) == ["b", "c", "x"]
    assert sorted(r.doc for r in after.matches("word").collect()) == ["b", "c", "x"]


def test_index_is_saved_over_itself(spark, tmp_path):
    folder = str(tmp_path / "i")
    docs = spark.createDataFrame([("a", "red"), ("b", "red blue")], "path string, text string")
    content.ContentIndex.build(docs).save(folder)
    index = content.ContentIndex.load(spark, folder)
    index.upsert(docs.filter("path = 'a'").withColumn("text", F.lit("green"))).save(folder)
    assert [r.doc for r in content.ContentIndex.load(spark, folder).matches("red").collect()] == ["b"]
    assert index.totals.first()["n"] == 2


def plain_paths(nodes, root):
    parent = {i: (p, n) for i, p, n in nodes if i != root}
    out = {}
    for i in parent:
        names, at, seen = [], i, set()
        while at in parent and at not in seen and len(names) <= hierarchy.MAX_DEPTH:
            seen.add(at)
            names.append(parent[at][1])
            at = parent[at][0]
        if at == root:
            out[i] = "R\\" + "\\".join(reversed(names))
        elif at in seen or at in parent:
            out[i] = "R\\$Cycle\\" + parent[i][1]
        else:
            out[i] = "R\\$OrphanFiles\\" + "\\".join(reversed(names))
    return out


def test_paths_of_random_forests(spark):
    rng = random.Random(1)
    for _ in range(3):
        nodes = [(i, rng.choice([1, rng.randrange(2, 60), rng.randrange(2, 60), 999]), f"n{i}") for i in range(2, 60)]
        df = spark.createDataFrame(nodes, "id long, parent_id long, name string")
        got = {r.id: r.path for r in hierarchy.derive_paths(df, 1, "R").collect()}
        assert got == plain_paths(nodes, 1)
    none = df.limit(0)
    assert hierarchy.derive_paths(none, 1, "R").count() == 0 and hierarchy.descendants(none, none).count() == 0


def test_tables_of_a_session(spark):
    t = tables.written(spark.range(3), "x")
    assert t.shoal_path.startswith(tables.session_dir(spark)) and t.count() == 3
    tables.discard(t)
    with pytest.raises(Exception):
        spark.read.parquet(t.shoal_path).count()
