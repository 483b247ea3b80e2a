"""Parents and children: direct-child counts, paths from parent ids, subtrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.tables import written

#: Parents that a path can have; beyond that it counts as a cycle.
MAX_DEPTH = 512
ORPHANS, CYCLES = "$OrphanFiles", "$Cycle"


def child_facts(catalog: DataFrame, counts: bool = True, flags: dict[str, Column] | None = None) -> DataFrame:
    """parent_id with child_count, child_files, child_folders and a flag for each test of the
    children.  One map-side aggregation; a folder of any size is one row a task."""
    children = catalog.filter((F.col("parent_id") != 0) & (F.col("parent_id") != F.col("id")))
    wanted = []
    if counts:
        wanted += [
            F.count(F.lit(1)).alias("child_count"),
            F.count_if(~F.col("directory")).alias("child_files"),
            F.count_if("directory").alias("child_folders"),
        ]
    wanted += [F.bool_or(test).alias(name) for name, test in (flags or {}).items()]
    return children.groupBy("parent_id").agg(*wanted)


def with_child_facts(catalog: DataFrame, counts: bool = True, flags: dict[str, Column] | None = None) -> DataFrame:
    """The catalog with the facts of each row's direct children; null without children."""
    facts = child_facts(catalog, counts, flags).withColumnRenamed("parent_id", "__parent")
    return catalog.join(facts, F.col("id") == F.col("__parent"), "left").drop("__parent")


def _levels(nodes: DataFrame, seeds: DataFrame, step) -> DataFrame:
    """The seeds and, level by level, what ``step`` makes of each child and its parent's row.

    ``nodes`` is a written table.  Each level is written once and only joins the level before it,
    so nothing is derived twice and a level may be lost and read again; the number of levels is that of the
    tree, at most ``MAX_DEPTH``.  No id is reached twice: a node has one parent, and seeds are roots.
    """
    level, found = written(seeds, "level"), []
    for _ in range(MAX_DEPTH):
        if level.isEmpty():
            break
        found.append(level)
        level = written(step(nodes, level), "level")
    else:
        found += [] if level.isEmpty() else [level]
    rows = found[0] if found else level
    return rows.sparkSession.read.schema(rows.schema).parquet(*[t.shoal_path for t in found]) if found else rows


def derive_paths(nodes: DataFrame, root_id: int, root_path: str) -> DataFrame:
    """id, path of every node but the root, from (id, parent_id, name).

    A node whose parent is absent lies under ``$OrphanFiles``, with its descendants below
    it; one in or below a cycle, or deeper than the cap, is put flat under ``$Cycle``.

    Every node points to an ancestor and has the path from there.  A round joins the nodes that have not
    arrived with what they point to, which doubles the stretch, so a tree of depth d takes log2(d) rounds; what
    has arrived is not written again.  What has not after ``MAX_DEPTH`` parents is in or below a cycle.
    """
    plain = nodes.select("id", "parent_id", "name").filter(F.col("id") != root_id)
    kind = F.when(F.col("parent_id") == root_id, "top")
    state = plain.select("id", F.col("parent_id").alias("up"), F.col("name").alias("path"), F.lit(1).alias("steps"), kind.alias("kind"))
    state = written(state, "paths", by="kind")
    arrived, away = state.filter("kind is not null"), state.filter("kind is null")
    tables, rounds = [state], 0
    while rounds < MAX_DEPTH.bit_length() and not away.isEmpty():
        there = arrived.unionByName(away).select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"), F.col("steps").alias("more"), F.col("kind").alias("found"))
        # What has arrived is cut to what is pointed to first; when few are left, that needs no shuffle.
        there = there.join(away.select("up").distinct(), "up", "left_semi")
        met = away.drop("kind").join(there, "up", "left")
        missing = F.col("next").isNull() & F.col("above").isNull()
        moved = met.select(
            "id", F.coalesce("next", "up").alias("up"), F.when(missing, F.col("path")).otherwise(F.concat_ws("\\", "above", "path")).alias("path"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.when(missing, "lost").otherwise(F.col("found")).alias("kind"),
        )
        tables.append(written(moved, "paths", by="kind"))
        away = tables[-1].filter("kind is null")
        arrived = arrived.unionByName(tables[-1].filter("kind is not null"))
        rounds += 1
    deep = F.col("steps") > MAX_DEPTH
    above = F.when(F.col("kind") == "lost", f"{root_path}\\{ORPHANS}\\").otherwise(root_path + "\\")
    out = arrived.filter(~deep).select("id", F.concat(above, "path").alias("path"))
    rest = arrived.filter(deep).select("id").union(away.select("id"))
    return out.union(plain.join(rest, "id", "left_semi").select("id", F.concat(F.lit(f"{root_path}\\{CYCLES}\\"), "name")))


def descendants(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """id, top of every node below the ids of ``changed`` (itself included)."""
    plain = written(nodes.select("id", "parent_id").filter("id <> parent_id"), "nodes")

    def step(nodes: DataFrame, level: DataFrame) -> DataFrame:
        return nodes.join(level.select(F.col("id").alias("above"), "top"), F.col("parent_id") == F.col("above")).select("id", "top")

    seeds = changed.select("id").distinct()
    return _levels(plain, seeds.select("id", F.col("id").alias("top")), step)
