"""A catalog of the entries below local folders."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.model import CATALOG, DIRECTORY, FILETIME_EPOCH, RECORD
from shoal.ship import ship
from shoal.tables import written


#: Levels below the roots that are listed one by one, each folder in a task of its own choosing; the
#: folders below are then walked whole, many tasks at a time.
LEVELS = 2


def _entries(root: str, errors: list[str], deep: bool = True) -> Iterator[tuple]:
    pending = [root]
    while pending:
        folder = pending.pop()
        try:
            listed = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            errors.append(str(e))
            continue
        for entry in listed:
            try:
                info = entry.stat(follow_symlinks=False)
            except OSError as e:
                errors.append(str(e))
                continue
            is_dir, link = entry.is_dir(follow_symlinks=True), stat.S_ISLNK(info.st_mode)
            ticks = lambda ns: FILETIME_EPOCH + ns // 100
            attributes = (DIRECTORY if is_dir else 0x20) | (0x400 if link else 0) | (0x2 if entry.name.startswith(".") else 0)
            yield entry.path, folder, entry.name, is_dir, 0 if is_dir else info.st_size, ticks(info.st_mtime_ns), ticks(info.st_ctime_ns), ticks(info.st_atime_ns), attributes
            if deep and is_dir and not link:
                pending.append(entry.path)


def scan(spark: SparkSession, roots: list[str]):
    """(catalog, accumulator of the entries that could not be read).  The roots are not entries; links
    to folders are entries that are not entered.  A large root is the work of many tasks, see ``LEVELS``."""
    ship(spark)
    errors = spark.sparkContext.accumulator(0)
    schema = "path string, folder string, name string, directory boolean, size long, last_write_time long, creation_time long, last_access_time long, attributes int"

    def walk(deep: bool):
        def run(frames):
            import pandas as pd

            for f in frames:
                for root in f["root"]:
                    failed: list[str] = []
                    rows = list(_entries(root, failed, deep))
                    errors.add(len(failed))
                    if rows:
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

        return run

    folders, parts, tasks = spark.createDataFrame([(r,) for r in roots], "root string"), [], 4 * spark.sparkContext.defaultParallelism
    for _ in range(LEVELS):
        parts.append(written(folders.repartition(tasks, "root").mapInPandas(walk(False), schema), "scan"))
        folders = parts[-1].filter(F.col("directory") & (F.col("attributes").bitwiseAND(0x400) == 0)).select(F.col("path").alias("root"))
    rows = reduce(DataFrame.union, [*parts, folders.repartition(tasks, "root").mapInPandas(walk(True), schema)])
    rows = rows.withColumns({"id": F.xxhash64(F.lower("path")), "parent_id": F.xxhash64(F.lower("folder")), "volume": F.lit(""), "change_time": F.col("last_write_time")})
    return rows.select(*RECORD), errors


def build_volumes(spark: SparkSession, volumes: dict[str, str], load) -> tuple[DataFrame, dict[str, str]]:
    """(union of the volumes that load, why others did not).  ``load(root)`` gives a catalog."""
    from shoal.operators.incremental import union_volumes

    good, failed = {}, {}
    for name, root in volumes.items():
        try:
            good[name] = load(root)
        except Exception as e:  # a volume that fails is left out and told
            failed[name] = str(e)
    if not good:
        return spark.createDataFrame([], CATALOG), failed
    return union_volumes(good), failed
