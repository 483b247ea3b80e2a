"""Keeping a catalog up to date: deltas, journals, metadata, compaction.

A catalog is a base and the changes since.  Reading merges them; compaction writes the
merged view as a new generation.  What a journal amounts to is a map-side aggregation by file;
what each of its changes did needs their order, which is taken within stretches of the
journal and then over the stretches, so that a file with a third of all changes is no one's task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from shoal.model import CREATE, DELETE, DIRECTORY, RENAME_NEW, RENAME_OLD
from shoal.operators.hierarchy import descendants

#: Changes after which a base is rewritten.
COMPACT_AFTER = 100_000
#: Changes whose numbers agree but for so many bits are one stretch of a journal.
STRETCH_BITS = 12


def last_by_id(rows: DataFrame, order: str, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Of rows with equal keys, the one with the greatest ``order``; map-side first."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("__best"))
    return best.select("__best.*")


def apply_delta(base: DataFrame, upserts: DataFrame, removed: DataFrame) -> DataFrame:
    """The live view: removals first, then upserts, so an id in both is live.  ``removed``
    has column id; of several upserts of an id any one must do (see ``last_by_id``)."""
    touched = upserts.select("id").union(removed.select("id")).distinct()
    return base.join(touched, "id", "left_anti").unionByName(upserts.select(*base.columns))


def live_view(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Base merged with (seq, op, record) changes; op is 'upsert' or 'remove', latest wins."""
    latest = last_by_id(changes, "seq")
    kept = latest.filter("op = 'upsert'").select(*base.columns)
    return base.join(latest.select("id"), "id", "left_anti").unionByName(kept)


def should_compact(pending: int, threshold: int = COMPACT_AFTER) -> bool:
    return threshold > 0 and pending >= threshold


def union_volumes(volumes: dict[str, DataFrame]) -> DataFrame:
    """Catalogs of several volumes in one; ``volume`` names where a row is from."""
    parts = [df.withColumn("volume", F.lit(name)) for name, df in sorted(volumes.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def global_id(volume: Column, file_id: Column) -> Column:
    """One id for a file of a volume, never 0."""
    h = F.xxhash64(F.upper(volume), file_id)
    return F.when(h == 0, F.lit(1).cast("long")).otherwise(h)


# -- journals ----------------------------------------------------------------------------


def _has(bits: int) -> Column:
    return F.col("reason").bitwiseAND(bits) != 0


def with_kind(changes: DataFrame) -> DataFrame:
    """kind of each change, and sets: 1 if the file lives after it, 0 if not, null if it says nothing."""
    kind = F.when(_has(RENAME_OLD), "old").when(_has(DELETE), "delete").when(_has(CREATE) | _has(RENAME_NEW), "name").otherwise("touch")
    return changes.withColumn("kind", kind).withColumn("sets", F.when(F.col("kind") == "delete", 0).when(F.col("kind") == "name", 1))


def classify(base: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Each change with its outcome: created, updated, renamed, deleted, ignored or remembered.

    A change's kind is, by its bits in this order: old name of a rename, deletion, or something
    that sets the name (creation, new name); anything else touches the file.  Whether the
    file lives before a change follows from the last deletion or naming before it, else
    from the base.
    """
    known = base.select(F.col("id").alias("file_id"), *[k for k in keys if k != "file_id"]).withColumn("in_base", F.lit(1))
    rows = with_kind(changes).withColumn("stretch", F.shiftright("usn", STRETCH_BITS))
    last = rows.groupBy(*keys, "stretch").agg(F.max_by("sets", F.when(F.col("sets").isNotNull(), F.col("usn"))).alias("end"))
    last = last.join(known, list(keys), "left")
    earlier = W.partitionBy(*keys).orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    last = last.withColumn("start", F.coalesce(F.last("end", ignorenulls=True).over(earlier), F.col("in_base"), F.lit(0)))
    before = W.partitionBy(*keys, "stretch").orderBy("usn").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.last("sets", ignorenulls=True).over(before))
    rows = rows.join(last.select(*keys, "stretch", "start"), [*keys, "stretch"])
    rows = rows.withColumn("lived", F.coalesce("within", "start"))
    outcome = (
        F.when(F.col("kind") == "old", "remembered")
        .when((F.col("kind") == "delete") & (F.col("lived") == 1), "deleted")
        .when((F.col("kind") == "name") & (F.col("lived") == 0), "created")
        .when(F.col("lived") == 0, "ignored")
        .when(_has(RENAME_NEW) & (F.col("kind") == "name"), "renamed")
        .otherwise("updated")
    )
    return rows.withColumn("outcome", outcome).drop("stretch", "within", "start")


def unmatched_renames(classified: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Files whose last old name was followed by nothing that takes it: no deletion, no new name
    of a live file, no creation of a missing one."""
    takes = (F.col("kind") == "delete") | ((F.col("kind") == "name") & ((F.col("lived") == 1) & _has(RENAME_NEW) | (F.col("lived") == 0) & ~_has(RENAME_NEW)))
    last = classified.groupBy(*keys).agg(F.max(F.when(F.col("kind") == "old", F.col("usn"))).alias("old"), F.max(F.when(takes, F.col("usn"))).alias("taken"))
    return last.filter("old is not null and (taken is null or taken < old)").select(*keys)


def change_counts(base: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: created, updated, renamed, deleted, ignored."""
    rows = classify(base, changes)
    lost = unmatched_renames(rows).agg(F.count(F.lit(1)).alias("lost"))
    names = ("created", "updated", "renamed", "deleted", "ignored")
    # First by file: a hot file's changes are one row a task.
    counts = rows.agg(*[F.count_if(F.col("outcome") == n).alias(n) for n in names])
    counts = counts.withColumn("one", F.lit(1)).join(lost.withColumn("one", F.lit(1)), "one")  # one row each
    return counts.select(*names[:-1], (F.col("ignored") + F.col("lost")).alias("ignored"))


def fold_changes(base: DataFrame, changes: DataFrame, reset_metadata: bool = True) -> tuple[DataFrame, DataFrame]:
    """(upserts, removed) that a batch of journal changes amounts to.

    A file's name and parent are those of its last naming, its attributes those of the last
    change that counted.  Sizes and times of changed files are unknown (0) unless
    ``reset_metadata`` is off; those of a file created anew always are.
    """
    # With the last word on a file, all changes since count: the last naming, or the base.
    def when(kind: str) -> Column:
        return F.when(F.col("kind") == kind, F.col("usn"))

    rows = with_kind(changes)
    state = rows.groupBy(F.col("file_id").alias("id")).agg(
        F.max_by("sets", F.when(F.col("sets").isNotNull(), F.col("usn"))).alias("lives"),
        F.max_by("name", when("name")).alias("new_name"),
        F.max_by("parent_id", when("name")).alias("new_parent"),
        F.max_by("attributes", F.when(F.col("kind") != "old", F.col("usn"))).alias("new_attributes"),
        F.max(when("delete")).alias("gone"),
        F.count_if(F.col("kind") != "old").alias("counted"),
    )
    state = state.join(base.select("id", F.lit(1).alias("in_base")), "id", "left").filter("lives is not null or (in_base = 1 and counted > 0)")
    anew = F.col("in_base").isNull() | F.col("gone").isNotNull()
    state = state.withColumn("anew", F.when(anew, 1)).drop("in_base", "gone", "counted")
    removed = state.filter("lives = 0").select("id")
    live = state.filter("coalesce(lives, 1) = 1").join(base, "id", "left")
    unknown = F.lit(reset_metadata) | F.col("anew").isNotNull()
    out = {}
    for c, kind in base.dtypes:
        if c in ("id", "volume", "path"):
            out[c] = F.col(c)
        elif c == "name":
            out[c] = F.coalesce("new_name", "name")
        elif c == "parent_id":
            out[c] = F.coalesce("new_parent", "parent_id")
        elif c == "attributes":
            out[c] = F.coalesce("new_attributes", "attributes")
        elif c == "directory":
            out[c] = F.coalesce("new_attributes", "attributes").bitwiseAND(DIRECTORY) != 0
        else:
            out[c] = F.when(unknown, F.lit(0).cast(kind)).otherwise(F.col(c))
    return live.select(*[v.alias(k) for k, v in out.items()]), removed


def apply_changes(base: DataFrame, changes: DataFrame, reset_metadata: bool = True) -> DataFrame:
    """The live rows after a batch of journal changes."""
    upserts, removed = fold_changes(base, changes, reset_metadata)
    return apply_delta(base, upserts, removed)


def repathed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids whose path may differ after a batch: rows that are new or have another name or parent,
    and all that lies below them or below a removed directory."""
    old = before.select("id", F.col("name").alias("old_name"), F.col("parent_id").alias("old_parent"))
    moved = after.join(old, "id", "left").filter("old_name is null or old_name != name or old_parent != parent_id").select("id")
    gone = before.filter("directory").join(after.select("id"), "id", "left_anti").select("id")
    return descendants(after, moved.union(gone)).join(after.select("id"), "id", "left_semi").select("id").distinct()


# -- metadata ----------------------------------------------------------------------------

METADATA = ("size", "last_write_time", "attributes")


def reuse_metadata(new: DataFrame, old: DataFrame) -> DataFrame:
    """A rebuilt catalog with sizes, times and attributes of the old one where id and path are
    the same and the old row knows them; ``state`` tells reused, unknown or stale."""
    known = old.select("id", F.col("path").alias("old_path"), *[F.col(c).alias("old_" + c) for c in METADATA])
    rows = new.join(known, "id", "left")
    same = F.col("old_path") == F.col("path")
    state = F.when(same & (F.col("old_last_write_time") != 0), "reused").when(F.col("old_path").isNotNull() & ~same, "stale").otherwise("unknown")
    rows = rows.withColumn("state", state)
    take = F.col("state") == "reused"
    return rows.select(*[F.when(take, F.col("old_" + c)).otherwise(F.col(c)).alias(c) if c in METADATA else F.col(c) for c in new.columns], "state")


def apply_metadata(catalog: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog with late metadata applied, one row with applied and stale counts).  An
    update counts only if its path is still the row's."""
    own = updates.select("id", F.col("path").alias("new_path"), *[F.col(c).alias("new_" + c) for c in METADATA])
    fits = F.col("new_path") == F.col("path")
    rows = catalog.join(own, "id", "left")
    out = rows.select(*[F.when(fits, F.col("new_" + c)).otherwise(F.col(c)).alias(c) if c in METADATA else F.col(c) for c in catalog.columns])
    met = own.join(catalog.select("id", "path"), "id", "left")
    counts = met.agg(F.count_if(fits).alias("applied"), F.count_if(~F.coalesce(fits, F.lit(False))).alias("stale"))
    return out, counts


def hydration_batch(catalog: DataFrame, after_id: int, limit: int) -> DataFrame:
    """The next rows, by id, whose metadata is unknown."""
    rows = catalog.filter((F.col("id") > after_id) & (F.col("last_write_time") == 0))
    return rows.select("id", "path").orderBy("id").limit(limit)


def enrich_page(page: DataFrame, updates: DataFrame) -> DataFrame:
    """A page of results with metadata read later, matched by id and path."""
    return apply_metadata(page, updates)[0]


def storage_stats(catalog: DataFrame) -> DataFrame:
    """One row: records, directories, files, characters of names and paths, bytes of files,
    rows without metadata."""
    return catalog.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if("directory").alias("directories"),
        F.count_if(~F.col("directory")).alias("files"),
        F.coalesce(F.sum(F.length("name")), F.lit(0)).alias("name_chars"),
        F.coalesce(F.sum(F.length("path")), F.lit(0)).alias("path_chars"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.count_if(F.col("last_write_time") == 0).alias("unknown"),
    )
