"""Small helpers shared by the corpus operators: durable tables, Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from shoal.ship import ship
from shoal.tables import LOCAL_DIR, discard, drop_tables, new_path, release, shared_dir, written

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
__all__ = ["LOCAL_DIR", "discard", "drop_tables", "new_path", "release", "shared_dir", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_hash(seed: str, *cols: Column) -> Column:
    """60 pseudo-random bits, the same in any engine that has MD5."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 15), 16, 10).cast("long")


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as make it unlike all ``columns``
    in any case, so that a caller's own columns pass through untouched."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def as_given(columns: list[str]) -> list[Column]:
    """The columns by their names, whatever characters they have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def row_key(doc_id: Column, text: Column) -> Column:
    """32 bytes that name a row by its id and whole text; a null text is the empty one."""
    number = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.concat(number, F.lit(":"), F.coalesce(text, F.lit(""))), 256))


def rows_with(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``row_key`` is in the only column of ``keys``; of rows that
    repeat id and text, one.  Columns as given."""
    key, number = free_names(docs.columns, "key", "number")
    rows = docs.withColumn(key, row_key(docs["doc_id"], docs["text"]))
    # The first of equal rows is taken within each task before they move, so repeats of any number are one row a task.
    rows = rows.withColumn(number, F.row_number().over(W.partitionBy(key).orderBy(key))).filter(F.col(number) == 1)
    return rows.join(keys.toDF(key), key, "left_semi").select(*as_given(docs.columns))


#: Rows and bytes of the Arrow batches that executors send to Python, where the session sets no bounds.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def arrow_map(df: DataFrame, fn, schema: str, rows: int = 1000, **kw) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows.  Batches are bounded in rows and bytes, so that a
    few very long texts make no huge batch: by the session's own settings, or by ``BATCH``."""
    ship(df.sparkSession)
    for name, most in BATCH.items():
        if df.sparkSession.conf.get(name, None) is None:
            df.sparkSession.conf.set(name, str(most))

    def run(batches):
        return fn(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))

    return df.mapInArrow(run, schema, **kw)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Whole texts of a batch; null counts as empty."""
    return [t if t is not None else "" for t in batch.column(name).to_pylist()]
