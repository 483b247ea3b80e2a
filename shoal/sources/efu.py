"""File lists: CSV with the columns below, and plain exports of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shoal.model import DIRECTORY, RECORD

#: Columns of a file list and the catalog's names for them (fixed values).
COLUMNS = {
    "Filename": "path",
    "Size": "size",
    "Date Modified": "last_write_time",
    "Date Created": "creation_time",
    "Date Accessed": "last_access_time",
    "Date Changed": "change_time",
    "Attributes": "attributes",
}
BOM = "﻿"


def _number(value: Column, kind: str) -> Column:
    """The digits that a field begins with; 0 without any."""
    digits = F.regexp_extract(value, r"^([0-9]+)", 1)
    return F.coalesce(F.when(F.length(digits) <= 18, digits.try_cast(kind)), F.lit(0).cast(kind))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The catalog of a file list.  Rows with an empty path are left out but count
    when ids are given, by place in the file."""
    lines = spark.read.text(path)
    first = lines.first()
    if first is None:
        raise ValueError("empty file list")
    header = [h.strip().strip('"').lower() for h in first[0].removeprefix(BOM).rstrip("\r").split(",")]
    if "filename" not in header:
        raise ValueError("a file list needs a Filename column")
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(header))])
    csv = spark.read.csv(path, schema=schema, quote='"', escape='"', header=True, enforceSchema=True, ignoreLeadingWhiteSpace=False)
    # One file is read by one task at a time in order, so places follow partitions.
    csv = csv.withColumn("__part", F.monotonically_increasing_id())
    at = {name: header.index(name.lower()) for name in COLUMNS if name.lower() in header}
    value = lambda name: F.coalesce(F.col(f"c{at[name]}"), F.lit("")) if name in at else F.lit("")
    part = F.shiftright("__part", 33)
    sizes = csv.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rows = csv.withColumn("p", part).join(starts, "p")
    file = F.replace(value("Filename"), F.lit("/"), F.lit("\\"))
    attributes = _number(value("Attributes"), "int")
    out = rows.select(
        (F.col("start") + F.col("__part").bitwiseAND((1 << 33) - 1) + 1).alias("id"),
        F.lit(0).cast("long").alias("parent_id"),
        F.lit("").alias("volume"),
        F.regexp_extract(file, r"([^\\]*)\\?$", 1).alias("name"),
        file.alias("path"),
        (attributes.bitwiseAND(DIRECTORY) != 0).alias("directory"),
        *[_number(value(c), "long").alias(COLUMNS[c]) for c in ("Size", "Date Modified", "Date Created", "Date Accessed", "Date Changed")],
        attributes.alias("attributes"),
    )
    return out.filter("path != ''").select(*RECORD)


def quoted(value: Column, always: bool = False) -> Column:
    """A CSV field, in quotes if it must be."""
    marked = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return marked if always else F.when(value.rlike(r'[",\r\n]'), marked).otherwise(value)


def lines(rows: DataFrame) -> DataFrame:
    """value: the lines of a file list, header first (its mark in front)."""
    text = F.concat_ws(",", quoted(F.col("path")), *[F.col(c).cast("string") for c in list(COLUMNS.values())[1:]])
    body = rows.select(F.lit(1).alias("o"), F.col("id"), text.alias("value"))
    head = rows.sparkSession.createDataFrame([(0, 0, BOM + ",".join(COLUMNS))], "o int, id long, value string")
    return head.union(body).orderBy("o", "id").select("value")


def write(rows: DataFrame, folder: str) -> None:
    """Write one file list (a part file with CRLF ends) into a folder."""
    lines(rows).coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(folder)


#: Columns of a CSV export.
EXPORT = ("name", "path", "size", "last_write_time", "creation_time", "last_access_time", "change_time", "attributes", "directory")


def export_csv(rows: DataFrame, folder: str, titles: list[str] | None = None) -> None:
    """All fields in quotes; ``titles`` are the headings in the reader's language."""
    named = rows.select(*[F.col(c).cast("string").alias(t) for c, t in zip(EXPORT, titles or EXPORT)])
    named.coalesce(1).write.mode("overwrite").csv(folder, header=True, quoteAll=True, escape='"')


def export_txt(rows: DataFrame, folder: str) -> None:
    """One path a line."""
    rows.select("path").coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(folder)
