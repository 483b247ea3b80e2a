"""Schemas, constants and options of the catalog."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: 100 ns units between 1601-01-01 and 1970-01-01.
FILETIME_EPOCH = 116_444_736_000_000_000

#: Attribute names and their bits (fixed values).
ATTRIBUTES = {
    "readonly": 0x1, "ro": 0x1,
    "hidden": 0x2, "h": 0x2,
    "system": 0x4, "s": 0x4,
    "directory": 0x10, "d": 0x10,
    "archive": 0x20, "a": 0x20,
    "reparse": 0x400,
    "compressed": 0x800, "c": 0x800,
    "offline": 0x1000, "o": 0x1000,
    "encrypted": 0x4000, "e": 0x4000,
}
DIRECTORY = 0x10

#: Reason bits of a change journal (fixed values).
DATA_EXTEND, CREATE, DELETE, RENAME_OLD, RENAME_NEW, BASIC_INFO, CLOSE = 0x2, 0x100, 0x200, 0x1000, 0x2000, 0x8000, 0x80000000

CATALOG = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("parent_id", T.LongType(), False),
        T.StructField("volume", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("directory", T.BooleanType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("last_write_time", T.LongType(), False),
        T.StructField("creation_time", T.LongType(), False),
        T.StructField("last_access_time", T.LongType(), False),
        T.StructField("change_time", T.LongType(), False),
        T.StructField("attributes", T.IntegerType(), False),
    ]
)
RECORD = [f.name for f in CATALOG]
CHANGE = "usn long, file_id long, parent_id long, reason long, attributes int, name string"

SORTS = (
    "relevance", "name", "path", "size", "last_write_time", "attributes", "extension", "type", "creation_time",
    "last_access_time", "change_time", "run_count", "last_open_time", "file_list_name",
)
#: Result caps: of a service answer, of a content search, of the command line.
SERVICE_LIMIT, CONTENT_LIMIT, CLI_LIMIT = 1000, 500, 100
#: Bytes of a service answer, and rows of the page that is shown while someone types.
SERVICE_BYTES, FIRST_PAGE = 4 << 20, 200


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 100
    case_sensitive: bool = False
    match_path: bool = False
    whole_word: bool = False
    match_diacritics: bool = True
    sort: str = "relevance"
    descending: bool = False
    regex_compat: bool = False


def to_filetime(moment: datetime) -> int:
    since = moment.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return FILETIME_EPOCH + (since.days * 86_400 + since.seconds) * 10_000_000 + since.microseconds * 10


def filetime_to_timestamp(ticks: Column) -> Column:
    return F.timestamp_micros(F.floor((ticks - FILETIME_EPOCH) / 10))


def conform(df: DataFrame) -> DataFrame:
    """``df`` with the catalog's columns: missing ones are 0 or empty, nulls likewise; a
    row is a directory exactly if its attribute says so or, without attributes, its flag."""
    have = set(df.columns)
    zero = {T.LongType(): F.lit(0).cast("long"), T.IntegerType(): F.lit(0), T.StringType(): F.lit(""), T.BooleanType(): F.lit(False)}
    out = df.select(
        *[F.coalesce(F.col(f.name).cast(f.dataType), zero[f.dataType]).alias(f.name) if f.name in have else zero[f.dataType].alias(f.name) for f in CATALOG]
    )
    flag = F.when(F.col("directory"), F.lit(DIRECTORY)).otherwise(F.lit(0))
    out = out.withColumn("attributes", F.col("attributes").bitwiseOR(flag))
    return out.withColumn("directory", F.col("attributes").bitwiseAND(DIRECTORY) != 0).select(*RECORD)
