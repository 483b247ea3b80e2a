"""Catalogs, trees and journals made of ordinary tables, to try every operator on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.sources.extract import SUPPORTED

#: Extensions of files to try: all that have text, some in capitals, and some that have none.
EXTENSIONS = [*SUPPORTED, "MD", "Docx", "exe", "PNG", "mdx", "tx", "zip"]
#: 2024-01-01 as a FILETIME, and an hour.
START, HOUR = 133_485_408_000_000_000, 36_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, stem: str = "number") -> DataFrame:
    """Documents as files; ``stem`` 'word' names them by their first word."""
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("txt", "md", "log", "html", "json"))), (F.col("doc_id") % 5 + 1).cast("int"))
    if stem == "word":
        name = F.concat(F.regexp_extract("text", r"^([^ .\n]+)", 1), F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), kind)
    else:
        name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_"), F.col("source"), F.lit("."), kind)
    marks = 32 + F.when(F.col("doc_id") % 7 == 0, 2).otherwise(0) + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)
    return d.select(
        (F.col("doc_id") + 1_000_000).alias("id"),
        F.lit(0).cast("long").alias("parent_id"),
        F.lit("D:").alias("volume"),
        name.alias("name"),
        F.concat(F.lit("D:\\"), "lang", F.lit("\\"), "source", F.lit("\\"), name).alias("path"),
        F.lit(False).alias("directory"),
        F.col("n_chars").alias("size"),
        (F.lit(START) + F.col("doc_id") * HOUR).alias("last_write_time"),
        *[F.lit(0).cast("long").alias(c) for c in ("creation_time", "last_access_time", "change_time")],
        marks.cast("int").alias("attributes"),
    )


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent_id, name, directory, size: customers hold orders, orders hold line items."""
    from pyspark.sql import Window as W

    line, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    twins = W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    text = lambda c: F.col(c).cast("string")
    items = line.withColumn("rn", F.row_number().over(twins)).select(
        (F.lit(3_000_000_000) + F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("rn")).alias("id"),
        (F.lit(2_000_000_000) + F.col("l_orderkey")).alias("parent_id"),
        F.concat(F.lit("item"), text("l_linenumber"), F.lit("_"), text("rn"), F.lit("_part"), text("l_partkey"), F.lit("."), F.lower("l_returnflag"), F.lower("l_linestatus")).alias("name"),
        F.lit(False).alias("directory"),
        F.floor("l_extendedprice").alias("size"),
    )
    zero = F.lit(0).cast("long").alias("size")
    folders = orders.select((F.lit(2_000_000_000) + F.col("o_orderkey")).alias("id"), (F.lit(1_000_000_000) + F.col("o_custkey")).alias("parent_id"), F.concat(F.lit("order_"), text("o_orderkey")).alias("name"), F.lit(True).alias("directory"), zero)
    roots = customer.select((F.lit(1_000_000_000) + F.col("c_custkey")).alias("id"), F.lit(1).cast("long").alias("parent_id"), F.col("c_name").alias("name"), F.lit(True).alias("directory"), zero)
    return items.union(folders).union(roots)


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as paths."""
    host, rest = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1), F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1)
    path = F.concat(F.lit("D:\\"), host, F.lit("\\"), F.replace(rest, F.lit("/"), F.lit("\\")))
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.lit(0).cast("long").alias("parent_id"), F.element_at(F.split(path, r"\\"), -1).alias("name"),
        path.alias("path"), F.lit(False).alias("directory"), F.length("html").cast("long").alias("size"),
        F.lit(0).cast("long").alias("last_write_time"), F.lit(32).alias("attributes"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as names."""
    name = F.concat("p_name", F.lit("."), F.lower("p_type"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.lit(0).cast("long").alias("parent_id"), name.alias("name"), name.alias("path"),
        F.lit(False).alias("directory"), (F.col("p_size").cast("long") * 1024).alias("size"),
        F.lit(0).cast("long").alias("last_write_time"), F.lit(32).alias("attributes"),
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change journal."""
    reason = F.when(F.col("event_type") == "signup", 256).when(F.col("event_type") == "purchase", 8192).when(F.col("event_type") == "error", 512).when(F.col("event_type") == "click", 32768).otherwise(2)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("usn"), F.col("user_id").alias("file_id"), (F.col("event_id") % 50).alias("parent_id"),
        reason.cast("long").alias("reason"), F.when(F.col("user_id") % 10 == 0, 16).otherwise(32).alias("attributes"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("_"), F.col("event_id").cast("string"), F.lit(".dat")).alias("name"),
    )


def journal_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that live before the journal: users of even number."""
    users = table(spark, sf_dir, "events").select("user_id").distinct().filter("user_id % 2 = 0")
    return users.select(
        F.col("user_id").alias("id"), F.lit(7).cast("long").alias("parent_id"), F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit(".dat")).alias("name"),
        (F.col("user_id") % 10 == 0).alias("directory"), (F.col("user_id") * 10).alias("size"), F.lit(START).alias("last_write_time"),
        F.when(F.col("user_id") % 10 == 0, 16).otherwise(32).alias("attributes"),
    )


def odd_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strays (whose parent is absent) with a child each, a ring of parents with a child each, and chains of 40."""
    supplier, nation, part = (table(spark, sf_dir, t) for t in ("supplier", "nation", "part"))
    node = lambda i, parent, name: (i.cast("long").alias("id"), parent.cast("long").alias("parent_id"), name.alias("name"))
    s, n, p = F.col("s_suppkey"), F.col("n_nationkey"), F.col("p_partkey")
    named = lambda stem, c: F.concat(F.lit(stem), c.cast("string"))
    rows = supplier.select(*node(5_000_000_000 + s, 6_000_000_000 + s, named("stray_", s)))
    rows = rows.union(supplier.select(*node(6_500_000_000 + s, 5_000_000_000 + s, named("below_", s))))
    rows = rows.union(nation.select(*node(7_000_000_000 + n, 7_000_000_000 + (n + 1) % 25, F.col("n_name"))))
    rows = rows.union(nation.select(*node(7_100_000_000 + n, 7_000_000_000 + n, named("under_", F.col("n_name")))))
    chains = part.filter((p >= 40) & (p < 4000))
    return rows.union(chains.select(*node(8_000_000_000 + p, F.when(p % 40 == 0, 1).otherwise(8_000_000_000 + p - 1), named("deep_", p))))


def rooted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as paths, every third one directly below the drive."""
    rows = page_paths(spark, sf_dir)
    path = F.when(F.col("id") % 3 == 0, F.concat(F.lit("D:\\"), F.get(F.split("path", r"\\"), F.lit(1)))).otherwise(F.col("path"))
    return rows.withColumn("path", path).withColumn("name", F.element_at(F.split("path", r"\\"), -1))


def typed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files with every extension whose text can be read, and some others."""
    kind = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % len(EXTENSIONS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("D:\\f"), F.col("p_partkey").cast("string"), F.lit("."), kind).alias("path"))
