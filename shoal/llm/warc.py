"""Deterministic sharded WARC writer, and the reader.

Records are sorted by page_id and payload digest and cut into shards of ``shard_bytes`` of payload (more
where that would give over ``MAX_SHARDS``): the bounds are keys at whole multiples of that many
bytes before them in the order of keys, a prefix sum that does not depend on how Spark deals the
rows.  One shuffle brings each shard's pages to a task of its own, which streams them in order and
begins a new file when the compressed size passes ``roll_bytes``.  Every record is a gzip member of
its own; headers, lengths, record ids and digests are made anew from page_id, url and payload.

A file is written under a temporary name with a random part and renamed when complete; its last name
has the SHA-256 of its bytes, so a repeated or speculative task replaces it by the same file.  The
manifest (file, shard, records, bytes, SHA-256) is written last by Spark's own committer; then
temporary files of lost tasks are deleted.  A reader wants the manifest, as many files as it
lists, and of every file the bytes that its name promises; nothing of that is collected.

Of records with equal payloads of at least ``REVISIT_BYTES`` the one with the largest page_id is
a response and the others are revisits of it; smaller ones are responses.

Defined cases: null html is the empty payload; a null url becomes ``urn:page:ID``; a null
page_id sorts first (by digest, so such rows spread over shards), loses against any id, and with no id
in its group is a response; rows that repeat page_id and payload are one capture, lie in one shard and all
have the same type; an empty table gives an empty archive and result; other columns are ignored.  The
folder must be new.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import arrow_map, new_path, written

REVISIT_BYTES = 1000
SHARD_BYTES, ROLL_BYTES = 32 << 20, 8 << 20
#: Shards at most, and so the keys that the driver holds and sends: 58 bytes each.
MAX_SHARDS = 100_000
#: One date for all records: the archive depends on its input only.
DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{digest}'.encode()).digest()[:16], version=4)}>"


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """The bytes of a WARC record, not compressed."""
    digest = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{'' if page_id is None else page_id}"
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest.hex())),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", base32(digest)),
        ("WARC-Block-Digest", base32(hashlib.sha1(block).digest())),
        ("X-Payload-Length", str(len(payload))),
        ("X-Source-URL", "-" if url is None else "+" + quote(url, safe="%/:=&?~#+!$,;'@()*[]")),
    ]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, digest.hex())),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """A row of ``RECORDS``; digests and lengths are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if first != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or base32(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    kind, payload, n = fields["WARC-Type"], None, int(fields["X-Payload-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != n or hashlib.sha1(payload).digest() != digest:
            raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("X-Page-ID"), fields["WARC-Target-URI"], payload, n, digest.hex(), kind, number("X-Refers-To-Page-ID")


class RollingWriter:
    """Writes the files of one shard at a time, each under a temporary name first."""

    def __init__(self, folder: str, roll_bytes: int):
        from pyarrow import fs

        self.store, self.folder = fs.FileSystem.from_uri(re.sub(r"^(/|file:/+)", "file:///", folder))
        self.roll_bytes, self.shard, self.out = roll_bytes, None, None

    def open(self, shard: int) -> None:
        self.number = self.number + 1 if shard == self.shard else 0
        self.shard, self.records, self.size, self.sum = shard, 0, 0, hashlib.sha256()
        self.name = f"shard-{shard:06d}-{self.number:05d}"
        self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}.tmp"
        self.out = self.store.open_output_stream(self.temporary, compression=None)
        self.put(b"warcinfo", count=False)

    def put(self, raw: bytes, count: bool = True) -> None:
        if not count:
            body = b"software: shoal\r\nformat: WARC File Format 1.1\r\n"
            raw = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id('info', self.name)}\r\nWARC-Date: {DATE}\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(raw) + packer.flush()
        self.out.write(member)
        self.sum.update(member)
        self.size += len(member)
        self.records += count

    def close(self) -> tuple | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        digest = self.sum.hexdigest()
        name = f"{self.name}-{digest}.warc.gz"
        self.store.move(self.temporary, f"{self.folder}/{name}")
        return self.shard, name, self.records, self.size, digest

    def add(self, shard: int, raw: bytes) -> tuple | None:
        """The manifest row of the file that this record closes, if any."""
        done = None
        if self.out is None or shard != self.shard or self.size >= self.roll_bytes:
            done = self.close()
            self.open(shard)
        self.put(raw)
        return done


MANIFEST = "shard int, file string, records long, bytes long, sha256 string"


def plan(pages: DataFrame, shard_bytes: int) -> tuple[DataFrame, list[str]]:
    """(page_id, digest, refers_to) of the revisits, and the first key of each shard but one."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    keys = written(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("n")), "warc-keys")
    best = keys.filter(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("times"))
    best = best.filter("times > 1 and refers_to is not null").drop("times")
    revisits = keys.join(best, "digest").filter("page_id is null or page_id != refers_to").select("page_id", "digest", "refers_to").distinct()

    # Bytes before each key, in the order of keys: sums by range of keys, then within the range.
    ranges = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = keys.groupBy(order_key(F.col("page_id"), F.col("digest")).alias("key")).agg(F.sum("n").alias("n"))
    sizes = written(sizes.repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id()), "warc-sizes")
    starts = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.groupBy("part").agg(F.sum("n").alias("total")).withColumn("offset", F.coalesce(F.sum("total").over(starts), F.lit(0)))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    within = W.partitionBy("part").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    at = sizes.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets.select("part", "offset"), "part")
    shard = F.floor((F.col("offset") + F.col("before")) / max(shard_bytes, -(-total // MAX_SHARDS)))
    firsts = at.groupBy(shard.alias("shard")).agg(F.min("key").alias("first")).filter("shard > 0").orderBy("shard").collect()
    return revisits, [r["first"] for r in firsts]  # at most MAX_SHARDS


def order_key(page_id: Column, digest: Column) -> Column:
    """57 characters whose order is that of ids, null first, then of digests."""
    number = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("1"), number), F.lit("0" * 17)), digest)


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the archive to ``folder`` and return its manifest."""
    spark = pages.sparkSession
    revisits, firsts = plan(pages, shard_bytes)
    sent = spark.sparkContext.broadcast(np.array(firsts, "U57"))

    @pandas_udf("int")
    def shard_of(keys):
        import pandas as pd

        return pd.Series(np.searchsorted(sent.value, keys.to_numpy().astype("U57"), side="right").astype(np.int32))

    payload = F.coalesce(F.col("html"), F.lit(""))
    none = F.lit(None)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.lit(1).alias("kind"), "url", payload.alias("html"), none.cast("long").alias("refers_to"))
    rows = rows.union(revisits.select("page_id", "digest", F.lit(0), none.cast("string"), none.cast("string"), "refers_to"))
    rows = rows.withColumn("shard", shard_of(order_key(F.col("page_id"), F.col("digest"))))
    rows = rows.repartitionById(len(firsts) + 1, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "digest", "kind", "url")

    def run(batches):
        w, refers = RollingWriter(folder, roll_bytes), (None, None, None)

        def manifest(done):
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(done, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["shard", "file", "records", "bytes", "sha256"])

        for b in batches:
            for page_id, digest, kind, url, html, refers_to, shard in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 0:
                    refers = (page_id, digest, refers_to)
                    continue
                target = refers[2] if refers[:2] == (page_id, digest) else None
                if done := w.add(shard, record(page_id, url, html.encode(), target)):
                    yield manifest(done)
        if done := w.close():
            yield manifest(done)

    make_folder(spark, folder)
    arrow_map(rows, run, MANIFEST, rows=500).write.parquet(f"{folder}/_manifest")
    drop_temporary(spark, folder)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def make_folder(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def drop_temporary(spark, folder: str) -> None:
    """Delete what tasks left that were lost before they renamed their file."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/.shard-*.tmp")
    store = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for left in store.globStatus(pattern) or []:
        store.delete(left.getPath(), False)


def members(data: bytes, step: int = 1 << 16):
    """The gzip members of a file, unpacked one at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("cut short")
            some = view[at : at + step]
            parts.append(unpack.decompress(some))
            at += len(some) - len(unpack.unused_data)
        yield b"".join(parts)


def read(spark, folder: str) -> DataFrame:
    """Rows of ``RECORDS`` from the files of a finished archive.  It fails if files are missing or too
    many, and when a file's bytes are not those that its name has the digest of."""
    listed = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if not listed[0]:
        return spark.createDataFrame([], RECORDS)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.warc.gz").load(folder)
    there = files.select("path", "length").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    if tuple(there) != tuple(listed):
        raise ValueError(f"{folder} has {there[0]} files of {there[1]} bytes; its manifest lists {listed[0]} of {listed[1]}")

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                data = content.as_py()
                if not path.endswith(f"-{hashlib.sha256(data).hexdigest()}.warc.gz"):
                    raise ValueError(f"damaged file {path}")
                rows = []
                for raw in members(data):
                    if b"\r\nWARC-Type: warcinfo\r\n" in raw[:200]:
                        continue
                    rows.append(parse(raw))
                    if len(rows) == 256:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return arrow_map(files.select("path", "content"), run, RECORDS, rows=2)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def round_trip(pages: DataFrame, folder: str | None = None, **sizes) -> DataFrame:
    """Write the pages and read them back."""
    folder = folder or new_path(pages.sparkSession, "warc")
    write(pages, folder, **sizes)
    return read(pages.sparkSession, folder)
