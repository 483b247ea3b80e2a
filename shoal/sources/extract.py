"""Text of documents: plain text in several encodings, DOCX and PDF; one reader a file type.

Binary formats need Python; files come from Spark's ``binaryFile`` reader, so any store
that Spark reads will do.  A file that cannot be read gives a row with an error.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.functions.text import extension
from shoal.ship import ship

#: Extensions that are indexed (fixed values).
SUPPORTED = (
    "txt md log csv json xml yaml yml ini cfg c cc cpp cxx h hpp cs java py js ts tsx jsx rs go "
    "cmake ps1 bat cmd sql html htm css toml pdf doc docx"
).split()
#: Bytes of the head that are searched for a NUL.
BINARY_HEAD = 4096
MAX_BYTES = 32 << 20
#: Bytes that a file may unpack to.
MAX_UNPACKED = 256 << 20


class Unreadable(ValueError):
    """The file gives no text."""


def plain_text(data: bytes) -> str:
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(encoding, "replace")
    if b"\0" in data[:BINARY_HEAD]:
        raise Unreadable("binary file")
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z, z.open("word/document.xml") as f:
            raw = f.read(MAX_UNPACKED + 1)
        if len(raw) > MAX_UNPACKED:
            raise Unreadable("unpacks to too much")
        root = ElementTree.fromstring(raw)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error) as e:
        raise Unreadable(f"not a document: {e}") from e
    out: list[str] = []
    # Depth first with a stack of its own, so that no nesting is too deep; a string is what ends a node.
    pending: list = [root]
    while pending:
        node = pending.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        tag = node.tag.rpartition("}")[2]
        if tag == "t":
            out.append((node.text or "") + " ")
        elif tag in ("tab", "br", "cr"):
            out.append("\t" if tag == "tab" else "\n")
        if tag == "p":
            pending.append("\n")
        pending.extend(reversed(node))
    text = "".join(out).strip()
    if not text:
        raise Unreadable("no text")
    return text


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        code = m[1]
        if code[:1].isdigit():
            return bytes([int(code, 8) & 255])
        return b"" if code in (b"\n", b"\r\n", b"\r") else _ESCAPES.get(code, code)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw, flags=re.S)


def _shown(data: bytes) -> str:
    return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("latin-1")


_STRING = re.compile(rb"\((?P<lit>(?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\)|<(?P<hex>[0-9A-Fa-f\s]*)>", re.S)


def pdf_text(data: bytes) -> str:
    """Text shown by the content streams of a PDF that is not encrypted, raw or deflated."""
    if not data.startswith(b"%PDF-"):
        raise Unreadable("not a PDF")
    if b"/Encrypt" in data:
        raise Unreadable("encrypted PDF")
    out, unpacked = [], 0
    for m in re.finditer(rb"<<(?P<dict>(?:(?!endobj).)*?)>>\s*stream\r?\n(?P<body>.*?)\r?\n?endstream", data, re.S):
        body = m["body"]
        if b"/FlateDecode" in m["dict"]:
            try:
                body = zlib.decompressobj().decompress(body, MAX_UNPACKED - unpacked + 1)
            except zlib.error:
                continue
            unpacked += len(body)
            if unpacked > MAX_UNPACKED:
                raise Unreadable("unpacks to too much")
        elif b"/Filter" in m["dict"]:
            continue
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", body, re.S):
            shown = []
            for s in _STRING.finditer(block):
                if s["lit"] is not None:
                    shown.append(_shown(_literal(s["lit"])))
                else:
                    digits = re.sub(rb"\s", b"", s["hex"])
                    shown.append(_shown(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())))
            out.append("".join(shown))
    text = "\n".join(o for o in out if o.strip()).strip()
    if not text:
        raise Unreadable("no text")
    return text


#: Reader of each file type; others are plain text.  More can be added.
READERS: dict[str, Callable[[bytes], str]] = {"docx": docx_text, "pdf": pdf_text}


def extract(path: str, data: bytes, max_bytes: int = MAX_BYTES) -> str:
    if len(data) > max_bytes:
        raise Unreadable("file too large")
    kind = path.rpartition(".")[2].lower()
    if kind == "doc" and "doc" not in READERS:
        raise Unreadable("no reader for doc")
    return READERS.get(kind, plain_text)(data)


def is_supported(path: Column) -> Column:
    return F.lower(extension(path)).isin(SUPPORTED)


def extract_files(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, text, size, last_write_time (ms), error of the supported files below a folder.
    Files over the limit are never read into memory."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.filter(is_supported(F.col("path")))
    small = files.filter(F.col("length") <= max_bytes)
    large = files.filter(F.col("length") > max_bytes)

    def run(batches):
        for b in batches:
            texts, errors = [], []
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                try:
                    texts.append(extract(path, content.as_py(), max_bytes))
                    errors.append(None)
                except Unreadable as e:
                    texts.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string()), b.column("length"), b.column("time"), pa.array(errors, pa.string())], ["path", "text", "size", "last_write_time", "error"])

    time = F.unix_millis("modificationTime").alias("time")
    out = small.select("path", "content", "length", time).mapInArrow(run, "path string, text string, size long, last_write_time long, error string")
    return out.union(large.select("path", F.lit(None).cast("string"), "length", time, F.lit("file too large")))
