"""Content search, extraction, file lists, folder scans."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from shoal.operators import content
from shoal.sources import efu, extract, scan
from shoal.sources.extract import Unreadable


@pytest.fixture(scope="module")
def index(spark):
    rows = [("D:\\a", "The quick brown fox. Quick!", "r1"), ("D:\\b", "A slow brown dog and the fox", "r1"), ("D:\\c", "你好世界 quick", "r2"), ("D:\\d", "", "r2"), ("D:\\e", None, "r2")]
    return content.ContentIndex.build(spark.createDataFrame(rows, "path string, text string, root string"), shard="root")


def docs(index, text):
    found = index.matches(text)
    return None if found is None else "".join(sorted(r.doc[-1] for r in found.collect()))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("brown", "ab"), ("brown fox", "ab"), ('"brown fox"', "a"), ("quick OR dog", "abc"), ("quick NOT fox", "c"), ("qui*", "ac"),
        ("+fox -slow", "a"), ("quick XOR fox", "bc"), ("你好", "c"), ("好你", ""), ("NOT quick", "bde"), ("(quick OR slow) brown", "ab"),
        ("BROWN", "ab"), ("nothing", ""), ("...", None), ("", None),
    ],
)
def test_matches(index, text, want):
    assert docs(index, text) == want


def test_search_ranks_and_limits(index):
    rows = index.search("quick", 10).collect()
    assert [r.relevance_percent for r in rows][0] == 100 and {r.doc for r in rows} == {"D:\\a", "D:\\c"}
    assert index.search("quick", 1).count() == 1 and index.estimated_matches("quick") == 2
    assert index.search("quick", 0).count() == 0 and index.search("", 5).count() == 0 and index.hits("", 5).count() == 0


def test_snippets(index):
    for r in index.hits("quick fox OR 世", 10).collect():
        assert len(r.snippet) <= content.SNIPPET + 6 and r.highlights
        units = r.snippet.encode("utf-16-le")
        for start, n in r.highlights:
            assert units[2 * start : 2 * (start + n)].decode("utf-16-le").lower() in {"quick", "fox", "世"}
    long = "x " * 500 + "needle and needle " + "y " * 500
    text, marks = content.snippet(long, [(("needle",), False)])
    assert text.startswith("...") and text.endswith("...") and len(marks) == 2 and len(text) <= content.SNIPPET + 6
    assert content.snippet("", [(("a",), False)]) == ("", [])


def test_upsert_remove_and_store(spark, index, tmp_path):
    new = spark.createDataFrame([("D:\\a", "green", "r1"), ("D:\\z", "quick green", "r3")], "path string, text string, root string")
    after = index.upsert(new, spark.createDataFrame([("D:\\c",)], "doc string"), shard="root")
    assert docs(after, "quick") == "z" and docs(after, "green") == "az"
    after.save(str(tmp_path / "i"))
    assert docs(content.ContentIndex.load(spark, str(tmp_path / "i")), "green") == "az"


def test_shards_and_status(index):
    a = index.search("quick", 10)
    merged = content.merge_shards([a.filter("shard = 'r1'"), a.filter("shard = 'r2'")], 1)
    assert merged.first().doc == a.first().doc
    row = content.overall_status(index.status()).first()
    assert (row.documents, row.ready, row.indexing) == (5, True, False)


def test_roots_and_path_filter(spark):
    assert content.normalise_roots(["D:\\a\\", "d:/A", "D:\\a\\b", "D:\\ab", "E:\\"]) == ["E:", "D:\\a", "D:\\ab"]
    paths = {
        "D:\\r": True, "D:\\r\\x.txt": True, "D:\\r\\Windows\\x": False, "D:\\r\\k\\Windows\\x": True, "D:\\r\\k\\.git\\x": False,
        "D:\\r\\skip\\x": False, "D:\\rx\\y": False, "D:\\r\\skipped": True, "D:/r/Node_Modules/q": False, "D:\\r\\abs\\q": False,
    }
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    ok = content.accepted(F.col("p"), "D:\\r", ("skip", "d:\\R\\abs"))
    assert {r.p: r.ok for r in df.select("p", ok.alias("ok")).collect()} == paths
    routed = df.select("p", content.route(F.col("p"), ["D:\\r"]).alias("r")).collect()
    assert {r.p for r in routed if r.r is None} == {"D:\\rx\\y"}


# -- extraction --------------------------------------------------------------------------


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pdf(content_bytes, deflate=False, extra=b""):
    body = zlib.compress(content_bytes) if deflate else content_bytes
    kind = b"/Filter /FlateDecode " if deflate else b""
    return b"%PDF-1.4\n1 0 obj\n<< " + kind + b"/Length %d >>\nstream\n" % len(body) + body + b"\nendstream\nendobj\n" + extra


def test_plain_text():
    assert extract.plain_text("é".encode()) == "é" == extract.plain_text(b"\xef\xbb\xbf" + "é".encode())
    assert extract.plain_text("\ufeffhé".encode("utf-16-le")) == "hé" == extract.plain_text("\ufeffhé".encode("utf-16-be"))
    assert extract.plain_text(b"caf\xe9") == "café"
    with pytest.raises(Unreadable):
        extract.plain_text(b"a\0b")


def test_docx_and_pdf():
    assert extract.docx_text(docx("<w:p><w:r><w:t>Hello &amp;</w:t><w:tab/><w:t>you</w:t><w:br/></w:r></w:p><w:p><w:r><w:t>end</w:t></w:r></w:p>")) == "Hello & \tyou \n\nend"
    for bad in (b"no zip", docx("<w:p/>")):
        with pytest.raises(Unreadable):
            extract.docx_text(bad)
    show = b"BT (Hello \\(world\\) \\101) Tj <48 69> Tj ET"
    assert extract.pdf_text(pdf(show)) == "Hello (world) AHi" == extract.pdf_text(pdf(show, True))
    for bad in (b"x", pdf(show, extra=b"/Encrypt 1 0 R"), pdf(b"BT ET")):
        with pytest.raises(Unreadable):
            extract.pdf_text(bad)


def test_extraction_is_bounded(monkeypatch):
    deep = "<w:p>" * 3000 + "<w:r><w:t>far down</w:t></w:r>" + "</w:p>" * 3000
    assert extract.docx_text(docx(deep)) == "far down"
    monkeypatch.setattr(extract, "MAX_UNPACKED", 5000)
    with pytest.raises(Unreadable, match="too much"):
        extract.docx_text(docx("<w:p><w:r><w:t>" + "a" * 6000 + "</w:t></w:r></w:p>"))
    with pytest.raises(Unreadable, match="too much"):
        extract.pdf_text(pdf(b"BT (" + b"a" * 6000 + b") Tj ET", True))


def test_extract_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.txt": b"one", "sub/b.PDF": pdf(b"BT (two) Tj ET"), "c.docx": docx("<w:p><w:r><w:t>three</w:t></w:r></w:p>"), "d.exe": b"no", "e.md": b"x" * 500, "f.log": b"a\0", "g.doc": b"old"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: (r.text, r.error) for r in extract.extract_files(spark, str(tmp_path), max_bytes=400).collect()}
    assert got["a.txt"] == ("one", None) and got["b.PDF"] == ("two", None) and got["c.docx"] == ("three", None)
    assert got["e.md"] == (None, "file too large") and got["f.log"] == (None, "binary file") and got["g.doc"][0] is None
    assert "d.exe" not in got


# -- file lists and scans ----------------------------------------------------------------


def test_file_list_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, 0, "", 'q"uote,.txt', 'D:\\x\\q"uote,.txt', False, 5, 7, 8, 9, 10, 32), (2, 0, "", "报告", "D:\\报告", True, 0, 1, 0, 0, 0, 16)],
        "id long, parent_id long, volume string, name string, path string, directory boolean, size long, last_write_time long, creation_time long, last_access_time long, change_time long, attributes int",
    )
    efu.write(rows, str(tmp_path / "l"))
    raw = b"".join(p.read_bytes() for p in (tmp_path / "l").glob("part-*"))
    assert raw.startswith(b"\xef\xbb\xbfFilename,Size,Date Modified,Date Created,Date Accessed,Date Changed,Attributes\r\n") and raw.count(b"\r\n") == 3
    assert sorted(map(tuple, efu.read(spark, str(tmp_path / "l")).collect())) == sorted(map(tuple, rows.collect()))


def test_odd_file_lists(spark, tmp_path):
    p = tmp_path / "o.efu"
    p.write_text("SIZE,filename,Attributes\r\n12x,D:\\a/b,16\r\n,,\r\nbad,D:\\c,\r\n")
    got = [(r.id, r.path, r.name, r.size, r.directory) for r in efu.read(spark, str(p)).orderBy("id").collect()]
    assert got == [(1, "D:\\a\\b", "b", 12, True), (3, "D:\\c", "c", 0, False)]
    q = tmp_path / "bad.efu"
    q.write_text("Size\n1\n")
    with pytest.raises(ValueError):
        efu.read(spark, str(q))


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "D:\\a", 5)], "id long, name string, path string, size long")
    full = rows.selectExpr("*", "0L last_write_time", "0L creation_time", "0L last_access_time", "0L change_time", "0 attributes", "false directory")
    efu.export_csv(full, str(tmp_path / "c"))
    assert b'"D:\\a","5"' in b"".join(p.read_bytes() for p in (tmp_path / "c").glob("part-*"))
    efu.export_txt(full, str(tmp_path / "t"))
    assert b"".join(p.read_bytes() for p in (tmp_path / "t").glob("part-*")) == b"D:\\a\r\n"


def test_scan(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "f.txt").write_text("12345")
    (tmp_path / "link").symlink_to(tmp_path / "d")
    rows, errors = scan.scan(spark, [str(tmp_path)])
    got = {r.name: r for r in rows.collect()}
    assert set(got) == {"d", "e", "f.txt", "link"} and got["f.txt"].size == 5 and got["d"].directory
    assert got["f.txt"].parent_id == got["d"].id and got["link"].attributes & 0x400
    (tmp_path / "d" / "e" / "g" / "h").mkdir(parents=True)
    (tmp_path / "d" / "e" / "g" / "h" / "deep.txt").write_text("1")
    rows, _ = scan.scan(spark, [str(tmp_path)])
    got = sorted(r.name for r in rows.collect())
    assert got == sorted(["d", "e", "f.txt", "g", "h", "deep.txt", "link"])
    both, failed = scan.build_volumes(spark, {"A": str(tmp_path), "B": "/none"}, lambda root: scan.scan(spark, [root])[0] if root != "/none" else 1 / 0)
    assert {r.volume for r in both.select("volume").distinct().collect()} == {"A"} and set(failed) == {"B"}


def test_shards_of_roots(spark, tmp_path):
    docs = spark.createDataFrame([("D:\\a\\1", "red blue"), ("d:/A/2", "red"), ("E:\\b\\1", "blue red"), ("F:\\x", "red")], "path string, text string")
    with pytest.raises(ValueError, match="overlap"):
        content.ShardedContentIndex.build(docs, ["D:\\a", "D:\\a\\b"])
    index = content.ShardedContentIndex.build(docs, ["D:\\a", "E:"])
    assert [r.path for r in index.outside(docs).collect()] == ["F:\\x"] and index.estimated_matches("red") == 3
    assert {r.doc for r in index.search("blue").collect()} == {"D:\\a\\1", "E:\\b\\1"}
    assert {(r.shard, r.documents, r.indexing) for r in index.status(frozenset({"E:"})).collect()} == {("D:\\a", 2, False), ("E:", 1, True)}
    with pytest.raises(ValueError, match="outside"):
        index.upsert(docs)
    index.save(str(tmp_path / "s"))
    again = content.ShardedContentIndex.load(spark, str(tmp_path / "s"), ["D:\\a", "E:"])
    new = docs.filter("path like 'E:%'").withColumn("text", F.lit("green"))
    after = again.upsert(new, docs.filter("path like 'd:%'").select(F.col("path").alias("doc")))
    assert after.estimated_matches("red") == 1 and [r.doc for r in after.search("green").collect()] == ["E:\\b\\1"]
    assert content.overall_status(after.status()).first()["documents"] == 2
