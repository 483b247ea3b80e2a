"""Searches of small catalogs."""

import itertools
import random
import re
from datetime import datetime, timezone
from functools import cmp_to_key

import pytest
from pyspark.sql import functions as F

from shoal.functions import text as T
from shoal.model import SearchOptions, conform, to_filetime
from shoal.operators.search import Catalog, compose, interactive, serve, with_run_history

NOW = datetime(2024, 2, 15, 12, 30, tzinfo=timezone.utc)
SCHEMA = "id long, parent_id long, name string, path string, directory boolean, size long, attributes int, last_write_time long"


def catalog(spark, rows):
    """rows: (id, name, path) and, where needed, directory, size, attributes, time, parent."""
    full = [(r[0], r[7] if len(r) > 7 else 0, r[1], r[2], *(r[3:7] + (False, 0, 0, 0)[len(r[3:7]) :])) for r in rows]
    return Catalog(conform(spark.createDataFrame(full, SCHEMA)), now=NOW)


def ids(c, text, **options):
    return [r.id for r in c.search(text, SearchOptions(**options)).collect()]


@pytest.fixture(scope="module")
def basics(spark):
    return catalog(
        spark,
        [
            (1, "Annual Report.pdf", "D:\\Docs\\Annual Report.pdf"),
            (2, "Annual Report Draft.pdf", "D:\\Temp\\Annual Report Draft.pdf"),
            (3, "readme.md", "D:\\Projects\\readme.md"),
            (4, "Projects", "D:\\Projects", True),
        ],
    )


def test_basics(basics):
    assert ids(basics, "annual ext:pdf !draft file:", match_path=True) == [1]
    assert ids(basics, "path:projects folder:") == [4]
    assert ids(basics, "*.md") == [3]
    assert ids(basics, "annual", case_sensitive=True) == []
    assert ids(basics, "case:on Annual count:1") == [1]


def test_what_finds_nothing(basics):
    for text in ("", "dupe:name", "count:5", "case:on", "a OR file:", 'regex:"("', '"open', "not"):
        assert ids(basics, text) == [], text
    assert ids(basics, "annual", limit=0) == [] and ids(basics, "annual count:0") == []
    assert len(ids(basics, "file:")) == 3


@pytest.fixture(scope="module")
def sized(spark):
    today = to_filetime(datetime(2024, 2, 15, tzinfo=timezone.utc))
    return catalog(
        spark,
        [
            (1, "alpha2.txt", "D:\\alpha2.txt", False, 2048, 0x20, today),
            (2, "beta10.log", "D:\\beta10.log", False, 8388608, 0x2, 0),
            (3, "alpha10.txt", "D:\\alpha10.txt", False, 2048, 0, 0),
            (4, "alpha2.txt", "D:\\copy\\alpha2.txt", False, 2048, 0, 0),
        ],
    )


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("(alpha OR beta) size:>=1mb", {2}), ('regex:"^alpha[0-9]+\\.txt$"', {1, 3, 4}), ("attr:hidden", {2}),
        ("startwith:alpha", {1, 3, 4}), ("endwith:.log", {2}), ("len:=11", {3}), ("depth:=0", {1, 2, 3}),
        ("parents:=1", {4}), ("parent:D:\\copy", {4}), ("infolder:D:\\", {1, 2, 3}), ("root:", {1, 2, 3}),
        ("ext:txt;log", {1, 2, 3, 4}), ("ext:t*;log", {1, 2, 3, 4}), ("size:large", {2}), ("size:1mb..10mb", {2}),
        ("dm:today", {1}), ("len:10-11", {1, 2, 3, 4}), ("<alpha|beta> !ext:log", {1, 3, 4}),
        ("alpha dupe:name-size", {1, 4}), ("dm:<2000-01-01", {2, 3, 4}), ("size:>=18446744073709551615", set()),
        ("parent:D:\\copy\\", set()), ("startwith:alph*", set()),
    ],
)
def test_predicates(sized, text, want):
    assert set(ids(sized, text, match_path=True)) == want


def test_sorts(sized):
    assert len(ids(sized, "count:2 alpha")) == 2
    by_name = ids(sized, "alpha", sort="name")
    assert by_name == [1, 4, 3]
    assert ids(sized, "alpha", sort="name", descending=True) == by_name[::-1]
    assert ids(sized, "file:", sort="size") == [1, 3, 4, 2] or ids(sized, "file:", sort="size") == [1, 4, 3, 2]
    assert ids(sized, "file:", sort="size")[-1] == 2
    assert ids(sized, "file:", sort="extension")[0] == 2
    with pytest.raises(ValueError):
        ids(sized, "file:", sort="colour")


@pytest.fixture(scope="module")
def tree(spark):
    row = lambda i, p, n, path, d: (i, n, path, d, 0, 0, 0, p)
    return catalog(
        spark,
        [
            row(1, 0, "Root", "D:\\Root", True), row(2, 1, "Empty", "D:\\Root\\Empty", True), row(3, 1, "Mixed", "D:\\Root\\Mixed", True),
            row(4, 3, "Nested", "D:\\Root\\Mixed\\Nested", True), row(5, 3, "alpha.txt", "D:\\Root\\Mixed\\alpha.txt", False),
            row(6, 4, "beta.txt", "D:\\Root\\Mixed\\Nested\\beta.txt", False), row(7, 1, "Files", "D:\\Root\\Files", True),
            row(8, 7, "gamma.txt", "D:\\Root\\Files\\gamma.txt", False),
        ],
    )


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("empty:", {2}), ("childcount:=2", {3}), ("childfilecount:=1", {3, 4, 7}), ("childfoldercount:=1", {3}),
        ("file: childcount:=0", set()), ("child:alpha.txt", {3}), ("child:*.txt", {3, 4, 7}), ("child:Nested", {3}),
        ("folder: !child:*.txt", {1, 2}), ("!empty: file:", {5, 6, 8}), ("child:alpha OR child:gamma", {3, 7}),
    ],
)
def test_children(tree, text, want):
    assert set(ids(tree, text, limit=20)) == want


@pytest.fixture(scope="module")
def lists(spark):
    rows = [
        (1, "alpha.txt", "D:\\alpha.txt"), (2, "alpha.txt", "D:\\folder\\alpha.txt"), (3, "beta.log", "D:\\beta.log"),
        (4, "alphabet.txt", "D:\\alphabet.txt"), (5, "café.txt", "D:\\café.txt"), (7, "éclair.txt", "D:\\docs\\éclair.txt"),
    ]
    return catalog(spark, rows + [(100 + i, f"noise{i}.tmp", f"D:\\noise{i}.tmp") for i in range(500)])


def test_file_lists(lists):
    assert set(ids(lists, 'filelist:"alpha.txt|beta.log"')) == {1, 2, 3}
    assert set(ids(lists, 'filelist:"d:/folder\\ALPHA.txt|D:\\beta.log"')) == {2, 3}
    assert set(ids(lists, 'filelist:"alpha*.txt|*.log"')) == {1, 2, 3, 4}
    assert ids(lists, "filelist:ALPHA.TXT", case_sensitive=True) == []
    for text, want in (("filelist:cafe.txt", [5]), ("filelist:eclair.txt", [7]), ("filelist:D:\\docs\\eclair.txt", [7])):
        assert ids(lists, text, match_diacritics=False) == want and ids(lists, text) == []


def test_text_folding(spark):
    c = catalog(spark, [(1, "other.txt", "D:\\other.txt"), (2, "报告.pdf", "D:\\报告.pdf"), (3, "报报告.txt", "D:\\报报告.txt"), (4, "café.txt", "D:\\café.txt"), (5, "cafe\u0301x.txt", "D:\\cafe\u0301x.txt"), (6, "😀a", "D:\\😀a")])
    assert set(ids(c, "报告")) == {2, 3}
    assert ids(c, "cafe.txt") == [] and ids(c, "cafe.txt", match_diacritics=False) == [4]
    assert ids(c, "CAFÉ.TXT") == [4]
    assert ids(c, "cafe", match_diacritics=False, whole_word=True) == [4]
    assert ids(c, "len:3") == [6]


def test_whole_words(spark):
    c = catalog(spark, [(i, n, "D:\\" + n) for i, n in enumerate(("my report.txt", "reports.txt", "report", "a_report.txt", "re-report.x"), 1)])
    assert set(ids(c, "wholeword:on report")) == {1, 3, 5}
    assert len(ids(c, "wholeword:on rep*")) == 5


def test_regular_expressions(basics):
    assert ids(basics, 'regex:"^README"') == [3] and ids(basics, 'case:on regex:"^README"') == []
    assert ids(basics, 'name-regex:"[[:space:]]draft"') == [2]
    assert ids(basics, 'regex:"\\S+\\.md$"') == [3]
    assert ids(basics, 'regex:"\\D+\\.MD$"', regex_compat=True) == []


def test_scores(spark):
    names = ["needle", "needle_a", "xneedle", "other"]
    c = catalog(spark, [(i, n, f"D:\\needle\\{n}") for i, n in enumerate(names)])
    rows = {r.id: r.score for r in c.search("needle", SearchOptions(match_path=True)).collect()}
    assert rows == {0: 120, 1: 80, 2: 50, 3: 20}
    assert {r.score for r in c.search("n*dle !other", SearchOptions()).collect()} == {20}


def test_relevance_page_is_chosen_by_id_and_shown_by_path(spark):
    rows = [(i, f"xneedle_contains_{i}.txt", f"D:\\{1000 - i}\\x") for i in range(1, 201)]
    rows += [(500, "needle", "D:\\needle")] + [(600 + i, f"needle_prefix_{i}.txt", f"D:\\{i}\\p") for i in range(150)]
    c = catalog(spark, rows)
    top = c.search("needle", SearchOptions(limit=10)).collect()
    assert top[0].id == 500 and all(r.score >= 80 for r in top)
    page = ids(c, "xneedle", limit=5)
    assert set(page) == {1, 2, 3, 4, 5} and page == [5, 4, 3, 2, 1]
    assert [r.score for r in c.search("needle", SearchOptions(limit=3, descending=True)).collect()] == [50] * 3


def test_natural_order_of_pages(spark):
    c = catalog(spark, [(1, "item10", "D:\\item10"), (2, "Item2x", "D:\\Item2x"), (3, "item2", "D:\\item2"), (4, "item02", "D:\\item02"), (5, "xitem1", "D:\\xitem1"), (6, "item20", "D:\\item20")])
    assert ids(c, "item", sort="name", limit=3)[0] == 3
    assert ids(c, "item", sort="name") == [3, 2, 4, 1, 6, 5]


def natural_less(left, right):
    """Runs of digits by value, fewer zeros first; other characters one by one, lower-cased."""
    split = lambda s: re.findall(r"[0-9]+|[^0-9]", s.lower())
    for a, b in itertools.zip_longest(split(left), split(right)):
        if a == b:
            continue
        if a is None or b is None:
            return -1 if a is None else 1
        if a[0] in "0123456789" and b[0] in "0123456789":
            key = lambda r: (len(r.lstrip("0")), r.lstrip("0"), len(r))
            return -1 if key(a) < key(b) else 1
        return -1 if a < b else 1
    return 0


def test_natural_key_against_comparator(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("ab0129_.é") for _ in range(rng.randrange(1, 9))) for _ in range(600)] + ["7", "007"]
    names = sorted(set(names))
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.natural_key(F.col("n")).alias("k"))
    keyed = sorted(df.collect(), key=lambda r: r.k.encode())
    plain = sorted(names, key=cmp_to_key(natural_less))
    for a, b in zip(keyed, plain):
        assert a.n == b or natural_less(a.n, b) == 0


def test_paths(spark):
    cases = {
        "D:\\a.txt": ("D:\\", 0), "D:\\x\\a": ("D:\\x", 1), "D:\\x\\y\\a\\": ("D:\\x\\y", 2), "\\\\srv\\share\\a": ("\\\\srv\\share", 0),
        "\\\\srv\\share\\d\\a": ("\\\\srv\\share\\d", 1), "plain": ("", 0), "rel\\a": ("rel", 1), "D:\\x\\\\y\\a": ("D:\\x\\\\y", 2), "D:\\": ("D:\\", 0), "": ("", 0), "/u/v/w": ("/u/v", 2),
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = {r.p: (r.a, r.d) for r in df.select("p", T.parent_path(F.col("p")).alias("a"), T.path_depth(F.col("p")).alias("d")).collect()}
    assert got == cases
    names = {"a.b.txt": "txt", "none": "", "dot.": "", ".git": "git"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.e for r in df.select("n", T.extension(F.col("n")).alias("e")).collect()} == names


def test_globs(spark):
    import fnmatch

    rng, cases = random.Random(6), []
    for _ in range(300):
        cases.append(("".join(rng.choice("ab*?.") for _ in range(rng.randrange(1, 6))), "".join(rng.choice("ab.\n") for _ in range(rng.randrange(0, 7)))))
    by_pattern = {}
    for p, v in cases:
        by_pattern.setdefault(p, []).append(v)
    for p, values in list(by_pattern.items())[:60]:
        df = spark.createDataFrame([(v,) for v in values], "v string")
        got = [r.m for r in df.select(F.col("v").rlike(T.glob_regex(p, True)).alias("m")).collect()]
        assert got == [fnmatch.fnmatchcase(v, p) for v in values], p


def test_client_rewrites(basics):
    assert compose("a", "audio").startswith("(a) (ext:mp3 OR")
    assert compose('a"b', regex=True) == 'regex:"a\\"b"'
    assert ids(basics, compose("annual", "document")) == [1, 2] and ids(basics, compose("", "folder")) == [4]
    assert ids(basics, compose("project", "folder")) == [4]
    assert ids(basics, compose("annual", "mine", saved={"mine": "!draft"})) == [1]
    assert serve(basics, "file:", SearchOptions(limit=10**9)).count() == 3


def test_run_history(spark, basics):
    past = spark.createDataFrame([("d:\\DOCS\\annual report.PDF", 3, 9)], "path string, run_count long, last_open_time long")
    got = {r.id: r.run_count for r in with_run_history(basics.rows, past).collect()}
    assert got == {1: 3, 2: 0, 3: 0, 4: 0}


def test_plan_keeps_to_the_columns_it_needs(spark, tmp_path):
    from shoal.sources import virtual

    folder = "/root/testdata/sf0.001"
    c = Catalog(virtual.files(spark, folder), now=NOW)
    plan = c.search("size:>1kb", SearchOptions(sort="size"), ["id"])._jdf.queryExecution().toString()
    assert "text" not in plan.split("ReadSchema")[-1] and "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,1024)]" in plan
    assert "TakeOrderedAndProject" in plan


def test_pages_of_a_service_and_while_typing(spark):
    rows = [(i, f"file{i:04d}.txt", f"D:\\file{i:04d}.txt") for i in range(450)]
    c = Catalog(spark.createDataFrame(rows, "id long, name string, path string"))
    options = SearchOptions(limit=400, sort="name")
    each = 80 + 2 * len("file0000.txt") + 2 * len("D:\\file0000.txt")
    got = serve(c, "file", options, most_bytes=each * 7 + each // 2).collect()
    assert [r.id for r in got] == list(range(7)) and serve(c, "file", options).count() == 400
    assert [p.count() for p in interactive(c, "file", options)] == [200, 400]
    assert [p.count() for p in interactive(c, "file00", options)] == [100]
    assert [p.count() for p in interactive(c, "file", SearchOptions(limit=200))] == [200]
