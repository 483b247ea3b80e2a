"""The search language: words, operators, terms, errors, dates and sizes."""

from datetime import datetime, timezone

import pytest

from shoal.functions.dates import Bounds, Dates, numeric, sizes
from shoal.model import FILETIME_EPOCH, to_filetime
from shoal.plans import content_query
from shoal.plans.parser import Both, Not, QueryError, Term, lex, parse

NOW = datetime(2024, 2, 15, 12, 30, tzinfo=timezone.utc)  # a Thursday


def q(text):
    return parse(text, NOW)


def shape(node):
    if isinstance(node, Not):
        return ("not", shape(node.of))
    if isinstance(node, Both):
        return ("or" if node.any else "and", *map(shape, node.parts))
    return node.value


def test_operators_and_precedence():
    assert shape(q("a b|c").root) == ("or", ("and", "a", "b"), "c")
    assert shape(q("a NOT b OR (c && d)").root) == ("or", ("and", "a", ("not", "b")), ("and", "c", "d"))
    assert shape(q("not not a").root) == ("not", ("not", "a"))
    assert shape(q("!a ! b").root) == ("and", ("not", "a"), ("not", "b"))
    assert shape(q("<a|b> c || d").root) == ("or", ("and", ("or", "a", "b"), "c"), "d")
    assert shape(q('"a b" "say \\"hi\\""').root) == ("and", "a b", 'say "hi"')
    assert shape(q("a AND b And c").root) == ("and", "a", "b", "c")


def test_quotes_do_not_protect_operator_words():
    assert shape(q('a "and" b').root) == ("and", "a", "b")
    assert q('"file:"').directories_only is False
    assert shape(q('"!x"').root) == ("not", "x")


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ('"open', "unterminated quote"),
        ("a )", "unmatched closing parenthesis"),
        ("( )", "unexpected closing parenthesis"),
        ("(a", "unmatched opening parenthesis"),
        ("OR a", "binary operator without left operand"),
        ("a OR", "query ends with an operator"),
        ("a OR file:", "query ends with an operator"),
        ("<ext:cpp|ext:h>", "unmatched opening parenthesis"),
        ("case:maybe", "invalid case option"),
        ("wholeword:", "invalid whole-word option"),
        ("count:x", "invalid result count"),
        ("dupe:path", "invalid duplicate mode"),
        ("ext:a;;b", "empty extension list item"),
        ("filelist:a|", "empty file list item"),
        ("name:", "empty scoped query term"),
        ("len:x", "invalid filename length expression"),
        ("depth:", "invalid path depth expression"),
        ("childcount:a", "invalid child count expression"),
        ("size:5zb", "invalid size expression"),
        ("dm:never", "invalid date expression"),
        ("attr:shiny", "invalid attribute name"),
        ('parent:"D:\\"', "unterminated quote"),
    ],
)
def test_errors(text, error):
    if error == "empty file list item":
        text = f'"{text}"'
    with pytest.raises(QueryError, match=error):
        q(text)


def test_angle_group_closes_before_a_scoped_word_with_a_space():
    assert [k for k, _ in lex("<ext:cpp|ext:h >")] == ["(", "word", "or", "word", ")"]
    assert len(q("<ext:cpp|ext:h >").terms) == 2


def test_directives_hold_wherever_they_stand():
    found = q("folder: a count:3 case:on file: wholeword:yes DUPE:Name_Size count:7")
    assert (found.directories_only, found.max_results, found.case_sensitive, found.whole_word, found.duplicates) == (False, 7, True, True, "name_size")
    assert [t.value for t in found.terms] == ["a"]
    assert q("!file:").directories_only is False
    assert q("").root is None and q("not").terms == []


def test_terms():
    one = lambda t: q(t).terms[0]
    assert one("ext:.CPP;h*") == Term("ext", "CPP", ("CPP", "h*"), wildcard=True)
    assert one('filelist:"a b.txt|c"').alternatives == ("a b.txt", "c")
    assert one("!regex:^a") == Term("any", "^a", regex=True, excluded=True)
    assert one("unknown:x").value == "unknown:x"
    assert one("attr:hidden,RO").mask == 3 and one("attr:!h").absent
    assert one("root:").bounds == Bounds(0, high=0) and one("empty:").target == "child_count"
    assert one("infolder:C:\\x").target == one("nosubfolders:C:\\x").target == "parent"
    assert one("childfoldercount:>2").target == "child_folders"
    assert one("parents:1..2").bounds == Bounds(1, high=2)


def test_numbers_and_sizes():
    assert numeric("5") == numeric("=5") == Bounds(5, high=5)
    assert numeric(">=5") == Bounds(5) and numeric("<5") == Bounds(high=5, high_included=False)
    assert numeric("3-7") == numeric("3..7") == Bounds(3, high=7)
    assert numeric("7-3") is None and numeric("-3") is None and numeric(str(2**64)) is None
    assert sizes("2KiB..1m") == Bounds(2048, high=1 << 20)
    assert sizes(">1g") == Bounds(1 << 30, low_included=False)
    assert sizes("Empty") == Bounds(0, high=0) and sizes("tiny") == Bounds(0, False, 10240)
    assert sizes("gigantic") == Bounds(128 << 20, False) and sizes("1.5k") is None


def ticks(*args):
    return to_filetime(datetime(*args, tzinfo=timezone.utc))


def test_filetime():
    assert ticks(1970, 1, 1) == FILETIME_EPOCH and ticks(2024, 1, 1) == 133_485_408_000_000_000


@pytest.mark.parametrize(
    ("text", "low", "high"),
    [
        ("today", (2024, 2, 15), (2024, 2, 16)),
        ("Yesterday", (2024, 2, 14), (2024, 2, 15)),
        ("thisweek", (2024, 2, 12), (2024, 2, 16)),
        ("lastweek", (2024, 2, 5), (2024, 2, 12)),
        ("nextweek", (2024, 2, 19), (2024, 2, 26)),
        ("currentmonth", (2024, 2, 1), (2024, 2, 16)),
        ("prevmonth", (2024, 1, 1), (2024, 2, 1)),
        ("comingmonth", (2024, 3, 1), (2024, 4, 1)),
        ("thisyear", (2024, 1, 1), (2024, 2, 16)),
        ("lastyear", (2023, 1, 1), (2024, 1, 1)),
        ("nextyear", (2025, 1, 1), (2026, 1, 1)),
        ("feb", (2024, 2, 1), (2024, 3, 1)),
        ("december", (2024, 12, 1), (2025, 1, 1)),
        ("sunday", (2024, 2, 18), (2024, 2, 19)),
        ("mon", (2024, 2, 12), (2024, 2, 13)),
        ("2024-02-29", (2024, 2, 29), (2024, 3, 1)),
        ("next2days", (2024, 2, 15, 12, 30), (2024, 2, 17, 12, 30)),
        ("coming90mins", (2024, 2, 15, 12, 30), (2024, 2, 15, 14, 0)),
    ],
)
def test_date_intervals(text, low, high):
    assert Dates(NOW).parse(text) == Bounds(ticks(*low), high=ticks(*high), high_included=False)


@pytest.mark.parametrize(
    ("text", "low"),
    [
        ("pastweek", (2024, 2, 8, 12, 30)),
        ("pastmonth", (2024, 1, 15, 12, 30)),
        ("pastyear", (2023, 2, 15, 12, 30)),
        ("last3months", (2023, 11, 15, 12, 30)),
        ("prev2years", (2022, 2, 15, 12, 30)),
        ("past36hours", (2024, 2, 14, 0, 30)),
    ],
)
def test_rolling_dates_are_open_above(text, low):
    assert Dates(NOW).parse(text) == Bounds(ticks(*low))


def test_date_details():
    assert Dates(datetime(2024, 3, 31, tzinfo=timezone.utc)).parse("last1months") == Bounds(ticks(2024, 2, 29))
    assert Dates(datetime(2024, 2, 29, tzinfo=timezone.utc)).parse("pastyear") == Bounds(ticks(2023, 2, 28))
    assert Dates(NOW, first_day_of_week=6).parse("thisweek").low == ticks(2024, 2, 11)
    d = Dates(NOW)
    assert d.parse(">=2024-01-02T03:04") == Bounds(ticks(2024, 1, 2, 3, 4))
    for bad in ("last0days", "last1day", "2024-02-30", "2024-01-01..2024-02-01", ">=today", "2024-1-1"):
        assert d.parse(bad) is None


def test_content_queries():
    leaf = content_query.Leaf
    tree = content_query.parse
    assert tree('red "blue sky" gre*') == content_query.Op("and", (leaf(("red",)), leaf(("blue", "sky")), leaf(("gre",), True)))
    assert tree("a OR b c").kind == "or" and tree("a XOR b").kind == "xor"
    assert tree("+a -b c") == content_query.Op("and", (leaf(("a",)), leaf(("c",)), content_query.Op("not", (leaf(("b",)),))))
    assert tree("NOT a") == content_query.Op("not", (leaf(("a",)),))
    assert tree("(a OR b) AND c)").kind == "and" and tree(" ... ") is None and tree("") is None
    assert tree("你好") == leaf(("你", "好"))
    assert dict(content_query.leaves(tree("a NOT b"))) == {leaf(("a",)): True, leaf(("b",)): False}
