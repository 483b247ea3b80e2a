"""From a parsed query to DataFrame expressions: the predicate, the score, what to join."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from shoal.functions import text as T
from shoal.functions.dates import Bounds
from shoal.model import SearchOptions
from shoal.plans.parser import Both, Node, Not, Query, Term

#: Terms that no text is scored by.
UNSCORED = {"length", "depth", "parent", "child_count", "child_files", "child_folders", "size", "modified", "attributes"}
COUNTS = {"child_count", "child_files", "child_folders"}


class InvalidPattern(ValueError):
    """A regular expression that Java does not take."""


def java_takes(spark: SparkSession, pattern: str) -> bool:
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        return False
    return True


@dataclass
class Compiled:
    predicate: Column
    score: Column
    #: Column of the catalog joined to directories: does any direct child match the term?
    child_flags: dict[str, Column] = field(default_factory=dict)
    needs_counts: bool = False


class Compiler:
    def __init__(self, spark: SparkSession, query: Query, options: SearchOptions):
        self.spark, self.query, self.options = spark, query, options
        pick = lambda own, given: given if own is None else own
        self.sensitive = pick(query.case_sensitive, options.case_sensitive)
        self.whole_word = pick(query.whole_word, options.whole_word)
        self.child_flags: dict[str, Column] = {}
        self.needs_counts = False

    # -- subjects and values --------------------------------------------------------

    def subject(self, column: str) -> Column:
        """A text column as it is compared: lower-cased and without marks as asked."""
        if self.sensitive:
            value = F.col(column)
        elif column in ("name", "path"):
            value = F.col(column + "_lc")
        else:
            value = F.lower(column)
        return value if self.options.match_diacritics else T.strip_marks(value)

    def value(self, text: str) -> str:
        text = text if self.sensitive else text.lower()
        return text if self.options.match_diacritics else T.strip_marks_text(text)

    # -- matching -------------------------------------------------------------------

    def regex(self, column: str, pattern: str) -> Column:
        if self.options.regex_compat and not self.sensitive:
            java = T.java_regex(pattern.lower(), False)
            subject = F.col(column) if self.options.match_diacritics else self.subject(column)
        else:
            java = T.java_regex(pattern, not self.sensitive)
            subject = F.col(column) if self.options.match_diacritics else self.subject(column)
        if not java_takes(self.spark, java):
            raise InvalidPattern(pattern)
        return subject.rlike(java)

    def found(self, column: str, term: Term) -> Column:
        """Substring, pattern or glob of a term somewhere in a column."""
        if term.regex:
            return self.regex(column, term.value)
        value, subject = self.value(term.value), self.subject(column)
        if term.wildcard:
            return subject.rlike(T.glob_regex(value, anchored=False))
        if self.whole_word:
            return F.contains(subject, F.lit(value)) & subject.rlike(T.whole_word_regex(value))
        return F.contains(subject, F.lit(value))

    def listed(self, subject: Column, items: list[str]) -> Column:
        """Equality with an item, or an anchored glob."""
        plain = [i for i in items if "*" not in i and "?" not in i]
        tests = [subject.isin(plain)] if plain else []
        tests += [subject.rlike(T.glob_regex(i, anchored=True)) for i in items if i not in plain]
        return reduce(lambda a, b: a | b, tests)

    def files(self, term: Term) -> Column:
        items = [self.value(i.replace("/", "\\")) for i in term.alternatives]
        paths = [i for i in items if "\\" in i or ":" in i]
        names = [i for i in items if i not in paths]
        tests = [self.listed(self.subject("name"), names)] if names else []
        if paths:
            tests.append(self.listed(F.replace(self.subject("path"), F.lit("/"), F.lit("\\")), paths))
        return reduce(lambda a, b: a | b, tests)

    @staticmethod
    def within(column: Column, b: Bounds) -> Column:
        tests = []
        if b.low is not None and b.low == b.high and b.low_included and b.high_included:
            return column == F.lit(b.low) if b.low < 2**63 else F.lit(False)
        if b.low is not None:
            tests.append(F.lit(False) if b.low >= 2**63 else column >= b.low if b.low_included else column > b.low)
        if b.high is not None and b.high < 2**63:
            tests.append(column <= b.high if b.high_included else column < b.high)
        return reduce(lambda a, c: a & c, tests, F.lit(True))

    def leaf(self, term: Term) -> Column:
        target = term.target
        if target == "any":
            hit = self.found("name", term)
            return hit | self.found("path", term) if self.options.match_path else hit
        if target in ("name", "path"):
            return self.found(target, term)
        if target == "files":
            return self.files(term)
        if target == "ext":
            return self.listed(self.subject("ext"), [self.value(i) for i in term.alternatives])
        if target == "prefix":
            return F.startswith(self.subject("name"), F.lit(self.value(term.value)))
        if target == "suffix":
            return F.endswith(self.subject("name"), F.lit(self.value(term.value)))
        if target == "parent":
            return self.subject("parent_path") == self.value(term.value)
        if target == "child":
            flag = f"child_{len(self.child_flags)}"
            self.child_flags[flag] = self.found("name", term)
            return F.col("directory") & F.coalesce(F.col(flag), F.lit(False))
        if target in COUNTS:
            self.needs_counts = True
            return F.col("directory") & self.within(F.coalesce(F.col(target), F.lit(0)), term.bounds)
        if target == "attributes":
            has = F.col("attributes").bitwiseAND(term.mask) == term.mask
            return ~has if term.absent else has
        column = {"length": F.col("name_len"), "depth": F.col("depth"), "size": F.col("size")}.get(target)
        if column is None:
            column = F.greatest(F.col("last_write_time"), F.lit(0))
        return self.within(column, term.bounds)

    def node(self, node: Node) -> Column:
        if isinstance(node, Not):
            return ~self.node(node.of)
        if isinstance(node, Both):
            parts = [self.node(p) for p in node.parts]
            return reduce((lambda a, b: a | b) if node.any else (lambda a, b: a & b), parts)
        return self.leaf(node)

    # -- score ----------------------------------------------------------------------

    def score(self) -> Column:
        total = F.lit(0)
        for term in self.query.terms:
            if term.excluded or term.target in UNSCORED:
                continue
            if term.regex or term.wildcard:
                total = total + 20
                continue
            value, name = F.lit(self.value(term.value)), self.subject("name")
            points = F.when(name == value, 120).when(F.startswith(name, value), 80).when(F.contains(name, value), 50)
            if term.target == "path" or self.options.match_path:
                points = points.when(F.contains(self.subject("path"), value), 20)
            total = total + points.otherwise(0)
        return total.cast("int")

    def compile(self) -> Compiled:
        predicate = self.node(self.query.root) if self.query.root else F.lit(True)
        if self.query.directories_only is not None:
            kind = F.col("directory") if self.query.directories_only else ~F.col("directory")
            predicate = kind & predicate
        return Compiled(predicate, self.score(), self.child_flags, self.needs_counts)
