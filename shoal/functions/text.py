"""Text and path expressions; everything here is a Column built of Spark's own functions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@cache
def _accents() -> tuple[str, str]:
    """Characters of the basic plane that decompose to a base and marks, and their bases."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        c = chr(code)
        parts = [p for p in unicodedata.normalize("NFD", c) if unicodedata.category(p) != "Mn"]
        if len(parts) == 1 and parts[0] != c and not 0xAC00 <= code <= 0xD7A3:
            source.append(c)
            target.append(parts[0])
    return "".join(source), "".join(target)


def strip_marks(value: Column) -> Column:
    """The text without diacritics."""
    source, target = _accents()
    return F.regexp_replace(F.translate(value, source, target), r"\p{Mn}+", "")


def strip_marks_text(value: str) -> str:
    source, target = _accents()
    plain = value.translate(str.maketrans(source, target))
    return "".join(c for c in plain if unicodedata.category(c) != "Mn")


def extension(name: Column) -> Column:
    """What follows the last dot; none or nothing after it gives ''."""
    return F.regexp_extract(name, r"(?s)\.([^.]+)$", 1)


def parent_path(path: Column) -> Column:
    """The part before the last separator; a drive root keeps its separator."""
    trimmed = F.concat(F.substring(path, 1, 3), F.regexp_replace(F.substr(path, F.lit(4)), r"[\\/]+\z", ""))
    cut = F.regexp_extract(trimmed, r"(?s)^(.*)[\\/][^\\/]*$", 1)
    return F.when(F.substring(trimmed, 1, 3).rlike(r"(?s)^.:[\\/]") & (F.length(cut) == 2), F.substring(trimmed, 1, 3)).otherwise(cut)


def path_depth(path: Column) -> Column:
    """Components of the parent path below its drive or its server and share."""
    parent = parent_path(path)
    below = F.when(parent.rlike(r"(?s)^.:[\\/]"), F.substr(parent, F.lit(4))).when(
        parent.rlike(r"^[\\/]{2}"), F.regexp_replace(parent, r"(?s)^[\\/]{2}[^\\/]*([\\/][^\\/]*)?", "")
    ).otherwise(parent)
    return F.size(F.filter(F.split(below, r"[\\/]"), lambda c: c != ""))


def utf16_length(value: Column) -> Column:
    return F.floor(F.octet_length(F.encode(value, "UTF-16BE")) / 2).cast("int")


def natural_key(value: Column) -> Column:
    """A string whose binary order is natural order: runs of digits compare by value, then
    by fewer leading zeros, and other characters by their lower case."""

    def key(run: Column) -> Column:
        digits = F.ltrim(run, F.lit("0"))
        return F.when(
            run.rlike("^[0-9]"),
            F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 5, "0"), digits, F.lpad(F.length(run).cast("string"), 5, "0")),
        ).otherwise(run)

    runs = F.regexp_extract_all(F.lower(value), F.lit(r"(?s)([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, key), "")


def escape_regex(value: str) -> str:
    return "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c if c.isprintable() and c != " " else f"\\x{ord(c):02x}" for c in value)


def glob_regex(pattern: str, anchored: bool) -> str:
    """A Java pattern for ``*`` and ``?``."""
    body = "".join(".*" if c == "*" else "." if c == "?" else escape_regex(c) for c in pattern)
    return f"(?s)^{body}\\z" if anchored else f"(?s){body}"


def whole_word_regex(value: str) -> str:
    return rf"(?<![\p{{L}}\p{{N}}_]){escape_regex(value)}(?![\p{{L}}\p{{N}}_])"


#: POSIX bracket classes of ECMAScript patterns, as Java has them (fixed values).
POSIX = {
    "alpha": r"\p{L}", "digit": r"\d", "alnum": r"\p{L}\p{N}", "space": r"\s", "upper": r"\p{Lu}",
    "lower": r"\p{Ll}", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "blank": r"\p{Blank}",
    "cntrl": r"\p{Cntrl}", "print": r"\p{Print}", "graph": r"\p{Graph}", "d": r"\d", "w": r"\w", "s": r"\s",
}


def java_regex(pattern: str, ignore_case: bool) -> str:
    """An ECMAScript pattern in Java's syntax: ``$`` means the very end, POSIX classes become
    properties, and '[' and '&&' inside a class are plain."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            out.append(pattern[at : at + 2])
            at += 2
            continue
        if inside and pattern.startswith("[:", at) and (end := pattern.find(":]", at)) > 0 and pattern[at + 2 : end] in POSIX:
            out.append(POSIX[pattern[at + 2 : end]])
            at = end + 2
            continue
        if inside:
            out.append({"[": "\\[", "&": "\\&"}.get(c, c))
            inside = c != "]"
        elif c == "[":
            out.append(c)
            inside = True
            if pattern.startswith("^", at + 1):
                out.append("^")
                at += 1
        else:
            out.append(r"\z" if c == "$" else c)
        at += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)


def enrich(catalog: DataFrame) -> DataFrame:
    """The catalog with its derived columns.  They are expressions: what a query does not
    read is never computed.  A catalog written with them is read with them."""
    derived = {
        "name_lc": F.lower("name"),
        "path_lc": F.lower("path"),
        "ext": extension(F.col("name")),
        "parent_path": parent_path(F.col("path")),
        "depth": path_depth(F.col("path")),
        "name_len": utf16_length(F.col("name")),
        "name_nat": natural_key(F.col("name")),
        "path_nat": natural_key(F.col("path")),
    }
    return catalog.withColumns({k: v for k, v in derived.items() if k not in catalog.columns})
