"""URL filters: explicit rules, and empirical-Bayes host reputation for the rest.

Rules are (verdict, host and path prefix); a rule fits its host and all its subdomains when the
url's path starts with its path, and the longest rule wins.  Rules meet the distinct hosts in a
join on the host's parents, so their number is not bounded.

Reputation: pages with a label have an outcome (good or bad).  Counts of pages and good
pages are summed by host, registered domain (the label before the public suffix) and
public suffix.  Good rates are shrunk from suffix to domain to host through
beta-binomial priors: a level's prior has its parent's shrunk rate as mean and a strength
estimated from the corpus by a nested analysis of variance.  With k good of n,
``A = sum k^2 / n`` over the units of a level and ``c`` its units, the mean squares are
``MSB = (A - A_parent) / (c - c_parent)`` and ``MSW = (K - A) / (N - c)``, the mean size is
``n0 = (N - sum n^2 / n_parent) / (c - c_parent)``, the intra-class correlation is
``rho = (MSB - MSW) / (MSB + (n0 - 1) MSW)``, held to 0.05 .. 0.5, and the strength is
``1 / rho - 1``: a prior counts as 19 pages at most.  Sums are taken in decimals, so they do not depend on the order of rows.

A host is blocked when the upper posterior bound of its good rate (mean plus ``z`` standard
deviations of the beta posterior) is under the corpus' own good rate less ``margin``: when even a
lenient reading of the evidence says that its pages are worse than the average page.  A host
without outcomes inherits its domain's and suffix's rate with the prior's wide spread.

The public suffix is the longest of the last three labels that ``suffixes`` has, else the last label; user
names and ports are no part of it.  A host of digits and dots is its own domain, of suffix ''.

All of it is DataFrame operations.  Outcomes are summed map-side by host; the join
of pages to hosts carries urls only, and adaptive execution splits a hot host.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no
rule and is judged as a page of the host with the empty name; labels without a page and pages without a label are no
outcomes; several labels of a page count as one, bad if any is; null labels count as
no label; repeated page rows stay and count once each; without any labelled page
the verdict is allow; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Posterior standard deviations, and how far below the corpus' good rate the bound must be.
Z, MARGIN = 1.0, 0.0
#: Bounds of the intra-class correlation.  Hosts of a corpus that hardly differ would get priors that
#: no host's own pages can move; the least value lets 20 pages outweigh any prior.
RHO = (0.05, 0.5)
#: Public suffixes of two labels that are used most.  A full list can be given instead.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp",
    "co.kr", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.za",
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without a user name and a port."""
    return F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*\z", "")


def suffix_of(name: Column, suffixes=SUFFIXES) -> Column:
    """The public suffix of a host's name."""
    last = lambda n: F.substring_index(name, ".", -n)
    known = list(suffixes) or [""]
    found = F.when(last(3).isin(known), last(3)).when(last(2).isin(known), last(2)).otherwise(last(1))
    return F.when(name.rlike(r"^[0-9.]+\z"), F.lit("")).otherwise(found)


def domain_of(name: Column, suffix: Column) -> Column:
    """The registered domain of a name: its suffix and one label more."""
    labels = F.size(F.split(suffix, r"\.")) + 1
    parts = F.split(name, r"\.")
    known = F.array_join(F.slice(parts, F.greatest(F.size(parts) - labels + 1, F.lit(1)), labels), ".")
    return F.when(suffix == "", name).otherwise(known)


RULES = "array<struct<own:string,size:int,rule:string,prefix:string,verdict:string>>"


def rules_of(hosts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """host, rules (array of length, rule, prefix, verdict) of the hosts that rules fit by name."""
    rows = [dict(own=text.partition("/")[0], size=len(text), rule=text, prefix=text[len(text.partition("/")[0]) :], verdict=what) for what, text in rules]
    known = hosts.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), RULES)))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = hosts.select("host", F.explode(parents).alias("own")).join(known, "own")
    return met.groupBy("host").agg(F.collect_list(F.struct("size", "rule", "prefix", "verdict")).alias("rules"))


def best_rule(path: Column, rules: Column) -> Column:
    """The longest of the host's rules that fits the path (the last by text of equal ones); null if none does."""
    return F.array_max(F.filter(rules, lambda r: F.startswith(path, r["prefix"])))


def outcomes(pages: DataFrame, labels: DataFrame, good: Column) -> DataFrame:
    """host, n, k: labelled pages and good ones of each host.  ``labels`` has page_id; ``good`` is of its columns."""
    marks = labels.select(F.col("page_id"), good.alias("good")).filter("page_id is not null and good is not null")
    marks = marks.groupBy("page_id").agg(F.min(F.col("good").cast("int")).alias("good"))
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host"))
    hosts = hosts.join(marks, "page_id", "left").groupBy("host")
    return hosts.agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))


def strengths(levels: list[tuple[float, float, float]], n: float, k: float) -> tuple[float, list[float]]:
    """Global good rate and the prior strength of each level, outermost first.  ``levels``
    holds sum(k^2 / n), sum(n^2 / n of the parent) and the number of units with outcomes."""
    rate = k / n if n else 1.0
    above, units_above, found = k * rate, 1.0, []
    for squares, sizes, units in levels:
        more, rho = units - units_above, 0.0
        if more > 0 and n > units:
            between, within = (squares - above) / more, (k - squares) / (n - units)
            whole = between + ((n - sizes) / more - 1) * within
            rho = (between - within) / whole if whole > 0 else 0.0
        found.append(1 / min(max(rho, RHO[0]), RHO[1]) - 1)
        above, units_above = squares, units
    return rate, found


def reputation(hosts: DataFrame, suffixes=SUFFIXES) -> tuple[DataFrame, float]:
    """(host, n, k and the beta posterior of each host: a, b, mean, upper), and the corpus' good rate."""
    name = name_of(F.col("host"))
    units = hosts.withColumn("suffix", suffix_of(name, suffixes))
    units = written(units.withColumn("domain", domain_of(name, F.col("suffix"))), "hosts")
    domains = units.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    tops = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    n, k = (float(x or 0) for x in tops.agg(F.sum("sn"), F.sum("sk")).first())

    def sums(df: DataFrame, own: str, good: str, parent) -> tuple[float, ...]:
        exact = lambda c: F.sum(c.cast("decimal(38,9)"))
        own_n, own_k = F.col(own).cast("double"), F.col(good).cast("double")
        row = df.filter(F.col(own) > 0).agg(exact(own_k * own_k / own_n), exact(own_n * own_n / parent), F.count(F.lit(1))).first()
        return tuple(float(x or 0) for x in row)

    rows = [
        sums(tops, "sn", "sk", F.lit(n)),
        sums(domains.join(tops, "suffix"), "dn", "dk", F.col("sn")),
        sums(units.join(domains, ["domain", "suffix"]), "n", "k", F.col("dn")),
    ]
    rate, (ms, md, mh) = strengths(rows, n, k)
    tops = tops.withColumn("srate", (ms * F.lit(rate) + F.col("sk")) / (ms + F.col("sn")))
    domains = domains.join(tops, "suffix").withColumn("drate", (md * F.col("srate") + F.col("dk")) / (md + F.col("dn")))
    out = units.join(domains.select("domain", "suffix", "drate"), ["domain", "suffix"])
    out = out.withColumns({"a": mh * F.col("drate") + F.col("k"), "b": mh * (1 - F.col("drate")) + F.col("n") - F.col("k")})
    out = out.withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("a") + F.col("b") + 1))
    return out.withColumn("upper", F.col("mean") + Z * spread), rate


def judge(pages: DataFrame, labels: DataFrame, good: Column, rules: list[tuple[str, str]], suffixes=SUFFIXES, margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule, verdict, n, good_mean, good_upper of every page."""
    known, rate = reputation(outcomes(pages, labels, good), suffixes)
    known = known.select("host", "n", F.col("mean").alias("good_mean"), F.col("upper").alias("good_upper"))
    known = known.join(rules_of(known.select("host"), rules), "host", "left")
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    by_host = F.when(F.col("good_upper") < rate - margin, "block").otherwise("allow")
    met = urls.join(known, "host", "left").withColumn("met", best_rule(F.col("path"), F.col("rules")))
    return met.select(
        "page_id", "host", "path", F.col("met.rule").alias("rule"), F.coalesce("met.verdict", by_host).alias("verdict"), "n", "good_mean", "good_upper"
    )
