"""Operator 7: allow or block urls by rules, and hosts without a rule by empirical-Bayes reputation.

Labelled pages give each host a number of outcomes and of bad ones. Bad rates shrink through beta-binomial priors along
all pages -> suffix -> registered domain -> host. All pages have the prior Beta(root_rate x root_pages, ...). A group's prior has its
parent's posterior mean m and a concentration k, its posterior mean is (bad + k m) / (n + k), and its variance is that of the
beta posterior plus (k / (n + k))^2 times the parent's, so the bound knows how little is known of the parents, too.
k = 1/rho - 1; rho is the moment estimate over the groups of a level, each about its own parent's mean:
E[n (bad/n - m)^2 / (m (1 - m))] = 1 + (n - 1) rho. Rates are kept off 0 and 1 by the prior of all pages.
A host is blocked if the lower `z` bound of its bad rate is above `bad_rate`. A host of a bad domain is blocked before it has
outcomes of its own, and one bad page blocks no host of a domain without others.

Outcomes are summed per host before any shuffle, so a host with a third of all pages costs a task no more than another;
the blocked hosts are joined back to the pages, those with very many pages by broadcast (fewer than 1,000 rows).

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end. A null
url, or one without `://`, has neither, fits no rule and is allowed unless pages without host have a bad reputation. Repeated
pages are judged alike; a page counts as bad if any of its labels says so. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semrank.llm.common import lookup, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: Suffixes of two labels, where the caller has no table of its own.
TWO_LABEL = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "gov.uk", "net.au", "org.au", "org.uk")


@dataclass(frozen=True)
class Reputation:
    #: (host and path prefix, verdict)
    rules: tuple[tuple[str, str], ...] = ()
    bad_rate: float = 0.5
    z: float = 1.645
    most_concentration: float = 10_000.0
    #: Concentration where no group has two outcomes.
    default_concentration: float = 10.0
    #: Prior of all pages: bad rate, and the number of pages that it counts as.
    root_rate: float = 0.1
    root_pages: float = 20.0
    #: Public suffixes of two labels; every other suffix has one.
    two_label: tuple[str, ...] = TWO_LABEL


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def suffix(host: Column, two_label: tuple[str, ...] = TWO_LABEL) -> Column:
    """Last label or two of the host without port; an address is its own suffix."""
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(bare.rlike(r"^[0-9.]+$"), bare).when(two.isin(*two_label), two).otherwise(F.substring_index(bare, ".", -1))


def domain(host: Column, suffix: Column) -> Column:
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    return F.when(bare == suffix, bare).when(F.contains(suffix, F.lit(".")), F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def concentration(groups: DataFrame, p: Reputation) -> float:
    """k of a level's groups (n, bad, prior: the parent's mean)."""
    m = F.col("prior")
    x = groups.where("n > 0").agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - m, F.lit(2)) / (m * (1 - m))).alias("s")).first()
    if not x.g or x.n == x.g:
        return p.default_concentration
    rho = (x.s - x.g) / (x.n - x.g)
    return min(p.most_concentration, max(1.0, 1 / rho - 1)) if rho > 0 else p.most_concentration


def _shrunk(groups: DataFrame, p: Reputation) -> DataFrame:
    """groups (n, bad, prior, prior_var) with mean and var of their bad rates."""
    k = concentration(groups, p)
    mean = (F.col("bad") + k * F.col("prior")) / (F.col("n") + k)
    got = groups.withColumn("mean", mean)
    own = F.col("mean") * (1 - F.col("mean")) / (F.col("n") + k + 1)
    return got.withColumn("var", own + F.pow(k / (F.col("n") + k), F.lit(2)) * F.col("prior_var"))


def posteriors(outcomes: DataFrame, p: Reputation = Reputation()) -> DataFrame:
    """outcomes (host, n, bad), one row per host: host, n, bad, posterior_mean, bound of the bad rate."""
    hosts = outcomes.withColumn("suffix", suffix(F.col("host"), p.two_label)).withColumn("domain", domain(F.col("host"), F.col("suffix")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    root = (total.bad + p.root_rate * p.root_pages) / (total.n + p.root_pages)
    by_suffix = _shrunk(suffixes.withColumns({"prior": F.lit(root), "prior_var": F.lit(root * (1 - root) / (total.n + p.root_pages + 1))}), p)

    def under(parents: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
        return _shrunk(groups.join(parents.select(*on, F.col("mean").alias("prior"), F.col("var").alias("prior_var")), on), p)

    found = under(under(by_suffix, domains, ["suffix"]), hosts, ["suffix", "domain"])
    return found.select("host", "n", "bad", F.col("mean").alias("posterior_mean"), (F.col("mean") - p.z * F.sqrt("var")).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, p: Reputation = Reputation()) -> DataFrame:
    """pages (page_id, url) with outcomes (page_id, bad boolean): page_id, host, path, rule, verdict."""
    pages = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    marks = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counts = pages.join(marks, "page_id", "left").groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.count_if("bad").alias("bad"))
    counted = stored(counts, "hosts")
    blocked = posteriors(counted.drop("pages"), p).where(F.col("bound") > p.bad_rate).select("host", F.lit("block").alias("by_host"))
    sized = stored(counted.select("host", "pages").join(blocked, "host", "left"), "reputation")
    rule, verdict = rule_of(F.col("host"), F.col("path"), p.rules)
    judged = lookup(pages, sized, ["host"], "pages")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "by_host", F.lit("allow")).alias("verdict"))
