"""Empirical-Bayes host reputation and URL rules, in DataFrame functions only.

Labelled outcomes of pages are counted by host. A host's share of good pages is shrunk to that of its registered
domain, this to its suffix, and this to all pages, each through a beta prior whose strength is estimated by moments
from the spread of the groups. A page is allowed if the lower bound of its host's posterior reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: (verdict, rule); a rule is a host, which holds for its subdomains too, and the start of a path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Suffixes of two labels under which domains are registered; every other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
#: Bounds of a prior's strength in pages, standard deviations below the mean, and the least bound of a host that is allowed.
STRENGTH, Z, THRESHOLD = (2.0, 500.0), 1.645, 0.5


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls if none fits. A rule is written ``host/start of path``."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, start = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _tail(host: Column, labels: Column) -> Column:
    parts = F.split(host, r"\.")
    keep = F.least(labels, F.size(parts))
    return F.array_join(F.slice(parts, F.size(parts) - keep + 1, keep), ".")


def host_suffix(host: Column) -> Column:
    return _tail(host, F.when(_tail(host, F.lit(2)).isin(*TWO_LABEL_SUFFIXES), 2).otherwise(1))


def registered_domain(host: Column) -> Column:
    return _tail(host, F.when(_tail(host, F.lit(2)).isin(*TWO_LABEL_SUFFIXES), 3).otherwise(2))


def _strength(groups: DataFrame) -> tuple[float, float]:
    """Mean and prior strength of a level by moments: one row comes back, whatever the number of groups."""
    n, k = F.col("n"), F.col("k")
    seen = groups.where(n > 0)
    total = seen.agg(F.sum(n).alias("n"), F.sum(k).alias("k"), F.count("*").alias("g")).first()
    if not total["n"]:
        return 0.5, STRENGTH[0]
    mean = total["k"] / total["n"]
    spread = mean * (1 - mean)
    squares = seen.agg(F.sum(n * (k / n - F.lit(mean)) * (k / n - F.lit(mean)))).first()[0] / total["n"]
    between = squares - spread * total["g"] / total["n"]
    if between <= 0 or spread <= 0:
        return mean, STRENGTH[1]
    return mean, min(max(spread / between - 1, STRENGTH[0]), STRENGTH[1])


def host_reputation(pages: DataFrame, labels: DataFrame, z: float = Z) -> DataFrame:
    """Per host of the pages: n and k labelled and good pages, posterior mean and lower bound.

    A label belongs to the page whose page_id is its doc_id; each of several labels counts. Null labels and ids count
    nowhere. A host without labels has its domain's prior, and without any labels the mean is one half.
    """
    outcomes = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum((F.col("quality") == 1).cast("int")).alias("k")
    )
    seen = pages.select("page_id", url_host(F.col("url")).alias("host")).join(
        outcomes, F.col("page_id") == F.col("doc_id"), "left"
    )
    hosts = stored(
        seen.groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
        .withColumn("domain", registered_domain(F.col("host")))
        .withColumn("suffix", host_suffix(F.col("host")))
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    (overall, s_suffix), (_, s_domain), (_, s_host) = _strength(suffixes), _strength(domains), _strength(hosts)

    def shrunk(prior: Column, strength: float) -> Column:
        return (F.col("k") + prior * strength) / (F.col("n") + F.lit(strength))

    by_suffix = suffixes.select("suffix", shrunk(F.lit(overall), s_suffix).alias("suffix_mean"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", shrunk(F.col("suffix_mean"), s_domain).alias("domain_mean"))
    a = F.col("k") + F.col("domain_mean") * s_host
    b = F.col("n") - F.col("k") + (1 - F.col("domain_mean")) * s_host
    mean = a / (a + b)
    return hosts.join(by_domain, "domain").select(
        "host", "n", "k", mean.alias("posterior_mean"), (mean - F.lit(z) * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("lower_bound")
    )


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    threshold: float = THRESHOLD,
    z: float = Z,
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict; the longest fitting rule decides, else the host's lower bound.

    A null url, or one without ``://``, has an empty host and path; such pages share the reputation of the empty host.
    The join by host has no hint, so that Spark splits a host that has a large part of the pages.
    """
    reputation = host_reputation(pages.select("page_id", "url"), labels.select("doc_id", "quality"), z)
    host, path = F.col("host"), F.col("path")
    rule, verdict = matching_rule(host, path, rules)
    parsed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    own = F.when(F.col("lower_bound") >= threshold, "allow").otherwise("block")
    return parsed.join(reputation.select("host", "lower_bound"), "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict")
    )
