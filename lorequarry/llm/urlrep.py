"""Host reputation by empirical Bayes (DataFrame operations only).

Page outcomes (1: bad) are counted per host, registered domain and suffix. Each level's rate
is shrunk toward its parent's through a beta prior whose weight is estimated from the spread
of the level's rates (method of moments); a host is refused if the lower posterior bound of
its bad rate reaches ``threshold``.

A page that a rule fits takes the rule's verdict; those verdicts are the labelled outcomes
from which the reputation of all hosts is learnt, so pages that no rule fits follow what the
rules say about their host's relatives.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no
rule, and belongs to the host ``''``; with no labelled page at all everything is allowed;
repeated rows each get their row; other input columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: (host, path, verdict); a bounded list that is part of the plan.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
STRONGEST = 1000.0
WEAKEST = 1.0
SUMS = ("n", "y", "yy", "nn", "groups")


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as struct(rule, verdict), else null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _spread(level: DataFrame) -> list[Column]:
    """Sums for the weight of a level's prior; all are sums of small counts."""
    n, y = F.col("n").cast("double"), F.col("bad").cast("double")
    sums = F.sum(n), F.sum(y), F.sum(F.when(n > 0, y * y / n)), F.sum(n * n), F.count(F.when(n > 0, 1))
    return [c.alias(name) for c, name in zip(sums, SUMS, strict=True)]


def prior_weight(n: float, bad: float, sum_y2_n: float, sum_n2: float, groups: int) -> float:
    """Method of moments: the beta prior's a + b for groups with rates that spread so."""
    if not n or groups < 2:
        return STRONGEST
    mean = bad / n
    within = mean * (1 - mean)
    between = (sum_y2_n - n * mean * mean - (groups - 1) * within) / (n - sum_n2 / n) if n * n > sum_n2 else 0.0
    if between <= 0 or within <= 0:
        return STRONGEST
    return min(STRONGEST, max(WEAKEST, within / between - 1))


def reputation(outcomes: DataFrame, z: float = 1.645, threshold: float = 0.5) -> DataFrame:
    """outcomes: host, bad (1, 0, or null if unlabelled), a row per page. Returns a row per
    host: host, n, bad, rate (posterior mean), bound (lower), refused.

    Pages are counted once, into a written table of hosts (a hot host is one row of each task before
    the exchange); the other levels are made from it, and one job gives the spreads of all three."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialize(hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    sums = [level.agg(*_spread(level)).select(F.lit(i).alias("level"), F.array([F.col(c).cast("double") for c in SUMS]).alias("sums")) for i, level in enumerate((hosts, domains, suffixes))]
    by_level = [[x or 0.0 for x in r["sums"]] for r in sorted(reduce(DataFrame.unionByName, sums).collect())]  # three rows
    weights = [prior_weight(*sums) for sums in by_level]
    n, bad = by_level[-1][:2]
    base = (bad + 0.5) / (n + 1.0) if n else 0.0
    w_host, w_domain, w_suffix = weights
    suffixes = suffixes.select("suffix", ((F.col("bad") + w_suffix * base) / (F.col("n") + w_suffix)).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("bad") + w_domain * F.col("suffix_rate")) / (F.col("n") + w_domain)).alias("domain_rate"))
    a = F.col("bad") + w_host * F.col("domain_rate")
    b = F.col("n") - F.col("bad") + w_host * (1 - F.col("domain_rate"))
    rate = a / (a + b)
    bound = F.greatest(F.lit(0.0), rate - z * F.sqrt(rate * (1 - rate) / (a + b + 1)))
    return hosts.join(domains, "domain").select("host", "n", "bad", rate.alias("rate"), bound.alias("bound"), (bound >= threshold).alias("refused"))


def filter_urls(pages: DataFrame, rules=RULES, z: float = 1.645, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's posterior rate and bound."""
    host, path = split_url(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    labelled = judged.select("host", F.when(F.col("hit").isNotNull(), (F.col("hit.verdict") == "block").cast("int")).alias("bad"))
    hosts = reputation(labelled, z, threshold).select("host", "rate", "bound", "refused")
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("refused"), "block").otherwise("allow"))
    # hosts are sent while Spark's own size limit allows it; beyond it a hot host is split by the adaptive join
    return judged.join(hosts, "host", "left").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "rate", "bound")
