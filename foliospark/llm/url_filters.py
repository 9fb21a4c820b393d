"""URL filters: listed rules first, then Empirical-Bayes host reputation.

Labelled page outcomes are counted by host, and shrunk through beta-binomial
priors from host to registered domain to suffix to the whole corpus. The
concentration of each level's prior is fitted by moments, in which a group weighs
by its pages less one, so one hot host doesn't decide alone. A host is blocked by
the lower posterior bound of its rate of bad pages: the beta posterior's quantile, on the
arcsine scale, where its spread hardly depends on the rate, and so never outside 0 to 1.
It is blocked where the bound reaches a fixed threshold, or one from the data: the
worst hosts by bound, up to a share of all pages.

Suffixes: the last label, or the last two where a registry's word stands before a
country's two letters (co.uk, com.cn, gov.br), or a suffix that is given, such as
that of a hosting site under which anyone may register names.

Scale: two narrow columns of pages are shuffled once by page id, then only
counts per host, domain and suffix. Hot hosts are summed before the shuffle;
the last join sends one row a host to the pages, and AQE can split its skew.

Defined cases: null or schemeless urls have empty host and path; they form the
host "". A page id found twice is judged twice; labels of a page are summed.
Empty labels leave the prior mean 0, so nothing is blocked but by rule. Labels of
no page and other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.shared import lower_ascii, stored

#: Bounds are compared in steps of 1 / STEPS where hosts are ranked.
STEPS = 10_000
#: Second-level words of registries, before two letters.
REGISTRY = "ac|asn|co|com|edu|gob|gov|gouv|id|info|ltd|me|mil|ne|net|nhs|nom|or|org|plc|police|sch"
#: Suffixes under which strangers register names.
SHARED_SUFFIXES = ("github.io", "gitlab.io", "blogspot.com", "wordpress.com", "netlify.app", "herokuapp.com", "appspot.com", "web.app")
#: (verdict, host and path); the longest that fits wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. For short written lists of rules."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _suffix(name: Column, shared: Sequence[str]) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(two.rlike(rf"^(?:{REGISTRY})\.[a-z][a-z]$") | two.isin(*shared), two).otherwise(F.substring_index(name, ".", -1))


def _domain(name: Column, suffix: Column) -> Column:
    labels = F.when(suffix.contains("."), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return F.when(name.rlike(r"^[0-9.]+$"), name).otherwise(labels)


def _concentration(level: DataFrame) -> float:
    """Prior strength of a level with n, k and the parent's mean m: moments of the beta-binomial, divided by n. At least one page's worth."""
    n, k, m = F.nullif("n", F.lit(0)), F.col("k"), F.col("m")
    extra = F.sum(F.pow(k - n * m, 2) / n - m * (1 - m))
    room = F.sum((n - 1) * m * (1 - m))
    rho = F.greatest(F.lit(0.001), F.least(F.lit(0.5), F.coalesce(F.when(room > 0, extra / room), F.lit(0.1))))
    return level.agg(((1 - rho) / rho).alias("c")).first().c


def _shrunk(level: DataFrame) -> tuple[DataFrame, float]:
    """The level with its posterior mean as m, and its prior's strength."""
    c = _concentration(level)
    return level.withColumn("m", (F.col("k") + c * F.col("m")) / (F.col("n") + c)), c


def posterior_bound(mean: Column, pages: Column, z: float = 1.645) -> Column:
    """Lower quantile of a beta with this mean whose two parameters sum to ``pages``."""
    return F.pow(F.sin(F.greatest(F.lit(0.0), F.asin(F.sqrt(mean)) - z / (2 * F.sqrt(pages + 1)))), 2)


def host_reputation(outcomes: DataFrame, shared: Sequence[str] = SHARED_SUFFIXES) -> DataFrame:
    """outcomes: host, n (labelled pages), k (bad ones); one row a host. Returns host, n, k, posterior_mean, posterior_bound."""
    name = F.regexp_replace("host", r"^.*@|:[0-9]*$", "")
    hosts = outcomes.select("host", "n", "k", _suffix(name, shared).alias("suffix"), _domain(name, _suffix(name, shared)).alias("domain"))
    domains = stored(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffixes")
    overall = suffixes.agg(F.coalesce(F.sum("k") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("m")).first().m
    above, _ = _shrunk(suffixes.withColumn("m", F.lit(overall)))
    above, _ = _shrunk(domains.join(above.select("suffix", "m"), "suffix"))
    level, c = _shrunk(hosts.join(above.select("suffix", "domain", "m"), ["suffix", "domain"]))
    return level.select("host", "n", "k", F.col("m").alias("posterior_mean"), posterior_bound(F.col("m"), F.col("n") + c).alias("posterior_bound"))


def worst_bound(known: DataFrame, rate: float, budget: float, least: int) -> int | None:
    """known: host, n, k, pages, posterior_bound. The lowest bound, in steps of 1 / STEPS, that hosts worse than the corpus may have so that those from it on hold ``budget`` of all pages at most; None if no bound is so high.

    A histogram of bounds has STEPS + 1 rows at most, however many hosts there are.
    """
    all_pages = known.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    bins = known.filter(_stands_out(rate, least)).groupBy(_step().alias("step")).agg(F.sum("pages").alias("pages"))
    upto = bins.withColumn("pages", F.sum("pages").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("step"))))
    return upto.filter(F.col("pages") <= budget * all_pages).agg(F.min("step")).first()[0]


def _step() -> Column:
    return F.floor(F.col("posterior_bound") * STEPS)


def _stands_out(rate: float, least: int) -> Column:
    """Enough labelled pages, and more of them bad than in the corpus."""
    return (F.col("n") >= least) & (F.col("k") > F.col("n") * rate)


def judge_pages(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, block_at: float = 0.5, budget: float = 0.15, least: int = 3) -> DataFrame:
    """pages: page_id, url; labels: doc_id (the page's id), quality, toxic. A page is bad if toxic is 1 or quality 0.

    Pages without a rule are blocked if their host's bound reaches block_at, or is among the worst: hosts with at least ``least`` labelled pages
    and a rate above the corpus', by falling bound, as long as they hold ``budget`` of all pages at most; equal bounds go together.
    """
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    seen = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n"), F.sum(bad.cast("long")).alias("k"))
    parsed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    outcomes = stored(parsed.select("page_id", "host").join(seen, "page_id", "left").groupBy("host").agg(F.count("*").alias("pages"), *(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n", "k"))), "host-outcomes")
    known = stored(host_reputation(outcomes).join(outcomes.select("host", "pages"), "host"), "reputation")
    rate = known.agg(F.coalesce(F.sum("k") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0))).first()[0]
    cut = worst_bound(known, rate, budget, least)
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    blocked = (F.col("posterior_bound") >= block_at) | (F.lit(False) if cut is None else _stands_out(rate, least) & (_step() >= cut))
    return parsed.join(known, "host").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), F.round("posterior_bound", 4).alias("posterior_bound"),
    )
