"""Operator 2: url rules, and empirical-Bayes host reputation where no rule fits.

Labelled page outcomes are counted by host, registered domain and suffix.  The share of bad pages of a
suffix is shrunk towards the overall share, a domain's towards its suffix', a host's towards its
domain's, each through a beta prior whose strength is fitted to the spread between siblings (moments of
the beta-binomial).  A host is blocked if the lower bound of its posterior exceeds the
overall share of bad pages (times `MAX_BAD`): if it is credibly worse than the web at large, whatever that share is.

All of it is DataFrame work.  Counts are summed before they are shuffled; the host table joins the pages
by broadcast where it has at most `BROADCAST_HOSTS` rows (counted first), else over salted keys, so that a
host with a third of all pages is spread.

Defined results: a url that is null or has no `://` has empty host and path, and the method judges it as
the empty host; a host without labels has its domain's posterior, and with no labels at all every
page is allowed; null labels do not count; repeated rows are judged each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Block where the posterior's lower bound is above so many times the share of bad pages among all that are labelled.
MAX_BAD = 1.0
#: Standard deviations between the posterior's mean and its lower bound.
BOUND = 1.645
BROADCAST_HOSTS = 100_000
SALTS = 32
#: Suffixes of two labels under which domains are registered (fixed values; a parameter).
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")


@dataclass(frozen=True)
class Rule:
    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_of(host: Column, long_suffixes: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, long_suffixes: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*long_suffixes), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def prior_strength(children: DataFrame, mean: float) -> float:
    """Pseudo-pages of the beta prior of one level, from the spread of its members' shares; one row comes to the driver."""
    spread = F.col("n") * F.pow(F.col("bad") / F.col("n") - mean, 2)
    r = children.where("n > 0").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(spread).alias("s")).first()
    inner = mean * (1 - mean)
    room = (r.n - r.nn / r.n) if r.n else 0
    if r.k < 2 or room <= 0 or inner <= 0:
        return 10.0
    between = (float(r.s) - (r.k - 1) * inner) / float(room)
    return min(1000.0, max(1.0, inner / between - 1)) if between > 0 else 1000.0


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, mean and lower bound of its share of bad pages, and the overall share; for every host of `pages` (page_id, url).

    outcomes: page_id, bad (0 or 1), one row for a page at most."""
    joined = pages.select("page_id", host_of(F.col("url")).alias("host")).join(outcomes, "page_id", "left")
    hosts = joined.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = (float(total.bad or 0) + 0.5) / (float(total.n or 0) + 10.0)
    k_suffix, k_domain, k_host = (prior_strength(x, mean) for x in (suffixes, domains, hosts))

    def shrunk(prior, strength):
        return (F.col("bad") + prior * strength) / (F.col("n") + strength)

    s = suffixes.select("suffix", shrunk(F.lit(mean), F.lit(k_suffix)).alias("suffix_mean"))
    d = domains.join(s, "suffix").select("domain", shrunk(F.col("suffix_mean"), F.lit(k_domain)).alias("domain_mean"))
    h = hosts.join(d, "domain").select("host", shrunk(F.col("domain_mean"), F.lit(k_host)).alias("bad_share"), (F.col("n") + k_host + 1).alias("weight"))
    return h.select("host", "bad_share", F.lit(mean).alias("overall"), (F.col("bad_share") - BOUND * F.sqrt(F.col("bad_share") * (1 - F.col("bad_share")) / F.col("weight"))).alias("bad_share_low"))


def judge_pages(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_share, bad_share_low for every row of `pages`.

    outcomes: page_id and bad (0 or 1; 1 where any of a page's rows says so)."""
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    known = outcomes.select(F.col("page_id").cast("long").alias("page_id"), F.col("bad").cast("int").alias("bad")).where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    table = reputations(urls, known)
    parts = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if table.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        judged = parts.join(F.broadcast(table), "host", "left")
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        judged = parts.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    ruled = judged.withColumn("ruled", matched_rule(F.col("host"), F.col("path"), rules))
    return ruled.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", F.when(F.col("bad_share_low") > MAX_BAD * F.col("overall"), "block").otherwise("allow")).alias("verdict"), "bad_share", "bad_share_low")
