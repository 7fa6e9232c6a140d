"""URL filters: explicit rules, else empirical-Bayes host reputation. DataFrame functions only.

Labelled pages give good and bad outcomes of hosts. A host's rate is shrunk to that of its registered domain, a
domain's to that of its suffix, and a suffix's to that of all pages, each through a beta-binomial prior whose strength
comes from the spread between its members (method of moments). A host without labelled pages gets the prior of the
nearest level that has some. A host is blocked if even the upper bound of its posterior falls under a floor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import UPPER


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str


#: Rules of the production query.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)
FLOOR, Z, MIN_STRENGTH, MAX_STRENGTH = 0.5, 1.645, 2.0, 200.0

# Public suffixes of two labels; every other suffix is the last label.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co",
    "com.hk", "com.mx", "com.my", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "go.jp", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk",
    "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "net.uk", "nhs.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za",
)
#: Suffix of addresses in numbers, whose registered domain is the address.
ADDRESS = "#address"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lowered; empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[UrlRule, ...], value: str) -> Column:
    """``rule`` or ``verdict`` of the longest rule that fits, else null; of equally long ones the first wins."""
    chain = F
    for r in sorted(rules, key=lambda r: -len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        chain = chain.when(fits, F.lit(r.host + r.path if value == "rule" else r.verdict))
    return chain if rules else F.lit(None).cast("string")


def registered_name(host: Column) -> Column:
    """``domain`` and ``suffix`` of a host, without user, port and final dot."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")
    last = lambda n: F.substring_index(name, ".", -n)
    long = last(2).isin(*SUFFIXES)
    address = name.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*)$")
    return F.struct(
        F.when(address, name).when(long, last(3)).otherwise(last(2)).alias("domain"),
        F.when(address, F.lit(ADDRESS)).when(long, last(2)).otherwise(last(1)).alias("suffix"),
    )


def host_reputation(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``host, labelled, mean, upper`` for each row of ``hosts``, from ``host, good`` (0/1) rows; null outcomes don't count.

    Counts of hosts are summed before anything else, so later steps see one row for each host.
    """
    named = lambda df: df.withColumn("_r", registered_name(F.col("host"))).select("*", "_r.domain", "_r.suffix").drop("_r")
    known = named(outcomes.where(F.col("good").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("k")))
    domains = known.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), _strength().alias("s_domain"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), _strength().alias("s_suffix"))
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), _strength().alias("s")).first()  # one row
    m_all, s_all = F.lit((float(whole["k"] or 0) + 1) / (float(whole["n"] or 0) + 2)), F.lit(float(whole["s"]))
    suffixes = suffixes.select("suffix", "s_suffix", _shrunk(m_all, s_all).alias("m_suffix"))
    domains = domains.join(suffixes, "suffix").select("domain", "s_domain", _shrunk(F.col("m_suffix"), F.col("s_suffix")).alias("m_domain"))
    joined = named(hosts).join(known.select("host", "n", "k"), "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
    prior, strength = F.coalesce("m_domain", "m_suffix", m_all), F.coalesce("s_domain", "s_suffix", s_all)
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))
    out = joined.select("host", n.alias("labelled"), ((k + prior * strength) / (n + strength)).alias("mean"), (n + strength).alias("_weight"))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("_weight") + 1))
    return out.select("host", "labelled", "mean", (F.col("mean") + Z * spread).alias("upper"))


def _shrunk(prior: Column, strength: Column) -> Column:
    return (F.col("k") + prior * strength) / (F.col("n") + strength)


def _strength() -> Column:
    """Prior strength of a group from its members' ``n`` and ``k``: what their rates differ beyond chance.

    One member alone tells nothing of the spread, so the prior stays weak.
    """
    rate = (F.col("k") + 0.5) / (F.col("n") + 1.0)
    spread = F.greatest(F.var_pop(rate) - F.avg(rate * (1 - rate) / (F.col("n") + 1.0)), F.lit(1e-6))
    fitted = F.least(F.greatest(F.avg(rate) * (1 - F.avg(rate)) / spread - 1, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH))
    return F.when(F.count("*") > 1, fitted).otherwise(F.lit(MIN_STRENGTH))


def judge_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", outcome_id_col: str = "doc_id", outcome_col: str = "quality", rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    Null urls and urls without ``://`` have an empty host and path, and are judged like any other host. Outcomes are joined by id; several outcomes of one id count as their largest. Repeated
    rows each get their row; extra columns are ignored; no rows give no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = outcomes.select(F.col(outcome_id_col).alias("page_id"), F.col(outcome_col).alias("good")).where(F.col("page_id").isNotNull())
    known = known.groupBy("page_id").agg(F.max("good").alias("good"))
    reputation = host_reputation(rows.select("host").distinct(), rows.select("page_id", "host").join(known, "page_id"))
    blocked = reputation.where(F.col("upper") < FLOOR).select("host", F.lit("block").alias("reputed"))
    rule = lambda v: matching_rule(F.col("host"), F.col("path"), rules, v)
    joined = rows.join(blocked, "host", "left")
    return joined.select("page_id", "host", "path", rule("rule").alias("rule"), F.coalesce(rule("verdict"), "reputed", F.lit("allow")).alias("verdict"))
