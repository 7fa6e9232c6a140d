"""Provider routing of pages by host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Host suffixes, labels and ids of providers, in order of priority.
PROVIDERS = (
    ("chatgpt.com", "ChatGPT", "chatgpt"),
    ("claude.ai", "Claude", "claude"),
    ("gemini.google.com", "Gemini", "gemini"),
    ("perplexity.ai", "Perplexity", "perplexity"),
    ("copilot.microsoft.com", "Copilot", "copilot"),
    ("bing.com", "Copilot", "copilot"),
    ("poe.com", "Poe", "poe"),
    ("huggingface.co", "HuggingChat", "huggingchat"),
    ("chat.mistral.ai", "Mistral Le Chat", "mistral"),
)
RESTRICTED_HOST = "chromewebstore.google.com"
#: Characters of a host name, at most.
LONGEST_HOST = 253


def _host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _by_host(url: Column, field: int) -> Column:
    chain = F
    for row in PROVIDERS:
        chain = chain.when((_host(url) == row[0]) | _host(url).endswith("." + row[0]), F.lit(row[field]))
    return chain


def provider(url: Column, chatgpt_marks: Column | None = None, claude_marks: Column | None = None) -> Column:
    """Provider id: by host, else by what the page holds, else generic."""
    marks = [F.when(c, F.lit(p)) for c, p in ((chatgpt_marks, "chatgpt"), (claude_marks, "claude")) if c is not None]
    return F.coalesce(_by_host(url, 2), *marks, F.lit("generic"))


def page_kind(url: Column) -> Column:
    """provider, web, restricted (other schemes, the extension store) or unknown (missing or invalid)."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.when(F.coalesce(url, F.lit("")) == "", "unknown").when(scheme.isNull(), "unknown").when(~scheme.isin("http", "https") | (_host(url) == RESTRICTED_HOST), "restricted").when(_by_host(url, 1).isNotNull(), "provider").otherwise("web")


def page_label(url: Column) -> Column:
    return F.when(page_kind(url) == "provider", _by_host(url, 1))


def page_state(kind: Column) -> Column:
    return F.when(kind == "web", "warning").when(kind == "restricted", "error").otherwise("ready")


def with_rules(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``rule`` and ``provider``, by a table of the user's own rules ``suffix, provider``.

    A rule fits its host and all hosts below it, whatever their case; the longest that fits wins, and of equal suffixes
    the least provider. Pages that no rule fits have a null ``rule`` and the provider of the built-in hosts, else
    generic; so have pages without a valid host. Rules without a suffix or provider are left out; an empty table of rules
    leaves the built-in hosts, and columns of these two names are replaced. Hosts are matched once each, however many
    pages they have, by an equi-join on their suffixes.
    """
    keyed = pages.withColumn("_host", _host(F.col(url_col)))
    labels = F.split("_host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = keyed.where((F.col("_host") != "") & (F.length("_host") <= LONGEST_HOST)).select("_host").distinct()
    known = rules.where((F.col("suffix") != "") & F.col("provider").isNotNull()).groupBy(F.lower("suffix").alias("_suffix")).agg(F.min("provider").alias("_named"))
    fitting = hosts.select("_host", F.explode(suffixes).alias("_suffix")).join(known, "_suffix")
    best = fitting.groupBy("_host").agg(F.max_by(F.struct("_suffix", "_named"), F.length("_suffix")).alias("_best"))
    others = [c for c in pages.columns if c not in ("rule", "provider")]
    named = F.coalesce("_best._named", provider(F.col(url_col)))
    return keyed.join(best, "_host", "left").select(*others, F.col("_best._suffix").alias("rule"), named.alias("provider"))
