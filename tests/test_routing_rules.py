"""Routing by a user's own rules."""

from __future__ import annotations

from parlance.operators.routing import with_rules

RULES = "suffix string, provider string"


def routed(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = with_rules(pages, spark.createDataFrame(rules, RULES)).orderBy("page_id").collect()
    return [(r["rule"], r["provider"]) for r in found]


def test_longest_rule_wins_and_look_alikes_do_not_match(spark):
    rules = [("example.org", "outer"), ("Chat.Example.org", "inner"), ("poe.com", "mine")]
    urls = ["https://a.CHAT.example.org/x", "https://example.org", "https://notexample.org/", "https://example.org.net/", "http://www.poe.com:80/", "https://claude.ai/chat/1"]
    assert routed(spark, urls, rules) == [
        ("chat.example.org", "inner"), ("example.org", "outer"), (None, "generic"), (None, "generic"), ("poe.com", "mine"), (None, "claude"),
    ]


def test_defined_cases(spark):
    rules = [("a.com", "z"), ("a.com", "b"), (None, "x"), ("", "x"), ("b.com", None)]
    urls = [None, "", "no address", "https://a.com/", "https://b.com/", "https://a.com/", "https://" + "a." * 5000 + "a.com/"]
    none = (None, "generic")
    assert routed(spark, urls, rules) == [none, none, none, ("a.com", "b"), none, ("a.com", "b"), none]
    assert routed(spark, ["https://poe.com/"], []) == [(None, "poe")]
    assert routed(spark, [], rules) == []


def test_clashing_columns_are_replaced(spark):
    pages = spark.createDataFrame([("https://a.com/", "old", "old", 7)], "url string, rule string, provider string, extra int")
    found = with_rules(pages, spark.createDataFrame([("a.com", "new")], RULES)).collect()
    assert [r.asDict() for r in found] == [{"url": "https://a.com/", "extra": 7, "rule": "a.com", "provider": "new"}]
