"""Quality rules as a short-circuit cascade, in DataFrame functions only.

The cost and the selectivity of each rule are estimated on a bounded sample; the rules are then put in the order of
rejections per cost and compiled into one CASE expression, so a rule runs only for rows that all rules before it let
pass. The order changes the work, never the verdict.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import BLANKS, bounded_sample, stored
from parlance.sources.conversations import spread

#: Rows of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 2000
#: Of these, the rows on which costs are timed.
COST_ROWS = 400
#: Time below which rules count as equally cheap.
LEAST_SECONDS = 0.02


@dataclass(frozen=True)
class Rule:
    """``rejects`` builds a boolean Column from the text and the statistics; null counts as false."""

    name: str
    rejects: Callable[[], Column]


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once per row and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def word_list(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def repeated_window_words(words: Column, width: int = 5) -> Column:
    """Number of words inside windows of ``width`` words that occur twice or more in the list, the first included."""

    def windows(w: Column) -> Column:
        full = F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, width))))
        return F.slice(full, F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(0)))

    def covered(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda p, k: (p["h"] == F.get(pairs, k - 1)["h"]) | (p["h"] == F.get(pairs, k + 1)["h"]))
        places = F.array_sort(F.transform(twice, lambda p: p["i"]))
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bind(pairs, covered))

    return _bind(_bind(words, windows), count)


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` and the base statistics of every whole text; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", word_list(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return rows.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def default_rules() -> list[Rule]:
    """The production rules beside the base rule; they look at whole texts."""
    c = F.col
    return [
        Rule("symbols", lambda: c("n_symbols") * 10 > c("n_words")),
        Rule("word_length", lambda: (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words"))),
        Rule("dup_lines", lambda: c("n_dup_lines") * 100 > 30 * (F.regexp_count(c("text"), F.lit("\n")) + 1)),
        Rule("exclamations", lambda: F.regexp_count(c("text"), F.lit("!")) * 5 > c("n_words")),
        Rule("capitals", lambda: F.regexp_count(c("text"), F.lit("[A-Z]")) > F.regexp_count(c("text"), F.lit("[a-z]"))),
    ]


def base_rule() -> Rule:
    return Rule("base", lambda: (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))


def _seconds(df: DataFrame, rejects: Column) -> float:
    """The shorter of two runs that count what a rule rejects."""
    took = []
    for _ in range(2):
        began = time.perf_counter()
        df.agg(F.count_if(rejects)).collect()
        took.append(time.perf_counter() - began)
    return min(took)


def rule_costs(sample: DataFrame, rules: list[Rule]) -> dict[str, float]:
    """The cost of each rule with the statistics that it needs, in steps of a factor of four.

    A job on the texts reads and computes only what its rule asks for; what a job without a rule takes is subtracted.
    Steps, rather than times, keep the order the same from run to run.
    """
    stats = text_statistics(sample)
    bare = _seconds(stats, F.length("text") < 0)
    return {r.name: 4.0 ** round(math.log(max(LEAST_SECONDS, _seconds(stats, r.rejects()) - bare), 4)) for r in rules}


def plan_cascade(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Order the rules by rejections per cost, as estimated on a bounded sample of ``docs``.

    Greedy: each next rule is the one that rejects most of what is still left, per unit of its own cost; of equals the
    one named first. An empty sample keeps the order given.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = stored(bounded_sample(rows, sample_rows, F.struct("doc_id", "text")), "rule-sample")
    flags = text_statistics(sample).select(*(F.coalesce(r.rejects(), F.lit(False)).alias(r.name) for r in rules))
    patterns = [r.asDict() for r in flags.groupBy(*(r.name for r in rules)).count().collect()]  # 2**rules rows at most
    if not patterns:
        return list(rules)
    cost = rule_costs(stored(sample.limit(COST_ROWS), "cost-sample"), rules)
    left, order = list(rules), []
    while left:
        best = max(left, key=lambda r: sum(p["count"] for p in patterns if p[r.name]) / cost[r.name])
        order.append(best)
        left.remove(best)
        patterns = [p for p in patterns if not p[best.name]]
    return order


def first_rejection(rules: list[Rule]) -> Column:
    """Name of the first rule of the cascade that rejects the row, else null."""
    chain = F
    for r in rules:
        chain = chain.when(r.rejects(), F.lit(r.name))
    return chain if rules else F.lit(None).cast("string")


def apply_quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` for every row of ``docs``.

    Null and empty texts have no words, so they fail the base rule. Repeated rows are judged each on their own; extra
    columns are ignored whatever their names; an empty table gives an empty result with the same columns.
    """
    stats = text_statistics(spread(docs.select(id_col, text_col)), id_col, text_col)
    order = plan_cascade(docs, [base_rule(), *(default_rules() if rules is None else rules)], id_col=id_col, text_col=text_col)
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_rule().rejects().alias("base_failed"),
        first_rejection(order).isNull().alias("kept"),
    )
