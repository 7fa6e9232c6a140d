"""Audit of filters that are applied one after another: what each removes in every order, from one pass over the texts.

A document's failures are a mask of five bits. For each part and label, 32 sums are taken: each adds +1 or -1 by the
parity of the failures that a mask of filters shares with the document's. That is the Walsh-Hadamard transform of the
counts of documents by mask, so the counts come back exactly, and with them any order of the filters and the Shapley value of each:
a document that fails k filters is removed by each of them in 120 / k of the 120 orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def text_failures(text: Column) -> Column:
    """Bits of the first four filters: few words, repeated words, capitals, symbols."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    judged = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    few = F.transform(F.array(judged), lambda j: (j["n"] < 100).cast("int") + 2 * (100 * j["distinct"] < 80 * j["n"]).cast("int"))[0]
    return few + 4 * (100 * capitals > 10 * F.length(text)).cast("int") + 8 * text.rlike("[#$%&*|]").cast("int")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, good, toxic, mask, n``: numbers of documents by part, labels and failures.

    Copies fail the same text filters, so whether a document repeats one with a smaller id is known from counts by text:
    all copies but those with the least id fail. Copies are counted in tasks before they meet.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    part, digest = F.coalesce("lang", F.lit("")), F.sha2(text, 256)
    # Rows without an id have no labels; a hash of the text, in a key of its own, deals them out.
    key = [F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.when(F.col("doc_id").isNull(), F.xxhash64(digest).bitwiseOR(F.lit(1))).otherwise(0).alias("spread")]
    rows = docs.select(*key, part.alias("part"), digest.alias("digest"), text_failures(text).alias("m"))
    marked = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id"), F.lit(0).cast("long").alias("spread")).agg(marked("quality"), marked("toxic"))
    found = rows.join(marks, ["id", "spread"], "left").select("id", "spread", "digest", "m", "part", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    same = ["digest", "m", "part", "good", "toxic"]
    repeated = found.groupBy("id", "spread", *same).agg(F.count("*").alias("k")).withColumn("id", F.when(F.col("spread") == 0, F.col("id")))
    counts = repeated.groupBy(*same).agg(
        F.sum("k").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("k")).otherwise(0)).alias("no_id"), F.min("id").alias("least"), F.min_by("k", "id").alias("at_least"),
    )
    whole = counts.groupBy("digest").agg(F.min("least").alias("first"), F.collect_list(F.struct("m", "part", "good", "toxic", "n", "no_id", "least", "at_least")).alias("kinds"))
    kinds = whole.select("first", F.explode("kinds").alias("x")).select("first", "x.*")
    own = F.col("no_id") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    split = kinds.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("m").alias("mask"), own.alias("n")), F.struct((F.col("m") + 16).alias("mask"), (F.col("n") - own).alias("n")))).alias("x"))
    return split.select("part", "good", "toxic", "x.mask", "x.n").where(F.col("n") > 0)


def parity_sums(mask: Column, n: Column) -> list[Column]:
    """Sums over documents of +1 or -1, by whether they fail an even or odd number of the filters of each of the 32 masks."""
    odd = lambda w: (F.bit_count(mask.bitwiseAND(F.lit(w))) % 2) == 1
    return [F.sum(F.when(odd(w), -n).otherwise(n)).alias(f"s{w}") for w in range(CELLS)]


def cells_of(sums: Column) -> Column:
    """Counts by mask from the 32 parity sums: the transform is its own inverse but for the factor 32."""
    sign = lambda m, w: F.lit(1) - 2 * (F.bit_count(m.bitwiseAND(w)) % 2)
    total = lambda m: F.aggregate(F.sequence(F.lit(0), F.lit(CELLS - 1)), F.lit(0).cast("long"), lambda acc, w: acc + sign(m, w) * F.get(sums, w))
    return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda m: F.floor(total(m) / CELLS).cast("long"))


def _sum_where(cells: Column, condition) -> Column:
    """Sum of the cells of the masks for which ``condition`` holds."""
    kept = F.filter(F.transform(cells, lambda c, m: F.struct(m.alias("m"), c.alias("c"))), lambda x: condition(x["m"]))
    return F.aggregate(kept, F.lit(0).cast("long"), lambda acc, x: acc + x["c"])


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` from ``doc_id, text, lang`` and ``doc_id, quality, toxic``.

    600 rows for each part: five steps of 120 orders. Null texts are empty and a null language is the part ``''``. A row
    without id repeats nothing, and rows of equal ids and texts don't repeat one another; a label that stands in several
    rows of an id counts once. Empty tables give no rows, and other columns don't matter.
    """
    found = masks(docs, labels)
    sums = found.groupBy("part", "good", "toxic").agg(*parity_sums(F.col("mask"), F.col("n")))
    cells = sums.select("part", "good", "toxic", cells_of(F.array(*(f"s{w}" for w in range(CELLS)))).alias("c"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("good", "toxic", "c")).alias("x"))  # four at most
    zero = F.array_repeat(F.lit(0).cast("long"), CELLS)
    added = lambda xs: F.aggregate(xs, zero, lambda acc, x: F.zip_with(acc, x["c"], lambda a, b: a + b))
    parts = parts.select("part", added(F.col("x")).alias("all"), added(F.filter("x", lambda x: x["good"])).alias("good"), added(F.filter("x", lambda x: x["toxic"])).alias("toxic"))
    steps = [(order, k + 1, 1 << FILTERS.index(order[k]), sum(1 << FILTERS.index(f) for f in order[:k])) for order in ORDERS for k in range(len(FILTERS))]
    steps = F.from_json(F.lit(str([list(s) for s in zip(*steps, strict=True)]).replace("'", '"')), "array<array<string>>")
    names = ("filter_order", "step", "own", "before")
    rows = parts.select("*", F.posexplode(steps[0]).alias("i", "filter_order")).select("*", *(F.get(steps[k], F.col("i")).cast("int").alias(names[k]) for k in (1, 2, 3)))
    own, before = F.col("own"), F.col("before")
    fails = lambda m, bits: m.bitwiseAND(bits) != 0
    removed = lambda m: fails(m, own) & ~fails(m, before)
    share = F.filter(F.transform("all", lambda c, m: F.struct(m.alias("m"), c.alias("c"))), lambda x: fails(x["m"], own))
    return rows.select(
        "part", "filter_order", "step",
        _sum_where(F.col("all"), lambda m: ~fails(m, before.bitwiseOR(own))).alias("kept"),
        _sum_where(F.col("all"), removed).alias("removed"),
        _sum_where(F.col("all"), lambda m: fails(m, own) & fails(m, before)).alias("redundant"),
        F.get("all", own).alias("unique_fails"),
        _sum_where(F.col("good"), removed).alias("good_lost"),
        _sum_where(F.col("toxic"), removed).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda acc, x: acc + x["c"] * F.floor(len(ORDERS) / F.bit_count(x["m"])).cast("long")).alias("shapley"),
    )
