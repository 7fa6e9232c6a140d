"""Samples, hashes and blocks at sizes and on rows where they might give way."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import common, language_id, ngram_join
from tests.llm import fixtures as fx


def test_samples_of_very_large_strata_are_as_large_as_asked(spark):
    rows = spark.range(450_000_000, numPartitions=64).withColumn("lang", F.lit("en"))
    assert common.bounded_sample(rows, 400, F.col("id"), "lang").count() == 400


def test_samples_are_exact_whatever_the_keys(spark):
    rows = spark.range(20_000, numPartitions=8).select((F.col("id") % 3).alias("lang"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("key"), F.lit("t").alias("text"))
    found = common.bounded_sample(rows, 500, F.struct("key", "text"), "lang")
    assert collections.Counter(r["lang"] for r in found.collect()) == {0: 500, 1: 500, 2: 500}
    assert found.columns == rows.columns
    same = rows.where("key is null")  # all rows alike
    assert common.bounded_sample(same, 500, F.struct("key", "text"), "lang").count() == 1500
    assert common.bounded_sample(same, 2000, F.struct("key", "text")).count() == 2000
    assert common.bounded_sample(rows, 2000, F.struct("key", "text")).count() == 2000
    few = rows.where(F.col("key") < 100)
    assert common.bounded_sample(few, 500, F.col("key"), "lang").count() == few.count() == common.bounded_sample(few, 500, F.col("key")).count()
    assert common.bounded_sample(rows.limit(0), 500, F.col("key"), "lang").count() == 0 == common.bounded_sample(rows.limit(0), 500, F.col("key")).count()
    with pytest.raises(ValueError):
        common.bounded_sample(rows, 5000, F.col("key"), "lang")


def test_samples_are_the_same_however_rows_are_dealt(spark):
    rows = spark.range(5000).withColumn("lang", F.col("id") % 2)
    draw = lambda n: sorted(r["id"] for r in common.bounded_sample(rows.repartition(n), 50, F.col("id"), "lang").collect())
    assert draw(3) == draw(7)


def test_documents_without_ids_teach_a_language(spark):
    docs = spark.createDataFrame([(None, "the cat sat on the mat", "en", "s", 22)] * 3000, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.identify_language(spark, docs, "").count() == 3000
    with pytest.raises(ValueError):
        corpus_pipeline.identify_language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "")
    assert language_id.train(docs.limit(0)).names == []


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_on_which_polynomials_collide_stay_apart(spark):
    twin = str.maketrans("ab", "ba")
    words = [thue_morse(n) for n in (1024, 4096)]
    rows = list(enumerate([x for w in words for x in (w, w.translate(twin), f"{w} x y", f"{w.translate(twin)} x y")]))
    found = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: i for i, _ in rows}


def test_blocks_are_cut_by_the_size_of_their_sets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 4096)  # two or three rows of a block
    r = np.random.default_rng(11)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        words = list(base)
        for k in r.integers(0, 200, 1 + i % 4):
            words[k] = f"x{i}-{k}"
        rows.append((i, " ".join(words)))
    found = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=80)
    assert {x["doc_id"]: x["component_id"] for x in found.collect()} == fx.components(rows, 3, 80)


def test_later_batches_of_lines_give_what_one_run_gives(spark):
    from parlance.llm import line_dedup

    docs = fx.documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).cache()
    columns = ("doc_id", "n_lines", "n_dropped", "sha")
    whole = {r["doc_id"]: tuple(r) for r in line_dedup.drop_common_lines(docs, min_docs=10, batches=3).select(*columns).collect()}
    runs = line_dedup.LineRuns(spark, buckets=4, min_docs=10, fanout=3)
    parts = [docs.where(F.col("doc_id") % 3 == k) for k in range(3)]
    for part in parts[:2]:
        line_dedup.drop_common_lines(part, min_docs=10, batches=2, runs=runs)
    last = line_dedup.drop_common_lines(parts[2], min_docs=10, batches=1, runs=runs).select(*columns).collect()
    assert len(last) > 5 and any(r["n_dropped"] for r in last)
    assert {r["doc_id"]: tuple(r) for r in last} == {i: r for i, r in whole.items() if i % 3 == 2}
    runs.forget()


def test_places_and_items_of_a_window_are_not_multiplied(spark):
    from parlance.llm import decontamination

    window = " ".join(f"w{i}" for i in range(10))
    docs = spark.createDataFrame([(1, " ".join([window] * 2000)), (2, f"x {window} y"), (3, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(i, window) for i in range(3000)], "item_id long, text string")
    found = decontamination.find_contamination(docs, items)
    rows = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in found.collect()}
    assert rows == {1: (20_000, 20_000, 3000), 2: (12, 10, 3000), 3: (1, 0, 0)}
    # No operator of the plan makes a row for each pair of a place and an item: 2,001 places times 3,000 items.
    assert "left_semi" in found._jdf.queryExecution().toString().lower().replace(" ", "_") or "leftsemi" in found._jdf.queryExecution().toString().lower()
