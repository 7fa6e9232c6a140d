"""Stages of the corpus pipeline against plain-Python twins; ids are missing or repeated in some rows."""

from __future__ import annotations

import collections

import pytest

import corpus_pipeline
from tests.llm import fixtures as fx

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "All rights reserved here."
ITEM = "the quick brown fox jumps over the lazy dog at noon"


def rows() -> list[tuple]:
    texts = fx.texts()
    out = [(i, t) for i, t in enumerate(texts)]
    other = [f"{w} nine unlike words stand in this very short line" for w in ("alpha", "beta", "gamma", "delta")]
    out += [(None, other[0]), (None, other[1]), (None, LINE), (7, other[2]), (7, LINE.upper()), (8, texts[8]), (8, texts[8])]
    out += [(None, f"before {ITEM} after"), (9000, f"again {ITEM}"), (9000, other[3]), (9001, texts[-2]), (9001, texts[-2]), (None, texts[-2])]
    return [(i, t, "en", f"s{n % 2}", len(t or "")) for n, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


def stage(spark, docs, name, sf_dir=""):
    return collections.Counter(tuple(r) for r in dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir).select("doc_id", "text", "n_chars").collect())


def test_line_dedup_keeps_the_text_of_each_row(spark, docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(fx.LOWER)
    lines = [(r[0], (r[1] or "").split("\n")) for r in rows()]
    counts = collections.Counter(k for _, x in lines for k in {key(y) for y in x} if k)
    want = collections.Counter()
    for i, x in lines:
        kept = [y for y in x if counts[key(y)] < 10]
        text = "\n".join(kept)
        if len(kept) == len(x) or text.strip(" "):
            want[i, text, len(text)] += 1
    assert stage(spark, docs, "line_dedup") == want


def test_ngram_join_keeps_one_row_of_each_component(spark, docs):
    component = fx.components([(k, r[1]) for k, r in enumerate(rows())], 5, 80)
    members = collections.defaultdict(list)
    for k, r in enumerate(rows()):
        members[component[k]].append((r[0] is None, r[0] or 0, k))
    want = collections.Counter((rows()[k][0], rows()[k][1], rows()[k][4]) for *_, k in map(min, members.values()))
    assert stage(spark, docs, "ngram_join") == want


def test_decontamination_drops_contaminated_rows_only(spark, docs, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = collections.Counter((r[0], r[1], r[4]) for r in rows() if ITEM not in (r[1] or ""))
    assert stage(spark, docs, "decontamination", str(tmp_path)) == want


def test_the_whole_pipeline_packs_what_its_stages_keep(spark):
    data = "/root/testdata/sf0.001"
    found = corpus_pipeline.run(spark, data).collect()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, spark.createDataFrame(rows, docs.schema).repartition(3), data)
        rows = [tuple(r) for r in docs.collect()]
    assert {r["doc_id"] for r in found} == {r[0] for r in rows} and len(rows) < spark.read.parquet(f"{data}/documents.parquet").count()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in pieces.values():
        own.sort()
        assert [p[0] for p in own] == [sum(p[1] for p in own[:i]) for i in range(len(own))] and sum(p[1] for p in own) == own[0][2]
    for own in sequences.values():
        own.sort()
        assert [p[0] for p in own] == [sum(p[1] for p in own[:i]) for i in range(len(own))] and sum(p[1] for p in own) <= 2048
