"""What a worker holds while it tokenises, and pieces from Arrow batches."""

from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import common, decontamination, packing
from parlance.llm.queries import tokenizer_path
from tests.llm import fixtures as fx


def test_tokenising_a_stretch_takes_little_beside_its_texts():
    tok = packing.WordTokenizer(tokenizer_path())
    texts = ["an ox is in it, so " * 500] * 400  # a stretch and less, of a million short words
    assert sum(map(len, texts)) < packing.STRETCH_CHARS
    tracemalloc.start()
    try:
        total = sum(map(len, tok.batch_ids(texts)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == 4 * len(texts) * len(tok.tok.encode(texts[0], add_special_tokens=False).ids)
    assert peak < 8 << 20


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("stretch", [packing.STRETCH_CHARS, 50])
def test_pieces_of_arrow_batches(monkeypatch, kind, stretch):
    monkeypatch.setattr(packing, "STRETCH_CHARS", stretch)
    texts = ["left out", *fx.texts(), None, "", "x " * 3000, None]
    ids = [None if i % 7 == 3 else str(i % 9) for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts, kind)], names=["doc_id", "text"]).slice(1)
    found = [tuple(r.values()) for b in packing._pieces(tokenizer_path(), 64, 1)(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    tok, want = packing.worker_tokenizer(tokenizer_path()).tok, []
    for i, text in zip(ids[1:], texts[1:], strict=True):
        own = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(i, at, len(own[at : at + 64]), zlib.crc32(own[at : at + 64].tobytes()), len(own)) for at in range(0, len(own), 64)]
    assert found == want


def test_a_worker_forgets_its_tokenizer_when_another_operator_begins():
    tok = packing.worker_tokenizer(tokenizer_path())
    assert list(common.giving_back(packing._numbered)(iter([]))) == []
    assert packing.worker_tokenizer(tokenizer_path()) is tok
    assert list(common.giving_back(decontamination._windows(10))(iter([]))) == []
    assert packing.worker_tokenizer.cache_info().currsize == 0


def test_batches_of_a_stage_are_bounded_by_bytes(spark):
    had = spark.conf.get(corpus_pipeline.BATCH_BOUND)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 10_000).alias("text")).coalesce(1)

    def bytes_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    stage = corpus_pipeline._stage(lambda spark, docs, sf_dir: docs.mapInArrow(bytes_of, "n long"))
    try:
        spark.conf.unset(corpus_pipeline.BATCH_BOUND)
        found = [r["n"] for r in stage(spark, docs, "").collect()]
        assert sum(found) >= 600 * 50_000 and max(found) <= corpus_pipeline.BATCH_BYTES + 100_000
        spark.conf.set(corpus_pipeline.BATCH_BOUND, "1m")  # the session's own
        assert max(r["n"] for r in stage(spark, docs, "").collect()) <= (1 << 20) + 100_000
    finally:
        spark.conf.set(corpus_pipeline.BATCH_BOUND, had)


def test_a_run_takes_its_bound_back(spark, monkeypatch):
    had, seen = spark.conf.get(corpus_pipeline.BATCH_BOUND), []

    def stage(spark, docs, sf_dir):
        seen.append(spark.conf.get(corpus_pipeline.BATCH_BOUND))
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", corpus_pipeline._stage(stage))])
    try:
        for own in ("1048576", None):
            spark.conf.set(corpus_pipeline.BATCH_BOUND, own) if own else spark.conf.unset(corpus_pipeline.BATCH_BOUND)
            before = spark.conf.get(corpus_pipeline.BATCH_BOUND)
            corpus_pipeline.run(spark, "/root/testdata/sf0.001")
            assert seen.pop() == (own or str(corpus_pipeline.BATCH_BYTES))
            assert spark.conf.get(corpus_pipeline.BATCH_BOUND) == before
    finally:
        spark.conf.set(corpus_pipeline.BATCH_BOUND, had)
