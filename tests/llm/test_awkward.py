"""Awkward rows for the operators whose results have no simple twin: nulls, ties, repeats, very long texts, clashing columns."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import common, decontamination, language_id, line_dedup, ngram_join, packing, pii, quality_model, quality_rules, suffix_dedup
from parlance.llm.queries import tokenizer_path
from tests.llm import fixtures as fx

N = 120_000
LONG = ["1" * N, "a@b" + ".c" * (N // 2), "a" * N, " " * N, "1 2 " * (N // 4), "a.a-" * (N // 4), "+1 " * (N // 3), "12 34 56 " * (N // 9), "\n" * N, "word " * (N // 5), " ".join(map(str, range(N // 6)))]


@pytest.fixture(scope="module")
def docs(spark):
    return fx.documents(spark).cache()


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string").repartition(3).cache()


def test_personal_data_in_very_long_texts(long):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}"}
    found = {r["doc_id"]: r for r in pii.find_personal_data(long).select("doc_id", pii.listed(F.col("base")).alias("base"), F.size("spans").alias("n")).collect()}
    assert len(found) == len(LONG)
    for i, t in enumerate(LONG):
        if "@" in t:
            assert found[i]["base"] == ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(patterns["email"], t))
        else:
            assert found[i]["base"] == ""


def test_spans_of_many_matches_stand_where_they_are_found(spark):
    text = " ".join(f"x{i}@b.de" for i in range(1000)) + " 😀 10.0.0.1"
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = frame.select(pii.find_spans(F.col("text"), pii.EMAIL).alias("s")).first()["s"]
    assert [(s["start"], s["end"], s["match"]) for s in spans] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"[a-z0-9]+@b\.de", text)]
    assert spans[1]["before"] == " " and spans[1]["after"] == " "


def test_base_patterns_find_what_backtracking_finds(spark):
    r = np.random.default_rng(9)
    plain = {pii.EMAIL: (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "aB1.@-_%+ é"), pii.IP: (r"[0-9]+(?:\.[0-9]+){3}", "012.. a"), pii.CARD: (r"[0-9](?:[\x20-]?[0-9])+", "0123 -  a"), pii.PHONE: (r"\+[0-9][\x20().0-9-]+[0-9]", "01+ ().-a")}
    for pattern, (twin, letters) in plain.items():
        texts = ["".join(r.choice(list(letters), r.integers(1, 40))) for _ in range(2000)]
        found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("m")).collect()
        assert [(x["t"], x["m"]) for x in found] == [(t, [m.group() for m in re.finditer(twin, t)]) for t in texts]


def test_added_spans_are_those_that_were_planted(spark):
    """Recall and precision of what the classifier adds to the base spans, on labelled secrets and numbers without meaning."""
    r = np.random.default_rng(2)
    key = lambda n: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789"), n)) + "7x"
    rows, want = [], {}
    for i in range(600):
        kind = i % 6
        text, planted = [
            (f"my api key is sk_{key(24)} ok", True), (f"password: {key(20)} and more", True), (f"call {r.integers(200, 999)}-{r.integers(200, 999)}-{r.integers(1000, 9999)} today", True),
            (f"phone (0{r.integers(10, 99)}) or ({r.integers(200, 999)}) {r.integers(200, 999)}-{r.integers(1000, 9999)}", True), ("nothing to see in these plain words 2024 12", False), (f"page {i} of 10 3 20", False),
        ][kind]
        rows.append((i, text))
        want[i] = planted
    found = {x["doc_id"]: x["n"] for x in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", (F.size("spans") - F.size("base")).alias("n")).collect()}
    caught = [found[i] > 0 for i, p in want.items() if p]
    clean = [found[i] == 0 for i, p in want.items() if not p]
    assert np.mean(caught) >= 0.9 and np.mean(clean) >= 0.95


def test_long_texts_pass_every_operator(spark, long):
    found = suffix_dedup.remove_repeats(long).select("doc_id", "n_bytes", "n_removed").collect()
    want = {i: x for i, x in enumerate(fx.repeats([t[:3000] for t in LONG], 200))}
    assert {r["doc_id"]: r["n_bytes"] for r in found} == {i: len(t) for i, t in enumerate(LONG)}
    assert all((r["n_removed"] > 0) == (want[r["doc_id"]][1] > 0) for r in found)
    lines = {r["doc_id"]: r["n_lines"] for r in line_dedup.drop_common_lines(long).collect()}
    assert lines == {i: t.count("\n") + 1 for i, t in enumerate(LONG)}
    sets = {r["doc_id"]: r["n_shingles"] for r in ngram_join.jaccard_components(long).collect()}
    assert sets == {i: len(fx.shingles(t, 3)) for i, t in enumerate(LONG)}
    items = spark.createDataFrame([(1, "word " * 10), (2, LONG[-1])], "item_id long, text string")
    hits = {r["doc_id"]: r["n_hit"] for r in decontamination.find_contamination(long, items).collect()}
    assert hits[9] == N // 5 and hits[10] == N // 6 and hits[0] == 0
    stats = {r["doc_id"]: r["n_words"] for r in quality_rules.apply_quality_rules(long).collect()}
    assert stats == {i: len(t.split()) for i, t in enumerate(LONG)}


def test_packing_of_whole_sequences_and_long_words(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    texts = ["x" * 9000, "word " * 4000, None, "", " ".join(f"w{i}" for i in range(6000))]
    rows = [(None if i % 5 == 2 else 3, texts[i % 5], "extra") for i in range(40)]
    found = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5), tokenizer_path()).toPandas()
    want = collections.Counter()
    for _, t, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.update((s, len(p := ids[s : s + 2048]), zlib.crc32(p.tobytes()), len(ids)) for s in range(0, len(ids), 2048))
    assert collections.Counter(zip(found.start, found.length, found.ids_crc32, found.doc_tokens, strict=True)) == want
    for _, part in found.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum()[:-1]] and part.length.sum() <= 2048
    assert (found.length == 2048).sum() > 10


def test_language_of_awkward_rows(spark, docs):
    labelled = [(i, w and w * 40, lang, "s") for i, (w, lang) in enumerate([("abcd efg ", "x"), ("zyxw vut ", "y"), ("abcd efg ", "x"), (None, "y"), ("zz", None)])]
    train = spark.createDataFrame(labelled, "doc_id long, text string, lang string, score string")
    model = language_id.train(train)
    assert model.names == ["x", "y"]
    found = language_id.identify_languages(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(found) == len(fx.rows()) and all(0 <= r["score"] <= 1 for r in found)
    by_text = language_id.language_column(spark, model)(F.col("text"))
    plain = docs.select("text", by_text.alias("p")).collect()
    other = docs.select("text", F.lit(1).alias("doc_id"), F.lit("y").alias("lang"), F.lit("z").alias("source")).select("text", by_text.alias("p")).collect()
    assert collections.Counter(plain) == collections.Counter(other)  # ids, labels and sources are no inputs
    assert all((r["p"]["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in plain)
    assert {r["p"]["lang_pred"] for r in plain if r["text"] and "same" in r["text"]} <= {"x", "y"}


def test_quality_scores_equal_a_plain_twin(spark, docs):
    r = np.random.default_rng(6)
    labels = [(i, int(r.random() < 0.5)) for i in range(30)] + [(3, 1), (3, 0), (None, 1), (4, None), (9999, 1)]
    model = quality_model.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    found = quality_model.score_quality(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(found) == len(fx.rows())

    def twin(t):
        x = quality_model.features_of([(t or "").encode()])[0]
        total = model.base + sum(table[sum(1 for e in edge if e <= v)] for edge, table, v in zip(model.edges, model.tables, x, strict=True))
        for a, b, table in model.pairs:
            total += table[sum(1 for e in model.coarse[a] if e <= x[a]), sum(1 for e in model.coarse[b] if e <= x[b])]
        return 1 / (1 + np.exp(-min(30, max(-30, total))))

    want = collections.Counter((str(row[0]), round(float(twin(row[1])), 9)) for row in fx.rows())
    assert collections.Counter((str(x["doc_id"]), round(x["score"], 9)) for x in found) == want


def test_a_filter_never_loses_a_key(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "row_key")
    keys = spark.range(0, 20_000, 7).withColumnRenamed("id", "row_key")
    maybe, never = common.split_by(rows, keys)
    assert maybe.count() + never.count() == 20_000 and never.join(keys, "row_key").count() == 0
    assert maybe.count() < 2 * keys.count()
    assert common.without(rows, keys, "row_key").count() == 20_000 - keys.count()
    assert common.without(rows, keys.limit(0), "row_key").count() == 20_000


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": lambda self, key, default=None: default})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_stage(spark):
    rows = [(i, ("abcd efg " if i % 2 else "zyxw vut ") * 30, "x" if i % 2 else "y", None, 1) for i in range(20)] + [(None, None, None, None, None), (1, "12 !!", "x", "s", 5), (1, "abcd", None, "s", 4), (1, "abcd", None, "s", 4)]
    found = dict(corpus_pipeline.STAGES)["language_id"](spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    want = [(i, t, "x" if "a" in t else "y", s, n) for i, t, _, s, n in rows if t and any(c.isalpha() for c in t)]
    assert collections.Counter(map(tuple, found)) == collections.Counter(want)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none = spark.createDataFrame([], SCHEMA)
    found = dict(corpus_pipeline.STAGES)[name](spark, none, str(tmp_path))
    assert found.count() == 0 and (name == "packing" or found.columns == none.columns)


def test_long_texts_pass_the_models(spark, long, docs):
    from parlance.llm import url_reputation

    model = language_id.train(docs)
    found = {r["doc_id"]: r for r in language_id.identify_languages(long, model).collect()}
    assert len(found) == len(LONG) and all((found[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t)) for i, t in enumerate(LONG))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    scores = quality_model.score_quality(long, quality_model.train(docs, labels)).collect()
    assert len(scores) == len(LONG) and all(0 <= r["score"] <= 1 for r in scores)
    urls = ["http://" + "a." * (N // 2) + "com/" + "x" * N, "http://" + "b" * N, "x://" + "/" * N, "://" * (N // 3), "http://[" + "1:" * N]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    judged = {r["page_id"]: r for r in url_reputation.judge_urls(pages, labels).collect()}
    assert len(judged) == len(urls) and judged[0]["host"] == "a." * (N // 2) + "com" and judged[0]["path"] == "/" + "x" * N and judged[2]["host"] == ""


def test_stretches_of_phrases_are_those_of_a_walk(spark, docs):
    """Long texts are parsed in parts side by side; each part gives the phrases that a walk over it gives."""
    model = language_id.train(docs)
    text = (fx.texts()[-2] + " ") * 2
    short, whole = model.predict([text[:900]])[0], model.predict([text])[0]
    assert short[0] == whole[0] and 0 <= whole[1] <= 1
