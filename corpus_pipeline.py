"""A training corpus from ``documents``: language, common lines, near copies, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that the stage before kept. All but the last
return the columns of ``documents``; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import decontamination, language_id, line_dedup, ngram_join, packing
from parlance.llm.common import delete, new_path, release, stage_tables, stored, without
from parlance.llm.queries import table, tokenizer_path


def _text_id(docs: DataFrame) -> DataFrame:
    """The rows with a name of their text, ``_text``, for decisions that hang on the text alone."""
    return docs.withColumn("_text", F.md5(F.coalesce("text", F.lit(""))))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without any letter; ``lang`` becomes the prediction. Documents of which none has a label are refused.

    Null and empty texts have no letter; repeated rows are judged each; an empty table gives none.
    """
    model = language_id.train(docs)
    if not model.names and not docs.isEmpty():
        raise ValueError("no document has a language to learn from")
    found = docs.withColumn("_found", language_id.language_column(spark, model)(F.col("text")))
    kept = found.where(F.col("_found.lang_pred") != "und").withColumn("lang", F.col("_found.lang_pred"))
    return kept.select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go from all of them; documents of which nothing is left go too.

    A repeated row counts as a document. Null and empty texts, which lose no line, stay; an empty table gives none.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    found = line_dedup.drop_common_lines(docs, min_docs=10, carry=others)
    kept = found.where((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    named = {c: F.col(f"_{i}") for i, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.select(*(named[c].alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by a five-word shingle similarity of 0.8 or more, one of the least id stays; rows without an id come last."""
    # A key of each row's own; stored, as it has to be the same each time the rows are read.
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = stored(ngram_join.jaccard_components(rows, id_col="_row", width=5, percent=80).select(F.col("doc_id").alias("_row"), "component_id"), "row-components")
    many = found.groupBy("component_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    members = found.join(many, "component_id").join(rows.select("_row", "doc_id"), "_row")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    first = members.groupBy("component_id").agg(F.min(place).alias("first")).select("first._row")
    gone = stored(members.select("_row").join(first, "_row", "left_anti"), "near-copies")
    return without(rows, gone, "_row").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold ten consecutive words of a benchmark item (or a whole shorter item) go.

    Texts decide, so rows without an id and repeated rows go together; null and empty texts stay; an empty table gives none.
    """
    rows = _text_id(docs)
    found = decontamination.find_contamination(rows, table(spark, sf_dir, "benchmark"), id_col="_text")
    gone = stored(found.where("contaminated").select(F.col("doc_id").alias("_text")).distinct(), "contaminated-texts")
    return without(rows, gone, "_text").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; null and empty texts have the one id that ends a document, an empty table gives no pieces."""
    return packing.pack_documents(docs, tokenizer_path())


#: Spark's bound on the bytes of a batch that a task hands its Python worker, and ours: whole texts are wide, and 10,000
#: of them are held several times over on the way.
BATCH_BOUND, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def _has_own_bound(spark: SparkSession) -> bool:
    return spark.conf.get(BATCH_BOUND, "1") != "1"  # what is given is returned if the session has none


def _stage(function: Callable) -> Callable:
    """The stage, with the tables its operators store held until the next stage begins.

    Batches are of ``BATCH_BYTES``, unless the session has a bound of its own; results are lazy, so the session
    keeps it; ``run``, which writes them, takes it back.
    """

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not _has_own_bound(spark):
            spark.conf.set(BATCH_BOUND, str(BATCH_BYTES))
        with stage_tables(spark, sf_dir):
            return function(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _stage(identify_language)),
    ("line_dedup", _stage(drop_common_lines)),
    ("ngram_join", _stage(drop_near_copies)),
    ("decontamination", _stage(drop_contaminated)),
    ("packing", _stage(pack)),
]

#: SQL can express neither the language model nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the stages before it wrote is deleted once the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    bounded = _has_own_bound(spark)
    try:
        for name, stage in STAGES:
            path = new_path(spark, name)
            stage(spark, docs, sf_dir).write.parquet(path)
            release(spark, sf_dir)
            if before:
                delete(spark, before)
            docs, before = spark.read.parquet(path), path
    finally:
        if not bounded:
            spark.conf.unset(BATCH_BOUND)
    return docs
