"""Sources of messages: stored turns and pasted transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.blocks import text_block
from parlance.functions.text import bind, stable_id, trim_all
from parlance.schema import METADATA

# Speaker labels of pasted transcripts.
SPEAKERS = "user|you|human|assistant|chatgpt|claude|ai"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table, as the optimiser estimates them, up to which it is dealt over all cores.
SPREAD_BYTES = 64 << 20


def spread(table: DataFrame) -> DataFrame:
    """A small table over all cores; larger ones, whose files have parts enough, stay as they are, unmoved.

    For costly work row by row: a small table in one row group would keep one core busy and all others idle.
    """
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(table.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else table


def _metadata(index: Column, text: Column) -> Column:
    fields = {"index": index.cast("int"), "visibleTextHash": F.sha2(text, 256)}
    names = [f.split(":")[0] for f in METADATA[len("struct<") : -1].split(",")]
    return F.struct(*(fields.get(n, F.lit(None).cast("int" if n == "index" else "string")).alias(n) for n in names))


def message_columns(role: Column, index: Column, text: Column) -> list[Column]:
    identity = F.concat_ws("-", role, index.cast("string"), stable_id(role, text))
    return [identity.alias("id"), role.alias("role"), F.lit(None).cast("string").alias("kind"), F.array(text_block(text)).alias("content"), _metadata(index, text).alias("metadata")]


def messages_from_turns(turns: DataFrame) -> DataFrame:
    """Messages from ``conv_id, turn, role, text``; a null text is empty, a null role unknown."""
    rows = turns.select("conv_id", F.col("turn").cast("int").alias("msg_idx"), F.coalesce("role", F.lit("unknown")).alias("r"), F.coalesce("text", F.lit("")).alias("t"))
    return rows.select("conv_id", "msg_idx", *message_columns(F.col("r"), F.col("msg_idx"), F.col("t")))


def messages_from_clipboard(pasted: DataFrame) -> DataFrame:
    """Messages from ``conv_id, text``: split at speaker labels, else at blank lines; blank texts give none."""
    clean = lambda parts: F.filter(F.transform(parts, trim_all), lambda x: x != "")
    labelled = clean(F.split("text", f"(?i)\\n(?=(?:{SPEAKERS})[\\s]*:)"))
    paragraphs = clean(F.split("text", "\\n{2,}"))
    label = "(?s)^([^:\\n]{1,24})\\s*:\\s*(.*)\\z"
    parsed = lambda b: F.struct(F.when(b.rlike(label), F.regexp_extract(b, label, 1)).alias("label"), F.when(b.rlike(label), F.regexp_extract(b, label, 2)).otherwise(b).alias("text"))
    plain = lambda b: F.struct(F.lit(None).cast("string").alias("label"), b.alias("text"))
    parts = bind(labelled, lambda x: F.when(F.size(x) > 1, F.transform(x, parsed)).otherwise(F.transform(paragraphs, plain)))
    rows = pasted.select("conv_id", F.posexplode(parts).alias("msg_idx", "part"))
    name, index = F.lower(F.coalesce("part.label", F.lit(""))), F.col("msg_idx")
    role = F.when(name.rlike("user|you|human"), "user").when(name.rlike("assistant|chatgpt|claude|ai"), "assistant").when(index % 2 == 0, "user").otherwise("assistant")
    rows = rows.select("conv_id", "msg_idx", role.alias("r"), trim_all(F.col("part.text")).alias("t"))
    return rows.select("conv_id", "msg_idx", *message_columns(F.col("r"), index, F.col("t")))


def base_conversations(conversations: DataFrame, captured_at: str) -> DataFrame:
    """Headers from ``conv_id`` and, if there, ``provider, title, url, model, status, reasons``; the provider stands in for a missing title."""
    text = lambda c: F.col(c).cast("string") if c in conversations.columns else F.lit(None).cast("string")
    provider = F.coalesce(text("provider"), F.lit("generic"))
    title = F.when(F.coalesce(text("title"), F.lit("")) == "", provider).otherwise(text("title"))
    reasons = F.col("reasons") if "reasons" in conversations.columns else F.lit(None).cast("array<string>")
    return conversations.select(
        "conv_id", provider.alias("provider"), title.alias("title"), F.coalesce(text("url"), F.lit("")).alias("url"), F.lit(captured_at).alias("captured_at"),
        text("model").alias("model"), text("status").alias("status"), reasons.alias("reasons"),
    )
