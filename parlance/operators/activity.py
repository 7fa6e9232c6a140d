"""Separate activity lines and artefact labels from the text of assistant messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.blocks import text_block
from parlance.functions.text import bind, compact_whitespace, stable_id, trim_all
from parlance.schema import BLOCK

# Activity lines and document chips, in two languages.
ACTIVITY_LINE = "(?i)^(?:dachte\\s+.{1,20}\\s*nach|thought(?:\\s+for\\s+.*)?|web[- ]?durchsucht|web ?search(?:ed)?(?: the web)?|searched the web|datei (?:erstellt|gelesen|bearbeitet|angesehen)[^.]*|[0-9]+\\s+dateien? (?:bearbeitet|erstellt|angesehen)[^.]*)\\.?\\s*\\z"
ARTIFACT = "Artefakt: "
ARTIFACT_CHIP = "(?i)^dokument(\\s*·\\s*\\S+)?\\z"


def split_message(content: Column) -> Column:
    """``content`` without activity, and ``activity`` in order, of all text blocks; artefact labels are listed once.

    Other blocks stay where they are; text blocks of which nothing is left go.
    """
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast(f"array<{BLOCK}>").alias("content"), none.alias("activity"))

    def step(acc: Column, b: Column) -> Column:
        def joined(part: Column) -> Column:
            fresh = F.filter(part["activity"], lambda x: ~x.startswith(ARTIFACT) | ~F.array_contains(acc["activity"], x))
            kept = F.when(part["text"] == "", F.array().cast(f"array<{BLOCK}>")).otherwise(F.array(text_block(part["text"])))
            return F.struct(F.concat(acc["content"], kept).alias("content"), F.concat(acc["activity"], fresh).alias("activity"))

        other = F.struct(F.concat(acc["content"], F.array(b)).alias("content"), acc["activity"].alias("activity"))
        return F.when(b["type"] == "text", bind(split_activity(F.coalesce(b["text"], F.lit(""))), joined)).otherwise(other)

    return F.aggregate(content, start, step)


def separate_activity(messages: DataFrame, prefix: str = "claude-activity") -> DataFrame:
    """Assistant messages without activity; what was split off is an activity message right before, ``msg_idx`` renumbered.

    Ids and hashes were made before the split and stay. An assistant message of which nothing is left goes.
    """
    parts = F.when(F.col("role") == "assistant", split_message(F.col("content")))
    rows = messages.withColumn("_p", parts)
    content = F.when(F.col("_p").isNotNull(), F.col("_p.content")).otherwise(F.col("content"))
    answer = F.struct("id", "role", "kind", content.alias("content"), "metadata")
    said = F.array_join("_p.activity", "\n")
    empty = F.from_json(F.lit("{}"), messages.schema["metadata"].dataType)
    meta = empty.withField("index", F.col("metadata.index")).withField("providerMessageId", F.col("metadata.providerMessageId"))
    activity = F.struct(stable_id(prefix, said).alias("id"), F.col("role"), F.lit("activity").alias("kind"), F.array(text_block(said)).alias("content"), meta.alias("metadata"))
    both = F.array_compact(F.array(F.when(F.size("_p.activity") > 0, activity), F.when(F.col("_p").isNull() | (F.size(content) > 0), answer)))
    out = rows.select("conv_id", "msg_idx", F.posexplode(both).alias("_n", "m"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("msg_idx", "_n")) - 1
    return out.select("conv_id", place.cast("int").alias("msg_idx"), "m.*")


def split_activity(text: Column) -> Column:
    """``text`` without activity, and ``activity`` in order. Artefact labels are listed once, activity lines each time."""

    def walk(parts: Column) -> Column:
        none = F.array().cast("array<string>")
        start = F.struct(F.lit(False).alias("skip"), none.alias("kept"), none.alias("activity"))

        def step(acc: Column, i: Column) -> Column:
            own, following = compact_whitespace(F.get(parts, i)), compact_whitespace(F.coalesce(F.get(parts, i + 1), F.lit("")))
            line, chip = own.rlike(ACTIVITY_LINE), (own != "") & following.rlike(ARTIFACT_CHIP)
            label = F.concat(F.lit(ARTIFACT), own)
            added = F.when(line, F.array(F.regexp_replace(own, "\\.\\z", ""))).when(chip & ~F.array_contains(acc["activity"], label), F.array(label)).otherwise(none)
            kept = F.when(line | chip, none).otherwise(F.array(F.get(parts, i)))
            return F.when(acc["skip"], F.struct(F.lit(False).alias("skip"), acc["kept"].alias("kept"), acc["activity"].alias("activity"))).otherwise(
                F.struct((chip & ~line).alias("skip"), F.concat(acc["kept"], kept).alias("kept"), F.concat(acc["activity"], added).alias("activity"))
            )

        finish = lambda acc: F.struct(trim_all(F.array_join(acc["kept"], "\n\n")).alias("text"), acc["activity"].alias("activity"))
        return F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1), start, step, finish)

    return bind(F.split(text, "\n{2,}"), walk)
