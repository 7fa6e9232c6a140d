"""Completeness report of captured conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def capture_report(messages: DataFrame) -> DataFrame:
    """Counts by role and kind, duplicates, empty messages, provider ids, and whether the order has gaps.

    A row for each conversation; least and largest id, and whether ids increase, where all messages have numbers as ids.
    """
    text = F.array_join(F.transform("content", lambda b: b["text"]), "\n\n")
    step = F.col("msg_idx") - F.lag("msg_idx").over(Window.partitionBy("conv_id").orderBy("msg_idx"))
    provider_id = F.col("metadata.providerMessageId")
    before = F.lag(provider_id.try_cast("long")).over(Window.partitionBy("conv_id").orderBy("msg_idx"))
    rows = messages.select("conv_id", "msg_idx", "role", "kind", text.alias("text"), step.alias("step"), provider_id.alias("provider_id"), before.alias("before"))
    number = F.col("provider_id").try_cast("long")
    numeric = F.bool_and(F.coalesce(F.col("provider_id").rlike("^[0-9]+\\z"), F.lit(False)))
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("role") == "user").alias("n_user"),
        F.count_if(F.col("role") == "assistant").alias("n_assistant"),
        (F.count("*") - F.count_distinct("role", "text")).alias("n_duplicates"),
        F.count_if(F.col("text") == "").alias("n_empty"),
        F.min("msg_idx").alias("first_idx"),
        F.max("msg_idx").alias("last_idx"),
        F.coalesce(F.bool_and(F.col("step") == 1), F.lit(True)).alias("contiguous"),
        F.count_if(F.col("kind") == "activity").alias("n_activity"),
        F.count_if(F.col("kind") == "document").alias("n_documents"),
        F.count_if(F.coalesce("provider_id", F.lit("")) != "").alias("n_with_id"),
        F.when(numeric, F.min(number)).alias("min_id"),
        F.when(numeric, F.max(number)).alias("max_id"),
        F.when(numeric, F.coalesce(F.bool_and(number > F.col("before")), F.lit(True))).alias("ids_increase"),
        F.substring(F.min_by("text", "msg_idx"), 1, 50).alias("first_text"),
        F.substring(F.max_by("text", "msg_idx"), 1, 50).alias("last_text"),
    )
