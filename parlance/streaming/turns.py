"""Streaming forms: quick Markdown of arriving turns and first-seen messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.redaction import redact_text


def redacted_turns(turns: DataFrame) -> DataFrame:
    """Row-local, so it runs on streams as on tables."""
    return turns.withColumn("text", redact_text(F.col("text")))


def first_seen(turns: DataFrame, delay: str = "1 hour", time_col: str = "ts") -> DataFrame:
    """Drop repeats of (conversation, role, text) within the watermark's reach."""
    keyed = turns.withWatermark(time_col, delay).withColumn("text_hash", F.sha2("text", 256))
    return keyed.dropDuplicatesWithinWatermark(["conv_id", "role", "text_hash"])
