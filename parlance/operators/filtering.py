"""Export options, interim replies, selection and edits."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.blocks import editor_form, plain_form, text_block
from parlance.functions.redaction import redact_block
from parlance.functions.text import anonymous_url, looks_like_full_message
from parlance.schema import ExportOptions


def interim_flag() -> Column:
    """True for every assistant message of a run (documents aside) but the last."""
    own = (F.col("role") == "assistant") & (F.coalesce("kind", F.lit("")) != "document")
    following = F.lead(own).over(Window.partitionBy("conv_id").orderBy("msg_idx"))
    return F.coalesce(own & F.coalesce(following, F.lit(False)), F.lit(False))


def apply_export_options(messages: DataFrame, options: ExportOptions = ExportOptions()) -> DataFrame:
    """Images, redaction, empty messages, metadata, interim replies, in this order."""
    out = messages
    if not options.images:
        out = out.withColumn("content", F.filter("content", lambda b: b["type"] != "image"))
    out = out.where(F.size("content") > 0)  # redaction drops no block, so it needn't run for this
    if options.redact_secrets:
        out = out.withColumn("content", F.transform("content", redact_block))
    if not options.metadata:
        out = out.withColumn("metadata", F.lit(None).cast(messages.schema["metadata"].dataType))
    if not options.collapse_intermediate:
        out = out.withColumn("_interim", interim_flag()).where(~F.col("_interim")).drop("_interim")
    return out


def apply_header_options(conversations: DataFrame, options: ExportOptions = ExportOptions()) -> DataFrame:
    """What the options change in the header: the URL without its private parts, no model without metadata."""
    out = conversations
    if options.anonymize_url:
        out = out.withColumn("url", anonymous_url(F.col("url")))
    if not options.metadata:
        out = out.withColumn("model", F.lit(None).cast("string"))
    return out


def preview(messages: DataFrame, selection: DataFrame, options: ExportOptions = ExportOptions()) -> DataFrame:
    """The selected messages as an export with these options would show them, without touching metadata."""
    return apply_export_options(select_messages(messages, selection), replace(options, metadata=True))


def apply_provider_copy(messages: DataFrame, copies: DataFrame, options: ExportOptions = ExportOptions()) -> DataFrame:
    """Assistant messages get the provider's own copy (``conv_id, msg_id, copied_text``) where it plausibly is the whole message."""
    if not options.use_provider_copy:
        return messages
    copied = copies.groupBy("conv_id", F.col("msg_id").alias("id")).agg(F.max("copied_text").alias("_copy"))
    joined = messages.join(copied, ["conv_id", "id"], "left")
    visible = F.array_join(F.transform("content", plain_form), "\n\n")
    fits = (F.col("role") == "assistant") & (F.coalesce("_copy", F.lit("")) != "") & F.coalesce(looks_like_full_message(F.col("_copy"), visible), F.lit(False))
    out = joined.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    out = out.withColumn("content", F.when(F.col("_fits"), F.array(text_block(F.col("_copy")))).otherwise(F.col("content")))
    marked = F.coalesce(F.col("metadata"), F.from_json(F.lit("{}"), messages.schema["metadata"].dataType)).withField("extractionMethod", F.lit("provider-copy"))
    return out.withColumn("metadata", F.when(F.col("_fits"), marked).otherwise(F.col("metadata"))).select(*messages.columns)


def select_messages(messages: DataFrame, selection: DataFrame) -> DataFrame:
    """Messages whose (conv_id, msg_id) is selected."""
    chosen = selection.select("conv_id", F.col("msg_id").alias("id"))
    return messages.join(chosen, ["conv_id", "id"], "left_semi").select(*messages.columns)


def apply_edits(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace the content of messages whose Markdown was changed by one text block."""
    changed = edits.select("conv_id", F.col("msg_id").alias("id"), F.col("markdown").alias("_edit"))
    joined = messages.join(changed, ["conv_id", "id"], "left")
    shown = F.array_join(F.transform("content", editor_form), "\n\n")
    differs = F.col("_edit").isNotNull() & (F.col("_edit") != shown)
    return joined.withColumn("content", F.when(differs, F.array(text_block(F.col("_edit")))).otherwise(F.col("content"))).select(*messages.columns)


def redact_messages(messages: DataFrame) -> DataFrame:
    """Redacted content with ``changed``; undoing is going back to the frame before."""
    out = messages.withColumn("_redacted", F.transform("content", redact_block))
    return out.withColumn("changed", F.col("_redacted") != F.col("content")).withColumn("content", F.col("_redacted")).drop("_redacted")
