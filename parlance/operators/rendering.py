"""Markdown and JSON exports: one row for each conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.blocks import editor_form, export_form
from parlance.functions.text import compact_whitespace, escape_html, json_array, json_object, json_string, prefix_lines, slugify
from parlance.operators.filtering import apply_export_options, apply_header_options, interim_flag
from parlance.schema import SCHEMA_VERSION, ExportOptions

LABEL_LENGTH, LABELS_SHOWN = 80, 4


def capture_warning(status: Column, reasons: Column) -> Column:
    """The sentence for incomplete captures, else null."""
    said = lambda r: F.when(r == "load-limit", "the older-message loading limit was reached").otherwise("the scrolling limit was reached")
    text = F.concat(F.lit("Incomplete capture: "), F.array_join(F.transform(reasons, said), "; "), F.lit(". Messages may be missing."))
    return F.when(status == "incomplete", text)


def _collapsed(interim: Column) -> Column:
    """A run of interim messages as one fold: activity labels in the summary, other bodies inside."""
    activity = F.filter(interim, lambda m: m["kind"].eqNullSafe("activity"))
    others = F.filter(interim, lambda m: ~m["kind"].eqNullSafe("activity"))
    lines = F.transform(F.flatten(F.transform(activity, lambda m: F.split(m["body"], "\n"))), compact_whitespace)
    labels = F.array_distinct(F.filter(lines, lambda x: F.length(x).between(1, LABEL_LENGTH)))
    more = F.when(F.size(labels) > LABELS_SHOWN, F.array(F.concat(F.lit("+"), (F.size(labels) - LABELS_SHOWN).cast("string")))).otherwise(F.array().cast("array<string>"))
    n = F.size(others)
    earlier = F.when(n > 0, F.concat(n.cast("string"), F.lit(" previous message"), F.when(n == 1, F.lit("")).otherwise(F.lit("s"))))
    summary = F.concat_ws(" · ", F.slice(labels, 1, LABELS_SHOWN), more, earlier)
    plain = F.concat(F.lit("_"), escape_html(summary, False, False), F.lit("_\n"))
    bodies = F.transform(others, lambda m: F.concat(m["body"], F.lit("\n")))
    fold = F.concat_ws("\n", F.concat(F.lit("<details><summary>"), escape_html(summary, False, False), F.lit("</summary>\n")), bodies, F.lit("</details>\n"))
    return F.when(F.size(interim) > 0, F.when((n == 0) & (F.size(labels) > 0), plain).otherwise(fold))


def front_matter(fields: dict[str, Column]) -> Column:
    lines = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}: "), json_string(v.cast("string")))) for k, v in fields.items()]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---\n"))


def export_markdown(messages: DataFrame, conversations: DataFrame, version: str) -> DataFrame:
    """``conv_id, filename, content``. Conversations without messages have a front matter and a title only.

    One exchange by ``conv_id`` serves the window, the runs and the conversation.
    """
    rows = messages.withColumn("interim", interim_flag()).withColumn("body", F.array_join(F.transform("content", export_form), "\n\n"))
    before = Window.partitionBy("conv_id").orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("run", F.coalesce(F.sum((~F.col("interim")).cast("int")).over(before), F.lit(0)))
    quoted = F.when(F.col("role") == "assistant", F.col("body")).otherwise(prefix_lines(F.col("body")))
    member = F.struct("msg_idx", "kind", "body")
    runs = rows.groupBy("conv_id", "run").agg(
        F.array_sort(F.collect_list(F.when(F.col("interim") & (F.col("body") != ""), member))).alias("folded"),
        F.max(F.when(~F.col("interim") & (F.col("body") != ""), F.concat(quoted, F.lit("\n")))).alias("shown"),
        F.count("*").alias("n"),
    )
    text = F.concat_ws("\n", _collapsed(F.col("folded")), F.col("shown"))
    whole = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("run", text.alias("text")))).alias("parts"), F.sum("n").alias("message_count"))
    joined = conversations.join(whole, "conv_id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))
    body = F.array_join(F.filter(F.transform("parts", lambda p: p["text"]), lambda x: x != ""), "\n")
    head = front_matter({"schema_version": F.lit(SCHEMA_VERSION), **{k: F.col(k) for k in ("provider", "title", "url", "captured_at", "model", "message_count")}, "extension_version": F.lit(version)})
    title = F.concat(F.lit("# "), F.when(F.coalesce("title", F.lit("")) == "", "Chat Export").otherwise(F.col("title")))
    warning = F.concat(F.lit("\n> "), capture_warning(F.col("status"), F.col("reasons")))
    content = F.regexp_replace(F.concat_ws("\n", head, title, warning, F.lit(""), body), "\\n{4,}", "\n\n\n")
    return joined.select("conv_id", F.concat(slugify(F.col("title")), F.lit(".md")).alias("filename"), F.concat(F.regexp_replace(content, "\\s+\\z", ""), F.lit("\n")).alias("content"))


def _quoted(c: Column) -> Column:
    return F.when(c.isNotNull(), json_string(c))


def export_json(messages: DataFrame, conversations: DataFrame, version: str) -> DataFrame:
    """``conv_id, filename, content``: JSON with two spaces of indent; absent keys are left out, and metadata without any key."""
    meta = F.col("metadata")
    names = [f.name for f in messages.schema["metadata"].dataType.fields]
    known = {n: F.col(f"metadata.{n}").cast("string") if n == "index" else _quoted(F.col(f"metadata.{n}")) for n in names}
    some = F.coalesce(*(meta[n].cast("string") for n in names)).isNotNull()
    message = json_object({
        "role": _quoted(F.col("role")), "content": _quoted(F.array_join(F.transform("content", editor_form), "\n\n")),
        "kind": F.when(F.col("kind") != "", json_string(F.col("kind"))), "metadata": F.when(some, json_object(known, 3)),
    }, 2)
    whole = messages.select("conv_id", F.struct("msg_idx", message.alias("m")).alias("item")).groupBy("conv_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    joined = conversations.join(whole, "conv_id", "left")
    listed = F.transform(F.coalesce("items", F.array()), lambda x: x["m"])
    reasons = json_array(F.transform("reasons", json_string), 2)
    body = json_object({
        **{k: _quoted(F.col(k)) for k in ("title", "provider", "model", "url", "captured_at")}, "extension_version": json_string(F.lit(version)),
        "capture": F.when(F.col("status").isNotNull(), json_object({"status": _quoted(F.col("status")), "reasons": reasons}, 1)),
        "message_count": F.size(listed).cast("string"), "messages": json_array(listed, 1),
    })
    return joined.select("conv_id", F.concat(slugify(F.col("title")), F.lit(".json")).alias("filename"), body.alias("content"))


def meta_line(count: Column, total: Column, all_documents: Column, conversation: dict[str, Column]) -> Column:
    """``n of m messages``, provider, model, time and URL, joined by middle dots; documents have sections."""
    unit = F.when((total > 0) & all_documents, "sections").otherwise("messages")
    number = F.when(count == total, total.cast("string")).otherwise(F.concat(count.cast("string"), F.lit(" of "), total.cast("string")))
    some = lambda k: F.when(conversation[k] != "", conversation[k])
    return F.concat_ws(" · ", F.concat_ws(" ", number, unit), some("provider"), some("model"), F.concat(F.lit("captured "), some("captured_at")), some("url"))


FORMATS = {"md": export_markdown, "json": export_json}


def export(messages: DataFrame, conversations: DataFrame, kind: str = "md", options: ExportOptions = ExportOptions(), version: str = "1.0.0") -> DataFrame:
    """``conv_id, filename, content`` of messages and headers with the options applied; ``kind`` is ``md`` or ``json``."""
    if kind not in FORMATS:
        raise ValueError(f"formats are {', '.join(FORMATS)}")
    return FORMATS[kind](apply_export_options(messages, options), apply_header_options(conversations, options), version)


def quick_markdown(messages: DataFrame, conversations: DataFrame, version: str = "1.0.0") -> DataFrame:
    """Markdown with the default options."""
    return export(messages, conversations, "md", ExportOptions(), version)


def save_exports(exports: DataFrame, path: str) -> None:
    """Write exports as Parquet, dealt by conversation; a file of the table holds many conversations."""
    exports.write.mode("errorifexists").parquet(path)
