"""Evidence: the files of a conversation, their hashes and a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import data_url_bytes, image_extension, json_array, json_object, json_string
from parlance.operators.rendering import export_json, export_markdown
from parlance.operators.sanitising import page_snapshots
from parlance.schema import SCHEMA_VERSION

# Fixed value: the warning that goes with an unredacted page.
ORIGINAL_PAGE_WARNING = "Original page evidence is unredacted and is not affected by transcript selection or edits."


def _image_name(message: Column, block: Column, b: Column) -> Column:
    return F.format_string("artifacts/images/message-%d-image-%d.%s", message + 1, block + 1, image_extension(b["mime_type"], b["filename"]))


def numbered(messages: DataFrame) -> DataFrame:
    """Messages with ``place``, their position among those that are exported, from 0."""
    return messages.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("msg_idx")) - 1)


def image_files(messages: DataFrame) -> DataFrame:
    """``conv_id, seq, name, data`` and the artefact's fields, of images with a data URL; ``seq`` orders by message and block."""
    blocks = numbered(messages).select("conv_id", "place", F.posexplode("content").alias("block", "b")).where((F.col("b.type") == "image") & (F.col("b.data_url") != ""))
    data = data_url_bytes(F.col("b.data_url"))
    return blocks.select(
        "conv_id", F.struct(F.lit(10).alias("group"), F.col("place").cast("long").alias("a"), F.col("block").cast("long").alias("b")).alias("seq"),
        _image_name(F.col("place"), F.col("block"), F.col("b")).alias("name"), data.alias("data"),
        F.format_string("image-%d-%d", F.col("place") + 1, F.col("block") + 1).alias("artifact_id"), F.coalesce("b.mime_type", F.lit("image/png")).alias("mime_type"),
    )


def with_image_files(messages: DataFrame) -> DataFrame:
    """Messages whose images point to their files instead of holding the data."""

    def stored(b: Column, block: Column) -> Column:
        name = _image_name(F.col("place"), block, b)
        moved = b.withField("src", name).withField("filename", F.coalesce(b["filename"], F.element_at(F.split(name, "/"), -1))).withField("data_url", F.lit(None).cast("string"))
        return F.when((b["type"] == "image") & (b["data_url"] != ""), moved).otherwise(b)

    return numbered(messages).withColumn("content", F.transform("content", stored)).select(*messages.columns)


def _file(frame: DataFrame, group: int, name: str, data: Column) -> DataFrame:
    seq = F.struct(F.lit(group).alias("group"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    none = F.lit(None).cast("string")
    return frame.select("conv_id", seq.alias("seq"), F.lit(name).alias("name"), data.alias("data"), none.alias("artifact_id"), none.alias("mime_type"))


def evidence_files(messages: DataFrame, conversations: DataFrame, version: str, originals: DataFrame | None = None) -> DataFrame:
    """``conv_id, seq, name, data, artifact_id, mime_type``: transcript, JSON, images and, where asked for, the page.

    ``originals`` has ``conv_id, include_original, html_snapshot, screenshot``; only rows that opt in give files, and
    only of what they hold. Pages are sanitised: nothing hidden or executable is written.
    """
    shown = with_image_files(messages)
    out = image_files(messages)
    for group, name, render in ((1, "transcript.md", export_markdown), (2, "conversation.json", export_json)):
        out = out.unionByName(_file(render(shown, conversations, version), group, name, F.encode("content", "UTF-8")))
    if originals is not None:
        asked = originals.where(F.col("include_original"))
        pages = page_snapshots(asked.where(F.col("html_snapshot") != ""), "conv_id", "html_snapshot").withColumnRenamed("page_id", "conv_id")
        out = out.unionByName(_file(pages, 20, "snapshot.html", F.encode("html", "UTF-8")))
        out = out.unionByName(_file(asked.where(F.length("screenshot") > 0), 21, "visible-screenshot.png", F.col("screenshot")))
    return out


def manifest(files: DataFrame, conversations: DataFrame, version: str, generated_at: str, originals: DataFrame | None = None, browser: str | None = None, platform: str | None = None) -> DataFrame:
    """``conv_id, hashes, manifest``: SHA-256 of every file by name, and the manifest as JSON with twelve fields.

    Only names, sizes and hashes of a conversation's files come together, not their contents.
    """
    item = F.struct("seq", "name", F.sha2("data", 256).alias("sha256"), F.octet_length("data").alias("bytes"), "artifact_id", "mime_type")
    whole = files.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("f"))
    hashes = F.map_from_entries(F.transform("f", lambda x: F.struct(x["name"], x["sha256"])))
    joined = whole.join(conversations, "conv_id", "left")
    asked = F.lit(False)
    if originals is not None:
        joined = joined.join(originals.select("conv_id", F.col("include_original").alias("_asked")), "conv_id", "left")
        asked = F.coalesce("_asked", F.lit(False))
    quoted = lambda c: F.when(c.isNotNull(), json_string(c))
    names = F.transform("f", lambda x: x["name"])
    artifacts = F.transform(F.filter("f", lambda x: x["artifact_id"].isNotNull()), lambda x: json_object({
        "id": json_string(x["artifact_id"]), "type": F.lit('"image"'), "filename": json_string(x["name"]), "mime_type": quoted(x["mime_type"]), "bytes": x["bytes"].cast("string"), "sha256": json_string(x["sha256"]),
    }, 2))
    by_name = json_array(F.transform("f", lambda x: F.concat(json_string(x["name"]), F.lit(": "), json_string(x["sha256"]))), 1)
    body = json_object({
        "schema_version": json_string(F.lit(SCHEMA_VERSION)),
        "capture": F.when(F.col("status").isNotNull(), json_object({"status": quoted(F.col("status")), "reasons": json_array(F.transform("reasons", json_string), 2)}, 1)),
        "original_page_included": (asked & (F.array_contains(names, "snapshot.html") | F.array_contains(names, "visible-screenshot.png"))).cast("string"),
        "original_page_warning": F.when(asked, json_string(F.lit(ORIGINAL_PAGE_WARNING))),
        "source": json_object({k: quoted(F.col(k)) for k in ("provider", "url", "title", "captured_at", "model")}, 1),
        "extension_version": json_string(F.lit(version)),
        "artifacts": json_array(artifacts, 1),
        "browser": quoted(F.lit(browser).cast("string")),
        "platform": quoted(F.lit(platform).cast("string")),
        "generated_at": json_string(F.lit(generated_at)),
        "exported_formats": json_array(F.transform(names, json_string), 1),
        "hashes": F.concat(F.lit("{"), by_name.substr(F.lit(2), F.length(by_name) - 2), F.lit("}")),
    })
    return joined.select("conv_id", hashes.alias("hashes"), body.alias("manifest"))
