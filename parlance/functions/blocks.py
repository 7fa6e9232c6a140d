"""Content blocks: builders and their two Markdown forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.text import prefix_lines, trim_all
from parlance.schema import BLOCK

_FIELDS = ("type", "text", "language", "markdown", "url", "alt", "src", "filename", "data_url", "mime_type")


def text_block(c: Column) -> Column:
    rest = [F.lit(None).cast("string").alias(f) for f in _FIELDS[2:]]
    return F.struct(F.lit("text").alias("type"), c.alias("text"), *rest).cast(BLOCK)


def _fence(b: Column) -> Column:
    return F.concat(F.lit("```"), F.coalesce(b["language"], F.lit("")), F.lit("\n"), b["text"], F.lit("\n```"))


def export_form(b: Column) -> Column:
    """A block as exported documents show it."""
    image = F.concat(F.lit("!["), F.coalesce(b["alt"], b["filename"], F.lit("image")), F.lit("]("), F.coalesce(b["src"], b["filename"], F.lit("")), F.lit(")"))
    return F.when(b["type"] == "code", _fence(b)).when(b["type"] == "table", b["markdown"]).when(b["type"] == "quote", prefix_lines(b["text"], "> >")).when(b["type"] == "image", image).otherwise(b["text"])


def editor_form(b: Column) -> Column:
    """A block as the editor and JSON show it: every quoted line prefixed, images only with a source."""
    quote = F.array_join(F.transform(F.split(b["text"], "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")
    alt = F.when(b["alt"].rlike("(?i)^https?:"), F.lit("")).otherwise(F.coalesce(F.regexp_replace(b["alt"], "[\\[\\]]", ""), F.lit("")))
    image = F.when(F.coalesce(b["src"], F.lit("")) == "", F.coalesce(b["alt"], b["filename"], F.lit(""))).otherwise(F.concat(F.lit("!["), alt, F.lit("]("), b["src"], F.lit(")")))
    return F.when(b["type"] == "code", _fence(b)).when(b["type"] == "table", b["markdown"]).when(b["type"] == "quote", quote).when(b["type"] == "image", image).otherwise(b["text"])


def plain_form(b: Column) -> Column:
    """A block's text as used for keys and plain text; images by alt, source and file name."""
    empty = F.lit("")
    image = F.concat_ws(":", F.coalesce(b["alt"], empty), F.coalesce(b["src"], empty), F.coalesce(b["filename"], empty))
    return F.when(b["type"] == "table", b["markdown"]).when(b["type"] == "image", image).otherwise(b["text"])


def plain_text(content: Column) -> Column:
    """All blocks as plain text, blank lines between them; images by what of alt, file name and source they have."""
    some = lambda c: F.when(c != "", c)
    shown = lambda b: F.when(b["type"] == "table", b["markdown"]).when(b["type"] == "image", F.concat_ws(" ", some(b["alt"]), some(b["filename"]), some(b["src"]))).otherwise(b["text"])
    return trim_all(F.array_join(F.transform(content, shown), "\n\n"))


def merge_adjacent_text(content: Column) -> Column:
    """Runs of text blocks become one, joined by blank lines; blocks without text go."""

    def step(acc: Column, b: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = last.withField("text", F.concat_ws("\n\n", last["text"], b["text"]))
        both = (F.size(acc) > 0) & (b["type"] == "text") & (F.try_element_at(acc, F.lit(-1))["type"] == "text")
        return F.when(both, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(b)))

    return F.aggregate(content, F.array().cast(f"array<{BLOCK}>"), step)
