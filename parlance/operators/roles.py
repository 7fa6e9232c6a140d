"""Roles, models and document messages from what a page says of its messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.blocks import plain_form, text_block
from parlance.functions.text import AB, compact_whitespace, stable_id
from parlance.schema import METADATA

# Words in attributes, and labels at the start of a text, that tell who speaks.
USER_MARKS, ASSISTANT_MARKS = "user|human|you|ich|me", "assistant|claude|chatgpt|bot|ai"
USER_LABELS, ASSISTANT_LABELS = "you said|you|user|human|ich|du hast gesagt", "assistant|ai|bot|chatgpt|claude|gemini|copilot"


def infer_role(marks: Column, text: Column, index: Column) -> Column:
    """Role by the words of an element's attributes, else by a leading speaker label, else by turns."""
    marked = F.lower(compact_whitespace(F.coalesce(marks, F.lit(""))))
    label = F.lower(compact_whitespace(F.substring(F.coalesce(text, F.lit("")), 1, 80)))
    by_turn = F.when(index % 2 == 0, "user").otherwise("assistant")
    return (
        F.when(marked.rlike(f"{AB}({USER_MARKS}){AB}"), "user")
        .when(marked.rlike(f"{AB}({ASSISTANT_MARKS}){AB}"), "assistant")
        .when(label.rlike(f"^({USER_LABELS})\\s*:"), "user")
        .when(label.rlike(f"^({ASSISTANT_LABELS})( said)?\\s*:"), "assistant")
        .otherwise(by_turn)
    )


def infer_row_role(marks: Column, text: Column, index: Column) -> Column:
    """Role of a transcript row: the words count inside longer ones, too."""
    marked = F.lower(F.coalesce(marks, F.lit("")))
    return F.when(marked.rlike("user|human"), "user").when(marked.rlike("assistant|claude"), "assistant").otherwise(infer_role(marks, text, index))


def message_model(role: Column, model: Column) -> Column:
    """The model of a message: that of the page, for assistant messages only."""
    return F.when(role == "assistant", model)


def content_key(content: Column) -> Column:
    """Texts of the blocks, one below the other, cut at 500 characters."""
    return F.substring(F.array_join(F.transform(content, plain_form), "\n"), 1, 500)


def document_message(text: Column, index: Column) -> Column:
    """A section of a document page as a message (id, role, kind, content, metadata)."""
    content = F.array(text_block(text))
    identity = stable_id("document", F.concat_ws(":", index.cast("string"), content_key(content)))
    names = [f.split(":")[0] for f in METADATA[len("struct<") : -1].split(",")]
    known = {"index": index.cast("int"), "visibleTextHash": F.sha2(text, 256)}
    metadata = F.struct(*(known.get(n, F.lit(None).cast("string")).alias(n) for n in names))
    return F.struct(identity.alias("id"), F.lit("assistant").alias("role"), F.lit("document").alias("kind"), content.alias("content"), metadata.alias("metadata"))
