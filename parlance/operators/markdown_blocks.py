"""Blocks of Markdown texts: lines as rows, blocks as islands of lines, nothing walks a text.

* A line of three backticks, with a word behind them or not, opens a code block, the next one without a word closes it. Whether a line is
  inside follows from the last line with a word and the number of bare ones since.
* ``<details>`` at the beginning of a line opens a raw block up to the line that closes it.
* Rules, headings (1 to 6), quotes, lists, tables (two rows or more, the second one of dashes) and paragraphs are runs of lines of
  their kind. A list goes on over blank lines and over lines that are indented; another kind of marker at its outermost
  level begins a new one. Its levels are the steps of indentation, by two spaces, that it has.
* Rows of bars that make no table, and lines that begin with three backticks but aren't marks, say nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ITEM, _ORDERED = "^\\s*(?:[-*+]|\\d+[.)])\\s+", "^\\s*\\d+[.)]\\s+"
_RULE, _HEADING, _SEPARATOR = "^\\s*(?:-{3,}|\\*{3,}|_{3,})\\s*\\z", "^(#{1,6})\\s+(.*)\\z", "^\\s*\\|?[\\s:|-]+\\|?\\s*\\z"


def markdown_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line, text, kind, indent, level, island``: every line that belongs to a block, with the number of its island of lines."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n")).alias("line", "text"))
    order = Window.partitionBy("doc_id").orderBy("line")
    text = F.col("text")
    bare, named = text.rlike("^\\s*```\\s*\\z"), text.rlike("^\\s*```\\w+\\s*\\z")
    rows = rows.withColumns({"_bare": bare, "_n": F.sum(bare.cast("int")).over(order)})
    rows = rows.withColumn("_named", F.last(F.when(named, F.col("_n")), ignorenulls=True).over(order))
    rows = rows.withColumn("_in", F.when(F.col("_named").isNull(), F.col("_n") % 2 == 1).otherwise((F.col("_n") - F.col("_named")) % 2 == 0))
    rows = rows.withColumn("_code", F.coalesce(F.lag("_in").over(order), F.lit(False)))
    mark = (F.col("_code") & F.col("_bare")) | (~F.col("_code") & (F.col("_bare") | named))
    rows = rows.withColumn("_fence", F.when(mark, F.when(F.col("_code"), "close").otherwise("open")))
    # Raw blocks: from a line that opens one to the line that closes it.
    free = ~F.col("_code") & F.col("_fence").isNull()
    opens, closes = free & F.trim(text).startswith("<details>"), free & text.rlike("(?i)</details>")
    rows = rows.withColumn("_raw_after", F.coalesce(F.last(F.when(closes, F.lit(False)).when(opens, F.lit(True)), ignorenulls=True).over(order), F.lit(False)))
    rows = rows.withColumn("_raw_before", F.coalesce(F.lag("_raw_after").over(order), F.lit(False)))
    rows = rows.withColumns({"indent": F.length(text) - F.length(F.regexp_replace(text, "^\\s+", "")), "_raw": F.col("_raw_before") | opens, "_raw_opens": opens & ~F.col("_raw_before")})
    kind = (
        F.when(F.col("_fence").isNotNull(), "fence").when(F.col("_code"), "code").when(F.col("_raw"), "details").when(~text.rlike("\\S"), "blank").when(text.rlike(_RULE), "rule")
        .when(text.rlike(_HEADING), "heading").when(text.rlike("^\\s*>"), "quote").when(text.rlike(_ITEM), "item").when(F.trim(text).startswith("|"), "bar").when(text.rlike("^\\s*```"), "lost").otherwise("text")
    )
    rows = rows.withColumn("kind", kind)
    # Lists: what is neither blank nor an item nor indented ends one; lines before its first item aren't part of it.
    ends = F.col("kind").isin("fence", "code", "details") | (F.col("kind").isin("rule", "heading", "quote", "text", "bar", "lost") & (F.col("indent") == 0))
    rows = rows.withColumn("_ends", ends)
    rows = rows.withColumn("_stretch", F.sum(F.col("_ends").cast("int")).over(order))
    stretch = Window.partitionBy("doc_id", "_stretch").orderBy("line")
    first = F.first(F.when(F.col("kind") == "item", F.struct("line", "indent")), ignorenulls=True).over(stretch)
    rows = rows.withColumn("_first", first)
    in_list = ~F.col("_ends") & F.col("_first").isNotNull() & ((F.col("kind") == "item") | (F.col("indent") > F.col("_first.indent"))) & (F.col("kind") != "blank")
    rows = rows.withColumn("_list", F.coalesce(in_list, F.lit(False)))
    top = F.col("_list") & (F.col("kind") == "item") & (F.col("indent") < F.col("_first.indent") + 2)
    rows = rows.withColumns({"_top": top, "_ordered": text.rlike(_ORDERED)})
    last_top = F.last(F.when(F.col("_top"), F.col("_ordered")), ignorenulls=True).over(stretch.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("kind", F.when(F.col("_list"), F.when(F.col("kind") == "item", "item").otherwise("more")).otherwise(F.col("kind")))
    rows = rows.withColumn("_class", F.when(F.col("_list"), "list").when(F.col("kind").isin("fence", "code"), "code").otherwise(F.col("kind")))
    # An island begins where the kind changes, and where a block of one line, a code or raw block or another list begins; lists go on over blank lines.
    shown = rows.where((F.col("kind") != "blank") | ~F.col("_list")).withColumn("_last_top", last_top)
    previous = F.lag("_class").over(order)
    before = F.last(F.when(F.col("_class") != "blank", F.col("_class")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    goes_on = F.coalesce(before == "list", F.lit(False)) & F.col("_class").isin("list", "blank")
    other_list = F.col("_top") & F.col("_last_top").isNotNull() & (F.col("_ordered") != F.col("_last_top"))
    begins = F.col("_class").isin("rule", "heading") | (F.col("_fence") == "open") | F.col("_raw_opens") | other_list | previous.isNull() | (~goes_on & (previous != F.col("_class")))
    shown = shown.withColumn("island", F.sum(F.coalesce(begins, F.lit(False)).cast("int")).over(order))
    shown = shown.where(~F.col("_class").isin("blank", "lost"))
    steps = F.dense_rank().over(Window.partitionBy("doc_id", "island").orderBy(F.floor(F.col("indent") / 2)))
    level = F.when(F.col("kind") == "item", steps - 1).when(F.col("kind") == "heading", F.length(F.regexp_extract(text, _HEADING, 1)))
    return shown.select("doc_id", "line", "text", "kind", F.col("_class").alias("block_kind"), "indent", F.coalesce(level, F.lit(0)).cast("int").alias("level"), "_fence", "island")


def markdown_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, block, kind, level, first_line, n_lines, text`` for every block of every text.

    The text is a block's own: code without its fences, quotes and headings without their marks, paragraphs with trimmed
    lines, items of lists with two spaces for each level. Texts without a block, or null, give no rows.
    """
    lines = markdown_lines(docs, id_col, text_col)
    marker = F.when(F.col("text").rlike(_ORDERED), F.regexp_extract("text", "^\\s*(\\d+[.)])", 1)).otherwise("-")
    own = (
        F.when(F.col("kind") == "heading", F.regexp_extract("text", _HEADING, 2)).when(F.col("kind") == "quote", F.regexp_replace("text", "^\\s*>\\s?", "")).when(F.col("kind") == "text", F.trim("text"))
        .when(F.col("kind") == "item", F.concat(F.repeat(F.lit("  "), F.col("level")), marker, F.lit(" "), F.regexp_replace("text", _ITEM, "")))
        .when(F.col("kind") == "more", F.concat(F.lit("\x01"), F.trim("text"))).when(F.col("kind").isin("fence", "rule"), F.lit(None).cast("string")).otherwise(F.col("text"))
    )
    whole = lines.groupBy("doc_id", "island").agg(
        F.first("block_kind").alias("kind"), F.min("line").alias("first_line"), F.count("*").cast("int").alias("n_lines"), F.max("level").alias("level"),
        F.array_sort(F.collect_list(F.when(own.isNotNull(), F.struct("line", own.alias("t"))))).alias("x"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("y"),
    )
    text = F.regexp_replace(F.replace(F.array_join(F.transform("x", lambda x: x["t"]), "\n"), F.lit("\n\x01"), F.lit(" ")), "^\x01", "")
    table = (F.size("y") >= 2) & F.get(F.col("y"), F.lit(1))["text"].rlike(_SEPARATOR)
    found = whole.withColumn("text", text).where((F.col("kind") != "bar") | table)
    kind = F.when(F.col("kind") == "bar", "table").when(F.col("kind") == "text", "paragraph").otherwise(F.col("kind"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("island")) - 1
    return found.select("doc_id", place.cast("int").alias("block"), kind.alias("kind"), "level", "first_line", "n_lines", "text")
