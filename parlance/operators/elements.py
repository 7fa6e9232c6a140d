"""Selection among the nodes of pages: containment, the root of a chat, sections of a document, lists and tables.

All of it works on the intervals of ``sources.pages``: sorted walks with running values, no node is compared with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import AB, WS, compact_whitespace, filename_of_url, trim_all
from parlance.operators.roles import document_message
from parlance.sources.pages import events, in_order, with_sums, with_text

# Elements by their part in a page, and words that tell who speaks.
PRUNED = ("nav", "header", "footer", "aside", "form")
SECTIONS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "ol", "pre", "table", "blockquote", "figure", "details", "hr", "section")
NO_MESSAGE = (*PRUNED, "input", "textarea", "button")
INTERACTIVE = ("button", "input", "textarea", "select")
ROLE_WORDS = "user|assistant|you|human|ai|chatgpt|claude"
MOST_BLOCKS = 80
# What the elements of a provider's transcript are called.
TRANSCRIPT_IDS, TRANSCRIPT_CLASS, TRANSCRIPT_CLASS_PART = ("transcript-row", "user-message", "assistant-message"), "font-claude-response", "font-claude-message"


def attribute(name: str) -> Column:
    return F.coalesce(F.try_element_at("attributes", F.lit(name)), F.lit(""))


def has_class(word: str) -> Column:
    """Whether the class attribute holds ``word`` anywhere, in any case."""
    return F.contains(F.lower(attribute("class")), F.lit(word))


def innermost(candidates: DataFrame) -> DataFrame:
    """The candidates (``page_id, start, stop``) that contain no other one: the next candidate starts behind their end."""
    following = F.lead("start").over(Window.partitionBy("page_id").orderBy("start"))
    return candidates.withColumn("_next", following).where(F.col("_next").isNull() | (F.col("_next") >= F.col("stop"))).drop("_next")


def outermost(candidates: DataFrame) -> DataFrame:
    """The candidates that no other one contains: all before them have ended."""
    before = F.max("stop").over(Window.partitionBy("page_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return candidates.withColumn("_ended", before).where(F.col("_ended").isNull() | (F.col("_ended") <= F.col("start"))).drop("_ended")


def count_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"(?i){AB}(?:{ROLE_WORDS}){AB}"), F.lit(0)))


def chat_roots(nodes: DataFrame) -> DataFrame:
    """``page_id, start, tag, score``: for each page the likeliest root of a chat, none for pages without a candidate.

    Four points for each message-like element inside, one for each word that tells a role, one for each thousand
    characters up to twenty. The first of equals wins. Candidates without text don't count.
    """
    message = (F.col("tag") == "article") | (attribute("role") == "listitem") | has_class("message") | (F.col("tag") == "pre")
    candidate = (F.col("tag") == "main") | (attribute("role") == "main") | has_class("chat") | has_class("conversation") | (F.col("tag") == "body")
    counted = with_sums(nodes, {"messages": F.coalesce(message, F.lit(False)).cast("int")})
    texts = with_text(counted, (F.col("tag") != "#text") & candidate).withColumn("content", compact_whitespace(F.col("content"))).where(F.col("content") != "")
    score = F.col("messages") * 4 + count_words(F.col("content")) + F.least(F.length("content") / 1000, F.lit(20.0))
    best = texts.withColumn("score", score).groupBy("page_id").agg(F.max_by(F.struct("start", "tag", "score"), F.struct("score", -F.col("start"))).alias("b"))
    return best.select("page_id", "b.*")


def page_marks(nodes: DataFrame) -> DataFrame:
    """``page_id, chatgpt_marks, claude_marks``: whether a page of an unknown host looks like one of the two providers, for ``routing.provider``."""
    has = lambda name: F.coalesce(F.map_contains_key("attributes", F.lit(name)), F.lit(False))
    title = F.coalesce(F.max(F.when(F.col("parent_tag") == "title", F.contains(F.lower("text"), F.lit("claude")))), F.lit(False))
    named = F.array_contains(F.split(attribute("class"), "\\s+"), TRANSCRIPT_CLASS) | F.contains(attribute("class"), F.lit(TRANSCRIPT_CLASS_PART))
    transcript = F.bool_or(attribute("data-testid").isin(*TRANSCRIPT_IDS) | named)
    return nodes.groupBy("page_id").agg(F.bool_or(has("data-message-author-role")).alias("chatgpt_marks"), (title & transcript).alias("claude_marks"))


def explicit_role(marks: Column) -> Column:
    """user or assistant, if a word of the marks (attributes, joined by spaces, in lower case) says so."""
    word = lambda words: marks.rlike(f"(^|[\\s_-])({words})([\\s_-]|$)")
    return F.when(word("user|human"), "user").when(word("assistant|bot|ai"), "assistant")


def likely_messages(nodes: DataFrame) -> DataFrame:
    """``page_id, start, stop, tag, role, content``: the elements that look like messages of a chat; ``role`` if they say it.

    Marked elements first; pages with fewer than two of them give their longer blocks of text, 80 at most.
    """
    role = explicit_role(F.lower(F.concat_ws(" ", *(F.when(attribute(a) != "", attribute(a)) for a in ("data-message-author-role", "data-author-role", "data-role", "class")))))
    held = {"rich": F.col("tag").isin("pre", "code", "table", "img"), "interactive": F.col("tag").isin(*INTERACTIVE)}
    counted = with_sums(nodes, {k: v.cast("int") for k, v in held.items()})
    direct = (F.col("tag") == "article") | (attribute("role") == "listitem") | F.coalesce(F.map_contains_key("attributes", F.lit("data-message-id")), F.lit(False)) | has_class("message") | has_class("response")
    block = F.col("tag").isin("p", "li", "pre", "blockquote", "section", "div")
    counted = counted.withColumns({"role": role, "direct": direct, "block": block, "marked": F.coalesce(F.map_contains_key("attributes", F.lit("data-message-id")), F.lit(False)) | role.isNotNull()})
    rows = with_text(counted, (F.col("tag") != "#text") & (F.col("direct") | F.col("block"))).withColumn("content", compact_whitespace(F.col("content")))
    size = F.length("content")
    likely = lambda marked: (size >= 2) & ~F.col("tag").isin(*NO_MESSAGE) & (marked | (size >= 16) | (F.col("rich") > 0)) & (F.col("interactive") < 8)
    rows = rows.withColumns({"a": F.col("direct") & likely(F.col("marked")), "b": F.col("block") & likely(F.lit(False)) & (size > 24)})
    rows = rows.withColumn("enough", F.sum(F.col("a").cast("int")).over(Window.partitionBy("page_id")) >= 2)
    kept = outermost(rows.where(F.when(F.col("enough"), F.col("a")).otherwise(F.col("b"))))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("start"))
    return kept.withColumn("_place", place).where(F.col("enough") | (F.col("_place") <= MOST_BLOCKS)).select("page_id", "start", "stop", "tag", "role", "content")


def is_chat(messages: DataFrame) -> DataFrame:
    """``page_id, chat``: whether there are two messages or more, and both roles among them."""
    said = lambda role: F.coalesce(F.bool_or(F.col("role") == role), F.lit(False))
    return messages.groupBy("page_id").agg(((F.count("*") >= 2) & said("user") & said("assistant")).alias("chat"))


def within(nodes: DataFrame, condition: Column, name: str = "root", kept: Column | None = None) -> DataFrame:
    """Nodes inside the outermost ones for which ``condition`` holds, these included, with the start of theirs as ``name``.

    ``kept`` (of the outermost node) leaves out the insides of some of them.
    """
    sofar = Window.partitionBy("page_id").orderBy("start")
    asked = F.coalesce(condition, F.lit(False))
    ended = F.max(F.when(asked, F.col("stop"))).over(sofar.rowsBetween(Window.unboundedPreceding, -1))
    rows = nodes.withColumn("_is", asked & (F.coalesce(ended, F.lit(0)) <= F.col("start")))
    mark = F.struct(F.col("start").alias("at"), F.col("stop").alias("end"), (F.lit(True) if kept is None else kept).alias("kept"))
    rows = rows.withColumn("_last", F.last(F.when(F.col("_is"), mark), ignorenulls=True).over(sofar)).where((F.col("start") < F.col("_last.end")) & F.col("_last.kept"))
    return rows.select(*nodes.columns, F.col("_last.at").alias(name))


def in_segments(nodes: DataFrame) -> DataFrame:
    """Nodes in the sections of a document (``root``): outermost section elements outside navigation, headers, footers, asides and forms."""
    return within(nodes, F.col("tag").isin(*SECTIONS, *PRUNED), kept=~F.col("tag").isin(*PRUNED))


def with_nearest(nodes: DataFrame, condition: Column, name: str) -> DataFrame:
    """Nodes with the start of the innermost one around them (themselves included) for which ``condition`` holds, else null.

    As many such nodes are open at a node as it is deep among them, and the last one of that depth is the nearest.
    """
    marked = nodes.withColumn("_is", F.coalesce(condition, F.lit(False)))
    change = F.when(F.col("_is"), F.when(F.col("starts") == 1, 1).otherwise(-1)).otherwise(0)
    rows = events(marked).withColumn("_level", F.sum(change).over(in_order())).where(F.col("starts") == 1)
    last = F.last(F.when(F.col("_is"), F.col("start")), ignorenulls=True).over(Window.partitionBy("page_id", "_level").orderBy("start"))
    return rows.withColumn(name, F.when(F.col("_level") > 0, last)).select(*nodes.columns, name)


def absolute_url(base: Column, link: Column) -> Column:
    """A link as seen from the page at ``base``; steps such as ``..`` stay as they are."""
    plain = F.regexp_replace(base, "[?#].*", "")
    origin = F.regexp_extract(plain, "^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    folder = F.concat(origin, F.coalesce(F.nullif(F.regexp_extract(F.substring(plain, F.length(origin) + 1, F.length(plain)), "^(/.*/|/)", 1), F.lit("")), F.lit("/")))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (F.coalesce(origin, F.lit("")) == ""), link)
        .when(link == "", base).when(link.startswith("//"), F.concat(F.regexp_extract(origin, "^[^:]*:", 0), link))
        .when(link.startswith("/"), F.concat(origin, link)).when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*", ""), link))
        .when(link.startswith("?"), F.concat(plain, link)).otherwise(F.concat(folder, link))
    )


def inline_markdown(nodes: DataFrame, owner: str, urls: DataFrame | None = None) -> DataFrame:
    """``page_id, <owner>, markdown``: what is inside the nodes that share a value of ``owner`` as one line of Markdown.

    Every node says what it writes where it starts and where it stops, so a text of any length or depth is one sorted walk.
    Bold, italics, links, code and images; scripts, menus, buttons and hidden parts say nothing. ``urls`` (``page_id,
    url``) makes links absolute. Inside marks white space is compacted and trimmed, which is noted by four control characters
    until the end: inside of a mark begins (1) and ends (2), a space inside (3), the end of a link's target (4).
    """
    hidden = F.col("tag").isin("script", "style", "noscript", "svg", "nav", "aside", "footer", "button") | (attribute("aria-hidden") == "true") | attribute("role").isin("menu", "menuitem") | F.array_contains(F.split(attribute("class"), "\\s+"), "sr-only") | has_class("visually-hidden")
    bold, slant, link, code = F.col("tag").isin("strong", "b"), F.col("tag").isin("em", "i"), (F.col("tag") == "a") & F.map_contains_key("attributes", F.lit("href")), F.col("tag") == "code"
    rows = nodes.join(urls.select("page_id", F.col("url").alias("_url")), "page_id", "left") if urls is not None else nodes.withColumn("_url", F.lit(None).cast("string"))
    target = lambda name: absolute_url(F.coalesce("_url", F.lit("")), attribute(name))
    href, src = target("href"), F.when(attribute("src") != "", target("src")).otherwise("")
    script = attribute("href").rlike("(?i)^\\s*javascript:")
    # How many hidden, code, pre and compacting elements are open.
    opens = {"_hidden": hidden, "_code": code, "_pre": F.col("tag") == "pre", "_tight": bold | slant | link | code}
    both = events(rows.withColumns({k: F.coalesce(v, F.lit(False)).cast("int") for k, v in opens.items()}))
    step = F.when(F.col("starts") == 1, 1).otherwise(-1)
    both = both.withColumns({f"_in{k}": F.sum(F.col(k) * step).over(in_order()) for k in opens})
    inside = {k: F.col(f"_in{k}") - F.when(F.col("starts") == 1, F.col(k)).otherwise(0) for k in opens}  # around the node, itself left out
    spaced = F.when(inside["_tight"] > 0, F.regexp_replace("text", f"{WS}+", "\x03")).otherwise(F.col("text"))
    alt = F.coalesce(F.nullif(attribute("alt"), F.lit("")), F.nullif(attribute("title"), F.lit("")), filename_of_url(src), F.lit("image"))
    image = F.when(src == "", alt).otherwise(F.concat(F.lit("!["), alt, F.lit("]("), src, F.lit(")")))
    own_code = code & (inside["_pre"] == 0)
    plain = inside["_code"] > 0  # code shows its texts only
    start = F.when(F.col("tag") == "#text", spaced).when(plain, "").when(own_code, "`\x01").when(F.col("tag") == "br", F.when(inside["_tight"] > 0, "\x03").otherwise("\n")).when(bold, "**\x01").when(slant, "_\x01").when(link, F.when(script, "\x01").otherwise("[\x01")).when(F.col("tag") == "img", image).otherwise("")
    stop = F.when(plain, "").when(own_code, "\x02`").when(bold, "\x02**").when(slant, "\x02_").when(link, F.when(script, "\x02").otherwise(F.concat(F.lit("\x02]("), href, F.lit("\x04)")))).otherwise("")
    said = both.where((inside["_hidden"] == 0) & (F.col("_hidden") == 0)).withColumn("_said", F.when(F.col("starts") == 1, start).otherwise(stop)).where(F.col("_said") != "")
    whole = said.groupBy("page_id", owner).agg(F.array_sort(F.collect_list(F.struct("at", "starts", "_inner", "_said"))).alias("_x"))
    text = F.array_join(F.transform("_x", lambda x: x["_said"]), "")
    text = F.regexp_replace(F.regexp_replace(text, "\x01\x03+", "\x01"), "\x03+\x02", "\x02")
    text = F.regexp_replace(text, "\\[\x01\x02\\]\\(([^\x04]*)\x04", "[\x01$1\x02]($1\x04")
    text = F.regexp_replace(F.regexp_replace(text, "\x03+", " "), "[\x01\x02\x04]", "")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[ \\t]+\\n", "\n"), "\\n[ \\t]+", "\n"), "[ \\t]{2,}", " ")
    return whole.select("page_id", owner, text.alias("markdown"))


def list_items(nodes: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """``page_id, root, start, list, depth, ordinal, number, text``: the items of the outermost lists.

    ``list`` is the item's own list, whose ``depth`` counts from 0, and ``ordinal`` the item's place among the direct items of
    it, from 1; ``number`` is what an ordered list shows, null in others. Empty items count. A list counts as nested only
    directly in an item; what else is in an item is its text.
    """
    a_list, item = F.col("tag").isin("ul", "ol"), F.col("tag") == "li"
    inside = within(nodes.drop("root"), a_list)
    direct = F.when(a_list, (F.col("start") == F.col("root")) | (F.col("parent_tag") == "li")).otherwise(item & F.col("parent_tag").isin("ul", "ol"))
    rows = with_depth(inside.withColumn("_direct", F.coalesce(direct, F.lit(False))), F.col("_direct"), "_level")
    top = F.min("depth").over(Window.partitionBy("page_id", "root"))
    rows = rows.withColumn("_proper", F.col("_direct") & (F.col("_level") == F.col("depth") - top + 1))
    rows = with_nearest(rows, F.col("_proper"), "_own")
    first = F.regexp_extract(attribute("start"), "^\\s*([+-]?[0-9]{1,9})\\s*\\z", 1)
    first = F.when(first.isin("", "0", "+0", "-0"), 1).otherwise(F.regexp_replace(first, "^\\+", "").cast("int"))
    lists = rows.where(a_list & F.col("_proper")).select("page_id", F.col("start").alias("list"), (F.col("tag") == "ol").alias("_ordered"), first.alias("_first"))
    texts = inline_markdown(rows.where(~(F.col("_proper") & a_list) & F.col("_own").isNotNull()), "_own", urls)
    items = rows.where(item & F.col("_proper")).select("page_id", "root", "start", F.col("parent").alias("list"), F.floor((F.col("_level") - 2) / 2).cast("int").alias("depth"))
    items = items.join(lists, ["page_id", "list"]).withColumn("ordinal", F.row_number().over(Window.partitionBy("page_id", "list").orderBy("start")))
    shown = items.join(texts.withColumnRenamed("_own", "start"), ["page_id", "start"], "left")
    return shown.select(
        "page_id", "root", "start", "list", "depth", "ordinal", F.when(F.col("_ordered"), F.col("_first") + F.col("ordinal") - 1).alias("number"),
        F.coalesce(compact_whitespace(F.col("markdown")), F.lit("")).alias("text"),
    )


def with_depth(nodes: DataFrame, condition: Column, name: str) -> DataFrame:
    """Nodes with how many nodes for which ``condition`` holds are around them, themselves included."""
    rows = events(nodes.withColumn("_is", F.coalesce(condition, F.lit(False)).cast("int")))
    rows = rows.withColumn(name, F.sum(F.col("_is") * F.when(F.col("starts") == 1, 1).otherwise(-1)).over(in_order()))
    return rows.where(F.col("starts") == 1).select(*nodes.columns, name)


def list_markdown(items: DataFrame) -> DataFrame:
    """``page_id, root, markdown``: each outermost list as lines; two spaces of indent for each level, items without text left out."""
    mark = F.when(F.col("number").isNull(), "- ").otherwise(F.concat(F.col("number").cast("string"), F.lit(". ")))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), mark, F.col("text"))
    whole = items.where(F.col("text") != "").groupBy("page_id", "root").agg(F.array_sort(F.collect_list(F.struct("start", line.alias("line")))).alias("x"))
    return whole.select("page_id", "root", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("markdown"))


def table_markdown(nodes: DataFrame) -> DataFrame:
    """``page_id, root, n_rows, width, markdown``: each outermost table; rows without any text go, shorter ones are filled up, the first is the header."""
    inside = within(nodes.drop("root"), F.col("tag") == "table")
    cells = with_text(inside, (F.col("tag") != "#text") & (F.col("parent_tag") == "tr"), F.struct("page_id", "root")).select("page_id", "root", "parent", "start", F.replace(compact_whitespace(F.col("content")), F.lit("|"), F.lit("\\|")).alias("cell"))
    rows = cells.groupBy("page_id", "root", F.col("parent").alias("line")).agg(F.array_sort(F.collect_list(F.struct("start", "cell"))).alias("x"))
    rows = rows.withColumn("cells", F.transform("x", lambda x: x["cell"])).where(F.exists("cells", lambda c: c != ""))
    whole = rows.groupBy("page_id", "root").agg(F.array_sort(F.collect_list(F.struct("line", "cells"))).alias("rows"), F.max(F.size("cells")).alias("width"))
    shown = lambda cells: F.concat(F.lit("| "), F.array_join(F.concat(cells, F.array_repeat(F.lit(""), F.col("width") - F.size(cells))), " | "), F.lit(" |"))
    lines = F.transform("rows", lambda r: shown(r["cells"]))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    whole = whole.select("page_id", "root", F.size("rows").alias("n_rows"), "width", lines.alias("_lines"), rule.alias("_rule"))
    markdown = F.array_join(F.concat(F.slice("_lines", 1, 1), F.array("_rule"), F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0)))), "\n")
    return whole.select("page_id", "root", "n_rows", "width", markdown.alias("markdown"))


def document_segments(nodes: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """``page_id, segment, start, tag, type, content``: the sections of a page that have something to say, in order.

    Headings with one more mark than their level, six at most; lists and tables as Markdown, code and quotes with their
    type; everything else as a line of text. Figures, sections and details are one text.
    """
    inside = in_segments(nodes)
    by = ["page_id", "root"]
    text = lambda name, c: F.when(F.lit(name) == F.col("what"), c)
    said_as = lambda rows, name, c: rows.select(*by, F.lit(name).alias("what"), c.alias("said"), F.lit(None).cast("string").alias("tag"))
    roots = inside.where(F.col("start") == F.col("root")).select(*by, F.lit("root").alias("what"), F.lit(None).cast("string").alias("said"), "tag")
    prose = inline_markdown(within(nodes, F.col("tag").isin(*SECTIONS, *PRUNED), kept=~F.col("tag").isin(*PRUNED, "ul", "ol", "table", "pre", "hr")), "root", urls)
    lists = list_markdown(list_items(inside.where(F.col("root").isNotNull()), urls))
    codes = with_text(inside, (F.col("tag") == "pre") & (F.col("start") == F.col("root")), F.struct("page_id", "root"))
    all_said = roots.unionByName(said_as(prose, "prose", F.col("markdown"))).unionByName(said_as(lists, "list", F.col("markdown"))).unionByName(said_as(table_markdown(inside), "table", F.col("markdown")))
    all_said = all_said.unionByName(said_as(codes, "code", trim_all(F.col("content"))))
    rows = all_said.groupBy(*by).agg(F.max("tag").alias("tag"), *(F.max(text(name, F.col("said"))).alias(to) for name, to in (("prose", "markdown"), ("list", "list"), ("table", "table"), ("code", "code"))))
    rows = rows.where(F.col("tag").isNotNull()).withColumn("start", F.col("root"))
    said, level = trim_all(F.coalesce("markdown", F.lit(""))), F.regexp_extract("tag", "^h([1-6])$", 1)
    content = (
        F.when(F.col("tag").isin("ul", "ol"), F.col("list")).when(F.col("tag") == "table", F.col("table")).when(F.col("tag") == "pre", F.col("code")).when(F.col("tag") == "hr", "---")
        .when((level != "") & (said != ""), F.concat(F.repeat(F.lit("#"), F.least(F.expr("try_cast(nullif(regexp_extract(tag, '^h([1-6])$', 1), '') AS int)") + 1, F.lit(6))), F.lit(" "), said)).otherwise(said)
    )
    kind = F.when(F.col("tag") == "table", "table").when(F.col("tag") == "pre", "code").when(F.col("tag") == "blockquote", "quote").otherwise("text")
    rows = rows.withColumns({"type": kind, "content": content}).where(F.coalesce("content", F.lit("")) != "")
    return rows.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("start")) - 1).alias("segment"), "start", "tag", "type", "content")


def document_messages(segments: DataFrame) -> DataFrame:
    """Messages of kind ``document``, one for each section, from ``page_id, segment, content``."""
    made = document_message(F.col("content"), F.col("segment"))
    return segments.select(F.col("page_id").alias("conv_id"), F.col("segment").cast("int").alias("msg_idx"), made.alias("m")).select("conv_id", "msg_idx", "m.*")
