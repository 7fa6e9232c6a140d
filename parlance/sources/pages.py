"""Saved pages as tables of nodes: one row for each element and each text, in a nested-set encoding.

A node covers the interval from ``start`` to ``stop`` (exclusive) of its page's tokens, so that containment is a
comparison of numbers. The tree comes from windows over tag tokens; nothing parses a page as a whole.

* Tags are matched by name and depth: an element ends at the next closing tag that is as deep among the tags of its name.
  Lists match as one name. Closing tags without an opening one are left out.
* Void elements have no inside; scripts, styles, titles and text areas hold one text, whatever it looks like.
* A paragraph ends before the next tag of a block; list items, cells, rows, sections of tables, terms and options end
  before the next one of their kind in the same list, table or menu, or with it.
* A pair of tags that crosses another pair, and a tag that is never closed, last as long as the innermost sound element
  around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of elements by how they end.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
BLOCKS = (
    "address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
    "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "body", "html",
)
#: The family whose depth scopes a tag, and its rank there: an element of a rank ends before the next tag of its rank or a lower one.
SCOPES = {
    **{t: ("list", 0) for t in ("ul", "ol", "menu")}, "li": ("list", 1), "table": ("table", 0), **{t: ("table", 1) for t in ("thead", "tbody", "tfoot", "caption")}, "tr": ("table", 2),
    "td": ("table", 3), "th": ("table", 3), "dl": ("dl", 0), "dt": ("dl", 1), "dd": ("dl", 1), "select": ("select", 0), "optgroup": ("select", 1), "option": ("select", 2),
}
_NAME = "[A-Za-z][^\\s/>]*+"
_REST = "(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
_TEXT = "[^<]++(?:<(?![A-Za-z/!?])[^<]*+)*+|<(?![A-Za-z/!?])[^<]*+(?:<(?![A-Za-z/!?])[^<]*+)*+"
_RAW_NAMES = "|".join(RAW)
_RAW_TOKEN = f"<({_RAW_NAMES})(?=[\\s/>]){_REST}.*?</\\1\\s*>"
#: Comments, declarations, raw elements with their texts, tags, texts; an opening mark that begins none of these is a text.
TOKEN = f"(?is)<!--.*?(?:-->|\\z)|<[!?/](?![A-Za-z])[^>]*+>?|<![^>]*+>?|{_RAW_TOKEN}|</?{_NAME}{_REST}|{_TEXT}|<"
_ATTRIBUTE = "(?s)([^\\s\"'>/=]+)(?:\\s*=\\s*(\"[^\"]*+\"|'[^']*+'|[^\\s\"'>]++))?"
#: Bits of the numbers by which elements are told apart in running sums, so that no sum overflows.
_MARK = (1 << 40) - 1


def _numeric(entity: Column) -> Column:
    """The character of a numeric reference such as ``&#233;`` or ``&#xE9;``."""
    digits = F.regexp_extract(entity, "(?i)&#x?([0-9a-f]+);", 1)
    code = F.when(entity.rlike("(?i)^&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("decimal(20,0)")
    sound = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    number = F.when(sound, code.cast("long")).otherwise(F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def decode_entities(c: Column) -> Column:
    """Numeric references and the six common named ones; others stay as they are."""
    pattern = "&#(?:[0-9]{1,8}|[xX][0-9a-fA-F]{1,7});"
    parts, found = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    joined = F.array_join(F.flatten(F.transform(F.arrays_zip(parts.alias("p"), found.alias("f")), lambda x: F.array(x["p"], F.when(x["f"].isNull(), "").otherwise(_numeric(x["f"]))))), "")
    out = F.when(F.contains(c, F.lit("&#")), joined).otherwise(c)
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", "\u00a0"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.when(F.contains(c, F.lit("&")), out).otherwise(c)


def attributes_of(tag: Column) -> Column:
    """Map of a tag's attributes, names in lower case; the first of equal names counts, and one without a value is empty."""
    rest = F.regexp_replace(tag, "^</?[A-Za-z][^\\s/>]*|/?>\\z", "")
    pairs = F.transform(F.regexp_extract_all(rest, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: F.struct(
        F.lower(F.regexp_extract(a, "^[^\\s=]+", 0)).alias("k"), decode_entities(F.regexp_replace(F.regexp_replace(a, "(?s)^[^\\s=]+\\s*=?\\s*", ""), "(?s)^([\"'])(.*)\\1\\z", "$2")).alias("v"),
    ))
    names = F.transform(pairs, lambda p: p["k"])
    first = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), (F.array_position(names, p["k"]) == i + 1).alias("first"))), lambda p: p["first"])
    return F.when(F.length(rest) > 0, F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"], p["v"])))).otherwise(F.create_map().cast("map<string,string>"))


def page_tokens(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, pos, kind, tag, token``: opening and closing tags and texts in order; comments and declarations are left out."""
    found = F.filter(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: (t != "") & ~t.rlike("^(?:<!|<\\?|</(?![A-Za-z]))"))
    raw = f"(?is)^(<({_RAW_NAMES})(?=[\\s/>]){_REST})(.*)(</\\2\\s*>)\\z"
    # Texts of raw elements begin with a mark, so that nothing takes them for a tag.
    mark = lambda t: F.when(F.lower(F.regexp_extract(t, raw, 2)).isin("title", "textarea"), "\x00t").otherwise("\x00r")
    parts = lambda t: F.array(F.regexp_extract(t, raw, 1), F.concat(mark(t), F.regexp_extract(t, raw, 3)), F.regexp_extract(t, raw, 4))
    tokens = F.flatten(F.transform(found, lambda t: F.when(t.rlike(f"(?is)^<(?:{_RAW_NAMES})[\\s/>].*</"), parts(t)).otherwise(F.array(t))))
    rows = pages.select(F.col(id_col).alias("page_id"), F.posexplode(tokens).alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", f"^</?({_NAME})", 1))
    kind = F.when(F.col("token").startswith("\x00r"), "raw").when(F.col("token").rlike("^</[A-Za-z]"), "close").when(F.col("token").rlike("^<[A-Za-z]"), "open").otherwise("text")
    rows = rows.withColumns({"kind": kind, "tag": F.when(kind.isin("raw", "text"), "#text").otherwise(tag)})
    return rows.withColumn("token", F.regexp_replace("token", "^\\x00[rt]", "")).where(F.col("token") != "")


def _by_tag(values: dict[str, object], default: Column) -> Column:
    chain = F
    for value in dict.fromkeys(values.values()):
        chain = chain.when(F.col("tag").isin([t for t, v in values.items() if v == value]), F.lit(value))
    return chain.otherwise(default)


def _matched(tokens: DataFrame) -> DataFrame:
    """Tokens with ``stop``: where their own closing tag or an implied end puts it; null if there is neither."""
    opening, closing = F.col("kind") == "open", F.col("kind") == "close"
    paired = ~F.col("tag").isin(*VOID, "p", "#text")
    family = F.when(paired, _by_tag({t: f for t, (f, _) in SCOPES.items()}, F.col("tag"))).otherwise(F.lit("-"))
    rank = _by_tag({t: r for t, (_, r) in SCOPES.items()}, F.lit(0))
    rows = tokens.withColumns({"family": family, "rank": rank})
    page = Window.partitionBy("page_id")
    # Depth within the family, which closing tags without an opening one don't lower.
    step = F.when(paired & (F.col("rank") == 0), F.when(opening, 1).when(closing, -1)).otherwise(0)
    in_family = Window.partitionBy("page_id", "family").orderBy("pos")
    rows = rows.withColumn("_sum", F.sum(step).over(in_family))
    rows = rows.withColumn("_level", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(in_family)))
    before = F.coalesce(F.lag("_level").over(in_family), F.lit(0))
    rows = rows.withColumn("_scope", F.when(closing & (F.col("rank") == 0), before).otherwise(F.col("_level")))
    later = Window.partitionBy("page_id", "family", "_scope").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    following = {r: F.last(F.when((F.col("rank") <= r) if r else ((F.col("rank") == 0) & closing), F.struct("pos", "tag", closing.alias("closes"))), ignorenulls=True).over(later) for r in range(4)}
    # A paragraph: up to the next tag of a block, its own closing tag included.
    next_block = F.last(F.when(F.col("tag").isin(*BLOCKS), F.struct("pos", "tag", closing.alias("closes"))), ignorenulls=True).over(page.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({f"_next{r}": c for r, c in following.items()} | {"_block": next_block})
    end = F.when(F.col("tag") == "p", F.col("_block"))
    for r in range(4):
        end = end.when(paired & (F.col("rank") == r), F.col(f"_next{r}"))
    rows = rows.withColumn("_end", end)
    own = F.col("_end.closes") & ((F.col("_end.tag") == F.col("tag")) | (F.col("rank") == 0) & (F.col("tag") != "p"))
    stop = F.when(F.col("tag").isin(*VOID) | (F.col("tag") == "#text"), F.col("pos") + 1).when(own, F.col("_end.pos") + 1).otherwise(F.col("_end.pos"))
    token = F.when(F.col("kind") == "text", decode_entities(F.col("token"))).otherwise(F.col("token"))
    return rows.where(~closing).select("page_id", F.col("pos").alias("start"), "tag", token.alias("token"), stop.alias("stop"))


def events(nodes: DataFrame) -> DataFrame:
    """Two rows for each node, where it starts and where it stops (``at``); inner nodes stop first, and stops come before starts."""
    both = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("starts"), F.lit(0).alias("_inner")), F.struct(F.col("stop").alias("at"), F.lit(0).alias("starts"), (-F.col("start")).alias("_inner"))))
    return nodes.select("*", both.alias("_e")).select(*nodes.columns, "_e.*")


def in_order() -> Window:
    return Window.partitionBy("page_id").orderBy("at", "starts", "_inner")


def with_sums(nodes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Nodes with the sums of ``values`` over each node's inside, itself left out, as differences of running sums."""
    rows = events(nodes.withColumns({f"_v{i}": v for i, v in enumerate(values.values())}))
    rows = rows.withColumns({f"_s{i}": F.sum(F.when(F.col("starts") == 1, F.col(f"_v{i}")).otherwise(0)).over(in_order()) for i in range(len(values))})
    last = Window.partitionBy("page_id", "start").orderBy("starts")  # the stop, then the start
    rows = rows.withColumns({name: F.lag(f"_s{i}").over(last) - F.col(f"_s{i}") for i, name in enumerate(values)})
    return rows.where(F.col("starts") == 1).select(*nodes.columns, *values)


def page_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, start, stop, depth, parent, parent_tag, tag, attributes, text, text_from, text_to``, a row for each element and text.

    Nodes at the top have depth 1 and no parent; ``parent`` is another node's ``start``. A text has the tag ``#text``;
    an element's text is that of its page from character ``text_from`` up to ``text_to``. A null page, or an empty one,
    has no nodes. Ids of pages have to be distinct.
    """
    # One exchange by page serves all windows that follow.
    source = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).repartition("page_id")
    found = _matched(page_tokens(source))
    found = found.withColumn("_has", F.col("stop").isNotNull()).withColumn("stop", F.coalesce("stop", "start"))
    mark = F.xxhash64("start").bitwiseAND(F.lit(_MARK))
    # What starts inside a sound element stops inside it: the marks of what is open are the same at both its ends.
    held = F.sum(F.when(~F.col("_has"), 0).when(F.col("starts") == 1, mark).otherwise(-mark)).over(in_order())
    pair = Window.partitionBy("page_id", "start").orderBy("starts")
    sides = events(found).where(F.col("_has") | (F.col("starts") == 1)).withColumn("_open", held)
    sides = sides.withColumn("_sound", F.coalesce(F.lag("_open").over(pair) + mark == F.col("_open"), F.lit(False))).where(F.col("starts") == 1)
    rows = sides.select("page_id", "start", "tag", "token", F.when(F.col("_sound"), F.col("stop")).otherwise(F.col("start")).alias("stop"), "_sound")
    # Others stop with the innermost sound element around them: the next stop at their level.
    rows = events(rows).where(F.col("_sound") | (F.col("starts") == 1))
    change = F.when(F.col("_sound"), F.when(F.col("starts") == 1, 1).otherwise(-1)).otherwise(0)
    rows = rows.withColumn("_depth", F.sum(change).over(in_order()))
    rows = rows.withColumn("_level", F.when(F.col("starts") == 0, F.col("_depth") + 1).otherwise(F.col("_depth")))
    later = Window.partitionBy("page_id", "_level").orderBy(F.desc("at"), F.desc("starts"), F.desc("_inner")).rowsBetween(Window.unboundedPreceding, -1)
    around = F.last(F.when(F.col("starts") == 0, F.col("at")), ignorenulls=True).over(later)
    whole = F.max(F.greatest(F.col("start") + 1, F.col("stop"))).over(Window.partitionBy("page_id"))
    rows = rows.withColumns({"_around": around, "_whole": whole})
    stop = F.when(F.col("_sound"), F.col("stop")).when(F.col("_level") == 0, F.col("_whole")).otherwise(F.coalesce("_around", "_whole"))
    is_text = F.col("tag") == "#text"
    nodes = rows.where(F.col("starts") == 1).select("page_id", "start", stop.alias("stop"), "tag", F.when(~is_text, F.col("token")).alias("_tag"), F.when(is_text, F.col("token")).alias("text"))
    # Depth, characters of text before and inside, and the parent: the last node a level above.
    length = F.coalesce(F.length("text"), F.lit(0))
    rows = events(nodes).withColumns({
        "_depth": F.sum(F.when(F.col("starts") == 1, 1).otherwise(-1)).over(in_order()), "_chars": F.sum(F.when(F.col("starts") == 1, length).otherwise(0)).over(in_order()),
    })
    rows = rows.withColumn("text_to", F.lag("_chars").over(pair)).where(F.col("starts") == 1)
    rows = rows.withColumns({"depth": F.col("_depth").cast("int"), "text_from": F.col("_chars") - length})
    levels = rows.select("*", F.explode(F.array(F.struct(F.col("depth").alias("_at"), F.lit(False).alias("_child")), F.struct((F.col("depth") - 1).alias("_at"), F.lit(True).alias("_child")))).alias("_l")).select("*", "_l.*")
    above = F.last(F.when(~F.col("_child"), F.struct("start", "tag")), ignorenulls=True).over(Window.partitionBy("page_id", "_at").orderBy("start", F.desc("_child")).rowsBetween(Window.unboundedPreceding, -1))
    return levels.withColumn("_above", above).where("_child").select(
        "page_id", "start", "stop", "depth", F.col("_above.start").alias("parent"), F.col("_above.tag").alias("parent_tag"), "tag", F.when(F.col("_tag").isNotNull(), attributes_of(F.col("_tag"))).alias("attributes"), "text", "text_from", "text_to",
    )


def with_text(nodes: DataFrame, wanted: Column, group: Column | None = None) -> DataFrame:
    """The nodes for which ``wanted`` holds, with ``content``: the text inside them, as it stands.

    Texts meet by page; ``group`` names smaller groups, such as the disjoint roots that the nodes are in.
    """
    whole_page = F.col("page_id") if group is None else group
    texts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("start", "text"))))
    names = [c for c in nodes.columns if c != "text"]
    whole = nodes.groupBy(whole_page.alias("_group")).agg(
        F.array_join(F.transform(texts, lambda t: t["text"]), "").alias("_all"), F.min(F.when(F.col("text").isNotNull(), F.col("text_from"))).alias("_first"), F.collect_list(F.when(F.coalesce(wanted, F.lit(False)), F.struct(*names))).alias("_nodes"),
    )
    rows = whole.select("_all", "_first", F.explode("_nodes").alias("n"))
    text = F.substring("_all", (F.col("n.text_from") - F.coalesce("_first", F.lit(0))).cast("int") + 1, (F.col("n.text_to") - F.col("n.text_from")).cast("int"))
    return rows.select("n.*", F.coalesce(F.when(F.col("n.text_to") > F.col("n.text_from"), text), F.lit("")).alias("content"))
