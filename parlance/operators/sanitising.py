"""Saved pages without what is private, hidden or executable: whole subtrees go, the rest is put together again in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import escape_html
from parlance.operators.elements import attribute, has_class
from parlance.sources.pages import VOID, events, in_order, page_nodes

# Elements that go with all that is in them, elements and attributes that may stay, schemes of links.
PRIVATE = ("script", "style", "noscript", "template", "iframe", "object", "embed", "input", "textarea", "select", "svg", "math", "audio", "video", "head", "title")
ALLOWED = (
    "a", "p", "br", "hr", "div", "span", "section", "article", "main", "header", "footer", "nav", "aside", "h1", "h2", "h3", "h4", "h5", "h6", "strong", "b", "em", "i", "u", "s", "del", "sup", "sub",
    "pre", "code", "blockquote", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "th", "td", "caption", "figure", "figcaption", "img", "details", "summary",
)
ATTRIBUTES = ("href", "src", "alt", "title", "open", "start", "colspan", "rowspan", "loading", "referrerpolicy", "target", "rel", "data-fallback", "class")
LINK = "(?i)^(?:(?:https?|mailto|tel|ftp|sms|callto|cid|xmpp|matrix):|[^a-z]|[a-z+.-]+(?:[^a-z+.:-]|\\z))"
POLICY = "default-src 'none'; img-src data:; base-uri 'none'; form-action 'none'"


def is_hidden() -> Column:
    """Elements that nobody sees: marked as hidden, for screen readers only, or styled away in the element itself."""
    style = F.regexp_replace(F.lower(attribute("style")), "\\s+", "")
    styled = style.rlike("(?:^|;)(?:display:none|visibility:(?:hidden|collapse)|opacity:0+(?:\\.0*)?)(?:!important)?(?:;|\\z)")
    named = F.array_contains(F.split(attribute("class"), "\\s+"), "sr-only") | has_class("visually-hidden")
    return F.coalesce(F.map_contains_key("attributes", F.lit("hidden")) | (attribute("aria-hidden") == "true") | named | styled, F.lit(False))


def _opening() -> Column:
    quoted = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("\u00a0"), F.lit("&nbsp;"))
    bare = lambda v: F.regexp_replace(v, "[\\x00-\\x20\\u00a0\\u1680\\u180e\\u2000-\\u2029\\u205f\\u3000]", "")
    sound = lambda k, v: ~k.isin("href", "src") | bare(v).rlike(LINK) | ((F.col("tag") == "img") & (k == "src") & bare(v).rlike("(?i)^data:"))
    kept = F.filter(F.map_entries("attributes"), lambda a: a["key"].isin(*ATTRIBUTES) & sound(a["key"], a["value"]))
    return F.concat(F.lit("<"), F.col("tag"), F.array_join(F.transform(kept, lambda a: F.concat(F.lit(" "), a["key"], F.lit('="'), quoted(a["value"]), F.lit('"'))), ""), F.lit(">"))


def sanitised(nodes: DataFrame) -> DataFrame:
    """``page_id, title, body``: the bodies of pages (the whole page, where it has none) as HTML of allowed elements only.

    Of other elements the inside stays. A page of which nothing is left has an empty body.
    """
    gone, body = F.col("tag").isin(*PRIVATE) | is_hidden(), F.col("tag") == "body"
    rows = events(nodes.withColumns({"_gone": F.when(F.col("tag") == "#text", 0).otherwise(gone.cast("int")), "_body": body.cast("int"), "_in_title": (F.col("parent_tag") == "title")}))
    step = F.when(F.col("starts") == 1, 1).otherwise(-1)
    rows = rows.withColumns({"_hidden": F.sum(F.col("_gone") * step).over(in_order()) + F.when(F.col("starts") == 0, F.col("_gone")).otherwise(0), "_inside": F.sum(F.col("_body") * step).over(in_order())})
    text = F.replace(escape_html(F.col("text"), False, False), F.lit("\u00a0"), F.lit("&nbsp;"))
    start = F.when(F.col("tag") == "#text", text).when(F.col("tag").isin(*ALLOWED), _opening())
    stop = F.when(F.col("tag").isin(*ALLOWED) & ~F.col("tag").isin(*VOID), F.concat(F.lit("</"), F.col("tag"), F.lit(">")))
    said = F.when(F.col("_hidden") == 0, F.when(F.col("starts") == 1, start).otherwise(stop))
    piece = lambda c: F.array_sort(F.collect_list(F.when(c & said.isNotNull(), F.struct("at", "starts", "_inner", said.alias("said")))))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["said"]), "")
    whole = rows.groupBy("page_id").agg(
        piece(F.col("_inside") > 0).alias("_in"), piece(F.col("_inside") == 0).alias("_out"), F.max("_body").alias("_has"),
        F.first(F.when(F.col("_in_title") & (F.col("starts") == 1), F.col("text")), ignorenulls=True).alias("title"),
    )
    return whole.select("page_id", F.coalesce("title", F.lit("")).alias("title"), F.when(F.col("_has") == 1, joined(F.col("_in"))).otherwise(joined(F.col("_out"))).alias("body"))


def page_snapshots(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, html``: pages that fetch nothing and run nothing. A page without nodes gives an empty one."""
    found = sanitised(page_nodes(pages, id_col, html_col))
    rows = pages.select(F.col(id_col).alias("page_id")).join(found, "page_id", "left")
    head = F.concat(F.lit(f'<!doctype html>\n<html><head><meta charset="utf-8">\n<meta http-equiv="Content-Security-Policy" content="{POLICY}">\n<title>'), escape_html(F.coalesce("title", F.lit(""))), F.lit("</title></head><body>"))
    return rows.select("page_id", F.concat(head, F.coalesce("body", F.lit("")), F.lit("</body></html>")).alias("html"))
