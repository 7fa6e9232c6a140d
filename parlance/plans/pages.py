"""Queries over the nodes of saved pages, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import archive, elements, routing, sanitising
from parlance.sources.conversations import read_table
from parlance.sources.pages import page_nodes

_INLINE = ("b", "li", "div", "p", "a", "article", "nav", "ul")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages")


def _nodes(spark: SparkSession, sf_dir: str, html: Column | str = "html") -> DataFrame:
    return page_nodes(_pages(spark, sf_dir).select("page_id", (F.col(html) if isinstance(html, str) else html).alias("html")))


def page_elements(spark, sf_dir):
    """All nodes of all pages."""
    return _nodes(spark, sf_dir).select("page_id", "start", "stop", "depth", F.coalesce("parent", F.lit(-1)).alias("parent"), "tag", elements.attribute("class").alias("class"), elements.attribute("href").alias("href"), (F.col("text_to") - F.col("text_from")).alias("n_chars"))


def innermost_elements(spark, sf_dir):
    """Of the common elements those that hold no other one."""
    return elements.innermost(_nodes(spark, sf_dir).where(F.col("tag").isin(*_INLINE))).select("page_id", "start", "tag")


def outermost_elements(spark, sf_dir):
    """Of paragraphs, bold texts, items and links those that no other one holds."""
    return elements.outermost(_nodes(spark, sf_dir).where(F.col("tag").isin("p", "b", "li", "a"))).select("page_id", "start", "tag")


def chat_roots(spark, sf_dir):
    """The root of a chat in pages whose first box is marked as a conversation."""
    return elements.chat_roots(_nodes(spark, sf_dir, F.replace("html", F.lit('class="ad"'), F.lit('class="Conversation"')))).select("page_id", "start", "tag", "score")


def route_marked_pages(spark, sf_dir):
    """Providers of pages whose hosts say nothing, by their marks: in turn none, those of one, the title of the other alone, its transcript alone, both."""
    turn = F.pmod(F.col("page_id"), F.lit(5))
    mark = F.when(turn == 1, '<p data-message-author-role="user">').when(turn.isin(3, 4), '<p class="a font-claude-response">').otherwise("<p>")
    title = F.when(turn.isin(2, 4), "<title>About CLAUDE ").otherwise("<title>")
    pages = _pages(spark, sf_dir).select("page_id", "url", F.replace(F.replace("html", F.lit("<p>"), mark), F.lit("<title>"), title).alias("html"))
    marks = elements.page_marks(page_nodes(pages))
    return pages.join(marks, "page_id").select("page_id", routing.provider(F.col("url"), F.col("chatgpt_marks"), F.col("claude_marks")).alias("provider"))


def likely_messages(spark, sf_dir):
    """Messages of pages whose boxes and headings are marked as such; pages with one mark give their blocks."""
    marked = F.when(F.col("page_id") % 2 == 0, F.replace(F.replace("html", F.lit('class="ad"'), F.lit('class="user-message"')), F.lit("<h1>"), F.lit('<h1 class="message bot">'))).otherwise(F.col("html"))
    return elements.likely_messages(_nodes(spark, sf_dir, marked)).select("page_id", "start", "tag", "role", F.md5("content").alias("content_md5"))


def document_segments(spark, sf_dir):
    """Sections of all pages as Markdown."""
    nodes = _nodes(spark, sf_dir).persist()  # they are walked for sections, lists, tables and codes
    found = elements.document_segments(nodes, _pages(spark, sf_dir))
    return found.select("page_id", "segment", "tag", "type", "content")


def nested_list_items(spark, sf_dir):
    """Items of the pages' lists, numbered from 3, with every second item made a list of its own inside the one before."""
    nested = F.regexp_replace("html", "</li><li>(.*?)</li>", "<ul><li>$1</li></ul></li>")
    nested = F.replace(nested, F.lit("<nav><ul>"), F.lit('<nav><ol start="3">'))
    return elements.list_items(_nodes(spark, sf_dir, F.replace(nested, F.lit("</ul></nav>"), F.lit("</ol></nav>"))).persist()).select("page_id", "depth", "ordinal", F.coalesce("number", F.lit(0)).alias("number"), "text")


def link_tables(spark, sf_dir):
    """The pages' lists of links as tables with rows of one and two cells."""
    table = F.replace(F.replace("html", F.lit("<nav><ul>"), F.lit("<nav><table>")), F.lit("</ul></nav>"), F.lit("</table></nav>"))
    table = F.replace(F.replace(table, F.lit("<li>"), F.lit("<tr><td>")), F.lit("</li>"), F.lit("<td>a | b</tr><tr><td> </tr>"))
    return elements.table_markdown(_nodes(spark, sf_dir, table)).select("page_id", "n_rows", "width", "markdown")


def page_snapshots(spark, sf_dir):
    """All pages without scripts and what is hidden; the boxes of every second page are."""
    hidden = F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit('<div class="ad">'), F.lit('<div style="color:red; display: none">'))).otherwise(F.col("html"))
    return sanitising.page_snapshots(_pages(spark, sf_dir).select("page_id", hidden.alias("html"))).select("page_id", F.md5("html").alias("html_md5"))


def evidence_archives(spark, sf_dir):
    """Archives of two files of each page, its address and its source: size, beginning and end record."""
    pages = _pages(spark, sf_dir)
    file = F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("url.txt").alias("name"), F.encode("url", "UTF-8").alias("data")), F.struct(F.lit(2).alias("seq"), F.lit("seite-ä.html").alias("name"), F.encode("html", "UTF-8").alias("data"))))
    found = archive.archives(pages.select(F.col("page_id").alias("conv_id"), file.alias("f")).select("conv_id", "f.*"))
    size = F.octet_length("archive")
    return found.select("conv_id", "filename", size.alias("n_bytes"), F.hex(F.substring("archive", 1, 14)).alias("head"), F.hex(F.substring(F.col("archive"), size - 21, F.lit(22))).alias("tail"))


# A stack machine over tokens: what is open by tag and position, popped by closing tags and by blocks that end a paragraph.
_PATTERN = r"(?is)<!--.*?-->|<!\w[^>]*>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<title[^>]*>.*?</title>|</?[a-z][^>]*>|[^<]+"
_BLOCK = "('article','div','footer','h1','li','nav','p','ul','body','html')"
_TREE = rf"""
WITH RECURSIVE raw AS (SELECT page_id, unnest(list_filter(regexp_extract_all(html, '{_PATTERN}'), lambda t: NOT starts_with(t, '<!'))) AS t, generate_subscripts(list_filter(regexp_extract_all(html, '{_PATTERN}'), lambda t: NOT starts_with(t, '<!')), 1) AS k FROM pages),
parts AS (SELECT page_id, k, CASE WHEN regexp_matches(t, '(?is)^<(script|style|title)') THEN [regexp_extract(t, '(?is)^(<[^>]*>)', 1), chr(1) || regexp_extract(t, '(?is)^<[^>]*>(.*)</[a-z]+>$', 1), regexp_extract(t, '(?is)(</[a-z]+>)$', 1)] ELSE [t] END AS l FROM raw),
flat AS (SELECT page_id, k, unnest(l) AS t, generate_subscripts(l, 1) AS j FROM parts),
tok AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k, j) - 1)::INT AS i, ltrim(t, chr(1)) AS t, CASE WHEN starts_with(t, chr(1)) OR NOT starts_with(t, '<') THEN '#text' ELSE lower(regexp_extract(t, '^</?([a-z][^\s/>]*)', 1, 'i')) END AS tag,
  starts_with(t, '</') AS closes FROM flat),
m AS (SELECT page_id, -1 AS i, '' AS tag, '' AS t, false AS closes, []::VARCHAR[] AS tags, []::INT[] AS starts, []::STRUCT(s INT, e INT)[] AS ended, 0 AS depth, NULL::INT AS parent FROM (SELECT DISTINCT page_id FROM tok)
  UNION ALL SELECT page_id, i, tag, t, closes, CASE WHEN pushes THEN list_append(tags2, tag) ELSE tags2 END, CASE WHEN pushes THEN list_append(starts2, i) ELSE starts2 END, ended, len(tags2) + 1, CASE WHEN len(starts2) > 0 THEN starts2[-1] END FROM (
    SELECT *, tags1[:own - 1] AS tags2, starts1[:own - 1] AS starts2, NOT closes AND tag NOT IN ('#text', 'br', 'meta') AS pushes,
      list_concat(ended1, list_transform(starts1[own:], lambda x: {{'s': x, 'e': i + 1}})) AS ended FROM (
    SELECT *, CASE WHEN closes AND tag <> 'p' AND list_contains(tags1, tag) THEN len(tags1) - list_position(list_reverse(tags1), tag) + 1 ELSE len(tags1) + 1 END AS own FROM (
    SELECT tok.*, tags[:para - 1] AS tags1, starts[:para - 1] AS starts1, list_transform(starts[para:], lambda x: {{'s': x, 'e': tok.i + (tok.closes AND tok.tag = 'p')::INT}}) AS ended1 FROM (
    SELECT page_id AS p, i AS at, tags, starts FROM m) AS m JOIN tok ON tok.page_id = m.p AND tok.i = m.at + 1,
    LATERAL (SELECT CASE WHEN tok.tag IN {_BLOCK} AND list_contains(tags, 'p') THEN len(tags) - list_position(list_reverse(tags), 'p') + 1 ELSE len(tags) + 1 END AS para)))) WHERE true),
ends AS (SELECT page_id, x.s AS start, x.e AS stop FROM (SELECT page_id, unnest(ended) AS x FROM m)),
opened AS (SELECT page_id, i AS start, tag, t, depth, parent FROM m WHERE i >= 0 AND NOT closes),
whole AS (SELECT page_id, greatest(max(start) + 1, max(stop)) AS last FROM opened LEFT JOIN ends USING (page_id, start) GROUP BY page_id),
n AS (SELECT page_id, start, CASE WHEN tag IN ('#text', 'br', 'meta') THEN start + 1 ELSE coalesce(stop, last) END AS stop, depth, parent, tag, t,
  CASE WHEN tag = '#text' THEN replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') END AS text FROM opened LEFT JOIN ends USING (page_id, start) JOIN whole USING (page_id)),
c AS (SELECT a.page_id, a.start, any_value(a.stop) AS stop, any_value(a.depth) AS depth, any_value(a.parent) AS parent, any_value(a.tag) AS tag, any_value(a.t) AS t, coalesce(string_agg(b.text, '' ORDER BY b.start), '') AS content
  FROM n AS a LEFT JOIN n AS b ON a.page_id = b.page_id AND b.start >= a.start AND b.start < a.stop AND b.tag = '#text' GROUP BY 1, 2),
w AS (SELECT *, trim(regexp_replace(content, '[\x09-\x0D \x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]+', ' ', 'g')) AS said FROM c)
"""


def _tree(html: str) -> str:
    """The tree of pages whose text is ``html``."""
    return _TREE.replace("FROM pages)", f"FROM (SELECT page_id, {html} AS html FROM pages))")


_AD = """replace(html, 'class="ad"', 'class="Conversation"')"""
_MARKED = """CASE WHEN page_id % 2 = 0 THEN replace(replace(html, 'class="ad"', 'class="user-message"'), '<h1>', '<h1 class="message bot">') ELSE html END"""
_NESTED = """replace(replace(regexp_replace(html, '</li><li>(.*?)</li>', '<ul><li>\\1</li></ul></li>', 'g'), '<nav><ul>', '<nav><ol start="3">'), '</ul></nav>', '</ol></nav>')"""
_CELLS = """replace(replace(replace(replace(html, '<nav><ul>', '<nav><table>'), '</ul></nav>', '</table></nav>'), '<li>', '<tr><td>'), '</li>', '<td>a | b</tr><tr><td> </tr>')"""
_LI = r"list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav><ul>(.*?)</ul></nav>', 1), '(?s)<li>(.*?)</li>', 1), lambda x: {})"
_DECODED = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"

QUERIES = {f.__name__: f for f in (page_elements, innermost_elements, outermost_elements, route_marked_pages, chat_roots, likely_messages, document_segments, nested_list_items, link_tables, page_snapshots, evidence_archives)}

ORACLES = {
    "page_elements": rf"""{_TREE} SELECT page_id, start, stop, depth, coalesce(parent, -1) AS parent, tag, CASE WHEN tag = '#text' THEN '' ELSE regexp_extract(t, 'class="([^"]*)"', 1) END AS class,
        CASE WHEN tag = '#text' THEN '' ELSE regexp_extract(t, 'href="([^"]*)"', 1) END AS href, length(content)::BIGINT AS n_chars FROM c""",
    "innermost_elements": rf"""{_TREE}, s AS (SELECT * FROM n WHERE tag IN {_INLINE}) SELECT page_id, start, tag FROM s AS a WHERE NOT EXISTS (SELECT 1 FROM s AS b WHERE b.page_id = a.page_id AND b.start > a.start AND b.stop <= a.stop)""",
    "outermost_elements": rf"""{_TREE}, s AS (SELECT * FROM n WHERE tag IN ('p', 'b', 'li', 'a')) SELECT page_id, start, tag FROM s AS a WHERE NOT EXISTS (SELECT 1 FROM s AS b WHERE b.page_id = a.page_id AND b.start < a.start AND b.stop >= a.stop)""",
    "chat_roots": rf"""{_tree(_AD)}, s AS (SELECT a.page_id, a.start, a.tag, (SELECT count(*) FROM n AS b WHERE b.page_id = a.page_id AND b.start > a.start AND b.stop <= a.stop AND (b.tag IN ('article', 'pre') OR b.t ILIKE '%message%'))  * 4
        + len(regexp_extract_all(said, '(?i)\b(?:user|assistant|you|human|ai|chatgpt|claude)\b')) + least(length(said)::DOUBLE / 1000, 20) AS score FROM w AS a WHERE said <> '' AND (tag IN ('main', 'body') OR t ILIKE '%class="%conversation%'))
        SELECT page_id, start, tag, score FROM s QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, start) = 1""",
    "likely_messages": rf"""{_tree(_MARKED)}, d AS (SELECT page_id, start, stop, tag, said, tag = 'article' OR regexp_matches(t, '(?i)^<[^>]*class="[^"]*message') AS direct, tag IN ('p', 'li', 'div') AS block,
          CASE WHEN t LIKE '<%class="user-message"%' THEN 'user' WHEN t LIKE '<%class="message bot"%' THEN 'assistant' END AS role FROM w WHERE tag <> '#text'),
        a AS (SELECT *, direct AND length(said) >= 2 AND (role IS NOT NULL OR length(said) >= 16) AS one, block AND length(said) > 24 AS two FROM d),
        k AS (SELECT *, count(*) FILTER (WHERE one) OVER (PARTITION BY page_id) >= 2 AS enough FROM a), s AS (SELECT * FROM k WHERE CASE WHEN enough THEN one ELSE two END),
        o AS (SELECT * FROM s AS a WHERE NOT EXISTS (SELECT 1 FROM s AS b WHERE b.page_id = a.page_id AND b.start < a.start AND b.stop >= a.stop))
        SELECT page_id, start, tag, role, md5(said) AS content_md5 FROM o QUALIFY enough OR row_number() OVER (PARTITION BY page_id ORDER BY start) <= 80""",
    "document_segments": rf"""{_TREE}, s AS (SELECT * FROM n WHERE tag IN ('h1', 'p', 'ul', 'nav', 'footer')), o AS (SELECT * FROM s AS a WHERE tag IN ('h1', 'p') AND NOT EXISTS (SELECT 1 FROM s AS b WHERE b.page_id = a.page_id AND b.start < a.start AND b.stop >= a.stop)),
        x AS (SELECT o.page_id, o.start, o.tag, string_agg(CASE n.tag WHEN 'br' THEN CASE WHEN b.start IS NULL THEN chr(10) ELSE ' ' END WHEN 'b' THEN '**' || n.start || '**' ELSE n.text END, '' ORDER BY n.start) FILTER (WHERE b.start IS NULL OR n.start = b.start) AS plain FROM o
          JOIN n ON n.page_id = o.page_id AND n.start >= o.start AND n.stop <= o.stop AND n.tag IN ('#text', 'br', 'b') LEFT JOIN n AS b ON b.page_id = o.page_id AND b.tag = 'b' AND b.start <= n.start AND b.stop >= n.stop GROUP BY 1, 2, 3),
        y AS (SELECT x.page_id, x.start, x.tag, CASE WHEN w.start IS NULL THEN plain ELSE replace(plain, '**' || w.start || '**', '**' || trim(w.said) || '**') END AS t FROM x LEFT JOIN w ON w.page_id = x.page_id AND w.tag = 'b' AND w.parent = x.start),
        z AS (SELECT page_id, start, tag, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM y)
        SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY start) - 1)::INT AS segment, tag, 'text' AS type, CASE WHEN tag = 'h1' THEN '## ' ELSE '' END || t AS content FROM z WHERE t <> ''""",
    "nested_list_items": rf"""WITH l AS (SELECT page_id, {_LI.format("x")} AS l FROM pages), i AS (SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) AS k FROM l),
        s AS (SELECT page_id, k, {_DECODED.format("'[' || regexp_extract(t, '>([^<]*)<', 1) || '](' || regexp_extract(t, 'href=\"([^\"]*)\"', 1) || ')'")} AS text FROM i)
        SELECT page_id, ((k - 1) % 2)::INT AS depth, CASE WHEN k % 2 = 1 THEN (k + 1) // 2 ELSE 1 END::INT AS ordinal, CASE WHEN k % 2 = 1 THEN 3 + k // 2 ELSE 0 END::INT AS number, text FROM s""",
    "link_tables": rf"""WITH l AS (SELECT page_id, {_LI.format("x")} AS l FROM pages), i AS (SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) AS k FROM l),
        s AS (SELECT page_id, k, '| ' || replace({_DECODED.format("regexp_extract(t, '>([^<]*)<', 1)")}, '|', '\|') || ' | a \| b |' AS t FROM i)
        SELECT page_id, count(*)::INT AS n_rows, 2 AS width, string_agg(CASE WHEN k = 1 THEN t || chr(10) || '| --- | --- |' ELSE t END, chr(10) ORDER BY k) AS markdown FROM s GROUP BY 1""",
    "page_snapshots": rf"""{_TREE}, g AS (SELECT * FROM n WHERE tag IN ('head', 'script', 'style', 'title') OR (page_id % 2 = 0 AND t LIKE '<div class="ad"%')),
        k AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.page_id = n.page_id AND g.start <= n.start AND g.stop >= n.stop) AND EXISTS (SELECT 1 FROM n AS b WHERE b.page_id = n.page_id AND b.tag = 'body' AND b.start < n.start AND b.stop >= n.stop)),
        e AS (SELECT page_id, start AS pos, 1 AS starts, 0 AS deep, CASE WHEN tag = '#text' THEN replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') ELSE t END AS s FROM k
          UNION ALL SELECT page_id, stop, 0, -start, '</' || tag || '>' FROM k WHERE tag NOT IN ('#text', 'br')),
        b AS (SELECT page_id, string_agg(s, '' ORDER BY pos, starts, deep) AS body FROM e GROUP BY 1), h AS (SELECT w.page_id, content AS title FROM w WHERE tag = 'title')
        SELECT p.page_id, md5('<!doctype html>' || chr(10) || '<html><head><meta charset="utf-8">' || chr(10) || '<meta http-equiv="Content-Security-Policy" content="default-src ''none''; img-src data:; base-uri ''none''; form-action ''none''">' || chr(10) || '<title>' ||
          replace(replace(replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#039;') || '</title></head><body>' || coalesce(body, '') || '</body></html>') AS html_md5
        FROM pages AS p LEFT JOIN b USING (page_id) LEFT JOIN h USING (page_id)""",
    "evidence_archives": """WITH s AS (SELECT page_id, 30 + 7 + octet_length(encode(url)) + 30 + 13 + octet_length(encode(html)) AS behind FROM pages), x AS (SELECT *, lpad(hex(behind), 8, '0') AS h FROM s)
        SELECT page_id AS conv_id, 'conversation-evidence.zip' AS filename, (behind + 112 + 22)::INT AS n_bytes, '504B03041400000000000000' || '0000' AS head,
          '504B0506000000000200020070000000' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '0000' AS tail FROM x""",
    "route_marked_pages": "SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'chatgpt' WHEN 4 THEN 'claude' ELSE 'generic' END AS provider FROM pages WHERE html LIKE '%<p>%'",
}
