"""Nodes of pages and what is built on them against twins that walk trees."""

from __future__ import annotations

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.operators import elements
from parlance.sources import pages

_TOKEN = re.compile(pages.TOKEN.replace("\\z", "\\Z"))


def tokens_of(html):
    out = []
    for m in _TOKEN.finditer(html or ""):
        t = m.group()
        if re.match(r"<!|<\?|</(?![A-Za-z])", t):
            continue
        raw = re.match(r"(?is)(<(script|style|textarea|title|noscript|iframe)(?=[\s/>])(?:[^>\"']+|\"[^\"]*\"|'[^']*')*>)(.*)(</\2\s*>)\Z", t)
        if raw:
            out += [("open", raw[2].lower(), raw[1]), ("text", "#text", raw[3]), ("close", raw[2].lower(), raw[4])] if raw[3] else [("open", raw[2].lower(), raw[1]), ("skip", "", ""), ("close", raw[2].lower(), raw[4])]
        elif re.match("</[A-Za-z]", t):
            out.append(("close", re.match(r"</([A-Za-z][^\s/>]*)", t)[1].lower(), t))
        elif re.match("<[A-Za-z]", t):
            out.append(("open", re.match(r"<([A-Za-z][^\s/>]*)", t)[1].lower(), t))
        else:
            out.append(("text", "#text", t))
    return out


def nodes_twin(html):
    """(start, stop, depth, parent, tag) by the rules in words, one node and one pair at a time."""
    tokens = tokens_of(html)
    scope = lambda t: pages.SCOPES.get(t, (t, 0))
    paired = lambda t: t not in (*pages.VOID, "p", "#text", "")
    stacks, level, stop = collections.defaultdict(list), [], {}
    for i, (kind, tag, _) in enumerate(tokens):  # containers match by name and depth
        family, rank = scope(tag)
        own = stacks[family]
        if kind == "open" and paired(tag) and rank == 0:
            own.append(i)
            level.append(len(own))
        elif kind == "close" and paired(tag) and rank == 0:
            level.append(len(own))
            if own:
                stop[own.pop()] = i + 1
        else:
            level.append(len(own))
    for i, (kind, tag, _) in enumerate(tokens):
        family, rank = scope(tag)
        if kind in ("text",) or tag in pages.VOID and kind == "open":
            stop[i] = i + 1
        elif kind == "open" and (tag == "p" or paired(tag) and rank):
            for j in range(i + 1, len(tokens)):
                k, t, _ = tokens[j]
                if tag == "p" and t in pages.BLOCKS or tag != "p" and paired(t) and scope(t)[0] == family and scope(t)[1] <= rank and level[j] == level[i]:
                    stop[i] = j + (k == "close" and t == tag)
                    break
    starts = [i for i, (kind, _, _) in enumerate(tokens) if kind in ("open", "text")]
    crosses = {a for a in stop for b in stop if a < b < stop[a] < stop[b]} | {b for a in stop for b in stop if a < b < stop[a] < stop[b]}
    sound = {i: s for i, s in stop.items() if i not in crosses and i in starts}
    end = max([*(i + 1 for i in starts), *sound.values(), 0])
    ends = {i: sound.get(i, min((s for j, s in sound.items() if j < i < s), default=end)) for i in starts}
    out, open_ = [], []
    for i in starts:
        while open_ and ends[open_[-1]] <= i:
            open_.pop()
        out.append((i, ends[i], len(open_) + 1, open_[-1] if open_ else None, tokens[i][1]))
        open_.append(i)
    return out


SOUPS = [
    None, "", "plain", "<p>a<p>b</p>c", "<div><span>x</div>y</span>z", "<b><i>x</b>y</i>", "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<table><tr><td>a<td>b<tr><th>c</table>", "a < b <> c </ d <3",
    "<!-- <p> --><p title='a>b' data-x=\"</p>\">t</p><!-- open", "<script>if (a<b) '</p>'</script><style></style><title>A &amp; <b></title>", "</div></p><p></div>x", "<li>a<li>b</li>c", "<dl><dt>a<dd>b<dt>c</dl>",
    "<select><option>a<option>b<optgroup><option>c</select>", "<html><body><p><b>one<br><p>two</html>", "<div>" * 40 + "x" + "</div>" * 39, "<a href=x>1<a href=y>2</a>3",
]


def soups(n=150):
    r = random.Random(3)
    tags = ["p", "div", "b", "i", "ul", "li", "ol", "table", "tr", "td", "th", "tbody", "br", "hr", "dl", "dt", "dd", "h2", "article", "select", "option", "nav"]
    return ["".join(r.choice([f"<{t}>", f"<{t}>", f"</{t}>", f"</{t}>", "x"]) for t in r.choices(tags[: r.randint(2, len(tags))], k=r.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def nodes(spark):
    frame = spark.createDataFrame(list(enumerate([*SOUPS, *soups()])), "page_id long, html string").repartition(4)
    return pages.page_nodes(frame).cache()


def test_nodes_are_those_of_the_rules(nodes):
    found = collections.defaultdict(list)
    for r in nodes.collect():
        found[r["page_id"]].append((r["start"], r["stop"], r["depth"], r["parent"], r["tag"]))
    for i, html in enumerate([*SOUPS, *soups()]):
        assert sorted(found[i]) == nodes_twin(html), html


def test_texts_attributes_and_entities(spark):
    html = "<div ID=a class='x  y' class=z hidden data-n=5>A &lt;b&gt; &amp;amp; &#233;&#x1F600;&#0; &nbsp;&copy;<b>B</b>C</div>"
    rows = {r["tag"]: r for r in pages.page_nodes(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("start").collect()}
    assert rows["div"]["attributes"] == {"id": "a", "class": "x  y", "hidden": "", "data-n": "5"}
    frame = pages.page_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    content = {r["tag"]: r["content"] for r in pages.with_text(frame, frame["tag"] != "#text").collect()}
    assert content == {"div": "A <b> &amp; é😀�  &copy;BC", "b": "B"}
    assert pages.page_nodes(spark.createDataFrame([], "page_id long, html string")).count() == 0


def frame_of(spark, *pages_, url="https://e.org/d/p?q#f"):
    return spark.createDataFrame([(i, h, url) for i, h in enumerate(pages_)], "page_id long, html string, url string")


def test_containment_equals_comparing_all_pairs(nodes):
    some = nodes.where("tag in ('p', 'div', 'li', 'b', 'ul')")
    own = collections.defaultdict(list)
    for r in some.collect():
        own[r["page_id"]].append((r["start"], r["stop"]))
    inner = {(p, a) for p, x in own.items() for a, b in x if not any(a < c and d <= b for c, d in x)}
    outer = {(p, a) for p, x in own.items() for a, b in x if not any(c < a and b <= d for c, d in x)}
    assert {(r["page_id"], r["start"]) for r in elements.innermost(some).collect()} == inner
    assert {(r["page_id"], r["start"]) for r in elements.outermost(some).collect()} == outer


def test_nearest_and_counted_nodes_equal_a_walk_over_all(nodes):
    rows = collections.defaultdict(list)
    for r in elements.with_nearest(pages.with_sums(nodes, {"n_p": (nodes["tag"] == "p").cast("int")}), nodes["tag"].isin("div", "ul"), "near").collect():
        rows[r["page_id"]].append(r)
    for own in rows.values():
        for r in own:
            assert r["n_p"] == sum(x["tag"] == "p" and r["start"] < x["start"] < r["stop"] for x in own)
            assert r["near"] == max((x["start"] for x in own if x["tag"] in ("div", "ul") and x["start"] <= r["start"] < x["stop"]), default=None)


def test_chat_roots_messages_and_roles(spark):
    chat = '<main class=conversation><article class="message user"><p>User: Please explain.</p></article><article class="message assistant"><p>Assistant: it is.</p><pre>sha</pre></article></main>'
    short = '<article data-role="user" class="user-message">continue</article><article class="message">Copy</article><article data-role="assistant">An answer that is long enough.</article>'
    blocks = "<div><p>" + "</p><p>".join(f"paragraph number {i} is long enough" for i in range(100)) + "</p></div>"
    plain = "<p>" + "<p>".join(f"paragraph number {i} is long enough" for i in range(100))
    frame = pages.page_nodes(frame_of(spark, f"<body>{chat}</body>", short, blocks, plain, "<body><main class=CHAT>you</main></body>")).cache()
    roots = {r["page_id"]: (r["tag"], r["score"]) for r in elements.chat_roots(frame).collect()}
    assert roots == {0: ("body", 14.041), 4: ("body", 1.003)}
    found = collections.defaultdict(list)
    for r in elements.likely_messages(frame).orderBy("page_id", "start").collect():
        found[r["page_id"]].append((r["tag"], r["role"], r["content"]))
    assert found[0] == [("article", "user", "User: Please explain."), ("article", "assistant", "Assistant: it is.sha")]
    assert found[1] == [("article", "user", "continue"), ("article", "assistant", "An answer that is long enough.")]
    assert [x[0] for x in found[2]] == ["div"] and len(found[3]) == 80
    assert {r["page_id"]: r["chat"] for r in elements.is_chat(elements.likely_messages(frame)).collect()} == {0: True, 1: True, 2: False, 3: False}


def test_sections_lists_tables_and_lines(spark):
    frame = frame_of(
        spark,
        "<nav>N<p>n</p></nav><article><h1>Eine Meldung</h1><p>Der erste Absatz.</p><h6> Details </h6><p>Ein <code> a  <b>b</b> </code><br> x</p><ul><li>Erster</li><li>Zweiter</li></ul><pre><code> x\n y </code></pre>"
        "<blockquote>q</blockquote><hr><p> </p><table><tr><th>a|b<th>c</tr><tr></tr><tr><td>1</table></article><footer>F</footer>",
        "<ol><li>One<ol><li>Nested</li></ol></li><li>Two</li><li></li><li> <b> x </b>y</li></ol><ol start=0><li>a<li>b</ol><ol start=7><li>a<li>b</ol>",
        "<ul><li><p>First</p></li><li>Second <a href='/q?a=1'>  </a><a href=z>l <i>k</i></a><a href='javascript:x()'>j s</a><div><ul><li>w</li></ul></div></li></ul>",
    )
    nodes = pages.page_nodes(frame).cache()
    found = collections.defaultdict(list)
    for r in elements.document_segments(nodes, frame).orderBy("page_id", "segment").collect():
        found[r["page_id"]].append((r["tag"], r["type"], r["content"]))
    assert found[0] == [
        ("h1", "text", "## Eine Meldung"), ("p", "text", "Der erste Absatz."), ("h6", "text", "###### Details"), ("p", "text", "Ein `a b`\nx"), ("ul", "text", "- Erster\n- Zweiter"), ("pre", "code", "x\n y"),
        ("blockquote", "quote", "q"), ("hr", "text", "---"), ("table", "table", "| a\\|b | c |\n| --- | --- |\n| 1 |  |"),
    ]
    assert [x[2] for x in found[1]] == ["1. One\n  1. Nested\n2. Two\n4. **x**y", "1. a\n2. b", "7. a\n8. b"]
    assert [x[2] for x in found[2]] == ["- First\n- Second [https://e.org/q?a=1](https://e.org/q?a=1)[l _k_](https://e.org/d/z)j sw"]
    items = [(r["depth"], r["ordinal"], r["number"], r["text"]) for r in elements.list_items(nodes).where("page_id = 1 and root = 0").orderBy("start").collect()]
    assert items == [(0, 1, 1, "One"), (1, 1, 1, "Nested"), (0, 2, 2, "Two"), (0, 3, 3, ""), (0, 4, 4, "**x**y")]
    messages = elements.document_messages(elements.document_segments(nodes, frame)).where("conv_id = 0").orderBy("msg_idx").collect()
    assert [(m["role"], m["kind"]) for m in messages] == [("assistant", "document")] * 9 and messages[0]["id"].startswith("document-")


def test_lines_of_a_million_characters(spark):
    html = "<p>" + "a <b> b </b><i>c</i><a href=x>d</a> " * 30_000
    frame = pages.page_nodes(frame_of(spark, html)).withColumn("root", F.lit(0))
    text = elements.inline_markdown(frame, "root").first()["markdown"]
    assert text.startswith("a **b**_c_[d](x) a **b**") and len(text) > 450_000


def test_links_from_where_a_page_is(spark):
    links = {"": "https://e.org/d/p?q#f", "x/y": "https://e.org/d/x/y", "/z": "https://e.org/z", "//o.org/a": "https://o.org/a", "#k": "https://e.org/d/p?q#k", "?n": "https://e.org/d/p?n", "mailto:a": "mailto:a"}
    frame = spark.createDataFrame([(k,) for k in links], "link string")
    found = frame.select("link", elements.absolute_url(F.lit("https://e.org/d/p?q#f"), F.col("link")).alias("url")).collect()
    assert {r["link"]: r["url"] for r in found} == links
    assert frame.select(elements.absolute_url(F.lit("https://e.org"), F.lit("x")).alias("u")).first()["u"] == "https://e.org/x"
