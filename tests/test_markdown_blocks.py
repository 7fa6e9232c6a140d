"""Blocks of Markdown against a twin that walks the lines of a text."""

from __future__ import annotations

import random
import re

from parlance.operators.markdown_blocks import markdown_blocks

ITEM, ORDERED = r"\s*(?:[-*+]|\d+[.)])\s+", r"\s*\d+[.)]\s+"


def blocks_twin(text):
    lines = (text or "").replace("\r\n", "\n").split("\n")
    code = raw = False
    rows = []  # kind, class, line, text, begins
    base = last_top = previous = before = None
    for n, t in enumerate(lines):
        indent = len(t) - len(t.lstrip())
        bare, named, begins = re.fullmatch(r"\s*```\s*", t), re.fullmatch(r"\s*```\w+\s*", t), False
        if code:
            kind = "fence" if bare else "code"
            code = not bare
        elif bare or named:
            kind, code, begins = "fence", True, True
        else:
            opens = t.strip(" ").startswith("<details>")
            begins = opens and not raw
            kind = "details" if raw or opens else "blank" if not t.strip() else None
            raw = (raw or opens) and not re.search("(?i)</details>", t)
            tests = (("rule", r"\s*(?:-{3,}|\*{3,}|_{3,})\s*\Z"), ("heading", r"#{1,6}\s+.*\Z"), ("quote", r"\s*>"), ("item", ITEM), ("bar", r" *\|"), ("lost", r"\s*```"), ("text", ""))
            kind = kind or next(k for k, p in tests if re.match(p, t))
        if kind in ("fence", "code", "details") or kind not in ("item", "blank") and indent == 0:
            base, last_top = None, None
        elif kind == "item" and base is None:
            base = indent
        in_list = base is not None and kind not in ("blank", "fence", "code", "details") and (kind == "item" or indent > base)
        group = "list" if in_list else "code" if kind in ("fence", "code") else kind
        if in_list:
            top = kind == "item" and indent < base + 2
            order = bool(re.match(ORDERED, t))
            begins = before != "list" or top and last_top is not None and order != last_top
            last_top = order if top else last_top
            kind = "item" if kind == "item" else "more"
        else:
            begins = begins or previous != group and not (kind == "blank" and before == "list") or kind in ("rule", "heading")
        rows.append((kind, group, n, t, begins, indent))
        previous, before = group, before if group == "blank" else group
    islands = []
    for row in rows:
        if row[4] or not islands:
            islands.append([])
        if row[1] not in ("blank", "lost"):
            islands[-1].append(row)
    out = []
    for own in filter(None, islands):
        group = own[0][1]
        if group == "bar" and (len(own) < 2 or not re.fullmatch(r"\s*\|?[\s:|-]+\|?\s*", own[1][3])):
            continue
        steps = sorted({r[5] // 2 for r in own})
        level = max([len(re.match("#*", r[3])[0]) if r[0] == "heading" else steps.index(r[5] // 2) if r[0] == "item" else 0 for r in own])
        said = ""
        for i, (kind, _, _, t, _, indent) in enumerate(r for r in own if r[0] not in ("fence", "rule")):
            if kind == "item":
                mark = re.match(r"\s*(\d+[.)])", t)
                t = "  " * steps.index(indent // 2) + (mark[1] if mark else "-") + " " + re.sub("^" + ITEM, "", t)
            t = {"heading": re.sub(r"^#{1,6}\s+", "", t), "quote": re.sub(r"^\s*>\s?", "", t), "text": t.strip(" "), "more": t.strip(" ")}.get(kind, t)
            said += ("" if not i else " " if kind == "more" else "\n") + t
        out.append(({"bar": "table", "text": "paragraph"}.get(group, group), level, own[0][2], len(own), said))
    return out


VECTORS = [
    None, "", "\n \n", "# Titel\n\n**fett**\nzwei", "- a\n- b\n  - b1\n  - b2\n- c", "1. eins\n2. zwei\n- drei", "| a | b |\n| --- | --- |\n| 1 | 2 |\n| x", "> **Fazit:** gut\n> weiter\nText", '```ts\nconst a = "<b>";\n```\nb', "oben\n\n---\n\nunten",
    "<details><summary>x</summary>\n- y\n</details>\nz", "- a\n\n  more\n\n- b\ntext\n- c", "```\n- a\n```js\n```\n```", "| a\n\n|b|\n|c|", "###### h\n####### no\n#no", "a\r\nb", "  - x\n y\n  - z", "```foo bar\ntext", "* a\n  1. b\n  2. c\n* d",
]


def test_blocks_are_those_of_a_walk(spark):
    r = random.Random(4)
    parts = ["- a", "  - b", "    - c", "1. d", "  2) e", "# h", "## ", "> q", " >r", "```", "```py", "```a b", "", " ", "text", "  text", "---", "| a | b |", "|---|---|", "<details>", "x </details>", "<details>y</details>", "* * *", "\t- t"]
    texts = VECTORS + ["\n".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(300)]
    found = {}
    for x in markdown_blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).orderBy("doc_id", "block").collect():
        found.setdefault(x["doc_id"], []).append((x["kind"], x["level"], x["first_line"], x["n_lines"], x["text"]))
    for i, t in enumerate(texts):
        assert found.get(i, []) == blocks_twin(t), t


def test_blocks_of_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {}
    for x in markdown_blocks(docs).orderBy("doc_id", "block").collect():
        found.setdefault(x["doc_id"], []).append((x["kind"], x["level"], x["first_line"], x["n_lines"], x["text"]))
    assert found == {r["doc_id"]: blocks_twin(r["text"]) for r in docs.collect() if blocks_twin(r["text"])}
