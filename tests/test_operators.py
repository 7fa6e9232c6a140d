"""Operators on literal rows that reach each branch; expectations are derived by hand or by a plain twin."""

from __future__ import annotations

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from parlance.functions import redaction, text
from parlance.functions.blocks import plain_text, text_block
from parlance.operators import activity, evidence, filtering, merging, rendering, report, roles, routing
from parlance.schema import MESSAGES, ExportOptions
from parlance.sources.conversations import base_conversations, messages_from_clipboard, messages_from_turns
from parlance.streaming.turns import first_seen, redacted_turns

DATA = "/root/testdata/sf0.001"


def values(spark, column, rows, schema="a string"):
    frame = spark.createDataFrame(rows, schema)
    return [r[0] for r in frame.select(column).collect()]


def block(kind, **fields):
    names = ("type", "text", "language", "markdown", "url", "alt", "src", "filename", "data_url", "mime_type")
    return tuple({"type": kind, **fields}.get(n) for n in names)


def message(conv, i, role, content, kind=None, meta=None):
    return (conv, i, f"{role}-{i}", role, kind, content, meta)


def said(conv, i, role, t, kind=None):
    return message(conv, i, role, [block("text", text=t)], kind)


# Merging.


def snapshot_rows(windows, tops=None):
    """Windows of labels: ``=x`` has the provider id x, others go by role and text."""
    out = []
    for s, window in enumerate(windows):
        for i, label in enumerate(window):
            pid, role = (label[1:], "user") if label.startswith("=") else (None, label.split(":")[0] if ":" in label else "user")
            key = f"message:{role}:{pid or hashlib.sha256(label.encode()).hexdigest()}"
            out.append((1, s, i, role, None, pid, key, f"{label}@{s}", None if tops is None else float(tops[s][i])))
    return out


def merged(spark, windows, tops=None):
    found = merging.merge_snapshots(spark.createDataFrame(snapshot_rows(windows, tops), merging.SNAPSHOT)).orderBy("msg_idx").collect()
    assert [r["msg_idx"] for r in found] == list(range(len(found))) and [r["id"] for r in found] == [f"message-{i + 1}" for i in range(len(found))]
    return [r["text"] for r in found]


def labels(texts):
    return [t.split("@")[0] for t in texts]


def test_merge_puts_late_pages_between_what_was_there(spark):
    found = merged(spark, [["=1", "=2", "=46", "=47"], ["=2", "=3", "=4"], ["=4", "=5", "=46"], ["=46", "=47"]])
    assert labels(found) == ["=1", "=2", "=3", "=4", "=5", "=46", "=47"]
    assert found[-1] == "=47@3" and found[0] == "=1@0"  # the last content stays


def test_merge_by_text(spark):
    assert labels(merged(spark, [["one", "two"], ["two", "three"]])) == ["one", "two", "three"]
    again = ["user:continue", "assistant:x", "user:continue", "assistant:y"]
    assert labels(merged(spark, [again])) == again
    windows = [["user:continue", "assistant:x", "user:continue"], ["assistant:x", "user:continue", "assistant:y"], ["user:continue", "assistant:y", "user:continue", "assistant:z"]]
    assert labels(merged(spark, windows)) == ["user:continue", "assistant:x", "user:continue", "assistant:y", "user:continue", "assistant:z"]


def test_merge_by_position(spark):
    thread = [("user:continue", "assistant:same")[i % 2] for i in range(120)]
    windows = [thread[s : s + 20] for s in range(0, 120, 8)]
    tops = [[(s + i) * 70 for i in range(len(w))] for s, w in zip(range(0, 120, 8), windows, strict=True)]
    assert len(merged(spark, windows)) < 120
    assert labels(merged(spark, windows, tops)) == thread
    moved = ["a", "continue", "b", "continue", "c", "continue", "d", "continue"]
    found = merged(spark, [moved[:6], moved[2:]], [[0, 70, 140, 210, 280, 350], [440, 510, 580, 650, 720, 790]])
    assert labels(found) == moved


def test_merge_of_a_long_walk(spark):
    thread = [f"={i}" for i in range(3000)]
    assert labels(merged(spark, [thread[s : s + 30] for s in range(0, 3000, 15)])) == thread
    up = [thread[s : s + 30] for s in range(2970, -1, -15)]  # every window goes before what is there
    assert labels(merged(spark, up)) == thread


def test_unchanged_snapshots_go(spark):
    rows = snapshot_rows([["=1", "=2"], ["=1", "=2"], ["=1", "=3"], ["=1", "=2"]])
    rows = [(*r[:7], r[5], r[8]) for r in rows]
    found = merging.drop_unchanged(spark.createDataFrame(rows, merging.SNAPSHOT)).select("snapshot_seq").distinct().collect()
    assert sorted(r[0] for r in found) == [0, 2, 3]


def test_positions_are_trusted_if_every_element_shows_its_message(spark):
    rows = [(1, 0, "hello  world", 1.0, "x hello world y"), (1, 0, "", 2.0, "z"), (1, 1, "hello", 1.0, "other"), (1, 1, "b", 2.0, "b")]
    found = merging.trusted_tops(spark.createDataFrame(rows, "conv_id long, snapshot_seq int, text string, top double, root_text string")).collect()
    assert sorted((r["snapshot_seq"], r["top"]) for r in found if r["top"]) == [(0, 1.0), (0, 2.0)]


def test_headers_come_from_the_last_snapshot(spark):
    rows = [(1, 0, "old"), (1, 2, "new"), (1, 1, "mid"), (2, 0, None)]
    found = merging.merge_headers(spark.createDataFrame(rows, "conv_id long, snapshot_seq int, title string")).collect()
    assert sorted((r["conv_id"], r["title"]) for r in found) == [(1, "new"), (2, None)]


def test_capture_status(spark):
    found = values(spark, merging.capture_status(F.col("a"), F.col("b")), [(True, True), (False, False)], "a boolean, b boolean")
    assert [(r["status"], r["reasons"]) for r in found] == [("complete", []), ("incomplete", ["load-limit", "walk-limit"])]


# Options, selection, copies.


def test_interim_replies(spark):
    rows = [said(1, 0, "user", "q"), said(1, 1, "assistant", "a"), said(1, 2, "assistant", "b", "activity"), said(1, 3, "assistant", "c"), said(1, 4, "assistant", "d", "document"), said(1, 5, "assistant", "e"), said(2, 0, "assistant", "x")]
    frame = spark.createDataFrame(rows, MESSAGES)
    found = frame.select("conv_id", "msg_idx", filtering.interim_flag().alias("f")).where("f").collect()
    assert sorted((r[0], r[1]) for r in found) == [(1, 1), (1, 2)]
    kept = filtering.apply_export_options(frame, ExportOptions(collapse_intermediate=False)).collect()
    assert sorted((r["conv_id"], r["msg_idx"]) for r in kept) == [(1, 0), (1, 3), (1, 4), (1, 5), (2, 0)]


def test_options(spark):
    rows = [message(1, 0, "user", [block("image", src="s")]), message(1, 1, "user", [block("text", text="a@b.de"), block("image", alt="x@y.de", filename="f")])]
    frame = spark.createDataFrame(rows, MESSAGES)
    kept = filtering.apply_export_options(frame, ExportOptions(images=False, metadata=False)).collect()
    assert [(r["msg_idx"], [b["text"] for b in r["content"]], r["metadata"]) for r in kept] == [(1, ["[redacted-email]"], None)]
    redacted = filtering.redact_messages(frame).orderBy("msg_idx").collect()
    assert [r["changed"] for r in redacted] == [False, True] and redacted[1]["content"][1]["alt"] == "[redacted-email]"
    header = spark.createDataFrame([(1, "https://me:pw@Example.com:443/a?b#c", "gpt")], "conv_id long, url string, model string")
    out = filtering.apply_header_options(header, ExportOptions(anonymize_url=True, metadata=False)).first()
    assert (out["url"], out["model"]) == ("https://example.com/a", None)
    assert filtering.apply_header_options(header).first()["model"] == "gpt"


def test_preview_shows_the_selection(spark):
    frame = spark.createDataFrame([said(1, 0, "user", "a@b.de"), said(1, 1, "user", "x"), message(1, 2, "user", [block("image", src="s")])], MESSAGES)
    chosen = spark.createDataFrame([(1, "user-0"), (1, "user-2"), (1, "user-2")], "conv_id long, msg_id string")
    found = filtering.preview(frame, chosen, ExportOptions(images=False)).collect()
    assert [(r["id"], r["content"][0]["text"]) for r in found] == [("user-0", "[redacted-email]")]


def test_edits_replace_changed_markdown_only(spark):
    frame = spark.createDataFrame([message(1, 0, "user", [block("quote", text="a\nb")]), said(1, 1, "user", "x")], MESSAGES)
    edits = spark.createDataFrame([(1, "user-0", "> a\n> b"), (1, "user-1", "y")], "conv_id long, msg_id string, markdown string")
    found = {r["id"]: r["content"] for r in filtering.apply_edits(frame, edits).collect()}
    assert found["user-0"][0]["type"] == "quote" and found["user-1"][0]["text"] == "y"


def test_provider_copy(spark):
    long = "the whole answer that the provider has copied for us"
    frame = spark.createDataFrame([said(1, 0, "assistant", long + " Copy"), said(1, 1, "user", long), said(1, 2, "assistant", long)], MESSAGES)
    copies = spark.createDataFrame([(1, "assistant-0", "**" + long), (1, "user-1", long), (1, "assistant-2", "short")], "conv_id long, msg_id string, copied_text string")
    on = {r["msg_idx"]: r for r in filtering.apply_provider_copy(frame, copies, ExportOptions(use_provider_copy=True)).collect()}
    assert on[1]["metadata"] is None and on[2]["metadata"] is None
    copy = spark.createDataFrame([(1, "assistant-0", long)], "conv_id long, msg_id string, copied_text string")
    one = {r["msg_idx"]: r for r in filtering.apply_provider_copy(frame, copy, ExportOptions(use_provider_copy=True)).collect()}
    assert one[0]["content"][0]["text"] == long and one[0]["metadata"]["extractionMethod"] == "provider-copy"
    assert filtering.apply_provider_copy(frame, copy).where("metadata IS NOT NULL").count() == 0


# Activity and roles.


def test_activity_of_a_message(spark):
    parts = [
        block("text", text="Thought for 12s.\n\nHello  there\n\nPlan\n\nDokument · MD\n\nWeb durchsucht"),
        block("code", text="x = 1"),
        block("text", text="Plan\n\ndokument"),
        block("text", text="searched the web\n\nBye"),
    ]
    rows = [message(1, 0, "user", [block("text", text="Thought for 1s")]), message(1, 1, "assistant", parts), message(1, 2, "assistant", [block("text", text="Dachte kurz nach.")])]
    found = activity.separate_activity(spark.createDataFrame(rows, MESSAGES)).orderBy("msg_idx").collect()
    assert [(r["role"], r["kind"], [b["text"] for b in r["content"]]) for r in found] == [
        ("user", None, ["Thought for 1s"]),
        ("assistant", "activity", ["Thought for 12s\nArtefakt: Plan\nWeb durchsucht\nsearched the web"]),
        ("assistant", None, ["Hello  there", "x = 1", "Bye"]),
        ("assistant", "activity", ["Dachte kurz nach"]),
    ]
    assert [r["msg_idx"] for r in found] == [0, 1, 2, 3] and found[2]["id"] == "assistant-1"


ROLES = [
    ("message user-row", "", 1, "user", "user"), ("the bot here", "You: x", 0, "assistant", "assistant"), ("", "You said: hi", 1, "user", "user"),
    ("", "ChatGPT said: hi", 0, "assistant", "assistant"), ("username", "x", 1, "assistant", "user"), (None, None, 0, "user", "user"), ("", "you are", 1, "assistant", "assistant"),
]


def test_roles(spark):
    frame = spark.createDataFrame(ROLES, "marks string, said string, i int, want string, row string")
    for r in frame.select("want", "row", roles.infer_role(F.col("marks"), F.col("said"), F.col("i")).alias("a"), roles.infer_row_role(F.col("marks"), F.col("said"), F.col("i")).alias("b")).collect():
        assert (r["a"], r["b"]) == (r["want"], r["row"])


def test_documents_and_models(spark):
    frame = spark.createDataFrame([("Intro", 0)], "t string, i int")
    m = frame.select(roles.document_message(F.col("t"), F.col("i")).alias("m"), text.stable_id("document", F.lit("0:Intro")).alias("id")).first()
    assert (m["m"]["id"], m["m"]["kind"], m["m"]["role"], m["m"]["content"][0]["text"]) == (m["id"], "document", "assistant", "Intro")
    assert values(spark, roles.message_model(F.col("a"), F.lit("m")), [("user",), ("assistant",)]) == [None, "m"]


# Routing.

PAGES = [
    ("https://chatgpt.com/c/1", "provider", "chatgpt"), ("https://www.claude.ai/x", "provider", "claude"), ("https://notclaude.ai/", "web", "generic"), ("https://bing.com/chat", "provider", "copilot"),
    ("chrome://settings", "restricted", "generic"), ("https://chromewebstore.google.com/a", "restricted", "generic"), ("", "unknown", "generic"), (None, "unknown", "generic"), ("no url", "unknown", "generic"), ("http://a.b", "web", "generic"),
]


def test_pages(spark):
    frame = spark.createDataFrame(PAGES, "url string, kind string, who string")
    for r in frame.select("*", routing.page_kind(F.col("url")).alias("k"), routing.provider(F.col("url")).alias("p"), routing.page_state(routing.page_kind(F.col("url"))).alias("s")).collect():
        assert (r["k"], r["p"]) == (r["kind"], r["who"]), r["url"]
        assert r["s"] == {"web": "warning", "restricted": "error"}.get(r["kind"], "ready")


def test_marks_on_the_page_come_after_hosts(spark):
    marks = [("https://a.b", True, False), ("https://a.b", False, True), ("https://claude.ai", True, False), ("https://a.b", True, True)]
    assert values(spark, routing.provider(F.col("a"), F.col("b"), F.col("c")), marks, "a string, b boolean, c boolean") == ["chatgpt", "claude", "claude", "chatgpt"]


# Rendering.


def exported(spark, rows, kind="md", options=ExportOptions(redact_secrets=False), **header):
    head = spark.createDataFrame([(1, *(header.get(k) for k in ("provider", "title", "url", "model", "status", "reasons")))], "conv_id long, provider string, title string, url string, model string, status string, reasons array<string>")
    return rendering.export(spark.createDataFrame(rows, MESSAGES), base_conversations(head, "T"), kind, options, "9").first()


def test_markdown(spark):
    rows = [
        said(1, 0, "user", "q\n\nr"), said(1, 1, "assistant", "Looking <up>\nReading", "activity"), said(1, 2, "assistant", "first"), said(1, 3, "assistant", "", None),
        message(1, 4, "assistant", [block("code", text="x", language="py"), block("table", markdown="|a|"), block("quote", text="z\n\ny"), block("image", filename="f.png"), block("image", src="s")]),
    ]
    out = exported(spark, rows, title="A “B”", status="incomplete", reasons=["walk-limit"], model="m")
    assert out["filename"] == "a-b.md"
    assert out["content"] == (
        '---\nschema_version: "1.0"\nprovider: "generic"\ntitle: "A “B”"\ncaptured_at: "T"\nmodel: "m"\nmessage_count: "5"\nextension_version: "9"\n---\n\n# A “B”\n\n'
        "> Incomplete capture: the scrolling limit was reached. Messages may be missing.\n\n> q\n>\n> r\n\n<details><summary>Looking &lt;up&gt; · Reading · 1 previous message</summary>\n\nfirst\n\n</details>\n\n"
        "```py\nx\n```\n\n|a|\n\n> > z\n> >\n> > y\n\n![f.png](f.png)\n\n![image](s)\n"
    )


def test_markdown_of_activity_alone(spark):
    lines = "\n".join(f"step {i}" for i in range(6))
    body = exported(spark, [said(1, 0, "assistant", lines, "activity"), said(1, 1, "assistant", "done")], title="t")["content"]
    assert "_step 0 · step 1 · step 2 · step 3 · +2_\n\ndone\n" in body
    assert "<details><summary></summary>" in exported(spark, [said(1, 0, "assistant", "x" * 81, "activity"), said(1, 1, "assistant", "d")], title="t")["content"]


def test_json(spark):
    meta = (None, None, None, 0, "h", None, None)
    rows = [message(1, 0, "user", [block("quote", text='a"\nb')], None, meta), said(1, 1, "assistant", "x", "activity")]
    out = exported(spark, rows, "json", title="T t", url="u", status="complete", reasons=[])
    want = {
        "title": "T t", "provider": "generic", "url": "u", "captured_at": "T", "extension_version": "9", "capture": {"status": "complete", "reasons": []}, "message_count": 2,
        "messages": [{"role": "user", "content": '> a"\n> b', "metadata": {"index": 0, "visibleTextHash": "h"}}, {"role": "assistant", "content": "x", "kind": "activity"}],
    }
    assert out["content"] == json.dumps(want, indent=2) and out["filename"] == "t-t.json"
    bare = exported(spark, rows, "json", ExportOptions(metadata=False), title="t")["content"]
    assert "metadata" not in bare and json.loads(bare)["message_count"] == 2
    with pytest.raises(ValueError):
        exported(spark, rows, "html")


def test_meta_line(spark):
    row = [(1, 2, False, "p", "m", "c", ""), (2, 2, True, "p", None, None, "u")]
    frame = spark.createDataFrame(row, "n int, total int, docs boolean, provider string, model string, captured_at string, url string")
    line = rendering.meta_line(F.col("n"), F.col("total"), F.col("docs"), {k: F.col(k) for k in ("provider", "model", "captured_at", "url")})
    assert [r[0] for r in frame.select(line).collect()] == ["1 of 2 messages · p · m · captured c", "2 sections · p · u"]


def test_plain_text(spark):
    frame = spark.createDataFrame([message(1, 0, "user", [block("text", text=" a"), block("image", alt="b", src="s", filename=""), block("table", markdown="t")])], MESSAGES)
    assert frame.select(plain_text(F.col("content"))).first()[0] == "a\n\nb s\n\nt"


# Evidence.


def test_evidence(spark):
    png = "data:image/png;base64,iVBORw0="
    rows = [said(1, 3, "user", "x"), message(1, 5, "assistant", [block("text", text="y"), block("image", data_url=png, mime_type="image/png", alt="pic")])]
    frame = spark.createDataFrame(rows, MESSAGES)
    head = base_conversations(spark.createDataFrame([(1, "t")], "conv_id long, title string"), "T")
    pages = spark.createDataFrame([(1, True, "<p>", b"")], "conv_id long, include_original boolean, html_snapshot string, screenshot binary")
    files = evidence.evidence_files(frame, head, "9", pages)
    name = "artifacts/images/message-2-image-2.png"
    data = {r["name"]: bytes(r["data"]) for r in files.collect()}
    assert set(data) == {"transcript.md", "conversation.json", name, "snapshot.html"} and data[name] == b"\x89PNG\r"
    assert f"![pic]({name})" in data["transcript.md"].decode()
    out = evidence.manifest(files, head, "9", "now", pages, "b", "p").first()
    found = json.loads(out["manifest"])
    assert out["hashes"] == {n: hashlib.sha256(d).hexdigest() for n, d in data.items()} == found["hashes"]
    assert found["artifacts"] == [{"id": "image-2-2", "type": "image", "filename": name, "mime_type": "image/png", "bytes": 5, "sha256": out["hashes"][name]}]
    assert found["exported_formats"] == ["transcript.md", "conversation.json", name, "snapshot.html"]
    assert found["original_page_included"] is True and found["source"] == {"provider": "generic", "url": "", "title": "t", "captured_at": "T"}
    assert [found[k] for k in ("schema_version", "extension_version", "browser", "platform", "generated_at")] == ["1.0", "9", "b", "p", "now"]
    shut = spark.createDataFrame([(1, False, "<p>", b"")], "conv_id long, include_original boolean, html_snapshot string, screenshot binary")
    closed = evidence.evidence_files(frame, head, "9", shut)
    plain = json.loads(evidence.manifest(closed, head, "9", "now", shut).first()["manifest"])
    assert plain["original_page_included"] is False and "original_page_warning" not in plain and "snapshot.html" not in plain["hashes"]


def test_report(spark):
    meta = lambda i: (None, None, None, i, None, str(i), None)
    rows = [message(1, i, "user", [block("text", text="x")], None, meta(i)) for i in (3, 4, 6)] + [said(2, 0, "assistant", "", "activity")]
    found = {r["conv_id"]: r for r in report.capture_report(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert [found[1][k] for k in ("n", "n_with_id", "min_id", "max_id", "ids_increase", "contiguous", "n_duplicates")] == [3, 3, 3, 6, True, False, 2]
    assert [found[2][k] for k in ("n_activity", "n_empty", "min_id", "ids_increase")] == [1, 1, None, None]


# Scalar functions and sources.

SCALARS = [
    (text.safe_url, "HTTPS://x", True), (text.safe_url, "javascript:1", False), (text.safe_url, None, False), (text.hostname, "https://A.b/c", "a.b"), (text.hostname, "not a url", "not a url"),
    (text.mime_of_data_url, "data:image/png;base64,xx", "image/png"), (text.mime_of_data_url, "http://x", None), (text.filename_of_url, "https://a.b/c/d.png?x", "d.png"),
    (lambda c: text.stable_id("p", c), "", "p-ztntfp"), (text.escape_html, "<a href=\"'\">&", "&lt;a href=&quot;&#039;&quot;&gt;&amp;"), (text.crc32, "123456789", 0xCBF43926),
    (lambda c: text.escape_html(c, True, False), "'\"", "'&quot;"), (text.prefix_lines, "a\n \nb", "> a\n>\n> b"),
]


def test_scalars(spark):
    for f, given, want in SCALARS:
        assert values(spark, f(F.col("a")), [(given,)]) == [want], given


def test_stable_id_equals_a_plain_twin(spark):
    def twin(t):
        h = 2166136261
        raw = t.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619 % 2**32
        out = ""
        while h:
            h, d = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return f"p-{out}"

    texts = ["a", "é😀", "x" * 500, "\n", "long text with words"]
    assert values(spark, text.stable_id("p", F.col("a")), [(t,) for t in texts]) == [twin(t) for t in texts]


def test_clipboard(spark):
    rows = [(1, "Note: x\nUser: hi\nthere\nClaude : yes\nEmail: no"), (2, "first\n\n\nsecond\n\nthird"), (3, " \n "), (4, None)]
    found = messages_from_clipboard(spark.createDataFrame(rows, "conv_id long, text string")).orderBy("conv_id", "msg_idx").collect()
    assert [(r["conv_id"], r["role"], r["content"][0]["text"]) for r in found] == [
        (1, "user", "x"), (1, "user", "hi\nthere"), (1, "assistant", "yes\nEmail: no"), (2, "user", "first"), (2, "assistant", "second"), (2, "user", "third"),
    ]


def test_turns_with_nulls(spark):
    found = messages_from_turns(spark.createDataFrame([(1, 0, None, None, "extra")], "conv_id long, turn long, role string, text string, id string")).first()
    assert (found["role"], found["content"][0]["text"]) == ("unknown", "")


# Redaction of whole texts against a plain twin.


def redaction_twin(t):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)

    def phone_like(v):
        n = len(digits(v))
        groups = [g for g in re.split("[ ./()-]+", re.sub(r"^(.*?)\(0\)", r"\1", v, flags=re.S)) if g]
        if not 7 <= n <= 15 or (re.fullmatch("[0-9]+", v) and v[0] != "0") or re.match(r"[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}", v) or re.fullmatch(r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}", v):
            return False
        if re.fullmatch(r"[0-9]{4}\s*-\s*[0-9]{4}", v) or ("." in v and not re.fullmatch(r"[0-9]{3}\.[0-9]{3}\.[0-9]{4}", v)) or re.fullmatch("[1-9][0-9]{0,2}( [0-9]{3})+", v):
            return False
        return all(len(g) > 1 for g in groups[1:])

    def phone(m):
        v = m.group()
        head, body = ("(", v[1:]) if v[0] == "(" and ")" not in v else ("", v)
        groups, out, i = body.split(" "), [], 0
        while i < len(groups):
            k = next((k for k in range(len(groups), i, -1) if phone_like(" ".join(groups[i:k]))), None)
            out.append(groups[i] if k is None else "[redacted-phone]")
            i = i + 1 if k is None else k
        return head + " ".join(out)

    a = re.ASCII
    t = re.sub(r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[redacted-email]", t, flags=re.I | a)
    t = re.sub(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}\b", lambda m: "[redacted-iban]" if 15 <= len(m.group().replace(" ", "")) <= 34 else m.group(), t, flags=a)
    card = r"\b(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})\b"
    t = re.sub(card, lambda m: "[redacted-card]" if luhn(digits(m.group())) else m.group(), t, flags=a)
    t = re.sub(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "[redacted-aws-key]", t, flags=a)
    t = re.sub(r"\b(?:sk|rk|pk|xox[baprs]|ghp|github_pat)_[A-Za-z0-9_-]{16,}\b", "[redacted-token]", t, flags=a)
    t = re.sub(r"\b[A-Za-z0-9_-]{32,}\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}\b", "[redacted-token]", t, flags=a)
    t = re.sub(r"(?i)\b(api[_-]?key|token|secret|password)\s*[:=]\s*[\"']?[^\"'\s,;]{8,}", r"\1=[redacted-secret]", t, flags=a)
    return re.sub(r"(?:(?<=^)|(?<=[\s(]))\(?\+?[0-9](?:[0-9]|[ ./-](?=[0-9])|\) ?(?=[0-9])| ?\((?=[0-9]))*\b", phone, t, flags=a)


def test_redaction_of_all_documents_equals_a_plain_twin(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("text IS NOT NULL")
    found = docs.select("text", redaction.redact_text(F.col("text")).alias("got")).collect()
    want = [redaction_twin(r["text"]) for r in found]
    assert [r["got"] for r in found] == want and any(w != r["text"] for w, r in zip(want, found, strict=True))


# Streams.


def test_streams(spark, tmp_path):
    turns = spark.createDataFrame([(1, "user", "a@b.de", 0), (1, "user", "a@b.de", 1), (1, "user", "x", 2)], "conv_id long, role string, text string, s int")
    turns.withColumn("ts", F.timestamp_seconds("s")).drop("s").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("conv_id long, role string, text string, ts timestamp").parquet(f"{tmp_path}/in")
    out = redacted_turns(first_seen(stream)).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert sorted(r["text"] for r in spark.sql("SELECT text FROM seen").collect()) == ["[redacted-email]", "x"]


def test_text_block_fields(spark):
    assert values(spark, text_block(F.col("a")), [("t",)])[0]["text"] == "t"
