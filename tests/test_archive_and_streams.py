"""Archives, sanitised pages, folders of transcripts and merges of streams and of long threads."""

from __future__ import annotations

import io
import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from parlance.operators import archive, evidence, merging, sanitising
from parlance.sources.transcripts import TranscriptFolder
from parlance.streaming.merging import merged_threads


def test_archives_are_read_by_a_standard_reader(spark):
    r = random.Random(1)
    files = {1: [("a.txt", b"A"), ("empty", b""), ("ä/ö.bin", r.randbytes(70_000))], 2: [("one.txt", b"1")], 3: [(f"f{i}", b"x" * i) for i in range(300)]}
    rows = [(c, i, n, d) for c, own in files.items() for i, (n, d) in enumerate(own)]
    r.shuffle(rows)
    headers = spark.createDataFrame([(1, "A Talk"), (2, None)], "conv_id long, title string")
    found = {x["conv_id"]: x for x in archive.archives(spark.createDataFrame(rows, "conv_id long, seq int, name string, data binary"), headers).collect()}
    assert {c: x["filename"] for c, x in found.items()} == {1: "a-talk-evidence.zip", 2: "conversation-evidence.zip", 3: "conversation-evidence.zip"}
    for c, own in files.items():
        raw = bytes(found[c]["archive"])
        assert raw[:4] == b"PK\x03\x04" and raw[-22:-18] == b"PK\x05\x06" and int.from_bytes(raw[-12:-10], "little") == len(own)
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            assert z.testzip() is None
            assert [z.read(i) for i in z.infolist()] == [d for _, d in own] and [i.file_size for i in z.infolist()] == [len(d) for _, d in own]


def test_pages_lose_what_is_private(spark):
    html = (
        "<title>T & '</title><body onload=x><p class=a onclick='x()' data-n=1>kept <b>bold</p><script>alert(1)</script><div hidden>h</div><div aria-hidden=true><p>h</p></div><span class='x sr-only'>h</span>"
        "<i class=visually-hidden-2>h</i><p style='Visibility : Hidden'>h</p><p style='opacity:0.5'>seen</p><form><input value=v><textarea>h</textarea>in form</form><video>h</video>"
        "<a href=' JAVA\tscript:x()'>j</a><a href='/p?a=1&amp;b=\"2\"'>l</a><img src='data:image/png;base64,AA' alt=i><img src=javascript:x><a href=data:x>d</a><custom>c &lt;x&gt;</custom>"
    )
    frame = spark.createDataFrame([(1, html), (2, None), (3, "no body <script>x</script><u>u</u>")], "page_id long, html string")
    found = {r["page_id"]: r["html"] for r in sanitising.page_snapshots(frame).collect()}
    body = (
        '<p class="a">kept <b>bold</b></p><p>seen</p>in form<a>j</a><a href="/p?a=1&amp;b=&quot;2&quot;">l</a><img src="data:image/png;base64,AA" alt="i"><img><a>d</a>c &lt;x&gt;'
    )
    assert found[1].split("<body>")[1] == body + "</body></html>" and "<title>T &amp; &#039;</title>" in found[1] and "default-src 'none'" in found[1]
    assert found[2].endswith("<body></body></html>") and found[3].endswith("<body>no body <u>u</u></body></html>")


def test_evidence_holds_sanitised_pages_only(spark):
    from parlance.schema import MESSAGES
    from parlance.sources.conversations import base_conversations

    messages = spark.createDataFrame([], MESSAGES)
    headers = base_conversations(spark.createDataFrame([(1,), (2,)], "conv_id long"), "t")
    originals = spark.createDataFrame([(1, True, "<p>a<script>evil()</script>", None), (2, False, "<p>b", None)], "conv_id long, include_original boolean, html_snapshot string, screenshot binary")
    pages = evidence.evidence_files(messages, headers, "1", originals).where("name = 'snapshot.html'").collect()
    assert [p["conv_id"] for p in pages] == [1] and b"<p>a</p>" in bytes(pages[0]["data"]) and b"evil" not in bytes(pages[0]["data"])


def test_transcripts_are_written_one_by_one_and_read_again(spark, tmp_path):
    spark.dataSource.register(TranscriptFolder)
    rows = [(i - 2, f"talk-{i % 2}.md", f"# {i}\r\n\nä😀\n") for i in range(7)] + [(9, "a/../b.md", ""), (10, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, filename string, content string").repartition(3)
    folder = str(tmp_path / "out")
    frame.write.format("transcripts").mode("append").save(folder)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert "_SUCCESS" in names and "0-talk-0.md" in names and "9-a_.._b.md" in names and not [n for n in names if n.startswith(".")]
    back = sorted(tuple(r) for r in spark.read.format("transcripts").load(folder).collect())
    assert back == sorted((c, (n or "conversation.md").replace("/", "_"), t or "") for c, n, t in rows)
    frame.where("conv_id = 1").write.format("transcripts").mode("overwrite").save(folder)
    assert [r["conv_id"] for r in spark.read.format("transcripts").load(folder).collect()] == [1]
    bad = frame.withColumn("content", F.when(F.col("conv_id") == 3, F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="stop"):
        bad.coalesce(1).write.format("transcripts").mode("append").save(str(tmp_path / "failed"))
    assert not (tmp_path / "failed" / "_SUCCESS").exists()


def snapshots(seed, n=40):
    """Windows over a thread of messages with and without ids, with texts that repeat, and with positions on the page or not."""
    r = random.Random(seed)
    ids, tops = r.random() < 0.5, r.random() < 0.7
    thread = [(f"p{i}" if ids and r.random() < 0.7 else None, r.choice(["user", "assistant"]), f"t{i}" if r.random() < 0.6 else "same") for i in range(n)]
    rows, at, seq = [], 0, 0
    while at < n:
        window = range(at, min(n, at + 12))
        for k, i in enumerate(window):
            identity, role, text = thread[i]
            rows.append((seq, k, role, None, identity, f"message:{role}:{identity or text}", f"{text} v{seq}", i * 70.0 + 300 * (seq > 2) if tops else None))
        at += r.choice([3, 5, 8]) if len(window) == 12 else n
        seq += 1
    return thread, tops, rows


def test_windows_over_a_thread_give_it_back(spark):
    rows, threads = [], {}
    for seed in range(40):
        thread, tops, own = snapshots(seed)
        if tops:
            threads[seed] = [(role, text) for _, role, text in thread]
            rows += [(seed, *r) for r in own]
    found = {}
    for r in merging.merge_snapshots(spark.createDataFrame(rows, merging.SNAPSHOT).repartition(5)).orderBy("conv_id", "msg_idx").collect():
        found.setdefault(r["conv_id"], []).append((r["role"], r["text"].split(" ")[0]))
    assert found == threads


def test_new_messages_between_two_find_room(spark):
    rows = [(1, 0, 0, "user", None, "a", "ka", "a", None), (1, 0, 1, "user", None, "z", "kz", "z", None)]
    for s in range(1, 200):  # each comes right behind the first one
        rows += [(1, s, 0, "user", None, "a", "ka", "a", None), (1, s, 1, "user", None, f"m{s}", f"k{s}", f"m{s}", None)]
    found = [r["text"] for r in merging.merge_snapshots(spark.createDataFrame(rows, merging.SNAPSHOT)).orderBy("msg_idx").collect()]
    assert found == ["a", *(f"m{s}" for s in range(199, 0, -1)), "z"]


def test_streams_give_the_threads_of_tables(spark, tmp_path):
    rows = [(seed, *r) for seed in range(6) for r in snapshots(seed, 25)[2]]
    rows.sort(key=lambda r: (r[1], r[0], r[2]))
    names = [x.split(" ")[0] for x in merging.SNAPSHOT.split(", ")]
    want = sorted(tuple(r) for r in merging.merge_snapshots(spark.createDataFrame(rows, merging.SNAPSHOT)).collect())
    for cut in (7, 31):
        source, out, marks = (tmp_path / f"{x}{cut}" for x in ("in", "out", "marks"))
        source.mkdir()
        parts = [rows[a : a + len(rows) // cut + 1] for a in range(0, len(rows), len(rows) // cut + 1)]

        def run(parts, source=source, out=out, marks=marks):
            def keep(frame, batch):
                frame.write.mode("overwrite").parquet(f"{out}/{batch}")

            for k, part in enumerate(parts):  # a query of its own for each file: every one starts from the checkpoint
                number = len(list(source.iterdir()))
                file = source / f"{number:05}.json"
                file.write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in part))
                os.utime(file, (1_700_000_000 + number,) * 2)  # files are taken by age
                if k % 3 and k + 1 < len(parts):
                    continue
                stream = spark.readStream.schema(merging.SNAPSHOT).option("maxFilesPerTrigger", 1).json(str(source))
                merged_threads(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(marks)).trigger(availableNow=True).start().awaitTermination()

        run(parts[: 3 if cut == 7 else 4])
        run(parts[3 if cut == 7 else 4 :])
        every = spark.read.option("recursiveFileLookup", True).parquet(str(out))
        last = every.groupBy("conv_id").agg(F.max("version").alias("version"))
        found = every.join(last, ["conv_id", "version"]).select("conv_id", "msg_idx", "id", "role", "kind", "provider_id", "text").collect()
        assert sorted(tuple(r) for r in found) == want
