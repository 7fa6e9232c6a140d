"""Very long texts of one kind of character: patterns neither overflow the stack nor take more than linear time."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from parlance.functions.redaction import EMAIL, PHONE, redact_text
from parlance.functions.text import fnv1a
from parlance.plans import catalogue

N = 1_000_000
#: Repeated units of which nothing is redacted.
KEPT = ("1", "0", "a", " ", ".", "+1 ", "a.a-", "aB1_")


def test_redaction_of_a_million_characters(spark):
    texts = [u * (N // (10 * len(u)) if " " in u.strip() + "x" and len(u) > 1 else N // len(u)) for u in KEPT]
    rows = [(t, t) for t in texts] + [("a@b" + ".cc" * (N // 3), "[redacted-email]")]
    frame = spark.createDataFrame(rows, "raw string, want string").repartition(4)
    assert frame.select((redact_text(F.col("raw")) == F.col("want")).alias("same")).where(~F.col("same")).count() == 0


#: The plain patterns, with backtracking, as Python's engine runs them.
PLAIN = {
    PHONE: (r"(?:(?<=^)|(?<=[\s(]))\(?\+?[0-9](?:[0-9]|[ ./-](?=[0-9])|\) ?(?=[0-9])| ?\((?=[0-9]))*\b", "0123 ().-/+a_"),
    EMAIL: (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "aab.@-_%1 é"),
}


@pytest.mark.parametrize("pattern", list(PLAIN), ids=["phone", "email"])
def test_patterns_find_what_backtracking_finds(spark, pattern):
    plain, letters = PLAIN[pattern]
    r = random.Random(13)
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(4000)]
    found = spark.createDataFrame([(t,) for t in texts], "raw string").select("raw", F.regexp_extract_all("raw", F.lit(pattern), F.lit(0)).alias("m")).collect()
    want = re.compile(plain, re.ASCII)
    assert [(x["raw"], x["m"]) for x in found] == [(t, [m.group() for m in want.finditer(t)]) for t in texts]


def test_hash_of_units_across_parts(spark):
    def twin(t):
        h, raw = 2166136261, t.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619 % 2**32
        return h

    texts = ["", "\0", "\uffff", "\U00010000", "\U0010ffff", "\r\n\u2028\u0085", "a😀" * 1500, "😀" * 2049, *("x" * n + "😀é" for n in (1022, 1023, 1024, 1025, 2047))]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "raw string").select(fnv1a(F.col("raw")).alias("h")).collect()
    assert [r["h"] for r in rows] == [*map(twin, texts), None]


def test_ids_of_long_turns_take_linear_time(spark, tmp_path):
    """select_and_edit over one turn of 40,000 characters, and over as many in short turns."""
    took = {}
    for n in (400, 1):
        rows = [(1, i, "user", f"{i:05}" + "x" * (40_000 // n - 5)) for i in range(n)]
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/{n}/conversations.parquet")
        began = time.perf_counter()
        found = catalogue.select_and_edit(spark, f"{tmp_path}/{n}").collect()
        took[n] = time.perf_counter() - began
        assert sorted(map(tuple, found)) == [(1, i, t[:100]) for _, i, _, t in rows]
    assert took[1] < 3 * took[400] + 2
