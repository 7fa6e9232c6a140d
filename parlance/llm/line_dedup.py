"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches. A batch's distinct line keys, with the number of its documents that hold each, are
merge-anti-joined with the runs: keys that the runs know as common are dropped, keys that they hold with fewer documents
carry the count on, unseen keys start anew. What is left becomes a sorted run of its own. Runs live in levels; when a
level holds ``fanout`` runs they are compacted into one run of the next level.

All runs are dealt by one hash of the key into the same buckets when they are written, so neither anti-joins nor
compactions move a row: only a batch's own counts have an exchange, after partial sums. A later batch, added to the same
runs, costs its own rows and a pass over the runs.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import BLANKS, UPPER, hold, keyed, map_docs, new_path, split_by, stored, texts_of, with_decisions

_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_BLANK_BYTES = BLANKS.encode()
#: Documents of a batch, and batches of a table; a larger table has larger batches.
BATCH_DOCS, LEAST_BATCHES, MOST_BATCHES = 50_000_000, 4, 64


class LineRuns:
    """Levelled runs in the shared folder: tables of (key, n) with ``buckets`` buckets, each sorted by key.

    ``n`` counts documents from the first batch on, so of several entries of a key the latest holds. A key that has
    reached ``min_docs`` is common and gets no further entry.
    """

    def __init__(self, spark: SparkSession, buckets: int, min_docs: int, fanout: int = 4):
        self.spark, self.buckets, self.min_docs, self.fanout = spark, buckets, min_docs, fanout
        self.levels: list[list[str]] = []
        self._tables: list[str] = []

    def bucketed(self, df: DataFrame, name: str) -> str:
        """Write ``df`` into buckets by key, sorted; returns the table's name."""
        table, path = f"{name.replace('-', '_')}_{uuid.uuid4().hex}", new_path(self.spark, name)
        df.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).format("parquet").saveAsTable(table)
        hold(path)
        self._tables.append(table)
        return table

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def _store(self, entries: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self.bucketed(entries, f"lines-run{level}"))
        if len(self.levels[level]) >= self.fanout:
            runs = [self.spark.table(t) for t in reversed(self.levels[level])]
            self.levels[level] = []
            # The latest entry of a key holds. Anti-joins, not an aggregate over the union, find it: Spark 4.1.2 takes a
            # union of bucketed column-wise scans for dealt by key, which it isn't, and would leave keys in two groups.
            merged = runs[0]
            for i, run in enumerate(runs[1:], 1):
                for later in runs[:i]:
                    run = run.join(later.select("key"), "key", "left_anti")
                merged = merged.unionByName(run)
            self._store(merged, level + 1)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Merge-anti-join: the rows whose key no run holds yet."""
        for run in self.runs():
            keys = keys.join(run.select("key"), "key", "left_anti")
        return keys

    def not_common(self, batch: DataFrame) -> DataFrame:
        """Merge-anti-join of (key, n) with the common keys of the runs; ``n`` of the others counts on from the runs."""
        known: list[Column] = []
        for i, run in enumerate(self.runs()):
            batch = batch.join(run.select("key", F.col("n").alias(f"n{i}")), "key", "left")
            known.append(F.coalesce(f"n{i}", F.lit(0)))
        before = F.lit(0) if not known else known[0] if len(known) == 1 else F.greatest(*known)
        return batch.where(before < self.min_docs).select("key", (F.col("n") + before).cast("long").alias("n"))

    def add(self, batch: DataFrame) -> None:
        """Add a batch: (key, n), no key twice."""
        self._store(self.not_common(batch), 0)

    def add_lines(self, keys: DataFrame) -> None:
        """Add the documents of a batch, as (keys): each counts once for each of its keys."""
        each = keys.select(F.explode(F.array_distinct("keys")).alias("key")).where(F.length("key") > 0)
        self.add(each.groupBy("key").agg(F.count("*").alias("n")))

    def common_keys(self) -> DataFrame:
        """The keys of ``min_docs`` documents or more; each stands in one run only, as it got no entry after that."""
        none = self.spark.createDataFrame([], "key binary")
        out = None
        for run in self.runs():
            own = run.where(F.col("n") >= self.min_docs).select("key")
            out = own if out is None else out.unionByName(own)
        return none if out is None else out

    def forget(self) -> None:
        """Drop the tables' names; their files stay with the other tables of the shared folder."""
        for t in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self._tables, self.levels = [], []


def line_key(line: bytes, min_chars: int = 1) -> bytes:
    """Key of a line: blanks stripped at both ends, A-Z lowered; empty if shorter than ``min_chars``, else a 128-bit hash."""
    bare = line.strip(_BLANK_BYTES).translate(_LOWER)
    if len(bare) < min_chars or (min_chars > 1 and len(bare.decode()) < min_chars):
        return b""
    return xxhash.xxh3_128_digest(bare)


def line_keys(rows: DataFrame, min_chars: int = 1) -> DataFrame:
    """One row per document with the keys of all its lines, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [[line_key(x, min_chars) for x in (t or "").encode().split(b"\n")] for t in texts_of(batch)]
            yield pd.DataFrame({"row_key": batch["row_key"], "doc_id": batch["doc_id"], "keys": keys})

    return map_docs(rows, run, "row_key long, keys array<binary>")


def _kept_of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        kept, n_lines, n_dropped = [], [], []
        for text, gone in zip(texts_of(batch), batch["gone"], strict=True):
            lines = (text or "").split("\n")
            drop = set() if gone is None else set(gone)
            kept.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text or "")
            n_lines.append(len(lines))
            n_dropped.append(len(drop))
        out = batch.drop(columns=["gone"]).assign(text=kept, n_lines=n_lines, n_dropped=n_dropped)
        out["sha"] = [hashlib.sha256(x.encode()).hexdigest() for x in kept]
        yield out


def stored_keys(rows: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """Line keys in the shared folder, with the ``batch`` of their document; each batch is a folder of its own."""
    path = new_path(rows.sparkSession, "line-keys")
    keys = line_keys(rows.select("doc_id", "text", "row_key"), min_chars).withColumn("batch", F.pmod("row_key", F.lit(batches)).cast("int"))
    keys.write.partitionBy("batch").parquet(path)
    hold(path)
    return rows.sparkSession.read.schema(keys.schema).parquet(path)


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int | None = None, carry: tuple[str, ...] = (), runs: LineRuns | None = None) -> DataFrame:
    """Drop every line whose key stands in at least ``min_docs`` documents: ``doc_id, text, n_lines, n_dropped, sha``.

    Keys of fewer than ``min_chars`` code points (1 at least) never count. The text of a null or empty document is one
    empty line, kept. A repeated row counts as a document of its own. Extra columns are ignored; no rows give no rows.
    The documents come in ``batches`` parts, by default as many as their number asks for; neither their number nor the
    order of batches changes the result. With ``runs``, the documents are added to those that the runs have counted before,
    and judged by all of them (``min_docs`` is that of the runs then); the runs stay for later tables. Columns named in ``carry`` come along as ``_0, _1, ...``.
    """
    if min_chars < 1 or min_docs < 1:
        raise ValueError("min_chars and min_docs are 1 at least")
    rows = keyed(docs, id_col, text_col, carry)
    if batches is None:
        batches = min(MOST_BATCHES, max(LEAST_BATCHES, math.ceil(rows.count() / BATCH_DOCS)))
    keys = stored_keys(rows, min_chars, batches)
    spark = docs.sparkSession
    known = LineRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), min_docs) if runs is None else runs
    for b in range(batches):
        known.add_lines(keys.where(F.col("batch") == b))
    # Stored, so that both sides of the later join are plain exchanges and a very common line can be split.
    common = stored(known.common_keys(), "common-lines")
    if runs is None:
        known.forget()
    lines = keys.select("row_key", "doc_id", F.posexplode("keys").alias("line", "key")).where(F.length("key") > 0)
    gone = stored(lines.join(common, "key", "left_semi").groupBy("row_key", "doc_id").agg(F.collect_set("line").alias("gone")), "common-places")
    # Only texts that may have a common line move; the others are judged where they lie.
    maybe, whole = split_by(rows, gone)
    joined = with_decisions(maybe, gone).unionByName(whole.withColumn("gone", F.lit(None).cast("array<int>"))).drop("row_key")
    kinds = "".join(f", _{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    return map_docs(joined, _kept_of_batches, f"text string, n_lines long, n_dropped long, sha string{kinds}")
