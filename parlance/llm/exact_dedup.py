"""Exact dedup: sorted runs of text digests, merged along a tree of exchanges between partitions.

A digest is the SHA-256 of a normalised text. Every task sorts the digests it meets into a run with one entry for each
digest: the row that stays, and how many rows it stands for. Partitions are numbered in binary and a digest belongs to
the partition named by its leading bits. In each round, partitions whose numbers differ in a few bits only exchange the
slices of their runs which belong to one another, and merge what they get; after the last round every digest has one
entry, in its own partition. Equal digests are joined at every level, so a text's copies, however many, are no more than
one entry of each run: no task gets them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import UPPER, stored

#: Entries of a partition after the last round, on average; bits of a partition's number decided in a round; entries of a frame.
ENTRIES, ROUND_BITS, FRAME = 1 << 20, 6, 1 << 15
#: A group with more than this share of all rows is looked up without an exchange; there can be no more than a thousand.
HOT_SHARE = 1000

#: Words of a digest as 64-bit numbers, of which the first leads; length of the text; id (and whether there is one), number and count of rows.
_ENTRY = np.dtype([("d0", "<u8"), ("d1", "<u8"), ("d2", "<u8"), ("d3", "<u8"), ("size", "<i8"), ("has", "<i8"), ("id", "<i8"), ("row", "<i8"), ("n", "<i8")])
_IDENTITY = ("d0", "d1", "d2", "d3", "size")
_FRAMES = "target int, entries binary"


def normalised(text: Column, fold_case: bool = True) -> Column:
    plain = F.coalesce(text, F.lit(""))
    return F.translate(plain, UPPER, UPPER.lower()) if fold_case else plain


def merged(entries: np.ndarray, largest: bool) -> np.ndarray:
    """One entry for each text, in digest order, from sorted runs that stand one behind the other.

    The stable sort finds the runs and merges them. Entries are joined only if their whole digests and the lengths of
    their texts agree. The row that stays has the largest (or smallest) id, rows without id come last, and the least row
    number decides among equal ids.
    """
    if not len(entries):
        return entries
    order = np.argsort(entries["d0"], kind="stable")
    e = entries[order]
    same_lead = e["d0"][1:] == e["d0"][:-1]
    if any((same_lead & (e[c][1:] != e[c][:-1])).any() for c in _IDENTITY[1:]):  # different texts with equal leading words: rare
        e = e[np.lexsort([e[c] for c in reversed(_IDENTITY)])]
    new = np.ones(len(e), dtype=bool)
    new[1:] = np.logical_or.reduce([e[c][1:] != e[c][:-1] for c in _IDENTITY])
    if new.all():
        return e
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rank = ~e["id"] if largest else e["id"]
    best = np.lexsort([e["row"], rank, 1 - e["has"], group])[starts]  # the first of each group
    out = e[best].copy()
    out["n"] = np.add.reduceat(e["n"], starts)
    return out


def _slices(run: np.ndarray, at: int, shift: int, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a run, and the partitions that they go to from partition ``at``: its number with ``bits`` bits above ``shift`` those of the digest."""
    if not len(run):
        return
    digit = (run["d0"] >> np.uint64(64 - shift - bits)) & np.uint64((1 << bits) - 1)
    cuts = np.flatnonzero(np.diff(digit, prepend=digit[0] + np.uint64(1)))
    for a, b in zip(cuts, [*cuts[1:], len(run)], strict=True):
        yield int(digit[a]), run[a:b]


def _frames(run: np.ndarray, name: Callable[[int], int], at: int, shift: int, bits: int) -> Iterator[pa.RecordBatch]:
    targets, parts = [], []
    for digit, part in _slices(run, at, shift, bits):
        for i in range(0, len(part), FRAME):
            targets.append(name(digit))
            parts.append(part[i : i + FRAME].tobytes())
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(targets, pa.int32()), pa.array(parts, pa.binary())], names=["target", "entries"])


def _replaced(at: int, digit: int, total: int, shift: int, bits: int) -> int:
    """Number ``at`` of ``total`` bits with the ``bits`` bits behind its leading ``shift`` bits replaced."""
    low = total - shift - bits
    return (at & ~(((1 << bits) - 1) << low)) | (digit << low)


def _first_runs(largest: bool, total: int, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() % (1 << total)
        held: list[np.ndarray] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            whole = merged(np.concatenate(held), largest)
            yield from _frames(whole, lambda d: _replaced(at, d, total, 0, bits), at, 0, bits)

        for batch in batches:
            e = np.zeros(batch.num_rows, dtype=_ENTRY)
            digests = batch.column("digest").cast(pa.binary()).to_pylist()
            words = np.frombuffer(b"".join(digests), dtype=">u8").reshape(-1, 4)
            for i in range(4):
                e[f"d{i}"] = words[:, i]
            ids = batch.column("doc_id")
            e["has"], e["id"] = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            e["size"], e["row"], e["n"] = batch.column("size").to_numpy(), batch.column("row").to_numpy(), 1
            held.append(merged(e[np.argsort(e["d0"], kind="stable")], largest))
            size += len(held[-1])
            if size > ENTRIES:  # a very large part is sent on as several runs
                yield from sent()
                held, size = [], 0
        if held:
            yield from sent()

    return run


def _round(largest: bool, total: int, shift: int, bits: int) -> Callable:
    """Merge what partitions got; slices go on by ``bits`` bits behind the leading ``shift``, or all stay if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for target, raw in zip(batch.column("target").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                got.setdefault(target, []).append(np.frombuffer(raw, dtype=_ENTRY))
        for at in sorted(got):
            run_ = merged(np.concatenate(got.pop(at)), largest)
            if bits:
                yield from _frames(run_, lambda d, at=at: _replaced(at, d, total, shift, bits), at, shift, bits)
            else:
                yield from _frames(run_, lambda d, at=at: at, at, 0, 0)

    return run


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries that stand for more than one row, as columns."""
    for batch in batches:
        for raw in batch.column("entries").to_pylist():
            e = np.frombuffer(raw, dtype=_ENTRY)
            e = e[e["n"] > 1]
            if len(e):
                words = np.empty((len(e), 4), dtype=">u8")
                for i in range(4):
                    words[:, i] = e[f"d{i}"]
                digests = words.tobytes()
                ids = pa.array(e["id"].astype(np.int64), mask=e["has"] == 0)
                columns = [pa.array([digests[i : i + 32] for i in range(0, len(digests), 32)], pa.binary()), pa.array(e["size"].astype(np.int64)), ids, pa.array(e["row"].astype(np.int64)), pa.array(e["n"].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "size", "keep_id", "keep_row", "group_size"])


def digit_plan(n: int, partitions: int) -> list[int]:
    """Bits of a partition's number that each round decides: two rounds at least, of ``ROUND_BITS`` bits at most."""
    total = max(2, (max(1, partitions) - 1).bit_length(), (max(1, -(-n // ENTRIES)) - 1).bit_length())
    rounds = max(2, -(-total // ROUND_BITS))
    return [total // rounds + (i < total % rounds) for i in range(rounds)]


def tree_merge(digests: DataFrame, n: int, largest: bool = True) -> DataFrame:
    """``digest, size, keep_id, keep_row, group_size`` of the texts that several rows have, from ``digest, size, doc_id, row``."""
    bits = digit_plan(n, int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = sum(bits)
    frames = digests.select("digest", "size", "doc_id", "row").mapInArrow(_first_runs(largest, total, bits[0]), _FRAMES)
    for i in range(len(bits)):
        shift = sum(bits[: i + 1])
        following = bits[i + 1] if i + 1 < len(bits) else 0
        frames = frames.repartitionById(1 << total, F.col("target")).mapInArrow(_round(largest, total, shift, following), _FRAMES)
    return frames.mapInArrow(_copies, "digest binary, size long, keep_id long, keep_row long, group_size long")


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold_case: bool = True, keep: str = "largest") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row for each row of ``docs``, rows that go included.

    Texts are equal if they are identical, with ``fold_case`` after lower-casing A-Z; a null text counts as empty. Of equal
    texts the row with the ``largest`` or ``smallest`` id stays. Ids are integers; rows without one stay only if no copy
    has one, and of rows with equal ids and texts exactly one stays. Empty tables give none. Other columns don't matter.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    text = normalised(F.col(text_col), fold_case)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "digests")  # the row numbers have to be the same at each reading
    n = rows.count()
    groups = stored(tree_merge(rows, n, keep == "largest"), "copies")
    hot = F.col("group_size") > n // HOT_SHARE
    by = ["digest", "size"]
    near = rows.join(F.broadcast(groups.where(hot)), by, "left")
    found = ["doc_id", "row", "digest", "keep_id", "keep_row", "group_size"]
    far = near.where(F.col("keep_row").isNull()).select("doc_id", "row", *by).join(groups.where(~hot), by, "left")
    joined = near.where(F.col("keep_row").isNotNull()).select(*found).unionByName(far.select(*found))
    alone = F.col("keep_row").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
