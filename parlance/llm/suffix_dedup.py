"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Every ``length``-byte window of a text is represented by an anchor: of the k-grams inside the window, the one with the
least hash (the leftmost of equals). Equal windows have equal anchors at equal offsets, so it is enough to sort the
suffixes that start at anchors, each with the bytes before it as far as its windows reach. Anchors whose k-gram occurs
only once are dropped first. Each task sorts its suffixes into a run for every bucket of k-grams, writes a run
front-coded (common prefix with the suffix before, then the rest), and collapses equal contexts. A bucket's runs are
combined by a loser tree that carries the prefix length each head is known to share with the last output and compares
bytes only beyond it. Among neighbours that share the k-gram, the lengths shared to the right (from the merge) and to
the left decide for each window whether it also starts elsewhere.

A k-gram of very many anchors would make one task's group grow with the corpus. Windows of different offsets from the
anchor never equal each other, so the contexts of such a k-gram are split by offset and window: each context, collapsed
within its task, gives the hashes of its windows, which Spark counts like any other key.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import U64, giving_back, keyed, map_docs, mix, powers, stored, texts_of, with_decisions

#: Bytes of a k-gram.
GRAM = 64
#: Bytes of text hashed at once, and contexts gathered before a task writes its runs.
STRETCH, RUN_BYTES = 1 << 20, 24 << 20
#: Anchors of a k-gram beyond which its contexts are split by window: as many contexts, of 336 bytes at most, take about
#: 22 MB, which a task can hold, and ten more for comparing them.
HOT_ANCHORS = 1 << 16
#: Anchors of a bucket of runs, on average at most.
BUCKET_ANCHORS = 200_000
#: Rows of a frame that a task sends on.
FRAME_ROWS = 4096


def _gram_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum((codes.astype(U64) + U64(1)) * up[:-1], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: len(codes) - width + 1])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(values) - width + 1
    rest = -len(values) % width
    padded = np.concatenate([values, np.full(rest, np.iinfo(U64).max, dtype=U64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _stretches(raws: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Bytes to hash at once; for its places the text and the offset in it. Long texts come in overlapping parts."""
    parts: list[bytes] = []
    meta: list[tuple[int, int, int]] = []
    size = 0

    def flush():
        n = np.array([m[2] for m in meta])
        begin = np.cumsum(n) - n
        doc = np.repeat(np.array([m[0] for m in meta]), n)
        offset = np.arange(int(n.sum())) - np.repeat(begin, n) + np.repeat(np.array([m[1] for m in meta]), n)
        return b"".join(parts), doc, offset

    for d, raw in enumerate(raws):
        for at in range(0, max(1, len(raw) - length + 1), STRETCH):
            part = raw[at : at + STRETCH + length - 1]
            if len(part) < length:
                continue
            if parts and size + len(part) > STRETCH:
                yield flush()
                parts, meta, size = [], [], 0
            parts.append(part)
            meta.append((d, at, len(part)))
            size += len(part)
    if parts:
        yield flush()


def anchors_of(raws: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of (text, k-gram hash, anchor offset, first window, last window): windows run between the last two."""
    span = length - GRAM + 1
    for joined, doc, offset in _stretches(raws, length):
        codes = np.frombuffer(joined, dtype=np.uint8)
        grams = _gram_hashes(codes, GRAM)
        packed = (grams & U64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=U64)
        low = (_sliding_min(packed, span) & U64(0xFFFFFF)).astype(np.int64)
        start = np.arange(len(low))
        valid = (doc[start] == doc[start + length - 1]) & (offset[start] + length - 1 == offset[start + length - 1])
        start, low = start[valid], low[valid]
        if not len(start):
            continue
        new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (start[1:] != start[:-1] + 1)]))
        last = np.append(new[1:], len(start)) - 1
        at = low[new]
        yield doc[start[new]], grams[at], offset[at], offset[start[new]], offset[start[last]]


def _anchor_hashes(length: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raws = [(t or "").encode() for t in texts_of(batch)]
            hashes: list[list[np.ndarray]] = [[] for _ in raws]
            for doc, h, *_ in anchors_of(raws, length):
                cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                for d, part in zip(doc[cuts].tolist(), np.split(h, cuts[1:]), strict=True):
                    hashes[d].append(part)
            out = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in hashes]
            yield pd.DataFrame({"row_key": batch["row_key"], "doc_id": batch["doc_id"], "hashes": out})

    return run


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes already."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(entries: list[tuple[bytes, bytes, int]]) -> bytes:
    """Sorted (suffix, left context, flags) entries; each as prefix length shared with the one before, and the rest."""
    out, before = [struct.pack("<I", len(entries))], b""
    for suffix, left, flags in entries:
        k = common_prefix(before, suffix)
        out += struct.pack("<BBBI", k, len(suffix) - k, len(left), flags), suffix[k:], left
        before = suffix
    return b"".join(out)


def front_decode(raw: bytes) -> Iterator[tuple[int, bytes, bytes, int]]:
    """(prefix shared with the entry before, suffix, left context, flags)."""
    (n,), at, before = struct.unpack_from("<I", raw), 4, b""
    for _ in range(n):
        k, rest, left, flags = struct.unpack_from("<BBBI", raw, at)
        at += 7
        before = before[:k] + raw[at : at + rest]
        at += rest
        yield k, before, raw[at : at + left], flags
        at += left


def merge_runs(runs: list[bytes]) -> Iterator[tuple[int, bytes, bytes, int, int, int]]:
    """Loser tree over front-coded runs: (prefix shared with the last output, suffix, left, flags, run, entry number).

    Every head knows how much it shares with the last output. Of two heads the one that shares more is the smaller;
    only heads that share equally much are compared, and only from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    readers = [front_decode(r) for r in runs]
    heads: list[tuple | None] = [next(r, None) for r in readers] + [None] * (k - len(runs))
    shared = [0] * k
    place = [0] * k
    losers = [-1] * k

    def beats(a: int, b: int) -> bool:
        """Whether head a comes before head b. The loser's shared length becomes that with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        p = common_prefix(x[1], y[1], shared[a])
        if p == len(x[1]) or (p < len(y[1]) and x[1][p] < y[1][p]):
            shared[b] = p
            return True
        shared[a] = p
        return False

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        won = beats(a, b)
        losers[node] = b if won else a
        return a if won else b

    winner = build(1) if k > 1 else 0
    while heads[winner] is not None:
        _, suffix, left, flags = heads[winner]
        yield shared[winner], suffix, left, flags, winner, place[winner]
        place[winner] += 1
        heads[winner] = after = next(readers[winner], None)
        shared[winner] = after[0] if after else 0  # with the entry before in the run, which was the last output
        node = (winner + k) // 2
        while node >= 1:
            other = losers[node]
            if not beats(winner, other):
                losers[node], winner = winner, other
            node //= 2


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def repeated_offsets(group: list[tuple[int, bytes, bytes, int, int]], length: int) -> list[list[tuple[int, int]]]:
    """For each entry of a group (shared, suffix, left, first offset, last offset, copies) its repeated offsets.

    A window at offset d takes d bytes to the left of the anchor and ``length`` - d from it on. It is repeated if another
    entry shares both, or if the entry itself stands for several places.
    """
    m = len(group)
    found: list[list[tuple[int, int]]] = [[(e[3], e[4])] if e[5] > 1 else [] for e in group]
    if m <= 8:
        for i in range(m):
            right = length
            for j in range(i + 1, m):
                right = min(right, group[j][0])
                a, b = group[i], group[j]
                left = common_prefix(a[2][::-1], b[2][::-1])
                lo, hi = max(length - right, a[3], b[3]), min(left, a[4], b[4])
                if lo <= hi:
                    found[i].append((lo, hi))
                    found[j].append((lo, hi))
        return [_union(x) for x in found]
    reach = max(e[4] for e in group)
    backward = np.zeros((m, reach), dtype=np.uint8)
    for i, e in enumerate(group):
        backward[i, : len(e[2])] = np.frombuffer(e[2][::-1], dtype=np.uint8)
    lo, hi, copies = (np.array([e[c] for e in group]) for c in (3, 4, 5))
    right = np.array([e[0] for e in group])
    sums = np.zeros(m, dtype=U64)
    repeated = np.zeros((m, reach + 2), dtype=bool)
    up, _ = powers(reach + 1)
    for d in range(reach + 1):
        if d:
            sums = sums + (backward[:, d - 1].astype(U64) + U64(1)) * up[d]
        own = np.flatnonzero((lo <= d) & (d <= hi) & (copies == 1))
        valid = (lo <= d) & (d <= hi)
        if not len(own) or valid.sum() < 2:
            continue
        stairs = np.cumsum(right < length - d).astype(U64)  # entries of one stair share length - d bytes to the right
        key = mix(mix(sums) + stairs)
        _, inverse, counts = np.unique(key[valid], return_inverse=True, return_counts=True)
        repeated[np.flatnonzero(valid)[counts[inverse] > 1], d] = True
    for i in range(m):
        edges = np.flatnonzero(np.diff(repeated[i].astype(np.int8), prepend=0))
        found[i] += [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return [_union(x) for x in found]


#: Stands for the bucket of the contexts that are split by window.
HOT = -1


def window_hashes(suffix: bytes, left: bytes, low: int, length: int) -> list[bytes]:
    """128-bit hashes of a context's windows with their offset, from offset ``low`` to the length of ``left``."""
    whole, anchor = left + suffix, len(left)
    return [xxhash.xxh3_128_digest(whole[anchor - d : anchor - d + length], seed=d) for d in range(low, anchor + 1)]


def _runs(length: int, buckets: int) -> Callable:
    """Sort a task's candidate suffixes into runs.

    Rows: a run (bucket, payload), a place (entry of a run, text, anchor), or the windows of an entry of a hot k-gram
    (entry, least offset as anchor, windows; bucket -1 if the entry stands for several places, else -2).
    """

    def rows(contexts: dict) -> Iterator[tuple]:
        """(doc_id, row_key, run, bucket, payload, entry, anchor, windows) of all runs of these contexts."""
        name = uuid.uuid4().hex
        by_bucket: dict[int, list] = {}
        for (suffix, left, low), (bucket, places) in contexts.items():
            by_bucket.setdefault(bucket, []).append((suffix, left, low, places))
        for bucket, entries in by_bucket.items():
            run = f"{name}-{bucket}"
            if bucket == HOT:
                for i, (suffix, left, low, places) in enumerate(entries):
                    yield None, None, run, -1 if len(places) > 1 else -2, None, i, low, window_hashes(suffix, left, low, length)
            else:
                entries.sort(key=lambda e: e[0])
                yield None, None, run, bucket, front_code([(s, left, low << 1 | (len(places) > 1)) for s, left, low, places in entries]), None, None, None
            for i, e in enumerate(entries):
                for doc_id, key, at in e[3]:
                    yield doc_id, key, run, None, None, i, at, None

    def flush(contexts: dict) -> Iterator[pd.DataFrame]:
        todo = rows(contexts)
        while part := list(itertools.islice(todo, FRAME_ROWS)):
            doc_id, key, run, bucket, payload, entry, anchor, windows = zip(*part, strict=True)
            whole = lambda x: pd.array(x, dtype="Int64")
            yield pd.DataFrame({"doc_id": doc_id, "row_key": whole(key), "run": run, "bucket": whole(bucket), "payload": payload, "entry": whole(entry), "anchor": whole(anchor), "windows": windows})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        contexts: dict = {}
        size = 0
        for batch in batches:
            texts, ids, keys = texts_of(batch), batch["doc_id"].tolist(), batch["row_key"].tolist()
            wanted = [np.sort(np.asarray(w, dtype=np.int64).view(U64)) for w in batch["wanted"]]
            hot = [{int(h) for h in np.asarray(w, dtype=np.int64).view(U64)} for w in batch["hot"]]
            for first in range(0, len(texts), 200):
                raws = [(t or "").encode() for t in texts[first : first + 200]]
                for arrays in anchors_of(raws, length):
                    for d, h, at, s0, s1 in zip(*(x.tolist() for x in arrays), strict=True):
                        own = wanted[first + d]
                        k = int(np.searchsorted(own, U64(h)))
                        if k == len(own) or int(own[k]) != h:
                            continue
                        raw = raws[d]
                        key = raw[at : at + length - at + s1], raw[s0:at], at - s1
                        held = contexts.get(key)
                        if held is None:
                            contexts[key] = held = (HOT if h in hot[first + d] else h % buckets, [])
                            size += len(key[0]) + len(key[1]) + (200 if held[0] != HOT else 16 * length)
                        held[1].append((ids[first + d], keys[first + d], at))
                        size += 50
                if size > RUN_BYTES:
                    yield from flush(contexts)
                    contexts, size = {}, 0
        yield from flush(contexts)

    return run


def _merged(length: int) -> Callable:
    """Merge all runs of a bucket; emit the repeated offsets of entries that have any."""

    def verdicts(names: list[str], payloads: list[bytes]) -> pd.DataFrame:
        out, group, who = [], [], []

        def done() -> None:
            if len(group) > 1 or group[0][5] > 1:
                for (run, entry), spans in zip(who, repeated_offsets(group, length), strict=True):
                    if spans:
                        out.append((names[run], entry, [x for s in spans for x in s]))

        for shared, suffix, left, flags, run, entry in merge_runs(payloads):
            if group and shared < GRAM:
                done()
                group, who = [], []
            group.append((shared if group else 0, suffix, left, flags >> 1, len(left), 1 + (flags & 1)))
            who.append((run, entry))
        if group:
            done()
        return pd.DataFrame(out, columns=["run", "entry", "offsets"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, names, payloads = None, [], []
        for batch in batches:
            for b, name, payload in zip(batch["bucket"], batch["run"], batch["payload"], strict=True):
                if b != bucket and names:
                    yield verdicts(names, payloads)
                    names, payloads = [], []
                bucket = b
                names.append(name)
                payloads.append(payload)
        if names:
            yield verdicts(names, payloads)

    return run


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows, texts = [], []
        for text, spans in zip(texts_of(batch), batch["spans"], strict=True):
            raw = (text or "").encode()
            gone = _union([(int(s["first"]), int(s["last"]) - 1) for s in spans]) if spans is not None else []
            kept, at = [], 0
            for a, b in gone:
                kept.append(raw[at:a])
                at = b + 1
            rest = b"".join([*kept, raw[at:]]) if gone else raw
            rows.append((len(raw), len(raw) - len(rest), len(gone), hashlib.sha256(rest).hexdigest()))
            texts.append(rest)
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
        yield out.assign(doc_id=batch["doc_id"].to_numpy(), kept=texts)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, hot_anchors: int = HOT_ANCHORS) -> DataFrame:
    """``doc_id, kept, n_bytes, n_removed, n_spans, kept_sha256``: each text without the bytes that are repeated.

    A byte goes if a ``length``-byte string over it also starts anywhere else; all copies go. ``kept`` is binary, as a
    cut may fall inside a character. Null texts count as empty; texts shorter than ``length`` stay; a repeated row is a
    copy like any other. Extra columns are ignored; no rows give no rows. ``length`` is 65 to 255. ``hot_anchors`` decides how k-grams are split over tasks, never what goes.
    """
    if not GRAM < length <= 255:
        raise ValueError(f"length has to be {GRAM + 1} to 255")
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    hashes = stored(map_docs(rows, _anchor_hashes(length), "row_key long, hashes array<long>"), "anchors")
    each = hashes.select("row_key", "doc_id", F.explode("hashes").alias("h"))
    twice = stored(each.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("h", "n", (F.col("n") > hot_anchors).alias("is_hot")), "repeated-grams")
    wanted = each.join(twice.drop("n"), "h").groupBy("row_key", "doc_id").agg(F.collect_set("h").alias("wanted"), F.collect_set(F.when(F.col("is_hot"), F.col("h"))).alias("hot"))
    anchors = twice.where(~F.col("is_hot")).agg(F.sum("n")).first()[0] or 0
    buckets = max(8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-anchors // BUCKET_ANCHORS))
    candidates = with_decisions(rows, wanted, "inner")
    columns = "row_key long, run string, bucket long, payload binary, entry long, anchor long, windows array<binary>"
    both = stored(map_docs(candidates, _runs(length, buckets), columns), "suffix-runs")
    runs = both.where(F.col("bucket") >= 0).select("bucket", "run", "payload")
    runs = runs.repartition("bucket").sortWithinPartitions("bucket", "run")
    verdicts = stored(runs.mapInPandas(giving_back(_merged(length)), "run string, entry long, offsets array<int>"), "verdicts")
    windows = both.where(F.col("bucket") < 0).select("run", "entry", F.when(F.col("bucket") == -1, 2).otherwise(1).alias("copies"), "anchor", F.posexplode("windows").alias("nth", "window"))
    repeated = windows.groupBy("window").agg(F.sum("copies").alias("n")).where(F.col("n") > 1).select("window")
    offset = (F.col("anchor") + F.col("nth")).cast("int")
    split = windows.join(repeated, "window", "left_semi").groupBy("run", "entry").agg(F.flatten(F.collect_list(F.array(offset, offset))).alias("offsets"))
    places = both.where(F.col("bucket").isNull()).select("run", "entry", "doc_id", "row_key", "anchor")
    hit = places.join(stored(verdicts.unionByName(split), "all-verdicts"), ["run", "entry"])
    # Offsets come in pairs (least, most): their windows cover anchor - most to anchor - least + length.
    pairs = F.transform(F.sequence(F.lit(0), F.size("offsets") - 2, F.lit(2)), lambda i: F.struct((F.col("anchor") - F.col("offsets")[i + 1]).alias("first"), (F.col("anchor") - F.col("offsets")[i] + length).alias("last")))
    spans = hit.select("row_key", "doc_id", F.explode(pairs).alias("span")).groupBy("row_key", "doc_id").agg(F.collect_set("span").alias("spans"))
    joined = with_decisions(rows, spans).select("doc_id", "text", "spans")
    return map_docs(joined, _removed, "kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
