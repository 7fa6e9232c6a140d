"""Benchmark decontamination by winnowing.

Of every ``window`` consecutive words the minimum ``K``-gram hash is a fingerprint, so a shared span of ``window`` words
always shares one. The fingerprints of the benchmark are a table made in tasks. Document fingerprints are joined with
it: while the table is small, as counted, by a lookup in each task; beyond that bound by an exchange of both sides.
Fingerprints that meet are extended to the windows they stand for, and these are joined word by word with the windows of
the items. Neither documents nor items pass the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import U64, chunks, keyed, map_docs, mix, prefix_hashes, span_hashes, stored, texts_of, with_decisions, words_of

#: Benchmark fingerprints that are sent to all executors, at 8 bytes each; more are joined by an exchange.
MOST_PRINTS = 1 << 20
K = 5

_CLASS = np.zeros(256, dtype=np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _CLASS[_b] = _b + 32 if 0x41 <= _b <= 0x5A else _b
_TABLE = bytes(b if b else 0x20 for b in _CLASS)


def item_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lowered."""
    return (text or "").encode().translate(_TABLE).split()


def _grams(prefix: np.ndarray, n: int, width: int) -> np.ndarray:
    at = np.arange(max(0, n - width + 1))
    return span_hashes(prefix, at, at + width)


def _minima(grams: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` consecutive grams."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = grams[:n].copy()
    for k in range(1, span):
        np.minimum(out, grams[k : k + n], out=out)
    return out


def prints_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """The fingerprint of each window of ``width`` words: its minimum ``K``-gram hash; of shorter windows their hash."""
    k = min(K, width)
    low = _minima(_grams(prefix_hashes(hashes), len(hashes), k), width - k + 1)
    return mix(low + U64(width))  # windows of different widths never meet


def _windows(window: int) -> Callable:
    """A row for each window of each item; an item of fewer words than ``window`` is one window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text in zip(batch["item_id"], texts_of(batch), strict=True):
                words = item_words(text)
                if not words:
                    continue
                width = min(window, len(words))
                prints = prints_of(words_of([b" ".join(words)], _CLASS)[0], width)
                yield pd.DataFrame({"item_id": item, "width": width, "print": prints.view(np.int64), "words": [b" ".join(words[i : i + width]) for i in range(len(prints))]})

    return run


def _document_prints(widths: list[int]) -> Callable:
    """The distinct fingerprints of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for _, _, raws in chunks(texts_of(batch)):
                hashes, bounds = words_of(raws, _CLASS)
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    own = [prints_of(hashes[a:b], w) for w in widths if b - a >= w]
                    out.append(np.unique(np.concatenate(own)).view(np.int64) if own else np.zeros(0, np.int64))
            yield pd.DataFrame({"row_key": batch["row_key"], "doc_id": batch["doc_id"], "prints": out})

    return run


def _found(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(values):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _extended(widths: list[int], lookup) -> Callable:
    """The number of words of each text, and the windows whose fingerprint is wanted: first word, width, words.

    The wanted fingerprints are those of ``lookup``, a broadcast sorted array, or else those in the row's ``wanted``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n_words, hits = [], []
            wanted = None if lookup else batch["wanted"].tolist()
            for first, _, raws in chunks(texts_of(batch)):
                hashes, bounds = words_of(raws, _CLASS)
                n_words += np.diff(bounds).tolist()
                found: list[list[tuple[int, int]]] = [[] for _ in raws]
                for width in widths:
                    prints = prints_of(hashes, width)
                    if lookup:
                        at = np.flatnonzero(_found(prints, lookup.value))
                    else:
                        own = [np.flatnonzero(np.isin(prints[a:b].view(np.int64), w)) + a for a, b, w in zip(bounds[:-1], bounds[1:], wanted[first : first + len(raws)], strict=True) if w is not None and len(w)]
                        at = np.concatenate(own) if own else np.zeros(0, np.int64)
                    docs = np.searchsorted(bounds, at, side="right") - 1
                    inside = at + width <= bounds[docs + 1]
                    for d, i in zip(docs[inside].tolist(), at[inside].tolist(), strict=True):
                        found[d].append((i - int(bounds[d]), width))
                for raw, own in zip(raws, found, strict=True):
                    words = raw.translate(_TABLE).split() if own else []
                    hits.append([{"first": i, "width": w, "words": b" ".join(words[i : i + w])} for i, w in own])
            yield pd.DataFrame({"row_key": batch["row_key"], "doc_id": batch["doc_id"], "n_words": n_words, "hits": hits})

    return run


def covered(spans: Column) -> Column:
    """Words covered by spans (first, width) in order of their first word."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = s["first"] + s["width"]
        return F.struct((acc["n"] + F.greatest(end - F.greatest(s["first"], acc["end"]), F.lit(0))).alias("n"), F.greatest(end, acc["end"]).alias("end"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, most_prints: int = MOST_PRINTS) -> DataFrame:
    """``doc_id, n_words, n_hit, items, n_items, items_sha256, contaminated`` for every document.

    A document word is hit if it lies in an occurrence of a benchmark window. Null and empty texts have no words and no
    hits. Items without words or without an id are left out; items of one id count once. Repeated rows each get their
    row; extra columns are ignored; an empty table on either side gives no rows or no hits. ``most_prints`` decides how
    the fingerprints are joined, never what is found.
    """
    if window < K:
        raise ValueError(f"a window takes {K} words at least")
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    tests = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text")).where(F.col("item_id").isNotNull())
    windows = stored(tests.mapInPandas(_windows(window), "item_id string, width int, print long, words binary"), "item-windows")
    prints = stored(windows.select("width", "print").distinct(), "item-prints")
    counts = {r["width"]: r["count"] for r in prints.groupBy("width").count().collect()}  # ``window`` rows at most
    widths = sorted(counts)
    extended = "row_key long, n_words long, hits array<struct<first:long,width:int,words:binary>>"
    if sum(counts.values()) <= most_prints:
        few = np.sort(prints.select("print").toArrow().column("print").to_numpy().astype(np.int64).view(U64))
        found = map_docs(rows, _extended(widths, spark.sparkContext.broadcast(few)), extended)
    else:
        each = map_docs(rows, _document_prints(widths), "row_key long, prints array<long>").select("row_key", "doc_id", F.explode("prints").alias("print"))
        wanted = each.join(prints.select("print"), "print", "left_semi").groupBy("row_key", "doc_id").agg(F.collect_set("print").alias("wanted"))
        found = map_docs(with_decisions(rows, wanted).select("row_key", "doc_id", "text", "wanted"), _extended(widths, None), extended)
    found = stored(found, "extended-hits")
    hits = found.where(F.size("hits") > 0).dropDuplicates(["row_key", "doc_id"]).select("row_key", "doc_id", F.explode("hits").alias("hit"))
    hits = hits.select("row_key", "doc_id", F.col("hit.first").alias("first"), F.col("hit.width").alias("width"), F.col("hit.words").alias("words"))
    # Places need to know that some item has their words, items that some place has: the two are never multiplied.
    met = hits.join(windows.select("words").distinct(), "words", "left_semi")
    spans = met.groupBy("row_key", "doc_id").agg(F.array_sort(F.collect_set(F.struct("first", "width"))).alias("spans"))
    named = hits.select("row_key", "doc_id", "words").distinct().join(windows.select("words", "item_id").distinct(), "words")
    items = named.groupBy("row_key", "doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    per_row = with_decisions(spans, items).select("row_key", "doc_id", "spans", "items")
    none = F.array().cast("array<string>")
    out = with_decisions(found.select("row_key", "doc_id", "n_words"), per_row).withColumn("items", F.coalesce("items", none))
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0).cast("long"))
    out = out.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)
