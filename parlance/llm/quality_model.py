"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted feature by feature in cycles, and each tree's steps are added to the feature's lookup table;
then the pairs of features that explain most of what is left get tables of their own the same way. A document is scored
by looking up its bins and adding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import bounded_sample, chunks, map_docs, texts_of

#: Labelled rows that the model is fitted on.
SAMPLE_ROWS = 10_000
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 32, 8, 6, 150, 0.1

FEATURES = ("log_words", "word_length", "upper", "symbols", "exclamations", "digits", "lines", "stops", "distinct_words", "dup_lines", "top_word", "non_ascii")


def _class_tables() -> np.ndarray:
    """For each byte, membership of the byte classes that are counted."""
    kinds = [set(b" \t\n\x0b\x0c\r"), set(range(65, 91)), set(b"#*$%&|<>"), set(b"!"), set(range(48, 58)), set(b"\n"), set(b".,;:"), set(range(128, 192)), set(range(192, 256))]
    return np.array([[b in k for b in range(256)] for k in kinds], dtype=np.int64)


_CLASSES = _class_tables()


def features_of(raws: list[bytes]) -> np.ndarray:
    """Features of whole texts, one row each; empty texts have zeros."""
    counts = np.zeros((len(raws), len(_CLASSES)))
    words_of, extra = np.zeros(len(raws)), np.zeros((len(raws), 3))
    for i, raw in enumerate(raws):
        counts[i] = _CLASSES @ np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        words, lines = raw.split(), raw.split(b"\n")
        words_of[i] = len(words)
        if words:
            codes, sizes = {}, None
            ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
            sizes = np.bincount(ids)
            extra[i] = len(sizes) / len(words), 1 - len(set(lines)) / len(lines), sizes.max() / len(words)
    size = np.array([len(r) for r in raws]) - counts[:, 7]  # code points
    n, chars = np.maximum(1, words_of), np.maximum(1, size - counts[:, 0])
    return np.column_stack([
        np.log1p(words_of), (size - counts[:, 0]) / n, counts[:, 1] / chars, counts[:, 2] / n, counts[:, 3] / n, counts[:, 4] / chars,
        counts[:, 5] / n, counts[:, 6] / n, extra[:, 0], extra[:, 1], extra[:, 2], counts[:, 8] / chars,
    ])


def _steps(gradient: np.ndarray, weight: np.ndarray, leaves: int = 4, least: float = 5.0) -> np.ndarray:
    """A shallow regression tree over ordered bins: its value for each bin."""
    cuts = [0, len(gradient)]
    g, w = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1.0)
    while len(cuts) <= leaves:
        best = (1e-9, -1)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = np.arange(a + 1, b)
            at = at[(w[at] - w[a] >= least) & (w[b] - w[at] >= least)]
            if len(at):
                gains = gain(a, at) + gain(at, b) - gain(a, b)
                k = int(np.argmax(gains))
                best = max(best, (float(gains[k]), int(at[k])))
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(gradient))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1.0)
    return out


def _steps_2d(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of each axis into four quarters: gain and table."""
    best, table = 0.0, np.zeros_like(gradient)
    g, w = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (gradient, weight))
    n, m = gradient.shape
    for i in range(1, n):
        for j in range(1, m):
            gs = np.array([g[i, j], g[i, m] - g[i, j], g[n, j] - g[i, j], g[n, m] - g[i, m] - g[n, j] + g[i, j]])
            ws = np.array([w[i, j], w[i, m] - w[i, j], w[n, j] - w[i, j], w[n, m] - w[i, m] - w[n, j] + w[i, j]])
            gain = float((gs**2 / (ws + 1.0)).sum())
            if gain > best + 1e-12:
                values = gs / (ws + 1.0)
                best, table = gain, np.zeros_like(gradient)
                table[:i, :j], table[:i, j:], table[i:, :j], table[i:, j:] = values
    return best, table


@dataclass
class AdditiveModel:
    """Bin edges, a table for each feature, and (feature, feature, table) for each pair."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edge, x[:, k], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting on the log loss: features first, then the best pairs. Without rows every score is 0.5."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(len(FEATURES))]
    coarse = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(len(FEATURES))]
    rate = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(edges, coarse, float(np.log(rate / (1 - rate))), [np.zeros(len(e) + 1) for e in edges], [])
    if not len(x):
        return model
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    total = np.full(len(x), model.base)
    slope = lambda: (p := 1 / (1 + np.exp(-total)), y - p, p * (1 - p) + 1e-6)[1:]
    for _ in range(ROUNDS):
        for k, own in enumerate(bins):
            g, w = slope()
            n = len(model.tables[k])
            step = RATE * np.clip(_steps(np.bincount(own, g, n), np.bincount(own, w, n)), -4, 4)
            model.tables[k] += step
            total += step[own]
    cells = {}
    g, w = slope()
    for a, b in combinations(range(len(FEATURES)), 2):
        ia, ib = np.searchsorted(coarse[a], x[:, a], side="right"), np.searchsorted(coarse[b], x[:, b], side="right")
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cells[a, b] = ia * shape[1] + ib, shape
    sums = lambda k, v: np.bincount(cells[k][0], v, cells[k][1][0] * cells[k][1][1]).reshape(cells[k][1])
    chosen = sorted(cells, key=lambda k: (-_steps_2d(sums(k, g), sums(k, w))[0], k))[:PAIRS]
    tables = {k: np.zeros(cells[k][1]) for k in chosen}
    for _ in range(ROUNDS // 5):
        for k in chosen:
            g, w = slope()
            step = RATE * np.clip(_steps_2d(sums(k, g), sums(k, w))[1], -4, 4)
            tables[k] += step
            total += step.ravel()[cells[k][0]]
    model.pairs = [(a, b, tables[a, b]) for a, b in chosen]
    return model


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        parts = [features_of(raws) for _, _, raws in chunks(texts_of(batch))]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "features": [row for p in parts for row in p]})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on ``rows`` labelled rows at most, drawn over all labels; null labels or ids teach nothing.

    Of several labels of an id the largest counts; each document of that id teaches it. Labels without a document, and
    documents without a label, are left out. Without any, every score is one half. Extra columns are ignored.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    drawn = bounded_sample(known, rows, F.struct("doc_id", "label")).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = map_docs(texts.join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_semi"), _features, "features array<double>")
    data = found.join(drawn, "doc_id").orderBy("doc_id").select("features", "label").toPandas()  # bounded by rows
    x = np.array(data["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, (data["label"].to_numpy(dtype=float) > 0).astype(float))


def score_quality(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every whole text; a null text counts as empty.

    Equal texts have equal scores. Repeated rows each get their row; no rows give no rows; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [shared.value.score(features_of(raws)) for _, _, raws in chunks(texts_of(batch))]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": np.concatenate(parts) if parts else []})

    return map_docs(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, "score double")


def is_held_out(doc_id: Column) -> Column:
    """The fold that never teaches: crc32 of the id as text divisible by 5. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
