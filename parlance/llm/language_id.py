"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into longest matches against
each automaton; the language that needs the fewest phrases per character wins. Parsing needs only the automaton's
forward transitions, so many stretches of text are walked side by side with array operations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import bounded_sample, chunks, turn_to

#: Labelled rows drawn for each language, and characters of them that go into its automaton.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 40_000
#: Letters that have a column in the dense table of transitions; those of all others are looked up in a sorted list.
LETTERS = 62
#: Letters that are parsed on their own, so that stretches of one text can be walked side by side; each cut adds at most
#: one phrase, the same for every language.
STRETCH = 1024


def transitions(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of ``codes``."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def suffix_automaton(codes: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the suffix automaton of ``codes`` (1..width-1): states x width, -1 where there is none."""
    nxt = transitions(codes)
    table = np.full((len(nxt), width), -1, dtype=np.int32)
    for state, out in enumerate(nxt):
        for c, to in out.items():
            table[state, c] = to
    return table


def letters_of(text: str) -> str:
    """Lower-case letters of a text, every run of other characters as one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class LanguageModel:
    """Automata of all languages in one transition table. State 0 is 'no transition'.

    Every letter of the texts has a code. The most common ones have a column of the table; the transitions of all others
    are in ``rare``, sorted by state and letter.
    """

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        counts: dict[str, int] = {}
        for t in texts.values():
            for c in t:
                counts[c] = counts.get(c, 0) + 1
        known = sorted((c for c in counts if c != " "), key=lambda c: (-counts[c], c))
        self.codes = {c: i + 2 for i, c in enumerate(known)}  # 0: unknown letter, 1: space
        self.letters, self.width = len(known) + 2, min(len(known), LETTERS) + 2
        tables, roots, rare, base = [np.zeros((1, self.width), np.int32)], [], [], 1
        for name in self.names:
            own = transitions(np.array([1 if c == " " else self.codes[c] for c in texts[name]], dtype=np.int64))
            table = np.zeros((len(own), self.width), np.int32)
            for state, out in enumerate(own):
                for c, to in out.items():
                    if c < self.width:
                        table[state, c] = base + to
                    else:
                        rare.append(((base + state) * self.letters + c, base + to))
            roots.append(base)
            tables.append(table)
            base += len(own)
        rare.sort()
        self.rare = np.array([k for k, _ in rare], dtype=np.int64)
        self.rare_to = np.array([to for _, to in rare], dtype=np.int32)
        self.table = np.concatenate(tables).ravel()
        self.roots = np.array(roots, dtype=np.int32)
        # After a failed step the phrase starts anew with this character, or at the root if no phrase begins with it.
        every = np.arange(self.letters, dtype=np.int32)
        first = self._step(np.repeat(self.roots[None, :], self.letters, axis=0), every)
        self.again = np.where(first > 0, first, self.roots[None, :]).astype(np.int32)

    def _step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after the characters ``c``, one for each row of ``state``; 0 where there is no transition."""
        if self.letters == self.width:
            return self.table[state * self.width + c[:, None]]
        step = self.table[state * self.width + np.where(c < self.width, c, 0)[:, None]]
        rows = np.flatnonzero(c >= self.width)
        if len(rows):
            keys = state[rows].astype(np.int64) * self.letters + c[rows, None]
            at = np.minimum(np.searchsorted(self.rare, keys), len(self.rare) - 1)
            step[rows] = np.where(self.rare[at] == keys, self.rare_to[at], 0)
        return step

    def classes(self, text: str) -> np.ndarray:
        """Character classes of a text: letters by their code, runs of other characters as one space."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        distinct, inverse = np.unique(points, return_inverse=True)
        kind = np.fromiter((self.codes.get(c, 0) if (c := chr(p)).isalpha() else 1 for p in distinct), np.min_scalar_type(self.letters), len(distinct))
        out = kind[inverse]
        return out[~((out == 1) & (np.concatenate([[1], out[:-1]]) == 1))] if len(out) else out

    def phrases(self, parts: list[np.ndarray]) -> np.ndarray:
        """Phrases needed for each part by each language."""
        if not parts or not self.names:
            return np.zeros((len(parts), len(self.names)))
        flat = np.concatenate(parts)
        sizes = np.array([len(p) for p in parts])
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(parts)), -(-sizes // STRETCH))
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(-(-sizes // STRETCH)) - -(-sizes // STRETCH), -(-sizes // STRETCH))
        at = begin[owner] + nth * STRETCH
        length = np.minimum(STRETCH, begin[owner] + sizes[owner] - at)
        order = np.argsort(-length, kind="stable")
        owner, at, length = owner[order], at[order], length[order]
        state = np.repeat(self.roots[None, :], len(at), axis=0)
        count = np.ones(state.shape, dtype=np.int32)
        alive = len(at)
        for t in range(int(length[0]) if len(length) else 0):
            while length[alive - 1] <= t:
                alive -= 1
            c = flat[at[:alive] + t].astype(np.int32)
            step = self._step(state[:alive], c)
            failed = step == 0
            count[:alive] += failed
            state[:alive] = np.where(failed, self.again[c], step)
        out = np.zeros((len(parts), len(self.names)))
        np.add.at(out, owner, count)
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        parts = [self.classes(t) for t in texts]
        has = [any(c.isalpha() for c in t) if len(p) and p.max() <= 1 else bool(len(p)) for t, p in zip(texts, parts, strict=True)]
        cost = self.phrases(parts) / np.maximum(1, np.array([len(p) for p in parts]))[:, None]
        out = []
        for ok, row in zip(has, cost, strict=True):
            if not ok or not self.names:
                out.append(("und", 0.0))
                continue
            best = int(np.argmin(row))
            second = min((x for i, x in enumerate(row) if i != best), default=None)
            out.append((self.names[best], 1.0 if second is None else float(min(1.0, max(0.0, 1 - row[best] / second)))))
        return out


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> LanguageModel:
    """Learn from ``rows`` labelled rows of each language, up to ``chars`` letters; null labels or texts teach nothing.

    Repeated rows teach again, within the bound. A table without labelled rows gives a model that knows no language. Extra
    columns are ignored.

    The model's size is at most languages x 2 x ``chars`` x 64 numbers of four bytes, and languages x 3 x ``chars``
    transitions of twelve bytes for letters without a column.
    """
    known = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = bounded_sample(known, rows, F.struct("doc_id", "text"), "lang").withColumn("place", F.xxhash64("doc_id", "text"))

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        out, size = [], 0
        for text in pdf.sort_values(["place", "text"])["text"]:
            out.append(letters_of(text)[: chars - size])
            size += len(out[-1]) + 1
            if size >= chars:
                break
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "text": [" ".join(out)]})

    return LanguageModel({r["lang"]: r["text"] for r in sample.groupBy("lang").applyInPandas(gather, "lang string, text string").collect()})


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every whole text.

    ``und`` with score 0 for null texts and texts without a letter, or if the model knows no language. The score is one
    less the ratio of the best to the second best rate; ties go to the first name in order. Repeated rows each get their
    row; no rows give no rows; extra columns are ignored.
    """
    found = language_column(docs.sparkSession, model)(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), found.alias("found"))
    return rows.select("doc_id", "found.lang_pred", "found.score")


def language_column(spark: SparkSession, model: LanguageModel) -> Callable[[Column], Column]:
    """The prediction as a Column function, for frames whose other columns are to stay."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        turn_to(__name__)
        plain = [t if isinstance(t, str) else "" for t in texts]
        found = [x for first, last, _ in chunks(plain, 4 << 20) for x in shared.value.predict(plain[first:last])]
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    # Else a filter on the prediction makes the optimiser predict once for the filter and once for the result.
    return predict.asNondeterministic()


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of an id as text, modulo ``of``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))
