"""Packing of tokenised documents into fixed-length sequences: shortest-pack-first over the length histogram.

Documents are tokenised where they lie; only piece records (a few numbers each) move. A piece is a full sequence or
what is left of a document after its full sequences. The histogram of piece lengths, at most ``max_length`` numbers,
is packed on the driver into patterns with counts. Each pattern slot takes a range of ranks among the pieces of its
length, so pieces find their sequence by their rank, which comes from one range partitioning by length and number.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import giving_back, kept_by_workers, map_docs, stored

#: Entries of each of the two generations of a worker's memo of tokenised letters, and characters of an entry at most.
MEMO_WORDS, MEMO_CHARS = 120_000, 40
#: Characters of texts that are tokenised at once, each distinct word of them once.
STRETCH_CHARS = 4 << 20


def _bytes_of(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Memo(dict):
    """What ``make`` gives for a text, remembered in two generations of ``bound`` texts at most."""

    def __init__(self, make: Callable[[str], bytes], bound: int):
        super().__init__()
        self.make, self.bound, self.older = make, bound, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = self.make(text)
        if len(text) <= MEMO_CHARS:
            if len(self) >= self.bound:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


class WordTokenizer:
    """Ids of texts by a tokenizer whose pre-tokenizer never joins across spaces, by the distinct words of many texts.

    Words of plain Latin letters, which ASCII punctuation may follow, are lowered letters and a run of marks: the letters go
    straight to the vocabulary model, and what comes out is remembered for all words that hold them. All other words go
    through the whole tokenizer.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        letters = [chr(c) for c in (*range(97, 123), *range(0xDF, 0x100)) if c != 0xF7]
        self.table = {ord(c): "".join(x for x, _ in self.tok.pre_tokenizer.pre_tokenize_str(c)) for c in letters}
        self.plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
        self.stems, self.marks = _Memo(self._stem, memo_words), _Memo(self._slow, memo_words)

    def _slow(self, word: str) -> bytes:
        return _bytes_of(self.tok.encode(word, add_special_tokens=False).ids)

    def _stem(self, letters: str) -> bytes:
        return _bytes_of([t.id for t in self.tok.model.tokenize(letters.translate(self.table))])

    def _word(self, word: str) -> bytes:
        found = self.plain.fullmatch(word)
        if not found:
            return self._slow(word)
        letters, marks = found.groups()
        ids = self.stems[letters.lower()]
        return ids + self.marks[marks] if marks else ids

    def _stretch(self, texts: pa.Array) -> Iterator[bytes]:
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        words, cuts = split.flatten().dictionary_encode(), split.offsets.to_pylist()
        del split  # the words of all texts; each distinct one is in the dictionary
        pa.default_memory_pool().release_unused()
        ids, index = [self._word(w) for w in words.dictionary.to_pylist()], words.indices.to_numpy()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield b"".join(map(ids.__getitem__, index[a:b].tolist()))

    def batch_ids(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; a null text has none.

        Of an Arrow array only stretches are copied, and only texts longer than a stretch become Python's.
        """
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        first, held = 0, 0
        for i, size in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
            if held + size > STRETCH_CHARS and first < i:
                yield from self._stretch(texts[first:i])
                first, held = i, 0
            held += size
            if size > STRETCH_CHARS:  # cut where words end
                yield b"".join(ids for part in _parts(texts[i].as_py()) for ids in self._stretch(pa.array([part], pa.large_string())))
                first, held = i + 1, 0
        if first < len(texts):
            yield from self._stretch(texts[first:])

    def ids(self, text: str) -> bytes:
        """Ids of one text."""
        return next(self.batch_ids([text]))


def _parts(text: str) -> Iterator[str]:
    """A text cut at white space into parts of ``STRETCH_CHARS`` characters or a word more."""
    text, at = text.replace("\n", " "), 0
    while at < len(text):
        end = text.find(" ", at + STRETCH_CHARS)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end + 1


@kept_by_workers
def worker_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a Python worker, with its memo, for all tasks of a stage that the worker runs."""
    return WordTokenizer(path)


def spfhp(histogram: dict[int, int], max_length: int) -> list[tuple[int, tuple[int, ...]]]:
    """Shortest-pack-first histogram packing: (count, piece lengths) patterns, from {length: count}."""
    free: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            room = max((r for r, packs in free.items() if packs and r >= length), default=0)
            if not room:
                free[max_length - length].append((left, (length,)))
                break
            count, pack = free[room].pop()
            used = min(count, left)
            if count > used:
                free[room].append((count - used, pack))
            free[room - length].append((used, (*pack, length)))
            left -= used
    return [x for room in sorted(free) for x in free[room]]


def slots_of(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """For each length the slots in order of rank: columns first rank, first sequence, offset."""
    taken: dict[int, int] = defaultdict(int)
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for count, pack in patterns:
        offset = 0
        for length in pack:
            slots[length].append((taken[length], sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    return {k: np.array(v, dtype=np.int64) for k, v in slots.items()}


def _pieces(path: str, max_length: int, end_id: int) -> Callable:
    """The pieces of each text, from Arrow batches: a worker never holds the texts of a batch a second time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_tokenizer(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        step = max_length * 4
        for batch in batches:
            rows = []
            for row, ids in enumerate(tok.batch_ids(batch.column("text"))):
                raw = ids + end
                total = len(raw) // 4
                rows += [(row, at // 4, min(step, len(raw) - at) // 4, zlib.crc32(raw[at : at + step]), total) for at in range(0, len(raw), step)]
            own, *numbers = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            doc_ids = batch.column("doc_id").take(pa.array(own))
            yield pa.RecordBatch.from_arrays([doc_ids, *map(pa.array, numbers)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the pieces of each length within a sorted partition."""
    last, n = -1, 0
    for batch in batches:
        lengths = batch["length"].to_numpy()
        new = np.flatnonzero(np.diff(lengths, prepend=last) != 0)
        index = np.arange(len(lengths))
        first = np.zeros(len(lengths), dtype=np.int64)
        first[new] = index[new]
        np.maximum.accumulate(first, out=first)
        local = index - first
        head = new[0] if len(new) else len(lengths)
        local[:head] += n
        if len(lengths):
            last, n = int(lengths[-1]), int(local[-1]) + 1
        yield batch.assign(local=local)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_length: int = 2048, end_id: int = 1) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: a row for each piece.

    A null or empty text is the end id alone. Repeated rows are packed each on their own. Extra columns are ignored;
    no rows give no rows. ``tokenizer_path`` has to be readable on the executors.
    """
    id_type = docs.select(id_col).schema[0].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    base = "start long, length long, ids_crc32 long, doc_tokens long"
    cut = rows.mapInArrow(giving_back(_pieces(tokenizer_path, max_length, end_id)), f"doc_id string, {base}").withColumn("doc_id", F.col("doc_id").cast(id_type))
    # A number of its own for each piece, stored, spreads pieces of one length however many share an id.
    pieces = stored(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # max_length rows at most
    slots = slots_of(spfhp(histogram, max_length))
    order = ["length", "piece"]
    ranged = map_docs(pieces.repartitionByRange(*order).sortWithinPartitions(*order), _numbered, f"{base}, piece long, local long")
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()), "ranked-pieces")
    counts = ranged.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = stored(counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")), "rank-begins")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths, rank = batch["length"].to_numpy(), (batch["begin"] + batch["local"]).to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                own, table = lengths == length, slots[int(length)]
                slot = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
                sequence[own] = slot[:, 1] + rank[own] - slot[:, 0]
                offset[own] = slot[:, 2]
            yield batch[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].assign(sequence_id=sequence, offset=offset)

    ranked = ranged.join(begins, ["length", "part"]).drop("piece", "part")
    return map_docs(ranked, place, "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
