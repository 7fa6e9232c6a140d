"""Alignment of the tokens of two tokenizers by the bytes that they own.

Token numbers are repeated over the bytes of their tokens, for both tokenizers. Consecutive bytes with another pair of
owners are links, tokens that overlap; where both owners change at once, a group of tokens ends.

Texts are tokenised once, and their ids stored. How often a pair of ids is linked in the corpus is counted from the ids;
then each text's links look their counts up. Pairs that are frequent enough to be among the first ``MOST_PAIRS`` go to all
tasks, the others are joined by an exchange.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import chunks, map_docs, stored, texts_of

#: Pairs that are sent to all tasks, at most (17 bytes each), and pairs that a task counts before it hands them on.
MOST_PAIRS, HANDED_ON = 1 << 20, 1 << 19
#: Bytes of text that are tokenised at once; a longer text is taken whole.
AT_ONCE = 1 << 20
#: Pieces of text of each of the two generations of a worker's memo, and characters of a piece in it at most.
MEMO_PIECES, MEMO_CHARS = 100_000, 40
#: Pieces begin at a space that stands alone before something else: there both tokenizers begin a token.
_CUT = re.compile(r"(?<! )(?= \S)")
# Fixed value: what byte-level vocabularies take for words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """Which byte each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.b = SentencePieceProcessor(model_file=path_b)
        self.bytes_a = self._load(path_a)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # Texts may only be taken apart at spaces if no piece of B reaches over one.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.memo: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}
        self.types = tuple("<u4" if len(own) > 1 << 16 else "<u2" for own in (self.bytes_a, self.bytes_b))
        self.sizes_a, self.sizes_b = np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))
        # What an id writes in a list of groups: a comma behind it inside its side of a group, else the mark that ends the side.
        a, b = [str(i).encode() for i in range(len(self.bytes_a))], [str(i).encode() for i in range(len(self.bytes_b))]
        written = np.array([x + mark for names, mark in ((a, b","), (a, b"|"), (b, b","), (b, b";")) for x in names])
        self.written = written.view(np.uint8).reshape(len(written), -1)  # filled up with zeros

    def _load(self, path: str) -> list[bytes]:
        """Set ``ids_a``, the ids of texts by A, and give the bytes of every id.

        Where ids follow the order of merges, they are ranks, and the ranks' encoder is the faster one.
        """
        import tiktoken
        from tokenizers import Tokenizer

        with open(path) as file:
            model = json.load(file)["model"]
        vocabulary, merges = model["vocab"], [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        letters = byte_letters()
        out = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            if set(entry) <= letters.keys():
                out[i] = bytes(letters[c] for c in entry)
        first = vocabulary["".join(merges[0])] if merges else 0
        if first == 256 and all(vocabulary["".join(x)] == first + i for i, x in enumerate(merges)):
            ranks = {raw: i for i, raw in enumerate(out) if raw and i < first + len(merges)}
            encoder = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            self.ids_a = lambda texts: [encoder.encode_ordinary(t) for t in texts]
        else:
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.ids_a = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return out

    def _encoded(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids, packed, of texts that begin with a space; none if one of the tokenizers doesn't give the bytes back."""
        raws = [t.encode("utf-8") for t in texts]
        sound, packed = np.ones(len(texts), dtype=bool), []
        for ids, entries, sizes, kind in ((self.ids_a(texts), self.bytes_a, self.sizes_a, self.types[0]), (self.b.encode([t[1:] for t in texts], num_threads=1), self.bytes_b, self.sizes_b, self.types[1])):  # B adds the space itself
            flat = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int64)
            ends = np.cumsum([0, *map(len, ids)])
            if b"".join([entries[x] for x in flat.tolist()]) != b"".join(raws) or (np.diff(np.cumsum(np.append(0, sizes[flat]))[ends]) != [len(r) for r in raws]).any():
                sound &= [b"".join([entries[x] for x in own]) == raw for own, raw in zip(ids, raws, strict=True)]
            width, data = np.dtype(kind).itemsize, flat.astype(kind).tobytes()
            packed.append([data[a * width : b * width] for a, b in itertools.pairwise(ends.tolist())])
        return [(a, b) if ok else None for a, b, ok in zip(*packed, sound.tolist(), strict=True)]

    def ids(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of a space and each text by both, packed; none if a text is empty or one of them doesn't give its bytes back."""
        if len(self.memo) > MEMO_PIECES:
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        pieces = [_CUT.split(" " + t) if t and self.cuts else [" " + t] if t else [] for t in texts]
        new = set().union(*pieces).difference(memo, ("",))
        missing = [w for w in new if w not in older]
        found = {w: older[w] for w in new.difference(missing)} | dict(zip(missing, self._encoded(missing), strict=True))
        memo.update(found)  # long pieces leave again below
        out = []
        for t, own in zip(texts, pieces, strict=True):
            ids = [memo[w] for w in own if w]
            if None in ids:  # the bytes of the whole text count
                ids = self._encoded([" " + t])
            out.append((b"", b"") if not ids or None in ids else (b"".join([x[0] for x in ids]), b"".join([x[1] for x in ids])))
        for w in missing:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return out

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the tokens of each link, and whether a group begins with it."""
        owner_a, owner_b = np.repeat(np.arange(len(a)), self.sizes_a[a]), np.repeat(np.arange(len(b)), self.sizes_b[b])
        new_a, new_b = np.diff(owner_a, prepend=-1) != 0, np.diff(owner_b, prepend=-1) != 0
        at = np.flatnonzero(new_a | new_b)
        return owner_a[at], owner_b[at], (new_a & new_b)[at]

    def groups(self, a: np.ndarray, b: np.ndarray, linked_a: np.ndarray, linked_b: np.ndarray, begins: np.ndarray) -> bytes:
        """Ids by groups: ``a1,a2|b1;a3|b2,b3``."""
        first_a, first_b = linked_a[begins], linked_b[begins]  # of each group
        group_a, group_b = np.searchsorted(first_a, np.arange(len(a)), side="right") - 1, np.searchsorted(first_b, np.arange(len(b)), side="right") - 1
        ends_a, ends_b = np.append(np.diff(group_a) != 0, True), np.append(np.diff(group_b) != 0, True)
        out = np.empty(len(a) + len(b), dtype=np.int64)
        out[np.arange(len(a)) + first_b[group_a]] = a + ends_a * len(self.bytes_a)
        after_a = np.append(first_a[1:], len(a))  # tokens A up to the end of each group
        out[np.arange(len(b)) + after_a[group_b]] = b + 2 * len(self.bytes_a) + ends_b * len(self.bytes_b)
        letters = self.written[out].ravel()
        return letters[letters != 0].tobytes()[:-1]


@functools.lru_cache(maxsize=1)
def worker_tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """The tokenizers of a Python worker, for all tasks that it runs."""
    return Tokenizers(path_a, path_b)


def _tokenised(path_a: str, path_b: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = worker_tokenizers(path_a, path_b)
        for batch in batches:
            texts = [t or "" for t in texts_of(batch)]
            ids = [x for first, last, _ in chunks(texts, AT_ONCE) for x in both.ids(texts[first:last])]
            yield pd.DataFrame({"doc_id": batch["doc_id"].tolist(), "a": [x[0] for x in ids], "b": [x[1] for x in ids]})

    return run


def _unpacked(both: Tokenizers, a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(raw, dtype=kind).astype(np.int64) for raw, kind in zip((a, b), both.types, strict=True))


def _counted(path_a: str, path_b: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = worker_tokenizers(path_a, path_b)
        keys, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        loose: list[np.ndarray] = []
        size = 0

        def settled() -> tuple[np.ndarray, np.ndarray]:
            values, weights = np.unique(np.concatenate([*loose, keys[:0]]), return_counts=True)
            order = np.argsort(np.concatenate([keys, values]), kind="stable")
            merged, counts = np.concatenate([keys, values])[order], np.concatenate([sums, weights])[order]
            starts = np.flatnonzero(np.diff(merged, prepend=-1))
            return merged[starts], np.add.reduceat(counts, starts) if len(starts) else counts

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                if a:
                    ids_a, ids_b = _unpacked(both, a, b)
                    linked_a, linked_b, _ = both.links(ids_a, ids_b)
                    loose.append(ids_a[linked_a] << 32 | ids_b[linked_b])
                    size += len(linked_a)
                if size > HANDED_ON:
                    keys, sums = settled()
                    loose, size = [], 0
                    if len(keys) > HANDED_ON:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])
                        keys, sums = keys[:0], sums[:0]
        keys, sums = settled()
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])

    return run


def tokenised(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, a, b, row``: ids of a space and the text by both tokenizers as little-endian numbers, of two bytes where that is enough; stored."""
    rows = map_docs(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), _tokenised(path_a, path_b), "a binary, b binary")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "token-ids")


def count_pairs(tokens: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``pair, n, best``: how many links of the corpus hold a pair of ids (A's above 32 bits, B's below), and whether no other pair of its B id has more."""
    partial = tokens.select("a", "b").mapInArrow(_counted(path_a, path_b), "pair long, n long")
    pairs = stored(partial.groupBy("pair").agg(F.sum("n").alias("n")), "token-pairs")
    of_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = pairs.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))  # as many rows as B has ids, at most
    return pairs.join(F.broadcast(most), of_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent(pairs: DataFrame, bound: int) -> int:
    """The least count so that ``bound`` pairs at most have it or more, from a histogram by powers of two and their quarters."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 4).cast("int")
    histogram = sorted(((r["step"], r["least"], r["k"]) for r in pairs.groupBy(step.alias("step")).agg(F.min("n").alias("least"), F.count("*").alias("k")).collect()), reverse=True)
    total, least = 0, 1 << 62
    for _, n, k in histogram:
        total += k
        if total > bound:
            break
        least = n
    return least


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row for each row of ``docs``.

    ``path_a`` names a byte-level vocabulary, ``path_b`` a piece model; a space is put before the text. Texts that are
    null or empty, or which one of the two does not give back byte by byte, have no tokens: zeros and ``''``. Texts of
    any length are taken whole; rows that repeat, in id or text, count each. Other columns don't matter.
    """
    tokens = tokenised(docs, path_a, path_b, id_col, text_col)
    pairs = count_pairs(tokens, path_a, path_b)
    frequent = _frequent(pairs, most_pairs)
    sent = pairs.where(F.col("n") >= frequent).toArrow().sort_by("pair")  # bounded by most_pairs
    table = docs.sparkSession.sparkContext.broadcast((sent["pair"].to_numpy(), sent["n"].to_numpy(), sent["best"].to_numpy()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = worker_tokenizers(path_a, path_b)
        keys, counts, best = table.value
        for batch in batches:
            rows = []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                if not a:
                    rows.append((0, 0, 0, 0, 0, 0, "", []))
                    continue
                ids_a, ids_b = _unpacked(both, a, b)
                linked_a, linked_b, begins = both.links(ids_a, ids_b)
                pair = ids_a[linked_a] << 32 | ids_b[linked_b]
                at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
                known = keys[at] == pair if len(keys) else np.zeros(len(pair), dtype=bool)
                sha = hashlib.sha256(both.groups(ids_a, ids_b, linked_a, linked_b, begins)).hexdigest()
                rows.append((len(ids_a), len(ids_b), int(begins.sum()), len(pair), int(best[at[known]].sum()), int(counts[at[known]].sum()), sha, pair[~known].tolist()))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rare")
            yield pd.DataFrame({"doc_id": batch["doc_id"].tolist(), "row": batch["row"].tolist()} | dict(zip(names, columns, strict=True)))

    schema = "row long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rare array<long>"
    found = map_docs(tokens, run, schema)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if pairs.where(F.col("n") < frequent).isEmpty():
        return found.select(*columns)
    found = stored(found, "aligned")
    # Each of these pairs has few links by its count, so no key is hot.
    loose = found.select("row", F.explode("rare").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("k")).join(pairs.where(F.col("n") < frequent), "pair")
    added = loose.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("more_best"), F.sum(F.col("k") * F.col("n")).alias("more_count"))
    whole = found.join(added, "row", "left")
    return whole.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_count", F.lit(0))).select(*columns)
