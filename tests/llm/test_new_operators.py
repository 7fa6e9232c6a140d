"""Exact dedup, filter audit and token alignment against plain-Python twins."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import exact_dedup, filter_audit, token_alignment
from parlance.llm.queries import tokenizer_path
from tests.llm import fixtures as fx

PATHS = ("byte_bpe_50k.json", "piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return fx.documents(spark).cache()


# exact dedup


def copies_twin(rows, largest):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(fx.LOWER)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if largest else min)(known) if known else None
        left = 1  # of rows with equal ids and texts one stays
        for i in ids:
            kept = i == best and left > 0
            left -= kept
            out.append((i, best, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(map(str, out))


def test_one_row_of_each_text_stays(docs):
    pairs = [(r[0], r[1]) for r in fx.rows()]
    for keep in ("largest", "smallest"):
        found = exact_dedup.dedup_exact(docs, keep=keep).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert sorted(str(tuple(r)) for r in found) == copies_twin(pairs, keep == "largest")


def test_large_groups_over_many_partitions_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ROUND_BITS", 2)
    monkeypatch.setattr(exact_dedup, "FRAME", 7)
    monkeypatch.setattr(exact_dedup, "ENTRIES", 50)
    assert exact_dedup.digit_plan(3000, 4) == [2, 2, 2]
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 700}" if i % 3 == 1 else f"own {i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    found = exact_dedup.dedup_exact(frame).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(str(tuple(r)) for r in found) == copies_twin(rows, True)


def test_entries_with_equal_leading_words_are_told_apart():
    e = np.zeros(6, dtype=exact_dedup._ENTRY)
    e["d0"], e["d3"], e["size"], e["n"], e["has"] = 5, [2, 1, 2, 1, 2, 2], [9, 9, 9, 9, 9, 8], 1, [1, 1, 1, 0, 1, 1]
    e["id"], e["row"] = [4, 4, 4, 0, 7, 3], range(6)
    found = exact_dedup.merged(e, True)
    assert [(int(x["d3"]), int(x["size"]), int(x["id"]), int(x["row"]), int(x["n"])) for x in found] == [(1, 9, 4, 1, 2), (2, 8, 3, 5, 1), (2, 9, 7, 4, 3)]


def test_exact_dedup_of_nothing_and_case(spark):
    assert exact_dedup.dedup_exact(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    frame = spark.createDataFrame([(1, "Ab"), (2, "aB"), (3, "É"), (4, "é")], "doc_id int, text string")
    assert {r["doc_id"] for r in exact_dedup.dedup_exact(frame).where("kept").collect()} == {2, 3, 4}
    assert exact_dedup.dedup_exact(frame, fold_case=False).where("kept").count() == 4
    with pytest.raises(ValueError):
        exact_dedup.dedup_exact(frame, keep="first")


# filter audit


def audit_twin(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least: dict[str, int] = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = collections.defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t]]
        parts[lang or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, members in parts.items():
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = members
            for k, f in enumerate(order):
                at = "ABCDE".index(f)
                gone = [m for m in left if m[0][at]]
                rest = [m for m in left if not m[0][at]]
                redundant = sum(m[0][at] for m in members) - len(gone)
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = (len(rest), len(gone), redundant, sum(m[0][at] and sum(m[0]) == 1 for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone))
                left = rest
        for (p, order, k), v in list(out.items()):
            if p == part:
                out[p, order, k] = (*v[:6], shapley[order[k - 1]])
    return out


def test_audit_is_that_of_applying_every_order(spark, docs):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 3)] + [(3, 1, 0), (None, 1, 1), (6, None, None), (9, 0, 1)]
    found = filter_audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    by_row = {tuple(r)[:3]: tuple(r)[3:] for r in found.collect()}
    assert by_row == audit_twin([r[:3] for r in fx.rows()], labels)


def test_parity_sums_give_the_cells_back(spark):
    r = np.random.default_rng(3)
    counts = r.integers(0, 1 << 40, 32).tolist()
    frame = spark.createDataFrame(list(enumerate(counts)), "mask int, n long").agg(*filter_audit.parity_sums(F.col("mask"), F.col("n")))
    assert frame.select(filter_audit.cells_of(F.array(*(f"s{w}" for w in range(32)))).alias("c")).first()["c"] == counts


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs, labels).count() == 0
    one = spark.createDataFrame([(None, None, None)], docs.schema)
    found = filter_audit.audit_filters(one, labels).collect()
    assert len(found) == 600 and {r["part"] for r in found} == {""} and all(r["redundant"] == 0 for r in found)


# token alignment


def tokens_of(text):
    """Ids and bytes of the tokens of a space and the text, by both tokenizers, encoded as a whole."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = tokens_of.__dict__.setdefault("both", (Tokenizer.from_file(tokenizer_path(PATHS[0])), SentencePieceProcessor(model_file=tokenizer_path(PATHS[1]))))
    a.encode_special_tokens = True
    letters = token_alignment.byte_letters()
    found = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(letters[c] for c in entry)) for i, entry in zip(found.ids, found.tokens, strict=True)]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return left, right


def alignment_twin(rows):
    links, firsts = [], []
    for i, t in rows:
        a, b = tokens_of(t) if t else ([], [])
        if b"".join(x for _, x in a) != (" " + (t or "")).encode() or b"".join(x for _, x in b) != (" " + (t or "")).encode():
            a, b = [], []
        spans = lambda tokens: list(itertools.pairwise([0, *itertools.accumulate(len(x) for _, x in tokens)]))
        sa, sb = spans(a), spans(b)
        own, j = [], 0
        for k, (lo, hi) in enumerate(sa):
            while sb[j][1] <= lo:
                j += 1
            m = j
            while m < len(sb) and sb[m][0] < hi:
                own.append((a[k][0], b[m][0]))
                m += 1
        cuts = sorted({hi for _, hi in sa} & {hi for _, hi in sb})
        group = lambda tokens, ends, lo, hi: ",".join(str(tokens[k][0]) for k in range(len(tokens)) if lo < ends[k][1] <= hi)
        text = ";".join(group(a, sa, lo, hi) + "|" + group(b, sb, lo, hi) for lo, hi in itertools.pairwise([0, *cuts]))
        links.append(own)
        firsts.append((i, len(a), len(b), len(cuts), len(own), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    counts = collections.Counter(x for own in links for x in own)
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(str((*f[:5], sum(counts[x] == most[x[1]] for x in own), sum(counts[x] for x in own), f[5])) for f, own in zip(firsts, links, strict=True))


ODD = [
    "a  b", "  two leading", "tail  ", "\n", " \n x", "a\n\nb\n c", "a\r\nb;\r\n", "tab\tand\x0bvt", "a▁b c", "<s> </s> <0x0A> <|endoftext|> <unk>", "ﬁ Ａ ½ \xa0x", "\x00 \x1c x\x1cy \x1c",
    "日本語 の テキスト", "😀 👩‍👩‍👧 é", "don't we'll I'm", "x" * 300 + " " + "1234567890" * 30, "a b 　c", "word" + " " * 50 + "word", "﻿bom", "é ́x",
]


def collected(frame):
    return sorted(str(tuple(r)) for r in frame.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_alignment_is_that_of_whole_texts(spark):
    r = np.random.default_rng(5)
    parts = ["the", "Wort", "\n", " ", "  ", "é", "▁", "1,2", "don't", "\r\n", "\t", "日本", "x́", "<s>", "\x00"]
    mixed = [" ".join(r.choice(parts, 12)) + "".join(r.choice(parts, 6)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([None, "", *ODD, *ODD[:3], *mixed])] + [(None, "no id"), (3, "same id"), (3, "same id")]
    frame = spark.createDataFrame([(*x, 1, "x") for x in rows], "doc_id long, text string, n long, rare string").repartition(3)
    want = alignment_twin(rows)
    paths = [tokenizer_path(p) for p in PATHS]
    assert collected(token_alignment.align_tokens(frame, *paths)) == want
    # All but the most frequent pairs, and all pairs, are joined by an exchange.
    assert collected(token_alignment.align_tokens(frame, *paths, most_pairs=20)) == want
    assert collected(token_alignment.align_tokens(frame, *paths, most_pairs=0)) == want


def test_alignment_of_documents(docs):
    rows = [(r[0], r[1]) for r in fx.rows()]
    assert collected(token_alignment.align_tokens(docs, *(tokenizer_path(p) for p in PATHS))) == alignment_twin(rows)


def test_alignment_of_long_texts_in_small_portions(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "AT_ONCE", 1000)
    monkeypatch.setattr(token_alignment, "MEMO_PIECES", 5)
    monkeypatch.setattr(token_alignment, "HANDED_ON", 30)
    rows = list(enumerate(["1 2 " * 400, "word " * 400, "x" * 20_000, "\n" * 800, " ".join(map(str, range(400)))]))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(token_alignment.align_tokens(frame, *(tokenizer_path(p) for p in PATHS))) == alignment_twin(rows)


def test_alignment_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align_tokens(frame, *(tokenizer_path(p) for p in PATHS)).count() == 0
