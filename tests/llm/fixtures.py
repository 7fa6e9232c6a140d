"""Small tables with every awkward case, and plain-Python twins of the operators."""

from __future__ import annotations

import collections
import hashlib
import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns whose names clash with those that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, h long, n long, words string, found string"


def texts() -> list[str | None]:
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage, line = prose(120), prose(70), "All rights reserved here."
    out: list[str | None] = [None, "", " \n\t\n", "one", "One two", "x" * 5000, "\x00 \x01 a\x00b", "æøå 😀 ñandú", base, base, base.upper()]
    for k in range(12):  # near copies, each with a few words changed
        words = base.split(" ")
        for _ in range(k):
            words[r.randrange(len(words))] = prose(1)
        out.append(" ".join(words))
    out += [prose(40) + "\n" + passage + "\n" + prose(60) for _ in range(4)]
    out += [line + "\n" + prose(30) + "\n  " + line.upper() + " \t" for _ in range(11)]
    out += [prose(r.randint(1, 300)) for _ in range(20)]
    out += ["!!! " * 40, "#$% " * 40, "same " * 60, prose(6000), "mail a@b.co and +1 (555) 123-4567, 10.0.0.255, 4111 1111 1111 1111, 999.1.1.1 token = abcdef0123456789abcd"]
    return out


def rows() -> list[tuple]:
    out = [(i, t, ("en", "de", None)[i % 3], f"s{i % 2}", len(t or ""), "k", 1, 2, "w", "f") for i, t in enumerate(texts())]
    return [*out, out[8], (None, texts()[9], None, None, None, None, None, None, None, None)]  # a repeated row; a row without an id


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def shingles(text: str | None, width: int) -> set:
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(pairs: list[tuple[int, str | None]], width: int, percent: int) -> dict[int, int]:
    items = [(i, shingles(t, width)) for i, t in pairs if i is not None]
    parent = {i: i for i, _ in items}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(items):
        for j, b in items[k + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in items}


def repeats(all_texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    raws = [(t or "").encode() for t in all_texts]
    seen = collections.Counter(r[s : s + length] for r in raws for s in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for s in range(len(r) - length + 1):
            if seen[r[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        rest = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(r), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out
